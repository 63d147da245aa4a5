"""A stored table of results by key digest: only questions that nobody asked before go on. Inventory 91, 128, 171.

A digest covers the question and everything that an answer depends on (see :func:`corvine.functions.identity.cache_digest`).
Results and uses are Parquet folders, one for each batch of questions. The least recently used results go first when there
are more than there is room for. One writer at a time; a batch that broke off has written whole folders or none that count.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corvine.runtime import materialize


class ResultTable:
    def __init__(self, spark: SparkSession, path: str, schema: str, room: int | None = None):
        """``schema``: the columns of a result, without its digest. ``room``: results that are kept; None for all, 0 for none."""
        self.spark, self.path, self.room = spark, path.rstrip("/"), room
        self.columns = StructType.fromDDL(schema).names
        self._schemas = {"results": f"digest string, {schema}, batch bigint", "used": "digest string, batch bigint"}
        self._hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._fs = self._hadoop.Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _batches(self, name: str) -> list[int]:
        """Numbers of the batches that were written to their end."""
        root = self._hadoop.Path(f"{self.path}/{name}")
        folders = [f.getPath() for f in self._fs.listStatus(root)] if self._fs.exists(root) else []
        return sorted(int(p.getName().partition("=")[2]) for p in folders if p.getName().startswith("batch=") and self._fs.exists(self._hadoop.Path(p, "_SUCCESS")))

    def _read(self, name: str) -> DataFrame:
        paths = [f"{self.path}/{name}/batch={b}" for b in self._batches(name)]
        if not paths:
            return self.spark.createDataFrame([], self._schemas[name])
        return self.spark.read.schema(self._schemas[name]).option("basePath", f"{self.path}/{name}").parquet(*paths)

    def results(self) -> DataFrame:
        """digest and result columns; of a digest that was stored twice the first stays."""
        first = F.min_by(F.struct(*self.columns), "batch").alias("r")
        return self._read("results").groupBy("digest").agg(first).select("digest", "r.*")

    def _next(self) -> int:
        return max((*self._batches("results"), *self._batches("used")), default=-1) + 1

    def answered(self, questions: DataFrame, key: str, digest: Column, answer: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """``key`` and the result of each of ``questions`` (key, text).

        ``answer`` gets (digest, text) of the questions that are not known, each once, and gives digest and result; with
        none left it is not called, so nothing behind it is read. A question it gives no row for has a result of nulls.
        """
        asked = materialize(questions.select(F.col(key), F.col("text"), digest.alias("digest")), "asked-results")
        batch, known = self._next(), self.results()
        new = asked.join(known.select("digest"), "digest", "left_anti").groupBy("digest").agg(F.min("text").alias("text"))
        new = materialize(new, "new-questions")
        if self.room == 0:
            found = materialize(answer(new).select("digest", *self.columns), "results")
        else:
            if not new.isEmpty():
                answer(new).select("digest", *self.columns).write.mode("overwrite").parquet(f"{self.path}/results/batch={batch}")
            asked.select("digest").distinct().write.mode("overwrite").parquet(f"{self.path}/used/batch={batch}")
            found = materialize(self.results().join(asked.select("digest").distinct(), "digest", "left_semi"), "results")
            self._evict()
        return asked.join(found, "digest", "left").select(key, *self.columns)

    def _evict(self) -> None:
        """Write the results that stay and their last uses as the next batch, then delete the others."""
        if self.room is None or self._read("results").select("digest").distinct().count() <= self.room:
            return
        last = self._read("used").groupBy("digest").agg(F.max("batch").alias("last"))
        kept = materialize(last.orderBy(F.col("last").desc(), "digest").limit(self.room), "kept")
        old = {name: self._batches(name) for name in ("results", "used")}
        batch = self._next()
        self.results().join(kept, "digest", "left_semi").write.parquet(f"{self.path}/results/batch={batch}")
        kept.select("digest").write.parquet(f"{self.path}/used/batch={batch}")
        for name, numbers in old.items():
            for b in numbers:
                self._fs.delete(self._hadoop.Path(f"{self.path}/{name}/batch={b}"), True)
