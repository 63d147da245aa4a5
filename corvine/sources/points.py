"""The points table: Parquet in buckets of point ids, copied on write, with guards. Inventory 10, 15-20, 46, 53, 160.

Points are dealt to buckets by a hash of their id. A write makes a new version folder that holds only the buckets it
touches, and then moves the pointer (``table.json``: for each bucket the versions that make it up) in one rename. So an
upsert rewrites its buckets and no others, an append adds to them, a reader sees the table as it was when it began, and
a write that broke off leaves the table as it was. A bucket of more than ``MOST_PARTS`` versions is written together.
Within a bucket points are partitioned by source. Beside each version lies which of its files hold which tags, so a filter
on tags opens those files only. One writer at a time.
"""

from __future__ import annotations

import json
import re
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

#: Buckets of a new table; a bucket should be some files' worth of points, so larger tables ask for more.
BUCKETS = 64
MOST_PARTS = 8
#: Columns that the layout adds; points may not have columns of these names.
OWN = ("_version", "_bucket")


def _stored(schema: StructType) -> dict:
    """A schema as JSON in which everything may be null, as what comes later may be."""
    return json.loads(re.sub(r'("(?:nullable|containsNull|valueContainsNull)"\s*:\s*)false', r"\1true", schema.json()))


class CollectionMismatch(ValueError):
    """A table or its vectors do not have the expected shape."""


class PointsTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._hadoop = jvm.org.apache.hadoop.fs
        self._fs = self._hadoop.Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _p(self, name: str):
        return self._hadoop.Path(f"{self.path}/{name}")

    def exists(self) -> bool:
        return self._fs.exists(self._p("table.json"))

    def _meta(self) -> dict:
        return json.loads(self.spark.read.text(f"{self.path}/table.json", wholetext=True).first()[0])

    def _save(self, meta: dict) -> None:
        out = self._fs.create(self._p("table.json.new"), True)
        out.write(bytearray(json.dumps(meta, sort_keys=True).encode()))
        out.close()
        over = self.spark.sparkContext._gateway.new_array(self._hadoop.Options.Rename, 1)
        over[0] = self._hadoop.Options.Rename.OVERWRITE
        files = self._hadoop.FileContext.getFileContext(self._fs.getUri(), self._fs.getConf())
        files.rename(self._p("table.json.new"), self._p("table.json"), over)

    def ensure(self, dim: int, sparse: bool = True, distance: str = "cosine", recreate: bool = False, buckets: int = BUCKETS) -> bool:
        """True if the table was made; an existing one must have this shape."""
        if recreate and self._fs.exists(self._p("")):
            self._fs.delete(self._hadoop.Path(self.path), True)
        if self.exists():
            meta = self._meta()
            if (meta["dim"], meta["distance"]) != (dim, distance):
                raise CollectionMismatch(f"table has {meta['dim']} {meta['distance']} dimensions, not {dim} {distance}")
            if sparse and not meta["sparse"]:
                raise CollectionMismatch("table was made without sparse vectors and must be rebuilt to have them")
            return False
        self._fs.mkdirs(self._hadoop.Path(self.path))
        self._save({"dim": dim, "sparse": sparse, "distance": distance, "version": 0, "partition": "source", "buckets": buckets, "parts": {}, "schema": None})
        return True

    def read(self) -> DataFrame | None:
        """The points as they stand; None if there never were any."""
        meta = self._meta()
        return self._points(meta, [int(b) for b in meta["parts"]])

    def bucket_of(self, key: str = "point_id") -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self._meta()["buckets"])).cast("int")

    def _points(self, meta: dict, buckets: list[int]) -> DataFrame | None:
        """The points of some buckets, read from their folders alone."""
        if meta["schema"] is None:
            return None
        schema = StructType.fromJson(meta["schema"])
        paths = [f"{self.path}/_version={v}/_bucket={b}" for b in buckets for v in meta["parts"].get(str(b), [])]
        if not paths:
            return self.spark.createDataFrame([], schema)
        whole = StructType([*schema, StructField(OWN[0], LongType()), StructField(OWN[1], IntegerType())])
        return self.spark.read.schema(whole).option("basePath", self.path).parquet(*paths).select(*[F.col(f"`{f.name}`") for f in schema])

    def count(self) -> int:
        points = self.read()
        return 0 if points is None else points.count()

    def _touched(self, points: DataFrame) -> list[int]:
        return sorted(r[0] for r in points.select(self.bucket_of()).distinct().collect())

    def _write(self, points: DataFrame, meta: dict, replaced: set[int]) -> list[int]:
        """Write ``points`` as the next version; their buckets in ``replaced`` consist of it alone afterwards. The buckets written."""
        meta["version"] += 1
        folder = f"{self.path}/_version={meta['version']}"
        rows = points.withColumn(OWN[1], self.bucket_of()).hint("rebalance", OWN[1], "source")
        rows.write.mode("overwrite").partitionBy(OWN[1], "source").option("parquet.bloom.filter.enabled#doc_id", "true").parquet(folder)
        names = [f.getPath().getName() for f in self._fs.listStatus(self._hadoop.Path(folder))]
        written = sorted(int(n.partition("=")[2]) for n in names if n.startswith(OWN[1] + "="))
        for b in written:
            before = [] if b in replaced else meta["parts"].get(str(b), [])
            meta["parts"][str(b)] = [*before, meta["version"]]
        self._index_tags(points, meta)
        meta["schema"] = meta["schema"] or _stored(points.schema)
        self._save(meta)
        return written

    def _index_tags(self, points: DataFrame, meta: dict) -> None:
        """Which files of the version just written hold which tags: a row for each pair, as a folder of its own."""
        if "tags" not in points.columns:
            return
        folder = f"{self.path}/_version={meta['version']}"
        schema = StructType([points.schema["tags"], StructField(OWN[1], IntegerType())])
        rows = self.spark.read.schema(schema).option("basePath", folder).parquet(folder)
        pairs = rows.select(F.explode("tags").alias("tag"), F.col("_metadata.file_path").alias("file"), OWN[1]).distinct()
        pairs.coalesce(1 + meta["buckets"] // 256).write.mode("overwrite").parquet(f"{self.path}/_tags/{OWN[0]}={meta['version']}")

    def read_tagged(self, tags: list[str]) -> DataFrame | None:
        """The points that have any of ``tags``, read from the files that hold one of them and from no others."""
        meta = self._meta()
        if meta["schema"] is None:
            return None
        schema = StructType.fromJson(meta["schema"])
        live = {(v, int(b)) for b, versions in meta["parts"].items() for v in versions}
        files: list[str] = []
        if live and "tags" in schema.names:
            pairs = self.spark.read.schema(f"tag string, file string, {OWN[1]} int, {OWN[0]} bigint").option("basePath", f"{self.path}/_tags").parquet(*[f"{self.path}/_tags/{OWN[0]}={v}" for v in sorted({v for v, _ in live})])
            found = pairs.where(F.col("tag").isin(list(tags))).select("file", OWN[0], OWN[1]).distinct().collect()
            files = sorted(unquote(r["file"]) for r in found if (r[OWN[0]], r[OWN[1]]) in live)
        if not files:
            return self.spark.createDataFrame([], schema)
        whole = StructType([*schema, StructField(OWN[0], LongType()), StructField(OWN[1], IntegerType())])
        points = self.spark.read.schema(whole).option("basePath", self.path).parquet(*files).select(*[F.col(f"`{f.name}`") for f in schema])
        return points.where(F.arrays_overlap("tags", F.array(*map(F.lit, tags))))

    def _checked(self, points: DataFrame, column: str) -> tuple[DataFrame, dict]:
        meta = self._meta()
        validate_points(points, meta["dim"], column)
        if meta["schema"] is not None:
            points = points.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in StructType.fromJson(meta["schema"])])
        return points, meta

    def upsert(self, points: DataFrame, column: str = "vector") -> list[int]:
        """Rows with a known point_id replace the old ones; only their buckets are read and written, and returned.

        Widths are checked before anything is written.
        """
        points, meta = self._checked(points, column)
        touched = self._touched(points)
        old = self._points(meta, touched)
        return self._write(upserted(points.limit(0) if old is None else old, points), meta, set(touched)) if touched else []

    def append_new(self, points: DataFrame, column: str = "vector") -> list[int]:
        """Only rows whose point_id is not known yet; of a bucket's old files none is rewritten until it has too many."""
        points, meta = self._checked(points, column)
        points = upserted(points.limit(0), points)
        touched = self._touched(points)
        old = self._points(meta, touched)
        if not touched:
            return []
        fresh = points if old is None else fresh_points(old, points)
        full = {b for b in touched if len(meta["parts"].get(str(b), [])) >= MOST_PARTS}
        if full:
            fresh = fresh.unionByName(self._points(meta, sorted(full)))
        return self._write(fresh, meta, full)

    def vacuum(self) -> int:
        """Delete what no bucket refers to any more, and say how many folders; nothing may be reading an older state."""
        used = {(v, int(b)) for b, versions in self._meta()["parts"].items() for v in versions}
        gone = 0
        for f in self._fs.listStatus(self._hadoop.Path(self.path)):
            version = f.getPath().getName().partition("=")[2]
            for g in self._fs.listStatus(f.getPath()) if version else ():
                bucket = g.getPath().getName().partition("=")[2]
                if bucket and (int(version), int(bucket)) not in used:
                    gone += self._fs.delete(g.getPath(), True)
        return gone


def upserted(old: DataFrame, new: DataFrame, key: str = "point_id") -> DataFrame:
    """Rows of ``new`` replace those of ``old`` with their key. Rows have no order, so of new ones that share a key
    the one with the greatest other columns, in their order, stays."""
    rest = [c for c in old.columns if c != key]
    new = new.groupBy(key).agg(F.max(F.struct(*[F.col(f"`{c}`") for c in rest])).alias("__row")).select(key, *[F.col("__row").getField(c).alias(c) for c in rest])
    return old.join(new, key, "left_anti").select(old.columns).unionByName(new.select(old.columns))


def fresh_points(old: DataFrame, new: DataFrame, key: str = "point_id") -> DataFrame:
    return new.join(old.select(key), key, "left_anti").select(new.columns)


def existing_ids(points: DataFrame, ids: DataFrame, key: str = "point_id") -> DataFrame:
    return ids.select(key).distinct().join(points, key, "left_semi")


def validate_points(points: DataFrame, dim: int, column: str = "vector") -> None:
    no_id = F.col("point_id").isNull() if "point_id" in points.columns else F.lit(False)
    wrong = points.where(no_id | F.coalesce(F.size(column) != dim, F.lit(True))).select(F.size(column), no_id).first()
    if wrong is not None and wrong[1]:
        raise CollectionMismatch("a point has no point_id")
    if wrong is not None:
        raise CollectionMismatch(f"a vector has {wrong[0]} dimensions, not {dim}")


def embedder_models(points: DataFrame) -> DataFrame:
    return points.where("embedded_model is not null and embedded_model <> ''").select("embedded_model").distinct()


def assert_embedder(points: DataFrame, expected: str) -> None:
    found = sorted(r[0] for r in embedder_models(points).limit(16).collect())
    if found != [expected]:
        raise CollectionMismatch(f"vectors come from {found or 'no model'}, not {expected}")
