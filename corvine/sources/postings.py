"""Stored posting lists for BM25, added to batch by batch, with their statistics. Inventory 43, 49, 54, 62, 64, 99, 103, 160.

An index is a folder of Parquet written and read by Spark alone. A batch of documents adds, under ``batch=N`` each:

* ``postings``: a row for each term and range of documents: how many documents hold it (``n``), the largest tf, the least
  length, and the entries (key, tf, length). A range is at most ``RANGE_DOCS`` documents that came side by side, so no
  term makes an unbounded row. Files are in order of hash bucket and term, so a search for some terms opens the folders
  of their buckets and reads the row groups that hold them.
* ``lengths``: key and length of every document.
* ``corpus``: document count and total length. This is written last, and a batch without it is not there for readers.

A batch that is written again replaces itself, and only adds keys that no batch before it has; so a repeated batch adds
nothing, and statistics are sums over batches that equal a fit over all texts, whatever the order. A search reads no text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corvine.operators import bm25
from corvine.operators.keys import one_per_key
from corvine.runtime import broadcast_if_small, drop_materialized, materialize, row_count, slices

RANGE_DOCS = 512
BUCKETS = 32
#: Ranges of each query that are scored first, to learn what its k-th score is at least.
FIRST_RANGES = 4
#: Bounds are raised by this much against rounding.
SLACK = 1e-9
#: Ranges that a scan may be asked for by name.
INLINE_RANGES = 2000
#: Entries of a file of postings, as a rule.
PART_ENTRIES = 4_000_000
#: Estimated bytes of query and range pairs that a search may broadcast; beyond them they are joined by a shuffle.
PAIR_BYTES = 64 << 20


class PostingError(ValueError):
    """An index cannot take or answer what it was asked."""


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


#: A range's documents with one bucket's terms of it: how many documents hold each term, and their places among the keys and tfs, term by term.
_PACKED = (
    "`range` int, bucket int, leads boolean, entries int, keys array<{kind}>, lengths array<int>, terms string, ns array<int>, places array<smallint>, tfs array<int>"
)


def _pack(range_docs: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Documents (key, length, terms, buckets) in ranges of neighbours; a range's rows are those of ``_PACKED``, one at least, of which one leads."""
    names = ["range", "bucket", "leads", "entries", "keys", "lengths", "terms", "ns", "places", "tfs"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            for part in bm25.blocks(batch, min(range_docs, 1 << 15)):
                if task >= 1 << 15 or number >= 1 << 16:
                    raise PostingError("a batch of so many tasks, or so many ranges of a task, cannot be numbered")
                yield packed(part, task << 16 | number)
                number += 1

    def packed(part: pa.RecordBatch, number: int) -> pa.RecordBatch:
        keys, lengths, lists, buckets = part.columns
        n, coded = part.num_rows, lists.flatten().dictionary_encode()
        code, terms = coded.indices.to_numpy(), coded.dictionary
        bucket = np.zeros(len(terms), np.int32)
        bucket[code] = buckets.flatten().to_numpy()
        order = pc.sort_indices(pa.table({"b": bucket, "t": terms}), [("b", "ascending"), ("t", "ascending")]).to_numpy()
        terms, bucket = terms.take(pa.array(order)), bucket[order]
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        cells, tfs = np.unique(rank[code] * n + np.repeat(np.arange(n), pc.list_value_length(lists).to_numpy()), return_counts=True)
        term, place = np.divmod(cells, n)
        ns = np.bincount(term, minlength=len(order))
        # of the terms, and of the entries, those where a bucket begins; without terms one row has the documents alone
        at = np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), len(order)) if len(order) else np.zeros(2, np.int64)
        first, rows = np.searchsorted(term, at), len(at) - 1
        each = lambda values, offsets: pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)
        again = lambda values: each(pa.concat_arrays([values] * rows), np.arange(rows + 1) * n)
        return pa.RecordBatch.from_arrays([
            pa.array(np.full(rows, number, np.int32)), pa.array(bucket[at[:-1]] if len(order) else np.zeros(1, np.int32)), pa.array(np.arange(rows) == 0), pa.array(np.diff(first).astype(np.int32)),
            again(keys), again(lengths), pc.binary_join(each(terms, at), " "), each(pa.array(ns.astype(np.int32)), at),
            each(pa.array(place.astype(np.int16)), first), each(pa.array(tfs.astype(np.int32)), first)], names)

    return run


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """bucket, term, range, keys, and tf and length in one number, of every term of rows packed by :func:`_pack`."""
    for batch in slices(batches, 64):
        of = {x: batch.column(x) for x in batch.schema.names}
        terms, ns = pc.split_pattern(of["terms"], " "), of["ns"].flatten().to_numpy()
        held = pc.list_value_length(of["keys"]).to_numpy()
        place = of["places"].flatten().to_numpy() + np.repeat(np.cumsum(held) - held, pc.list_value_length(of["places"]).to_numpy())
        both = of["tfs"].flatten().to_numpy().astype(np.int64) << 32 | of["lengths"].flatten().to_numpy()[place]
        offsets = pa.array(np.append(0, np.cumsum(ns)), pa.int32())
        each = lambda name: np.repeat(of[name].to_numpy(), pc.list_value_length(terms).to_numpy())  # noqa: E731, B023
        yield pa.RecordBatch.from_arrays([
            pa.array(each("bucket")), terms.flatten(), pa.array(each("range")),
            pa.ListArray.from_arrays(offsets, of["keys"].flatten().take(pa.array(place))), pa.ListArray.from_arrays(offsets, pa.array(both))], ["bucket", "term", "range", "keys", "both"])


class PostingIndex:
    def __init__(self, spark: SparkSession, path: str, key: str = "doc_id", key_type: str = "bigint"):
        self.spark, self.path, self.key, self.key_type = spark, path.rstrip("/"), key, key_type
        self._fixed: list[int] | None = None
        entry = f"struct<`{key}`: {key_type}, tf: bigint, length: int>"
        self._schemas = {
            "postings": StructType.fromDDL(f"term string, `range` int, n int, most_tf bigint, least_length int, entries array<{entry}>, batch bigint, bucket int"),
            "lengths": StructType.fromDDL(f"`{key}` {key_type}, length int, batch bigint"),
            "corpus": StructType.fromDDL("document_count bigint, total_length bigint, batch bigint"),
        }

    # writing

    def add(self, documents: DataFrame, batch: int, text: str = "text") -> None:
        """Index those of ``documents`` (key, text) whose key no batch before this one has; of rows that share a key the greatest text.

        A null text has no terms, a null key is a key; batches are whole numbers from 0 and must come in order.
        """
        if batch < 0:
            raise PostingError("batches are numbered from 0")
        key = self.key
        docs = documents.select(F.col(key).cast(self.key_type).alias(key), F.col(text).alias("text"))
        docs = one_per_key(docs, key, self._whole("lengths").where(F.col("batch") < batch).select(key))
        tokenised = bm25.with_terms(docs, key).select(key, "length", "terms", F.transform("terms", lambda t: _bucket(t).cast("byte")).alias("buckets"))
        # written, so that each document has one range in all that is read of them
        packed = materialize(tokenised.mapInArrow(_pack(RANGE_DOCS), _PACKED.format(kind=self.key_type)), "ranges")
        lengths = packed.where("leads").select(F.inline(F.arrays_zip("keys", "lengths"))).toDF(key, "length")
        total = lengths.agg(F.count("*").alias("document_count"), F.coalesce(F.sum("length"), F.lit(0)).alias("total_length")).first()
        parts = max(1, -(-(packed.agg(F.sum("entries")).first()[0] or 0) // (BUCKETS * PART_ENTRIES)))
        # postings are moved once, as rows that hold a bucket's terms of a range
        moved = packed.where("entries > 0").drop("leads", "entries").repartitionById(BUCKETS * parts, F.col("bucket") * parts + F.pmod(F.xxhash64("range"), F.lit(parts)).cast("int"))
        blocks = moved.mapInArrow(_unpack, f"bucket int, term string, `range` int, keys array<{self.key_type}>, both array<bigint>").sortWithinPartitions("bucket", "term", "range")
        entry = self._schemas["postings"]["entries"].dataType
        tf, length = F.transform("both", lambda x: F.shiftright(x, 32)), F.transform("both", lambda x: x.bitwiseAND(F.lit(0xFFFFFFFF)).cast("int"))
        blocks = blocks.select(
            "term", "range", F.size("keys").alias("n"), F.array_max(tf).alias("most_tf"), F.array_min(length).alias("least_length"),
            F.arrays_zip("keys", tf, length).cast(entry).alias("entries"), "bucket")
        at = lambda name: f"{self.path}/{name}/batch={batch}"
        blocks.write.mode("overwrite").option("compression", "zstd").partitionBy("bucket").parquet(at("postings"))
        lengths.write.mode("overwrite").parquet(at("lengths"))
        corpus = self.spark.range(1).select(F.lit(total["document_count"]).cast("long").alias("document_count"), F.lit(total["total_length"]).cast("long").alias("total_length"))
        corpus.write.mode("overwrite").parquet(at("corpus"))
        drop_materialized(packed)

    # reading

    def _read(self, name: str) -> DataFrame:
        """A part of the index; one that was never written has no rows."""
        path = f"{self.path}/{name}"
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if not p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
            return self.spark.createDataFrame([], self._schemas[name])
        return self.spark.read.schema(self._schemas[name]).option("basePath", path).parquet(path)

    def batches(self) -> list[int]:
        """Numbers of the batches that are whole. One row is read for each."""
        return self._fixed if self._fixed is not None else sorted(r["batch"] for r in self._read("corpus").select("batch").distinct().collect())

    def snapshot(self) -> PostingIndex:
        """The index as it stands: batches that come later are not in it."""
        out = PostingIndex(self.spark, self.path, self.key, self.key_type)
        out._fixed = self.batches()
        return out

    def _whole(self, name: str) -> DataFrame:
        return self._read(name).where(F.col("batch").isin(self.batches()))

    def lengths(self) -> DataFrame:
        return self._whole("lengths").select(self.key, "length")

    def postings(self) -> DataFrame:
        """term, key, tf, length of every posting."""
        return self._whole("postings").select("term", F.inline("entries"))

    def entry_count(self) -> int:
        """The postings that there are, without reading any."""
        return self._whole("postings").agg(F.sum("n")).first()[0] or 0

    def corpus_stats(self) -> DataFrame:
        """document_count and average_length, from one row of each batch."""
        return self._whole("corpus").agg(
            F.coalesce(F.sum("document_count"), F.lit(0)).alias("document_count"), (F.sum("total_length") / F.nullif(F.sum("document_count"), F.lit(0))).alias("average_length"))

    def document_frequencies(self) -> DataFrame:
        """term and df, without reading any entry."""
        return self._whole("postings").groupBy("term").agg(F.sum("n").cast("long").alias("df"))

    def _of_terms(self, asked: DataFrame) -> DataFrame:
        """Posting rows of the asked terms: named in the scan where they are few, else by a join."""
        terms = [r["term"] for r in asked.select("term").distinct().limit(bm25.INLINE_TERMS + 1).collect()]
        rows = self._whole("postings")
        if len(terms) > bm25.INLINE_TERMS:
            return rows.join(asked.select("term").distinct().withColumn("bucket", _bucket(F.col("term"))), ["bucket", "term"], "left_semi")
        buckets = [r[0] for r in asked.select(_bucket(F.col("term"))).distinct().collect()]
        return rows.where(F.col("bucket").isin(buckets) & F.col("term").isin(terms))

    def search(self, queries: DataFrame, query_key: str, k: int = 40, model: bm25.Bm25 | None = None, restrict: DataFrame | None = None) -> DataFrame:
        """query key, key, score, rank of each query's k best documents: what :func:`corvine.operators.bm25.sparse_search` gives.

        From the heads of the posting rows comes a bound on what any document of a range can score for a query. The ranges
        with the highest bounds are scored first; of the others only those whose bound reaches the k-th score so far are.
        ``restrict`` (a column of keys) applies before anything is ranked.
        """
        if self._fixed is None:
            return self.snapshot().search(queries, query_key, k, model, restrict)
        found = self.bounds(queries, query_key, model)
        first = found.pairs.where(F.col("place") <= FIRST_RANGES)
        some = materialize(bm25.top_k(self._scores(first, found, query_key, model, restrict), query_key, self.key, k), "first", 40)
        least = some.where(F.col("rank") == k).select(query_key, F.col("score").alias("least"))
        least = materialize(least, "least", 24)
        rest = found.pairs.where(F.col("place") > FIRST_RANGES).join(broadcast_if_small(least, row_count(least), 24), query_key, "left")
        rest = rest.where(F.col("least").isNull() | (F.col("bound") >= F.col("least"))).drop("least")
        more = self._scores(rest, found, query_key, model, restrict)
        return bm25.top_k(some.select(query_key, self.key, "score").unionByName(more), query_key, self.key, k)

    def bounds(self, queries: DataFrame, query_key: str, model: bm25.Bm25 | None = None) -> _Bounds:
        """For each query and range with any of its terms: the bound, and its place among the query's bounds."""
        asked = materialize(bm25.query_terms(queries, query_key), "asked", 64)
        heads = materialize(self._of_terms(asked).select("batch", "range", "term", "n", "most_tf", "least_length"), "heads", 48)
        df = heads.groupBy("term").agg(F.sum("n").cast("long").alias("df"))
        terms = materialize(asked.join(df, "term").crossJoin(F.broadcast(self.corpus_stats())), "weighed", 96)
        each = heads.select("batch", "range", "term", F.col("most_tf").alias("tf"), F.col("least_length").alias("length"))
        pairs = each.join(broadcast_if_small(terms, row_count(terms), 120), "term")
        pairs = pairs.groupBy(query_key, "batch", "range").agg((F.sum(bm25.weight(model or bm25.Bm25())) + SLACK).alias("bound"))
        place = F.row_number().over(Window.partitionBy(query_key).orderBy(F.col("bound").desc(), "batch", "range"))
        return _Bounds(materialize(pairs.withColumn("place", place), "bounds", 48), terms)

    def _scores(self, pairs: DataFrame, found: _Bounds, query_key: str, model: bm25.Bm25 | None, restrict: DataFrame | None) -> DataFrame:
        """Scores of all documents in the given ranges for the given queries."""
        pairs = materialize(pairs.select(query_key, "batch", "range"), "pairs", 24)
        rows = self._of_terms(found.terms)
        named = pairs.select("batch", "range").distinct().limit(INLINE_RANGES + 1).collect()
        if len(named) <= INLINE_RANGES:
            rows = rows.where(F.col("batch").isin(sorted({r["batch"] for r in named})) & F.col("range").isin(sorted({r["range"] for r in named})))
        rows = rows.select("batch", "range", "term", "entries")
        few = broadcast_if_small(pairs, row_count(pairs), 24, PAIR_BYTES)
        if few is not pairs:
            # dealt by range once: sums over a document's terms need no other exchange
            rows = rows.select("batch", "range", "term", *[F.col("entries")[c].alias(f"_{i}") for i, c in enumerate((self.key, "tf", "length"))]).withColumn("_1", F.col("_1").cast("array<int>"))
            entries = F.arrays_zip("_0", "_1", "_2").cast(self._schemas["postings"]["entries"].dataType).alias("entries")
            wanted = rows.repartition("batch", "range").select("batch", "range", "term", entries).join(broadcast_if_small(found.terms, row_count(found.terms), 120), "term")
            rows = wanted.join(few, [query_key, "batch", "range"], "left_semi")
        else:
            rows = rows.join(pairs.join(broadcast_if_small(found.terms, row_count(found.terms), 120), query_key), ["batch", "range", "term"])
        entry = rows.select(query_key, "batch", "range", "df", "document_count", "average_length", F.inline("entries"))
        if restrict is not None:
            entry = entry.join(restrict.select(self.key), self.key, "left_semi")
        return bm25.summed(entry.select(query_key, "batch", "range", self.key, bm25.weight(model or bm25.Bm25()).alias("weight")), query_key, self.key, ["batch", "range"])


class _Bounds:
    def __init__(self, pairs: DataFrame, terms: DataFrame):
        self.pairs, self.terms = pairs, terms
