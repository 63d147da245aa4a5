"""BM25 as relations: corpus statistics, document weights and batch search. Inventory 49, 54, 62-64, 79, 99-101, 103.

A search reads and tokenises each document once and keeps of it only its length and the terms that some query
asks for (a set in the scan up to ``INLINE_TERMS``, else a join); that is written, and statistics, document
frequencies and scores come from it. Queries that fit ``INLINE_PAIRS`` go to the executors as they are: documents are
scored where they lie, in blocks of ``CELLS``, and a partition keeps no more than k of them for a query. Of more queries,
and of keys that several documents share, the matches are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvine.functions.identity import term_index
from corvine.functions.text import let, search_terms
from corvine.runtime import broadcast_if_small, materialize, row_count

INLINE_TERMS = 20_000
#: Most frequent terms whose document frequencies are broadcast; only the other terms' counts are shuffled.
HOT_TERMS = 60_000
#: Pairs of query and term, and queries, that go to the executors as they are.
INLINE_PAIRS, INLINE_QUERIES = 1 << 16, 4096
#: Scores in one block of a task: documents times queries, and matched terms.
CELLS = 1 << 21


@dataclass(frozen=True)
class Bm25:
    k1: float = 1.2
    b: float = 0.75

    def __post_init__(self) -> None:
        if not self.k1 >= 0 or not 0 <= self.b <= 1:
            raise ValueError("k1 must not be negative and b must lie between 0 and 1")


def with_terms(documents: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, terms, length of every document; documents without terms stay, with length 0."""
    terms = F.coalesce(search_terms(F.col(text)), F.array().cast("array<string>"))
    return documents.select(key, terms.alias("terms")).withColumn("length", F.size("terms"))


def corpus_stats(tokenised: DataFrame) -> DataFrame:
    """document_count and average_length: one row. Documents without terms count."""
    return tokenised.agg(F.count("*").alias("document_count"), (F.sum("length") / F.count("*")).alias("average_length"))


def vocabulary_size(tokenised: DataFrame) -> DataFrame:
    return tokenised.select(F.explode("terms").alias("term")).agg(F.countDistinct("term").alias("vocabulary_size"))


def term_counts(tokenised: DataFrame, key: str, wanted: DataFrame | None = None) -> DataFrame:
    """key, length, term, tf; only terms in ``wanted`` (one column, term) if given."""
    rows = tokenised.select(key, "length", F.explode("terms").alias("term"))
    if wanted is not None:
        rows = rows.join(wanted, "term", "left_semi")
    return rows.groupBy(key, "length", "term").agg(F.count("*").alias("tf"))


def counted(terms: Column) -> Column:
    """Each distinct term once with how often it is there, from the array alone: (term, tf) in order of terms."""
    def runs(ordered: Column) -> Column:
        starts = F.array_compact(F.transform(ordered, lambda t, i: F.when((i == 0) | (F.get(ordered, i - 1) != t), i)))
        ends = lambda at, j: F.coalesce(F.get(at, j + 1), F.size(ordered))
        return let(starts, lambda at: F.transform(at, lambda i, j: F.struct(F.get(ordered, i).alias("term"), (ends(at, j) - i).cast("long").alias("tf"))))

    return let(F.sort_array(terms), runs)


def idf() -> Column:
    """Of columns document_count and df."""
    n, df = F.col("document_count"), F.col("df")
    return F.log(1.0 + (n - df + 0.5) / (df + 0.5))


def weight(model: Bm25) -> Column:
    """Of columns document_count, average_length, df, tf and length."""
    tf = F.col("tf")
    # without any terms in the corpus, a document stands for the average
    average = F.when(F.col("average_length") > 0, F.col("average_length")).otherwise(F.col("length"))
    return idf() * tf * (model.k1 + 1) / (tf + model.k1 * (1 - model.b + model.b * F.col("length") / average))


def document_weights(tokenised: DataFrame, key: str, model: Bm25 | None = None, wanted: DataFrame | None = None) -> DataFrame:
    """key, term, weight of every (wanted) term of every document.

    Terms are counted within their document and written; only counts of terms beyond the ``HOT_TERMS`` most frequent are shuffled,
    once and whatever their number, and meet their document frequency there.
    """
    held = materialize(tokenised.select(key, "length", counted(F.col("terms")).alias("counts")), "counts")
    counts = _merged(held, key)
    if wanted is not None:
        counts = counts.join(wanted, "term", "left_semi")
    df = counts.groupBy("term").agg(F.count("*").alias("df"))
    hot = materialize(df.orderBy(F.desc("df"), "term").limit(HOT_TERMS), "hot", 64)
    rows = counts.join(F.broadcast(hot), "term")
    if row_count(hot) == HOT_TERMS:
        rare = counts.join(F.broadcast(hot.select("term")), "term", "left_anti")
        rows = rows.unionByName(rare.withColumn("df", F.count("*").over(Window.partitionBy("term"))))
    rows = rows.crossJoin(F.broadcast(corpus_stats(held)))
    return rows.select(key, "term", weight(model or Bm25()).alias("weight"))


def _merged(held: DataFrame, key: str) -> DataFrame:
    """key, length, term, tf of written counts; rows with one key and length count as one, and only they are dealt by key."""
    each = lambda d: d.select(key, "length", F.inline("counts"))
    again = held.groupBy(key, "length").agg(F.count("*").alias("_n")).where("_n > 1").select(F.col(key).alias("_key"), F.col("length").alias("_length"), F.lit(True).alias("_again"))
    again = materialize(again, "again", 32)
    if not row_count(again):
        return each(held)
    marked = held.join(broadcast_if_small(again, row_count(again), 32), F.col(key).eqNullSafe(F.col("_key")) & (F.col("length") == F.col("_length")), "left")
    once, more = each(marked.where("_again is null")), each(marked.where("_again"))
    return once.unionByName(more.groupBy(key, "length", "term").agg(F.sum("tf").alias("tf")))


def query_terms(queries: DataFrame, query_key: str, text: str = "text") -> DataFrame:
    """query key, term, index: each distinct term once with weight 1; queries without terms have no row."""
    rows = queries.select(query_key, F.explode(F.array_distinct(search_terms(F.col(text)))).alias("term"))
    return rows.withColumn("term_idx", term_index(F.col("term")))


def sparse_search(tokenised: DataFrame, key: str, queries: DataFrame, query_key: str, k: int = 40, model: Bm25 | None = None, restrict: DataFrame | None = None) -> DataFrame:
    """query key, key, score, rank of each query's k best documents by BM25; ties by key.

    Statistics are those of all of ``tokenised``. ``restrict`` (a column ``key``) is applied before scoring.
    Sums do not depend on their order, so equal documents get equal scores.
    """
    model = model or Bm25()
    asked = materialize(query_terms(queries, query_key), "asked", 64)
    terms = [r["term"] for r in asked.select("term").distinct().limit(INLINE_TERMS + 1).collect()]
    if len(terms) > INLINE_TERMS:
        weights = document_weights(tokenised, key, model, asked.select("term").distinct())
    else:
        # terms are letters, digits and -_. only, so they need no quoting; the test is a hash set in the scan itself
        quoted = ", ".join(f"'{t}'" for t in terms)
        some = F.expr(f"filter(terms, t -> t in ({quoted}))") if terms else F.array().cast("array<string>")
        matched = materialize(tokenised.select(key, "length", some.alias("terms")), "matched")
        df = matched.select(F.explode(F.array_distinct("terms")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
        facts = df.crossJoin(F.broadcast(corpus_stats(matched)))
        pairs = asked.select(query_key, "term").limit(INLINE_PAIRS + 1).toArrow()
        if terms and pairs.num_rows <= INLINE_PAIRS and len(pairs[query_key].unique()) <= INLINE_QUERIES:
            return _scored_in_place(matched, facts, asked, pairs, key, query_key, k, model, restrict)
        weights = _matched_weights(matched, facts, key, model)
    if restrict is not None:
        weights = weights.join(restrict, key, "left_semi")
    pairs = weights.join(broadcast_if_small(asked, asked.count(), 96), "term")
    return top_k(summed(pairs, query_key, key), query_key, key, k)


def _matched_weights(matched: DataFrame, facts: DataFrame, key: str, model: Bm25) -> DataFrame:
    """key, term, weight, from matched terms and each term's df beside the corpus's statistics."""
    # dealt by key once: counts within documents and sums by query and document need no other exchange
    counts = term_counts(matched.where(F.size("terms") > 0).repartition(key), key)
    return counts.join(F.broadcast(facts), "term").select(key, "term", weight(model).alias("weight"))


def _scored_in_place(
    matched: DataFrame, facts: DataFrame, asked: DataFrame, pairs: pa.Table, key: str, query_key: str, k: int, model: Bm25, restrict: DataFrame | None,
) -> DataFrame:
    """The same best k, of which each partition deals out its own; only documents that share their key (or have none) are summed by it."""
    from pyspark.sql.pandas.types import to_arrow_type

    kinds = asked.schema[query_key].dataType, matched.schema[key].dataType
    schema = f"`{query_key}` {kinds[0].simpleString()}, `{key}` {kinds[1].simpleString()}, score double"
    some = matched.where(F.size("terms") > 0)
    shared = some.groupBy(F.col(key).alias("_key")).agg(F.count("*").alias("_n")).where("_key is null or _n > 1").select("_key")
    shared = materialize(shared, "shared", 32)
    found = facts.select("term", idf().alias("idf"), "average_length").toArrow()
    scan = _block_scan(found, pairs[query_key], pairs["term"], max(k, 1), model, [query_key, key, "score"], to_arrow_type(kinds[1]))
    if restrict is not None:
        some = some.join(restrict, key, "left_semi")
    if not row_count(shared):
        return top_k(some.mapInArrow(scan, schema), query_key, key, k)
    apart = lambda how: some.join(broadcast_if_small(shared, row_count(shared), 32), F.col(key).eqNullSafe(F.col("_key")), how)
    more = _matched_weights(apart("left_semi"), facts, key, model).join(F.broadcast(asked), "term")
    return top_k(apart("left_anti").mapInArrow(scan, schema).unionByName(summed(more, query_key, key)), query_key, key, k)


def _block_scan(found: pa.Table, queries: pa.ChunkedArray, wanted: pa.ChunkedArray, k: int, model: Bm25, names: list[str], kind: pa.DataType):
    """Scores of (key, length, terms) in whole multiples of 2^-40, as :func:`weight` and :func:`summed` have them, and each query's best k."""
    terms, idfs = found["term"].combine_chunks(), found["idf"].to_numpy()
    average = found["average_length"][0].as_py() if found.num_rows else None
    coded = queries.combine_chunks().dictionary_encode(null_encoding="encode")
    ids, asking = coded.dictionary, [[] for _ in range(len(terms))]
    for t, q in zip(pc.index_in(wanted, value_set=terms).to_pylist(), coded.indices.to_pylist(), strict=True):
        if t is not None:  # else no document has it
            asking[t].append(q)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list] = [[] for _ in range(len(ids))]
        least = np.ones(len(ids), np.int64)
        for batch in batches:
            for keys, lengths, lists in (part.columns for part in blocks(batch, max(1, CELLS // len(ids)))):
                scores = _scores(lengths.to_numpy(), lists)
                for q, row in enumerate(scores):
                    some = np.flatnonzero(row >= least[q])
                    if len(some) > k:
                        some = some[row[some] >= np.partition(row[some], -k)[-k]]
                    if len(some):
                        new = zip((-row[some]).tolist(), keys.take(pa.array(some)).to_pylist(), strict=True)
                        best[q] = sorted([*best[q], *new])[:k]
                        if len(best[q]) == k:
                            least[q] = -best[q][-1][0]
        at = np.repeat(np.arange(len(ids)), [len(x) for x in best])
        score = np.array([-s for x in best for s, _ in x], np.int64) / float(1 << 40)
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(at)), pa.array([y for x in best for _, y in x], kind), pa.array(score)], names)

    def _scores(lengths: np.ndarray, lists: pa.Array) -> np.ndarray:
        n = len(lengths)
        term = pc.index_in(lists.flatten(), value_set=terms).to_numpy(zero_copy_only=False).astype(np.int64)
        cells, tf = np.unique(term * n + np.repeat(np.arange(n), pc.list_value_length(lists).to_numpy()), return_counts=True)
        term, row = np.divmod(cells, n)
        w = idfs[term] * tf * (model.k1 + 1) / (tf + model.k1 * (1 - model.b + model.b * lengths[row] / average)) * float(1 << 40)
        down = np.floor(w)
        exact = (down + (w - down >= 0.5)).astype(np.int64)
        starts = np.flatnonzero(np.diff(term, prepend=-1))
        scores = np.zeros((len(ids), n), np.int64)
        for i, j in zip(starts, [*starts[1:], len(term)], strict=True):
            for q in asking[term[i]]:
                scores[q][row[i:j]] += exact[i:j]  # a term has a document once
        return scores

    return run


def blocks(batch: pa.RecordBatch, rows: int) -> Iterator[pa.RecordBatch]:
    """A batch (its third column: terms) in blocks of at most so many rows and, but for a single long row, ``CELLS`` terms."""
    ends = np.cumsum(pc.list_value_length(batch.column(2)).to_numpy())
    at = 0
    while at < batch.num_rows:
        full = np.searchsorted(ends, (ends[at - 1] if at else 0) + CELLS, "right")
        part = batch.slice(at, max(1, min(rows, full - at)))
        yield part
        at += part.num_rows


def summed(weights: DataFrame, query_key: str, key: str, place: list[str] | None = None) -> DataFrame:
    """Scores above 0: sums of whole multiples of 2^-40, which are the same in any order. ``place``: columns that a key fixes."""
    exact = F.sum(F.round(F.col("weight") * F.lit(float(1 << 40))).cast("long")) / F.lit(float(1 << 40))
    return weights.groupBy(query_key, *(place or []), key).agg(exact.alias("score")).where("score > 0").select(query_key, key, "score")


def top_k(scores: DataFrame, query_key: str, key: str, k: int) -> DataFrame:
    w = Window.partitionBy(query_key).orderBy(F.col("score").desc(), key)
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def sparse_vectors(weights: DataFrame, key: str) -> DataFrame:
    """key, indices, values: the parallel form, sorted by index, without duplicates."""
    rows = weights.groupBy(key, term_index(F.col("term")).alias("i")).agg(F.max_by("weight", "term").alias("w"))
    packed = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("i", "w"))).alias("v"))
    return packed.select(key, F.col("v.i").alias("indices"), F.col("v.w").alias("values"))
