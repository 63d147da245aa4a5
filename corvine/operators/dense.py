"""Exact cosine search of query batches. Inventory 50, 102.

Queries that fit one block of ``BLOCK_BYTES`` go to the executors as they are; each Arrow batch of vectors is one matrix
product, and a partition keeps no more than k candidates of a query, so what is shuffled is k rows for each query and
partition. More queries stay a table: they are dealt to tiles and the vectors to parts, both of at most about a block, and
every tile meets every part in a task of its own, from one scan of each. Scores are rounded to nine decimals before they are ranked, so equal
vectors tie whatever the order of summation.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvine.operators.bm25 import top_k

BLOCK_BYTES = 32 << 20
DIGITS = 9


class DimensionError(ValueError):
    """Vectors and queries differ in width."""


def _matrix(col: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays(col.chunks)
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(col), -1) if len(col) else flat.reshape(0, 0)


def _unit(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def _scan(ids: pa.Array, q: np.ndarray, k: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[list] = [[] for _ in range(len(q))]
        best = [np.zeros(0) for _ in range(len(q))]
        for batch in batches:
            batch = batch.filter(batch.column(1).is_valid())
            m = _matrix(batch.column(1))
            if len(m) and m.shape[1] != q.shape[1]:
                raise DimensionError(f"vectors have {m.shape[1]} dimensions, queries {q.shape[1]}")
            scores = np.round(q @ _unit(m).T, DIGITS) + 0.0
            own = batch.column(0).to_pylist()
            for i, row in enumerate(scores):
                some = np.flatnonzero(row >= np.partition(row, -k)[-k]) if len(row) > k else np.arange(len(row))
                both = keys[i] + [own[j] for j in some]
                vals = np.concatenate((best[i], row[some]))
                order = sorted(range(len(both)), key=lambda j: (-vals[j], both[j]))[:k]
                keys[i], best[i] = [both[j] for j in order], vals[order]
        at = np.repeat(np.arange(len(q)), [len(x) for x in keys])
        yield pa.RecordBatch.from_arrays(
            [ids.take(pa.array(at)), pa.array([x for row in keys for x in row], key_type[0]), pa.array(np.concatenate(best) if best else np.zeros(0))], names)

    key_type: list = [None]
    return run, key_type


def dense_search(vectors: DataFrame, key: str, queries: DataFrame, query_key: str, k: int = 40, column: str = "vector") -> DataFrame:
    """query key, key, score, rank of each query's k nearest vectors by cosine; zero vectors score 0; ties by key."""
    from pyspark.sql.pandas.types import to_arrow_type

    q_kind, kind = queries.schema[query_key].dataType, vectors.schema[key].dataType
    schema = f"`{query_key}` {q_kind.simpleString()}, `{key}` {kind.simpleString()}, score double"
    # a test for null in the plan would make each vector twice; the scan passes over null ones
    source = vectors.select(key, column)
    asked = queries.where(F.col(column).isNotNull()).select(query_key, column)
    size = asked.agg(F.count("*").alias("n"), F.max(F.size(column)).alias("width")).first()
    if not size["n"]:
        return top_k(source.sparkSession.createDataFrame([], schema), query_key, key, k)
    names, kinds = [query_key, key, "score"], (to_arrow_type(q_kind), to_arrow_type(kind))
    row_bytes = 8 * max(1, size["width"])
    tiles = -(-size["n"] * row_bytes // BLOCK_BYTES)
    if tiles == 1:
        held = asked.toArrow()
        run, key_type = _scan(held[query_key].combine_chunks(), _unit(_matrix(held[column])), k, names)
        key_type[0] = kinds[1]
        return top_k(source.mapInArrow(run, schema), query_key, key, k)
    parts = max(1, -(-source.count() * row_bytes // BLOCK_BYTES))
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = source.withColumn("_p", deal(key, parts)).withColumn("_t", every(tiles)).groupBy("_p", "_t")
    right = asked.withColumn("_t", deal(query_key, tiles)).withColumn("_p", every(parts)).groupBy("_p", "_t")
    return top_k(left.cogroup(right).applyInArrow(_tile(k, names, kinds), schema), query_key, key, k)


def _tile(k: int, names: list[str], kinds: tuple[pa.DataType, pa.DataType]):
    def run(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        ids = queries.column(0).combine_chunks().cast(kinds[0])
        if not vectors.num_rows or not queries.num_rows:
            return pa.Table.from_arrays([ids.slice(0, 0), pa.array([], kinds[1]), pa.array([], pa.float64())], names)
        scan, key_type = _scan(ids, _unit(_matrix(queries.column(1))), k, names)
        key_type[0] = kinds[1]
        return pa.Table.from_batches(list(scan(iter(vectors.combine_chunks().to_batches()))))

    return run
