"""Reciprocal rank fusion, thresholds and branch bookkeeping. Inventory 42, 51, 65, 77, 80-82, 92, 105."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60


def rank_keys(scored: DataFrame, query_key: str, key: str) -> DataFrame:
    """1-based positions by score, ties by key."""
    w = Window.partitionBy(query_key).orderBy(F.col("score").desc(), key)
    return scored.withColumn("rank", F.row_number().over(w))


def fuse(rankings: Mapping[str, DataFrame], query_key: str, key: str, k: int = RRF_K, weights: Mapping[str, float] | None = None) -> DataFrame:
    """query key, key, score, ranks and contributions by branch, fused_rank.

    ``rankings``: branch -> (query key, key, rank). A branch without a weight has 1; one of weight 0 keeps its
    keys and shows their ranks. A key that a branch repeats counts at its best rank.
    """
    if k <= 0:
        raise ValueError("k must be positive")
    rows = None
    for branch, frame in rankings.items():
        part = frame.groupBy(query_key, key).agg(F.min("rank").alias("rank")).select(
            query_key, key, F.lit(branch).alias("branch"), F.col("rank").cast("int").alias("rank"),
            (F.lit(float((weights or {}).get(branch, 1.0))) / (k + F.col("rank"))).alias("part"))
        rows = part if rows is None else rows.unionByName(part)
    each = F.array_sort(F.collect_list(F.struct("branch", "rank", "part")))
    out = rows.groupBy(query_key, key).agg(each.alias("each"))
    out = out.select(
        query_key, key, F.aggregate("each", F.lit(0.0), lambda s, x: s + x["part"]).alias("score"),
        F.map_from_arrays(F.col("each.branch"), F.col("each.rank")).alias("ranks"),
        F.map_from_arrays(F.col("each.branch"), F.col("each.part")).alias("contributions"))
    w = Window.partitionBy(query_key).orderBy(F.col("score").desc(), key)
    return out.withColumn("fused_rank", F.row_number().over(w))


def threshold_and_limit(fused: DataFrame, query_key: str, limit: int, threshold: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """The hits with their final rank, and (query key, dropped) for every fused query.

    Reading stops at the first hit beyond the limit, so weaker ones are counted as dropped only if the limit
    is not exceeded by hits above the threshold.
    """
    if limit < 0:
        raise ValueError("limit must not be negative")
    kept = fused.where(F.col("score") >= threshold) if threshold > 0 else fused
    hits = kept.withColumn("rank", F.col("fused_rank")).where(F.col("rank") <= limit)
    low = F.col("score") < threshold if threshold > 0 else F.lit(False)
    counts = fused.groupBy(query_key).agg(F.count_if(low).alias("low"), F.count_if(~low).alias("high"))
    return hits, counts.select(query_key, F.when(F.col("high") > limit, 0).otherwise(F.col("low")).cast("int").alias("dropped"))


def branch_label(ranks: Column) -> Column:
    """both, dense_only or sparse_only, from which branches ranked the key."""
    d, s = F.map_contains_key(ranks, F.lit("dense")), F.map_contains_key(ranks, F.lit("sparse"))
    return F.when(d & s, "both").when(d, "dense_only").when(s, "sparse_only")
