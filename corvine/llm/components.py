"""Connected components of an edge table, by alternating large-star and small-star passes.

A node's smallest neighbour is a sum-like aggregate, which combines before the shuffle, and goes back to the
node's edges by a join that may split a hub; no pass gathers a node's edges. Nothing but two sums per pass comes
to the driver. Each pass is written to the shared folder, so lost executors cost at most the pass that runs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvine.runtime import drop_materialized, materialize, row_count


def _with_least(edges: DataFrame) -> DataFrame:
    """Edges (u, v) with m, the smallest v of their u."""
    return edges.join(edges.groupBy("u").agg(F.min("v").alias("m")), "u")


def _stars(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    large = _with_least(both).withColumn("m", F.least("u", "m")).where((F.col("v") > F.col("u")) & (F.col("v") != F.col("m")))
    large = large.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    # now u > v: each node points at something smaller
    out = _with_least(large).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
    return out.where(F.col("u") != F.col("v")).distinct()


def connected_components(edges: DataFrame, max_passes: int = 64) -> DataFrame:
    """(id, component): the smallest id reachable, for every id that has an edge. ``edges`` has u and v."""
    now = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges", 16)
    if not row_count(now):
        return now.select(F.col("u").alias("id"), F.col("v").alias("component"))
    seen = None
    for _ in range(max_passes):
        mark = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if mark == seen or not mark["n"]:
            break
        seen = mark
        after = materialize(_stars(now), "edges", 16)
        drop_materialized(now)
        now = after
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)
