"""One row for each key, without dealing whole rows by key: only keys are shuffled, and the rows of keys that recur. Inventory 160."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvine.runtime import broadcast_if_small, materialize, row_count


def one_per_key(rows: DataFrame, key: str, known: DataFrame | None = None) -> DataFrame:
    """Rows whose key ``known`` (its first column) does not have; of rows that share a key the greatest, by their other columns in order.

    A null key is a key. ``rows`` is read twice, so it must give the same rows both times.
    """
    keyed = rows.groupBy(key).agg(F.count("*").alias("_n")).withColumnRenamed(key, "_odd")
    there = F.lit(False)
    if known is not None:
        seen = known.select(F.col(f"`{known.columns[0]}`").alias("_known")).distinct().withColumn("_seen", F.lit(True))
        keyed, there = keyed.join(seen, F.col("_odd").eqNullSafe(F.col("_known")), "left"), F.coalesce("_seen", F.lit(False))
    odd = materialize(keyed.select("_odd", "_n", there.alias("_there")).where("_n > 1 or _there").drop("_n"), "odd", 24)
    if not row_count(odd):
        return rows
    marked = rows.join(broadcast_if_small(odd, row_count(odd), 24), F.col(f"`{key}`").eqNullSafe(F.col("_odd")), "left")
    rest = [c for c in rows.columns if c != key]
    best = marked.where("not _there").groupBy(key).agg(F.max(F.struct(*[F.col(f"`{c}`") for c in rest])).alias("_best"))
    names = [F.col(f"`{c}`") for c in rows.columns]
    return marked.where("_there is null").select(*names).unionByName(best.select(F.col(f"`{key}`"), *[F.col(f"_best.`{c}`").alias(c) for c in rest]))
