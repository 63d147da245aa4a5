"""Exact order statistics of groups of any size, without sorting a group. Inventory 78, 89.

The interval that holds a wanted rank is cut into ``SLICES`` parts, whose rows are counted; the part that holds the rank is
the next interval, with the least and greatest value that occur in it as its ends. That goes on until both are one
value. Each round is one filtered scan and one aggregate whose result has at most ``SLICES`` rows for an interval,
whatever share of all rows a group has, and values have only so many digits, so there are few rounds.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvine.runtime import broadcast_if_small, drop_materialized, materialize, row_count

SLICES = 4096


def _slice(value: Column, low: Column, high: Column) -> Column:
    """Number of the part of [low, high] in which a value lies; growing with the value, and 0 for low alone where halves vanish."""
    width = high / 4 - low / 4  # quarters, for the width of all doubles is none
    part = F.floor((value / 4 - low / 4) / F.nullif(width, F.lit(0.0)) * SLICES).cast("int")
    return F.when(value == low, 0).when(value == high, SLICES).otherwise(F.greatest(F.lit(1), F.least(F.coalesce(part, F.lit(1)), F.lit(SLICES - 1))))


def values_at(rows: DataFrame, by: Sequence[str], value: str, ranks: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """One row for each group: its columns, ``n``, ``least``, ``most``, and for each entry of ``ranks`` the value at that
    place in ascending order; an entry makes the place, from 0, out of the number of rows.

    Null and NaN values do not count, and a group without others has no row. Null is a group like others. A place
    outside the rows gives null.
    """
    by = list(by)
    kept = rows.select(*by, F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v") & (F.abs("_v") != float("inf")))
    whole = materialize(kept.groupBy(*by).agg(F.count("*").alias("n"), F.min("_v").alias("least"), F.max("_v").alias("most")), "whole", 64)
    wanted = whole.select(*by, F.explode(F.array(*[F.struct(F.lit(name).alias("name"), place(F.col("n")).cast("long").alias("place")) for name, place in ranks.items()])).alias("w"), "n", F.col("least").alias("lo"), F.col("most").alias("hi"))
    wanted = wanted.select(*by, "w.*", "lo", "hi", F.lit(0).cast("long").alias("before")).where("place >= 0 and place < n").drop("n")
    state = materialize(wanted, "ranks", 96)
    while True:
        open_ = state.where("lo < hi")
        if open_.isEmpty():
            break
        ends = materialize(open_.select(*[F.col(c).alias("_" + c) for c in by], "lo", "hi", "before").distinct(), "ends", 64)
        same = [F.col(c).eqNullSafe(F.col("_" + c)) for c in by]
        inside = kept.join(broadcast_if_small(ends, row_count(ends), 64), [*same, F.col("_v") >= F.col("lo"), F.col("_v") <= F.col("hi")])
        parts = inside.groupBy(*by, "lo", "hi", "before", _slice(F.col("_v"), F.col("lo"), F.col("hi")).alias("slice"))
        parts = parts.agg(F.count("*").alias("c"), F.min("_v").alias("lo2"), F.max("_v").alias("hi2"))
        up = F.sum("c").over(Window.partitionBy(*by, "lo", "hi", "before").orderBy("slice"))
        parts = parts.withColumn("start", F.col("before") + up - F.col("c"))
        parts = parts.select(*[F.col(c).alias("_" + c) for c in by], F.col("lo").alias("_lo"), F.col("hi").alias("_hi"), "start", "c", "lo2", "hi2")
        same += [F.col("lo") == F.col("_lo"), F.col("hi") == F.col("_hi"), F.col("place") >= F.col("start"), F.col("place") < F.col("start") + F.col("c")]
        found = open_.join(parts, same).select(*by, "name", "place", F.col("lo2").alias("lo"), F.col("hi2").alias("hi"), F.col("start").alias("before"))
        before, state = state, materialize(state.where("lo = hi").unionByName(found), "ranks", 96)
        drop_materialized(before)
    found = state.groupBy(*[F.col(c).alias("_" + c) for c in by]).agg(*[F.max(F.when(F.col("name") == name, F.col("lo"))).alias(name) for name in ranks])
    same = [F.col(c).eqNullSafe(F.col("_" + c)) for c in by]
    out = whole.join(found, same, "left") if by else whole.crossJoin(F.broadcast(found))
    return out.select(*by, "n", "least", "most", *ranks)
