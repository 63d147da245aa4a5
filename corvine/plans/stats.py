"""Paired statistics over outcome vectors. Inventory 89, 149-153.

Deltas, discordant counts and the exact test are aggregates and expressions. Bootstrap and power simulation
need the standard library's random stream for reproducible figures, so they run as grouped maps, one group per
comparison or effect step.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values of the published figures.
RESAMPLES, SEED = 10_000, 20260811
#: So many draws are made at once, or one resample if that is more.
BLOCK = 1 << 20


def binomial_tail_p(k: Column, n: Column) -> Column:
    """min(1, 2 P(X <= k)) for X binomial(n, 1/2); 1 for n = 0. Terms follow from one another, scaled by 2^-n."""
    first = F.pow(F.lit(0.5), n)
    start = F.struct(first.alias("term"), first.alias("sum"))

    def step(acc: Column, i: Column) -> Column:
        term = acc["term"] * (n - i + 1) / i
        return F.struct(term.alias("term"), (acc["sum"] + term).alias("sum"))

    tail = F.aggregate(F.when(k >= 1, F.sequence(F.lit(1), k)).otherwise(F.array().cast("array<int>")), start, step, lambda acc: acc["sum"])
    return F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2.0 * tail))


def paired(outcomes: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Per scope: n, delta, a_only, b_only, p_exact of columns a and b (booleans)."""
    rows = outcomes.groupBy(*scope).agg(
        F.count("*").alias("n"), F.avg(F.col("a").cast("int") - F.col("b").cast("int")).alias("delta"),
        F.count_if(F.col("a") & ~F.col("b")).cast("int").alias("a_only"), F.count_if(F.col("b") & ~F.col("a")).cast("int").alias("b_only"))
    return rows.withColumn("p_exact", binomial_tail_p(F.least("a_only", "b_only"), F.col("a_only") + F.col("b_only")))


def reportable(n: Column, low: Column, high: Column) -> tuple[Column, Column]:
    """(reportable, reason) by the fixed rule: thirty cases, and an interval without zero."""
    reason = F.when(n < 30, "n < 30").when((low <= 0) & (high >= 0), "ci95 includes zero").otherwise("")
    return reason == "", reason


def picks(n: int, resamples: int, seed: int) -> Iterator[np.ndarray]:
    """What ``random.Random(seed).randrange(n)`` draws, as blocks of whole resamples of n indexes each."""
    state, bits = random.Random(seed).getstate()[1], np.uint64(32 - n.bit_length())
    words = np.random.MT19937()
    words.state = {"bit_generator": "MT19937", "state": {"key": np.array(state[:-1], np.uint32), "pos": state[-1]}}
    most, rest = max(1, BLOCK // n), np.empty(0, np.uint32)
    for at in range(0, resamples, most):
        due = min(most, resamples - at) * n
        while len(rest) < due:
            drawn = (words.random_raw(max(BLOCK, due - len(rest))) >> bits).astype(np.uint32)
            rest = np.concatenate((rest, drawn[drawn < n]))
        yield rest[:due].reshape(-1, n)
        rest = rest[due:]


def bootstrap_interval(differences: Sequence[int], resamples: int = RESAMPLES, seed: int = SEED) -> tuple[float, float]:
    """Percentile interval of the mean, resampling with the seeded stream of the standard library."""
    if not len(differences):
        raise ValueError("no outcomes")
    if resamples <= 0:
        raise ValueError("resamples must be positive")
    d, n = np.asarray(differences, np.int8), len(differences)
    sums = np.concatenate([d[p].sum(1) for p in picks(n, resamples, seed)])
    low, high = np.percentile(sums / n, [2.5, 97.5])
    return float(low), float(high)


def bootstrap(outcomes: DataFrame, scope: Sequence[str], order: str, resamples: int = RESAMPLES, seed: int = SEED) -> DataFrame:
    """ci_low and ci_high of each scope; cases are taken in ``order``. A scope's differences are one byte a case."""
    kinds = ", ".join(f"`{c}` {outcomes.schema[c].dataType.simpleString()}" for c in scope)

    def run(key, pdf):
        import pandas as pd

        own = pdf.sort_values("o")
        low, high = bootstrap_interval((own.a.astype(int) - own.b.astype(int)).to_numpy(), resamples, seed)
        return pd.DataFrame([[*key, low, high]], columns=[*scope, "ci_low", "ci_high"])

    rows = outcomes.select(*scope, F.col(order).alias("o"), "a", "b")
    return rows.groupBy(*scope).applyInPandas(run, f"{kinds}, ci_low double, ci_high double")


def _p_exact(a_only: int, b_only: int) -> float:
    n = a_only + b_only
    return 1.0 if n == 0 else min(1.0, 2 * sum(math.comb(n, k) for k in range(min(a_only, b_only) + 1)) / 2**n)


def power_at(n: int, base: float, step: int, width: float, simulations: int, seed: int) -> float:
    """Share of simulations in which shifting the rate by ``step`` widths is significant; outcomes share their uniforms."""
    effect, rng = step * width, random.Random(seed + step)
    low, high = (base, base + effect) if base <= 0.5 else (base - effect, base)
    u = np.fromiter((rng.random() for _ in range(n * simulations)), float, n * simulations).reshape(simulations, n)
    moved = ((u >= low) & (u < high)).sum(1)
    verdict = {int(k): _p_exact(int(k), 0) < 0.05 for k in np.unique(moved)}
    return sum(verdict[int(k)] for k in moved) / simulations


def minimum_detectable_effect(spark: SparkSession, n: int, base: float, power: float = 0.8, simulations: int = 2000, seed: int = SEED, width: float = 0.01) -> float:
    """Smallest step whose simulated power suffices, all steps in parallel; the largest possible shift if none does."""
    if n <= 0 or not 0 <= base <= 1 or not 0 < power < 1 or simulations <= 0 or not 0 < width <= 1:
        raise ValueError("bad simulation parameters")
    room = 1 - base if base <= 0.5 else base
    steps = math.floor(room / width + 1e-12)

    def run(frames):
        import pandas as pd

        for pdf in frames:
            yield pd.DataFrame({"step": pdf.id, "power": [power_at(n, base, int(i), width, simulations, seed) for i in pdf.id]})

    enough = spark.range(1, steps + 1, 1, min(32, max(1, steps))).mapInPandas(run, "step long, power double").where(F.col("power") >= power).agg(F.min("step")).first()[0]
    return round(room if enough is None else enough * width, 2)
