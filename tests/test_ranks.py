import math
import random

import pytest
from pyspark.sql import functions as F

from corvine.operators.ranks import values_at

PLACES = {"first": lambda n: F.lit(0), "middle": lambda n: F.floor(n / 2), "last": lambda n: n - 1, "beyond": lambda n: n}


def sample():
    rng = random.Random(4)
    rows = [("hot", rng.choice([0.0, 1.0, 1.0, 1e-300, 5e-324, -1e308, 1e308, 3.25])) for _ in range(500)]
    rows += [("fine", 1.0 + rng.randrange(40) * 2**-52) for _ in range(300)] + [(None, float(rng.randrange(10**9))) for _ in range(300)]
    return [*rows, ("one", -0.5), ("same", 7.0), ("same", 7.0), ("none", None), ("none", math.nan), ("mixed", math.nan), ("mixed", 2.0)]


@pytest.mark.parametrize("by", [["k"], []])
def test_equals_sorting(spark, by):
    rows = sample()
    got = {r["k"] if by else "": r for r in values_at(spark.createDataFrame(rows, "k string, v double"), by, "v", PLACES).collect()}
    groups: dict = {}
    for k, v in rows:
        if v is not None and not math.isnan(v):
            groups.setdefault(k if by else "", []).append(v)
    assert set(got) == set(groups)
    for k, vs in groups.items():
        vs.sort()
        r = got[k]
        assert (r.n, r.least, r.most, r["first"], r.middle, r["last"], r.beyond) == (len(vs), vs[0], vs[-1], vs[0], vs[len(vs) // 2], vs[-1], None), k


def test_empty(spark):
    assert values_at(spark.createDataFrame([], "k string, v double"), ["k"], "v", PLACES).count() == 0
