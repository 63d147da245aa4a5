"""Sparse search in place: what a join gives, with only the best k of a partition dealt out."""

import random

import pytest
from pyspark.sql import functions as F

from corvine.functions.identity import hash_vector
from corvine.operators import bm25, dense

WORDS = [f"w{i}" for i in range(40)] + ["the", "co-op", "v1.2"]


def texts(spark, keys, kind):
    r = random.Random(5)
    rows = [(k, " ".join(r.choices(WORDS, [1 / (i + 1) for i in range(len(WORDS))], k=r.choice((0, 1, 3, 30, 200))))) for k in keys]
    rows += [(f"{k}" if kind == "string" else int(k), "w1 w3 w3 w20") for k in range(7000, 7030)]  # ties
    return spark.createDataFrame(rows, f"key {kind}, text string").repartition(5)


def asked(spark):
    r = random.Random(6)
    rows = [(i, " ".join(r.choices([*WORDS, "unknown"], k=r.choice((0, 1, 4, 25))))) for i in range(30)]
    return spark.createDataFrame([*rows, (3, "w1 w2 w39"), (None, "w20")], "query_id long, text string")  # an id repeats, one is null


def found(hits):
    return sorted(map(tuple, hits.select("query_id", "key", "score", "rank").collect()), key=str)


@pytest.mark.parametrize(("kind", "keys", "cells"), [("string", range(200), 1), ("long", [*range(200), 5, 5, 9, None], 700), ("long", [], 1 << 21)])
def test_documents_scored_in_place_are_what_a_join_gives(spark, monkeypatch, kind, keys, cells):
    docs = bm25.with_terms(texts(spark, [None if k is None else str(k) if kind == "string" else k for k in keys], kind), "key")
    some = docs.where("length > 1").select("key").distinct()
    model = bm25.Bm25(0.9, 0.4)
    each = lambda: [found(bm25.sparse_search(docs, "key", asked(spark), "query_id", k, model, restrict)) for k, restrict in ((40, None), (3, some))]
    monkeypatch.setattr(bm25, "CELLS", cells)
    got = each()
    monkeypatch.setattr(bm25, "INLINE_PAIRS", 0)
    assert got == each() and got[0]


def test_nothing_is_dealt_by_document(spark):
    docs = bm25.with_terms(texts(spark, range(100), "long"), "key")
    plan = bm25.sparse_search(docs, "key", asked(spark), "query_id", 3)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "hashpartitioning(key" not in plan and "Join" not in plan


def test_a_vector_is_made_once(spark):
    docs = texts(spark, range(50), "long").select("key", hash_vector(F.col("text")).alias("vector"))
    q = docs.where("key < 3").withColumnRenamed("key", "query_id")
    plan = dense.dense_search(docs, "key", q, "query_id", 3)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("sha2(") == 4
