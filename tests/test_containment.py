import random

import pytest

from corvine.catalog import queries
from corvine.operators import containment


def texts(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, body string")


def asked(spark, rows):
    return spark.createDataFrame(rows, "q long, passage string")


def plain(docs, passages):
    return sorted((d, q) for d, t in docs for q, p in passages if t is not None and p and p in t)


def sample():
    rng = random.Random(2)
    words = ["a", "bb", "it's", "back\\slash", "x\ny", "ünï", "", "tab\tbed", "z9", "end."]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 30)))) for i in range(80)] + [(80, None), (81, ""), (81, "a bb it's")]
    passages = []
    for q in range(60):
        t = docs[rng.randrange(80)][1]
        at = rng.randint(0, max(0, len(t) - 1))
        passages.append((q, t[at : at + rng.randint(0, 40)]))
    return docs, [*passages, (60, None), (61, ""), (62, " "), (63, "a bb it's"), (63, "nowhere to be found"), (64, "bb " * 4000)]


@pytest.mark.parametrize("inline", [0, 20_000])
def test_equals_comparing_all_pairs(spark, monkeypatch, inline):
    monkeypatch.setattr(containment, "INLINE_WORDS", inline)
    monkeypatch.setattr(containment, "BLOCK", 7)
    docs, passages = sample()
    got = containment.holding(texts(spark, docs), "doc_id", "body", asked(spark, passages), "q", "passage")
    assert sorted(tuple(r) for r in got.collect()) == plain(docs, passages)


def test_empty_tables(spark):
    docs, passages = sample()
    assert containment.holding(texts(spark, []), "doc_id", "body", asked(spark, passages), "q", "passage").count() == 0
    assert containment.holding(texts(spark, docs), "doc_id", "body", asked(spark, []), "q", "passage").count() == 0


def test_no_join_without_keys_behind_the_cases(spark, sf_dir):
    plan = queries.golden_labels(spark, sf_dir)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
