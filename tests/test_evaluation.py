import math
import random

import pytest
from pyspark.sql import functions as F

from corvine.catalog import queries
from corvine.config import Settings, load_settings
from corvine.plans import checks, evaluate, stats


def test_pinned_statistics(spark):
    a = [True] * 12 + [False] * 3
    df = spark.createDataFrame([(x, not x) for x in a], "a boolean, b boolean")
    r = stats.paired(df).first()
    assert (r.a_only, r.b_only, r.p_exact) == (12, 3, 0.03515625) and r.delta == 0.6
    same = spark.createDataFrame([(True, True)], "a boolean, b boolean")
    assert stats.paired(same).first().p_exact == 1.0


def test_exact_test_for_many_pairs(spark):
    df = spark.createDataFrame([(k, n) for n in (1, 10, 62, 200, 900) for k in (0, n // 3, n // 2)], "k int, n int")
    for r in df.select("k", "n", stats.binomial_tail_p(F.col("k"), F.col("n")).alias("p")).collect():
        want = min(1.0, 2 * sum(math.comb(r.n, i) for i in range(r.k + 1)) / 2**r.n)
        assert r.p == pytest.approx(want, rel=1e-9)


def test_pinned_bootstrap(spark):
    a, b = [True, False, True, False], [False, False, True, True]
    low, high = stats.bootstrap_interval([int(x) - int(y) for x, y in zip(a, b, strict=True)], 1000, 7)
    df = spark.createDataFrame([("s", i, x, y) for i, (x, y) in enumerate(zip(a, b, strict=True))], "scope string, i int, a boolean, b boolean")
    r = stats.bootstrap(df, ["scope"], "i", 1000, 7).first()
    assert (r.ci_low, r.ci_high) == (low, high) and low <= 0 <= high
    with pytest.raises(ValueError):
        stats.bootstrap_interval([], 10)


@pytest.mark.parametrize(("n", "low", "high", "want"), [(29, 0.1, 0.2, (False, "n < 30")), (30, -0.1, 0.2, (False, "ci95 includes zero")), (30, 0.0, 0.2, (False, "ci95 includes zero")), (30, 0.1, 0.2, (True, "")), (30, -0.3, -0.1, (True, ""))])
def test_reportable(spark, n, low, high, want):
    assert tuple(spark.range(1).select(*stats.reportable(F.lit(n), F.lit(low), F.lit(high))).first()) == want


def test_minimum_detectable_effect(spark):
    small, large = (stats.minimum_detectable_effect(spark, n, 0.5, simulations=200) for n in (20, 200))
    assert 0 < large < small <= 0.5
    assert stats.minimum_detectable_effect(spark, 3, 0.5, simulations=50) == 0.5
    with pytest.raises(ValueError):
        stats.minimum_detectable_effect(spark, 0, 0.5)


CASES = "id int, text string, expected array<string>, category string, answerable boolean"


def tier1(spark, expected, got, category="c"):
    cases = spark.createDataFrame([(1, "q", expected, category, None)], CASES)
    hits = spark.createDataFrame([(1, k, i + 1) for i, k in enumerate(got)], "id int, k string, rank int")
    return evaluate.tier1_cases(cases, hits, "k").first()


def test_tier1_case(spark):
    r = tier1(spark, ["a", "b"], ["x", "a", "a", "y"])
    assert (r.recall, r.hit_rank, r.reciprocal_rank) == (0.5, 2, 0.5)
    assert r.ndcg == pytest.approx((1 / math.log2(3)) / (1 + 1 / math.log2(3)))
    late = tier1(spark, ["b"], ["x", "x", "b"])
    assert late.reciprocal_rank == pytest.approx(1 / 3) and late.ndcg == pytest.approx(1 / math.log2(3))
    none = tier1(spark, [], ["x"])
    assert not none.scored and not none.hit and none.ndcg == 0
    assert not tier1(spark, ["q"], []).hit


def test_tier1_aggregates(spark):
    cases = spark.createDataFrame([(1, "q", ["a"], "x", None), (2, "q", ["b"], None, None), (3, "q", [], "u", None)], CASES)
    hits = spark.createDataFrame([(1, "a", 1), (2, "z", 1)], "id int, k string, rank int")
    rows = evaluate.tier1_cases(cases, hits, "k")
    m = evaluate.tier1_metrics(rows).first()
    assert (m.cases, m.scored_cases, m.hit_at_k, m.mrr) == (3, 2, 0.5, 0.5)
    assert {(r.category, r.cases) for r in evaluate.by_category(rows).collect()} == {(None, 2), ("x", 1)}
    assert evaluate.tier1_metrics(rows.where("id > 9")).first().hit_at_k == 0.0


def test_unanswerable_rule(spark):
    rows = [(1, "", ["a"], "unanswerable", True), (2, "", ["a"], None, False), (3, "", [], None, None), (4, "", ["a"], "unanswerable", None), (5, "", ["a"], None, None)]
    got = {r.id: r.u for r in spark.createDataFrame(rows, CASES).select("id", evaluate.unanswerable().alias("u")).collect()}
    assert got == {1: False, 2: True, 3: True, 4: True, 5: False}


def test_tier2(spark):
    cases = spark.createDataFrame([(1, "rank fusion", ["p"], "c", None), (2, "nothing", [], "u", None), (3, "missed", ["p"], "c", None)], CASES)
    block = "array<struct<marker:int,key:string,text:string>>"
    rows = [(1, "rank fusion is here [1][2]", [(1, "p", "rank fusion"), (2, "q", "is here")], [2, 1], [9], False), (2, "no", [], [], [], True), (3, "no", [], [], [], True)]
    a = spark.createDataFrame(rows, f"id int, answer string, blocks {block}, cited array<int>, invalid_markers array<int>, refused boolean")
    per = evaluate.tier2_cases(cases, a)
    r = {x.id: x for x in per.collect()}
    assert r[1].cited_keys == ["q", "p"] and r[1].citation_precision == 0.5 and r[1].relevance == 1.0 and r[1].faithfulness == 1.0
    assert r[2].refusal_correct and not r[3].refusal_correct and r[3].faithfulness is None
    m = evaluate.tier2_metrics(per).first()
    assert (m.citation_precision, m.invalid_marker_rate, m.refusal_accuracy, m.refusals) == (0.5, 0.3333, 0.6667, 2)
    assert evaluate.tier2_metrics(per.where("id = 2")).first().faithfulness is None


def test_scorecard(spark):
    rows = [(c, i, "slice" if i % 2 else None, (i + len(c)) % 3 == 0) for c in evaluate.CONFIGURATIONS for i in range(12)]
    df = spark.createDataFrame(rows, "config string, id int, category string, hit boolean")
    metrics = {c: dict.fromkeys(evaluate.METRICS, 0.5) for c in evaluate.CONFIGURATIONS}
    prov = {"commit": "x", "corpus": {"path": "p", "documents": 1, "chunks": 2}, "golden": {"path": "g", "items": 12}, "embedder": "e", "llm": "l", "judge": "none", "cost_usd": 0.0, "cost_estimate_usd": 0.0, "cost_expected_usd": 0.0, "billed": False}
    card = evaluate.build_scorecard(df, metrics, prov, resamples=50)
    assert len(card["comparisons"]) == 9 and set(card["slices"]) == {"slice", "uncategorized"}
    for broken in ({**card, "extra": 1}, {**card, "schema_version": 2}, {**card, "provenance": {**card["provenance"], "billed": True}}, {**card, "provenance": {**card["provenance"], "bootstrap_seed": None}}):
        with pytest.raises(ValueError):
            evaluate.validate_scorecard(broken)


def test_costs(spark):
    calls = checks.derive_calls(60, evaluate.CONFIGURATIONS, 100, True, "openai", "none")
    assert (calls.document_embeddings, calls.query_embeddings, calls.generations, calls.judge_calls) == (100, 360, 240, 0)
    log = spark.createDataFrame([("documents", 5, 1000, None), ("query", 1, 10, None), ("generation", 1, 2000, 300)], "kind string, items int, prompt_tokens long, completion_tokens long")
    r = checks.ledger(log, True)
    assert r["cost_usd"] == round((1010 * 0.02 + 2000 * 0.15 + 300 * 0.6) / 1e6, 6) and r["document_embeddings"] == 5
    assert checks.ledger(log, False)["cost_usd"] == 0.0
    for bad, how in ((log.withColumn("prompt_tokens", F.lit(None).cast("long")), {}), (log.withColumn("kind", F.lit("x")), {}), (log, {"bound": 1e-9})):
        with pytest.raises(checks.CostError):
            checks.ledger(bad, True, **how)
    with pytest.raises(ValueError):
        checks.require_consent(True, False)


def test_cache_and_keys():
    assert checks.canonical_filters({"b": ["y", "x"], "a": "1"}) == '{"a":"1","b":["x","y"]}' and checks.canonical_filters({}) == checks.canonical_filters(None) == ""
    assert checks.retrieval_fingerprint(mode="hybrid", top_k=3) != checks.retrieval_fingerprint(mode="hybrid", top_k=4)
    c = checks.ResultCache(2)
    c.put("a", 1), c.put("b", 2), c.get("a"), c.put("c", 3)
    assert (c.get("a"), c.get("b"), c.get("c")) == (1, None, 3)
    assert checks.sample_ids(list("abcdef"), 3, 5) == checks.sample_ids(list("abcdef"), 3, 5) and checks.sample_ids(["a"], 5, 1) == ["a"]


def test_settings(tmp_path):
    p = tmp_path / "s.yaml"
    p.write_text('{"retrieval": {"top_k": 7, "unknown": 1}, "chunking": {"size": 500}}')
    s = load_settings(str(p), {"CORVINE_RETRIEVAL__RRF_K": "30", "CORVINE_API_KEY": "secret"})
    assert (s.retrieval.top_k, s.chunking.size, s.retrieval.rrf_k) == (7, 500, 30) and s.safe_dump()["api_key"] == "***"
    assert load_settings(str(tmp_path / "none.yaml"), {}) == Settings()


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1000])
def test_block_draws_are_those_of_the_standard_library(n, monkeypatch):
    monkeypatch.setattr(stats, "BLOCK", 500)
    draw = random.Random(5).randrange
    assert [x for p in stats.picks(n, 9, 5) for x in p.ravel()] == [draw(n) for _ in range(9 * n)]


def test_queries_run_all_resamples_and_simulations(spark, monkeypatch):
    """The registered queries give what the published numbers of resamples and simulations give."""
    pairs = spark.createDataFrame([(i, "en", i % 3 > 0, i % 5 > 0) for i in range(90)], "doc_id long, lang string, a boolean, b boolean")
    cases = spark.createDataFrame([(c, i, "one", i % k > 0) for c, k in (("sparse", 3), ("dense", 5)) for i in range(90)], "config string, id long, category string, hit boolean")
    monkeypatch.setattr(queries, "_pairs", lambda *a: pairs)
    monkeypatch.setattr(queries, "_ablation", lambda *a: cases)
    draw = random.Random(20260811).randrange
    d = [(i % 3 > 0) - (i % 5 > 0) for i in range(90)]
    means = sorted(sum(d[draw(90)] for _ in d) / 90 for _ in range(10_000))
    at = lambda p: (lambda x, i: means[i] * (1 - x % 1) + means[i + 1] * (x % 1))(9_999 * p, int(9_999 * p))
    r = queries.bootstrap_ci(spark, "").first()
    assert (r.ci_low, r.ci_high) == pytest.approx((at(0.025), at(0.975)), abs=1e-12)
    rate = sum(i % 3 > 0 for i in range(90)) / 90
    assert queries.mde(spark, "").first().mde == stats.minimum_detectable_effect(spark, 60, rate, simulations=2000)
    seen = []
    monkeypatch.setattr(stats, "bootstrap", lambda o, scope, order, resamples, seed: seen.append((resamples, seed)) or o.groupBy(*scope).agg(F.lit(0.0).alias("ci_low"), F.lit(0.0).alias("ci_high")))
    assert queries.scorecard_comparisons(spark, "").count() == 2 and set(seen) == {(10_000, 20260811)}


def test_mde_has_a_row_for_every_language(spark, monkeypatch):
    langs = [None, "de", "en", "es", "fr", "it"]
    pairs = spark.createDataFrame([(i, lang, i % 3 > 0, True) for i in range(30) for lang in langs], "doc_id long, lang string, a boolean, b boolean")
    monkeypatch.setattr(queries, "_pairs", lambda *a: pairs)
    monkeypatch.setattr(stats, "minimum_detectable_effect", lambda spark, n, rate: round(rate, 2))
    assert {(r.lang, r.mde) for r in queries.mde(spark, "").collect()} == {(lang, 0.67) for lang in langs}
    monkeypatch.setattr(queries, "MAX_GROUPS", 5)
    with pytest.raises(ValueError):
        queries.mde(spark, "")
