import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvine.config import RetrievalSettings
from corvine.operators import bm25, context, dense, fusion, rerank
from corvine.operators.filters import FilterError, build_filter, parse_filter_arguments
from corvine.plans.retrieve import Corpus, RetrievalError, answer_batch, checked_queries, retrieve, with_payload

TEXTS = {
    "a/1": "Reciprocal rank fusion combines dense and sparse rankings.", "a/2": "BM25 weighs rare terms more than frequent ones.", "b/3": "Dense vectors capture paraphrase.",
    "b/4": "Rank fusion needs no score calibration. Fusion is simple.", "c/5": "the of and is it", "c/6": "",
}


@pytest.fixture(scope="module")
def points(spark):
    rows = [(k, t, k[0], "handbook" if k[0] == "a" else "notes", ["bm25"] if k == "a/2" else ["rrf", "bm25"] if k == "b/4" else None) for k, t in TEXTS.items()]
    return spark.createDataFrame(rows, "point_id string, text string, source_path string, source string, tags array<string>").withColumn("title", F.lit(None).cast("string")).withColumn("heading_path", F.lit(None).cast("string"))


def queries(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id long, text string")


def reference_bm25(query, k1=1.2, b=0.75):
    import re

    from corvine.functions.text import SEARCH_STOPWORDS, TERM

    toks = {k: [w for w in re.findall(TERM, t.lower()) if w not in SEARCH_STOPWORDS] for k, t in TEXTS.items()}
    n, avg = len(toks), sum(map(len, toks.values())) / len(toks)
    out = {}
    for k, t in toks.items():
        s = 0.0
        for w in set(re.findall(TERM, query.lower())) - set(SEARCH_STOPWORDS):
            df = sum(w in x for x in toks.values())
            if tf := t.count(w):
                s += math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(t) / avg))
        if s:
            out[k] = s
    return out


def test_bm25_scores_count_empty_documents(spark, points):
    tok = bm25.with_terms(points, "point_id")
    assert bm25.corpus_stats(tok).first()["document_count"] == 6
    got = {r.point_id: r.score for r in bm25.sparse_search(tok, "point_id", queries(spark, "rank fusion calibration"), "query_id").collect()}
    want = reference_bm25("rank fusion calibration")
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    assert bm25.sparse_search(tok, "point_id", queries(spark, "is it the"), "query_id").count() == 0


def test_sparse_vectors_are_sorted(spark, points):
    for r in bm25.sparse_vectors(bm25.document_weights(bm25.with_terms(points, "point_id"), "point_id"), "point_id").collect():
        assert r.indices == sorted(set(r.indices)) and len(r["indices"]) == len(r["values"])


def test_dense_search_matches_numpy(spark):
    rng = np.random.default_rng(0)
    m = rng.normal(size=(300, 16))
    m[7], m[9] = m[3], 0
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "id long, vector array<double>").repartition(5)
    q = df.where("id in (3, 20)").withColumnRenamed("id", "query_id")
    u = np.divide(m, np.linalg.norm(m, axis=1, keepdims=True), out=np.zeros_like(m), where=np.linalg.norm(m, axis=1, keepdims=True) > 0)
    got = {(r.query_id, r["rank"]): r.id for r in dense.dense_search(df, "id", q, "query_id", 12).collect()}
    for k in (3, 20):
        want = sorted(range(300), key=lambda i: (-round(float(u[i] @ u[k]), 9), i))[:12]
        assert [got[k, i + 1] for i in range(12)] == want
    with pytest.raises(Exception, match="dimensions"):
        dense.dense_search(df, "id", q.withColumn("vector", F.slice("vector", 1, 4)), "query_id").collect()


def ranking(spark, keys):
    return spark.createDataFrame([(0, k, i + 1) for i, k in enumerate(keys)], "q long, k string, rank int")


def test_fusion(spark):
    r = {x.k: x for x in fusion.fuse({"dense": ranking(spark, ["x", "y"]), "sparse": ranking(spark, ["y", "z", "y"])}, "q", "k").collect()}
    assert r["x"].score == 1 / 61 and abs(r["y"].score - (1 / 62 + 1 / 61)) < 1e-15 and r["y"].fused_rank == 1
    assert r["y"].ranks == {"dense": 2, "sparse": 1} and r["z"].contributions == {"sparse": 1 / 62}
    w = {x.k: x.score for x in fusion.fuse({"dense": ranking(spark, ["x"]), "sparse": ranking(spark, ["y"])}, "q", "k", weights={"dense": 0.0}).collect()}
    assert w == {"x": 0.0, "y": 1 / 61}
    tie = fusion.fuse({"dense": ranking(spark, ["b"]), "sparse": ranking(spark, ["a"])}, "q", "k").orderBy("fused_rank").collect()
    assert [x.k for x in tie] == ["a", "b"]
    with pytest.raises(ValueError):
        fusion.fuse({}, "q", "k", k=0)


@pytest.mark.parametrize(("limit", "threshold", "kept", "dropped"), [(10, 0.0163, 1, 3), (10, 0.0, 4, 0), (1, 0.0162, 1, 0), (2, 0.0162, 2, 2)])
def test_threshold(spark, limit, threshold, kept, dropped):
    fused = fusion.fuse({"dense": ranking(spark, list("abcd"))}, "q", "k")
    hits, low = fusion.threshold_and_limit(fused, "q", limit, threshold)
    scores = sorted((r.score for r in fused.collect()), reverse=True)
    assert hits.count() == min(limit, sum(s >= threshold for s in scores) if threshold else 4)
    want = 0 if sum(s >= threshold for s in scores) > limit else sum(s < threshold for s in scores)
    assert low.first().dropped == (want if threshold else 0)


def test_retrieve_filters_before_limits(spark, points):
    s = RetrievalSettings(dense_top_k=1, sparse_top_k=1, top_k=5)
    hits = retrieve(Corpus(points), queries(spark, "rank fusion"), settings=s, flt=build_filter({"source": "handbook"})).collect()
    assert hits and {h.point_id[0] for h in hits} == {"a"}
    tags = build_filter({"tags": ["rrf", "none"]}).apply(points).collect()
    assert [r.point_id for r in tags] == ["b/4"]


def test_stopword_query_still_has_dense_hits(spark, points):
    hits = retrieve(Corpus(points), queries(spark, "is it the"), settings=RetrievalSettings(top_k=3)).collect()
    assert len(hits) == 3 and all(set(h.ranks) == {"dense"} for h in hits)


def test_bad_requests(spark, points):
    with pytest.raises(RetrievalError):
        checked_queries(queries(spark, "  "), "query_id")
    for bad in (RetrievalSettings(mode="x"), RetrievalSettings(top_k=0)):
        with pytest.raises(RetrievalError):
            retrieve(Corpus(points), queries(spark, "a"), settings=bad)


@pytest.mark.parametrize(("raw", "kind"), [({"lang": "x"}, "filter_not_allowed"), ({"source": ""}, "filter_invalid_value"), ({"source": []}, "filter_invalid_value"), ({"tags": [1]}, "filter_invalid_value"), ({"tags": 5}, "filter_invalid_value"), ("x", "filter_invalid_value")])
def test_bad_filters(raw, kind):
    with pytest.raises(FilterError) as e:
        build_filter(raw)
    assert e.value.error_type == kind


def test_filter_forms():
    assert build_filter({}) is None and build_filter(None) is None
    f = build_filter({"source": [" a", "a", "b "], "title": "t"})
    assert f.conditions[0].values == ("a", "b") and f.unindexed == ("title",)
    assert parse_filter_arguments(["tags=a=b", " tags = c"]) == {"tags": ["a=b", "c"]}
    with pytest.raises(FilterError):
        parse_filter_arguments(["nothing"])


def test_rerank(spark):
    hits = spark.createDataFrame([(0, "p", 1, "rank fusion", "other words"), (0, "q", 2, "rank fusion", "fusion of ranks, rank by rank"), (0, "r", 3, "rank fusion", "fusion")], "q long, k string, rank int, query string, text string")
    out, err = rerank.rerank(hits, "q", rerank.term_coverage, 2)
    assert [(r.k, r["rank"], r.pre_rerank_rank, r.rerank_score) for r in out.orderBy("rank").collect()] == [("q", 1, 2, 1.0), ("r", 2, 3, 0.5)] and err is None
    boom = F.udf(lambda a, b: 1 / 0, "double")
    out, err = rerank.rerank(hits, "q", boom, 2)
    assert [r.k for r in out.orderBy("rank").collect()] == ["p", "q"] and err
    with pytest.raises(rerank.RerankError):
        rerank.rerank(hits, "q", lambda a, b: F.col("missing"), 2, fail_open=False)
    assert rerank.build_reranker("off") is None
    with pytest.raises(ValueError):
        rerank.build_reranker("magic")


def hits_of(spark, *texts):
    return spark.createDataFrame([(0, i + 1, f"k{i}", f"p{i}.md", None, None, t, 1.0 / (i + 1)) for i, t in enumerate(texts)], "query_id long, rank int, key string, source_path string, title string, heading_path string, text string, score double")


def test_budget_skips_and_goes_on(spark):
    r = context.select_blocks(hits_of(spark, "x" * 4000, "y" * 4000, "z" * 40), "query_id", 8, 1100).first()
    assert [(b.marker, b.key) for b in r.blocks] == [(1, "k0"), (2, "k2")] and r.dropped == 1
    r = context.select_blocks(hits_of(spark, "x" * 9000, "y"), "query_id", 8, 10).first()
    assert [b.key for b in r.blocks] == ["k0"]
    r = context.select_blocks(hits_of(spark, *"abcd"), "query_id", 2, 6000).first()
    assert len(r.blocks) == 2 and r.dropped == 2


def test_prompt_round_trip(spark):
    rows = answer_batch(hits_of(spark, "First body.\nSecond line", " "), queries(spark, " ask [1]? "), "query_id").first()
    assert rows.prompt.endswith("\n\nQuestion: ask [1]?") and rows.prompt.startswith("Context blocks:\n\n[1] source=p0.md\nFirst body.")
    assert context.parse_blocks(rows.prompt) == [(1, "First body.\nSecond line")]


def test_answers_and_refusals(spark, points):
    q = queries(spark, "How does rank fusion work?", "zzzz yyyy", "unrelated chemistry question")
    c = Corpus(points)
    h = with_payload(retrieve(c, q, settings=RetrievalSettings(mode="sparse")), c, ["source_path", "title", "heading_path", "text"]).withColumn("key", F.col("point_id"))
    h = h.unionByName(h.where("query_id = 0").limit(1).withColumn("query_id", F.lit(2).cast("long")))
    out = {r.query_id: r for r in answer_batch(h, q, "query_id").collect()}
    assert not out[0].refused and out[0].cited == [1, 2] and "[1]." in out[0].answer and out[0].hits_used == 2
    assert out[1].refusal_reason == "no_evidence" and out[1].cited == [] and out[1].hits_used == 0
    assert out[2].refusal_reason == "model_abstained"


@pytest.mark.parametrize("block", [64, 640, 32 << 20])
def test_tiles_of_queries_give_what_one_block_gives(spark, monkeypatch, block):
    """However many tiles and parts: ties by key, zero vectors, nulls, and no query in the driver beyond one block."""
    monkeypatch.setattr(dense, "BLOCK_BYTES", block)
    vectors = [(f"k{i:03}", [float(i % 5), float(i % 3), 1.0 - i % 2] if i % 11 else [0.0, 0.0, 0.0]) for i in range(70)] + [("null", None)]
    queries = [(i, [1.0, float(i % 4), 0.5] if i % 9 else None if i else [0.0, 0.0, 0.0]) for i in range(25)]
    v = spark.createDataFrame(vectors, "key string, vector array<double>")
    q = spark.createDataFrame(queries, "query_id long, vector array<double>")
    got = dense.dense_search(v, "key", q, "query_id", 4)
    unit = lambda x: [a / (math.sqrt(sum(b * b for b in x)) or 1.0) for a in x]
    want = set()
    for i, x in queries:
        if x is not None:
            scored = sorted((-round(sum(a * b for a, b in zip(unit(x), unit(y), strict=True)), 9) + 0.0, k) for k, y in vectors if y is not None)
            want |= {(i, k, r + 1, abs(round(s, 8))) for r, (s, k) in enumerate(scored[:4])}
    assert {(r.query_id, r.key, r["rank"], abs(round(r.score, 8))) for r in got.collect()} == want
    assert dense.dense_search(v, "key", q.limit(0), "query_id", 4).count() == 0
    with pytest.raises(Exception, match="dimensions"):
        dense.dense_search(v, "key", q.where("query_id = 1").withColumn("vector", F.array(F.lit(1.0))), "query_id", 4).collect()
