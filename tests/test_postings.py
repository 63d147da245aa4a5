import random
import uuid

import pytest
from pyspark.sql import functions as F

from corvine.operators import bm25
from corvine.runtime import scratch_root, table
from corvine.sources import postings
from corvine.sources.postings import PostingIndex


def fresh(spark, **how):
    return PostingIndex(spark, f"{scratch_root(spark)}/index-{uuid.uuid4().hex}", **how)


def corpus(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def texts(n, seed=5):
    """Documents over a long-tailed vocabulary, with copies, empty ones and a null."""
    rng = random.Random(seed)
    out = [(i, " ".join(f"w{min(int(rng.paretovariate(0.6)), 400)}" for _ in range(rng.randint(1, 40)))) for i in range(n)]
    return [*out, (n, out[3][1]), (n + 1, out[3][1]), (n + 2, ""), (n + 3, None), (n + 4, "the of and")]


def ask(spark, *qs):
    return spark.createDataFrame(list(enumerate(qs)), "query_id long, text string")


def rows(df, key="doc_id"):
    return sorted((r.query_id, r["rank"], r[key], round(r.score, 12)) for r in df.collect())


QUESTIONS = ("w1 w2 w399", "w7 w7 w9 w250", "w1", "nothing here", "", "the", "w120 w121 w122 w123 w124 w3")


@pytest.mark.parametrize("range_docs", [3, 512])
def test_search_equals_scoring_all_texts(spark, monkeypatch, range_docs):
    monkeypatch.setattr(postings, "RANGE_DOCS", range_docs)
    docs = corpus(spark, texts(220))
    index = fresh(spark)
    index.add(docs.where("doc_id % 3 = 0"), 0)
    index.add(docs.where("doc_id % 3 <> 0"), 1)
    q = ask(spark, *QUESTIONS)
    for k in (1, 10, 500):
        assert rows(index.search(q, "query_id", k)) == rows(bm25.sparse_search(bm25.with_terms(docs, "doc_id"), "doc_id", q, "query_id", k))
    some = docs.where("doc_id % 7 < 3").select("doc_id")
    assert rows(index.search(q, "query_id", 5, restrict=some)) == rows(bm25.sparse_search(bm25.with_terms(docs, "doc_id"), "doc_id", q, "query_id", 5, restrict=some))
    other = bm25.Bm25(0.4, 0.1)
    assert rows(index.search(q, "query_id", 5, other)) == rows(bm25.sparse_search(bm25.with_terms(docs, "doc_id"), "doc_id", q, "query_id", 5, other))


def test_ranges_that_cannot_reach_the_kth_score_are_skipped(spark, monkeypatch):
    monkeypatch.setattr(postings, "RANGE_DOCS", 10)
    filler = [(i, "common " + " ".join(f"x{i}y{j}" for j in range(30))) for i in range(1000)]
    docs = corpus(spark, filler + [(5000 + i, "common rare rare") for i in range(5)])
    index = fresh(spark)
    index.add(docs, 0)
    q, scored = ask(spark, "common rare"), []
    scores = index._scores
    fixed = index.snapshot()
    fixed._scores = lambda pairs, *a: scored.append(pairs.count()) or scores(pairs, *a)
    assert [r.doc_id for r in fixed.search(q, "query_id", 3).orderBy("rank").collect()] == [5000, 5001, 5002]
    assert fixed.bounds(q, "query_id").pairs.count() > 90 and sum(scored) < 12


def test_statistics_do_not_depend_on_the_order_of_batches(spark):
    rows_ = texts(90)
    docs = corpus(spark, rows_)
    tok = bm25.with_terms(docs, "doc_id")
    want = tok.agg(F.count("*"), F.sum("length") / F.count("*")).first()
    df = {r.term: r.df for r in bm25.term_counts(tok, "doc_id").groupBy("term").agg(F.count("*").alias("df")).collect()}
    for parts in ([0, 1, 2], [2, 0, 1], [1, 2, 0]):
        index = fresh(spark)
        for number, part in enumerate(parts):
            index.add(docs.where(F.col("doc_id") % 3 == part), number)
        assert tuple(index.corpus_stats().first()) == tuple(want)
        assert {r.term: r.df for r in index.document_frequencies().collect()} == df
        assert index.lengths().count() == len(rows_)


def test_a_batch_again_and_known_keys_add_nothing(spark):
    docs = corpus(spark, texts(50))
    index = fresh(spark)
    index.add(docs.where("doc_id < 30"), 0)
    index.add(docs, 1)
    before = rows(index.search(ask(spark, *QUESTIONS), "query_id", 7))
    for batch in (1, 0, 1, 2):
        index.add(docs if batch else docs.where("doc_id < 30"), batch)
    assert index.batches() == [0, 1, 2] and index.lengths().count() == 55
    assert rows(index.search(ask(spark, *QUESTIONS), "query_id", 7)) == before


def test_a_batch_that_broke_off_is_not_there(spark):
    docs = corpus(spark, texts(30))
    index = fresh(spark)
    index.add(docs.where("doc_id < 20"), 0)
    index.add(docs, 1)
    corpus_file = f"{index.path}/corpus/batch=1"
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(corpus_file)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    assert index.batches() == [0] and index.corpus_stats().first()["document_count"] == 20 and index.lengths().count() == 20
    index.add(docs, 1)
    assert index.corpus_stats().first()["document_count"] == 35


def test_nulls_repeats_and_other_keys(spark):
    rows_ = [("a", "rank fusion"), ("a", "rank"), (None, "fusion fusion"), ("b", None), ("c", "The Rank-Fusion of ß"), ("d", "x " * 50_000 + "fusion")]
    index = fresh(spark, key="point id", key_type="string")
    index.add(spark.createDataFrame([(k, t, 1) for k, t in rows_], "`point id` string, text string, `range` int"), 0)
    got = {r["point id"] for r in index.search(ask(spark, "fusion"), "query_id").collect()}
    assert got == {"a", None, "d"} and index.lengths().count() == 5
    assert fresh(spark).search(ask(spark, "fusion"), "query_id").count() == 0
    empty = fresh(spark)
    empty.add(corpus(spark, []), 0)
    assert empty.search(ask(spark, "fusion"), "query_id").count() == 0 and empty.corpus_stats().first()["document_count"] == 0
    with pytest.raises(postings.PostingError):
        empty.add(corpus(spark, []), -1)


def test_a_search_reads_no_text(spark, sf_dir):
    index = fresh(spark)
    index.add(table(spark, sf_dir, "documents"), 0)
    hits = index.search(ask(spark, "the rank of things"), "query_id")
    assert all("/index-" in f or "/corvine/" in f for f in hits.inputFiles())
    with pytest.raises(ValueError, match="k1"):
        bm25.Bm25(-1.0)
    with pytest.raises(ValueError, match="b must"):
        bm25.Bm25(1.2, 1.5)
