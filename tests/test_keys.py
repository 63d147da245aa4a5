import random

from pyspark.sql import functions as F

from corvine.operators import bm25
from corvine.operators.keys import one_per_key
from corvine.runtime import materialize
from tests.test_postings import corpus, fresh


def shuffled(spark):
    """Bytes that all stages so far have written for shuffles."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty()
    return sc.statusStore().executorList(True).head().totalShuffleWrite()


def long_texts(spark, n=60, words=4000):
    rng = random.Random(1)
    rows = [(i, " ".join(f"{rng.getrandbits(40):010x}" for _ in range(words))) for i in range(n)]
    return corpus(spark, rows), sum(len(t) for _, t in rows)


def test_only_rows_of_keys_that_recur_are_moved(spark):
    docs, size = long_texts(spark)
    before = shuffled(spark)
    assert one_per_key(docs, "doc_id", docs.select("doc_id").limit(3)).count() == 57
    assert shuffled(spark) - before < size / 50
    rows = spark.createDataFrame([(1, "a", None), (1, "b", "x"), (1, "b", None), (None, "c", "y"), (None, "d", "y"), (2, None, None), (3, "e", "z"), (4, "f", "z"), (4, "g", "z")], "k long, text string, `a b` string")
    known = spark.createDataFrame([(3,), (3,), (4,)], "k long")
    assert sorted(map(tuple, one_per_key(rows, "k", known).collect()), key=str) == [(1, "b", "x"), (2, None, None), (None, "d", "y")]
    known = spark.createDataFrame([(None,)], "k long")
    assert {r.k for r in one_per_key(rows, "k", known).collect()} == {1, 2, 3, 4}


def test_an_index_moves_terms_twice_at_most_and_no_texts(spark):
    docs, size = long_texts(spark)
    index, before = fresh(spark), shuffled(spark)
    index.add(docs, 0)
    # each term is of one document here: the terms once, then a row for each
    assert shuffled(spark) - before < 5.5 * size
    assert index.postings().count() == bm25.term_counts(bm25.with_terms(docs, "doc_id"), "doc_id").count()


def test_postings_are_moved_once_and_packed(spark):
    """A row is moved for each bucket of a range's terms, not one for each term; terms and keys are not repeated for each posting."""
    words = F.concat_ws(" ", *[F.concat(F.lit("word"), F.floor(F.pow(F.rand(i), F.lit(3)) * 4000)) for i in range(100)])
    docs = materialize(spark.range(4000).select(F.col("id").alias("doc_id"), words.alias("text")))
    index, before = fresh(spark), shuffled(spark)
    index.add(docs, 0)
    moved = shuffled(spark) - before
    entries = index.entry_count()
    assert entries == index.postings().count() > 300_000
    assert moved < 9 * entries


def test_counts_of_frequent_terms_are_not_moved(spark):
    rng = random.Random(2)
    docs = bm25.with_terms(corpus(spark, [(i, " ".join(f"w{rng.randrange(3000)}" for _ in range(3000))) for i in range(80)]), "doc_id")
    before = shuffled(spark)
    rows = bm25.document_weights(docs, "doc_id").count()
    assert shuffled(spark) - before < 4 * rows


def test_counts_of_rare_terms_move_as_much_more_as_there_are_more(spark, monkeypatch):
    monkeypatch.setattr(bm25, "HOT_TERMS", 100)
    least = "spark.sql.autoBroadcastJoinThreshold"

    def moved(n):
        rng = random.Random(3)
        texts = [(i, " ".join(f"{rng.getrandbits(40):010x}" for _ in range(500))) for i in range(n)]
        docs = bm25.with_terms(corpus(spark, texts), "doc_id")
        before = shuffled(spark)
        bm25.document_weights(docs, "doc_id").write.format("noop").mode("overwrite").save()
        return shuffled(spark) - before

    held = spark.conf.get(least)
    spark.conf.set(least, 200_000)  # between the sizes of both tables of document frequencies
    try:
        few, many = moved(20), moved(100)
    finally:
        spark.conf.set(least, held)
    assert many < 5.5 * few


def test_weights_of_frequent_and_rare_terms_and_repeated_rows(spark, monkeypatch):
    rows = [(1, "a1 b1 b1 c1"), (1, "a1 d1 c1 c1"), (None, "a1"), (None, "a1"), (2, "a1 the b1"), (3, ""), (4, "x1 y1 a1")]
    docs = bm25.with_terms(corpus(spark, rows), "doc_id")
    counts = bm25.term_counts(docs, "doc_id")
    df = counts.groupBy("term").count().withColumnRenamed("count", "df")
    want = counts.join(df, "term").crossJoin(bm25.corpus_stats(docs)).select("doc_id", "term", bm25.weight(bm25.Bm25()).alias("weight"))
    for hot in (1, 3, 100):
        monkeypatch.setattr(bm25, "HOT_TERMS", hot)
        assert sorted(map(tuple, bm25.document_weights(docs, "doc_id").collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
