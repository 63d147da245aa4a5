import pytest
from pyspark.sql import functions as F

from corvine.operators import answer


def run(spark, text, markers=(1, 2, 3)):
    df = spark.createDataFrame([(text, [(m,) for m in markers])], "answer string, blocks array<struct<marker:int>>")
    return answer.cited(df).first()


@pytest.mark.parametrize(("text", "clean", "cited", "bad"), [
    ("Both agree [1, 2].", "Both agree [1][2].", [1, 2], []), ("Invented support [7].", "Invented support.", [], [7]), ("A [2;9] b [2] c [ 1 ] [9]", "A [2] b [2] c [1]", [2, 1], [9]),
    ("none", "none", [], []), ("x  [8]  y , z", "x y, z", [], [8]),
])
def test_markers(spark, text, clean, cited, bad):
    r = run(spark, text)
    assert (r.answer, r.cited, r.invalid_markers) == (clean, cited, bad)


@pytest.mark.parametrize(("text", "cited", "hits", "why"), [
    ("", [], True, "empty_answer"), (" \n", [1], True, "empty_answer"), ("so INSUFFICIENT_CONTEXT it is", [1], True, "model_abstained"), ("fine", [], True, "no_citations"),
    ("fine [1]", [1], True, None), ("fine [1]", [1], False, "no_evidence"),
])
def test_refusal_order(spark, text, cited, hits, why):
    df = spark.createDataFrame([(text, cited, hits)], "a string, c array<int>, h boolean")
    assert df.select(answer.refusal_reason(F.col("a"), F.col("c"), F.col("h"))).first()[0] == why


def test_judge(spark):
    df = spark.createDataFrame([("What is rank fusion?", "Rank fusion sums ranks [1].", ["fusion sums"], False), ("q", "a", ["c"], True), ("the", "of", [], False)], "q string, a string, c array<string>, r boolean")
    f, r = answer.judge(F.col("q"), F.col("a"), F.col("c"), F.col("r"))
    got = [tuple(x) for x in df.select(f, r).collect()]
    assert got == [(0.5, 1.0), (None, None), (None, None)]


def test_judge_replies(spark):
    replies = ['ok {"faithfulness": 1.5, "relevance": "high"}', "none", '{"faithfulness": 0.12345, "relevance": -1}']
    df = spark.createDataFrame([(x,) for x in replies], "t string")
    assert [tuple(x) for x in df.select(*answer.parse_judge_reply(F.col("t"))).collect()] == [(1.0, None), (None, None), (0.1235, 0.0)]
