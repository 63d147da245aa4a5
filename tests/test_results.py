import uuid

import pytest
from pyspark.sql import functions as F

from corvine.functions.identity import cache_digest
from corvine.plans.results import ResultTable
from corvine.runtime import scratch_root


def table(spark, room=None):
    return ResultTable(spark, f"{scratch_root(spark)}/results-{uuid.uuid4().hex}", "answer string, n int", room)


def asked(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "id long, text string")


class Answerer:
    def __init__(self):
        self.calls = []

    def __call__(self, new):
        self.calls.append(sorted(r.text for r in new.collect()))
        return new.where("text <> 'unanswered'").select("digest", F.upper("text").alias("answer"), F.length("text").alias("n"))


def ask(t, spark, answer, *texts, model="m"):
    out = t.answered(asked(spark, *texts), "id", cache_digest(F.lit(model), F.col("text")), answer)
    return {r.id: (r.answer, r.n) for r in out.collect()}


def test_only_new_questions_go_on(spark):
    t, answer = table(spark), Answerer()
    assert ask(t, spark, answer, "a", "bb", "a") == {0: ("A", 1), 1: ("BB", 2), 2: ("A", 1)} and answer.calls == [["a", "bb"]]
    assert ask(t, spark, answer, "bb", "a") == {0: ("BB", 2), 1: ("A", 1)} and len(answer.calls) == 1
    assert ask(t, spark, answer, "bb", "c", "unanswered") == {0: ("BB", 2), 1: ("C", 1), 2: (None, None)} and answer.calls[1:] == [["c", "unanswered"]]
    assert ask(t, spark, answer, "a", model="other") == {0: ("A", 1)} and answer.calls[2:] == [["a"]]
    assert ask(t, spark, answer) == {} and t.results().count() == 4


@pytest.mark.parametrize("room", [0, 2])
def test_the_least_recently_used_goes(spark, room):
    t, answer = table(spark, room), Answerer()
    for texts in (("a",), ("b",), ("a",), ("c",), ("a",), ("b",)):
        assert [v[0] for v in ask(t, spark, answer, *texts).values()] == [x.upper() for x in texts]
    assert answer.calls == ([["a"], ["b"], ["c"], ["b"]] if room else [["a"], ["b"], ["a"], ["c"], ["a"], ["b"]]) and t.results().count() == room


def test_a_batch_that_broke_off_does_not_count(spark):
    t, answer = table(spark), Answerer()
    ask(t, spark, answer, "a")
    p = t._hadoop.Path(f"{t.path}/results/batch=0/_SUCCESS")
    t._fs.delete(p, False)
    assert t.results().count() == 0 and ask(t, spark, answer, "a") == {0: ("A", 1)} and len(answer.calls) == 2
