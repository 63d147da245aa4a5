import json

import pytest
from pyspark.sql import functions as F

from corvine.operators.filters import FilterError
from corvine.plans import checks, report
from corvine.sources.points import CollectionMismatch


def test_identity_sidecar(tmp_path):
    p = report.identity_path(str(tmp_path), "a/b\\c")
    assert p.endswith("collection-identity-a_b_c.json") and report.read_identity(p) is None
    assert report.resolve_identity(p, "c", "e", lambda: None)["source"] == "missing_corpus"
    assert report.resolve_identity(p, "c", "e", lambda: {"doc_count": 3})["source"] == "computed"
    report.write_identity(p, {"doc_count": 2, "corpus_hash": "h"})
    r = report.resolve_identity(p, "c", "e", lambda: None)
    assert (r["source"], r["doc_count"], r["collection"]) == ("sidecar", 2, "c")


def test_checkpoint_resumes_only_the_same_cases(tmp_path):
    p, calls = str(tmp_path / "c.json"), []
    for _ in range(2):
        c = report.Checkpoint(p, ["a", "b"], embedder="hash")
        assert c.run("dense", lambda: calls.append(1) or {"hit": 1}) == {"hit": 1}
    assert calls == [1] and json.load(open(p))["embedder"] == "hash"
    with pytest.raises(ValueError):
        report.Checkpoint(p, ["b", "a"])


def test_errors():
    assert report.classify(FilterError("no lang", "filter_not_allowed"))["status"] == 422
    assert report.classify(CollectionMismatch("secret url")) == {"error_type": "collection_mismatch", "status": 409, "message": report.HIDDEN_CAUSE, "refused": False}
    assert report.classify(report.ProviderError("key"))["status"] == 503 and report.classify(KeyError("x"))["error_type"] == "internal_error"
    report.check_collection(None, "a")
    with pytest.raises(report.WrongCollection):
        report.check_collection("b", "a")


def test_texts():
    calls = checks.Calls(1, 2, 3, 0)
    assert report.preflight(calls, 0, 0, False)[0].startswith("Planned spend: 0 USD") and len(report.preflight(calls, 1, 2, True)) == 6
    assert report.spend_summary(0, 0, 0.0, False).startswith("Spent 0 USD")
    with pytest.raises(checks.CostError):
        report.spend_summary(0, 0, 0.1, False)
    r = report.build_report(["a"], 5, {"embedder": "hash", "llm": "real"}, tier2={"x": 1})
    assert not r["offline_defaults"] and r["tier2"] == {"x": 1} and "tier1" not in r
    page = "a\n<!-- t:start -->\nold\n<!-- t:end -->\nb"
    assert report.render_region(page, "t", {"n": 4}, "n = {n}") == "a\n<!-- t:start -->\nn = 4\n<!-- t:end -->\nb"
    for bad in ({}, None):
        with pytest.raises(ValueError):
            report.render_region(page if bad is not None else "x", "t", {}, "{n}")
    assert "<td>0.5</td>" in report.scorecard_html({"configs": {"a": {"hit": 0.5}}})


def test_segments_and_events(spark):
    assert report.answer_segments("A [1] b [9].", [1]) == [{"text": "A ", "marker": None}, {"text": "[1]", "marker": 1}, {"text": " b ", "marker": None}, {"text": "[9]", "marker": None}, {"text": ".", "marker": None}]
    df = spark.createDataFrame([(1, "two words")], "id int, t string")
    rows = report.answer_events(df, "id", F.col("t"), F.to_json(F.struct("t"))).orderBy("seq").collect()
    assert [r.event for r in rows] == ["meta", "delta", "delta", "result"]
    assert "".join(json.loads(r.data)["text"] for r in rows[1:3]) == "two words" and json.loads(rows[3].data) == {"t": "two words"}
    assert report.encode_event("delta", {"text": "é"}) == 'event: delta\ndata: {"text":"é"}\n\n'.encode()


def test_recorder(spark):
    r = report.Recorder(spark)
    with pytest.raises(ValueError), r.span("step"):
        raise ValueError
    assert r.timings_ms["step"] >= 0 and not r.failed
