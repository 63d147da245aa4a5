import json
import subprocess
import sys
import uuid
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from corvine.operators import bm25
from corvine.runtime import scratch_root, table
from jobs import evaluation_report, refresh_index
from jobs.common import JobError, command_line, file_pattern, settings
from jobs.evaluation_report import ReportConfig
from jobs.refresh_index import RefreshConfig

ROOT = Path(__file__).resolve().parent.parent


@pytest.fixture
def folder(spark):
    return f"{scratch_root(spark)}/jobs-{uuid.uuid4().hex}"


def contents(df):
    return sorted((json.dumps(r.asDict(recursive=True), sort_keys=True, default=str) for r in df.collect()))


def parts(spark, sf_dir, n):
    """Copies of the documents in n parts."""
    docs = table(spark, sf_dir, "documents")
    return [docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(n)) == k) for k in range(n)]


def refresh(spark, at, source, **how):
    config = RefreshConfig(source, f"{at}/output", f"{at}/checkpoint", **how)
    return config, refresh_index.run(spark, config)


def test_growing_input_equals_one_run(spark, sf_dir, folder):
    """Two runs over growing input read only what is new, and give what one run over everything gives."""
    some = parts(spark, sf_dir, 3)
    some[0].repartition(2).write.parquet(f"{folder}/in")
    config, first = refresh(spark, folder, f"{folder}/in")
    assert first["documents"] == first["catalogued"] == some[0].count() and first["batches"] == 1
    for p in some[1:]:
        p.coalesce(1).write.mode("append").parquet(f"{folder}/in")
    _, second = refresh(spark, folder, f"{folder}/in", files_per_batch=1)
    whole = table(spark, sf_dir, "documents")
    assert second["documents"] == whole.count() and second["batches"] == 3
    new = refresh_index.read_catalogue(spark, config).where("batch > 0").count()
    assert new == some[1].count() + some[2].count()
    again, third = refresh(spark, folder, f"{folder}/in")
    assert third == second
    other, _ = refresh(spark, f"{folder}-other", f"{sf_dir}/documents.parquet")
    want = contents(refresh_index.read_output(spark, other))
    assert contents(refresh_index.read_output(spark, config)) == want == contents(refresh_index.read_output(spark, again))
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    hits = config.index(spark).search(q, "query_id", 5)
    plain = bm25.sparse_search(bm25.with_terms(whole, "doc_id"), "doc_id", q, "query_id", 5)
    assert contents(hits) == contents(plain)


def test_a_documents_rows_stand_together_in_the_output(spark, folder):
    """Each row has its document's digest; digests that change from row to row made the output of 0.5 GB thirty-five times that of 0.1 GB."""
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *[F.concat(F.lit("w"), F.pmod(F.xxhash64("id", F.lit(i)), F.lit(500))) for i in range(20)]).alias("text"))
    docs.select("*", F.lit("en").alias("lang"), F.lit("s").alias("source")).repartition(3).write.parquet(f"{folder}/in")
    config, _ = refresh(spark, folder, f"{folder}/in")
    refresh_index.read_output(spark, config).write.parquet(f"{folder}/whole")
    files = spark.read.parquet(f"{folder}/whole").select("doc_id", F.input_file_name().alias("f")).groupBy("f").agg(F.collect_list("doc_id").alias("ids")).collect()
    runs = sum(1 + sum(a != b for a, b in zip(r.ids, r.ids[1:])) for r in files)
    assert runs == 3000 < sum(len(r.ids) for r in files) / 10


def test_a_batch_that_broke_off_is_done_again(spark, sf_dir, folder):
    some = parts(spark, sf_dir, 2)
    for p in some:
        p.coalesce(1).write.mode("append").parquet(f"{folder}/in")
    config = RefreshConfig(f"{folder}/in", f"{folder}/output", f"{folder}/checkpoint")
    config.index(spark).add(some[0], 0)  # as if a run had ended in the middle of its first batch
    assert refresh_index.run(spark, config)["documents"] == table(spark, sf_dir, "documents").count()
    want = contents(refresh_index.read_output(spark, config))
    for number in (0,):  # the same batch once more, whole
        refresh_index.add_batch(spark, config, spark.read.parquet(f"{folder}/in"), number)
    assert contents(refresh_index.read_output(spark, config)) == want


def test_known_null_and_repeated_documents(spark, folder):
    rows = [(1, "alpha beta", "en", "a/b"), (1, "alpha", "en", "a/b"), (2, None, None, None), (3, "", "fr", "1"), (None, "no id", "en", "x"), (3, "", "fr", "1")]
    schema = "doc_id long, text string, lang string, source string, `extra.x` int"
    spark.createDataFrame([(*r, 1) for r in rows], schema).write.parquet(f"{folder}/in")
    config, done = refresh(spark, folder, f"{folder}/in")
    assert done["documents"] == 3
    spark.createDataFrame([(1, "changed", "en", "a/b", 1), (4, "gamma", "de", "c", 1)], schema).write.mode("append").parquet(f"{folder}/in")
    _, done = refresh(spark, folder, f"{folder}/in")
    got = {(r.doc_id, r.term, r.tf, r.source, r.n_terms) for r in refresh_index.read_output(spark, config).collect()}
    assert got == {(1, "alpha", 1, "a/b", 2), (1, "beta", 1, "a/b", 2), (2, None, None, None, 0), (3, None, None, "1", 0), (4, "gamma", 1, "c", 1)} and done["documents"] == 4


def test_empty_input(spark, folder):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string").write.parquet(f"{folder}/in")
    config, done = refresh(spark, folder, f"{folder}/in")
    assert done["documents"] == 0 and refresh_index.read_output(spark, config).count() == 0


def report(spark, folder, sf_dir, **how):
    config = ReportConfig(f"{sf_dir}/documents.parquet", f"{sf_dir}/benchmark.parquet", f"{folder}/report", **how)
    return config, evaluation_report.run(spark, config)


def test_report_again_is_the_same(spark, sf_dir, folder):
    config, done = report(spark, folder, sf_dir)
    n = table(spark, sf_dir, "benchmark").count()
    assert done["rows"] == 2 * n
    first = contents(evaluation_report.read_output(spark, config))
    assert report(spark, folder, sf_dir)[1] == done and contents(evaluation_report.read_output(spark, config)) == first
    config, done = report(spark, folder, sf_dir, configurations=("sparse", "sparse"), top_k=1)
    assert done["rows"] == n and {r.config for r in evaluation_report.read_output(spark, config).collect()} == {"sparse"}
    assert all(len(r.retrieved) <= 1 for r in evaluation_report.read_output(spark, config).collect())
    with pytest.raises(JobError):
        report(spark, folder, sf_dir, configurations=("fancy",))
    with pytest.raises(JobError):
        report(spark, folder, sf_dir, configurations=())


def test_report_of_planted_cases(spark, folder):
    docs = [(1, "the quick brown fox jumps"), (2, "a quick brown fox runs far"), (3, None), (4, "unrelated words entirely")]
    asked = [(10, "quick brown fox"), (11, "unrelated words entirely"), (12, "missing passage of words"), (13, ""), (14, None)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(asked, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    config, _ = report(spark, folder, folder, configurations=("sparse",))
    got = {r.id: (r.category, r.hit, r.n_expected, sorted(r.retrieved)) for r in evaluation_report.read_output(spark, config).collect()}
    assert got == {10: ("multi", True, 2, [1, 2]), 11: ("single", True, 1, [4]), 12: ("unanswerable", False, 0, [4]), 13: ("unanswerable", False, 0, []), 14: ("unanswerable", False, 0, [])}


def test_settings(tmp_path):
    file = tmp_path / "x.json"
    file.write_text(json.dumps({"documents": "d", "questions": "q", "output": "o", "configurations": ["dense"]}))
    got = settings(ReportConfig, str(file), {"top_k": 9, "output": None})
    assert got == ReportConfig("d", "q", "o", ("dense",), 9)
    with pytest.raises(JobError, match="missing"):
        settings(ReportConfig, str(tmp_path / "none.json"), {"documents": "d"})
    file.write_text('{"nonsense": 1}')
    with pytest.raises(JobError, match="unknown"):
        settings(ReportConfig, str(file), {})
    assert file_pattern("/a/b.parquet") == "/a/b.parque[t]" and file_pattern("/a/*.parquet") == "/a/*.parquet"
    assert callable(command_line)


@pytest.mark.parametrize("job", ["refresh_index", "evaluation_report"])
def test_command_line(job, sf_dir, tmp_path):
    """As a user runs it: twice, from the shell, with the settings file for what is not given."""
    paths = {
        "refresh_index": ["--input", f"{sf_dir}/documents.parquet", "--output", f"{tmp_path}/out", "--checkpoint", f"{tmp_path}/cp"],
        "evaluation_report": ["--documents", f"{sf_dir}/documents.parquet", "--questions", f"{sf_dir}/benchmark.parquet", "--output", f"{tmp_path}/out", "--configurations", "sparse"],
    }[job]
    lines = []
    for _ in range(2):
        done = subprocess.run([sys.executable, "-m", f"jobs.{job}", *paths], cwd=ROOT, capture_output=True, text=True, timeout=300, check=True)
        lines.append(done.stdout.strip().splitlines()[-1])
        assert f"jobs.{job}" in done.stderr or "__main__" in done.stderr
    assert lines[0] == lines[1] and json.loads(lines[0])
