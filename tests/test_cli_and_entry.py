import importlib
import subprocess
import sys

import __spark_entry__ as entry
from corvine.cli import main


def test_entry_and_names(spark):
    assert entry.entry(spark).count() > 0
    q, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(q) and len(q) > 60


def test_queries_without_the_llm_package(tmp_path):
    code = "import sys, importlib.abc\n" \
        "class Gone(importlib.abc.MetaPathFinder):\n" \
        "    def find_spec(self, name, path, target=None):\n" \
        "        if name == 'corpus_pipeline' or name.startswith('corvine.llm'): raise ModuleNotFoundError(name, name=name)\n" \
        "sys.meta_path.insert(0, Gone())\n" \
        "import __spark_entry__ as e\nassert len(e.queries()) > 50 and not [n for n in e.queries() if n.startswith('op') or n == 'pipeline'], e.queries()\n"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=importlib.import_module("os").path.dirname(entry.__file__))


def test_ingest_ask_evaluate(spark, tmp_path, capsys):
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "fusion.md").write_text("# Fusion\n" + "Reciprocal rank fusion merges the rankings of two searches. " * 5)
    (tmp_path / "c" / "bm25.md").write_text("# Lexical\n" + "Lexical search weighs rare terms above frequent ones. " * 5)
    points = str(tmp_path / "p")
    assert main(["ingest", "--points", points, "--corpus", str(tmp_path / "c")]) == 0
    assert main(["ask", "--points", points, "--mode", "sparse", "What merges rankings?"]) == 0
    assert "Reciprocal rank fusion" in capsys.readouterr().out
    (tmp_path / "g.jsonl").write_text('{"id":"a","question":"rare terms","expected_source_paths":["bm25.md"]}\n')
    run = ["evaluate", "--points", points, "--golden", str(tmp_path / "g.jsonl"), "--mode", "sparse", "--fail-under-hit"]
    assert main([*run, "0.9"]) == 0 and main([*run, "1.1"]) == 1
    assert main(["ask", "--points", points, "--filter", "lang=x", "q"]) == 2
    assert main(["ingest", "--points", points, "--corpus", str(tmp_path / "none")]) == 2
