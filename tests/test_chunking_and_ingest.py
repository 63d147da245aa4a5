import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corvine.functions import identity
from corvine.operators.chunking import ChunkRules, chunk_documents, chunk_text, cuts, sections, spans, split_text
from corvine.plans import ingest
from corvine.sources import corpus
from corvine.sources.points import CollectionMismatch, PointsTable, assert_embedder
from corvine.streaming.ingest import document_stream, ingest_stream

TEXT = st.text(alphabet="ab .\n#", max_size=400)


def test_sections_and_fences():
    md = "intro\n# A #\none\n```\n# not a heading\n~~~\n## B\ntwo\n### C ##\n\n## D\nthree\n# E\n"
    assert list(sections(md)) == [(None, [], "intro"), ("A", ["A"], "one\n```\n# not a heading\n~~~"), ("B", ["A", "B"], "two"), ("D", ["A", "D"], "three")]
    assert list(sections("####### seven\n#x")) == [(None, [], "####### seven\n#x")]


@settings(max_examples=150, deadline=None)
@given(TEXT, st.integers(3, 60))
def test_cuts_are_lossless_and_bounded(s, limit):
    ends = list(cuts(s, 0, len(s), ChunkRules().separators, limit))
    assert ends == sorted(set(ends)) and (ends[-1:] == [len(s)] if s else ends == [])
    assert all(b - a <= limit for a, b in zip([0, *ends], ends, strict=False))


@settings(max_examples=150, deadline=None)
@given(TEXT, st.integers(10, 60), st.integers(0, 9))
def test_spans_cover_with_overlap(s, size, overlap):
    rules = ChunkRules(size=size, overlap=overlap, least=1)
    found = list(spans(s, rules)) if s else []
    assert all(0 < b - a <= size for a, b in found)
    for (a, b), (c, d) in zip(found, found[1:], strict=False):
        assert a <= c <= b < d and (b - c <= size)
        assert overlap or c == b
    if found:
        assert found[0][0] == 0 and found[-1][1] == len(s)


def test_separators_in_order():
    rules = ChunkRules(size=20, overlap=0, least=1, separators=("\n## ", "\n\n", ". ", " "))
    assert split_text("aaaa bbbb\n## cccc dddd. eeee ffff gggg", rules) == ["aaaa bbbb", "## cccc dddd.", "eeee ffff gggg"]
    assert split_text("x" * 45, rules) == ["x" * 20, "x" * 20, "x" * 5]


def test_overlap_repeats_whole_pieces():
    rules = ChunkRules(size=20, overlap=6, least=1, separators=(" ",))
    assert split_text("aaaa bbbb cccc dddd eeee", rules) == ["aaaa bbbb cccc dddd", "cccc dddd eeee"]
    assert split_text("aaaaaaaaaaaaaaa bbbbbbbbbb", ChunkRules(size=18, overlap=4, least=1, separators=(" ",))) == ["aaaaaaaaaaaaaaa", "aaa bbbbbbbbbb"]


def test_short_documents_and_dropped_pieces():
    rules = ChunkRules()
    assert chunk_text("tiny", rules) == [{"text": "tiny", "heading": None, "heading_path": [], "kept": True}]
    assert chunk_text(" \n", rules) == [] and chunk_text(None, rules) == []
    got = chunk_text("# A\nshort\n# B\n" + "long enough " * 20, rules)
    assert [(x["kept"], x["heading"]) for x in got] == [(False, "A"), (True, "B")]
    with pytest.raises(ValueError):
        ChunkRules(size=100, overlap=100)


def docs(spark, rows):
    return spark.createDataFrame([(p, t, "T", p.split("/")[0], ["x"]) for p, t in rows], "source_path string, text string, title string, source string, tags array<string>")


def test_chunk_rows(spark):
    body = "# One\n" + "alpha beta. " * 100 + "\n# Two\nsmall\n# Three\n" + "gamma delta. " * 30
    out = chunk_documents(docs(spark, [("g/a.md", body), ("g/b.md", "")])).collect()
    kept = sorted((r for r in out if r.kept), key=lambda r: r.chunk_index)
    assert [r.chunk_index for r in kept] == list(range(len(kept))) and sum(not r.kept for r in out) == 1
    assert all(len(r.text) <= 800 and r.embed_text.startswith("T > ") for r in kept)
    assert kept[0].chunk_id == f"{kept[0].doc_id}:0000" and kept[-1].heading_path == "Three"
    assert len({r.point_id for r in kept}) == len(kept) and all(re.fullmatch(r"[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}", r.point_id) for r in kept)


def test_corpus_files(spark, tmp_path):
    for name, raw in {
        "guide/hybrid.md": b"---\ntitle: Hybrid\ntags: [a, b]\n---\n# H1\nbody", "notes/chunking.MD": b"# Chunking #\ntext", "top.txt": b"plain \xff", "notes/empty.md": b"---\ntitle: x\n---\n \n",
        "image.png": b"x", ".hidden.md": b"hidden", "a/.git/x.md": b"hidden", "README.md": b"out", "bad.md": b"---\n: [\n---\nbody",
    }.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(raw)
    got = {r.source_path: r for r in corpus.read_corpus(spark, str(tmp_path), exclude=("**/.*", "README.md")).collect()}
    assert set(got) == {"guide/hybrid.md", "notes/chunking.MD", "top.txt", "bad.md"}
    r = got["guide/hybrid.md"]
    assert (r.title, r.source, r.tags, r.text) == ("Hybrid", "guide", ["a", "b"], "# H1\nbody")
    assert got["notes/chunking.MD"].title == "Chunking" and got["top.txt"].source == "root" and got["top.txt"].title == "top" and got["top.txt"].text == "plain �"
    with pytest.raises(corpus.CorpusError):
        corpus.read_corpus(spark, str(tmp_path / "nowhere"))


def test_golden_files(spark, tmp_path):
    p = tmp_path / "g.jsonl"
    p.write_text('# note\n\n{"id":"a","question":"q","expected_source_paths":["./x\\\\y.md"],"filters":{"source":"s"}}\n{"id":"b","question":"r","expected_source_paths":[],"answerable":false,"category":"unanswerable"}\n')
    rows = {r.id: r for r in corpus.read_golden(spark, str(p)).collect()}
    assert rows["a"].expected_source_paths == ["x/y.md"] and rows["a"].answerable is None and rows["b"].answerable is False
    p.write_text('{"id":"a","question":"q"}\n')
    with pytest.raises(corpus.GoldenError):
        corpus.read_golden(spark, str(p))
    (tmp_path / "r.json").write_text('{"baseline":"b","items":{"a":{"target_rank":3,"mode":"dense"},"b":{"target_rank":"x"}}}')
    assert {r.id: r.target_rank for r in corpus.read_ranks(spark, str(tmp_path / "r.json")).collect()} == {"a": 3, "b": None}


def test_points_table_and_incremental_ingest(spark, tmp_path):
    t = PointsTable(spark, str(tmp_path / "points"))
    first = docs(spark, [("g/a.md", "word one. " * 150), ("h/b.md", "short text")])
    r = ingest.run_ingest(first, t, "r1")
    n = r.counters["chunks_built"]
    assert r.counters["points_upserted"] == n == t.count() and r.counters["documents_ingested"] == 2 and r.stats["document_count"] == n
    again = ingest.run_ingest(first, t, "r2").counters
    assert again["points_upserted"] == 0 and again["chunks_skipped_unchanged"] == n
    changed = docs(spark, [("g/a.md", "word one. " * 150), ("h/b.md", "short text, edited")])
    assert ingest.run_ingest(changed, t, "r3").counters["points_upserted"] == 1 and t.count() == n + 1  # the old point stays
    ingest.run_ingest(changed, t, "r4", incremental=False)
    assert t.count() == n + 1
    assert_embedder(t.read(), identity.HASH_MODEL)
    assert ingest.run_ingest(changed, None, "dry", dry_run=True).counters["points_upserted"] == 0
    with pytest.raises(CollectionMismatch):
        t.ensure(64)
    with pytest.raises(CollectionMismatch):
        t.upsert(t.read().selectExpr("* except (vector)", "array(1D) as vector"))
    with pytest.raises(CollectionMismatch):
        assert_embedder(t.read(), "other")
    assert t.ensure(32, recreate=True) and t.count() == 0
    assert not t.ensure(32)


def test_stream_equals_batch(spark, tmp_path):
    for i in range(3):
        docs(spark, [(f"s/{i}.md", f"text number {i} " * 40)]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    t = PointsTable(spark, str(tmp_path / "points"))
    t.ensure(32)
    for _ in range(2):
        ingest_stream(document_stream(spark, str(tmp_path / "in"), 1), t, str(tmp_path / "cp")).awaitTermination()
    want = ingest.points_of(chunk_documents(spark.read.parquet(str(tmp_path / "in"))), "x")
    assert {r.point_id for r in t.read().collect()} == {r.point_id for r in want.collect()} and t.count() == want.count()


def test_identity(spark):
    d = docs(spark, [("a", "x"), ("b", "y")])
    one = ingest.corpus_identity(d, ChunkRules())
    assert ingest.compatible(one, ingest.corpus_identity(d, ChunkRules(), root="r", collection="c"))
    assert not ingest.compatible(one, ingest.corpus_identity(d, ChunkRules(size=500)))
    assert ingest.cache_material(one).startswith('{"chunker_version":"structural-markdown-v1:size=800:overlap=120"')
