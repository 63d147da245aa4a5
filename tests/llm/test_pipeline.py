import zlib

import corpus_pipeline as cp
from corvine.llm import decontaminate, language_id, mixing, toxicity
from tests.llm.test_jaccard_join import brute as near_groups
from tests.llm.test_mixing import brute as mixed


def plain(spark, rows, labels, items):
    """The stages one after another over Python rows (doc_id, text, lang, source, n_chars)."""
    frame = lambda: spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    toxic = toxicity.fit(frame(), labels)
    rows = [r for r in rows if toxic is None or toxic.probability(r[1]) < 0.5]
    lang = language_id.fit(frame())
    rows = [r for r in rows if (p := lang.probabilities(r[1])) is not None and p.max() >= cp.LEAST_LANGUAGE_SCORE]
    root = {d: c for d, _, c in near_groups([r[:2] for r in rows], 5, 80)}
    rows = list({r[0]: r for r in rows if root[r[0]] == r[0]}.values())
    rows = [r for r in rows if not decontaminate.leaks_of(r[1], items)]
    copies = mixed([(r[0], r[2], r[3], r[1]) for r in rows], mixing.MixPlan())
    return sorted((*r, copies[r[0]]) for r in rows if r[0] in copies)


def test_run_matches_plain_version(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    want = plain(spark, rows, spark.read.parquet(f"{sf}/labels.parquet"), items)
    out = cp.run(spark, sf)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "copies"]
    assert sorted(tuple(r) for r in out.collect()) == want and len(want) > 300


def test_stages_keep_columns_and_odd_rows(spark, tmp_path):
    base = "ein Satz über viele Dinge in dieser Welt und noch mehr davon"
    rows = [(1, base, "de", "src0", "x"), (1, base, "de", "src0", "x"), (2, base + " Ende", None, None, "y"), (3, None, "de", "src1", None), (4, "", "de", "src1", None), (None, "the end of all the things that were here", "en", "src2", "z")]
    rows += [(10 + i, f"the {i} of and to that was {i} things in it", "en", "src1", "n") for i in range(20)]
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score string")
    for name, stage in cp.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != cp.STAGES[-1][0]:
            assert out.columns == docs.columns
        got = out.collect()
        if name == "n-gram Jaccard join":
            assert sum(r.doc_id == 1 for r in got) == 1
        if name == "language ID":
            assert {r.doc_id for r in got} == {r[0] for r in rows} - {3, 4}
    assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_rows_that_share_an_id_are_judged_one_by_one(spark, tmp_path):
    fine = "the end of all the things that were here and many more of them"
    rows = [(i, f"{fine} {'zzuglyzz' if i % 2 else 'w%d' % i}", "en", "src0", 1) for i in range(200)]
    rows += [(7000, fine + " zzuglyzz", "en", "src0", 2), (7000, fine + " w2 w4 w6 w8 w10 w12", "en", "src1", 3), (7000, fine, "en", "src1", 3), (7000, fine, "en", "src1", 3), (None, fine + " zzuglyzz", "en", "src0", 2), (None, "of all " + fine, "en", "src0", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, __gone long")
    spark.createDataFrame([(i, 1, i % 2) for i in range(200)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "w2 w4 w6 w8 w10 w12")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    at = lambda out: sorted((str(r.doc_id), r.text) for r in out.collect() if r.doc_id is None or r.doc_id == 7000)
    clean = cp.drop_toxic(spark, docs, str(tmp_path))
    assert clean.columns == docs.columns and at(clean) == [("7000", fine)] * 2 + [("7000", fine + " w2 w4 w6 w8 w10 w12"), ("None", "of all " + fine)]
    assert at(cp.drop_contaminated(spark, clean, str(tmp_path))) == [("7000", fine)] * 2 + [("None", "of all " + fine)]
    assert at(cp.keep_one_of_each_group(spark, clean.where("doc_id is null or doc_id = 7000"), str(tmp_path))) == [("7000", fine), ("None", "of all " + fine)]


def test_empty_corpus(spark, tmp_path):
    for t, s in (("documents", "doc_id long, text string, lang string, source string, n_chars long"), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], s).write.parquet(str(tmp_path / f"{t}.parquet"))
    assert cp.run(spark, str(tmp_path)).count() == 0


def test_language_stage_without_any_language_to_learn(spark):
    texts = ["a clean text about many things", "wörter", None, "", "123 ... !!!", "x"]
    unmarked = [(i, t, None, "src0", 1) for i, t in enumerate(texts)] + [(None, None, None, "src0", 1)]
    held = [(i, texts[0], "en", "src0", 1) for i in range(100, 140) if zlib.crc32(str(i).encode()) % 4 == 2]
    docs = spark.createDataFrame(unmarked + held, "doc_id long, text string, lang string, source string, n_chars long")
    out = cp.drop_unidentified(spark, docs, "")
    assert out.columns == docs.columns and sorted(map(str, (r.doc_id for r in out.collect()))) == sorted(map(str, [0, 1, 5, *(r[0] for r in held)])) and held
