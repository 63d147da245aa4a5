"""Every operator beside columns of odd names and kinds, those of its own output among them."""

import uuid

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from corvine.llm import chat_format, conversation_repair, decontaminate, embedding_dedup, jaccard_join, language_id, license_scan, mixing, quality, token_output, toxicity, url_filters
from corvine.runtime import scratch_root

OWN = "score predicted held_out lang_pred component_id n_shingles n_links kept rule verdict labels word words gram part block start terms place cutoff epochs tokens role_ audit cost repaired gone"


def odd(df):
    more = {"a.b": F.lit(1), "Copies": F.lit("c"), "with space": F.lit(None).cast("string"), "back`tick": F.lit(2.0), "a map": F.create_map(F.lit("k"), F.lit(1)), "__row": F.lit(3), "_h": F.lit(4)}
    more |= {n: F.lit("x") for n in OWN.split() if n not in df.columns}
    return df.withColumns(more)


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.createDataFrame([(i % 28, f"the {i} of and to that was {i} things in it, under the mit license", "en" if i % 2 else "de", f"src{i % 3}") for i in range(30)], "doc_id long, text string, lang string, source string")
    return {
        "documents": odd(docs), "labels": odd(spark.createDataFrame([(i, i % 2, i % 2) for i in range(28)], "doc_id long, quality int, toxic int")),
        "benchmark": odd(spark.createDataFrame([(1, "of and to that was 4 things in it")], "item_id long, text string")),
        "embeddings": odd(spark.createDataFrame([(i, [1.0, float(i % 3)], "l") for i in range(9)], "vec_id long, embedding array<double>, label string")),
        "pages": odd(spark.createDataFrame([(1, "http://a.net/x?y", "")], "page_id long, url string, html string")),
        "conversations": odd(spark.createDataFrame([(1, 0, "user", "Hi."), (1, 1, "assistant", "Ho.")], "conv_id long, turn long, role string, text string")),
    }


def blocks(spark, docs):
    path = f"{scratch_root(spark)}/odd-{uuid.uuid4().hex}"
    token_output.write_token_blocks(docs, path)
    return token_output.read_token_blocks(spark, path)


RUNS = {
    1: lambda s, t: (decontaminate.find_leaks(t["documents"], t["benchmark"]), None), 2: lambda s, t: (jaccard_join.jaccard_components(t["documents"]), None),
    3: lambda s, t: (mixing.mix(t["documents"]), None), 4: lambda s, t: (url_filters.judge_urls(t["pages"]), 1), 5: lambda s, t: (embedding_dedup.near_duplicates(t["embeddings"]), 9),
    6: lambda s, t: (license_scan.scan_licenses(t["documents"]), 30), 7: lambda s, t: (quality.score_documents(t["documents"], quality.fit(t["documents"])), 30),
    8: lambda s, t: (language_id.predict_languages(t["documents"], language_id.fit(t["documents"])), 30),
    9: lambda s, t: (toxicity.score_documents(t["documents"], toxicity.fit(t["documents"], t["labels"])), 30),
    10: lambda s, t: (chat_format.read_back(chat_format.format_conversations(t["conversations"])), 1),
    11: lambda s, t: (conversation_repair.repair_conversations(t["conversations"]), 1), 12: lambda s, t: (blocks(s, t["documents"]), 30),
}


@pytest.mark.parametrize("number", RUNS)
def test_operator(spark, tables, number):
    out, rows = RUNS[number](spark, tables)
    got = out.collect()
    assert len(got) == rows if rows else got
    if number == 3:
        assert out.columns == [c for c in tables["documents"].columns if c != "Copies"] + ["copies"]


def test_pipeline(spark, tables, tmp_path):
    for name in ("labels", "benchmark", "documents"):
        tables[name].write.parquet(str(tmp_path / f"{name}.parquet"))
    out = cp.run(spark, str(tmp_path))
    assert out.columns == [c for c in tables["documents"].columns if c != "Copies"] + ["copies"] and out.count() >= 0
    kept = cp.keep_one_of_each_group(spark, tables["documents"], str(tmp_path))
    assert kept.columns == tables["documents"].columns and sorted(r.doc_id for r in kept.collect()) == sorted({r.doc_id for r in kept.collect()})
