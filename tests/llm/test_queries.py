"""Every query runs over its whole table and returns the columns it promises."""

import pytest

from corvine.llm.oracles import ORACLES
from corvine.llm.queries import QUERIES

#: query -> (table, one row for each of its rows, columns and types)
PROMISED = {
    "op2_jaccard_join": ("documents", "doc_id bigint, n_shingles bigint, component_id bigint"),
    "op4_url_filters": ("pages", "page_id bigint, host string, path string, rule string, verdict string"),
    "op5_embedding_dedup": ("embeddings", "vec_id bigint, n_links bigint, component_id bigint, kept boolean"),
    "op6_license_scan": ("documents", "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double"),
    "op7_quality": ("documents", "doc_id bigint, score double, kept boolean"),
    "op8_language_id": ("documents", "doc_id bigint, held_out boolean, lang_pred string, score double"),
    "op12_token_output": ("documents", "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"),
    "op9_toxicity": ("documents", "doc_id bigint, held_out boolean, score double, predicted int"),
}


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 13)) and set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", PROMISED)
def test_rows_and_columns(spark, sf_dir, name):
    table, columns = PROMISED[name]
    out = QUERIES[name](spark, sf_dir)
    kinds = dict(out.dtypes)
    assert all(kinds[c.split()[0]] == c.split()[1] for c in columns.split(", "))
    assert out.count() == spark.read.parquet(f"{sf_dir}/{table}.parquet").count()


def test_repair_returns_every_conversation(spark, sf_dir):
    out = QUERIES["op11_conversation_repair"](spark, sf_dir)
    kinds = dict(out.dtypes)
    assert all(kinds[c] == "bigint" for c in ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost")) and kinds["audit"] == kinds["repaired_sha256"] == "string"
    assert out.count() == spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id").distinct().count()


def test_contaminated_pairs_hold_their_items(spark):
    sf = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    items = {r.item_id: r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    got = {(r.doc_id, r.item_id) for r in QUERIES["op1_decontamination"](spark, sf).collect()}
    assert {(d, i) for i, t in items.items() for d, x in docs.items() if t in x} <= got and len(got) < 60


def test_mixing_follows_weights(spark):
    """Spent tokens by domain stand to the weights unless a domain has no more."""
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet").selectExpr("doc_id", "source", "size(split(trim(text), '[ \\t\\n\\r\\f\\x0B]+')) as n")
    out = QUERIES["op3_mixing"](spark, sf).drop("source").join(docs, "doc_id")
    spent = {r[0]: r[1] for r in out.selectExpr("case when int(substr(source, 4)) < 10 then 'web' when int(substr(source, 4)) < 15 then 'reference' else 'forum' end as d", "n * copies as t").groupBy("d").sum("t").collect()}
    total = docs.agg({"n": "sum"}).first()[0]
    assert abs(sum(spent.values()) / total - 0.8) < 0.01
    assert abs(spent["reference"] / spent["forum"] - 1.5) < 0.05 or spent["reference"] >= 0.99 * 2 * docs.where("int(substr(source, 4)) between 10 and 14").agg({"n": "sum"}).first()[0]
