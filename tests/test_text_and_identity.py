import hashlib
import re
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvine.functions import identity as ident
from corvine.functions import text as tx


@pytest.fixture(scope="module")
def one(spark):
    def run(column, **values):
        row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'int' if isinstance(v, int) else 'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items()))
        return row.select(column).first()[0]

    return run


def test_pinned_term_index(one):
    assert one(ident.term_index(F.col("t")), t="qdrant") == 1990180345


@pytest.mark.parametrize(("text", "chunk", "prompt"), [("", 0, 1), ("a", 1, 1), ("abcd", 1, 2), ("abcde", 2, 2), ("x" * 800, 200, 201)])
def test_token_estimates(one, text, chunk, prompt):
    assert one(tx.chunk_token_estimate(F.col("t")), t=text) == chunk
    assert one(tx.prompt_token_estimate(F.col("t")), t=text) == prompt


def test_uuid_and_ids(one):
    name = "guide/a.md::3::" + "ab" * 32
    assert one(ident.uuid5(F.col("n")), n=name) == str(uuid.uuid5(uuid.NAMESPACE_URL, name))
    assert one(ident.doc_id(F.col("p")), p="guide/a.md") == hashlib.sha256(b"guide/a.md").hexdigest()[:16]
    assert one(ident.chunk_id(F.lit("d"), F.col("i")), i=12345) == "d:12345" and one(ident.chunk_id(F.lit("d"), F.col("i")), i=7) == "d:0007"


def test_hash_vector_bit_exact(one):
    text, raw = "hybrid search é", b""
    for i in range(4):
        raw += hashlib.sha256(i.to_bytes(4, "big") + text.encode()).digest()
    v = np.frombuffer(raw, ">u4").astype(float) / 2**31 - 1
    assert np.allclose(one(ident.hash_vector(F.col("t")), t=text), v / np.sqrt((v * v).sum()), rtol=0, atol=1e-15)


def test_search_terms(one):
    assert one(tx.search_terms(F.col("t")), t="Straße of BM25-k1 a.b_c, x-") == ["strasse", "bm25-k1", "a.b_c", "x"]
    assert one(tx.search_terms(F.col("t")), t="is it the of") == []
    assert one(tx.search_terms(F.col("t"), ()), t="is it") == ["is", "it"]


def test_uncited_claims(one):
    t = "This part is entirely made up. This one is cited, by position. [1] In short. Also cited here, inside it [2]."
    assert one(tx.uncited_claims(F.col("t")), t=t) == ["This part is entirely made up."]


@pytest.mark.parametrize(("s", "want"), [("It is so.", "It is so [3]."), ("Is it ?", "Is it [3]?"), ("no end", "no end [3].")])
def test_cite(one, s, want):
    assert one(tx.cite(F.col("s"), F.lit(3)), s=s) == want


def test_sentences_headings_tags_paths(one):
    assert one(tx.first_sentence(F.col("t")), t=" A b\n c!  Next. ") == "A b c!"
    assert one(tx.first_h1(F.col("t")), t="## no\n# \n#x\n# Yes it is ##\n# later") == "Yes it is"
    assert one(tx.first_h1(F.col("t")), t="nothing") is None
    assert one(tx.tag_list(F.col("t")), t=" a, b ,,c\t") == ["a", "b", "c"]
    assert one(tx.normal_path(F.col("t")), t="/././a\\b/./c.md") == "a/b/./c.md"
    assert one(tx.source_of(F.col("t")), t="a/b") == "a" and one(tx.source_of(F.col("t")), t="top.md") == "root"
    assert one(tx.without_comments(F.col("t")), t="a<!-- x\ny -->b") == "ab"


def test_embed_text(one):
    assert one(tx.embed_text(F.lit("x"), F.lit("T"), F.col("h")), h=["T", "A", "B"]) == "T > A > B\n\nx"
    assert one(tx.embed_text(F.lit("x"), F.lit(""), F.col("h")), h=[]) == "x"


def test_judge_and_question_words(one):
    assert sorted(one(tx.judge_words(F.col("t")), t="The k1 and b [1] of BM25 [23]")) == ["b", "bm25", "k1"]
    assert sorted(one(tx.question_terms(F.col("t")), t="What does this fusion do with ranks?")) == ["fusion", "ranks"]


def test_stream_pieces_are_lossless(one):
    for t in ("a  b c ", "", " x", "one"):
        assert "".join(one(tx.stream_pieces(F.col("t")), t=t)) == t


def test_corpus_hash(spark):
    rows = [("b.md", "two"), ("a.md", "öne")]
    want = hashlib.sha256()
    for p, t in sorted(rows):
        want.update(p.encode() + b"\0" + hashlib.sha256(t.encode()).hexdigest().encode() + b"\0")
    assert tuple(ident.corpus_hash(spark.createDataFrame(rows, "source_path string, text string")).first()) == (want.hexdigest(), 2)


def test_stopword_sizes():
    assert len(tx.SEARCH_STOPWORDS) == len(set(tx.SEARCH_STOPWORDS)) and re.fullmatch(tx.TERM, "bm25-k1")


def test_ids_do_not_depend_on_how_a_path_or_text_is_spelt(spark):
    rows = [("src/caf\u00e9.md", "na\u00efve"), ("./src\\cafe\u0301.md", "nai\u0308ve"), ("/src/caf\u00e9.md", "na\u00efve"), ("src/cafe.md", None)]
    df = spark.createDataFrame(rows, "path string, text string")
    sha = ident.sha256_text(F.col("text"))
    got = df.select(ident.doc_id(F.col("path")).alias("d"), sha.alias("s"), ident.point_id(F.col("path"), F.lit(0), sha).alias("p")).collect()
    assert got[0] == got[1] == got[2] and got[0].d != got[3].d and got[3].s is None
    assert got[0].d == hashlib.sha256("src/caf\u00e9.md".encode()).hexdigest()[:16] and got[0].s == hashlib.sha256("na\u00efve".encode()).hexdigest()
    assert got[0].p == str(uuid.uuid5(uuid.NAMESPACE_URL, f"src/caf\u00e9.md::0::{got[0].s}"))


def test_terms_follow_casefold(spark):
    """Every character of the basic plane, against Python's own caseless form."""
    chars = [chr(i) for i in range(1, 0x10000) if not 0xD800 <= i < 0xE000]
    df = spark.createDataFrame([(i, f"x{c}y") for i, c in enumerate(chars)], "i int, text string")
    got = dict(df.select("i", tx.search_terms(F.col("text"), ()).alias("t")).rdd.map(tuple).collect())
    bad = [hex(ord(c)) for i, c in enumerate(chars) if got[i] != re.findall(tx.TERM, f"x{c}y".casefold())]
    assert not bad


def test_an_upsert_keeps_one_row_for_each_id(spark):
    from corvine.sources.points import upserted

    old = spark.createDataFrame([("a", "old", 1), ("b", "old", 1)], "point_id string, text string, n int")
    new = spark.createDataFrame([("a", "new", 2), ("a", "new", 3), ("c", "x", 1), ("c", "x", 1)], "point_id string, text string, n int")
    assert sorted(map(tuple, upserted(old, new).collect())) == [("a", "new", 3), ("b", "old", 1), ("c", "x", 1)]
