import uuid
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corvine.llm import token_codec, token_output
from corvine.llm.token_codec import BlockError, decode_block, encode_block
from corvine.runtime import scratch_root


def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(token_output.default_vocabulary())


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 3000), st.integers(1, 70_000), st.integers(0, 2**31), st.integers(1, 300))
def test_round_trip(n, alphabet, seed, lane_ids):
    rng = np.random.default_rng(seed)
    ids = rng.integers(0, alphabet, n) // rng.integers(1, 9, n)
    before, token_codec.LANE_IDS = token_codec.LANE_IDS, lane_ids
    try:
        assert (decode_block(encode_block(ids)) == ids).all()
    finally:
        token_codec.LANE_IDS = before


@pytest.mark.parametrize("ids", [[], [0], [2**32 - 1], [7] * 100_000, list(range(49_408)), [2**32 - 1, 0, 2**20] * 9])
def test_round_trip_of_extremes(ids):
    assert decode_block(encode_block(np.array(ids, np.int64))).tolist() == ids


def test_statistics_pay():
    """Repeats of ids, of pairs and of triples each take fewer bits than ids of equal chance would."""
    rng = np.random.default_rng(3)
    skewed = np.minimum(rng.geometric(0.05, 60_000), 1000)
    phrases = rng.integers(0, 40_000, (50, 6))[rng.integers(0, 50, 10_000)].ravel()
    assert 8 * len(encode_block(skewed)) / 60_000 < 6.3
    assert 8 * len(encode_block(phrases)) / 60_000 < 2.5


def test_damage_is_told():
    good = bytearray(encode_block(np.arange(5000) % 77))
    for at in (0, 5, 9, 13, 17, 22, 27, 29, len(good) // 2, len(good) - 1):
        bad = bytearray(good)
        bad[at] ^= 4
        with pytest.raises(BlockError):
            decode_block(bytes(bad))
    with pytest.raises(BlockError):
        decode_block(bytes(good[:-4]))
    with pytest.raises(BlockError):
        decode_block(b"cvT1")


TEXTS = [
    None, "", " ", "Hello, World!  it's | 3|4 || x", "<|endoftext|> and a<|startoftext|>b <|endoftext|>.", "é ́x ÅÅ ΣΑΣ Σ. İstanbul ﬁne ß", "a b c\td\r\ne\x1cf\x85g",
    "don't we'll I'M x'S '' 's", "日本語 text… 😀👍🏽 !?", "end. End, END; end: end! end? .. ,", "\x00\x01 ﻿", "…. a. 1. a.. b!? c'", '" "a" b" "',
]


#: Every Latin letter alone, in words, with marks, and next to what is none.
LATIN = [" ".join(f"{chr(c)} a{chr(c)}Z{chr(c).upper()} {chr(c)}. {chr(c)}!? {chr(c)}'s {chr(c)}9" for c in range(192, 256)), "ABC abc. d, e; f: g! h? i.. 'j k' l-m"]


def split(ids, counts):
    return [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]


def test_pieces_give_the_ids_of_whole_texts():
    t, pieces = library(), token_output.PieceTokenizer(token_output.default_vocabulary())
    for texts in (TEXTS, TEXTS[::-1], [" ".join(x or "" for x in TEXTS) * 50], LATIN):
        assert split(*pieces(pa.array(texts, pa.string()))) == [t.encode(text or "", add_special_tokens=False).ids for text in texts]
    assert split(*pieces(pa.array(["x", *TEXTS], pa.string()).slice(1, 4))) == [t.encode(text or "", add_special_tokens=False).ids for text in TEXTS[:4]]


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_pieces_of_any_text(text):
    pieces = token_output._tokenizer(token_output.default_vocabulary())
    assert split(*pieces(pa.array([text]))) == [pieces.tokenizer.encode(text, add_special_tokens=False).ids]


def test_bounded_memory_of_pieces(monkeypatch):
    monkeypatch.setattr(token_output, "REMEMBERED", 40)
    t, pieces = library(), token_output.PieceTokenizer(token_output.default_vocabulary())
    for k in range(12):
        text = " ".join(f"w{chr(97 + k)}{chr(97 + i)} same." for i in range(15))
        assert split(*pieces(pa.array([text]))) == [t.encode(text, add_special_tokens=False).ids]
        assert len(pieces.known) <= 80


def expected(rows):
    t = library()
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    out, start = [], 0
    for i, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4")), ids))
        start += len(ids)
    return out


@pytest.mark.parametrize("block_ids", [1, 100, 1 << 20])
def test_files_read_back(spark, block_ids):
    rows = [(37 * k % 101, TEXTS[k % len(TEXTS)]) for k in range(101)] + [(-5, "long text. " * 30_000), (None, "first of all")]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, start int, `part.x` string")
    path = f"{scratch_root(spark)}/blocks-{uuid.uuid4().hex}"
    token_output.write_token_blocks(docs, path, block_ids=block_ids)
    want = expected(rows)
    got = sorted(token_output.read_token_blocks(spark, path).collect(), key=lambda r: r.start)
    assert [(r.doc_id, r.start, r.n_tokens, r.ids) for r in got] == [(*w[:3], w[4]) for w in want]
    got = sorted(token_output.read_token_blocks(spark, path, digest_only=True).collect(), key=lambda r: r.start)
    assert [tuple(r) for r in got] == [w[:4] for w in want]
    assert spark.read.parquet(path).where("n_tokens > 400").count() >= 1


def test_repeated_documents_and_empty_table(spark):
    rows = [(4, "same")] * 5 + [(4, "other"), (3, None)]
    path = f"{scratch_root(spark)}/blocks-{uuid.uuid4().hex}"
    token_output.write_token_blocks(spark.createDataFrame(rows, "doc_id long, text string"), path)
    got = token_output.read_token_blocks(spark, path).collect()
    assert sorted((r.doc_id, tuple(r.ids)) for r in got) == sorted((w[0], tuple(w[4])) for w in expected(rows))
    starts = sorted((r.start, r.n_tokens) for r in got)
    assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:], strict=False)) and starts[0][0] == 0
    path += "-none"
    token_output.write_token_blocks(spark.createDataFrame([], "doc_id long, text string"), path)
    assert token_output.read_token_blocks(spark, path).count() == 0
