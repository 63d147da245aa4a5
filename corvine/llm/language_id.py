"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

Texts are lower-cased, every run of non-letters becomes one space, and 1- to 3-grams of characters are
hashed into ``BUCKETS``. Inverse document frequencies are counted over all training documents. Training
is follow-the-regularised-leader with elastic-net penalties on a bounded sample of training documents
(``PER_LANG`` of each language, whole texts); a fifth of the sample is kept apart to calibrate the softmax
temperature. The executors count n-grams, and of a training text only its counts (at most ``BUCKETS``) come to
the driver. Texts of any length are read whole, in pieces that share no state but the last two characters.

Defined results: null texts and texts without letters are ``und`` with score 0.0; without any training
language everything is ``und``; equal scores go to the alphabetically first language; repeated rows are
predicted one by one; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvine.llm.sampling import crc_mod, labelled_sample, trainable
from corvine.runtime import give_back, slices

BUCKETS, PER_LANG, EPOCHS = 1 << 15, 600, 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 2e-3, 1e-3
#: Very long texts are counted in pieces of so many characters, so memory stays bounded; the counts do not depend on it.
PIECE = 1 << 20
_LETTER = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
_SPACE = np.array([32], np.uint32)


def counts(text: str | None) -> np.ndarray | None:
    """Hashed n-gram counts of a whole text; None if it has no letter."""
    if not text:
        return None
    text, out, tail, inside = text.lower(), None, _SPACE, False
    for at in range(0, len(text), PIECE):
        codes = np.frombuffer(text[at : at + PIECE].encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = _LETTER[codes]
        keep = letter.copy()
        keep[1:] |= letter[:-1]  # the first of a run of non-letters
        keep[0] |= inside
        inside = bool(letter[-1])
        if keep.any():
            out, tail = _add(out, tail, np.where(letter, codes, np.uint32(32))[keep])
    if out is None:
        return None
    return _add(out, tail, _SPACE)[0] if inside else out


def _add(out: np.ndarray | None, tail: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts with the n-grams that end in ``new``, and the last two characters; ``tail``: those before."""
    if out is None:  # the space before the first word
        out, tail = np.zeros(BUCKETS, np.int64), tail[:0]
        new = np.concatenate((_SPACE, new))
    c = np.concatenate((tail, new))
    a, b, d = c * np.uint32(0x9E3779B1), c * np.uint32(0x85EBCA77), c * np.uint32(0xC2B2AE3D)
    two = a[:-1] ^ (b[1:] + np.uint32(0x27D4EB2F))
    for g, n in ((a, 1), (two, 2), ((two[:-1] * np.uint32(5)) ^ d[2:], 3)):
        g = g[max(0, len(tail) - n + 1) :]
        g = g ^ (g >> np.uint32(15))
        out += np.bincount((g * np.uint32(0x2C1B3C6D)) >> np.uint32(17), minlength=BUCKETS)
    return out, c[-2:]


@dataclass
class LanguageModel:
    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray  # BUCKETS x languages
    temperature: float = 1.0

    def weighted(self, i: np.ndarray, n: np.ndarray) -> np.ndarray:
        """TF-IDF of buckets ``i`` with counts ``n``, of length 1."""
        x = (1 + np.log(n)) * self.idf[i]
        return x / max(np.sqrt(x @ x), 1e-12)

    def probabilities(self, text: str | None) -> np.ndarray | None:
        if not self.langs or (n := counts(text)) is None:
            return None
        i = np.flatnonzero(n)
        return softmax((self.weighted(i, n[i]) @ self.weights[i]) / self.temperature)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def _ftrl_weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def train(rows: list[tuple[str, np.ndarray, np.ndarray]], idf: np.ndarray, seed: int = 5) -> LanguageModel:
    """``rows``: language, buckets and counts of a text."""
    langs = sorted({y for y, _, _ in rows})
    model = LanguageModel(langs, idf, np.zeros((BUCKETS, max(1, len(langs)))))
    data = [(langs.index(y), i, model.weighted(i, n)) for y, i, n in rows]
    if not data:
        return LanguageModel([], idf, model.weights)
    rng = np.random.default_rng(seed)
    mark = rng.permutation(len(data))
    kept, learn = mark[: len(data) // 5], mark[len(data) // 5 :]
    z, n = np.zeros_like(model.weights), np.zeros_like(model.weights)
    for _ in range(EPOCHS):
        for k in rng.permutation(learn):
            y, i, x = data[k]
            w = _ftrl_weights(z[i], n[i])
            p = softmax(x @ w)
            p[y] -= 1
            g = x[:, None] * p
            z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA * w
            n[i] += g * g
    model.weights = _ftrl_weights(z, n)
    if len(kept):
        logits = np.array([x @ model.weights[i] for _, i, x in (data[k] for k in kept)])
        ys = np.array([data[k][0] for k in kept])
        loss = lambda t: -np.mean(np.log(softmax(logits / t)[np.arange(len(ys)), ys] + 1e-12))
        model.temperature = float(min(np.geomspace(0.25, 8, 100), key=loss))
    return model


def _df_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, docs = np.zeros(BUCKETS, np.int64), 0
    for batch in slices(batches):
        for t in batch.column(0):
            if (n := counts(t.as_py())) is not None:
                total += n > 0
                docs += 1
    i = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(i, -1), pa.int32()), pa.array(np.append(total[i], docs), pa.int64())], ["bucket", "n"])


def inverse_frequencies(texts: DataFrame) -> np.ndarray:
    """Over all given texts; at most ``BUCKETS`` + 1 sums come to the driver."""
    sums = texts.select(F.col("text").cast("string").alias("text")).mapInArrow(_df_batches, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    df, docs = np.zeros(BUCKETS), 0
    for r in sums:
        if r["bucket"] < 0:
            docs = r["n"]
        else:
            df[r["bucket"]] = r["n"]
    return np.log((1 + docs) / (1 + df)) + 1


def _gram_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = pa.list_(pa.int32()), pa.list_(pa.int64())
    for batch in slices(batches, 100):
        n = [counts(t.as_py()) for t in batch.column("text")]
        i = [None if c is None else np.flatnonzero(c) for c in n]
        yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(i, kinds[0]), pa.array([None if k is None else c[k] for k, c in zip(i, n, strict=True)], kinds[1]), batch.column("_h")], ["lang", "i", "n", "_h"])


def fit(documents: DataFrame, mod: int = 4, held: int = 2) -> LanguageModel:
    """Learn from documents with a language whose crc32(doc_id) mod ``mod`` is not ``held``."""
    own = documents.select("doc_id", "text", F.col("lang").cast("string").alias("lang")).where(F.col("lang").isNotNull() & (crc_mod(F.col("doc_id"), mod) != held))
    sample = labelled_sample(own, own.where(trainable(F.col("text"))).select("doc_id", "lang"), "lang", PER_LANG)
    got = sample.mapInArrow(_gram_batches, "lang string, i array<int>, n array<long>, _h long").where("i is not null").toArrow().sort_by([("_h", "ascending"), ("lang", "ascending")])
    rows = [(y.as_py(), i.values.to_numpy(), n.values.to_numpy()) for y, i, n in zip(got["lang"], got["i"], got["n"], strict=True)]
    model = train(rows, inverse_frequencies(own))
    del got, rows
    give_back()
    return model


def _letterless_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        gone = pa.array([counts(t.as_py()) is None for t in batch.column("text")], pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").filter(gone)], ["doc_id"])


def without_letters(documents: DataFrame) -> DataFrame:
    """doc_id of every document whose text is null or has no letter."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(_letterless_batches, f"doc_id {kind}")


def _predict_batches(model: LanguageModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            langs, scores = [], np.zeros(batch.num_rows)
            for k, t in enumerate(batch.column("text")):
                p = model.probabilities(t.as_py())
                langs.append("und" if p is None else model.langs[int(np.argmax(p))])
                scores[k] = 0.0 if p is None else float(p.max())
            rest = [n for n in batch.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in rest], pa.array(langs, pa.string()), pa.array(scores)], [*rest, "lang_pred", "score"])

    return run


def predict_languages(documents: DataFrame, model: LanguageModel, mod: int = 4, held: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every document."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    docs = documents.select("doc_id", (crc_mod(F.col("doc_id"), mod) == held).alias("held_out"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_predict_batches(model), f"doc_id {kind}, held_out boolean, lang_pred string, score double")
