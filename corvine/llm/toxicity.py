"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the average of the vectors of its character 3- to 5-grams (with word edges). A document's bag is the
average of its ``TOP`` distinct words that speak most for the toxic class, and a linear softmax over the bag gives
the score, so neither a long clean text nor much repetition hides or makes toxicity. A misspelt or never seen
word shares n-grams with known ones and so their vectors.

Vectors and softmax start at random in all ``DIM`` dimensions and are trained together by Adagrad on the
cross-entropy. A first phase has bags of one word, drawn from each document, under the document's label. Then
rounds follow: the executors pick every training document's bag under the model so far, reading whole texts, and
the driver trains on the bags (earlier bags of clean documents stay as hard negatives). What comes to the driver
is ``FIRST_WORDS`` or ``TOP`` words a document, so its memory is bounded whatever the length of the texts.

Training rows are bounded: ``TRAIN_ROWS`` of each label.

Defined results: null and empty texts, and texts without words, have an empty bag and score as the bias alone
says; without usable labels of both kinds every score is 0.0; repeated rows are scored one by one; labels that
repeat for a document count as 1 if any is 1; an empty table gives no rows; extra columns are ignored; texts of
any length are read whole, both in training and in scoring.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvine.llm.sampling import crc_mod, labelled_sample, trainable
from corvine.runtime import drop_materialized, give_back, materialize, slices

BUCKETS, DIM, TOP, NGRAMS = 1 << 17, 16, 4, (3, 4, 5)
TRAIN_ROWS = {1: 2000, 0: 4000}
#: Words of a document in the first phase; rounds of picking bags; epochs of the first phase and of each round.
FIRST_WORDS, ROUNDS, FIRST_EPOCHS, EPOCHS = 96, 5, 4, 8
#: Learning rate, penalty and batch; chosen, like the start's width, on an inner fold of training rows (crc32 mod 5 = 1).
RATE, DECAY, BATCH = 0.25, 1e-5, 4096
CACHE = 120_000
_WORD = re.compile(r"\w+")


def words_of(text: str | None) -> list[str]:
    """Distinct words of a text."""
    return list(set(_WORD.findall(text.lower()))) if text else []


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and word position of every n-gram of ``<word>``, for all words in one vectorised pass."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    marked = "<" + "><".join(words) + ">"
    codes = np.frombuffer(marked.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    owner = np.repeat(np.arange(len(words)), lengths)
    buckets, owners = [], []
    for n in NGRAMS:
        if len(codes) < n:
            continue
        h = np.full(len(codes) - n + 1, n, np.uint64)
        for k in range(n):
            h = (h ^ codes[k : len(codes) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        inside = owner[: len(h)] == owner[n - 1 :]
        buckets.append((h[inside] >> np.uint64(32)).astype(np.int64) % BUCKETS)
        owners.append(owner[: len(h)][inside])
    return np.concatenate(buckets), np.concatenate(owners)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


@dataclass
class ToxicModel:
    vectors: np.ndarray  # BUCKETS x DIM
    weights: np.ndarray  # DIM x 2
    bias: np.ndarray  # 2

    def word_vectors(self, words: list[str]) -> np.ndarray:
        out = np.zeros((len(words), DIM))
        b, o = subwords(words)
        np.add.at(out, o, self.vectors[b])
        return out / np.maximum(np.bincount(o, minlength=len(words)), 1)[:, None]

    def probability(self, text: str | None) -> float:
        """The score of one text, step by step as defined: word vectors, the bag of the most toxic words, softmax."""
        words = words_of(text)
        v = self.word_vectors(words)
        z = v @ self.weights
        bag = v[np.argsort(z[:, 0] - z[:, 1])[:TOP]].sum(0) / TOP
        return float(softmax(bag @ self.weights + self.bias)[1])

    def scorer(self) -> WordScorer:
        return WordScorer((self.vectors @ (self.weights[:, 1] - self.weights[:, 0])).astype(np.float32), float(self.bias[1] - self.bias[0]))


@dataclass
class WordScorer:
    """What scoring needs of a model: averages and softmax are linear up to the last step, so each n-gram's vector
    enters only by its product with the difference of the two softmax columns."""

    gain: np.ndarray
    bias: float

    def word_scores(self, words: list[str]) -> np.ndarray:
        b, o = subwords(words)
        return np.bincount(o, self.gain[b], len(words)) / np.maximum(np.bincount(o, minlength=len(words)), 1) / TOP

    def highest(self, scores: np.ndarray) -> float:
        """Log-odds of a document from the scores of its distinct words."""
        return float((scores if len(scores) <= TOP else -np.partition(-scores, TOP)[:TOP]).sum()) + self.bias

    def __call__(self, texts: list[str | None], cache: dict[str, float]) -> Iterator[tuple[list[str], np.ndarray]]:
        """Distinct words and their scores, for each text."""
        for t in texts:
            words = words_of(t)
            if len(cache) > CACHE:
                cache.clear()
            new = [w for w in words if w not in cache]
            if new:
                cache.update(zip(new, self.word_scores(new).tolist(), strict=True))
            yield words, np.fromiter(map(cache.__getitem__, words), np.float64, len(words))


class _Bags:
    """Bags of words under labels, with the n-grams of each distinct word once."""

    def __init__(self, labels: np.ndarray, word: np.ndarray, sizes: np.ndarray, names: pa.Array, share: float):
        self.label, self.word, self.share = labels, word, share
        self.start, parts, counts = np.concatenate(([0], np.cumsum(sizes))), [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for k in range(0, len(names), 10_000):  # in parts, for names and hashes need room
            some = names.slice(k, 10_000).to_pylist()
            b, o = subwords(some)
            parts.append(b[np.argsort(o, kind="stable")].astype(np.int32))
            counts.append(np.bincount(o, minlength=len(some)))
        self.buckets, self.count = np.concatenate(parts), np.concatenate(counts)
        self.first = np.concatenate(([0], np.cumsum(self.count)))

    @classmethod
    def of(cls, bags: list[list[str]], labels: list[int], share: float) -> _Bags:
        words = pa.array([w for b in bags for w in b], pa.string()).dictionary_encode()
        return cls(np.array(labels, np.int64), words.indices.to_numpy(), np.fromiter(map(len, bags), np.int64, len(bags)), words.dictionary, share)

    def grams(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bucket, bag (position in ``rows``) and weight of every n-gram of the given bags."""
        n = self.start[rows + 1] - self.start[rows]
        at = np.repeat(self.start[rows] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        w, bag = self.word[at], np.repeat(np.arange(len(rows)), n)
        c = self.count[w]
        flat = np.repeat(self.first[w] - np.concatenate(([0], np.cumsum(c)[:-1])), c) + np.arange(c.sum())
        return self.buckets[flat], np.repeat(bag, c), np.repeat(self.share / np.maximum(c, 1), c).astype(np.float32)


class Trainer:
    def __init__(self, seed: int):
        self.rng = np.random.default_rng(seed)
        self.vectors = self.rng.uniform(-1, 1, (BUCKETS, DIM)).astype(np.float32) * 2 / DIM
        self.weights = self.rng.normal(0, 1, (DIM, 2)).astype(np.float32)
        self.bias = np.zeros(2, np.float32)
        self.sums = [np.full(BUCKETS, 1e-6, np.float32), np.full((DIM, 2), 1e-3, np.float32), np.full(2, 1e-3, np.float32)]

    def model(self) -> ToxicModel:
        return ToxicModel(self.vectors.copy(), self.weights.copy(), self.bias.copy())

    def run(self, bags: _Bags, weight: np.ndarray, epochs: int, batch: int) -> None:
        """Epochs of Adagrad over the bags; a vector's squared gradients are summed over its dimensions."""
        for _ in range(epochs):
            order = self.rng.permutation(len(bags.label))
            for rows in np.array_split(order, max(1, -(-len(order) // batch))):
                self._step(bags, rows, weight[rows])

    def _step(self, bags: _Bags, rows: np.ndarray, weight: np.ndarray) -> None:
        b, bag, share = bags.grams(rows)
        mean = np.zeros((len(rows), DIM), np.float32)
        if len(b):
            edges = np.flatnonzero(np.diff(bag, prepend=-1))
            mean[bag[edges]] = np.add.reduceat(self.vectors[b] * share[:, None], edges)
        p = softmax(mean @ self.weights + self.bias)
        p[np.arange(len(rows)), bags.label[rows]] -= 1
        p *= weight[:, None]
        back = p @ self.weights.T
        grads = [(self.weights, mean.T @ p, 1), (self.bias, p.sum(0), 2)]
        if len(b):
            order = np.argsort(b, kind="stable")
            edges = np.flatnonzero(np.diff(b[order], prepend=-1))
            g = np.add.reduceat(back[bag[order]] * share[order, None], edges)
            own = b[order][edges]
            g += DECAY * self.vectors[own]
            self.sums[0][own] += (g * g).mean(1)
            self.vectors[own] -= RATE * g / np.sqrt(self.sums[0][own])[:, None]
        for value, g, k in grads:
            self.sums[k] += g * g
            value -= 0.1 * RATE * g / np.sqrt(self.sums[k])


def train(words: pa.Table, pick: Callable[[WordScorer], list[tuple[int, list[str]]]], seed: int = 11) -> ToxicModel | None:
    """``words`` has toxic, word and n, the documents it was drawn from, sorted; ``pick`` gives (label, bag) of every
    training document under the model so far."""
    labels, n = words["toxic"].to_numpy(), words["n"].to_numpy()
    if not len(labels) or labels.min() == labels.max():
        return None
    t = Trainer(seed)
    # each distinct word once for each label, weighted by its documents; both labels weigh the same
    weight = n / np.where(labels == 1, n[labels == 1].sum(), n[labels == 0].sum())
    single = np.arange(len(n))
    t.run(_Bags(labels, single, np.ones(len(n), np.int64), words["word"].combine_chunks(), 1.0 / TOP), (weight * len(n) / 2).astype(np.float32), FIRST_EPOCHS, BATCH)
    clean: list[list[str]] = []
    for _ in range(ROUNDS):
        picked = pick(t.model().scorer())
        toxic = [w for y, w in picked if y]
        clean += [w for y, w in picked if not y]
        clean = [list(w) for w in dict.fromkeys(map(tuple, clean))]
        bags = _Bags.of(toxic + clean, [1] * len(toxic) + [0] * len(clean), 1.0 / TOP)
        t.run(bags, np.ones(len(bags.label), np.float32), EPOCHS, 256)
    return t.model()


def train_on(rows: list[tuple[int, str]]) -> ToxicModel | None:
    """:func:`train` on rows (label, text) at hand."""
    held: Counter = Counter()
    for k, (y, t) in enumerate(rows):
        held.update((y, w) for w in drawn(t, k))
    table = pa.table({"toxic": pa.array([y for y, _ in held], pa.int32()), "word": pa.array([w for _, w in held], pa.string()), "n": pa.array(list(held.values()), pa.int64())})
    return train(table.sort_by([("word", "ascending"), ("toxic", "ascending")]), lambda scorer: [(y, w) for (y, _), w in zip(rows, picked(scorer, [t for _, t in rows]), strict=True)])


def drawn(text: str | None, seed: int) -> list[str]:
    """At most ``FIRST_WORDS`` of a text's distinct words."""
    words = sorted(words_of(text))
    return words if len(words) <= FIRST_WORDS else [words[i] for i in np.random.default_rng(abs(seed)).choice(len(words), FIRST_WORDS, False)]


def picked(scorer: WordScorer, texts: list[str | None]) -> Iterator[list[str]]:
    """Each text's bag: its ``TOP`` most toxic words."""
    for words, scores in scorer(texts, {}):
        yield sorted(words[i] for i in (np.argpartition(-scores, TOP)[:TOP] if len(words) > TOP else range(len(words))))


def _word_batches(choose: Callable[[pa.RecordBatch], Iterable[list[str]]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(list(choose(batch)), pa.list_(pa.string())), batch.column("_h")], ["toxic", "words", "_h"])

    return run


def fit(documents: DataFrame, labels: DataFrame, held_out_mod: int = 5) -> ToxicModel | None:
    """Learn from labelled documents whose crc32(doc_id) mod ``held_out_mod`` is not 0."""
    marks = labels.where(F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    marks = marks.where(crc_mod(F.col("doc_id"), held_out_mod) != 0)
    there = documents.where(trainable(F.col("text"))).select("doc_id").distinct().join(marks, "doc_id")
    rows = materialize(labelled_sample(documents, there, "toxic", TRAIN_ROWS), "toxic-sample")
    schema = "toxic int, words array<string>, _h long"
    texts = lambda batch: [t.as_py() for t in batch.column("text")]
    first = rows.mapInArrow(_word_batches(lambda b: map(drawn, texts(b), b.column("_h").to_pylist())), schema)
    first = first.select("toxic", F.explode("words").alias("word")).groupBy("toxic", "word").agg(F.count("*").alias("n")).toArrow()

    def pick(scorer: WordScorer) -> list[tuple[int, list[str]]]:
        got = rows.mapInArrow(_word_batches(lambda b: picked(scorer, texts(b))), schema).toArrow().sort_by([("_h", "ascending"), ("toxic", "ascending")])
        return list(zip(got["toxic"].to_pylist(), got["words"].to_pylist(), strict=True))

    try:
        return train(first.sort_by([("word", "ascending"), ("toxic", "ascending")]), pick)
    finally:
        drop_materialized(rows)
        give_back()


def _score_batches(scorer: WordScorer | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, float] = {}
        for batch in slices(batches):
            out = np.zeros(batch.num_rows)
            if scorer is not None:
                texts = (t.as_py() for t in batch.column("text"))
                for k, (_, s) in enumerate(scorer(texts, cache)):
                    out[k] = 1 / (1 + np.exp(-scorer.highest(s)))
            names = [n for n in batch.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in names], pa.array(out)], [*names, "score"])

    return run


def score_documents(documents: DataFrame, model: ToxicModel | None, held_out_mod: int = 5) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    docs = documents.select("doc_id", (crc_mod(F.col("doc_id"), held_out_mod) == 0).alias("held_out"), F.col("text").cast("string").alias("text"))
    scored = docs.mapInArrow(_score_batches(model and model.scorer()), f"doc_id {kind}, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
