"""Quality classifier: a weak-label model and a hashed linear scorer.

Ten heuristic labellers vote good, bad or abstain on every whole text. How often each vote pattern occurs
is counted over all documents (there are at most 3^10 patterns), and expectation-maximisation over those
counts estimates every labeller's accuracy and the posterior of each pattern, without any gold label. The
posteriors of a bounded sample (``TRAIN_ROWS`` of likely good and of likely bad documents, whole texts) train a
logistic scorer on hashed words and word shapes; it scores whole texts. Of a training text only its posterior and
its bucket counts come to the driver.

Defined results: null and empty texts, and texts without words, have score 0.0 and are not kept; if all
documents get the same likely label, the posterior itself is the score; repeated rows are scored one by one;
an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvine.llm.sampling import labelled_sample, trainable
from corvine.runtime import drop_materialized, give_back, materialize, slices

BITS, EPOCHS, RATE, PENALTY, CACHE = 18, 6, 4.0, 1e-6, 120_000
TRAIN_ROWS = {1: 2000, 0: 2000}
SYMBOLS = b"#*%$&|<>{}[]=~^\\_@"
STOP = frozenset(
    "the of and to in is that for it was on be with as by at this from or are an a le la les de des et en un une que qui dans pour pas sur est du au "
    "der die das und ist zu mit von den auf für ein eine nicht el los las y por con del se al su como más".split()
)
NAMES = ("symbols", "capitals", "function words", "repeated word", "repeated lines", "line ends", "word length", "length", "punctuation", "stutter")


def _vote(_: float, bad: bool, good: bool) -> int:
    return 0 if bad else 1 if good else 2


def votes(text: str | None) -> str:
    """One digit for each labeller: 0 bad, 1 good, 2 abstains. Shares say little on short texts, where most abstain."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return "0" * len(NAMES)
    n, h = len(words), np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    solid = len(raw) - h[9:14].sum() - h[32]
    symbols, upper = h[list(SYMBOLS)].sum() / solid, h[65:91].sum()
    letters = upper + h[97:123].sum() + h[0xC2:].sum()
    lower = [w.strip(b".,;:!?").decode("utf-8", "replace").lower() for w in words]
    stop = sum(map(STOP.__contains__, lower)) / n
    stutter = sum(map(str.__eq__, lower, lower[1:])) / n
    top = Counter(lower).most_common(1)[0][1] / n
    lines = [x for x in raw.split(b"\n") if x.strip()]
    again, ends = 1 - len(set(lines)) / len(lines), sum(x.rstrip()[-1:] in b".!?" for x in lines) / len(lines)
    mean = (solid - h[0x80:0xC0].sum()) / n
    points = h[list(b".,;:!?")].sum() / solid
    caps = upper / max(1, letters)
    return "".join(map(str, (
        _vote(symbols, symbols > 0.05, symbols < 0.01), _vote(caps, caps > 0.3, caps < 0.12), _vote(stop, n >= 20 and stop < 0.06, n >= 20 and stop > 0.14),
        _vote(top, n >= 20 and top > 0.2, n >= 20 and top < 0.12), _vote(again, len(lines) > 2 and again > 0.3, len(lines) > 2 and again < 0.1),
        _vote(ends, len(lines) > 2 and ends < 0.5, len(lines) > 2 and ends > 0.85),
        _vote(mean, n >= 20 and (mean > 6.8 or mean < 2.5), n >= 20 and 3 < mean < 6.2), _vote(n, n < 3, n >= 40),
        _vote(points, n >= 20 and (points > 0.12 or points < 0.004), n >= 20 and 0.01 < points < 0.07),
        _vote(stutter, n >= 8 and stutter > 0.1, n >= 8 and stutter < 0.03),
    )))


@dataclass
class LabelModel:
    """``table[c, k, v]``: probability that labeller k, if it votes, votes v on a document of class c.

    Abstentions carry no evidence: they have probability 1 in either class."""

    prior: float
    table: np.ndarray

    def posterior(self, pattern: str) -> float:
        v = np.fromiter(map(int, pattern), int)
        k = np.arange(len(v))
        z = np.log(self.table[:, k, v]).sum(1) + np.log([1 - self.prior, self.prior])
        return float(1 / (1 + np.exp(np.clip(z[0] - z[1], -50, 50))))


def fit_labellers(patterns: dict[str, int], rounds: int = 60) -> LabelModel:
    """Expectation-maximisation over pattern counts, from majority votes, with add-one smoothing."""
    k = len(NAMES)
    if not patterns:
        return LabelModel(0.5, np.ones((2, k, 3)))
    v = np.array([list(map(int, p)) for p in patterns])
    c = np.array(list(patterns.values()), float)
    good = ((v == 1).sum(1) + 0.5) / ((v < 2).sum(1) + 1.0)
    for _ in range(rounds):
        table = np.ones((2, k, 3))
        for cls, w in ((0, c * (1 - good)), (1, c * good)):
            for x in range(2):
                table[cls, :, x] += (w[:, None] * (v == x)).sum(0)
        table[:, :, :2] /= table[:, :, :2].sum(2, keepdims=True)
        prior = float(np.clip((c * good).sum() / c.sum(), 1e-3, 1 - 1e-3))
        model = LabelModel(prior, table)
        z = sum(np.log(table[:, j, v[:, j]]) for j in range(k)) + np.log([[1 - prior], [prior]])
        good = 1 / (1 + np.exp(np.clip(z[0] - z[1], -50, 50)))
    return model


_RUNS = ((re.compile(r"[A-Z]+"), "A"), (re.compile(r"[^\W\d_A]+"), "a"), (re.compile(r"\d+"), "0"))


class _Buckets(dict):
    """A raw word's bucket and, above it, the bucket of its shape (character classes in runs)."""

    def __missing__(self, w: str) -> int:
        if len(self) > CACHE:
            self.clear()
        shape = w
        for run, to in _RUNS:
            shape = run.sub(to, shape)
        top = 64 - BITS
        out = self[w] = (xxhash.xxh3_64_intdigest("=" + shape) >> top) << BITS | xxhash.xxh3_64_intdigest(w.lower().strip(".,;:!?")) >> top
        return out


_buckets = _Buckets()


def features(text: str | None) -> np.ndarray:
    w = text.split() if text else []
    both = np.fromiter(map(_buckets.__getitem__, w), np.int64, len(w))
    return np.concatenate((both & ((1 << BITS) - 1), both >> BITS))


@dataclass
class QualityModel:
    labels: LabelModel
    weights: np.ndarray | None
    bias: float = 0.0

    def score(self, text: str | None) -> float:
        if self.weights is None:
            return self.labels.posterior(votes(text)) if text and text.split() else 0.0
        f = features(text)
        return float(1 / (1 + np.exp(-np.clip(self.weights[f].mean() * 2 + self.bias, -50, 50)))) if len(f) else 0.0


def train_scorer(labels: LabelModel, rows: Iterable[tuple[float, np.ndarray, np.ndarray]], seed: int = 3) -> QualityModel:
    """``rows``: posterior, and the buckets and counts of :func:`features`."""
    data = list(rows)
    if not data or len({p >= 0.5 for p, _, _ in data}) < 2:
        return QualityModel(labels, None)
    rng = np.random.default_rng(seed)
    w, g2, b, gb = np.zeros(1 << BITS), np.full(1 << BITS, 1e-8), 0.0, 1e-8
    for _ in range(EPOCHS):
        for k in rng.permutation(len(data)):
            p, i, n = data[k]
            x = n * (2 / n.sum())
            e = 1 / (1 + np.exp(-np.clip(w[i] @ x + b, -50, 50))) - p
            g = e * x + PENALTY * w[i]
            g2[i] += g * g
            w[i] -= RATE * g / np.sqrt(g2[i])
            gb += e * e
            b -= 0.5 * e / np.sqrt(gb)
    return QualityModel(labels, w.astype(np.float32), float(b))


def _vote_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("trainable"), pa.array([votes(t.as_py()) for t in batch.column("text")], pa.string())], ["doc_id", "trainable", "votes"])


def _feature_batches(labels: LabelModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 100):
            texts = [t.as_py() for t in batch.column("text")]
            both = [np.unique(features(t), return_counts=True) for t in texts]
            yield pa.RecordBatch.from_arrays([
                pa.array([labels.posterior(votes(t)) for t in texts], pa.float64()), pa.array([i for i, _ in both], pa.list_(pa.int32())),
                pa.array([n for _, n in both], pa.list_(pa.int64())), batch.column("_h")], ["p", "i", "n", "_h"])

    return run


def fit(documents: DataFrame) -> QualityModel:
    """The label model over all documents, and a scorer trained on its posteriors."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    docs = documents.select("doc_id", F.col("text").cast("string").alias("text"))
    voted = materialize(docs.withColumn("trainable", trainable(F.col("text"))).mapInArrow(_vote_batches, f"doc_id {kind}, trainable boolean, votes string"), "votes")
    counts = {r["votes"]: r["n"] for r in voted.groupBy("votes").agg(F.count("*").alias("n")).collect()}
    labels = fit_labellers(counts)
    # at most 3^10 patterns
    likely = documents.sparkSession.createDataFrame([(p, int(labels.posterior(p) >= 0.5)) for p in counts], "votes string, likely int")
    marks = voted.where("trainable").join(F.broadcast(likely), "votes").select("doc_id", "likely")
    sample = labelled_sample(docs, marks, "likely", TRAIN_ROWS).mapInArrow(_feature_batches(labels), "p double, i array<int>, n array<long>, _h long")
    got = sample.toArrow().sort_by([("_h", "ascending"), ("p", "ascending")])
    drop_materialized(voted)
    model = train_scorer(labels, [(p.as_py(), i.values.to_numpy(), n.values.to_numpy()) for p, i, n in zip(got["p"], got["i"], got["n"], strict=True) if len(i)])
    del got
    give_back()
    return model


def _score_batches(model: QualityModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [t.as_py() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([model.score(t) for t in texts], pa.float64())], ["doc_id", "score"])

    return run


def score_documents(documents: DataFrame, model: QualityModel) -> DataFrame:
    """doc_id, score (0 to 1, higher: good likelier), kept."""
    kind = documents.schema["doc_id"].dataType.simpleString()
    docs = documents.select("doc_id", F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_score_batches(model), f"doc_id {kind}, score double").withColumn("kept", F.col("score") >= 0.5)
