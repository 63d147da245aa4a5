"""Benchmark decontamination: rare n-gram seeds join passages to test items, Smith-Waterman scores them.

The pairs and triples of words of all items become one table of grams, by 64-bit hashes. One pass over the
documents counts how many hold each gram. Seeds are an item's grams that few documents hold, or no more than there
may be copies of the item, and the rarest of every ``BLOCK`` words; so a seed is rare for its item, however often the
item itself was copied, and an edited copy keeps some. A second pass finds the seeds in the documents, and
an equi-join by gram gives pairs of document and item with their places. Documents that hold a seed are written, and
where seeds cover ``COVER`` words of an item in one passage, the passage is aligned with the item word by word
(match 2, mismatch -1, gap -1). A pair is contaminated when the local alignment scores at least
``SHARE`` of a perfect copy, or at least ``RUN``, a dozen words in a row. For short items, where chance
alone reaches half, at least ``SHORT`` or four fifths of a perfect copy is needed. Items under ``MIN_WORDS`` words
are matched exactly: their only gram is the whole sequence, which has to stand in the document as it is.

The two passes are the same for a benchmark of any size. What the executors get of it is a table of bits, a
few for each gram and of bounded size, which only rules grams out; the joins decide. They shuffle what matches
and are broadcast behind a check of their size.

Defined results: null and empty documents match nothing; null items and items without words are not tested;
items that repeat are tested once for each item_id, and a null item_id is one of its own; repeated documents
and rows that share a doc_id are tested one by one; texts of any length are read whole; either table empty
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from corvine.llm.sieve import Sieve, sieve
from corvine.llm.wordhash import word_hashes
from corvine.runtime import broadcast_if_small, drop_materialized, materialize, row_count, slices

MIN_WORDS, BLOCK, COVER, SHARE, RUN, SHORT = 5, 4, 4, 0.5, 24, 14
RARE, TIMES = 20, 4
MATCH, MISS, GAP = 2, -1, -1
#: Counts that a task holds before it passes them on.
HELD = 1 << 18
_WORD = re.compile(r"\w+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def needed(size: int) -> float:
    """The score from which an item of so many words counts as copied."""
    perfect = MATCH * size
    return perfect if size < MIN_WORDS else min(max(SHARE * perfect, min(0.8 * perfect, SHORT)), max(RUN, SHORT))


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int]:
    """Best local alignment score of two id arrays, and the passage position behind its end."""
    if not len(item) or not len(passage):
        return 0, 0
    ramp = np.arange(len(passage) + 1) * -GAP
    row, best, at = np.zeros(len(passage) + 1, np.int64), 0, 0
    for w in item:
        new = np.maximum(row + GAP, 0)
        new[1:] = np.maximum(new[1:], row[:-1] + np.where(passage == w, MATCH, MISS))
        row = np.maximum.accumulate(new + ramp) - ramp
        k = int(row.argmax())
        if row[k] > best:
            best, at = int(row[k]), k
    return best, at


#: What ``\w`` matches.
_INSIDE = np.fromiter((chr(i).isalnum() or i == 95 for i in range(0x110000)), bool, 0x110000)


def hashes_of(text: str | None) -> np.ndarray:
    """A hash for each of :func:`words_of`."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    return word_hashes(codes, _INSIDE[codes])


def grams_of(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of n words."""
    out = np.full(max(0, len(h) - n + 1), n, np.uint64)
    for k in range(n):
        out = (out ^ h[k : k + len(out)]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def item_grams(h: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(length, hashes) of an item's grams: pairs and triples, or the whole of a short one."""
    for n in (2, 3) if len(h) >= MIN_WORDS else (len(h),):
        if n:
            yield n, grams_of(h, n)


def hits(of: Sieve, lengths: tuple[int, ...], h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Position and hash of the grams of a document that pass the sieve."""
    at, found = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for n in lengths:
        g = grams_of(h, n)
        at.append(np.flatnonzero(of.passes(g)))
        found.append(g[at[-1]])
    return np.concatenate(at), np.concatenate(found)


def _sieve(grams: DataFrame) -> tuple[Sieve, tuple[int, ...]]:
    """Of a written table of grams, with their lengths."""
    return sieve(grams, "gram", row_count(grams)), tuple(sorted(r[0] for r in grams.select("n").distinct().collect()))


def _item_batches(item_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            where, size, cols = [], [], []
            for i, t in enumerate(batch.column("text")):
                h = hashes_of(t.as_py())
                for n, g in item_grams(h):
                    where.append(np.full(len(g), i))
                    size.append(np.full(len(g), len(h)))
                    cols.append((np.full(len(g), n), np.arange(len(g)), g.view(np.int64)))
            i = pa.array(np.concatenate(where) if where else np.zeros(0, np.int64))
            n, at, g = (np.concatenate([c[k] for c in cols]) if cols else np.zeros(0, np.int64) for k in range(3))
            yield pa.RecordBatch.from_arrays([
                batch.column("item").take(i), pa.array(n, pa.int32()), pa.array(at, pa.int32()), pa.array(g, pa.int64()),
                pa.array(np.concatenate(size) if size else n, pa.int32())], ["item", "n", "at", "gram", "size"])

    return run


def _count_batches(of: Sieve, lengths: tuple[int, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0

        def flush() -> pa.RecordBatch:
            g, n = np.unique(np.concatenate([*parts, np.zeros(0, np.uint64)]), return_counts=True)
            parts.clear()
            return pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(n, pa.int64())], ["gram", "n"])

        for batch in slices(batches):
            for t in batch.column(0):
                parts.append(np.unique(hits(of, lengths, hashes_of(t.as_py()))[1]))
                held += len(parts[-1])
                if held >= HELD:
                    yield flush()
                    held = 0
        yield flush()

    return run


def _hit_batches(of: Sieve, lengths: tuple[int, ...]):
    """A row for each document with seeds: doc_id, text and its print, their hashes and places."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            where, found = [], []
            for i, t in enumerate(batch.column("text")):
                at, g = hits(of, lengths, hashes_of(t.as_py()))
                if len(at):
                    where.append(i)
                    found.append((g.view(np.int64), at))
            i = pa.array(where, pa.int64())
            yield pa.RecordBatch.from_arrays([
                *[batch.column(c).take(i) for c in ("doc_id", "text", "print")], pa.array([g for g, _ in found], pa.list_(pa.int64())),
                pa.array([p for _, p in found], pa.list_(pa.int32()))], ["doc_id", "text", "print", "grams", "places"])

    return run


def choose_seeds(found: pa.Table) -> pa.Table:
    """The seeds among one item's grams (columns n, at, gram, f); those that no document holds are not among them.

    Rare is what no more than ``RARE`` documents hold, or ``TIMES`` as many as the item's middle triple: that many
    copies of the item itself there may be. The rarest of every block is a seed too.
    """
    n, at, f = (found.column(c).to_numpy() for c in ("n", "at", "f"))
    triples = np.sort(f[n == 3])
    most = max(RARE, TIMES * triples[len(triples) // 2] if len(triples) else 0)
    keep = f <= most
    order = np.lexsort((at, f, at // BLOCK, n))
    first = np.ones(len(order), bool)
    first[1:] = (n[order][1:] != n[order][:-1]) | (at[order][1:] // BLOCK != at[order][:-1] // BLOCK)
    keep[order[first]] = True
    return found.filter(pa.array(keep))


def clusters(found: list[tuple[int, int, int]], size: int) -> Iterator[tuple[int, int]]:
    """Passages (from, to) in which seeds (place, place in the item, length) cover enough of an item."""
    need = min(COVER, size)
    found, cluster = sorted(found), []
    for h in [*found, None]:
        if h is not None and (not cluster or h[0] - cluster[-1][0] <= size):
            cluster.append(h)
            continue
        if len({x for _, at, n in cluster for x in range(at, at + n)}) >= need:
            places = [p - at for p, at, _ in cluster]
            yield max(0, min(places) - size // 2), max(places) + size + size // 2
        cluster = [h] if h is not None else []


def judge(item: np.ndarray, doc: np.ndarray, passages: list[tuple[int, int]]) -> tuple[int, int] | None:
    """Best (score, word behind its end) of the passages, if it is enough."""
    best = (0, 0)
    for low, high in passages:
        score, end = align(item, doc[low:high])
        best = max(best, (score, low + end))
    return best if best[0] and best[0] >= needed(len(item)) else None


def _cluster_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        where, out = [], []
        for i, (size, hits) in enumerate(zip(batch.column("size").to_pylist(), batch.column("hits").to_pylist(), strict=True)):
            found = list(clusters([(h["p"], h["at"], h["n"]) for h in hits], size))
            if found:
                where.append(i)
                out.append([{"low": a, "high": b} for a, b in found])
        i = pa.array(where, pa.int64())
        kind = pa.list_(pa.struct([("low", pa.int32()), ("high", pa.int32())]))
        yield pa.RecordBatch.from_arrays([*[batch.column(c).take(i) for c in ("doc_id", "print", "item")], pa.array(out, kind)], ["doc_id", "print", "item", "passages"])


def _judge_batches(item_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 100):
            where, ids, rows = [], [], []
            for i, (t, items) in enumerate(zip(batch.column("text"), batch.column("items"), strict=True)):
                doc = hashes_of(t.as_py())
                for x in items.as_py():
                    item = hashes_of(x["text"])
                    best = judge(item, doc, [(p["low"], p["high"]) for p in x["passages"]])
                    if best:
                        where.append(i)
                        ids.append(x["item_id"])
                        rows.append((best[0], best[0] / (MATCH * len(item)), best[1]))
            score, share, end = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id").take(pa.array(where, pa.int64())), pa.array(ids, item_type), pa.array(score, pa.int64()), pa.array(share, pa.float64()),
                pa.array(end, pa.int64())], ["doc_id", "item_id", "score", "share", "end_word"])

    return run


def find_leaks(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, score, share (of a perfect copy's score), end_word: one row per contaminated pair."""
    doc_kind, item_kind = (d.schema[c].dataType for d, c in ((documents, "doc_id"), (benchmark, "item_id")))
    doc, item = doc_kind.simpleString(), item_kind.simpleString()
    docs = documents.select("doc_id", F.col("text").cast("string").alias("text"))
    # an item is its id and text
    items = benchmark.select("item_id", F.col("text").cast("string").alias("text")).where("text is not null").distinct()
    items = materialize(items.withColumn("item", F.sha2(F.to_json(F.struct("item_id", "text")), 256)), "items", 256)
    named = items.select("item", "text")
    grams = materialize(named.mapInArrow(_item_batches(to_arrow_type(item_kind)), "item string, n int, at int, gram long, size int"), "grams", 96)
    counted = docs.select("text").mapInArrow(_count_batches(*_sieve(grams)), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("f"))
    counted = materialize(counted, "counts", 16)
    found = grams.join(broadcast_if_small(counted, row_count(counted), 24), "gram")
    seeds = found.groupBy("item").applyInArrow(choose_seeds, "gram long, item string, n int, at int, size int, f long")
    seeds = materialize(seeds, "seeds", 96)

    seen = docs.withColumn("print", F.xxhash64("text")).mapInArrow(_hit_batches(*_sieve(seeds)), f"doc_id {doc}, text string, print long, grams array<long>, places array<int>")
    seen = materialize(seen, "seen")
    places = seen.select("doc_id", "print", F.explode(F.arrays_zip("grams", "places")).alias("h")).select("doc_id", "print", F.col("h.grams").alias("gram"), F.col("h.places").alias("p"))
    both = places.join(broadcast_if_small(seeds, row_count(seeds), 128), "gram").groupBy("doc_id", "print", "item").agg(
        F.max("size").alias("size"), F.collect_set(F.struct("p", "at", "n")).alias("hits"))
    near = both.mapInArrow(_cluster_batches, f"doc_id {doc}, print long, item string, passages array<struct<low:int,high:int>>")
    near = materialize(near, "near", 128)
    asked = near.join(items, "item").groupBy("doc_id", "print").agg(F.collect_list(F.struct("item_id", "text", "passages")).alias("items"))
    asked = materialize(asked.select(F.col("doc_id").alias("d"), "print", "items"), "asked", 1024)
    texts = seen.alias("t").join(
        broadcast_if_small(asked, row_count(asked), 1024).alias("a"), F.col("t.doc_id").eqNullSafe(F.col("a.d")) & (F.col("t.print") == F.col("a.print")))
    out = texts.select("t.doc_id", "t.text", "a.items").mapInArrow(
        _judge_batches(to_arrow_type(item_kind)), f"doc_id {doc}, item_id {item}, score long, share double, end_word long")
    for df in (grams, counted, seeds, near):
        drop_materialized(df)
    return out


def leaks_of(text: str | None, items: list[tuple]) -> list[tuple]:
    """The plain version for one text, (item_id, text) pairs, and every gram a seed: (item_id, score, word behind its end)."""
    doc, out = hashes_of(text), []
    for item_id, t in items:
        item = hashes_of(t)
        if not len(item):
            continue
        found = [(p, at, n) for n, g in item_grams(item) for at, x in enumerate(g.tolist()) for p in np.flatnonzero(grams_of(doc, n) == np.uint64(x)).tolist()]
        best = judge(item, doc, list(clusters(found, len(item))))
        if best:
            out.append((item_id, *best))
    return out
