"""N-gram Jaccard join: a size-aware heavy-light join, exact.

Texts become sets of hashed word shingles. Equal sets collapse to one class first (by a 128-bit
fingerprint), so exact copies never meet in a join. A global order puts rare shingles first; rarity is
read off a counter table of fixed width that is summed over all documents, so any estimate gives right
results and a good one gives short lists. Two sets of Jaccard similarity t share a shingle among the first
n - ceil(t n) + 1 of each. Sets are light or heavy by a size boundary that is chosen by cost:

* light sets (both sizes up to the boundary) enumerate the 2-subsets of a prefix one longer, and meet
  in the subsets they share;
* heavy sets scan the inverted lists of their prefix shingles (a light set stands in those lists too if a
  heavy one can still be similar to it).

The cost is counted in rows, made and met: a list row for each prefix shingle and one for each other set that the
counters expect in its lists, against a row for each subset; every size takes part, and no cost more goes to the
larger boundary.

Of two linked sets the smaller one has its first common shingle so early that it could match a set of its own size
(its place there is ``short``). So lists without a short place are dropped, and only short places open pairs; a
long list of texts that share most but not enough words opens none.

In a list, sets are first compared with one centre, the short place with the fewest rarer shingles before it, and
each set with the ``CENTRES`` centres it shares most lists with. Pairs that are not in one component after
that are then compared in full, so no link between components is lost while groups of near copies do not expand
into all pairs.

Defined results: null texts and texts without words have an empty set (n_shingles 0) and link with
nothing; texts shorter than a shingle are one shingle; rows that repeat a doc_id with other texts are one document
that has the links of all its texts, each with its own n_shingles; a null doc_id links with nothing but its exact
copies; at 100 percent only equal sets link; texts of any length are read whole; an empty table gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvine.llm.components import connected_components
from corvine.llm.sieve import Sieve, sieve
from corvine.llm.wordhash import mix, word_hashes
from corvine.runtime import broadcast_if_small, drop_materialized, materialize, row_count, slices

#: Width of the counter table, partners of a set that are compared in one place, and centres a set is first compared with.
SLOT_BITS, PARTNERS, CENTRES = 18, 512, 3


@dataclass(frozen=True)
class JoinSpec:
    words: int = 4
    percent: int = 85  # link when 100 * intersection >= percent * union

    def least_own(self, n):
        """Smallest overlap of a set of size n with any partner."""
        return -(-self.percent * n // 100)

    def least_size(self) -> int | None:
        """The smallest set that can be similar to another one; None if only equal sets are."""
        return -(-self.percent // (100 - self.percent)) if self.percent < 100 else None


_LOWER, _INSIDE = np.arange(256, dtype=np.uint8), np.ones(256, bool)
_LOWER[65:91] += 32
_INSIDE[[9, 10, 11, 12, 13, 32]] = False


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct k-word shingles; A-Z lower-cased, words split at ASCII blanks."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    ids = word_hashes(_LOWER[raw], _INSIDE[raw])
    if not len(ids):
        return ids
    # fewer words are one shingle, of a length that no other has
    k = min(k, len(ids))
    h = ids[: len(ids) - k + 1] + np.uint64(k)
    for i in range(1, k):
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h += ids[i : len(ids) - k + 1 + i]
    return np.unique(mix(h))


def _slots(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def _count_batches(spec: JoinSpec):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SLOT_BITS, np.int64)
        for batch in slices(batches):
            part, held = [], 0
            for t in batch.column(0):
                s = _slots(shingle_set(t.as_py(), spec.words))
                part.append(s)
                held += len(s)
                if held > 1 << 20:
                    total += np.bincount(np.concatenate(part), minlength=1 << SLOT_BITS)
                    part, held = [], 0
            if part:
                total += np.bincount(np.concatenate(part), minlength=1 << SLOT_BITS)
        i = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(total[i])], ["slot", "n"])

    return run


def shingle_counters(texts: DataFrame, spec: JoinSpec) -> np.ndarray:
    """The counter table over all documents; its width is fixed, so it may be collected and sent out."""
    sums = texts.mapInArrow(_count_batches(spec), "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(1 << SLOT_BITS, np.int64)
    out[sums["slot"].to_numpy()] = sums["n"].to_numpy()
    return out


def order_keys(tokens: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """Shingles as integers that sort in the global order: the rank of their counter, then their low bits."""
    low = np.uint64((1 << (63 - SLOT_BITS)) - 1)
    return (ranks[_slots(tokens)] << np.uint64(63 - SLOT_BITS) | tokens & low).astype(np.int64)


def _prefix_batches(spec: JoinSpec, counters: np.ndarray):
    ranks = np.empty(len(counters), np.uint64)
    ranks[np.argsort(counters, kind="stable")] = np.arange(len(counters), dtype=np.uint64)
    base = float(np.median(counters))
    floor = base + 3 * base**0.5 + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sizes, prints, prefix, cost = [], [], [], []
            for t in batch.column("text"):
                s = shingle_set(t.as_py(), spec.words)
                n = len(s)
                m = n - spec.least_own(n) + 1
                keys = order_keys(s, ranks)
                head = np.argsort(keys)[: m + 1]
                sizes.append(n)
                prints.append(xxhash.xxh3_128_digest(s.tobytes()) if n else None)
                prefix.append(keys[head])
                cost.append(float(np.maximum(counters[_slots(s[head[:m]])] - floor, 0).sum()) if n else 0.0)
            ends = np.concatenate(([0], np.cumsum([len(p) for p in prefix]))).astype(np.int32)
            flat = np.concatenate(prefix) if prefix else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array(sizes, pa.int32()), pa.array(prints, pa.binary()),
                pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), pa.array(cost, pa.float64()),
            ], ["doc_id", "n", "print", "prefix", "cost"])

    return run


def _set_batches(spec: JoinSpec):
    """Column ``text`` becomes ``items``, its set; the other columns pass through."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [shingle_set(t.as_py(), spec.words).view(np.int64) for t in batch.column("text")]
            ends = np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32)
            flat = np.concatenate(sets) if sets else np.zeros(0, np.int64)
            rest = [n for n in batch.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in rest], pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], [*rest, "items"])

    return run


def light_boundary(spec: JoinSpec, histogram: list[tuple[int, int, float]]) -> int:
    """The size up to which sets are light at the least cost in rows, from (size, sets, other sets in their lists)."""
    rows = sorted(histogram)
    n, sets = (np.array([r[k] for r in rows], np.int64) for k in (0, 1))
    m = n + 1 - -(-spec.percent * n // 100)
    sums = lambda x: np.concatenate(([0.0], np.cumsum(x)))
    made, subsets, heavy = sums(sets * m), sums(sets * (m * (m + 1) // 2)), sums(sets * m + np.array([r[2] for r in rows]))
    # light sets that a heavy one can be similar to stand in lists too
    near = np.searchsorted(n, -(-spec.percent * (n + 1) // 100))
    cost = np.append(heavy[-1], subsets[1:] + heavy[-1] - heavy[1:] + made[1:] - made[np.minimum(near, np.arange(len(n)) + 1)])
    return [0, *n.tolist()][int(np.flatnonzero(cost <= cost.min())[-1])]


def _need(spec: JoinSpec, a: Column, b: Column) -> Column:
    return F.ceil(F.lit(spec.percent) * (a + b) / F.lit(100.0 + spec.percent) - 1e-9)


def _candidate(spec: JoinSpec, a: Column, i: Column, b: Column, j: Column) -> Column:
    """Sizes a, b can reach the threshold when their first common shingle stands at i and j (from 0)."""
    return (F.least(a - i, b - j) >= _need(spec, a, b)) & (F.lit(spec.percent) * F.greatest(a, b) <= 100 * F.least(a, b))


def _possible(pairs: DataFrame, sets: DataFrame, spec: JoinSpec) -> DataFrame:
    """The pairs (u, v) that their prefixes do not rule out.

    Up to the smaller of their last keys both prefixes are complete, so beyond the shingles they share there
    the sets can share no more than what either has left.
    """
    pairs = materialize(pairs, "pairs", 16)
    if not row_count(pairs):
        return pairs
    both = _meet(pairs, sets.select("id", F.struct("n", "prefix").alias("x")))
    both = both.withColumn("cut", F.least(F.element_at("a.prefix", -1), F.element_at("b.prefix", -1)))
    rest = F.least(*[F.col(f"{x}.n") - F.size(F.filter(f"{x}.prefix", lambda k: k <= F.col("cut"))) for x in "ab"])
    return both.where(F.size(F.array_intersect("a.prefix", "b.prefix")) + rest >= _need(spec, F.col("a.n"), F.col("b.n"))).select("u", "v").distinct()


def _meet(pairs: DataFrame, rows: DataFrame, build=None) -> DataFrame:
    """u, v, a, b: written pairs with the values of both; ``rows`` has id and a value, which ``build`` may replace.

    Only rows that a pair names are taken, and values move once: that of u, once for each pair, to where v is. A
    name with many partners is copied to several places, so no place and no row has more than some ``PARTNERS``.
    """
    number = row_count(pairs)  # what is broadcast here has no more rows
    dealt = pairs
    for own, other, place in (("v", "u", "place"), ("u", "v", "lot")):
        if number <= PARTNERS:
            dealt = dealt.withColumn(place, F.lit(0).cast("long"))
            continue
        hubs = pairs.groupBy(own).agg(F.ceil(F.count("*") / F.lit(PARTNERS)).alias("places")).where("places > 1")
        dealt = dealt.join(broadcast_if_small(hubs, number // PARTNERS, 32), own, "left")
        dealt = dealt.withColumn(place, F.pmod(F.xxhash64(other), F.coalesce("places", F.lit(1)))).drop("places")
    to = broadcast_if_small(dealt.groupBy("u", "lot").agg(F.collect_list(F.struct("v", "place")).alias("to")).select("u", "to"), number, 40)
    at = broadcast_if_small(dealt.select("v", "place").distinct(), number, 24)
    value = next(c for c in rows.columns if c != "id")
    left, right = rows.withColumnRenamed("id", "u").join(to, "u"), rows.withColumnRenamed("id", "v").join(at, "v")
    if build:
        (left, value), (right, _) = build(left), build(right)
    left = left.select("u", F.col(value).alias("a"), F.explode("to").alias("t")).select("u", "t.v", "t.place", "a")
    return left.join(right.select("v", "place", F.col(value).alias("b")), ["v", "place"])


def _verify(pairs: DataFrame, documents: DataFrame, spec: JoinSpec) -> DataFrame:
    """The pairs (u, v) that link. Whole sets are rebuilt from the texts of the documents in question only."""
    pairs = materialize(pairs, "pairs", 16)
    if not row_count(pairs):
        return pairs

    def build(rows: DataFrame) -> tuple[DataFrame, str]:
        kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "text")
        return rows.mapInArrow(_set_batches(spec), f"{kinds}, items array<bigint>"), "items"

    both = F.size(F.array_intersect("a", "b"))
    found = _meet(pairs, documents.withColumnRenamed("doc_id", "id"), build).where(100 * both >= spec.percent * (F.size("a") + F.size("b") - both))
    links = materialize(found.select("u", "v").distinct(), "links", 16)
    drop_materialized(pairs)
    return links


def _place_batches(spec: JoinSpec, x: int, of: Sieve | None):
    """A row for every place of a set in a list, if the sieve lets its key pass; light sizes go up to x."""
    def places(n: int, prefix: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        m = n - spec.least_own(n) + 1
        if 100 * n >= spec.percent * (x + 1):
            yield 0, prefix[:m], np.arange(m)
        if n <= x:
            j, i = np.tril_indices(m + 1, -1)
            low = prefix.view(np.uint64)
            yield 1, mix((low[i] ^ (low[i] >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + low[j]).view(np.int64), i

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            where, cols = [np.zeros(0, np.int64)], [np.zeros((3, 0), np.int64)]
            for i, (n, prefix) in enumerate(zip(batch.column("n").to_pylist(), batch.column("prefix"), strict=True)):
                for kind, key, pos in places(n, prefix.values.to_numpy()):
                    if of is not None:
                        keep = of.passes(key)
                        key, pos = key[keep], pos[keep]
                    where.append(np.full(len(key), i))
                    cols.append(np.stack((key, pos, np.full(len(key), kind))))
            at = pa.array(np.concatenate(where))
            key, pos, kind = np.concatenate(cols, 1)
            n = batch.column("n").take(at)
            size = n.to_numpy().astype(np.int64)
            short = pos <= size + (-2 * spec.percent * size // (100 + spec.percent))  # size less what a set of this size must share
            yield pa.RecordBatch.from_arrays([batch.column("id").take(at), n, pa.array(pos, pa.int32()), pa.array(key), pa.array(kind, pa.int32()), pa.array(short)],
                                             ["id", "n", "pos", "key", "kind", "short"])

    return run


def _lists(sets: DataFrame, spec: JoinSpec, x: int) -> DataFrame:
    """key, kind, id, n, pos, short of all places in lists that can hold a pair."""
    id_kind = sets.schema["id"].dataType.simpleString()
    places = lambda of: sets.select("id", "n", "prefix").mapInArrow(_place_batches(spec, x, of), f"id {id_kind}, n int, pos int, key long, kind int, short boolean")
    # nearly all keys stand alone: they are counted first, and only places in other lists move
    keys = places(None).groupBy("key").agg(F.count("*").alias("c"), F.max("short").alias("s")).where("c > 1 and s").select("key")
    keys = materialize(keys, "keys", 8)
    out = places(sieve(keys, "key", row_count(keys))).join(broadcast_if_small(keys, row_count(keys), 16), "key", "left_semi")
    out = materialize(out, "lists")
    drop_materialized(keys)
    return out


def jaccard_components(documents: DataFrame, spec: JoinSpec | None = None, boundary: int | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links) for every row of ``documents``.

    ``boundary`` sets the largest light size by hand; without it, it is chosen by cost.
    """
    spec = spec or JoinSpec()
    kind = documents.schema["doc_id"].dataType.simpleString()
    docs = documents.select("doc_id", F.col("text").cast("string").alias("text"))
    counters = shingle_counters(docs.select("text"), spec)
    made = materialize(docs.mapInArrow(_prefix_batches(spec, counters), f"doc_id {kind}, n int, print binary, prefix array<bigint>, cost double"), "prefixes")
    copies = made.where("n > 0").groupBy("print").agg(F.min("doc_id").alias("rep"), F.count("*").alias("c")).where("c > 1").select("print", "rep")
    copies = materialize(copies, "copies", 32)
    copies = broadcast_if_small(copies, row_count(copies), 48)
    out = made.select("doc_id", "n", "print").join(copies, "print", "left").withColumn("rep", F.coalesce("rep", "doc_id"))
    shape = lambda component: (F.col("n").cast("long").alias("n_shingles"), F.coalesce(component, "rep").alias("component_id"))
    least, links = spec.least_size(), _several_texts(out)
    if least is None:
        label = connected_components(links)
        return out.join(label.select(F.col("id").alias("rep"), "component"), "rep", "left").select("doc_id", *shape("component"))
    sets = made.where((F.col("n") >= least) & F.col("doc_id").isNotNull()).join(copies, "print", "left").where("rep is null or rep = doc_id")
    sets = materialize(sets.select(F.col("doc_id").alias("id"), "n", "prefix", "cost"), "classes")
    x = boundary
    if x is None:
        # one row for each size that occurs
        x = light_boundary(spec, [(r["n"], r["c"], r["l"]) for r in sets.groupBy("n").agg(F.count("*").alias("c"), F.sum("cost").alias("l")).collect()])
    lists = _lists(sets, spec, x)

    col = F.col

    def meets(a: str, b: str) -> Column:
        split = F.when(col(f"{a}.kind") == 0, F.greatest(col(f"{a}.n"), col(f"{b}.n")) > x).otherwise(F.lit(True))
        return split & _candidate(spec, col(f"{a}.n"), col(f"{a}.pos"), col(f"{b}.n"), col(f"{b}.pos"))

    centres = lists.where("short").groupBy("key", "kind").agg(F.min(F.struct("pos", "id", "n")).alias("c")).select("key", "kind", "c.*")
    first = lists.alias("a").join(centres.alias("b"), ["key", "kind"]).where((col("a.id") != col("b.id")) & _candidate(spec, col("a.n"), col("a.pos"), col("b.n"), col("b.pos")) & F.when(col("kind") == 0, F.greatest(col("a.n"), col("b.n")) > x).otherwise(F.lit(True)))
    first = first.groupBy(col("a.id").alias("u"), col("b.id").alias("v")).agg(F.count("*").alias("c"))
    best = F.slice(F.sort_array(F.collect_list(F.struct("c", "v")), False), 1, CENTRES)
    best = first.groupBy("u").agg(best.alias("b")).select("u", F.explode("b.v").alias("v"))
    best = materialize(best.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "best", 16)
    links = links.unionByName(_verify(_possible(best, sets, spec), docs, spec))
    label = materialize(connected_components(links), "labels", 16)

    own = lists.join(label, "id", "left").withColumn("comp", F.coalesce("component", "id")).drop("component")
    open_ = own.groupBy("key", "kind").agg(F.min("comp").alias("l"), F.max("comp").alias("h")).where("l <> h").select("key", "kind")
    own = materialize(own.join(open_, ["key", "kind"], "left_semi"), "open")
    a, b = own.where("short").alias("a"), own.alias("b")
    # the shorter set has the short place; of equal ones, whichever
    rest = a.join(b, (col("a.key") == col("b.key")) & (col("a.kind") == col("b.kind")) & (col("a.comp") != col("b.comp")) & (col("a.n") <= col("b.n")) & meets("a", "b"))
    rest = rest.select(F.greatest("a.id", "b.id").alias("u"), F.least("a.id", "b.id").alias("v")).distinct()
    more = _verify(_possible(rest.join(best, ["u", "v"], "left_anti"), sets, spec), docs, spec)
    if row_count(more):
        label = materialize(connected_components(links.unionByName(more)), "labels", 16)
    for df in (best, lists, own, sets):
        drop_materialized(df)
    return out.join(label.select(F.col("id").alias("rep"), "component"), "rep", "left").select("doc_id", *shape("component"))


def _several_texts(out: DataFrame) -> DataFrame:
    """Links (u, v) from documents that have texts of several classes to each of these."""
    named = out.where("doc_id is not null")
    ids = materialize(named.groupBy("doc_id").agg(F.min("rep").alias("l"), F.max("rep").alias("h")).where("l <> h").select("doc_id"), "several", 8)
    return materialize(named.join(broadcast_if_small(ids, row_count(ids), 16), "doc_id", "left_semi").select(F.col("doc_id").alias("u"), F.col("rep").alias("v")).distinct(), "several-links", 16)
