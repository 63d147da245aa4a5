"""Embedding near-dedup: an exact metric range join over pivot cells.

Vectors of one label are compared by cosine; on unit vectors that is a Euclidean range join of radius
r = sqrt(2 - 2 c). Equal vectors collapse first, with their number, so exact copies never meet. Every label gets
pivots, drawn by a hash, whose number grows with the square root of its vectors; a vector's home is its nearest
pivot's cell. Two cells can hold a link only if their pivots are no further apart than both radii and r (triangle
inequality). Neighbouring cells are packed into bins, and bins that are still too large are cut into parts.

A tile joins two parts. Inside it each home cell joins independently with its boundary replicas: those vectors of
the other part whose distance from the cell's centre is at most the cell's radius and r, by the triangle
inequality again. A vector is shuffled once for each tile, not once for each cell, and tiles are as large as memory
allows, so what is shuffled grows with the vectors of a label over ``LARGEST``.

A tile reports, for each vector, how many partners it has there, and a forest of the links (not the links),
which is linear in the tile; components come from the forests.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and rows with a
null label, link with nothing (n_links 0, own component, kept); vectors of other lengths are compared
within their length; components of any finite size are compared without over- or underflow; repeated rows count
as other vectors; a null vec_id has a null component; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvine.llm.components import connected_components
from corvine.runtime import drop_materialized, materialize

#: A label's pivots are about sqrt(vectors) / PIVOTS. A bin part holds an eighth of its label's vectors, within these bounds.
PIVOTS, SMALLEST, LARGEST = 2.0, 2048, 16384
#: Vectors that look for their home together, and products of a tile that are held at once.
HOMING, PRODUCTS = 4096, 1 << 20
#: Room for rounding in the bounds; links themselves are decided by the cosine alone.
SLACK = 1e-6


def unit(m: np.ndarray) -> np.ndarray:
    """Rows of length 1; scaled by their largest component first, so that squares neither overflow nor vanish."""
    m = m / np.abs(m).max(1, keepdims=True)
    return m / np.sqrt((m * m).sum(1, keepdims=True))


def _matrix(table: pa.Table) -> np.ndarray:
    col = table.column("vec").combine_chunks()
    return unit(col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(col), -1))


def _column(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T), 0))


def _home(table: pa.Table) -> pa.Table:
    """Vectors and their label's pivots: each vector with its nearest pivot's id and distance."""
    is_pivot = _column(table, "pivot")
    pivots, own = table.filter(pa.array(is_pivot)).sort_by("id"), table.filter(pa.array(~is_pivot))
    if not own.num_rows:
        d, at = np.zeros((0, 1)), np.zeros(0, int)
    else:
        d = _distances(_matrix(own), _matrix(pivots))
        at = d.argmin(1)
    return own.drop_columns(["pivot"]).append_column("cell", pivots.column("id").combine_chunks().take(pa.array(at))).append_column("dist", pa.array(d[np.arange(len(at)), at], pa.float64()))


def _bins(r: float):
    def run(table: pa.Table) -> pa.Table:
        """One label's cells, with pivot, number and radius: rows (cell, bin, parts) and rows (bin, other) of bins that may hold a link."""
        table = table.sort_by("cell")
        m, number, radius = _matrix(table), _column(table, "number"), _column(table, "radius")
        room = part_size(int(number.sum()))
        d = _distances(m, m)
        # neighbours first: each cell is followed by the nearest one left
        order, left = [0], np.ones(len(m), bool)
        left[0] = False
        while left.any():
            order.append(int(np.where(left, d[order[-1]], np.inf).argmin()))
            left[order[-1]] = False
        bins, held, at = np.zeros(len(m), np.int32), 0, 0
        for c in order:
            if held and held + number[c] > room:
                at, held = at + 1, 0
            bins[c], held = at, held + number[c]
        sizes = np.bincount(bins, number, at + 1)
        parts = np.maximum(1, np.ceil(sizes / room)).astype(np.int32)
        x, y = np.nonzero(d <= radius[:, None] + radius[None, :] + r + SLACK)
        pairs = np.unique(np.stack((np.minimum(bins[x], bins[y]), np.maximum(bins[x], bins[y])), 1), axis=0)
        grp, n, cells = table.column("grp")[0].as_py(), len(pairs), table.column("cell").combine_chunks()
        return pa.table({
            "grp": pa.array([grp] * (len(m) + n), pa.string()), "cell": pa.concat_arrays([cells, pa.nulls(n, cells.type)]),
            "bin": pa.array(np.concatenate((bins, pairs[:, 0])), pa.int32()), "parts": pa.array(np.concatenate((parts[bins], parts[pairs[:, 0]])), pa.int32()),
            "other": pa.concat_arrays([pa.nulls(len(m), pa.int32()), pa.array(pairs[:, 1], pa.int32())]),
            "other_parts": pa.concat_arrays([pa.nulls(len(m), pa.int32()), pa.array(parts[pairs[:, 1]], pa.int32())]),
        })

    return run


def part_size(vectors: int) -> int:
    return min(LARGEST, max(SMALLEST, -(-vectors // 8)))


class _Forest:
    """Union of links given in bulk: every node points at the smallest node of its tree."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def add(self, u: np.ndarray, v: np.ndarray) -> None:
        while True:
            a, b = self.root[u], self.root[v]
            open_ = a != b
            if not open_.any():
                return
            u, v, low = u[open_], v[open_], np.minimum(a, b)[open_]
            np.minimum.at(self.root, a[open_], low)
            np.minimum.at(self.root, b[open_], low)
            while (self.root[self.root] != self.root).any():
                self.root = self.root[self.root]


def _tile(threshold: float, r: float):
    def links(a: np.ndarray, b: np.ndarray, cell: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Row numbers of the links between a and b, cell by cell of a, in bounded lots. ``cell`` is sorted."""
        edges = np.append(np.flatnonzero(np.append(True, cell[1:] != cell[:-1])), len(cell))
        for low, high in zip(edges[:-1], edges[1:], strict=True):
            centre = a[low:high].mean(0, keepdims=True)
            radius = _distances(a[low:high], centre).max()
            near = np.flatnonzero(_distances(b, centre)[:, 0] <= radius + r + SLACK)
            replicas = b[near].T
            for at in range(low, high, step := max(1, PRODUCTS // max(1, len(near)))):
                x, y = np.nonzero(a[at : min(at + step, high)] @ replicas >= threshold)
                yield x + at, near[y]

    def run(table: pa.Table) -> pa.Table:
        left = table.filter(pa.array(_column(table, "side") == 0)).sort_by("cell")
        right = table.filter(pa.array(_column(table, "side") == 1)) if table.num_rows > left.num_rows else left
        same, n = right is left, left.num_rows
        none = table.slice(0, 0)
        if not n:
            return pa.table({"id": none.column("id"), "n": pa.array([], pa.int64()), "root": none.column("id")})
        a = _matrix(left)
        b = a if same else _matrix(right)
        total = n if same else n + right.num_rows
        weight = np.concatenate((_column(left, "number"), [] if same else _column(right, "number")))
        count, forest, shift = np.zeros(total), _Forest(total), 0 if same else n
        cells = left.column("cell").combine_chunks().dictionary_encode().indices.to_numpy()
        for x, y in links(a, b, cells):
            y = y + shift
            x, y = x[x != y], y[x != y]
            count += np.bincount(x, weight[y], total)
            if not same:
                count += np.bincount(y, weight[x], total)
            forest.add(x, y)
        some = np.flatnonzero(count)
        ids = pa.concat_arrays([left.column("id").combine_chunks(), *([] if same else [right.column("id").combine_chunks()])])
        # whichever of a tree's rows comes first stands for it
        return pa.table({"id": ids.take(pa.array(some)), "n": pa.array(count[some].astype(np.int64)), "root": ids.take(pa.array(forest.root[some]))})

    return run


def near_duplicates(embeddings: DataFrame, threshold: float = 0.93, pivots: float = PIVOTS) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``embeddings`` (vec_id, embedding, label)."""
    r = math.sqrt(2 - 2 * threshold)
    kind = embeddings.schema["embedding"].dataType.simpleString()
    vec = F.col("embedding").cast(kind if kind in ("array<float>", "array<double>") else "array<double>")
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = embeddings.select("vec_id", "label", vec.alias("vec"))
    usable = F.coalesce(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & ~bad & F.exists("vec", lambda x: x != 0), F.lit(False))
    grp = F.concat_ws("/", F.col("label").cast("string"), F.size("vec").cast("string"))
    rows = rows.withColumn("grp", F.when(usable, grp))
    # -0.0 and 0.0 are one value; a vector's bytes stand for it
    same = F.sha2(F.to_json(F.struct(F.transform("vec", lambda x: x + F.lit(0.0)).alias("v"))), 256)
    rows = materialize(rows.withColumn("print", F.when(F.col("grp").isNotNull(), F.concat_ws("/", "grp", same))), "vectors")
    reps = materialize(rows.where("grp is not null").groupBy("print", "grp").agg(F.min("vec_id").alias("id"), F.count("*").alias("number"), F.first("vec").alias("vec")), "reps")
    source = reps.select("id", "grp", "number", "vec")
    id_kind, vec_kind = (source.schema[c].dataType.simpleString() for c in ("id", "vec"))

    # each label's size, and its pivots: the row with the smallest id and whatever a hash draws
    sizes = materialize(reps.groupBy("grp").agg(F.count("*").alias("size"), F.min("id").alias("least")), "sizes", 64)
    sized = source.join(sizes, "grp")
    parts = F.ceil(F.col("size") / HOMING).cast("int")
    drawn = (F.pmod(F.xxhash64(F.lit("pivot"), "id"), "size") < F.sqrt("size") / pivots) | (F.col("id") == F.col("least"))
    centres = materialize(sized.where(drawn).select("id", "grp", "number", "vec", parts.alias("parts")), "pivots")
    seek = sized.select("id", "grp", "number", "vec", F.pmod(F.xxhash64("id"), parts).cast("int").alias("part"), F.lit(False).alias("pivot"))
    seek = seek.unionByName(centres.select("id", "grp", "number", "vec", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(True).alias("pivot")))
    schema = f"id {id_kind}, grp string, number long, vec {vec_kind}, cell {id_kind}, dist double"
    homes = seek.groupBy("grp", "part").applyInArrow(_dropping(_home, "part"), schema)
    homes = materialize(homes, "homes")

    cells = homes.groupBy("grp", "cell").agg(F.count("*").alias("number"), F.max("dist").alias("radius"))
    cells = cells.join(centres.select("grp", F.col("id").alias("cell"), "vec"), ["grp", "cell"])
    plan = materialize(cells.groupBy("grp").applyInArrow(_bins(r), f"grp string, cell {id_kind}, bin int, parts int, other int, other_parts int"), "bins", 48)
    placed = homes.join(plan.where("other is null").select("grp", "cell", "bin", "parts"), ["grp", "cell"])
    placed = placed.select("grp", "cell", "bin", F.pmod(F.xxhash64(F.lit("part"), "id"), "parts").cast("int").alias("part"), "id", "number", "vec")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    tiles = plan.where("other is not null").select("grp", F.col("bin").alias("a"), F.col("other").alias("b"), every("parts").alias("i"), "other_parts")
    tiles = tiles.select("grp", "a", "b", "i", every("other_parts").alias("j")).where("a <> b or i <= j")
    side = lambda bin_, part, n: placed.join(tiles.select("grp", F.col(bin_).alias("bin"), F.col(part).alias("part"), "a", "b", "i", "j"), ["grp", "bin", "part"]).withColumn("side", F.lit(n))
    dealt = side("a", "i", 0).unionByName(side("b", "j", 1).where("a <> b or i <> j")).select("grp", "a", "b", "i", "j", "side", "cell", "id", "number", "vec")
    found = dealt.groupBy("grp", "a", "b", "i", "j").applyInArrow(_tile(threshold, r), f"id {id_kind}, n long, root {id_kind}")
    found = materialize(found, "found", 24)

    counts = found.groupBy("id").agg(F.sum("n").alias("n"))
    label = connected_components(found.select(F.col("id").alias("u"), F.col("root").alias("v")))
    info = reps.select("print", "id", "number").join(counts, "id", "left").join(label, "id", "left")
    out = rows.select("vec_id", "print").join(info, "print", "left")
    for df in (sizes, centres, homes, plan):
        drop_materialized(df)
    component: Column = F.coalesce("component", "id", "vec_id")
    return out.select(
        "vec_id", F.coalesce(F.col("n") + F.col("number") - 1, F.col("number") - 1, F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"), (F.col("vec_id") == component).alias("kept"),
    )


def _dropping(f, *names: str):
    return lambda table: f(table.drop_columns(list(names)))
