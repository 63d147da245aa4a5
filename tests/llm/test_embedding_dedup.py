import numpy as np
import pyarrow as pa

from corvine.llm import embedding_dedup as ed
from corvine.llm.embedding_dedup import near_duplicates


def brute(rows, threshold=0.93):
    ids = [r[0] for r in rows]
    links, root = {i: 0 for i in range(len(rows))}, list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    vecs = []
    for _, v, label in rows:
        ok = v is not None and label is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v)
        vecs.append(np.array(v, np.float64) if ok else None)
    for i in range(len(rows)):
        for j in range(i):
            a, b = vecs[i], vecs[j]
            if a is None or b is None or rows[i][2] != rows[j][2] or len(a) != len(b):
                continue
            if a @ b / np.sqrt(a @ a) / np.sqrt(b @ b) >= threshold:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    low = {}
    for i, d in enumerate(ids):
        low[find(i)] = min(low.get(find(i), d), d)
    return sorted((d, links[i], low[find(i)], d == low[find(i)]) for i, d in enumerate(ids))


def check(spark, rows, kind="array<float>", **how):
    df = spark.createDataFrame([(*r, "g", 1) for r in rows], f"vec_id long, embedding {kind}, label int, grp string, cell int")
    assert sorted(tuple(r) for r in near_duplicates(df, **how).collect()) == brute(rows)


def test_table_in_few_and_in_many_cells(spark):
    rows = [(r.vec_id, list(r.embedding), r.label) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    check(spark, rows)
    check(spark, rows, pivots=0.3)


def test_near_groups_and_odd_rows(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows, n = [], 100
    for label in (1, 2):
        for _ in range(6):
            c = rng.normal(size=8)
            for _ in range(25):
                rows.append((n, [float(np.float32(x)) for x in c + rng.normal(size=8) * rng.choice([0.05, 0.25, 0.5])], label))
                n += 1
    rows += [(n + i, rows[5][1], 1) for i in range(40)]
    rows += [(1, None, 1), (2, [], 1), (3, [0.0] * 8, 1), (4, [None] + [1.0] * 7, 1), (5, [float("nan")] * 8, 1), (6, [float("inf")] + [0.0] * 7, 1),
             (7, rows[5][1], None), (8, [1.0, 0.0], 1), (9, [2.0, -0.0], 1), (10, [1.0, 0.0], 2), (11, [3e38] * 8, 3), (12, [1e-30] * 8, 3)]
    check(spark, rows)
    # small bins and parts, so that bins are cut, and cells of one bin and of several meet
    for size in (11, 40):
        monkeypatch.setattr(ed, "part_size", lambda n, size=size: size)
        monkeypatch.setattr(ed, "HOMING", 50)
        monkeypatch.setattr(ed, "PRODUCTS", 64)
        check(spark, rows, pivots=0.6)


def test_sizes_of_components_do_not_matter(spark):
    """Squares of these over- and underflow."""
    rows = [(1, [1e200, 1e200], 1), (2, [1e200, 1e200], 1), (3, [1e-200, 1e-200], 1), (4, [1e-200, 1e-200], 1), (5, [1.0, 1.0], 1), (6, [-1e308, 1e308], 1), (7, [-5e-324, 5e-324], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert sorted(tuple(r) for r in near_duplicates(df).collect()) == [(i, 4, 1, i == 1) for i in range(1, 6)] + [(6, 1, 6, True), (7, 1, 6, False)]


def test_clusters_are_pruned():
    """Bins of cells that are far apart get no tile."""
    rng = np.random.default_rng(1)
    centres = np.eye(8)[:4]
    cells = pa.table({"grp": ["g"] * 4, "cell": [1, 2, 3, 4], "number": [3000] * 4, "radius": [0.1] * 4, "vec": pa.array([c + rng.normal(size=8) * 0.01 for c in centres], pa.list_(pa.float64()))})
    out = ed._bins(0.37)(cells).to_pylist()
    assert [x for x in out if x["other"] is not None and x["other"] != x["bin"]] == [] and len({x["bin"] for x in out}) == 4


def test_empty_table(spark):
    check(spark, [])
