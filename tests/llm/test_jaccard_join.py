import itertools
import random
import re

from corvine.llm import jaccard_join
from corvine.llm.jaccard_join import JoinSpec, jaccard_components, light_boundary


def brute(rows, k=4, percent=85):
    """rows: (doc_id, text). Plain sets, inverted lists, union-find."""
    sets, parent = [], {}
    for d, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append((d, {tuple(w[i:i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()))
        parent[d] = d

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    lists = {}
    for i, (_, s) in enumerate(sets):
        for g in s:
            lists.setdefault(g, []).append(i)
    shared = {}
    for own in lists.values():
        for i, j in itertools.combinations(own, 2):
            shared[i, j] = shared.get((i, j), 0) + 1
    for (i, j), both in shared.items():
        if 100 * both >= percent * (len(sets[i][1]) + len(sets[j][1]) - both):
            a, b = sorted((find(sets[i][0]), find(sets[j][0])))
            parent[b] = a
    return sorted((d, len(s), find(d)) for d, s in sets)


def run(spark, rows, spec=None, boundary=None):
    df = spark.createDataFrame([(d, t, 1, "x", "y") for d, t in rows], "doc_id long, text string, n int, print string, component string")
    return sorted(tuple(r) for r in jaccard_components(df, spec, boundary).collect())


def edited(rng, words, edits):
    w = list(words)
    for _ in range(edits):
        i = rng.randrange(len(w))
        w[i] = f"x{rng.randrange(10**6)}"
    return " ".join(w)


def test_edge_cases(spark):
    rows = [(5, None), (6, ""), (7, " \t\n"), (8, "one two"), (3, "One TWO"), (9, "one  two three"), (10, "a b c d"), (11, "A b\x0bc\td"),
            (12, "a b c d"), (13, "z " * 500), (14, "Z " * 900), (15, "  a b c d"), (16, "ÄB c d e"), (17, "äB c d e")]
    assert run(spark, rows) == brute(rows)


def test_groups_of_near_copies(spark):
    rng = random.Random(4)
    rows, n = [], 0
    for size in (5, 6, 7, 8, 12, 20, 40, 66, 150):
        base = [f"w{rng.randrange(10**6)}" for _ in range(size + 3)]
        for _ in range(25):
            rows.append((n, edited(rng, base, rng.randrange(0, 4))))
            n += 1
        for cut in range(1, 6):
            rows.append((n, " ".join(base[: max(1, len(base) - cut)])))
            n += 1
    line = " ".join(f"common{i}" for i in range(30))
    rows += [(n + i, line + " " + " ".join(f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(0, 40)))) for i in range(120)]
    rng.shuffle(rows)
    want = brute(rows)
    for boundary in (None, 0, 25, 64):
        assert run(spark, rows, boundary=boundary) == want
    assert len({c for _, _, c in want}) < len(want) - 50


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert sorted(tuple(r) for r in jaccard_components(docs).collect()) == brute(rows)


def test_five_words_at_eight_tenths(spark):
    rng = random.Random(9)
    base = [f"w{i}" for i in range(60)]
    rows = [(i, edited(rng, base, i % 4)) for i in range(40)]
    assert run(spark, rows, JoinSpec(words=5, percent=80)) == brute(rows, 5, 80)


def test_rows_that_repeat_an_id(spark):
    """One document has the links of all its texts."""
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(5, a), (5, b), (3, a + " x"), (9, b + " y"), (9, ""), (2, ""), (7, "a b c d"), (8, a), (8, "q w e r t"), (1, "q w e r t"), (None, "q w e r t"), (None, a + " z")]
    got = run(spark, [r for r in rows if r[0] is not None])
    assert got == brute([r for r in rows if r[0] is not None]) and {c for d, _, c in got if d != 2 and d != 7} == {1}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sum(r.doc_id is None for r in jaccard_components(df).collect()) == 2


def test_at_hundred_percent_only_equal_sets_link(spark):
    rows = [(3, "a b c d e f"), (1, "A b c d e f"), (2, "a b c d e f g"), (4, "z"), (4, "a b c d e f"), (5, None)]
    assert run(spark, rows, JoinSpec(percent=100)) == brute(rows, percent=100) == [(1, 3, 1), (2, 4, 2), (3, 3, 1), (4, 1, 1), (4, 3, 1), (5, 0, 5)]


def test_very_long_texts(spark):
    words = [f"w{i}" for i in range(60_000)]
    rows = [(1, " ".join(words)), (2, " ".join(words[2000:])), (3, " ".join(words[30_000:])), (4, "w0 w1 w2 w3")]
    assert run(spark, rows) == [(1, 59997, 1), (2, 57997, 1), (3, 29997, 3), (4, 1, 4)]


def test_boundary_follows_cost():
    spec = JoinSpec()
    assert light_boundary(spec, []) == 0
    # no prefix shingle more than a pair: nothing to lose
    assert light_boundary(spec, [(4, 5, 0.0)]) == 4
    assert light_boundary(spec, [(10, 5, 0.0), (300, 9, 0.0)]) == 0
    assert light_boundary(spec, [(10, 5, 1e6), (30, 5, 0.0), (300, 9, 0.0)]) == 10
    # sizes of every height take part
    assert light_boundary(spec, [(10, 5, 1e6), (400, 5, 1e9)]) == 400


def test_boundary_above_zero_is_chosen_where_lists_are_long(spark, monkeypatch):
    """Many small sets over few shingles: the cost model itself takes the light path."""
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice("abcde") for _ in range(rng.randrange(9, 17)))) for i in range(1500)]
    seen = []
    monkeypatch.setattr(jaccard_join, "light_boundary", lambda *a: seen.append(light_boundary(*a)) or seen[-1])
    assert run(spark, rows) == brute(rows) and seen[0] > 0


def test_long_lists_of_texts_that_share_too_little_open_no_pairs(spark, monkeypatch):
    """A common passage that is most, but not enough, of hundreds of texts."""
    rng, spec = random.Random(3), JoinSpec()
    common = " ".join(f"c{i}" for i in range(100))
    rows = [(i, " ".join(f"u{rng.randrange(10**9)}" for _ in range(14)) + " " + common) for i in range(400)]
    met = []
    keep = jaccard_join._verify
    monkeypatch.setattr(jaccard_join, "_verify", lambda pairs, *a: met.append(pairs.count()) or keep(pairs, *a))
    assert run(spark, rows) == brute(rows) and sum(met) < 800


def test_empty_table(spark):
    assert run(spark, []) == []
