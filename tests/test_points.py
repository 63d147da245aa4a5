import uuid

import pytest
from pyspark.sql import functions as F

from corvine.runtime import scratch_root
from corvine.sources import points as pt
from corvine.sources.points import CollectionMismatch, PointsTable


@pytest.fixture
def points_table(spark):
    t = PointsTable(spark, f"{scratch_root(spark)}/points-{uuid.uuid4().hex}")
    t.ensure(2, buckets=16)
    return t


def points(spark, rows, note="old"):
    return spark.createDataFrame([(i, s, [1.0, float(len(note))], ["x"], note) for i, s in rows], "point_id string, source string, vector array<double>, tags array<string>, note string")


def many(spark, n, note="old", step=1):
    return points(spark, [(f"p{i}", None if i % 5 == 0 else str(i % 3)) for i in range(0, n, step)], note)


def rows(df):
    return sorted((r.point_id, str(r.source), r.note) for r in df.collect())


def files(t):
    return {f.split("/", 3)[-1] for f in t.read().inputFiles()}


def test_an_upsert_writes_its_buckets_only(spark, points_table):
    t = points_table
    t.upsert(many(spark, 400))
    before = files(t)
    written = t.upsert(points(spark, [("p7", "9"), ("new", None)], "changed"))
    assert 1 <= len(written) <= 2
    kept = {f for f in before if not any(f"_bucket={b}/" in f for b in written)}
    assert kept <= files(t) and all(any(f"_bucket={b}/" in f for b in written) for f in files(t) - kept)
    got = {r.point_id: (r.source, r.note) for r in t.read().collect()}
    assert len(got) == t.count() == 401 and got["p7"] == ("9", "changed") and got["new"] == (None, "changed") and got["p5"] == (None, "old") and got["p4"] == ("1", "old")


def test_readers_keep_what_they_began_with(spark, points_table):
    t = points_table
    t.upsert(many(spark, 60))
    reader = t.read()
    t.upsert(many(spark, 60, "changed"))
    t.append_new(many(spark, 90, "more"))
    assert {r.note for r in reader.collect()} == {"old"} and reader.count() == 60
    assert {r.note for r in t.read().collect()} == {"changed", "more"} and t.count() == 90
    assert t.vacuum() > 0 and t.count() == 90 and t.vacuum() == 0


def test_a_write_that_breaks_off_changes_nothing(spark, points_table, monkeypatch):
    t = points_table
    t.upsert(many(spark, 30))
    before = rows(t.read())
    with monkeypatch.context() as m:
        m.setattr(PointsTable, "_save", lambda self, meta: (_ for _ in ()).throw(OSError("gone")))
        for write in (t.upsert, t.append_new):
            with pytest.raises(OSError):
                write(many(spark, 50, "lost"))
            assert rows(t.read()) == before
    t.append_new(many(spark, 50, "found"))
    assert rows(t.read()) == sorted(before + [(f"p{i}", str(None if i % 5 == 0 else i % 3), "found") for i in range(30, 50)])


def test_appends_add_files_until_there_are_too_many(spark, points_table, monkeypatch):
    monkeypatch.setattr(pt, "MOST_PARTS", 3)
    t = points_table
    for k in range(6):
        t.append_new(many(spark, 40 * (k + 1), f"n{k}"))
        t.append_new(many(spark, 40 * (k + 1), "again"))
    assert t.count() == 240 and all(len(v) <= 3 for v in t._meta()["parts"].values())
    assert rows(t.read()) == sorted((f"p{i}", str(None if i % 5 == 0 else i % 3), f"n{i // 40}") for i in range(240))


def test_repeats_and_empty_batches(spark, points_table):
    t = points_table
    assert t.read() is None and t.upsert(many(spark, 0)) == [] and t.append_new(many(spark, 0)) == [] and t.count() == 0
    t.append_new(points(spark, [("a", "1"), ("a", "2")]))
    assert rows(t.read()) == [("a", "2", "old")]
    t.upsert(points(spark, [("a", "2"), ("a", "1")], "changed"))
    assert t.read().where("point_id = 'a'").count() == 1
    with pytest.raises(CollectionMismatch, match="point_id"):
        t.upsert(points(spark, [("b", "1"), (None, "3")]))
    with pytest.raises(CollectionMismatch, match="dimensions"):
        t.upsert(points(spark, [("b", "1")]).withColumn("vector", F.array(F.lit(1.0))))


@pytest.mark.parametrize("n", [1000])
def test_one_percent_reads_and_writes_one_percent(spark, n):
    t = PointsTable(spark, f"{scratch_root(spark)}/points-{uuid.uuid4().hex}")
    t.ensure(2, buckets=256)
    t.upsert(many(spark, n))
    before = t.read().inputFiles()
    written = t.upsert(many(spark, n, "changed", 100))
    assert len(written) <= n // 100 and len(set(t.read().inputFiles()) - set(before)) <= 4 * len(written)
    assert t.read().where("note = 'changed'").count() == n // 100 and t.count() == n


def test_a_tag_is_read_from_its_files_alone(spark, points_table):
    t = points_table
    tagged = many(spark, 300).withColumn("tags", F.when(F.col("point_id").isin("p7", "p130"), F.array(F.lit("rare"), F.lit("x"))).when(F.col("point_id") == "p8", F.lit(None)).otherwise(F.array(F.lit("x"))))
    t.upsert(tagged.withColumn("source", F.when(F.col("source") == "2", "a/b c%d").otherwise(F.col("source"))))
    ids = lambda df: sorted(r.point_id for r in df.collect())
    rare = t.read_tagged(["rare"])
    assert ids(rare) == ["p130", "p7"] and len(rare.inputFiles()) <= 2 < len(t.read().inputFiles())
    assert len(ids(t.read_tagged(["x"]))) == 299 and ids(t.read_tagged(["none"])) == [] and t.read_tagged(["rare", "none"]).count() == 2
    t.upsert(points(spark, [("p7", "1")], "changed"))  # its tags are now x alone
    t.append_new(points(spark, [("q", "1")]).withColumn("tags", F.array(F.lit("rare"))))
    rare = t.read_tagged(["rare"])
    assert ids(rare) == ["p130", "q"] and len(rare.inputFiles()) <= 2
