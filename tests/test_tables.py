"""Keyed tables: parts, concurrent writers, batches, compaction, old versions."""

from pyspark.sql import functions as F

from graphloom.operators.occurrence import contained_entries
from graphloom.sources.tables import TableStore


def rows(spark, *values):
    return spark.createDataFrame(list(values), "id long, a string, version int")


def test_writers_of_one_version(spark, tmp_path):
    store = TableStore(spark, str(tmp_path), buckets=4)
    store.merge("t", rows(spark, *[(i, "old", 1) for i in range(20)]), ["id"], "version")
    first = store.prepare_merge("t", rows(spark, (1, "x", 2), (30, "new", 2)), ["id"], "version")
    second = store.prepare_merge("t", rows(spark, (1, "y", 3), (2, None, 3)), ["id"], "version")
    first.commit()
    second.commit()
    got = {r["id"]: r["a"] for r in store.read("t").collect()}
    assert (got[1], got[2], got[30], len(got)) == ("y", "old", "new", 21)
    assert {r["a"] for r in store.read("t", 1).collect()} == {"old"}
    assert store.delete_ids("t", rows(spark, (1, "", 0), (99, "", 0)).select("id"), "id") == 1
    assert store.vacuum("t", keep=1) > 0 and store.read("t").count() == 20


def test_batches_are_published_once_and_compacted(spark, tmp_path):
    store = TableStore(spark, str(tmp_path), buckets=2)
    for batch in (0, 1, 1, 0, 2):
        store.append("t", rows(spark, (batch, f"b{batch}", batch), (9, f"b{batch}", batch)), ["id"], batch=("s", batch))
    assert store.read("t").count() == 6
    assert store.compact("t", "version", files=1) > 0
    assert {(r["id"], r["a"]) for r in store.read("t").collect()} == {(0, "b0"), (1, "b1"), (2, "b2"), (9, "b2")}
    assert store.compact("t", "version", files=1) == 0


def test_partitions(spark, tmp_path):
    store = TableStore(spark, str(tmp_path), buckets=2)
    df = spark.createDataFrame([("m/1", "c", 1), ("m/1", "d", 1), ("é 2", "c", 1)], "m string, c string, v int")
    store.merge("t", df, ["m", "c"], "v", ("m",))
    assert store.read_partition("t", "m/1").count() == 2
    store.drop_partition("t", "m/1")
    assert [tuple(r) for r in store.read("t").collect()] == [("é 2", "c", 1)]
    store.write("t", df.limit(0))
    assert store.read("t").count() == 0


def test_occurrences_in_blocks(spark, monkeypatch):
    from graphloom.operators import occurrence

    monkeypatch.setattr(occurrence, "TEXT_SLICE", 3)
    monkeypatch.setattr(occurrence, "ENTRY_BLOCK", 2)
    texts = ["abcab", "", "ab", "xyz", "🙂ab", "aaa", None]
    entries = ["ab", "b", "abc", "z", "", "aa", "🙂", None, "nowhere"]
    t = spark.createDataFrame([(x,) for x in texts], "t string")
    e = spark.createDataFrame([(x,) for x in entries], "e string")
    got = {tuple(r) for r in contained_entries(t, "t", e, "e").collect()}
    assert got == {(x, y) for x in texts for y in entries if x is not None and y is not None and y in x}
    assert contained_entries(t, "t", e.where(F.lit(False)), "e").count() == 0
