"""Keyed tables: versions, keys, failures, replays, schema changes."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from minutebook.sources.keyed import Conflict, KeyedTable, KeyViolation

SCHEMA = "id long, name string, n long"


@pytest.fixture
def stored(spark, tmp_path):
    made = KeyedTable(spark, str(tmp_path / "t"), ["id"], spark.createDataFrame([], SCHEMA).schema, buckets=8)
    made.upsert(spark.createDataFrame([(i, f"a{i}", i) for i in range(200)], SCHEMA))
    return made


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def folders(table, version):
    return {r["bucket"]: r["folder"] for r in table._folders(version)}


def test_only_touched_buckets_are_written_again(spark, stored):
    before, old = folders(stored, 1), stored.read()
    want = rows(old)
    assert stored.upsert(spark.createDataFrame([(5, "new", 1), (5, "newer", 2), (900, "added", 3)], SCHEMA), "n") == 2
    after = folders(stored, 2)
    assert 1 <= sum(before[b] != after[b] for b in before) <= 2
    assert rows(stored.read()) == sorted([r for r in want if r[0] != 5] + [(5, "newer", 2), (900, "added", 3)])
    assert rows(old) == want == rows(stored.read(1))  # readers of the old version go on


def test_a_change_that_fails_leaves_no_trace(spark, stored):
    want = rows(stored.read())
    batch = spark.createDataFrame([(1, "x", 1), (2, "y", 1)], SCHEMA)
    with pytest.raises(KeyViolation, match="unique"):
        stored.change(batch, lambda old, new: old.unionByName(new))
    with pytest.raises(KeyViolation, match="complete"):
        stored.upsert(spark.createDataFrame([(None, "x", 1)], SCHEMA))
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO|boom|failed"):
        stored.change(batch, lambda old, new: old.withColumn("n", F.col("n") / F.raise_error(F.lit("boom")).cast("long")))
    with pytest.raises(ValueError, match="does not touch"):
        stored.change(spark.createDataFrame([(1, "x", 1)], SCHEMA), lambda old, new: spark.createDataFrame([(i, "x", 1) for i in range(50)], SCHEMA))
    assert stored.version() == 1 and rows(stored.read()) == want
    assert stored.upsert(batch) == 2 and (1, "x", 1) in rows(stored.read())


def test_inserts_deletes_and_newest(spark, stored):
    stored.insert_new(spark.createDataFrame([(3, "no", 0), (300, "b", 2), (300, "a", 1)], SCHEMA), "n")
    stored.delete(spark.createDataFrame([(i,) for i in range(100)], "id long"))
    stored.keep_newest(spark.createDataFrame([(150, "old", 10), (151, "new", 1000)], SCHEMA), "n")
    got = {r.id: r.name for r in stored.read().collect()}
    assert sorted(got) == list(range(100, 200)) + [300] and got[300] == "a" and got[150] == "a150" and got[151] == "new"
    stored.delete(stored.read().select("id"))
    assert stored.read().count() == 0 and stored.version() == 5


def test_a_told_batch_is_stored_once(spark, stored):
    batch = spark.createDataFrame([(7, "first", 1)], SCHEMA)
    assert stored.upsert(batch, source="s", batch_id=3) == 2
    assert stored.upsert(spark.createDataFrame([(7, "again", 1)], SCHEMA), source="s", batch_id=3) == 2
    assert stored.upsert(spark.createDataFrame([(8, "other", 1)], SCHEMA), source="t", batch_id=3) == 3
    assert {r.name for r in stored.read().where("id in (7, 8)").collect()} == {"first", "other"}


def test_of_two_racing_changes_one_is_refused(spark, stored, monkeypatch):
    rival = KeyedTable(spark, stored.root, ["id"], stored.schema)

    def how(old, new):
        if stored.version() == 1:
            rival.upsert(spark.createDataFrame([(1, "rival", 1)], SCHEMA))
        return old.join(new.select("id"), "id", "left_anti").unionByName(new)

    outcome = None
    try:
        stored.change(spark.createDataFrame([(1, "mine", 1)], SCHEMA), how)
        outcome = "mine"
    except Conflict:
        outcome = "rival"
    got = stored.read().where("id = 1").collect()
    assert len(got) == 1 and got[0].name == outcome and stored.version() == 2


def test_columns_may_be_added_but_not_changed(spark, stored):
    wider = spark.createDataFrame([], SCHEMA + ", extra string").schema
    later = KeyedTable(spark, stored.root, ["id"], wider)
    later.upsert(spark.createDataFrame([(1, "one", 1, "e")], wider))
    got = {r.id: r.extra for r in later.read().collect()}
    assert got[1] == "e" and got[2] is None and len(got) == 200
    for bad, why in (("id long, name string", "lacks"), ("id long, name string, n string, extra string", "is stored as bigint")):
        with pytest.raises(ValueError, match=why):
            KeyedTable(spark, stored.root, ["id"], spark.createDataFrame([], bad).schema).delete(spark.createDataFrame([(1,)], "id long"))
    with pytest.raises(ValueError, match="key columns"):
        KeyedTable(spark, stored.root, ["other"], wider)


def test_keys_of_two_columns_in_a_stream(spark, tmp_path):
    from minutebook.streaming import ingest as ig
    kind = "day string, id long, seq long, what string"
    for k, part in enumerate([[("a", 1, 5, "x"), ("a", 2, 1, "y"), (None, 9, 9, "lost")], [("a", 1, 4, "late"), ("b", 1, 1, "z")], [("a", 2, 7, "w")]]):
        spark.createDataFrame(part, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        table = KeyedTable(spark, str(tmp_path / "out"), ["day", "id"], spark.createDataFrame([], kind).schema, buckets=4)
        stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        ig.upsert_keyed_stream(stream, table, "seq", str(tmp_path / "cp"))
        assert table.version() == k + 1
    assert rows(table.read()) == [("a", 1, 5, "x"), ("a", 2, 7, "w"), ("b", 1, 1, "z")]
    assert len(glob.glob(os.path.join(tmp_path, "out", "data", "*"))) == 3
