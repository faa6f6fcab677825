"""Rejects, progress, live roll-ups and seen ids across batches, restarts and repeats."""

import json
import shutil

from pyspark.sql import functions as F

from minutebook.operators import rollups
from minutebook.sources.keyed import KeyedTable
from minutebook.streaming import live


def put(path, name, text):
    path.mkdir(parents=True, exist_ok=True)
    (path / name).write_text(text)


def day(date, *ids):
    return json.dumps({"date": date, "data": [{"id": i, "number": f"n{i}"} for i in ids]}, indent=1)


def forget_commit(checkpoint, batch):
    """What a crash between the sinks and the commit of a batch leaves behind."""
    for name in (f"commits/{batch}", f"commits/.{batch}.crc"):
        if (checkpoint / name).exists():
            (checkpoint / name).unlink()


def test_rejects_and_days_are_stored_once(spark, tmp_path):
    source, cp = tmp_path / "in", tmp_path / "cp"
    store = live.MeetingStore(spark, str(tmp_path / "out"))
    assert store.next_day("1990-01-01") == "1990-01-01"
    put(source, "1994-01-03.json", day("1994-01-03", 1, 2))
    put(source, "1994-01-04.json", day("1994-01-04"))
    put(source, "broken.json", '{"date": "1994-01-05", "data": [{')
    put(source, "1994-01-06.json", json.dumps({"data": [{"id": 9}]}, indent=1))
    live.ingest_meetings(spark, str(source), store, str(cp))
    for _ in range(2):
        assert sorted((r.date, r.pos, r.id) for r in store.items.read().collect()) == [("1994-01-03", 0, 1), ("1994-01-03", 1, 2), ("1994-01-06", 0, 9)]
        assert [(r.file_name, r._corrupt[:22]) for r in store.rejects.read().collect()] == [("broken.json", '{"date": "1994-01-05",')]
        assert sorted((r.date, r["items"]) for r in store.days.read().collect()) == [("1994-01-03", 2), ("1994-01-04", 0), ("1994-01-06", 1)]
        forget_commit(cp, 0)
        live.ingest_meetings(spark, str(source), store, str(cp))
    assert store.next_day("1990-01-01") == "1994-01-07" and store.days.version() == 1
    put(source, "1994-01-08.json", day("1994-01-08"))
    live.ingest_meetings(spark, str(source), store, str(cp))
    assert store.next_day("1990-01-01") == "1994-01-09" and store.rejects.read().count() == 1


def test_live_timeline_equals_the_roll_up(spark, tmp_path):
    kind = "date string, category string, type_name string"
    rows = [(f"{1990 + k % 4}-0{k % 6 + 1}-1{k % 3}", "ADOPTED" if k % 3 else "FILED", f"T{k % 2}") for k in range(60)] + [(None, "FILED", "T0")]
    cp, table = tmp_path / "cp", live.timeline_table(spark, str(tmp_path / "out"), buckets=4)
    for part in (rows[30:45], rows[:10], rows[45:], rows[10:30]):  # days in no order, a restart before each part
        spark.createDataFrame(part, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(kind).parquet(str(tmp_path / "in"))
        live.timeline_stream(stream, table, str(cp))
    whole = spark.createDataFrame([r for r in rows if r[0]], kind)
    want = rollups.timeline(whole, whole.select("date"))
    order = ["period", "total_items", "meetings", "actions", "types"]
    assert [tuple(r) for r in live.timeline_of(table).select(order).orderBy("period").collect()] == \
        [tuple(r) for r in want.select(order).orderBy("period").collect()]
    forget_commit(cp, 3)
    live.timeline_stream(spark.readStream.schema(kind).parquet(str(tmp_path / "in")), table, str(cp))
    assert live.timeline_of(table).agg(F.sum("total_items")).first()[0] == 60


def test_a_batch_opens_no_bucket_without_its_keys(spark, tmp_path):
    kind = "id long, title string"
    table = KeyedTable(spark, str(tmp_path / "out"), ["id"], spark.createDataFrame([], kind).schema, buckets=16)
    write = lambda rows: spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    go = lambda: live.store_unseen(spark.readStream.schema(kind).parquet(str(tmp_path / "in")), table, str(tmp_path / "cp"), "title")
    write([(i, f"a{i}") for i in range(300)])
    go()
    folders = {r["bucket"]: r["folder"] for r in table._folders(1)}
    own = {r[0] for r in spark.createDataFrame([(5,), (777,)], "id long").select(table._bucket(16)).collect()}
    for b, f in folders.items():  # whoever opens another bucket fails
        if b not in own:
            shutil.move(str(tmp_path / "out" / f), str(tmp_path / f"aside{b}"))
    write([(5, "seen"), (777, "z"), (777, "b"), (None, "no key")])
    go()
    for b, f in folders.items():
        if b not in own:
            shutil.move(str(tmp_path / f"aside{b}"), str(tmp_path / "out" / f))
    got = {r.id: r.title for r in table.read().collect()}
    assert len(got) == 301 and got[5] == "a5" and got[777] == "b"
