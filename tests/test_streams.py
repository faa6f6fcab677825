import json

from minutebook.streaming import ingest as ig

NEWS = "id long, title string"


def drop(path, name, rows):
    path.mkdir(parents=True, exist_ok=True)
    (path / name).write_text("\n".join(json.dumps({"id": i, "title": t}) for i, t in rows))


def stream(spark, path):
    return spark.readStream.schema(NEWS).option("maxFilesPerTrigger", 1).json(str(path))


def upserts(spark, root):
    return ig.DeltaTable(spark, str(root), spark.createDataFrame([], NEWS + ", seq long").schema, ig.newest_by_id(["title"]))


def rows(t):
    return sorted((r.id, r.title) for r in t.read().collect())


def numbered(spark, path):
    return spark.readStream.schema(NEWS + ", seq long").option("maxFilesPerTrigger", 1).json(str(path))


def put(path, name, rows):
    path.mkdir(parents=True, exist_ok=True)
    (path / name).write_text("\n".join(json.dumps({"id": i, "title": t, "seq": q}) for i, t, q in rows))


def test_upserts_survive_restart_and_second_stream(spark, tmp_path):
    src, target, cp = tmp_path / "in", upserts(spark, tmp_path / "out"), str(tmp_path / "cp")
    assert rows(target) == []
    put(src, "a.json", [(1, "a", 1), (2, "b", 5), (0, "none", 1)])
    ig.upsert_stream(numbered(spark, src), target, cp)
    assert rows(target) == [(1, "a"), (2, "b")]
    put(src, "b.json", [(2, "older", 4), (3, "c", 1), (3, "d", 2)])
    ig.upsert_stream(numbered(spark, src), target, cp)
    ig.upsert_stream(numbered(spark, src), target, cp)  # nothing new
    assert rows(target) == [(1, "a"), (2, "b"), (3, "d")]
    # A second stream with a checkpoint of its own starts at batch 0 again and hides nothing.
    put(tmp_path / "more", "c.json", [(1, "A", 9), (4, "e", 1)])
    ig.upsert_stream(numbered(spark, tmp_path / "more"), target, str(tmp_path / "cp2"))
    assert rows(target) == [(1, "A"), (2, "b"), (3, "d"), (4, "e")]
    # A repeated batch replaces its own rows only.
    again = spark.createDataFrame([(4, "e", 1), (1, "A", 9)], NEWS + ", seq long")
    target.write(again, ig.stream_source(spark, str(tmp_path / "cp2")), 0)
    assert rows(target) == [(1, "A"), (2, "b"), (3, "d"), (4, "e")]
    assert rows(target.compact(str(tmp_path / "small"))) == rows(target)


def test_counts_do_not_depend_on_batches(spark, tmp_path):
    data = [(k, "xyz"[k % 3]) for k in range(12)]
    got = []
    for parts in (1, 4):
        src = tmp_path / f"in{parts}"
        for p in range(parts):
            drop(src, f"{p}.json", data[p::parts])
        t = ig.DeltaTable(spark, str(tmp_path / f"out{parts}"), spark.createDataFrame([], "title string, n long").schema,
                          ig.summed(["title"]))
        ig.rollup_table_stream(stream(spark, src), t, ["title"], str(tmp_path / f"cp{parts}"))
        got.append(sorted((r.title, r.n) for r in t.read().collect()))
    assert got[0] == got[1] == [("x", 4), ("y", 4), ("z", 4)]


def test_seen_rows_are_skipped(spark, tmp_path):
    drop(tmp_path / "in", "a.json", [(1, "a"), (1, "a2"), (2, "b")])
    drop(tmp_path / "in", "b.json", [(2, "late"), (3, "c")])
    t = ig.DeltaTable(spark, str(tmp_path / "out"), spark.createDataFrame([], NEWS).schema, ig.first_by_key("id", ["title"]))
    ig.skip_seen_stream(stream(spark, tmp_path / "in"), t, "id", str(tmp_path / "cp"))
    assert [i for i, _ in rows(t)] == [1, 2, 3] and t.deltas().count() == 3


def test_ingest_meetings(spark, tmp_path):
    day = tmp_path / "in" / "1994"
    day.mkdir(parents=True)
    (day / "1994-01-03.json").write_text(json.dumps({"date": "1994-01-03", "data": [{"id": 1, "number": "n"}]}, indent=1))
    (day / "1994-01-04.json").write_text(json.dumps({"date": "1994-01-04", "data": []}))
    for _ in range(2):
        ig.ingest_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert [(r.date, r.id, r.year) for r in got] == [("1994-01-03", 1, 1994)]
