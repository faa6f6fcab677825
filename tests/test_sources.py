import json

from minutebook.operators.tables import materialize
from minutebook.sources import documents as docs, meetings as mt, reports as rp


def put(path, value):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(value if isinstance(value, str) else json.dumps(value, indent=1))


def meeting_files(root):
    for day, n in (("1994-01-03", 2), ("1994-02-01", 0), ("1995-05-06", 1)):
        put(root / day[:4] / f"{day}.json", {"date": day, "data": [
            {"id": k, "number": f"n{k}", "description": "d", "sponsors": ["A"]} for k in range(n)]})
    put(root / "1994" / "1994-03-01.json", "{ not json")
    put(root / "1994" / "1994-01-03.json.bak", "{}")


def test_read_meetings(spark, tmp_path):
    meeting_files(tmp_path)
    path = str(tmp_path)
    rows = mt.read_meetings(spark, path).collect()
    assert sorted((r.date, r.pos, r.id) for r in rows if r.id is not None) == [
        ("1994-01-03", 0, 0), ("1994-01-03", 1, 1), ("1995-05-06", 0, 0)]
    assert {r.date for r in rows} == {"1994-01-03", "1994-02-01", "1995-05-06"}
    assert [r.date for r in mt.read_meetings(spark, path, "1995-01-01", "1995-12-31").collect()] == ["1995-05-06"]
    assert {(r.date, r["items"]) for r in mt.read_meeting_dates(spark, path).collect()} == {
        ("1994-01-03", 2), ("1994-02-01", 0), ("1995-05-06", 1)}
    assert [r.file_name for r in mt.read_rejects(spark, path).collect()] == ["1994-03-01.json"]


def test_stored_meetings_round_trip(spark, tmp_path):
    """A day larger than a record, with and without given positions, next to a downloaded file."""
    path = str(tmp_path / "m")
    df = spark.createDataFrame([(k, d, f"n{k}", 24 - k) for d in ("1994-01-03", "1995-02-01") for k in range(25)],
                               "id long, date string, number string, pos int")
    for given in (df, df.drop("pos")):
        mt.write_meetings(given, path, chunk=5)
        rows = mt.read_meetings(spark, path).collect()
        assert len(rows) == 50 and {(r.date, r.pos) for r in rows} == {(d, k) for d in ("1994-01-03", "1995-02-01") for k in range(25)}
        if "pos" in given.columns:
            assert all(r.pos == 24 - r.id for r in rows)
    meeting_files(tmp_path / "m")
    assert mt.read_meetings(spark, path).where("id is not null").count() == 53
    for bounds, n in ((("1994-01-01", "1994-12-31"), 27), (("1995-01-01", None), 26), ((None, "1994-06-01"), 27), (("2001-01-01", "2002-01-01"), 0)):
        assert mt.read_meetings(spark, path, *bounds).where("id is not null").count() == n


def test_committees_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(f"c{k}", "1990-01-01", None) for k in range(7)], 'name string, start string, end string')
    mt.replace_committees(rows, str(tmp_path / "c"))
    assert mt.read_committees(spark, str(tmp_path / "c")).count() == 7
    put(tmp_path / "c" / "broken.json", "[nothing")
    from minutebook.schemas import COMMITTEES
    assert mt.read_committees(spark, str(tmp_path / "c")).count() == 7
    assert [r.file_name for r in mt.read_rejects(spark, str(tmp_path / "c"), COMMITTEES).collect()] == ["broken.json"]


def test_scratch_needs_a_shared_folder_on_a_cluster(spark, monkeypatch):
    import pytest
    from minutebook import session

    class Cluster:
        class sparkContext:
            master, applicationId = "yarn", "a"
    monkeypatch.setattr(session, "shared_folder", lambda _: None)
    with pytest.raises(RuntimeError):
        session.scratch_dir(Cluster, "x")


def test_dimensions(spark, tmp_path):
    put(tmp_path / "r" / "councilmembers.json", {"councilmembers": [
        {"name": "A", "terms": [{"start": "1994-01-03", "end": None, "office": "Post 1"}]}, {"name": "B", "terms": []}]})
    assert [r.asDict() for r in mt.read_terms(spark, str(tmp_path / "r")).collect()] == [
        {"name": "A", "pos": 0, "start_date": "1994-01-03", "end_date": None, "office": "Post 1"}]
    put(tmp_path / "d" / "meeting_doc_00123.json", {"FormalNumber": "14-R-1", "other": 1})
    assert [(r.doc_id, r.FormalNumber) for r in mt.read_api_docs(spark, str(tmp_path / "d")).collect()] == [(123, "14-R-1")]


def test_text_corpus(spark, tmp_path):
    put(tmp_path / "20r3001.txt", "line one\nline two")
    put(tmp_path / "20r3002.txt", " # PDF already contains searchable text\n")
    got = {r.stem: (r.text, r.char_count) for r in docs.read_text_corpus(spark, str(tmp_path)).collect()}
    assert got == {"20r3001": ("line one\nline two", 17), "20r3002": ("", 0)}


def test_details(spark, tmp_path):
    put(tmp_path / "7.json", {"content": {"text": "a"}})
    put(tmp_path / "8.json", {"results": [{"id": 80, "content": {"text": "b", "links": [{"text": "x", "href": "y"}]}}]})
    assert {(r.id, r.content.text) for r in docs.read_details(spark, str(tmp_path)).collect()} == {(7, "a"), (80, "b")}


def test_report_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "q", b\nc', "extra"), (2, None, "e")], "id long, text string, other string")
    rp.write_report(df, ["text", "id"], str(tmp_path / "j"), str(tmp_path / "c"))
    back = rp.read_report_csv(spark, str(tmp_path / "c"), "text string, id long").collect()
    assert {(r.id, r.text) for r in back} == {(1, 'a "q", b\nc'), (2, None)}
    assert spark.read.json(str(tmp_path / "j")).columns == ["id", "other", "text"]


def test_materialize_uses_shared_folder(spark, tmp_path, monkeypatch):
    from minutebook import session
    monkeypatch.setattr(session, "shared_folder", lambda _: str(tmp_path / "shared"))
    df = materialize(spark.range(5), "n")
    assert df.count() == 5 and all(str(tmp_path / "shared") in f for f in df.inputFiles())
