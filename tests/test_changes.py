import pytest
from pyspark.sql import functions as F

from minutebook.operators import corrections as co, joins, pages as pg, ranking, rollups, sets


def test_patch_items(spark):
    base = spark.createDataFrame([("d1", 1, ["A"], "x", "f"), ("d1", 2, None, "y", None)],
                                 "date string, id long, sponsors array<string>, description string, finalAction string") \
        .withColumn("sponsorConfidence", F.lit("high"))
    patches = spark.createDataFrame([("d1", 1, ["B"], None, 1), ("d1", 1, None, "new", 2), ("d9", 1, ["Z"], None, 3)],
                                    "date string, id long, sponsors array<string>, description string, seq int")
    got = {r.id: (r.sponsors, r.description, r.finalAction, r.sponsorConfidence) for r in co.patch_items(base, patches).collect()}
    assert got == {1: (["B"], "new", "f", "manual"), 2: (None, "y", None, "high")}
    assert [r.date for r in co.unmatched(base, patches).collect()] == ["d9"]


def test_merge_sponsors_is_idempotent(spark):
    df = spark.createDataFrame([(1, ["A", "B", "A2", "B"]), (2, ["C", "C"]), (3, None)], "id long, sponsors array<string>") \
        .withColumn("sponsorConfidence", F.lit("high"))
    once = co.merge_sponsors(df, ["A", "A2"], "A")
    assert {r.id: (r.sponsors, r.touched) for r in once.collect()} == {1: (["A", "B"], True), 2: (["C", "C"], False), 3: (None, False)}
    twice = co.merge_sponsors(once.drop("touched"), ["A", "A2"], "A")
    assert {r.id: r.sponsors for r in twice.collect()} == {r.id: r.sponsors for r in once.collect()}
    with pytest.raises(ValueError):
        co.merge_sponsors(df, ["A"], "A")


def test_upsert_and_fields(spark):
    base = spark.createDataFrame([(1, "a", "n1", 0), (2, "b", "n2", None)], "id long, title string, admin_notes string, is_hidden int")
    batch = spark.createDataFrame([(2, "B"), (3, "C"), (None, "D"), (0, "E")], "id long, title string")
    got = {r.id: (r.title, r.admin_notes) for r in co.upsert_news(base, batch).collect()}
    assert got == {1: ("a", "n1"), 2: ("B", "n2"), 3: ("C", None)}
    assert {r.outcome: r.n for r in co.upsert_report(base, batch).collect()} == {"updated": 1, "imported": 1, "skipped": 2}
    twice = batch.unionByName(spark.createDataFrame([(3, "C2")], "id long, title string"))
    assert {r.outcome: r.n for r in co.upsert_report(base, twice).collect()} == {"updated": 2, "imported": 1, "skipped": 2}
    gifts = spark.createDataFrame([(1, 5.0, "A", "p"), (2, 6.0, "B", "q")], "id long, amount double, donor string, purpose string")
    edits = spark.createDataFrame([(1, "amount", "about 9"), (1, "donor", "Z"), (2, "amount", "1,000"), (2, "purpose", None)],
                                  "id long, field string, value string")
    assert [tuple(r) for r in co.patch_donations(gifts, edits).orderBy("id").collect()] == [(1, 5.0, "A", "p"), (2, 1000.0, "B", None)]
    flags = spark.createDataFrame([(1, "toggle"), (2, "false")], "id long, hidden string")
    assert {r.id: r.is_hidden for r in co.set_news_fields(base, flags).collect()} == {1: 1, 2: 0}


def test_joins_and_windows(spark):
    terms = spark.createDataFrame([("A", "1994-01-01", "1994-12-31", "Post 1"), ("A", "1994-06-01", None, "Post 2"),
                                   ("B", "1994-01-01", None, "President"), ("C", "2050-01-01", None, "x")],
                                  "name string, start_date string, end_date string, office string")
    meetings = spark.createDataFrame([("1994-03-01",), ("1994-07-01",), ("1996-01-01",), ("1993-01-01",)], "date string")
    assert {r["name"]: r.meetings_during_tenure for r in joins.tenure_meetings(terms, meetings).collect()} == {"A": 3, "B": 0, "C": 0}
    tries = spark.createDataFrame([(k, k in (3, 4, 9, 10, 11)) for k in range(15)], "id long, miss boolean")
    for bucket in (4, 5, 10, 100):
        assert ranking.failure_cutoff(tries, 3, bucket=bucket).first().cutoff_id == 11
    assert ranking.failure_cutoff(tries, 4, bucket=5).first().cutoff_id is None
    gaps = spark.createDataFrame([(k, k in (1, 2, 4, 5)) for k in (0, 1, 2, 4, 5, 9)], "id long, miss boolean")
    for bucket in (4, 5, 100):  # 3 was skipped, not a hit
        assert ranking.failure_cutoff(gaps, 4, bucket=bucket).first().cutoff_id == 5
    with pytest.raises(ValueError):
        ranking.failure_cutoff(gaps, 5, bucket=4)
    some = spark.range(100).selectExpr("id", "concat('text ', id) AS t")
    one, two = (ranking.sample_endings(some.repartition(n), "t", 5).collect() for n in (1, 7))
    assert one == two
    placed = ranking.positions(some.orderBy(F.col("id").desc()))
    assert {(r.id, r.pos) for r in placed.collect()} == {(k, 100 - k) for k in range(100)}
    t = rollups.council_terms(spark).collect()
    assert (t[0].label, t[-1].label, [x.label for x in t if x.is_current]) == ("1982-1985", "2026-2029", ["2022-2025"])
    ids = spark.createDataFrame([(" 7 ",), ("# 8",), ("x",), ("7",), ("",)], "value string")
    assert [r.id for r in sets.id_set(ids).collect()] == [7]


HISTORY = """<div class="LegiFileSection MeetingHistory"><table class="MeetingHistory">
<tr class="x HeaderRow"><td class="Date">Jan 1 <a onclick='OpenWindow("/SplitView.aspx?Video=1")'>Video</a></td><td class="Group">Full</td></tr>
<tr class="VoteResultRow"><td><table class="VoteRecord"><tr><td>RESULT:</td><td>FILED</td></tr><tr><td>RESULT:</td><td>ADOPTED</td></tr></table></td></tr>
<tr class="HeaderRow"><td class="Date">Jan 2</td></tr></table></div>"""


def test_pages(spark):
    html = """<div>Jan 5 <a href="/a.PDF"> Deck </a><!-- no --><script>var a='<a href="/x.pdf">';</script></div>
    <table><tr><th>K:</th><td>1</td></tr><tr><td><table><tr><td>in</td></tr></table></td></tr></table><a>none</a><a href="http://h/b.htm">b</a>"""
    df = spark.createDataFrame([(1, html), (2, None), (3, HISTORY)], "page_id long, html string")
    assert [(r.text, r.href) for r in pg.extract_links(df, "http://s").where("page_id = 1").collect()] == [
        ("Deck", "http://s/a.PDF"), ("b", "http://h/b.htm")]
    f = pg.extract_file_links(df, "http://s").collect()
    assert [(r.title, r.url, r.file_type, r.date_context) for r in f] == [("Deck", "http://s/a.PDF", "PDF", "Jan 5Deck")]
    t = pg.extract_tables(df).where("page_id = 1").first().tables
    assert t == [[["K:", "1"], ["in", "in"], ["in"]], [["in"]]]
    h = sorted(pg.meeting_history(df, "http://s").collect(), key=lambda r: r.meeting_no)
    assert [(r.date, r.group, r.type, r.video_link, r.votes) for r in h] == [
        ("Jan 1", "Full", "", "http://s/SplitView.aspx?Video=1", {"RESULT": "ADOPTED"}), ("Jan 2", "", "", None, {})]
    pairs = spark.createDataFrame([(["a:", "1", "b", "", "a", "2", "odd"],)], "c array<string>")
    assert pairs.select(pg.last_wins(pg.pair_cells(F.col("c"))).alias("m")).first().m == {"a": "2"}
