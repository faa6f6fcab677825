"""Meetings within terms, against a count one by one; a term makes a row a year, none for a meeting."""

import random

from minutebook.operators.joins import tenure_meetings


def test_equals_count_one_by_one(spark):
    rnd = random.Random(3)
    day = lambda: f"{rnd.randint(1995, 2001)}-{rnd.randint(1, 12):02d}-{rnd.randint(1, 28):02d}"
    days = [day() for _ in range(300)]
    terms = [(f"m{rnd.randint(0, 30)}", day() if rnd.random() < 0.95 else None, day() if rnd.random() < 0.8 else None,
              "President" if rnd.random() < 0.1 else "District 1") for _ in range(120)]
    last = max(days)
    want = {n: set() for n, *_ in terms}
    for n, start, stop, office in terms:
        if office != "President" and start:
            want[n] |= {d for d in days if start <= d <= (stop or max(last, start))}
    roster = spark.createDataFrame(terms, "name string, start_date string, end_date string, office string")
    found = tenure_meetings(roster, spark.createDataFrame([(d,) for d in days], "date string"))
    assert {r[0]: r[1] for r in found.collect()} == {n: len(s) for n, s in want.items()}


def test_no_row_for_a_meeting(spark):
    terms = spark.createDataFrame([(f"m{i}", "1995-01-01", "2000-12-31", "District 1") for i in range(50)],
                                  "name string, start_date string, end_date string, office string")
    meetings = spark.sql("SELECT CAST(d AS STRING) AS date FROM (SELECT explode(sequence(DATE '1995-01-01', DATE '2000-12-31')) AS d)")
    found = tenure_meetings(terms, meetings)
    assert {r[1] for r in found.collect()} == {2192}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "count(distinct" not in plan
