"""Bindings of joins, roll-ups and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from minutebook.functions import legislation as leg, sponsors as sp
from minutebook.operators import joins, ranking, reports, rollups, sets
from minutebook.operators import dedupe as dd
from minutebook.operators.examples import pair_examples
from minutebook.operators.pairs import duplicate_pair_report
from minutebook.plans.fixtures import fixture, lit, table
from minutebook.plans.registry import query
from minutebook.plans.text_queries import (
    COMMITTEED, DONATIONS_SQL, PAPER_SQL, SETTLEMENTS_SQL, SPONSORED, donation_rows, items, known, papers,
    settlement_rows, sql_difference, sql_squeeze, sql_translate)
from minutebook.functions import text as tx


def prepared(spark, sf):
    return rollups.prepared(items(spark, sf))


def meetings(spark, sf):
    return fixture(spark, sf, "meetings")


# --- joins ------------------------------------------------------------------

DOCS_SQL = """
SELECT id * 2 AS doc_id, number AS "FormalNumber" FROM legis_items
UNION ALL SELECT id + 5, number FROM legis_items WHERE id % 4 = 0 UNION ALL SELECT id, NULL FROM legis_items WHERE id % 7 = 0"""


def api_docs(spark, sf):
    i = fixture(spark, sf, "legis_items")
    n = F.col("number").alias("FormalNumber")
    return (i.select((F.col("id") * 2).alias("doc_id"), n)
            .unionByName(i.where("id % 4 = 0").select((F.col("id") + 5).alias("doc_id"), n))
            .unionByName(i.where("id % 7 = 0").select(F.col("id").alias("doc_id"), F.lit(None).cast("string").alias("FormalNumber"))))


ATTACHED_SQL = f"""
SELECT i.id, COALESCE(d.doc, i.old) AS doc_id, CASE WHEN d.doc IS NULL THEN 'unmatched' WHEN d.doc = i.old THEN 'already' ELSE 'updated' END AS doc_status
FROM (SELECT id, CASE WHEN id % 5 = 0 THEN 'none' ELSE number END AS number, CASE WHEN id % 2 = 0 THEN id * 2 END AS old FROM legis_items) i
LEFT JOIN (SELECT "FormalNumber" AS n, min(doc_id) AS doc FROM ({DOCS_SQL}) WHERE "FormalNumber" IS NOT NULL GROUP BY 1) d ON d.n = i.number"""


def attached(spark, sf):
    base = fixture(spark, sf, "legis_items") \
        .withColumn("number", F.when(F.col("id") % 5 == 0, "none").otherwise(F.col("number"))) \
        .withColumn("meetingDocId", F.when(F.col("id") % 2 == 0, F.col("id") * 2))
    return joins.attach_doc_ids(base, api_docs(spark, sf))


@query("j1_attach_doc_ids", ATTACHED_SQL)
def _(spark, sf):
    return attached(spark, sf).select("id", F.col("meetingDocId").alias("doc_id"), "doc_status")


@query("j1_match_report", f"SELECT doc_status, count(*) AS n FROM ({ATTACHED_SQL}) GROUP BY 1")
def _(spark, sf):
    return joins.doc_id_report(attached(spark, sf))


@query("j1_lookup_report", f"""
SELECT count(*) AS files, count(DISTINCT "FormalNumber") AS keys, sum(CAST("FormalNumber" IS NULL AS INT)) AS missing FROM ({DOCS_SQL})""")
def _(spark, sf):
    return joins.formal_number_report(api_docs(spark, sf))


TENURE_SQL = """
SELECT r.name, count(DISTINCT m.date) AS meetings_during_tenure
FROM (SELECT DISTINCT name FROM roster_terms) r
LEFT JOIN roster_terms t ON t.name = r.name AND t.office <> 'President'
LEFT JOIN meetings m ON m.date >= t.start_date AND (t.end_date IS NULL OR m.date <= t.end_date) GROUP BY r.name"""


@query("j4_tenure_meetings", TENURE_SQL)
def _(spark, sf):
    return joins.tenure_meetings(fixture(spark, sf, "roster_terms"), meetings(spark, sf))


COUNTS_SQL = "SELECT sponsor AS name, count(*) AS n FROM item_sponsors GROUP BY sponsor"
PROFILE_SQL = f"""
SELECT c.name, c.n, t.name IS NOT NULL AS is_known,
       round(CASE WHEN t.name IS NULL THEN NULL WHEN meetings_during_tenure > 0 THEN c.n / meetings_during_tenure ELSE 0 END, 9) AS avg_per_meeting
FROM ({COUNTS_SQL}) c LEFT JOIN ({TENURE_SQL}) t ON t.name = c.name"""


def profile(spark, sf):
    held = joins.tenure_meetings(fixture(spark, sf, "roster_terms"), meetings(spark, sf))
    return joins.sponsor_profile(joins.sponsor_counts(fixture(spark, sf, "item_sponsors")), held)


@query("j3_sponsor_profile", PROFILE_SQL)
def _(spark, sf):
    return profile(spark, sf).select("name", "n", "is_known", F.round("avg_per_meeting", 9).alias("avg_per_meeting"))


@query("j5_committee_counts", """
SELECT c.name, count(s.id) AS n, true AS active FROM (SELECT name FROM committees UNION ALL SELECT 'No such committee') c
LEFT JOIN item_sponsors s ON s.sponsor = c.name GROUP BY c.name""")
def _(spark, sf):
    dims = fixture(spark, sf, "committees")
    extra = dims.agg(F.lit("No such committee").alias("name"), F.lit(None).cast("string").alias("end_date"))
    return joins.committee_counts(dims.unionByName(extra), fixture(spark, sf, "item_sponsors")).select("name", "n", "active")


@query("j6_paper_type_analysis", f"""
SELECT paper_type, n, round(n * 100.0 / sum(n) OVER (), 1) AS percentage FROM (
  SELECT COALESCE(paper_type, 'Unknown') AS paper_type, count(*) AS n FROM ({PAPER_SQL}) GROUP BY 1)""")
def _(spark, sf):
    return joins.paper_type_analysis(papers(spark, sf))


def contained_sql(small_text: str) -> str:
    return f"""
WITH v AS (SELECT max(doc_id) AS doc_id, text, lang, source FROM docs_variants WHERE text <> '' GROUP BY text, lang, source)
SELECT doc_id, {small_text} AS text, lang, source FROM v
WHERE NOT EXISTS (SELECT 1 FROM v b WHERE b.lang = v.lang AND b.source = v.source AND b.doc_id <> v.doc_id AND contains(b.text, v.text))
UNION ALL SELECT doc_id, {small_text}, lang, source FROM docs_variants WHERE text = ''"""


@query("j7_substring_dedupe", contained_sql("md5(text)"))
def _(spark, sf):
    df = fixture(spark, sf, "docs_variants")
    return dd.dedupe_contained(df, number="source", text="text", order="doc_id", id_col="doc_id") \
        .withColumn("text", F.md5("text"))


@query("j8_duplicate_pairs", f"""
WITH p AS (
  SELECT a.text = b.text AS same_text, a.lang = b.lang AS same_lang,
         {sql_difference('a.text', 'b.text')} AS dt, {sql_difference('a.lang', 'b.lang')} AS dl
  FROM docs_variants a JOIN docs_variants b ON a.source = b.source AND a.doc_id < b.doc_id)
SELECT 'field' AS scope, concat('text_', dt) AS name, CAST(count(*) AS BIGINT) AS pairs FROM p WHERE NOT same_text GROUP BY dt
UNION ALL SELECT 'field', concat('lang_', dl), count(*) FROM p WHERE NOT same_lang GROUP BY dl
UNION ALL SELECT 'category', CASE WHEN same_text AND same_lang THEN 'no_differences' WHEN same_lang THEN concat('text_', dt)
   WHEN same_text THEN concat('lang_', dl) ELSE 'multiple_fields' END, count(*) FROM p GROUP BY 2""")
def _(spark, sf):
    return duplicate_pair_report(fixture(spark, sf, "docs_variants"), "source", ["text", "lang"]) \
        .withColumn("pairs", F.col("pairs").cast("long"))


@query("w3_pair_examples", f"""
WITH p AS (
  SELECT a.source AS number, a.doc_id AS a, b.doc_id AS b, a.text = b.text AS same_text, a.lang = b.lang AS same_lang,
         {sql_difference('a.text', 'b.text')} AS dt, {sql_difference('a.lang', 'b.lang')} AS dl
  FROM docs_variants a JOIN docs_variants b ON a.source = b.source AND a.doc_id < b.doc_id)
SELECT name, CAST(row_number() OVER (PARTITION BY name ORDER BY number, a, b) AS INT) AS sample_no, number, a, b FROM (
  SELECT *, CASE WHEN same_text AND same_lang THEN 'no_differences' WHEN same_lang THEN concat('text_', dt)
    WHEN same_text THEN concat('lang_', dl) ELSE 'multiple_fields' END AS name FROM p)
QUALIFY sample_no <= 3""")
def _(spark, sf):
    return pair_examples(fixture(spark, sf, "docs_variants"), "source", ["text", "lang"], "doc_id")


@query("j12_calendar_years", """
SELECT y.year // 10 * 10 AS decade, y.year, count(m.date) AS meetings, count(m.date) > 0 AS available
FROM (SELECT unnest(range(min(CAST(substr(date, 1, 4) AS INT)) // 10 * 10, max(CAST(substr(date, 1, 4) AS INT)) // 10 * 10 + 10)) AS year FROM meetings) y
LEFT JOIN meetings m ON CAST(substr(m.date, 1, 4) AS INT) = y.year GROUP BY y.year""")
def _(spark, sf):
    return joins.calendar_years(meetings(spark, sf))


@query("j12_calendar_months", """
SELECT concat('1995-', lpad(CAST(k AS VARCHAR), 2, '0')) AS period, strftime(make_date(1995, CAST(k AS INT), 1), '%B') AS label, count(m.date) AS meetings
FROM (SELECT unnest(range(1, 13)) AS k) LEFT JOIN meetings m ON substr(m.date, 1, 7) = concat('1995-', lpad(CAST(k AS VARCHAR), 2, '0')) GROUP BY k""")
def _(spark, sf):
    return joins.calendar_months(meetings(spark, sf), 1995)


@query("w7_first_wins", f"""
SELECT "FormalNumber", doc_id FROM ({DOCS_SQL}) WHERE "FormalNumber" IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY "FormalNumber" ORDER BY doc_id) = 1""")
def _(spark, sf):
    return joins.first_wins(api_docs(spark, sf).where("FormalNumber IS NOT NULL"), "FormalNumber", ["doc_id"]) \
        .select("FormalNumber", "doc_id")


# --- roll-ups ---------------------------------------------------------------

def timeline_sql(width: int, where: str = "true") -> str:
    return f"""
WITH c AS (SELECT substr(date, 1, {width}) AS period, category, type_name, date FROM items WHERE {where}),
m AS (SELECT substr(date, 1, {width}) AS period, count(DISTINCT date) AS meetings FROM meetings WHERE {where} GROUP BY 1),
a AS (SELECT period, string_agg(concat(category, '=', n), '|' ORDER BY category) AS actions, sum(n) AS total_items FROM (SELECT period, category, count(*) AS n FROM c GROUP BY 1, 2) GROUP BY 1),
t AS (SELECT period, string_agg(concat(k, '=', n), '|' ORDER BY k) AS types FROM (SELECT period, COALESCE(type_name, 'Unknown') AS k, count(*) AS n FROM c GROUP BY 1, 2) GROUP BY 1)
SELECT m.period, COALESCE(total_items, 0) AS total_items, meetings, actions, types FROM m LEFT JOIN a ON a.period = m.period LEFT JOIN t ON t.period = m.period"""


def flat(column):
    return F.array_join(F.transform(F.map_entries(column), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), "|")


def timeline(spark, sf, **kw):
    df = rollups.timeline(prepared(spark, sf), meetings(spark, sf), **kw)
    return df.withColumn("actions", flat("actions")).withColumn("types", flat("types"))


@query("a1_rollup_timeline", timeline_sql(4))
def _(spark, sf):
    return timeline(spark, sf)


@query("a1_rollup_months", timeline_sql(7, "date >= '1994-01-01' AND date <= '1996-12-31'"))
def _(spark, sf):
    return timeline(spark, sf, group_by="month", start="1994-01-01", end="1996-12-31")


@query("a1_summary", "SELECT count(*) AS total_items, (SELECT count(*) FROM meetings) AS total_meetings FROM legis_items")
def _(spark, sf):
    return rollups.summary(fixture(spark, sf, "legis_items"), meetings(spark, sf))


@query("a1_distributions", """
SELECT measure, "key", n, round(n * 100.0 / sum(n) OVER (PARTITION BY measure), 1) AS percentage FROM (
  SELECT 'action' AS measure, category AS "key", count(*) AS n FROM items GROUP BY 2
  UNION ALL SELECT 'type', COALESCE(type_name, 'Unknown'), count(*) FROM items GROUP BY 2)""")
def _(spark, sf):
    p = prepared(spark, sf)
    return (rollups.distribution(p, "category").withColumn("measure", F.lit("action"))
            .unionByName(rollups.distribution(p, "type_name").withColumn("measure", F.lit("type"))))


@query("a2_council_terms", """
SELECT concat(s, '-', s + 3) AS label, s AS start, s + 3 AS "end", 1998 BETWEEN s AND s + 3 AS is_current
FROM (SELECT unnest(range(lo - (lo - 2) % 4, hi + 1, 4)) AS s
      FROM (SELECT min(CAST(substr(date, 1, 4) AS INT)) AS lo, max(CAST(substr(date, 1, 4) AS INT)) AS hi FROM meetings))""")
def _(spark, sf):
    return rollups.terms_spanned(meetings(spark, sf), as_of_year=1998)


@query("a3_hierarchy", """
WITH d AS (SELECT CAST(substr(date, 1, 4) AS INT) AS year, substr(date, 1, 7) AS month, date, count(*) AS n FROM legis_items GROUP BY 1, 2, 3),
t AS (SELECT year - (year - 2) % 4 AS term, * FROM d)
SELECT term, year, month, date, sum(n) AS total_items, count(*) AS meeting_days,
       CASE GROUPING(term, year, month, date) WHEN 15 THEN 'all' WHEN 7 THEN 'term' WHEN 3 THEN 'year' WHEN 1 THEN 'month' ELSE 'date' END AS level
FROM t GROUP BY ROLLUP (term, year, month, date)""")
def _(spark, sf):
    return rollups.hierarchy(fixture(spark, sf, "legis_items"))


@query("a3_drill_down", """
SELECT 'all' AS level, concat(s, '-', s + 3) AS value, (SELECT count(*) FROM legis_items i WHERE CAST(substr(i.date, 1, 4) AS INT) BETWEEN s AND s + 3) AS total_items,
  (SELECT count(*) FROM meetings m WHERE CAST(substr(m.date, 1, 4) AS INT) BETWEEN s AND s + 3) AS meetings
FROM (SELECT unnest(range(lo - (lo - 2) % 4, hi + 1, 4)) AS s
      FROM (SELECT min(CAST(substr(date, 1, 4) AS INT)) AS lo, max(CAST(substr(date, 1, 4) AS INT)) AS hi FROM meetings))
UNION ALL SELECT 'term', CAST(y AS VARCHAR), (SELECT count(*) FROM legis_items i WHERE substr(i.date, 1, 4) = CAST(y AS VARCHAR)),
  (SELECT count(*) FROM meetings m WHERE substr(m.date, 1, 4) = CAST(y AS VARCHAR)) FROM (SELECT unnest(range(1994, 1998)) AS y)
UNION ALL SELECT 'year', p, (SELECT count(*) FROM legis_items i WHERE substr(i.date, 1, 7) = p), (SELECT count(*) FROM meetings m WHERE substr(m.date, 1, 7) = p)
  FROM (SELECT concat('1995-', lpad(CAST(unnest(range(1, 13)) AS VARCHAR), 2, '0')) AS p)
UNION ALL SELECT 'month', m.date, (SELECT count(*) FROM legis_items i WHERE i.date = m.date), 1 FROM meetings m WHERE starts_with(m.date, '1995-06')""")
def _(spark, sf):
    base, held = fixture(spark, sf, "legis_items"), meetings(spark, sf)
    out = None
    for level, value in (("all", None), ("term", "1994-1997"), ("year", "1995"), ("month", "1995-06")):
        part = rollups.drill_down(base, held, level, value).withColumn("level", F.lit(level))
        out = part if out is None else out.unionByName(part)
    return out


@query("a4_adoption_rate", """
SELECT CAST(floor(sum(CAST(starts_with(category, 'ADOPTED') AS INT)) * 100.0 / count(*) + 0.5) AS INT) AS adoption_rate,
       min(substr(date, 1, 4)) AS first_period, max(substr(date, 1, 4)) AS last_period FROM items""")
def _(spark, sf):
    return rollups.adoption_rate(prepared(spark, sf))


@query("a5_action_pivot", "SELECT substr(date, 1, 4) AS period, " + ", ".join(
    f"count(*) FILTER (WHERE category = '{c}') AS \"{c}\"" for c in leg.action_categories()) + " FROM items GROUP BY 1")
def _(spark, sf):
    return rollups.action_pivot(prepared(spark, sf))


@query("a6_dates_by_year", """
SELECT substr(date, 1, 4) AS year, string_agg(date, '|' ORDER BY date DESC) AS dates, count(*) AS date_count, sum(n) AS item_count
FROM (SELECT date, count(*) AS n FROM legis_items GROUP BY date) GROUP BY 1""")
def _(spark, sf):
    return rollups.dates_by_year(fixture(spark, sf, "legis_items")).withColumn("dates", F.array_join("dates", "|"))


@query("a7_sponsor_counts", COUNTS_SQL)
def _(spark, sf):
    return joins.sponsor_counts(fixture(spark, sf, "item_sponsors"))


@query("a8_final_action_counts", """
SELECT COALESCE(NULLIF("finalAction", ''), '(empty)') AS action, count(*) AS n FROM items GROUP BY 1""")
def _(spark, sf):
    return reports.final_action_counts(items(spark, sf))


def doubles(df, *cols):
    return df.withColumns({c: F.col(c).cast("double") for c in cols})


def total_sql(test: str) -> str:
    return f"CAST(COALESCE(sum(amount) FILTER (WHERE {test}), 0) AS DOUBLE)"


@query("a9_donation_summary", f"""
SELECT count(*) AS total_count,
  count(*) FILTER (WHERE donation_direction = 'accepted') AS accepted_count, {total_sql("donation_direction = 'accepted'")} AS accepted_total,
  count(*) FILTER (WHERE donation_direction = 'made') AS made_count, {total_sql("donation_direction = 'made'")} AS made_total,
  {total_sql("true")} AS grand_total,
  count(*) FILTER (WHERE donation_type = 'monetary') AS monetary_count, {total_sql("donation_type = 'monetary'")} AS monetary_total,
  count(*) FILTER (WHERE donation_type = 'in_kind') AS inkind_count, {total_sql("donation_type = 'in_kind'")} AS inkind_total
FROM ({DONATIONS_SQL})""")
def _(spark, sf):
    return doubles(reports.donation_summary(donation_rows(spark, sf)), "accepted_total", "made_total", "grand_total",
                   "monetary_total", "inkind_total")


IND, COURT = "settlement_category = 'individual_claim'", "settlement_category = 'court_litigation'"


@query("a10_settlement_summary", f"""
SELECT count(*) AS total_count, count(*) FILTER (WHERE {IND}) AS individual_count, {total_sql(IND)} AS individual_total,
  count(*) FILTER (WHERE {COURT}) AS court_count, {total_sql(COURT)} AS court_total, {total_sql("true")} AS grand_total
FROM ({SETTLEMENTS_SQL})""")
def _(spark, sf):
    return doubles(reports.settlement_summary(settlement_rows(spark, sf)), "individual_total", "court_total", "grand_total")


def amount_sql(group: str, source: str, median: bool) -> str:
    med = (f", (SELECT CAST(list_sort(list(b.amount))[count(*) // 2 + 1] AS DOUBLE) FROM ({source}) b "
           f"WHERE b.{group} = a.{group} AND b.amount <> 0) AS median") if median else ""
    return f"""
SELECT a.{group}, count(*) AS n, count(*) FILTER (WHERE COALESCE(amount, 0) <> 0) AS with_amount,
  CAST(COALESCE(sum(amount), 0) AS DOUBLE) AS total, CAST(max(amount) FILTER (WHERE amount <> 0) AS DOUBLE) AS max_amount,
  CASE WHEN count(*) FILTER (WHERE amount <> 0) > 0 THEN round(CAST(sum(amount) AS DOUBLE) / count(*) FILTER (WHERE amount <> 0), 2) END AS average{med}
FROM ({source}) a GROUP BY a.{group}"""


@query("a11_donation_report", amount_sql("donation_direction", DONATIONS_SQL, False))
def _(spark, sf):
    return doubles(reports.amount_report(donation_rows(spark, sf), "donation_direction"), "total", "max_amount", "average")


@query("a11_top_donors", f"""
SELECT 'donor' AS kind, * FROM (SELECT donor AS value, count(*) AS n FROM ({DONATIONS_SQL}) WHERE donor IS NOT NULL GROUP BY 1 ORDER BY n DESC, value LIMIT 15)
UNION ALL SELECT 'recipient', * FROM (SELECT recipient, count(*) AS n FROM ({DONATIONS_SQL}) WHERE recipient IS NOT NULL GROUP BY 1 ORDER BY n DESC, 1 LIMIT 15)""")
def _(spark, sf):
    d = donation_rows(spark, sf)
    return reports.top_values(d, "donor", 15).withColumn("kind", F.lit("donor")).unionByName(
        reports.top_values(d, "recipient", 15).withColumn("kind", F.lit("recipient")))


@query("a12_settlement_report", amount_sql("settlement_category", SETTLEMENTS_SQL, True))
def _(spark, sf):
    return doubles(reports.amount_report(settlement_rows(spark, sf), "settlement_category", median=True),
                   "total", "max_amount", "average", "median")


@query("a12_top_damage_types", f"""
SELECT damage_type AS value, count(*) AS n FROM ({SETTLEMENTS_SQL}) WHERE damage_type IS NOT NULL GROUP BY 1 ORDER BY n DESC, value LIMIT 10""")
def _(spark, sf):
    return reports.top_values(settlement_rows(spark, sf), "damage_type", 10)


@query("a13_filtered_totals", f"""
SELECT donation_direction, count(*) AS n, CAST(COALESCE(sum(amount), 0) AS DOUBLE) AS total FROM ({DONATIONS_SQL})
WHERE legislation_date >= '1995' GROUP BY 1""")
def _(spark, sf):
    from minutebook.operators.search import filter_donations
    return doubles(reports.filtered_totals(filter_donations(donation_rows(spark, sf), year_from=1995), "donation_direction"), "total")


@query("a13_admin_totals", f"""
SELECT count(*) FILTER (WHERE id % 5 <> 0) AS total, count(*) FILTER (WHERE id % 5 <> 0 AND donation_direction = 'accepted') AS accepted,
  count(*) FILTER (WHERE id % 5 <> 0 AND donation_direction = 'made') AS made, count(*) FILTER (WHERE id % 5 = 0) AS excluded FROM ({DONATIONS_SQL})""")
def _(spark, sf):
    from minutebook.operators.search import filter_donations_admin
    d = donation_rows(spark, sf).withColumn("excluded", F.col("id") % 5 == 0)
    return reports.admin_totals(d, filter_donations_admin(d))


def docs_by_source(spark, sf):
    return fixture(spark, sf, "docs_variants").select(F.col("doc_id").alias("id"), F.col("source").alias("number"),
                                                      F.col("lang").alias("date"), F.md5("text").alias("description"))


@query("a14_ids_per_number", """
SELECT source AS number, count(DISTINCT doc_id) AS ids, count(DISTINCT lang) AS dates, min(lang) AS first_date, max(lang) AS last_date
FROM docs_variants WHERE doc_id <> 0 GROUP BY source""")
def _(spark, sf):
    return dd.ids_per_number(docs_by_source(spark, sf))


@query("a14_report", """
SELECT count(*) AS numbers, sum(CAST(ids = 1 AS INT)) AS single_id, sum(CAST(ids > 1 AS INT)) AS multiple_ids, avg(ids) AS mean_ids,
  max(ids) AS max_ids, arg_min(number, (-ids, number)) AS max_number
FROM (SELECT source AS number, count(DISTINCT doc_id) AS ids FROM docs_variants WHERE doc_id <> 0 GROUP BY source)""")
def _(spark, sf):
    return dd.ids_per_number_report(docs_by_source(spark, sf))


@query("a14_histogram", """
SELECT ids, count(*) AS numbers FROM (SELECT source, count(DISTINCT doc_id) AS ids FROM docs_variants WHERE doc_id <> 0 GROUP BY source) GROUP BY ids""")
def _(spark, sf):
    return dd.ids_per_number_histogram(docs_by_source(spark, sf))


GROUPS_SQL = "SELECT count(*) AS copies FROM docs_variants GROUP BY text, lang, source"


@query("a15_exact_duplicate_report", f"""
SELECT sum(copies) AS total_items, count(*) AS unique_items, count(*) FILTER (WHERE copies > 1) AS duplicated,
  sum(copies - 1) AS removable, round(sum(copies) FILTER (WHERE copies > 1) / count(*) FILTER (WHERE copies > 1), 9) AS mean_copies, max(copies) AS max_copies
FROM ({GROUPS_SQL})""")
def _(spark, sf):
    return dd.exact_duplicate_report(fixture(spark, sf, "docs_variants"), "doc_id") \
        .withColumn("mean_copies", F.round("mean_copies", 9))


@query("a15_copies_histogram", f"SELECT copies, count(*) AS records FROM ({GROUPS_SQL}) GROUP BY copies")
def _(spark, sf):
    return dd.duplicate_histogram(fixture(spark, sf, "docs_variants"), "doc_id")


KW = reports.REPORT_KEYWORDS
PATTERN_SQL = f"""
SELECT *, CASE WHEN keyword IS NULL THEN 'NO_CLEAR_ACTION' WHEN contains(context, 'ROLL CALL VOTE') THEN 'ACTION_WITH_VOTE'
   WHEN contains(context, 'CONSENT') THEN 'ACTION_ON_CONSENT' ELSE 'ACTION_SIMPLE' END AS pattern
FROM (SELECT *, CASE {' '.join(f"WHEN keyword = '{k}' THEN trim(regexp_extract_all(up, '[A-Z\\s,;]*{k}[^.]*')[-1])" for k in KW)} END AS context
FROM (SELECT id, description, upper(trim(description)) AS up,
   CASE {' '.join(f"WHEN contains(upper(description), '{k}') THEN '{k}'" for k in KW)} END AS keyword FROM legis_items WHERE description <> ''))"""


@query("a16_action_keyword_report", f"""
WITH p AS ({PATTERN_SQL})
SELECT 'keyword' AS measure, keyword AS value, count(*) AS n FROM p WHERE keyword IS NOT NULL GROUP BY 2
UNION ALL SELECT 'pattern', pattern, count(*) FROM p GROUP BY 2
UNION ALL SELECT 'has_vote', CAST(contains(up, 'ROLL CALL VOTE') AS VARCHAR), count(*) FROM p GROUP BY 2
UNION ALL SELECT 'confidence', CASE WHEN pattern IN ('ACTION_WITH_VOTE', 'ACTION_ON_CONSENT') THEN 'high' WHEN pattern = 'ACTION_SIMPLE' THEN 'medium' ELSE 'low' END, count(*) FROM p GROUP BY 2""")
def _(spark, sf):
    return reports.action_keyword_report(fixture(spark, sf, "legis_items"))


@query("a16_action_context", f"SELECT id, keyword, context, pattern FROM ({PATTERN_SQL})")
def _(spark, sf):
    return reports.with_action_pattern(fixture(spark, sf, "legis_items")).select("id", "keyword", "context", "pattern")


@query("a17_sponsor_pattern_report", " UNION ALL ".join(
    f"SELECT {lit(p)} AS pattern, count(*) FILTER (WHERE regexp_matches(description, {lit('(?i)' + p)})) AS n FROM legis_items"
    for p in reports.SPONSOR_KEYWORDS) + f"""
UNION ALL SELECT 'any', count(*) FILTER (WHERE regexp_matches(description, {lit('(?i)' + tx.any_of(reports.SPONSOR_KEYWORDS))})) FROM legis_items
UNION ALL SELECT 'total', count(*) FROM legis_items""")
def _(spark, sf):
    return reports.sponsor_pattern_report(fixture(spark, sf, "legis_items"))


@query("a18_type_distribution", """
SELECT COALESCE(type_code, '') AS type_code, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 1) AS percentage FROM typed GROUP BY 1""")
def _(spark, sf):
    return reports.type_distribution(fixture(spark, sf, "legis_items"))


@query("a18_type_distribution_strict", f"""
SELECT COALESCE(NULLIF(regexp_extract(number, '{leg.STRICT_TYPE}', 1), ''), '') AS type_code, count(*) AS n,
       round(count(*) * 100.0 / sum(count(*)) OVER (), 1) AS percentage FROM legis_items GROUP BY 1""")
def _(spark, sf):
    return reports.type_distribution(fixture(spark, sf, "legis_items"), strict=True)


@query("a19_sponsor_span", """
SELECT sponsor AS name, min(date) AS first_date, max(date) AS last_date, count(*) AS n FROM item_sponsors GROUP BY 1""")
def _(spark, sf):
    return reports.sponsor_span(fixture(spark, sf, "item_sponsors"))


@query("a20_news_stats", """
SELECT count(*) AS total_news, count(*) FILTER (WHERE COALESCE(is_hidden, 0) = 0) AS visible_news, min(id) AS min_id, max(id) AS max_id,
  strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS earliest, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS latest FROM news""")
def _(spark, sf):
    return reports.news_stats(fixture(spark, sf, "news")).withColumns({
        c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("earliest", "latest")})


@query("a20_news_type_counts", """
SELECT 'visible' AS scope, type, count(*) AS n FROM news WHERE COALESCE(is_hidden, 0) = 0 GROUP BY type
UNION ALL SELECT 'all', type, count(*) FROM news GROUP BY type""")
def _(spark, sf):
    n = fixture(spark, sf, "news")
    return reports.news_type_counts(n).withColumn("scope", F.lit("visible")).unionByName(
        reports.news_type_counts(n, True).withColumn("scope", F.lit("all")))


@query("a23_change_report", """
SELECT 'description' AS "column", count(*) FILTER (WHERE cleaned <> description) AS n FROM acted
UNION ALL SELECT '(changed rows)', count(*) FILTER (WHERE cleaned <> description) FROM acted
UNION ALL SELECT '(checked rows)', count(*) FROM acted""")
def _(spark, sf):
    before = fixture(spark, sf, "legis_items")
    after = leg.extract_final_action(before).withColumn("description", F.col("cleaned"))
    return reports.change_report(before, after, ["description", "number"])


@query("a23_changes", """
SELECT i.id, 'description' AS "column", i.description AS old, p.description AS "new" FROM legis_items i JOIN patches p ON p.id = i.id""")
def _(spark, sf):
    from minutebook.operators.corrections import patch_items
    before = fixture(spark, sf, "legis_items")
    after = patch_items(before, fixture(spark, sf, "patches"), key=("id",))
    return reports.changes(before, after, ["number", "description"])


@query("a24_extraction_confidence", f"""
SELECT COALESCE(confidence, 'none') AS confidence, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 1) AS percentage
FROM ({SPONSORED}) GROUP BY 1""")
def _(spark, sf):
    return reports.extraction_confidence(sp.extract_sponsors(fixture(spark, sf, "legis_items")))


@query("a24_top_sponsors", f"""
SELECT name AS value, count(*) AS n FROM (SELECT unnest(names) AS name FROM ({SPONSORED}) WHERE confidence IS NOT NULL)
GROUP BY 1 ORDER BY n DESC, value LIMIT 20""")
def _(spark, sf):
    return reports.top_sponsors(sp.extract_sponsors(fixture(spark, sf, "legis_items")))


@query("a24_committee_report", f"""
SELECT committee, committee_known, count(*) AS n FROM ({COMMITTEED}) WHERE committee IS NOT NULL GROUP BY 1, 2""")
def _(spark, sf):
    found = sp.extract_committee(fixture(spark, sf, "legis_items"), known(spark, sf)).where("committee IS NOT NULL")
    return found.groupBy("committee", "committee_known").agg(F.count("*").alias("n"))


MERGED = ["Supplier#000000001", "Supplier#000000002", "Supplier#000000004"]


@query("a26_merge_preview", f"""
SELECT sum(n) AS affected, arg_min(name, (-n, name)) AS canonical, count(*) AS variations FROM ({COUNTS_SQL})
WHERE name IN ({', '.join(lit(m) for m in MERGED)})""")
def _(spark, sf):
    return reports.merge_preview(joins.sponsor_counts(fixture(spark, sf, "item_sponsors")), MERGED)


# --- de-duplication ---------------------------------------------------------

@query("w1_dedupe_exact", "SELECT min(doc_id) AS doc_id, md5(text) AS text, lang, source FROM docs_variants GROUP BY text, lang, source")
def _(spark, sf):
    return dd.dedupe_exact(fixture(spark, sf, "docs_variants"), "doc_id").withColumn("text", F.md5("text"))


NORMED = sql_squeeze(sql_translate("text", tx.FULL_FOLD))


@query("w2_dedupe_normalized", f"""
SELECT min(doc_id) AS doc_id, md5({NORMED}) AS text, lang, source FROM docs_variants GROUP BY {NORMED}, lang, source""")
def _(spark, sf):
    return dd.dedupe_normalized(fixture(spark, sf, "docs_variants"), "doc_id").withColumn("text", F.md5("text"))


QUOTES = "[‘’“”–—]"


@query("w2_normalized_causes", f"""
WITH n AS (SELECT *, {NORMED} AS nt FROM docs_variants),
k AS (SELECT nt, lang, source, min(doc_id) AS kid FROM n GROUP BY 1, 2, 3),
p AS (SELECT n.doc_id, n.text AS t, b.text AS kt FROM n JOIN k ON k.nt = n.nt AND k.lang = n.lang AND k.source = n.source JOIN n b ON b.doc_id = k.kid)
SELECT count(*) AS total, (SELECT count(*) FROM k) AS kept, count(*) - (SELECT count(*) FROM k) AS removed,
  COALESCE(sum(CAST(t <> kt AND (regexp_matches(t, '{QUOTES}') OR regexp_matches(kt, '{QUOTES}')) AS INT)), 0) AS quote_removals,
  COALESCE(sum(CAST(t <> kt AND (t <> {sql_squeeze('t')} OR kt <> {sql_squeeze('kt')}) AS INT)), 0) AS whitespace_removals FROM p""")
def _(spark, sf):
    return dd.normalized_causes(fixture(spark, sf, "docs_variants"), "doc_id")


# --- order, samples, sets ---------------------------------------------------

@query("w3_samples_per_group", f"""
SELECT pattern, id, row_number() OVER (PARTITION BY pattern ORDER BY id) AS sample_no FROM ({PATTERN_SQL})
QUALIFY row_number() OVER (PARTITION BY pattern ORDER BY id) <= 5""")
def _(spark, sf):
    p = reports.with_action_pattern(fixture(spark, sf, "legis_items")).select("pattern", "id")
    return ranking.samples_per_group(p, "pattern", ["id"], 5)


@query("w4_page_ranges", """
SELECT package_id, seq, page_start, COALESCE(lead(page_start) OVER (PARTITION BY package_id ORDER BY seq), 40) - 1 AS page_end FROM bookmarks""")
def _(spark, sf):
    b = fixture(spark, sf, "bookmarks")
    totals = b.select("package_id").distinct().withColumn("total_pages", F.lit(40))
    return ranking.page_ranges(b, totals).select("package_id", "seq", "page_start", "page_end")


def numbered_lines(spark, sf):
    """Lines of the documents; every fourth one opens a record."""
    d = table(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    mark = F.concat((F.floor(F.col("pos") / 4) + 1).cast("string"), F.lit(" "),
                    F.lpad((F.col("doc_id") % 100000).cast("string"), 5, "0"), F.lit(" "), "line")
    return d.withColumn("line", F.when(F.col("pos") % 4 == 1, mark).otherwise(F.col("line")))


@query("w5_group_lines", f"""
WITH s AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents),
m AS (SELECT doc_id, pos, CASE WHEN pos % 4 = 1 THEN concat(CAST(pos // 4 + 1 AS VARCHAR), ' ', lpad(CAST(doc_id % 100000 AS VARCHAR), 5, '0'), ' ', line) ELSE line END AS line FROM s),
t AS (SELECT doc_id, pos, {sql_squeeze('line')} AS t FROM m),
r AS (SELECT *, sum(CAST(regexp_matches(t, '^\\d+ \\d{{5}} ') AS INT)) OVER (PARTITION BY doc_id ORDER BY pos) AS record FROM t)
SELECT doc_id, record, md5(string_agg(t, ' ' ORDER BY pos)) AS text FROM r WHERE record > 0 AND t <> '' GROUP BY 1, 2""")
def _(spark, sf):
    return ranking.group_lines(numbered_lines(spark, sf), "doc_id", "pos", "line").withColumn("text", F.md5("text"))


@query("w6_failure_cutoff", """
SELECT min(id) AS cutoff_id FROM (
  SELECT event_id * 4 + coalesce(user_id, 0) % 4 AS id,
         sum(CAST(event_type = 'error' AS INT)) OVER (ORDER BY event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS run
  FROM events)
WHERE run = 4""")
def _(spark, sf):
    # Every event is a try, at ids with gaps: a run of misses goes on over ids that were never tried.
    tries = table(spark, sf, "events").select(
        F.expr("event_id * 4 + coalesce(user_id, 0) % 4").alias("id"), (F.col("event_type") == "error").alias("miss"))
    return ranking.failure_cutoff(tries, 4, bucket=1000)


@query("w8_page", "SELECT id, date FROM legis_items ORDER BY date DESC, id LIMIT 50 OFFSET 100")
def _(spark, sf):
    return ranking.page(fixture(spark, sf, "legis_items"), [F.col("date").desc(), F.col("id").asc()], 3, 50).select("id", "date")


@query("w8_page_count", "SELECT count(*) AS total, CAST(ceil(count(*) / 50.0) AS BIGINT) AS pages FROM legis_items")
def _(spark, sf):
    return ranking.page_count(fixture(spark, sf, "legis_items"), 50)


@query("w8_page_after", "SELECT id, date FROM legis_items WHERE id < 1000 ORDER BY id DESC LIMIT 20")
def _(spark, sf):
    return ranking.page_after(fixture(spark, sf, "legis_items"), "id", 1000, 20).select("id", "date")


def sort_sql(order: str) -> str:
    return f"SELECT id, row_number() OVER (ORDER BY {order}) AS pos FROM ({DONATIONS_SQL})"


def placed(df):
    """All rows of an ordering with their place."""
    return ranking.positions(df.select("id"))


@query("w9_sort_amount_desc", sort_sql("amount DESC NULLS LAST, id"))
def _(spark, sf):
    return placed(ranking.sort_rows(donation_rows(spark, sf), "amount", descending=True))


@query("w9_sort_donor_asc", sort_sql("donor ASC NULLS LAST, id"))
def _(spark, sf):
    return placed(ranking.sort_rows(donation_rows(spark, sf), "donor"))


@query("w9_sort_admin", sort_sql("donor ASC NULLS FIRST, id"))
def _(spark, sf):
    return placed(ranking.sort_rows_admin(donation_rows(spark, sf), "donor"))


@query("w9_sort_roster", f"""
SELECT name AS id, row_number() OVER (ORDER BY avg_per_meeting DESC NULLS LAST, name) AS pos FROM ({PROFILE_SQL})""")
def _(spark, sf):
    return placed(ranking.sort_roster(profile(spark, sf).withColumn("avg_per_meeting", F.round("avg_per_meeting", 9)), "avg-desc")
                  .withColumn("id", F.col("name")))


@query("w9_sort_list", f"SELECT name AS id, row_number() OVER (ORDER BY n, name) AS pos FROM ({COUNTS_SQL})")
def _(spark, sf):
    counts = joins.sponsor_counts(fixture(spark, sf, "item_sponsors"))
    return placed(ranking.sort_roster(counts, "count-asc", ranking.LIST_ORDERS).withColumn("id", F.col("name")))


@query("w10_sample_endings", """
SELECT right(trim(description, ' '), 100) AS ending FROM legis_items WHERE COALESCE(description, '') <> ''
ORDER BY md5(concat('42-', id)), id LIMIT 20""")
def _(spark, sf):
    return ranking.sample_endings(fixture(spark, sf, "legis_items"), "description", 20)


@query("w11_office_members", """
SELECT office, name, start_date, CASE WHEN office = 'President' THEN 'President' ELSE 'Districts' END AS section,
  dense_rank() OVER (PARTITION BY office ORDER BY start_date, name) - 1 AS ordinal FROM roster_terms""")
def _(spark, sf):
    return ranking.office_members(fixture(spark, sf, "roster_terms")).select(
        "office", "name", "start_date", "section", F.col("ordinal").cast("long").alias("ordinal"))


@query("w11_members_without_office", "SELECT s_name AS name, concat(CAST(1990 + s_suppkey % 9 AS VARCHAR), '-01-01') AS first_start FROM supplier WHERE s_suppkey % 3 = 0")
def _(spark, sf):
    terms = table(spark, sf, "supplier").select(
        F.col("s_name").alias("name"), F.concat((F.col("s_suppkey") % 9 + 1990).cast("string"), F.lit("-01-01")).alias("start_date"),
        F.when(F.col("s_suppkey") % 3 != 0, "President").alias("office"))
    return ranking.members_without_office(terms)


@query("u1_distinct_numbers", "SELECT DISTINCT number FROM legis_items WHERE number <> ''")
def _(spark, sf):
    return sets.distinct_numbers(fixture(spark, sf, "legis_items"))


NEW_NEWS = "SELECT id, concat(type, ' (new)') AS type FROM news WHERE id % 3 = 0 UNION ALL SELECT id + 1000000, type FROM news WHERE id % 50 = 0"


def new_news(spark, sf):
    n = fixture(spark, sf, "news").select("id", "type")
    return n.where("id % 3 = 0").withColumn("type", F.concat("type", F.lit(" (new)"))).unionByName(
        n.where("id % 50 = 0").withColumn("id", F.col("id") + 1000000))


@query("u2_keyed_union", f"SELECT * FROM ({NEW_NEWS}) UNION ALL SELECT id, type FROM news WHERE id NOT IN (SELECT id FROM ({NEW_NEWS}))")
def _(spark, sf):
    return sets.keyed_union(fixture(spark, sf, "news").select("id", "type"), new_news(spark, sf))


@query("u2_keyed_union_report", f"""
SELECT CASE WHEN id IN (SELECT id FROM news) THEN 'updated' ELSE 'new' END AS outcome, count(*) AS n FROM ({NEW_NEWS}) GROUP BY 1""")
def _(spark, sf):
    return sets.keyed_union_report(fixture(spark, sf, "news"), new_news(spark, sf))


@query("u3_id_set", "SELECT DISTINCT l_orderkey AS id FROM lineitem UNION SELECT o_orderkey FROM orders WHERE o_orderkey % 3 <> 0")
def _(spark, sf):
    a = table(spark, sf, "lineitem").select(F.concat(F.lit(" "), F.col("l_orderkey").cast("string")).alias("value"))
    o = F.col("o_orderkey")
    b = table(spark, sf, "orders").select(F.when(o % 6 == 0, F.concat(F.lit("# "), o.cast("string")))
                                          .when(o % 3 == 0, F.concat(F.lit("id"), o.cast("string")))
                                          .otherwise(o.cast("string")).alias("value"))
    return sets.id_set(a, b)
