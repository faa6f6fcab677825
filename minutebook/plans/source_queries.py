"""Bindings of readers and writers: fixtures are stored and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from minutebook.functions import donations as don
from minutebook.operators import joins, reports, sets
from minutebook.plans.fixtures import fixture, table
from minutebook.plans.registry import query
from minutebook.plans.text_queries import DONATIONS_SQL, donation_rows, items
from minutebook.session import scratch_dir
from minutebook.sources import documents as docs, meetings as mt, reports as rp
from minutebook.sources.keyed import KeyedTable, KeyViolation


@query("s1_read_meetings", """
SELECT id, date, pos, number, description FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY date ORDER BY id) - 1 AS INT) AS pos FROM legis_items)
WHERE date >= '1993-06-01' AND date <= '1997-03-31'""")
def _(spark, sf):
    path = scratch_dir(spark, "meetings")
    mt.write_meetings(fixture(spark, sf, "legis_items"), path)
    return mt.read_meetings(spark, path, "1993-06-01", "1997-03-31").select("id", "date", "pos", "number", "description")


@query("s2_write_items", """
SELECT id, date, number, CAST(substr(date, 1, 4) AS INT) AS year FROM legis_items
WHERE substr(date, 1, 4) BETWEEN '1994' AND '1996'""")
def _(spark, sf):
    path = scratch_dir(spark, "items")
    mt.write_items(fixture(spark, sf, "legis_items"), path)
    return mt.read_items(spark, path, 1994, 1996).select("id", "date", "number", "year")


@query("s3_read_roster", "SELECT name, start_date, end_date, office FROM roster_terms")
def _(spark, sf):
    path = scratch_dir(spark, "roster")
    terms = fixture(spark, sf, "roster_terms")
    nested = terms.groupBy("name").agg(F.sort_array(F.collect_list(F.struct(
        F.col("start_date").alias("start"), F.col("end_date").alias("end"), "office"))).alias("terms"))
    nested.select(F.array(F.struct("name", "terms")).alias("councilmembers")).write.json(path)
    return mt.read_terms(spark, path).select("name", "start_date", "end_date", "office")


@query("s3_read_committees", """SELECT name, '1990-01-01' AS "start", end_date AS "end" FROM committees""")
def _(spark, sf):
    path = scratch_dir(spark, "committees")
    rows = fixture(spark, sf, "committees").select("name", F.lit("1990-01-01").alias("start"), F.col("end_date").alias("end"))
    mt.replace_committees(rows, path)
    return mt.read_committees(spark, path)


@query("s4_read_text_corpus", """
SELECT CASE WHEN doc_id % 10 = 0 THEN '' ELSE md5(text) END AS body,
       CASE WHEN doc_id % 10 = 0 THEN 0 ELSE length(text) END AS char_count, doc_id FROM documents""")
def _(spark, sf):
    marked = table(spark, sf, "documents").withColumn(
        "text", F.when(F.col("doc_id") % 10 == 0, F.lit(" # PDF already contains searchable text\n")).otherwise(F.col("text")))
    out = docs.clean_corpus(marked.select("doc_id", "text", F.length("text").alias("size")))
    # A text that was empty from the start is a text like any other; '' stands for a blanked placeholder only.
    return out.select(F.when((F.col("text") == "") & (F.col("size") > 0), "").otherwise(F.md5("text")).alias("body"),
                      F.col("char_count").cast("long").alias("char_count"), "doc_id")


@query("s4_read_text_files", """
SELECT concat('lang=', lang) AS folder, md5(line) AS line, count(*) AS n
FROM (SELECT lang, unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY 1, 2""")
def _(spark, sf):
    """Every line of every file, by the folder of the file."""
    # Every file is read whole; their size is bounded by their number of records.
    path = scratch_dir(spark, "texts")
    table(spark, sf, "documents").select("lang", F.col("text").alias("value")).write.option("maxRecordsPerFile", 200).partitionBy("lang").text(path)
    lines = F.split(F.regexp_replace("text", "\\n$", ""), "\n", -1)
    return (docs.read_text_corpus(spark, path).select("folder", F.explode(lines).alias("line"))
            .groupBy("folder", F.md5("line").alias("line")).agg(F.count("*").alias("n")))


@query("s5_read_api_docs", """SELECT id % 40 AS doc_id, count(*) AS n, min(number) AS first_number FROM legis_items GROUP BY 1""")
def _(spark, sf):
    path = scratch_dir(spark, "api")
    name = F.concat(F.lit("meeting_doc_"), F.lpad((F.col("id") % 40).cast("string"), 5, "0"))
    rows = fixture(spark, sf, "legis_items").select(name.alias("doc"), F.col("number").alias("FormalNumber"))
    rows.write.partitionBy("doc").json(path)
    return (mt.read_api_docs(spark, path).groupBy("doc_id")
            .agg(F.count("*").alias("n"), F.min("FormalNumber").alias("first_number")))


@query("s6_write_report", f"""
SELECT id, number, donation_direction, CAST(amount AS DOUBLE) AS amount, donor, recipient, description FROM ({DONATIONS_SQL})""")
def _(spark, sf):
    base = scratch_dir(spark, "report")
    rows = donation_rows(spark, sf)
    rp.write_report(rows, don.COLUMNS, base + "/json", base + "/csv")
    schema = rows.select(*don.COLUMNS).schema
    csv = rp.read_report_csv(spark, base + "/csv", schema)
    json = spark.read.schema(schema).json(base + "/json")
    return (csv.join(json.select("id"), "id", "left_semi")
            .select("id", "number", "donation_direction", F.col("amount").cast("double").alias("amount"),
                    "donor", "recipient", "description"))


def detail_results(spark, sf):
    """Scrape results: every 9th without id, every 4th failed."""
    p = table(spark, sf, "pages")
    return p.select(
        F.when(F.col("page_id") % 9 != 0, F.col("page_id")).alias("id"), "url",
        (F.col("page_id") % 4 != 0).alias("success"), F.lit("2024-01-01").alias("scraped_at"),
        F.struct(F.col("html").alias("text"), F.col("html").alias("html")).alias("content"))


@query("s7_read_details", """
SELECT page_id AS id, md5(html) AS html, md5(html) AS text FROM pages WHERE page_id % 9 <> 0""")
def _(spark, sf):
    path = scratch_dir(spark, "details")
    rows = detail_results(spark, sf).where("id IS NOT NULL")
    rows.where("id % 2 = 0").select("id", "content").write.json(path + "/a")
    rows.where("id % 2 = 1").select(F.array(F.struct("id", "content")).alias("results")).write.json(path + "/b")
    return docs.read_details(spark, path).select("id", F.md5("content.html").alias("html"), F.md5("content.text").alias("text"))


@query("s8_split_details", """
SELECT outcome, count(*) AS n FROM (
  SELECT CASE WHEN page_id % 9 = 0 OR page_id = 0 THEN 'skipped' WHEN page_id % 4 <> 0 THEN 'successful' ELSE 'failed' END AS outcome
  FROM pages) GROUP BY outcome""")
def _(spark, sf):
    return docs.detail_outcomes(detail_results(spark, sf))


@query("s8_kept_details", """
SELECT page_id AS id, url, md5(html) AS text FROM pages WHERE page_id % 9 <> 0 AND page_id % 4 <> 0""")
def _(spark, sf):
    path = scratch_dir(spark, "kept")
    docs.store_details(detail_results(spark, sf), path)
    return spark.read.parquet(path).select("id", "url", F.md5("content.text").alias("text"))


@query("s8_stored_detail", "SELECT page_id AS id, url FROM pages WHERE page_id = 7")
def _(spark, sf):
    path = scratch_dir(spark, "kept")
    docs.store_details(detail_results(spark, sf), path)
    return docs.stored_detail(spark, path, 7).select("id", "url")


@query("s9_read_run_log", """
SELECT event_id AS id, event_type AS status, 'msg' AS message, '2024-01-01 00:00:00' AS ts FROM events""")
def _(spark, sf):
    path = scratch_dir(spark, "log")
    fixture(spark, sf, "run_log").write.text(path)
    return docs.read_run_log(spark, path).withColumn("ts", F.col("ts").cast("string"))


@query("s9_latest_lines", """
SELECT event_id AS id, event_type AS status FROM events ORDER BY event_id DESC LIMIT 500""")
def _(spark, sf):
    return docs.latest(docs.parse_run_log(fixture(spark, sf, "run_log")), 500).select("id", "status")


@query("s9_app_log", """
SELECT event_id AS line, event_type AS level, concat('call took ', user_id, ' ms') AS message FROM events""")
def _(spark, sf):
    lines = table(spark, sf, "events").select(F.concat(
        F.lit("2024-01-05 10:00:00,123 "), "event_type", F.lit(": call took "), F.col("user_id").cast("string"),
        F.lit(" ms [in /srv/web.py:"), F.col("event_id").cast("string"), F.lit("]")).alias("value"))
    return docs.parse_app_log(lines).select(F.col("line").cast("long").alias("line"), "level", "message")


@query("s10_managed_tables", """
SELECT id, type, COALESCE(is_hidden, 0) = 1 AS hidden, content AS content_text, CAST(NULL AS VARCHAR) AS title FROM news""")
def _(spark, sf):
    path = scratch_dir(spark, "news")
    rows = fixture(spark, sf, "news").withColumnRenamed("content", "content_text")
    rp.write_table(rows, "news", path)
    return rp.read_table(spark, "news", path).select(
        "id", "type", F.coalesce("is_hidden", F.lit(False)).alias("hidden"), "content_text", "title")


@query("s10_all_tables", """
SELECT 'documents' AS name, count(*) AS n, count(*) AS filled FROM documents
UNION ALL SELECT 'news', count(*), count(type) FROM news
UNION ALL SELECT 'news_links', count(*), count(url) FROM pages
UNION ALL SELECT 'pp_packages', count(*), count(o_orderdate) FROM orders
UNION ALL SELECT 'pp_items', count(*), count(l_linenumber) FROM lineitem""")
def _(spark, sf):
    base = scratch_dir(spark, "tables")
    inputs = {
        "documents": (table(spark, sf, "documents").select(
            F.col("doc_id").cast("string").alias("paper_number"), F.col("text").alias("text_content")), "text_content"),
        "news": (fixture(spark, sf, "news"), "type"),
        "news_links": (table(spark, sf, "pages").select(F.col("page_id").alias("news_id"), F.col("url").alias("href")), "href"),
        "pp_packages": (table(spark, sf, "orders").select(
            F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").cast("string").alias("meeting_date")), "meeting_date"),
        "pp_items": (table(spark, sf, "lineitem").select(
            F.col("l_orderkey").alias("package_id"), F.col("l_linenumber").alias("row_num")), "row_num")}
    found = None
    for name, (rows, column) in inputs.items():
        rp.write_table(rows, name, f"{base}/{name}")
        one = rp.read_table(spark, name, f"{base}/{name}").agg(F.count("*").alias("n"), F.count(column).alias("filled"))
        one = one.select(F.lit(name).alias("name"), "n", "filled")
        found = one if found is None else found.unionByName(one)
    return found


@query("s10_keyed_upserts", """
SELECT l_orderkey AS id, l_linenumber AS line, CASE WHEN l_orderkey % 64 = 2 THEN l_partkey + 5 WHEN l_orderkey % 32 = 1 THEN 0 ELSE l_partkey END AS part
FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey DESC) AS rn FROM lineitem) WHERE rn = 1 AND l_orderkey % 64 <> 3""")
def _(spark, sf):
    """Two rounds of upserts and one of deletes; a change with repeated keys between them leaves no trace."""
    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"))
    stored = KeyedTable(spark, scratch_dir(spark, "keyed"), ["id", "line"], rows.schema, buckets=8)
    stored.upsert(rows, "part")
    stored.upsert(rows.where("id % 32 = 1").withColumn("part", F.lit(0).cast(rows.schema["part"].dataType)))
    try:
        stored.change(rows.where("id % 64 = 2"), lambda old, new: old.unionByName(new).unionByName(new))
        raise AssertionError("repeated keys were stored")
    except KeyViolation:
        pass
    stored.upsert(rows.where("id % 64 = 2").withColumn("part", F.col("part") + 5), "part")
    stored.delete(rows.where("id % 64 = 3"))
    return stored.read()


@query("s10_schema_versions", """
SELECT doc_id, lang, CASE WHEN doc_id % 3 = 0 THEN n_chars END AS n_chars, CASE WHEN doc_id % 3 = 0 THEN source END AS source FROM documents""")
def _(spark, sf):
    d, root = table(spark, sf, "documents"), scratch_dir(spark, "versions")
    first = d.select("doc_id", "lang")
    KeyedTable(spark, root, ["doc_id"], first.schema, buckets=8).upsert(first)
    later = d.where("doc_id % 3 = 0").select("doc_id", "lang", "n_chars", "source")
    KeyedTable(spark, root, ["doc_id"], later.schema).upsert(later)
    return KeyedTable(spark, root, ["doc_id"], later.schema).read()


@query("s11_write_values", "SELECT DISTINCT number AS value FROM legis_items")
def _(spark, sf):
    base = scratch_dir(spark, "values")
    rp.write_values(sets.distinct_numbers(fixture(spark, sf, "legis_items")), "number", base + "/t", base + "/j")
    text = spark.read.text(base + "/t")
    return text.join(spark.read.schema("value string").json(base + "/j"), "value", "left_semi")


@query("f13_skipped_ocr_docs", "SELECT doc_id AS stem FROM documents WHERE doc_id % 6 = 0 AND doc_id % 4 <> 0")
def _(spark, sf):
    d = table(spark, sf, "documents")
    corpus = d.select(F.col("doc_id").alias("stem"), F.when(
        F.col("doc_id") % 6 == 0, F.concat(F.lit("\n [OCR skipped on page 1]\n"), "text")).otherwise(F.col("text")).alias("text"))
    manifest = d.where("doc_id % 4 <> 0").select(F.col("doc_id").alias("stem"))
    return docs.skipped_ocr_docs(corpus, manifest).select("stem")


@query("a22_run_outcomes", """
SELECT outcome, count(*) AS n, round(count(*) * 100.0 / sum(count(*)) OVER (), 1) AS percentage
FROM (SELECT CASE event_type WHEN 'purchase' THEN 'downloaded' WHEN 'view' THEN 'exists' WHEN 'click' THEN 'not_found' ELSE 'error' END AS outcome FROM events)
GROUP BY outcome""")
def _(spark, sf):
    named = table(spark, sf, "events").select(F.concat(
        F.lit("2024-01-01 00:00:00 | ID "), F.lpad(F.col("event_id").cast("string"), 6, "0"), F.lit(" | "),
        F.when(F.col("event_type") == "purchase", "200").when(F.col("event_type") == "view", "exists")
        .when(F.col("event_type") == "click", "404").otherwise(F.col("event_type")), F.lit(" | msg")).alias("value"))
    return reports.run_outcomes(docs.parse_run_log(named))


@query("a22_ocr_outcomes", """
SELECT count(*) AS files, sum(length(text)) AS characters, sum(doc_id % 3) AS rotated_pages,
       sum(CAST(doc_id % 5 <> 0 AS INT)) AS successful FROM documents""")
def _(spark, sf):
    runs = table(spark, sf, "documents").select(
        F.length("text").alias("text_characters"), (F.col("doc_id") % 3).alias("rotation_corrected"),
        F.when(F.col("doc_id") % 5 != 0, "success").otherwise("failed").alias("status"))
    return reports.ocr_outcomes(runs)


@query("j2_corpus_metadata", """
SELECT t.stem, i.number AS legislation_number, i.date AS legislation_date, i.type_name AS legislation_type, i."finalAction" AS final_action
FROM (SELECT lower(replace(number, '-', '')) AS stem FROM legis_items UNION ALL SELECT concat('none', id) FROM legis_items WHERE tail(id)) t
LEFT JOIN (SELECT * FROM items QUALIFY row_number() OVER (PARTITION BY lower(replace(number, '-', '')) ORDER BY date, id) = 1) i
  ON lower(replace(i.number, '-', '')) = t.stem""".replace("WHERE tail(id)", "WHERE id % 10 = 3"))
def _(spark, sf):
    base = items(spark, sf).withColumn("pdfUrl", F.concat(
        F.lit("https://files.example.org/a/"), F.replace("number", F.lit("-"), F.lit("")), F.lit(".pdf")))
    base = base.withColumn("legislationDate", F.lit(None).cast("string")).withColumn("sponsors", F.lit(None).cast("array<string>"))
    # The same paper shows up again on a later day: the first day must win.
    again = base.withColumn("date", F.lit("2099-01-01")).withColumn("number", F.lit("later"))
    stems = fixture(spark, sf, "legis_items").select(F.lower(F.replace("number", F.lit("-"), F.lit(""))).alias("stem"))
    none = fixture(spark, sf, "legis_items").where("id % 10 = 3").select(F.concat(F.lit("none"), F.col("id").cast("string")).alias("stem"))
    return joins.corpus_metadata(stems.unionByName(none), base.unionByName(again)).select(
        "stem", "legislation_number", "legislation_date", "legislation_type", "final_action")
