"""Bindings of corrections, upserts and merges."""

from __future__ import annotations

from pyspark.sql import functions as F

from minutebook.operators import corrections as co, joins, reports
from minutebook.operators.search import keep_latest
from minutebook.plans.fixtures import fixture, lit, table
from minutebook.plans.registry import query
from minutebook.plans.text_queries import (
    DONATIONS_SQL, TAGGED_HTML, donation_rows, items, sponsor_arrays)
from minutebook.session import scratch_dir
from minutebook.sources import meetings as mt
from minutebook.sources.keyed import KeyedTable


def sponsored_items(spark, sf):
    return (fixture(spark, sf, "legis_items").join(sponsor_arrays(spark, sf).drop("date"), "id", "left")
            .withColumn("sponsorConfidence", F.lit("high")).withColumn("finalAction", F.lit("FILED")))


NAMES_OF = "SELECT id, string_agg(sponsor, '|' ORDER BY sponsor) AS names FROM item_sponsors GROUP BY id"


@query("m1_patch_items", f"""
SELECT i.id, COALESCE(p.description, i.description) AS description,
       CASE WHEN p.id IS NOT NULL AND i.id % 100 = 0 THEN 'Ann Lee|Bo Day' ELSE s.names END AS sponsors,
       CASE WHEN p.id IS NOT NULL AND i.id % 100 = 0 THEN 'manual' ELSE 'high' END AS confidence,
       CASE WHEN p.id IS NOT NULL AND i.id % 150 = 0 THEN 'HELD' ELSE 'FILED' END AS action
FROM legis_items i LEFT JOIN patches p ON p.id = i.id LEFT JOIN ({NAMES_OF}) s ON s.id = i.id""")
def _(spark, sf):
    base = sponsored_items(spark, sf)
    patches = fixture(spark, sf, "patches").withColumn("finalAction", F.when(F.col("id") % 150 == 0, "HELD")).withColumn(
        "sponsors", F.when(F.col("id") % 100 == 0, F.array(F.lit("Ann Lee"), F.lit("Bo Day"))))
    dated = patches.join(base.select("id", "date"), "id")
    out = co.patch_items(base, dated)
    return out.select("id", "description", F.array_join("sponsors", "|").alias("sponsors"),
                      F.col("sponsorConfidence").alias("confidence"), F.col("finalAction").alias("action"))


@query("m1_unmatched_patches", "SELECT id * 3 AS id FROM patches WHERE id * 3 NOT IN (SELECT id FROM legis_items)")
def _(spark, sf):
    shifted = fixture(spark, sf, "patches").withColumn("id", F.col("id") * 3)
    return co.unmatched(fixture(spark, sf, "legis_items"), shifted, key=("id",)).select("id")


VARIANTS = ["Supplier#000000001", "Supplier#000000002", "Supplier#000000004"]
VARLIST = ", ".join(lit(v) for v in VARIANTS)


@query("m2_merge_sponsors", f"""
WITH r AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY sponsor) AS k, CASE WHEN sponsor IN ({VARLIST}) THEN 'Merged' ELSE sponsor END AS s,
             max(CAST(sponsor IN ({VARLIST}) AS INT)) OVER (PARTITION BY id) AS hit FROM item_sponsors),
f AS (SELECT id, s, min(k) AS k, max(hit) AS hit FROM r GROUP BY id, s)
SELECT id, string_agg(s, '|' ORDER BY k) AS sponsors, max(hit) = 1 AS touched FROM f GROUP BY id""")
def _(spark, sf):
    base = sponsor_arrays(spark, sf).withColumn("sponsorConfidence", F.lit("high"))
    return co.merge_sponsors(base, VARIANTS, "Merged").select("id", F.array_join("sponsors", "|").alias("sponsors"), "touched")


@query("m3_delete_sponsor", """
SELECT id, COALESCE(string_agg(sponsor, '|' ORDER BY sponsor) FILTER (WHERE sponsor <> 'Supplier#000000005'), '') AS sponsors,
       max(CAST(sponsor = 'Supplier#000000005' AS INT)) = 1 AS touched FROM item_sponsors GROUP BY id""")
def _(spark, sf):
    return co.delete_sponsor(sponsor_arrays(spark, sf), "Supplier#000000005") \
        .select("id", F.array_join("sponsors", "|").alias("sponsors"), "touched")


@query("m4_merge_final_actions", """
SELECT id, CASE WHEN COALESCE("finalAction", '') IN ('', 'FILED', 'REFERRED') THEN 'CLOSED' ELSE "finalAction" END AS action,
       COALESCE("finalAction", '') IN ('', 'FILED', 'REFERRED') AS touched FROM items""")
def _(spark, sf):
    return co.merge_final_actions(items(spark, sf), ["(empty)", "FILED", "REFERRED"], "CLOSED") \
        .select("id", F.col("finalAction").alias("action"), "touched")


def donation_patches(spark, sf):
    """Three kinds of edits by id: an amount, a cleared donor, a new purpose."""
    p = fixture(spark, sf, "legis_items").select("id")
    k = F.col("id")
    amount = p.where("id % 36 = 0").select("id", F.lit("amount").alias("field"),
                                          F.when(k % 72 == 0, F.lit("1,250.50")).when(k % 5 == 0, "").otherwise("about 9").alias("value"))
    donor = p.where("id % 48 = 4").select("id", F.lit("donor").alias("field"), F.lit(None).cast("string").alias("value"))
    purpose = p.where("id % 24 = 0").select("id", F.lit("purpose").alias("field"), F.lit("Parks").alias("value"))
    other = p.where("id % 24 = 0").select("id", F.lit("number").alias("field"), F.lit("x").alias("value"))
    return amount.unionByName(donor).unionByName(purpose).unionByName(other)


@query("m5_patch_donations", f"""
SELECT id, number, CAST(CASE WHEN id % 36 = 0 AND id % 72 = 0 THEN 1250.50 WHEN id % 36 = 0 AND id % 5 = 0 THEN NULL ELSE amount END AS DOUBLE) AS amount,
       CASE WHEN id % 48 = 4 THEN NULL ELSE donor END AS donor, CASE WHEN id % 24 = 0 THEN 'Parks' ELSE purpose END AS purpose
FROM ({DONATIONS_SQL})""")
def _(spark, sf):
    out = co.patch_donations(donation_rows(spark, sf), donation_patches(spark, sf))
    return out.select("id", "number", F.col("amount").cast("double").alias("amount"), "donor", "purpose")


@query("m5_refused_amounts", "SELECT id FROM legis_items WHERE id % 36 = 0 AND id % 72 <> 0 AND id % 5 <> 0")
def _(spark, sf):
    return co.refused_amounts(donation_patches(spark, sf)).select("id")


@query("m5_delete_donations", f"SELECT id, number FROM ({DONATIONS_SQL}) WHERE id NOT IN (SELECT id FROM patches)")
def _(spark, sf):
    return co.delete_rows(donation_rows(spark, sf), fixture(spark, sf, "patches")).select("id", "number")


BATCH = "SELECT id, concat('new ', type) AS title, content, 0 AS seq FROM news WHERE id % 3 = 0 UNION ALL SELECT id + 1000000, type, content, 1 FROM news WHERE id % 100 = 0 UNION ALL SELECT NULL, type, content, 1 FROM news WHERE id % 100 = 1"
# Of rows with one id the last counts.
LAST_OF_BATCH = f"SELECT * FROM ({BATCH}) WHERE id IS NOT NULL AND id <> 0 QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC) = 1"


def base_news(spark, sf):
    return fixture(spark, sf, "news").select("id", F.col("type").alias("title"), F.col("content").alias("content_text"),
                                             F.col("type"), "is_hidden")


def news_batch(spark, sf):
    n = fixture(spark, sf, "news").withColumnRenamed("content", "content_text")
    one = n.where("id % 3 = 0").select("id", F.concat(F.lit("new "), "type").alias("title"), "content_text")
    two = n.where("id % 100 = 0").select((F.col("id") + 1000000).alias("id"), F.col("type").alias("title"), "content_text")
    none = n.where("id % 100 = 1").select(F.lit(None).cast("long").alias("id"), F.col("type").alias("title"), "content_text")
    return one.withColumn("seq", F.lit(0)).unionByName(two.unionByName(none).withColumn("seq", F.lit(1)))


@query("m6_upsert_news", f"""
SELECT COALESCE(n.id, b.id) AS id, CASE WHEN b.id IS NOT NULL AND b.id <> 0 THEN b.title ELSE n.type END AS title, n.type, n.is_hidden
FROM news n FULL OUTER JOIN ({LAST_OF_BATCH}) b ON b.id = n.id""")
def _(spark, sf):
    return co.upsert_news(base_news(spark, sf), news_batch(spark, sf)).select("id", "title", "type", "is_hidden")


@query("m6_stored_upsert", f"""
SELECT COALESCE(n.id, b.id) AS id, CASE WHEN b.id IS NOT NULL AND b.id <> 0 THEN b.title ELSE n.type END AS title, n.type, n.is_hidden
FROM (SELECT * FROM news WHERE id <> 0) n FULL OUTER JOIN ({LAST_OF_BATCH}) b ON b.id = n.id""")
def _(spark, sf):
    base = base_news(spark, sf).where("id <> 0")
    stored = KeyedTable(spark, scratch_dir(spark, "news"), ["id"], base.schema, buckets=8)
    stored.upsert(base)
    stored.change(news_batch(spark, sf).where("id <> 0"), co.upsert_news)
    return stored.read().select("id", "title", "type", "is_hidden")


@query("m6_upsert_report", f"""
SELECT CASE WHEN COALESCE(id, 0) = 0 THEN 'skipped' WHEN id NOT IN (SELECT id FROM news) AND place = 1 THEN 'imported' ELSE 'updated' END AS outcome, count(*) AS n
FROM (SELECT id, row_number() OVER (PARTITION BY id ORDER BY seq) AS place FROM ({BATCH})) GROUP BY 1""")
def _(spark, sf):
    return co.upsert_report(base_news(spark, sf), news_batch(spark, sf))


def news_links(spark, sf):
    """One link per order line."""
    o = table(spark, sf, "lineitem")
    return o.select(F.col("l_orderkey").alias("news_id"), F.col("l_linenumber").alias("pos"),
                    F.concat(F.lit("line "), F.col("l_linenumber").cast("string")).alias("text"),
                    F.concat(F.lit("/p/"), F.col("l_partkey").cast("string")).alias("href"))


@query("m6_replace_links", """
SELECT l_orderkey AS news_id, l_linenumber AS pos, concat('/p/', l_partkey) AS href FROM lineitem WHERE l_orderkey % 3 <> 0
UNION ALL SELECT l_orderkey, l_linenumber, '/new' FROM lineitem WHERE l_orderkey % 3 = 0 AND l_linenumber = 1""")
def _(spark, sf):
    old = news_links(spark, sf)
    batch = old.where("news_id % 3 = 0").select(F.col("news_id").alias("id")).distinct()
    new = old.where("news_id % 3 = 0 AND pos = 1").withColumn("href", F.lit("/new"))
    return co.replace_links(old, new, batch).select("news_id", "pos", "href")


@query("j10_news_with_links", """
SELECT n.id, count(l.l_linenumber) AS links, COALESCE(string_agg(concat('/p/', l.l_partkey), '|' ORDER BY l.l_linenumber, concat('line ', l.l_linenumber), concat('/p/', l.l_partkey)) FILTER (WHERE l.l_orderkey IS NOT NULL), '') AS hrefs
FROM news n LEFT JOIN lineitem l ON l.l_orderkey = n.id GROUP BY n.id""")
def _(spark, sf):
    out = joins.news_with_links(fixture(spark, sf, "news"), news_links(spark, sf))
    return out.select("id", F.size("links").cast("long").alias("links"),
                      F.array_join(F.transform("links", lambda l: l["href"]), "|").alias("hrefs"))


@query("m7_set_news_fields", """
SELECT id, CASE WHEN id % 4 = 0 THEN 1 - COALESCE(is_hidden, 0) WHEN id % 4 = 1 THEN 1 WHEN id % 4 = 2 THEN 0 ELSE is_hidden END AS is_hidden,
       CASE WHEN id % 10 = 0 THEN 'Media Advisory' ELSE type END AS type FROM news""")
def _(spark, sf):
    n = fixture(spark, sf, "news")
    k = F.col("id")
    patches = n.select("id", F.when(k % 4 == 0, "toggle").when(k % 4 == 1, "true").when(k % 4 == 2, "false").alias("hidden"),
                       F.when(k % 10 == 0, "Media Advisory").when(k % 10 == 1, "Gossip").alias("type"))
    return co.set_news_fields(n, patches).select("id", "is_hidden", "type")


@query("m8_recategorize_news", """
SELECT CASE WHEN page_id % 4 = 0 THEN 'News Release' WHEN page_id % 4 IN (1, 2) THEN 'Media Advisory' ELSE 'Unknown' END AS type, count(*) AS n FROM pages GROUP BY 1""")
def _(spark, sf):
    stored = table(spark, sf, "pages").select("page_id", F.expr(TAGGED_HTML).alias("content_html"))
    return reports.news_type_counts(co.set_news_types(stored), include_hidden=True)


def paper_batch(spark, sf):
    """Documents again, with every number twice."""
    d = table(spark, sf, "documents").select(F.concat(F.lit("p"), F.floor(F.col("doc_id") / 2).cast("string")).alias("paper_number"),
                                             "doc_id", "source")
    return d, d.withColumn("paper_number", F.concat("paper_number", F.when(F.col("doc_id") % 3 == 0, "x").otherwise("")))


@query("m9_insert_if_absent", """
WITH b AS (SELECT concat('p', doc_id // 2, CASE WHEN doc_id % 3 = 0 THEN 'x' ELSE '' END) AS paper_number, doc_id FROM documents),
d AS (SELECT concat('p', doc_id // 2) AS paper_number, doc_id FROM documents)
SELECT * FROM d UNION ALL SELECT paper_number, min(doc_id) FROM b WHERE paper_number NOT IN (SELECT paper_number FROM d) GROUP BY paper_number""")
def _(spark, sf):
    d, b = paper_batch(spark, sf)
    return co.insert_if_absent(d, b, "paper_number", "doc_id").select("paper_number", "doc_id")


@query("m9_stored_insert", """
WITH b AS (SELECT concat('p', doc_id // 2, CASE WHEN doc_id % 3 = 0 THEN 'x' ELSE '' END) AS paper_number, doc_id FROM documents),
d AS (SELECT concat('p', doc_id // 2) AS paper_number, min(doc_id) AS doc_id FROM documents GROUP BY 1)
SELECT * FROM d UNION ALL SELECT paper_number, min(doc_id) FROM b WHERE paper_number NOT IN (SELECT paper_number FROM d) GROUP BY paper_number""")
def _(spark, sf):
    d, b = paper_batch(spark, sf)
    stored = KeyedTable(spark, scratch_dir(spark, "papers"), ["paper_number"], d.schema, buckets=8)
    stored.insert_new(d, "doc_id")
    stored.insert_new(b, "doc_id")
    return stored.read().select("paper_number", "doc_id")


@query("m9_insert_report", """
WITH b AS (SELECT concat('p', doc_id // 2, CASE WHEN doc_id % 3 = 0 THEN 'x' ELSE '' END) AS paper_number FROM documents),
d AS (SELECT concat('p', doc_id // 2) AS paper_number FROM documents)
SELECT inserted, (SELECT count(*) FROM b) - inserted AS skipped FROM (SELECT count(DISTINCT paper_number) AS inserted FROM b WHERE paper_number NOT IN (SELECT paper_number FROM d))""")
def _(spark, sf):
    return co.insert_report(*paper_batch(spark, sf), "paper_number")


def package_items(spark, sf):
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("package_id"), F.col("l_linenumber").alias("row_num"),
        (F.col("l_partkey") % 7).cast("string").alias("elms_id"), F.col("l_suppkey").alias("sponsor"))


REPLACED = """
SELECT package_id, elms_id, row_num, sponsor FROM (
  SELECT l_orderkey AS package_id, CAST(l_partkey % 7 AS VARCHAR) AS elms_id, l_linenumber AS row_num, l_suppkey + 1000 AS sponsor,
         row_number() OVER (PARTITION BY l_orderkey, l_partkey % 7 ORDER BY l_linenumber DESC, l_suppkey DESC) AS rn FROM lineitem WHERE l_orderkey % 2 = 0) WHERE rn = 1
UNION ALL SELECT l_orderkey, CAST(l_partkey % 7 AS VARCHAR), l_linenumber, l_suppkey FROM lineitem WHERE l_orderkey % 2 <> 0"""


def replaced(spark, sf):
    old = package_items(spark, sf)
    batch = old.where("package_id % 2 = 0").withColumn("sponsor", F.col("sponsor") + 1000)
    return co.replace_items(old, batch, order=F.struct("row_num", "sponsor"))


@query("m10_replace_items", REPLACED)
def _(spark, sf):
    return replaced(spark, sf).select("package_id", "elms_id", "row_num", "sponsor")


@query("m10_stored_replace", """
SELECT package_id, elms_id, row_num, CASE WHEN package_id % 2 = 0 THEN sponsor + 1000 ELSE sponsor END AS sponsor FROM (
  SELECT l_orderkey AS package_id, CAST(l_partkey % 7 AS VARCHAR) AS elms_id, l_linenumber AS row_num, l_suppkey AS sponsor,
         row_number() OVER (PARTITION BY l_orderkey, l_partkey % 7 ORDER BY l_linenumber DESC, l_suppkey DESC) AS rn FROM lineitem) WHERE rn = 1""")
def _(spark, sf):
    old = package_items(spark, sf)
    stored = KeyedTable(spark, scratch_dir(spark, "items"), ["package_id", "elms_id"], old.schema, buckets=8)
    last = F.struct("row_num", "sponsor")
    stored.upsert(old, last)
    stored.upsert(old.where("package_id % 2 = 0").withColumn("sponsor", F.col("sponsor") + 1000), last)
    return stored.read().select("package_id", "elms_id", "row_num", "sponsor")


@query("m10_packages", f"""
SELECT o_orderkey AS id, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS meeting_date, COALESCE(n, 0) AS item_count, n IS NOT NULL AS processed
FROM orders LEFT JOIN (SELECT package_id, count(*) AS n FROM ({REPLACED}) GROUP BY 1) r ON r.package_id = o_orderkey
ORDER BY meeting_date DESC, id DESC""")
def _(spark, sf):
    packages = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").cast("string").alias("meeting_date"),
        F.lit(None).cast("timestamp").alias("processed_at"), F.lit(0).cast("long").alias("item_count"))
    done = co.mark_processed(packages, replaced(spark, sf))
    return co.list_packages(done).select("id", "meeting_date", "item_count", F.col("processed_at").isNotNull().alias("processed"))


@query("m11_replace_committees", "SELECT r_name AS name, '2000-01-01' AS start, CAST(NULL AS VARCHAR) AS \"end\" FROM region")
def _(spark, sf):
    path = scratch_dir(spark, "dimension")
    old = fixture(spark, sf, "committees").select("name", F.lit("1990-01-01").alias("start"), F.col("end_date").alias("end"))
    mt.replace_committees(old, path)
    new = table(spark, sf, "region").select(F.col("r_name").alias("name"), F.lit("2000-01-01").alias("start"),
                                            F.lit(None).cast("string").alias("end"))
    mt.replace_committees(new, path)
    return mt.read_committees(spark, path)


@query("j9_toc_merge", """
SELECT b.package_id, b.seq, COALESCE(t.leg_id, '') AS leg_id, COALESCE(t.description, '') AS description
FROM (SELECT l_orderkey AS package_id, l_linenumber AS seq FROM lineitem) b
LEFT JOIN (SELECT l_orderkey AS package_id, l_linenumber AS seq, arg_max(concat('26-R-', l_suppkey), (l_partkey, concat('26-R-', l_suppkey))) AS leg_id, concat('part ', max(l_partkey)) AS description
           FROM lineitem WHERE l_linenumber % 3 <> 0 GROUP BY 1, 2) t ON t.package_id = b.package_id AND t.seq = b.seq""")
def _(spark, sf):
    li = table(spark, sf, "lineitem")
    key = F.concat(F.lit("e"), F.col("l_linenumber").cast("string")).alias("elms_id")
    marks = li.select(F.col("l_orderkey").alias("package_id"), key, F.col("l_linenumber").alias("seq"))
    toc = li.where("l_linenumber % 3 <> 0").select(
        F.col("l_orderkey").alias("package_id"), key, F.col("l_partkey").alias("row"),
        F.concat(F.lit("26-R-"), F.col("l_suppkey").cast("string")).alias("leg_id"), F.lit("Smith").alias("sponsor"),
        F.concat(F.lit("part "), F.col("l_partkey").cast("string")).alias("description"),
        F.lit("Resolution").alias("leg_type"), F.lit("").alias("committee"))
    return joins.toc_merge(marks, toc).select("package_id", "seq", "leg_id", "description")


@query("j11_pending", """
SELECT doc_id FROM documents WHERE NOT (doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AND doc_id % 2 = 0)""")
def _(spark, sf):
    d = table(spark, sf, "documents")
    return joins.pending(d.select("doc_id"), table(spark, sf, "labels").where("quality = 1"),
                         d.where("doc_id % 2 = 0"), key="doc_id")


@query("w7_keep_latest", """
SELECT user_id, max(event_id) AS event_id FROM events GROUP BY user_id""")
def _(spark, sf):
    return keep_latest(table(spark, sf, "events").select("user_id", "event_id"), "user_id", "event_id")
