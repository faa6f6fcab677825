"""Bindings of filters, lookups and full-text search."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from minutebook.operators import fulltext as ft, search as se
from minutebook.operators.segments import SegmentedIndex
from minutebook.plans.fixtures import fixture, table
from minutebook.plans.registry import query
from minutebook.session import scratch_dir
from minutebook.plans.text_queries import (
    DONATIONS_SQL, PAPER_SQL, SETTLEMENTS_SQL, donation_rows, items, papers, settlement_rows,
    sponsor_arrays)


@query("f1_search_all_relevance", """
SELECT id, date, number, score FROM (
  SELECT *, CASE WHEN lower(number) = 'park' THEN 10 WHEN contains(lower(number), 'park') THEN 5 ELSE 0 END
         + (length(lower(description)) - length(replace(lower(description), 'park', ''))) // 4 AS score
  FROM legis_items) WHERE score > 0""")
def _(spark, sf):
    return se.search_items(items(spark, sf), '“PARK”', sort="relevance").select("id", "date", "number", "score")


@query("f1_search_number_range", """
SELECT id, date, number, CASE WHEN lower(number) = 'x11' THEN 10 ELSE 5 END AS score FROM legis_items
WHERE contains(lower(number), 'x11') AND date >= '1993-01-01' AND date <= '1996-02-29' """)
def _(spark, sf):
    return se.search_items(items(spark, sf), "X11", field="number", date_from="1993", date_to="1996-02",
                           sort="date_asc").select("id", "date", "number", "score")


@query("f1_search_typed", """
SELECT id, date, number, (length(description) - length(replace(description, 'CITY', ''))) // 4 AS score
FROM items WHERE type_name = 'Report' AND contains(description, 'CITY')""")
def _(spark, sf):
    return se.search_items(items(spark, sf), "city", field="description", leg_type="report") \
        .select("id", "date", "number", "score")


@query("f2_filter_donations", f"""
SELECT id, donation_direction, CAST(amount AS DOUBLE) AS amount, recipient FROM ({DONATIONS_SQL})
WHERE donation_direction = 'made' AND amount <> 0 AND amount BETWEEN 10000 AND 250000
  AND legislation_date >= '1993' AND legislation_date <= '1997-12-31' AND contains(lower(recipient), 'house')""")
def _(spark, sf):
    return se.filter_donations(donation_rows(spark, sf), direction="made", low=10000, high=250000,
                               year_from=1993, year_to=1997, recipient="House") \
        .select("id", "donation_direction", F.col("amount").cast("double").alias("amount"), "recipient")


@query("f2_filter_donations_party", f"""
SELECT id, donor, recipient FROM ({DONATIONS_SQL})
WHERE donation_type = 'in_kind' AND (contains(lower(COALESCE(donor, '')), 'machin') OR contains(lower(COALESCE(recipient, '')), 'machin'))""")
def _(spark, sf):
    return se.filter_donations(donation_rows(spark, sf), kind="in_kind", party="MACHIN").select("id", "donor", "recipient")


@query("f3_filter_settlements", f"""
SELECT id, settlement_category, CAST(amount AS DOUBLE) AS amount FROM ({SETTLEMENTS_SQL})
WHERE settlement_category = 'court_litigation' AND amount <> 0 AND amount >= 50000
  AND legislation_date >= '1994' AND contains(lower(court), 'superior')""")
def _(spark, sf):
    return se.filter_settlements(settlement_rows(spark, sf), category="court_litigation", low=50000,
                                 year_from=1994, court="Superior") \
        .select("id", "settlement_category", F.col("amount").cast("double").alias("amount"))


def flagged_donations(spark, sf):
    return donation_rows(spark, sf).withColumn("excluded", F.col("id") % 5 == 0)


@query("f4_filter_donations_admin", f"""
SELECT id, number FROM ({DONATIONS_SQL}) WHERE id % 5 <> 0 AND starts_with(legislation_date, '1995') AND COALESCE(amount, 0) <> 0""")
def _(spark, sf):
    return se.filter_donations_admin(flagged_donations(spark, sf), year=1995, hide_no_amount=True).select("id", "number")


@query("f5_items_by_sponsor", "SELECT id, date FROM item_sponsors WHERE sponsor = 'Supplier#000000003'")
def _(spark, sf):
    return se.items_by_sponsor(sponsor_arrays(spark, sf), "Supplier#000000003").select("id", "date")


@query("f5_committee_items", f"""
SELECT s.id, s.date, p.paper_type FROM item_sponsors s JOIN ({PAPER_SQL}) p ON p.id = s.id WHERE s.sponsor = 'Supplier#000000003'""")
def _(spark, sf):
    typed = papers(spark, sf).select("id", "paperType")
    own = se.items_by_sponsor(sponsor_arrays(spark, sf), "Supplier#000000003")
    return own.join(typed, "id").select("id", "date", F.col("paperType").alias("paper_type"))


@query("f6_items_by_final_action", """SELECT id, date FROM items WHERE COALESCE("finalAction", '') = ''""")
def _(spark, sf):
    return se.items_by_final_action(items(spark, sf), "(empty)").select("id", "date")


@query("f7_items_by_date", """
SELECT id, number, count(*) OVER () AS n FROM legis_items WHERE date = (SELECT max(date) FROM legis_items)""")
def _(spark, sf):
    base = fixture(spark, sf, "legis_items")
    day = se.items_by_date(base, base.agg(F.max("date")).scalar())
    return day.select("id", "number").withColumn("n", day.agg(F.count("*")).scalar())


@query("f7_items_on_a_date", "SELECT id, number FROM legis_items WHERE date = '1995-06-15'")
def _(spark, sf):
    stored = fixture(spark, sf, "legis_items").withColumn("year", F.substring("date", 1, 4).cast("int"))
    return se.items_by_date(stored, "1995-06-15").select("id", "number")


def news(spark, sf):
    return fixture(spark, sf, "news")


@query("f8_news_page", """
SELECT id, type FROM news WHERE COALESCE(is_hidden, 0) = 0 AND type = 'click' ORDER BY id DESC LIMIT 20 OFFSET 40""")
def _(spark, sf):
    return se.news_page(news(spark, sf), kind="click", limit=20, offset=40).select("id", "type")


@query("f9_news_between", """
SELECT id, type FROM news WHERE ts >= TIMESTAMP '2024-01-10 00:00:00' AND ts <= TIMESTAMP '2024-01-12 12:00:00' ORDER BY ts DESC, id DESC LIMIT 200""")
def _(spark, sf):
    return se.news_between(news(spark, sf), "2024-01-10 00:00:00", "2024-01-12 12:00:00", 200).select("id", "type")


@query("f9_news_text_dates", """
SELECT id FROM news WHERE ts >= TIMESTAMP '2024-01-10 00:00:00' AND ts < TIMESTAMP '2024-01-12 12:01:00'""")
def _(spark, sf):
    spoken = news(spark, sf).withColumn("date", F.date_format("ts", "MM/dd/yyyy h:mm a"))
    real = spoken.withColumn("ts", se.news_timestamp(F.col("date")))
    return se.news_between(real, "2024-01-10 00:00:00", "2024-01-12 12:00:00").select("id")


def doc_numbered(spark, sf):
    """Items whose document id collides with other items' own ids."""
    return items(spark, sf).withColumn("meetingDocId", F.when(F.col("id") % 3 == 0, F.floor(F.col("id") / 2)))


@query("f10_lookup_items", """
WITH base AS (SELECT id, date, number, CASE WHEN id % 3 = 0 THEN id // 2 END AS doc FROM legis_items),
by_doc AS (SELECT doc AS lookup_id, number FROM base WHERE doc IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc ORDER BY date, id) = 1),
ids AS (SELECT DISTINCT p_partkey AS lookup_id FROM part)
SELECT i.lookup_id, CASE WHEN d.lookup_id IS NOT NULL THEN 'meetingDocId' ELSE 'id' END AS matched_by,
       COALESCE(d.number, b.number) AS number
FROM ids i LEFT JOIN by_doc d ON d.lookup_id = i.lookup_id LEFT JOIN base b ON b.id = i.lookup_id
WHERE d.lookup_id IS NOT NULL OR b.id IS NOT NULL""")
def _(spark, sf):
    ids = table(spark, sf, "part").select(F.col("p_partkey").alias("lookup_id"))
    return se.lookup_items(ids, doc_numbered(spark, sf)).select("lookup_id", "matched_by", "number")


@query("f10_lookup_with_details", """
SELECT p.page_id AS lookup_id, i.number, md5(p.html) AS html
FROM pages p JOIN legis_items i ON i.id = p.page_id""")
def _(spark, sf):
    p = table(spark, sf, "pages")
    details = p.select(F.col("page_id").alias("id"), F.struct("html").alias("content"))
    found = se.lookup_items(p.select(F.col("page_id").alias("lookup_id")), doc_numbered(spark, sf), details, by_id_only=True)
    return found.select("lookup_id", "number", F.md5("details.html").alias("html"))


def roster(spark, sf):
    """All sponsors with their terms; names off the roster are unknown."""
    terms = fixture(spark, sf, "roster_terms").groupBy("name").agg(F.sort_array(F.collect_list(F.struct(
        F.col("start_date").alias("start"), F.col("end_date").alias("end"), "office"))).alias("terms"))
    every = table(spark, sf, "supplier").select(F.col("s_name").alias("name"))
    return every.join(terms, "name", "left").withColumn("is_known", F.col("terms").isNotNull())


@query("f11_filter_roster", """
SELECT name, 'current' AS status FROM roster_terms WHERE end_date IS NULL AND contains(name, '4')
UNION ALL SELECT name, 'former' FROM roster_terms WHERE end_date IS NOT NULL AND contains(name, '4')
UNION ALL SELECT s_name, 'all' FROM supplier WHERE contains(s_name, '4')""")
def _(spark, sf):
    r = roster(spark, sf)
    parts = [se.filter_roster(r, " 4 ", s).select("name", F.lit(s).alias("status")) for s in ("current", "former", "all")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("f12_filter_values", """
SELECT DISTINCT "finalAction" AS action FROM items WHERE contains(lower("finalAction"), 'consent')""")
def _(spark, sf):
    acted = items(spark, sf).withColumnRenamed("finalAction", "action")
    return se.filter_values(acted, "action", "Consent")


@query("f14_attachments", """
SELECT DISTINCT l_orderkey AS id, string_agg(concat('file ', l_linenumber), '|' ORDER BY l_linenumber) FILTER (WHERE l_linenumber % 3 = 0) AS files
FROM lineitem GROUP BY l_orderkey HAVING count(*) FILTER (WHERE l_linenumber % 3 = 0) > 0""")
def _(spark, sf):
    n = F.col("l_linenumber")
    link = F.struct(n.alias("pos"), F.when(n % 3 == 0, F.concat(F.lit("file "), n.cast("string")))
                    .when(n % 3 == 1, "Watch Video").otherwise("").alias("text"))
    nested = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id")) \
        .agg(F.array_sort(F.collect_list(link)).alias("links"))
    kept = nested.withColumn("links", se.attachments(F.col("links"))).where(F.size("links") > 0)
    return kept.select("id", F.array_join(F.transform("links", lambda l: l["text"]), "|").alias("files"))


# --- full text --------------------------------------------------------------

TOKENS = r"list_filter(regexp_split_to_array(strip_accents(lower({c})), '[^\p{L}\p{N}]+'), lambda t: t <> '')"
DOC_TOKENS = TOKENS.replace("{c}", "text")
# The two indexed fields: the text, and a title made of its source and language.
TITLE_TOKENS = TOKENS.replace("{c}", "concat(source, ' ', lang)")
INDEXED = f"""
ix AS (SELECT doc_id, lang, source, {DOC_TOKENS} AS w, {TITLE_TOKENS} AS t FROM documents),
stat AS (SELECT count(*) AS n, avg(len(w) + len(t)) AS mean FROM ix)"""


def corpus(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", "text", F.concat_ws(" ", "source", "lang").alias("title"),
        F.col("lang").alias("legislation_type"),
        F.date_add(F.lit("1990-01-01").cast("date"), (F.col("doc_id") % 3000).cast("int")).cast("string").alias("legislation_date"),
        F.col("n_chars").alias("char_count"))


FIELDS = ["text", "title"]


def fresh_index(spark, sf):
    docs = corpus(spark, sf)
    return ft.build_postings(docs, "doc_id", FIELDS), ft.document_lengths(docs, "doc_id", FIELDS)


_STORED: dict[tuple[str, str], str] = {}


def index(spark, sf):
    """The stored index of a folder; built by the first search of an application."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _STORED:
        path = scratch_dir(spark, "index")
        postings, lengths = fresh_index(spark, sf)
        ft.write_index(postings, path + "/postings")
        lengths.write.parquet(path + "/lengths")
        ft.corpus_totals(spark.read.parquet(path + "/lengths")).write.parquet(path + "/totals")
        _STORED[key] = path
    return spark.read.parquet(_STORED[key] + "/postings"), spark.read.parquet(_STORED[key] + "/lengths")


def searched(spark, sf, text):
    postings, lengths = index(spark, sf)
    folder = _STORED[(spark.sparkContext.applicationId, sf)]
    return ft.search(postings, lengths, text, spark.read.parquet(folder + "/totals"))


@query("x1_build_index", f"""
WITH {INDEXED}
SELECT term, count(*) AS df, sum(tf) AS tf, min(first) AS first FROM (
  SELECT doc_id, term, count(*) AS tf, min(i) AS first FROM (
    SELECT doc_id, unnest(w) AS term, unnest(range(len(w))) AS i FROM ix
    UNION ALL SELECT doc_id, unnest(t), unnest(range(len(t))) + 4294967296 FROM ix) GROUP BY doc_id, term)
GROUP BY term""")
def _(spark, sf):
    postings, _lengths = fresh_index(spark, sf)
    return postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"),
                                        F.min(F.array_min("positions")).alias("first"))


@query("x1_document_lengths", f"WITH {INDEXED} SELECT doc_id, len(w) + len(t) AS length FROM ix")
def _(spark, sf):
    return fresh_index(spark, sf)[1].withColumn("length", F.col("length").cast("long"))


@query("x1_stored_index", f"""
WITH {INDEXED}
SELECT doc_id, count(*) AS tf FROM (SELECT doc_id, unnest(w) AS term FROM ix UNION ALL SELECT doc_id, unnest(t) FROM ix)
WHERE term = 'the' GROUP BY doc_id""")
def _(spark, sf):
    return index(spark, sf)[0].where("term = 'the'").select("doc_id", F.col("tf").cast("long").alias("tf"))


# What is left after the batches of updated_index.
LIVE_INDEXED = INDEXED.replace("FROM documents", "FROM documents WHERE doc_id % 13 <> 0")


def updated_index(spark, sf):
    """An index built of most documents, some with an old text; the rest comes later, texts change, documents go."""
    docs = corpus(spark, sf)
    made = SegmentedIndex(spark, scratch_dir(spark, "segments"), "doc_id", FIELDS, fan=3)
    old = F.when(F.col("doc_id") % 7 == 0, F.lit("the old text of the paper")).otherwise(F.col("text"))
    made.apply(docs.where("doc_id % 10 <> 0").withColumn("text", old))
    made.apply(docs.where("doc_id % 10 = 0 OR doc_id % 7 = 0"))
    made.apply(docs.where("doc_id % 17 = 0").withColumn("text", F.lit("for a while")), deleted=docs.where("doc_id % 13 = 0"))
    made.apply(docs.where("doc_id % 17 = 0 AND doc_id % 13 <> 0"), deleted=docs.where("doc_id % 13 = 0"))
    return made


@query("x1_updated_index", f"""
WITH {LIVE_INDEXED}
SELECT term, count(*) AS df, sum(tf) AS tf, min(first) AS first FROM (
  SELECT doc_id, term, count(*) AS tf, min(i) AS first FROM (
    SELECT doc_id, unnest(w) AS term, unnest(range(len(w))) AS i FROM ix
    UNION ALL SELECT doc_id, unnest(t), unnest(range(len(t))) + 4294967296 FROM ix) GROUP BY doc_id, term)
GROUP BY term""")
def _(spark, sf):
    return updated_index(spark, sf).postings().groupBy("term").agg(
        F.count("*").alias("df"), F.sum("tf").alias("tf"), F.min(F.array_min("positions")).alias("first"))


def sql_word_hits(word: str, prefix: bool = False) -> str:
    test = f"starts_with(x, '{word}')" if prefix else f"x = '{word}'"
    return f"len(list_filter(w, lambda x: {test})) + len(list_filter(t, lambda x: {test}))"


def sql_phrase_hits(a: str, b: str) -> str:
    return " + ".join(
        f"len(list_filter(range(1, len({c})), lambda i: {c}[i] = '{a}' AND {c}[i + 1] = '{b}'))" for c in ("w", "t"))


def sql_bm25(hits: list[str], where: str, tail: str = "", extra: str = "", exact: str = "") -> str:
    """BM25 written out over word lists; ``exact`` names the score before it is rounded."""
    cols = ", ".join(f"{h} AS h{i}" for i, h in enumerate(hits))
    dfs = ", ".join(f"sum(CAST(h{i} > 0 AS INT)) AS d{i}" for i in range(len(hits)))
    score = " + ".join(
        f"greatest(ln((n - d{i} + 0.5) / (d{i} + 0.5)), 1e-6) * h{i} * 2.2 / (h{i} + 1.2 * (0.25 + 0.75 * size / mean))"
        for i in range(len(hits)))
    return f"""
WITH {INDEXED}, hit AS (SELECT doc_id, lang, source, len(w) + len(t) AS size, {cols} FROM ix),
freq AS (SELECT {dfs} FROM hit),
ranked AS (SELECT doc_id, lang, source, {f"{score} AS {exact}, " if exact else ""}round({score}, 6) AS score FROM hit, freq, stat WHERE {where})
SELECT doc_id, score{extra} FROM ranked {tail}"""


def scored(df):
    return df.select("doc_id", F.round("score", 6).alias("score"))


@query("x2_match_and", sql_bm25([sql_word_hits("the"), sql_word_hits("of")], "h0 > 0 AND h1 > 0"))
def _(spark, sf):
    return scored(searched(spark, sf, "the of"))


@query("x2_match_or_not", f"""
SELECT doc_id FROM (SELECT doc_id, {sql_word_hits('und')} AS a, {sql_word_hits('sch')} AS b, {sql_word_hits('les')} AS c
FROM (SELECT doc_id, {DOC_TOKENS} AS w, {TITLE_TOKENS} AS t FROM documents)) WHERE (a > 0 AND b = 0) OR c > 0""")
def _(spark, sf):
    return ft.match(index(spark, sf)[0], "und -sch OR les").where("matched").select("doc_id")


@query("x2_match_phrase", sql_bm25([sql_phrase_hits("of", "the"), sql_word_hits("to")], "h0 > 0 AND h1 > 0"))
def _(spark, sf):
    return scored(searched(spark, sf, "“of the” to"))


@query("x2_match_prefix", sql_bm25([sql_word_hits("th", True), sql_word_hits("and")], "h0 > 0 AND h1 > 0"))
def _(spark, sf):
    return scored(searched(spark, sf, "th* AND and"))


@query("x3_rank_top", sql_bm25([sql_word_hits("the"), sql_word_hits("src7")], "h0 > 0 AND h1 > 0",
                               "ORDER BY score DESC, doc_id LIMIT 10"))
def _(spark, sf):
    ranked = scored(searched(spark, sf, "the src7"))
    return ranked.orderBy(F.col("score").desc(), "doc_id").limit(10)


@query("x1_updated_search", sql_bm25([sql_word_hits("the"), sql_word_hits("of")], "h0 > 0 AND h1 > 0").replace(INDEXED, LIVE_INDEXED))
def _(spark, sf):
    made = updated_index(spark, sf)
    return scored(ft.search(made.postings(), made.lengths(), "the of", made.totals()))


DATED = "CAST(DATE '1990-01-01' + CAST(doc_id % 3000 AS INT) AS VARCHAR)"


@query("x4_filtered_page", sql_bm25([sql_word_hits("and")], "h0 > 0 AND lang = 'en'",
       f"WHERE {DATED} >= '1990-01-20' AND {DATED} <= '1992-06-30' ORDER BY legislation_date DESC, exact DESC, doc_id LIMIT 25 OFFSET 25",
       f", {DATED} AS legislation_date", "exact"))
def _(spark, sf):
    found = ft.filtered(searched(spark, sf, "and"), corpus(spark, sf).drop("text"),
                        "1990-01-20", "1992-06-30", "en")
    return ft.result_page(found, "date_desc", page=2, size=25).select(
        "doc_id", F.round("score", 6).alias("score"), "legislation_date")


@query("x4_total", f"""
SELECT count(*) AS total FROM (SELECT doc_id, lang, {sql_word_hits('and')} AS h
FROM (SELECT doc_id, lang, {DOC_TOKENS} AS w, {TITLE_TOKENS} AS t FROM documents)) WHERE h > 0 AND lang = 'en'""")
def _(spark, sf):
    found = ft.match(index(spark, sf)[0], "and").where("matched").join(
        corpus(spark, sf).where("legislation_type = 'en'").select("doc_id"), "doc_id", "left_semi")
    return found.agg(F.count("*").alias("total"))


SNIPPETS = f"""
WITH best AS ({{best}}), hits AS (
  SELECT doc_id, regexp_extract_all(text, '[\\p{{{{L}}}}\\p{{{{N}}}}]+[^\\p{{{{L}}}}\\p{{{{N}}}}]*') AS pieces,
    list_filter(range(0, len(w)), lambda i: w[i + 1] = 'of' AND w[i + 2] = 'the') AS phrases, list_filter(range(0, len(w)), lambda i: w[i + 1] = 'and') AS ands
  FROM (SELECT doc_id, text, {DOC_TOKENS.replace("{", "{{").replace("}", "}}")} AS w FROM documents) JOIN best USING (doc_id)
), placed AS (
  SELECT *, list_sort(list_distinct(phrases || ands)) AS opens, list_transform(phrases, lambda p: p + 1) || ands AS closes FROM hits
), chosen AS (
  SELECT *, greatest(0, least(coalesce(-list_max(list_transform(opens, lambda p: {{{{'n': len(list_filter(opens, lambda q: q >= p AND q < p + 40)), 'at': -p}}}})).at, 0),
                              len(pieces) - 40)) AS first FROM placed
)
SELECT doc_id, concat(CASE WHEN first > 0 THEN '...' ELSE '' END,
  rtrim(array_to_string(list_transform(range(first, least(first + 40, len(pieces))), lambda i: concat(
    CASE WHEN list_contains(opens, i) THEN '<mark>' ELSE '' END, regexp_extract(pieces[i + 1], '^[\\p{{{{L}}}}\\p{{{{N}}}}]+'),
    CASE WHEN list_contains(closes, i) THEN '</mark>' ELSE '' END,
    substr(pieces[i + 1], length(regexp_extract(pieces[i + 1], '^[\\p{{{{L}}}}\\p{{{{N}}}}]+')) + 1))), '')),
  CASE WHEN first + 40 < len(pieces) THEN '...' ELSE '' END) AS snippet FROM chosen"""
BEST = sql_bm25([sql_phrase_hits("of", "the"), sql_word_hits("and")], "h0 > 0 AND h1 > 0", "ORDER BY exact DESC, doc_id LIMIT 50", exact="exact")


@query("x5_snippet", SNIPPETS.format(best=BEST))
def _(spark, sf):
    docs = corpus(spark, sf)
    found = ft.search_documents(*index(spark, sf), docs, '"of the" and', size=50)
    return found.select("doc_id", "snippet")


@query("x6_search_news", """
SELECT id, row_number() OVER (ORDER BY length, id) AS place FROM (
  SELECT id, len(list_filter(string_split_regex(lower(content), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')) AS length FROM news
  WHERE COALESCE(is_hidden, 0) = 0 AND type = 'purchase') QUALIFY place <= 50""")
def _(spark, sf):
    # Each hit holds the word once, so the shorter rows rank first.
    rows = news(spark, sf)
    found = ft.search_news(ft.build_postings(rows, "id", ["type", "content"]),
                           ft.document_lengths(rows, "id", ["type", "content"]), rows, "purchase")
    place = F.row_number().over(Window.orderBy(F.col("score").desc(), "id"))
    return found.select("id", place.cast("long").alias("place"))


@query("a21_corpus_stats", f"""
SELECT count(*) AS total_documents, sum(n_chars) AS total_characters, min({DATED}) AS earliest_date,
       max({DATED}) AS latest_date, count(DISTINCT lang) AS type_count FROM documents""")
def _(spark, sf):
    from minutebook.operators import reports
    return reports.corpus_stats(corpus(spark, sf))

