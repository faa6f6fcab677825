"""Joins of items with documents, rosters, committees and calendars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from minutebook.functions.legislation import pdf_stem
from minutebook.functions.sponsors import paper_type_from_flags


def first_wins(df: DataFrame, key: str, order: list) -> DataFrame:
    """First row per key.  ``min_by`` keeps one candidate per task, so a hot key
    is reduced before the shuffle instead of being sorted in one task."""
    rest = [c for c in df.columns if c != key]
    return (df.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
            .select(key, "_row.*").select(*df.columns))


def attach_doc_ids(items: DataFrame, docs: DataFrame) -> DataFrame:
    """Document id by number, lowest id first; ``doc_status`` tells what changed."""
    lookup = (docs.where(F.coalesce("FormalNumber", F.lit("")) != "")
              .groupBy(F.col("FormalNumber").alias("number"))
              .agg(F.min("doc_id").alias("_doc")))
    old = F.col("meetingDocId")
    return (items.join(lookup, "number", "left")
            .withColumn("doc_status", F.when(F.col("_doc").isNull(), "unmatched")
                        .when(old.eqNullSafe(F.col("_doc")), "already").otherwise("updated"))
            .withColumn("meetingDocId", F.coalesce("_doc", "meetingDocId"))
            .drop("_doc"))


def doc_id_report(attached: DataFrame) -> DataFrame:
    return attached.groupBy("doc_status").agg(F.count("*").alias("n"))


def formal_number_report(docs: DataFrame) -> DataFrame:
    """Lookup quality: files, keys, files without a number, numbers seen again."""
    named = F.coalesce("FormalNumber", F.lit("")) != ""
    return docs.agg(F.count("*").alias("files"),
                    F.countDistinct(F.when(named, F.col("FormalNumber"))).alias("keys"),
                    F.coalesce(F.sum(F.when(named, 0).otherwise(1)), F.lit(0)).alias("missing"))


def corpus_metadata(texts: DataFrame, items: DataFrame) -> DataFrame:
    """Texts with the metadata of the first item whose PDF has the text's stem."""
    day = F.coalesce(F.nullif("date", F.lit("")), F.substring("legislationDate", 1, 10))
    meta = (items.where(F.coalesce("pdfUrl", F.lit("")) != "")
            .select(pdf_stem(F.col("pdfUrl")).alias("stem"),
                    F.col("number").alias("legislation_number"), "description",
                    day.alias("legislation_date"),
                    F.col("legislationTypeName").alias("legislation_type"), "sponsors",
                    F.col("pdfUrl").alias("pdf_url"), F.col("finalAction").alias("final_action"),
                    F.col("id").alias("_id"))
            .where(F.col("stem") != ""))
    first = first_wins(meta, "stem", ["legislation_date", "_id"]).drop("_id")
    return texts.join(first, "stem", "left")


def sponsor_profile(counts: DataFrame, roster: DataFrame) -> DataFrame:
    """(name, n) joined to the roster: known flag and items per meeting served."""
    m = F.col("meetings_during_tenure")
    known = roster.select("name", "meetings_during_tenure", F.lit(True).alias("is_known"))
    return (counts.join(known, "name", "left")
            .withColumn("is_known", F.coalesce("is_known", F.lit(False)))
            .withColumn("avg_per_meeting", F.when(F.col("is_known"),
                        F.when(m > 0, F.col("n") / m).otherwise(0.0))))


def tenure_meetings(terms: DataFrame, meetings: DataFrame) -> DataFrame:
    """Meetings within any term of a member, each counted once; terms as
    President do not count and members without a meeting show 0.

    Terms that overlap are merged and cut into calendar years; each year brings
    its list of days, so a term makes a row a year and none for a meeting.
    Neither side has to be broadcast and no nested loop is needed.
    """
    year = F.substring("date", 1, 4).try_cast("int")
    days = meetings.groupBy(year.alias("year")).agg(F.collect_set("date").alias("_days"))  # the days of one year at most
    last = meetings.agg(F.max("date")).scalar()
    counted = terms.where((F.coalesce("office", F.lit("")) != "President")
                          & (F.coalesce("start_date", F.lit("")) != ""))
    spans = counted.select("name", "start_date",
                           F.coalesce("end_date", F.greatest(last, F.col("start_date"))).alias("stop"))
    first_y = F.substring("start_date", 1, 4).try_cast("int")
    last_y = F.substring("stop", 1, 4).try_cast("int")
    spans = spans.where((last_y >= first_y) & (F.col("start_date") <= F.col("stop"))).distinct()
    # A term that starts after the end of all earlier ones opens a new span.
    w = Window.partitionBy("name").orderBy("start_date", "stop")
    before = F.max("stop").over(w.rowsBetween(Window.unboundedPreceding, -1))
    merged = (spans.withColumn("_new", F.coalesce(F.col("start_date") > before, F.lit(True)).cast("int"))
              .withColumn("_span", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
              .groupBy("name", "_span").agg(F.min("start_date").alias("start_date"), F.max("stop").alias("stop")))
    years = merged.select("name", "start_date", "stop", F.explode(F.sequence(first_y, last_y)).alias("year"))
    inside = F.size(F.filter("_days", lambda d: (d >= F.col("start_date")) & (d <= F.col("stop"))))
    held = years.join(days, "year").groupBy("name").agg(F.sum(inside).alias("_m"))
    return (terms.select("name").distinct().join(held, "name", "left")
            .select("name", F.coalesce("_m", F.lit(0)).alias("meetings_during_tenure")))


def sponsor_counts(exploded: DataFrame, sponsor: str = "sponsor") -> DataFrame:
    return exploded.groupBy(F.col(sponsor).alias("name")).agg(F.count("*").alias("n"))


def committee_counts(committees: DataFrame, exploded: DataFrame, sponsor: str = "sponsor") -> DataFrame:
    """Committees with their item counts (0 included) and whether they are active."""
    return (committees.join(sponsor_counts(exploded, sponsor), "name", "left")
            .withColumn("n", F.coalesce("n", F.lit(0)))
            .withColumn("active", F.col("end_date").isNull()))


def with_paper_type(items: DataFrame, exploded: DataFrame, committees: DataFrame,
                    members: DataFrame, id_col: str = "id", sponsor: str = "sponsor") -> DataFrame:
    """Add ``paperType`` to items given their (id, sponsor) rows."""
    names = (committees.select("name", F.lit(1).alias("c"), F.lit(0).alias("m"))
             .unionByName(members.select("name", F.lit(0).alias("c"), F.lit(1).alias("m")))
             .groupBy("name").agg(F.max("c").alias("c"), F.max("m").alias("m")))
    flags = (exploded.join(names, F.col(sponsor) == F.col("name"), "left")
             .groupBy(id_col).agg(F.max(F.coalesce("c", F.lit(0))).alias("_c"),
                                  F.max(F.coalesce("m", F.lit(0))).alias("_m")))
    return (items.join(flags, id_col, "left")
            .withColumn("paperType", paper_type_from_flags(
                F.col("_c").isNotNull(), F.col("_c") == 1, F.col("_m") == 1))
            .drop("_c", "_m"))


def paper_type_analysis(typed: DataFrame) -> DataFrame:
    """Class -> count and share; items without sponsors count as Unknown."""
    counts = typed.groupBy(F.coalesce("paperType", F.lit("Unknown")).alias("paper_type")) \
        .agg(F.count("*").alias("n"))
    return with_share(counts, "n")


def with_share(counts: DataFrame, n: str = "n", out: str = "percentage") -> DataFrame:
    """Share of the total in percent with one decimal."""
    total = counts.agg(F.sum(n)).scalar()
    return counts.withColumn(out, F.round(F.col(n).cast("decimal(20,0)") * 100 / total, 1).cast("double"))


def toc_merge(bookmarks: DataFrame, toc: DataFrame, keys=("package_id", "elms_id")) -> DataFrame:
    """Bookmarks with their table-of-contents fields, blank where missing.

    Of repeated entries the last row of the contents counts.
    """
    fields = ["leg_id", "sponsor", "description", "leg_type", "committee"]
    last = toc.groupBy(*keys).agg(F.max(F.struct("row", *fields)).alias("_t"))
    df = bookmarks.join(last, list(keys), "left")
    return df.withColumns({f: F.coalesce(F.col(f"_t.{f}"), F.lit("")) for f in fields}).drop("_t")


def news_with_links(news: DataFrame, links: DataFrame) -> DataFrame:
    """News rows with their links as an ordered array (empty where none)."""
    nested = links.groupBy(F.col("news_id").alias("id")).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("pos", "text", "href"))),
                    lambda l: F.struct(l["text"].alias("text"), l["href"].alias("href"))).alias("links"))
    return (news.join(nested, "id", "left")
            .withColumn("links", F.coalesce(
                "links", F.array().cast("array<struct<text:string,href:string>>"))))


def pending(inputs: DataFrame, *outputs: DataFrame, key: str) -> DataFrame:
    """Inputs that lack at least one of the outputs."""
    done = outputs[0].select(key)
    for other in outputs[1:]:
        done = done.join(other.select(key), key, "left_semi")
    return inputs.join(done, key, "left_anti")


def spine(spark_df: DataFrame, first: Column, last: Column, out: str) -> DataFrame:
    """Consecutive whole numbers between two aggregates of a table."""
    return spark_df.agg(first.alias("a"), last.alias("b")) \
        .select(F.explode(F.sequence("a", "b")).alias(out))


def calendar_years(meetings: DataFrame) -> DataFrame:
    """Every year of every decade touched, with its meeting count."""
    year = F.substring("date", 1, 4).cast("int")
    decade = F.floor(year / 10).cast("int") * 10
    counts = meetings.groupBy(year.alias("year")).agg(F.count("*").alias("meetings"))
    years = spine(meetings, F.min(decade), F.max(decade) + 9, "year")
    return (years.join(counts, "year", "left")
            .select((F.floor(F.col("year") / 10) * 10).cast("int").alias("decade"), "year",
                    F.coalesce("meetings", F.lit(0)).alias("meetings"),
                    F.col("meetings").isNotNull().alias("available")))


def calendar_months(meetings: DataFrame, year: int) -> DataFrame:
    """The twelve months of a year with their meeting counts."""
    counts = (meetings.where(F.col("date").startswith(f"{year}-"))
              .groupBy(F.substring("date", 6, 2).cast("int").alias("month"))
              .agg(F.count("*").alias("meetings")))
    months = meetings.sparkSession.range(1, 13).select(F.col("id").cast("int").alias("month"))
    return (months.join(counts, "month", "left")
            .select(F.format_string("%d-%02d", F.lit(year), "month").alias("period"),
                    F.date_format(F.make_date(F.lit(year), "month", F.lit(1)), "MMMM").alias("label"),
                    F.coalesce("meetings", F.lit(0)).alias("meetings")))
