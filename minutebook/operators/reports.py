"""Extraction tables and the reports over them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from minutebook.functions import donations as don
from minutebook.functions import legislation as leg
from minutebook.functions import settlements as stl
from minutebook.functions.claims import claim_type, is_claim
from minutebook.functions.money import dollar_amount
from minutebook.functions.text import HOME
from minutebook.operators.tables import materialize
from minutebook.operators.joins import with_share

# --- fixed values: words and patterns the reports look for ------------------
REPORT_KEYWORDS = (
    "ADOPTED", "FILED", "APPROVED", "REJECTED", "WITHDRAWN", "TABLED",
    "DEFERRED", "REFERRED", "PASSED", "FAILED", "VETOED", "CARRIED",
    "DEFEATED", "POSTPONED", "HELD", "CONTINUED",
)
SPONSOR_KEYWORDS = (
    r"SPONSOR(?:ED)?\s*BY",
    r"SPONSOR(?:S)?:",
    r"INTRODUCED BY",
    r"COUNCILMEMBER",
    r"COUNCIL\s*MEMBER",
    r"CM\.",
    r"CO-SPONSOR",
)
SAMPLE_PHRASES = ("BY COUNCILMEMBER", "BY COUNCIL MEMBER", "SPONSORED BY", "CO-SPONSOR", "INTRODUCED BY")
# ----------------------------------------------------------------------------


def _common(items: DataFrame) -> list[Column]:
    """Columns both extraction tables share; absent ones come out NULL."""
    def col(name: str, kind: str = "string") -> Column:
        return F.col(name) if name in items.columns else F.lit(None).cast(kind)
    day = "legislationDate" if "legislationDate" in items.columns else "date"
    return [
        F.col("id"), col("meetingDocId", "bigint").alias("meeting_doc_id"), F.col("number"),
        F.substring(F.coalesce(F.col(day), F.lit("")), 1, 10).alias("legislation_date"),
        col("legislationTypeName").alias("legislation_type"),
        F.coalesce(col("finalAction"), F.lit("")).alias("final_action"),
        col("pdfUrl").alias("pdf_url"),
        F.array_join(F.coalesce(col("sponsors", "array<string>"),
                                F.array().cast("array<string>")), ", ").alias("sponsors"),
        F.col("description"),
    ]


def parse_donations(items: DataFrame, compat: bool = False, city: str = HOME) -> DataFrame:
    """One row per donation to or by the ``city``, with the columns of the donation report."""
    d = F.col("description")
    found = (items.where(don.mentions_donation(d))
             .withColumn("donation_direction", don.donation_direction(d, compat, city))
             .where(F.col("donation_direction").isNotNull()))
    accepted = F.col("donation_direction") == "accepted"
    return (found.select(*_common(found), "donation_direction",
                         dollar_amount(d).alias("amount"),
                         F.when(accepted, don.donor(d)).alias("donor"),
                         F.when(~accepted, don.recipient(d, city)).alias("recipient"),
                         don.item_donated(d).alias("item_donated"),
                         don.purpose(d).alias("purpose"))
            .withColumn("donation_type", don.donation_type(d, F.col("item_donated")))
            .select(*don.COLUMNS))


def tag_claims(items: DataFrame, action: str = "finalAction") -> DataFrame:
    return items.withColumn("claimType", F.when(is_claim(F.col("description")), claim_type(F.col(action))))


def parse_settlements(items: DataFrame, city: str = HOME) -> DataFrame:
    """Individual claims (tagged as settled) and court settlements (untagged,
    mentioning a settlement amount) in one table."""
    tag = F.lower(F.coalesce("claimType", F.lit("")))
    d = F.col("description")
    raw = F.coalesce("claimType", F.lit("")).alias("claim_type_raw")

    def branch(rows: DataFrame, category: str, parsed: dict[str, Column]) -> DataFrame:
        out = rows.select(*_common(rows), raw, F.lit(category).alias("settlement_category"),
                          *[c.alias(k) for k, c in parsed.items()])
        absent = [c for c in stl.COLUMNS if c not in out.columns]
        return out.select(*[F.lit(None).cast("string").alias(c) if c in absent else F.col(c)
                            for c in stl.COLUMNS])

    individual = branch(items.where(tag == "settlement"), "individual_claim", stl.individual_claim(d))
    court = branch(items.where((tag == "") & F.contains(F.upper(d), F.lit(stl.COURT_PHRASE))),
                   "court_litigation", stl.court_settlement(d, city))
    return individual.unionByName(court)


def _has(amount: str = "amount") -> Column:
    return F.coalesce(F.col(amount), F.lit(0)) != 0


def _total(test: Column, amount: str = "amount") -> Column:
    zero = F.lit(0).cast("decimal(18,2)")
    return F.coalesce(F.sum(F.when(test, F.col(amount))), zero).cast("decimal(28,2)")


def donation_summary(d: DataFrame) -> DataFrame:
    accepted, made = F.col("donation_direction") == "accepted", F.col("donation_direction") == "made"
    money, kind = F.col("donation_type") == "monetary", F.col("donation_type") == "in_kind"
    return d.agg(
        F.count("*").alias("total_count"),
        F.count_if(accepted).alias("accepted_count"), _total(accepted).alias("accepted_total"),
        F.count_if(made).alias("made_count"), _total(made).alias("made_total"),
        _total(accepted | made).alias("grand_total"),
        F.count_if(money).alias("monetary_count"), _total(money).alias("monetary_total"),
        F.count_if(kind).alias("inkind_count"), _total(kind).alias("inkind_total"))


def settlement_summary(s: DataFrame) -> DataFrame:
    ind = F.col("settlement_category") == "individual_claim"
    court = F.col("settlement_category") == "court_litigation"
    return s.agg(
        F.count("*").alias("total_count"),
        F.count_if(ind).alias("individual_count"), _total(ind).alias("individual_total"),
        F.count_if(court).alias("court_count"), _total(court).alias("court_total"),
        _total(ind | court).alias("grand_total"))


def amount_report(df: DataFrame, group: str, median: bool = False) -> DataFrame:
    """Per group: rows, rows with an amount, total, average, maximum and, on
    request, the upper median.

    The median is exact without sorting a group in one task: amounts are first
    counted per distinct value, and the running count finds the middle one.
    """
    base = df.groupBy(group).agg(
        F.count("*").alias("n"), F.count_if(_has()).alias("with_amount"),
        _total(_has()).alias("total"), F.max(F.when(_has(), F.col("amount"))).alias("max_amount"))
    base = base.withColumn("average", F.when(F.col("with_amount") > 0, F.round(
        F.col("total") / F.col("with_amount"), 2)))
    if not median:
        return base
    values = df.where(_has()).groupBy(group, "amount").agg(F.count("*").alias("_c"))
    return base.join(upper_median(values, group), group, "left")


def upper_median(values: DataFrame, group: str, ranges: int = 1024) -> DataFrame:
    """Element ``n // 2`` of the sorted amounts, from (group, amount, _c) counts.

    Counts per range of amounts, at most ``ranges`` for each group, show which
    range holds the middle; only the amounts of that range are ordered.
    """
    span = values.groupBy(group).agg(F.min("amount").alias("_low"), F.max("amount").alias("_high"), F.sum("_c").alias("_n"))
    width = (F.col("_high") - F.col("_low")).cast("double")
    share = (F.col("amount") - F.col("_low")).cast("double") / width
    cut = values.join(span, group).withColumn("_range", F.when(width > 0, F.floor(share * (ranges - 1))).otherwise(0))
    sums = cut.groupBy(group, "_range", "_n").agg(F.sum("_c").alias("_in"))
    before = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)
    middle = F.floor(F.col("_n") / 2)
    held = (sums.withColumn("_upto", F.sum("_in").over(before))
            .where((F.col("_upto") > middle) & (F.col("_upto") - F.col("_in") <= middle))
            .select(group, "_range", (middle - (F.col("_upto") - F.col("_in"))).alias("_skip")))
    down = Window.partitionBy(group).orderBy(F.col("amount").asc())
    return (cut.join(held, [group, "_range"]).withColumn("_upto", F.sum("_c").over(down))
            .where((F.col("_upto") > F.col("_skip")) & (F.col("_upto") - F.col("_c") <= F.col("_skip")))
            .select(group, F.col("amount").alias("median")))


def top_values(df: DataFrame, column: str, k: int) -> DataFrame:
    """Most frequent non-empty values."""
    return (df.where(F.coalesce(column, F.lit("")) != "")
            .groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
            .orderBy(F.col("n").desc(), F.col("value").asc()).limit(k))


def filtered_totals(df: DataFrame, group: str) -> DataFrame:
    """Totals over whatever filter was applied before."""
    return df.groupBy(group).agg(F.count("*").alias("n"), _total(_has()).alias("total"))


def admin_totals(df: DataFrame, shown: DataFrame) -> DataFrame:
    excluded = df.agg(F.count_if(F.coalesce("excluded", F.lit(False)))).scalar()
    direction = F.col("donation_direction")
    return shown.agg(F.count("*").alias("total"), F.count_if(direction == "accepted").alias("accepted"),
                     F.count_if(direction == "made").alias("made")).withColumn("excluded", excluded)


# --- description reports ----------------------------------------------------

def action_context(description: Column) -> tuple[Column, Column]:
    """(keyword, last context) of the first listed keyword that occurs."""
    up = F.upper(F.trim(description))

    def context(k: str) -> Column:
        hits = F.regexp_extract_all(up, F.lit(rf"([A-Z\s,;]*{k}[^.]*)"))
        return F.when(F.contains(up, F.lit(k)), F.trim(F.try_element_at(hits, F.lit(-1))))

    keyword = reduce(lambda acc, k: acc.when(F.contains(up, F.lit(k)), k), REPORT_KEYWORDS, F)
    return keyword, F.coalesce(*[context(k) for k in REPORT_KEYWORDS])


def with_action_pattern(items: DataFrame, description: str = "description") -> DataFrame:
    """Add keyword, context, pattern class, vote flag and confidence band."""
    d = F.col(description)
    keyword, context = action_context(d)
    return (
        items.where(F.coalesce(d, F.lit("")) != "")
        .withColumn("keyword", keyword).withColumn("context", context)
        .withColumn("pattern", F.when(F.col("keyword").isNull(), "NO_CLEAR_ACTION")
                    .when(F.contains("context", F.lit("ROLL CALL VOTE")), "ACTION_WITH_VOTE")
                    .when(F.contains("context", F.lit("CONSENT")), "ACTION_ON_CONSENT")
                    .otherwise("ACTION_SIMPLE"))
        .withColumn("has_vote", F.contains(F.upper(d), F.lit("ROLL CALL VOTE")))
        .withColumn("confidence", F.when(F.col("pattern").isin("ACTION_WITH_VOTE", "ACTION_ON_CONSENT"), "high")
                    .when(F.col("pattern") == "ACTION_SIMPLE", "medium").otherwise("low")))


def count_by(df: DataFrame, column: str, name: str) -> DataFrame:
    return (df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("value"))
            .agg(F.count("*").alias("n")).select(F.lit(name).alias("measure"), "value", "n"))


def action_keyword_report(items: DataFrame) -> DataFrame:
    """(measure, value, n) for keywords, pattern classes, votes and confidence.

    One pass: the four labels of a row are counted together.
    """
    labels = ("keyword", "pattern", "has_vote", "confidence")
    rows = F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast("string").alias("value"))
                     for m in labels])
    return (with_action_pattern(items).select(F.inline(rows)).where(F.col("value").isNotNull())
            .groupBy("measure", "value").agg(F.count("*").alias("n")))


def sponsor_pattern_report(items: DataFrame, description: str = "description") -> DataFrame:
    """Rows that show each sponsor wording, and rows that show any, in one pass."""
    d = F.coalesce(F.col(description), F.lit(""))
    flags = [d.rlike("(?iU)" + p) for p in SPONSOR_KEYWORDS]
    either = reduce(lambda a, b: a | b, flags)
    totals = items.agg(*[F.count_if(f).alias(f"p{i}") for i, f in enumerate(flags)],
                       F.count_if(either).alias("any"), F.count("*").alias("all"))
    rows = F.array(*[F.struct(F.lit(p).alias("pattern"), F.col(f"p{i}").alias("n"))
                     for i, p in enumerate(SPONSOR_KEYWORDS)],
                   F.struct(F.lit("any").alias("pattern"), F.col("any").alias("n")),
                   F.struct(F.lit("total").alias("pattern"), F.col("all").alias("n")))
    return totals.select(F.inline(rows))


def type_distribution(items: DataFrame, strict: bool = False) -> DataFrame:
    """Type code -> count and share of all items; '' for items without one."""
    code = leg.legislation_type_strict if strict else leg.legislation_type
    counts = items.groupBy(F.coalesce(code(F.col("number")), F.lit("")).alias("type_code")) \
        .agg(F.count("*").alias("n"))
    return with_share(counts)


def sponsor_span(exploded: DataFrame, sponsor: str = "sponsor") -> DataFrame:
    return (exploded.where(F.coalesce(sponsor, F.lit("")) != "")
            .groupBy(F.col(sponsor).alias("name"))
            .agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"),
                 F.count("*").alias("n")))


def final_action_counts(items: DataFrame, action: str = "finalAction") -> DataFrame:
    label = F.coalesce(F.nullif(action, F.lit("")), F.lit("(empty)"))
    return items.groupBy(label.alias("action")).agg(F.count("*").alias("n"))


def news_stats(news: DataFrame) -> DataFrame:
    """Totals with hidden rows and without, id range and time range."""
    shown = ~F.coalesce(F.col("is_hidden").cast("boolean"), F.lit(False))
    return news.agg(F.count("*").alias("total_news"), F.count_if(shown).alias("visible_news"),
                    F.min("id").alias("min_id"), F.max("id").alias("max_id"),
                    F.min("ts").alias("earliest"), F.max("ts").alias("latest"))


def news_type_counts(news: DataFrame, include_hidden: bool = False) -> DataFrame:
    from minutebook.operators.search import visible
    df = news if include_hidden else visible(news)
    return df.groupBy(F.coalesce("type", F.lit("Unknown")).alias("type")).agg(F.count("*").alias("n"))


def corpus_stats(docs: DataFrame, chars: str = "char_count", date: str = "legislation_date",
                 kind: str = "legislation_type") -> DataFrame:
    return docs.agg(F.count("*").alias("total_documents"),
                    F.coalesce(F.sum(chars), F.lit(0)).alias("total_characters"),
                    F.min(date).alias("earliest_date"), F.max(date).alias("latest_date"),
                    F.countDistinct(kind).alias("type_count"))


def run_outcomes(log: DataFrame) -> DataFrame:
    """Run-log outcomes with their share."""
    s = F.col("status")
    outcome = (F.when(s.isin("200", "success"), "downloaded").when(s == "exists", "exists")
               .when(s == "404", "not_found").otherwise("error"))
    return with_share(log.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n")))


def ocr_outcomes(runs: DataFrame) -> DataFrame:
    return runs.agg(F.count("*").alias("files"), F.sum("text_characters").alias("characters"),
                    F.sum(F.coalesce("rotation_corrected", F.lit(0))).alias("rotated_pages"),
                    F.count_if(F.col("status") == "success").alias("successful"))


def _bucket(id_col: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(id_col), F.lit(buckets))


def changed_buckets(before: DataFrame, after: DataFrame, columns: list[str], id_col: str = "id", buckets: int = 1024) -> DataFrame:
    """Buckets of ids in which the two tables differ: at most ``buckets`` rows.

    A bucket's digest is its number of rows and the sums of two 64-bit hashes
    of their id and columns, added up where the rows lie; no row travels.
    """
    cells = [x for c in columns for x in (F.col(c).cast("string"), F.col(c).isNull())]

    def digests(df: DataFrame, side: str) -> DataFrame:
        total = lambda seed: F.sum(F.xxhash64(F.lit(seed), id_col, *cells).cast("decimal(38,0)"))
        return df.groupBy(_bucket(id_col, buckets).alias("_bucket")).agg(F.struct(F.count("*"), total(1), total(2)).alias(side))

    both = digests(before, "old").join(digests(after, "new"), "_bucket", "full_outer")
    return both.where(~F.col("old").eqNullSafe(F.col("new"))).select("_bucket")


def changes(before: DataFrame, after: DataFrame, columns: list[str], id_col: str = "id", buckets: int = 1024) -> DataFrame:
    """One row per changed value: id, column, old, new (the dry run of any correction).

    Digests of the buckets are compared first; only rows of buckets that
    differ are joined, so what did not change costs one digest and no exchange.
    """
    differ = F.broadcast(materialize(changed_buckets(before, after, columns, id_col, buckets), "differing"))  # a number for each bucket

    def side(df: DataFrame, mark: str) -> DataFrame:
        some = df.withColumn("_bucket", _bucket(id_col, buckets)).join(differ, "_bucket", "left_semi")
        return some.select(id_col, *[F.col(c).cast("string").alias(f"{mark}{i}") for i, c in enumerate(columns)])

    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"_o{i}").alias("old"),
                               F.col(f"_n{i}").alias("new")) for i, c in enumerate(columns)])
    return (side(before, "_o").join(side(after, "_n"), id_col, "full_outer").select(id_col, F.inline(cells))
            .where(~F.col("old").eqNullSafe(F.col("new"))))


def change_report(before: DataFrame, after: DataFrame, columns: list[str], id_col: str = "id", buckets: int = 1024) -> DataFrame:
    """(column, rows changed) plus ``checked`` and ``changed`` totals."""
    rows = materialize(changes(before, after, columns, id_col, buckets), "changes")
    per = rows.groupBy("column").agg(F.count("*").alias("n"))
    touched = rows.agg(F.countDistinct(id_col).alias("n")).select(F.lit("(changed rows)").alias("column"), "n")
    checked = before.agg(F.count("*").alias("n")).select(F.lit("(checked rows)").alias("column"), "n")
    return per.unionByName(touched).unionByName(checked)


def extraction_confidence(items: DataFrame, column: str = "sponsorConfidence") -> DataFrame:
    counts = items.groupBy(F.coalesce(column, F.lit("none")).alias("confidence")) \
        .agg(F.count("*").alias("n"))
    return with_share(counts)


def top_sponsors(items: DataFrame, k: int = 20) -> DataFrame:
    return top_values(items.select(F.explode("sponsors").alias("sponsor")), "sponsor", k)


def file_type_counts(links: DataFrame) -> DataFrame:
    return links.groupBy("file_type").agg(F.count("*").alias("n"))


def merge_preview(counts: DataFrame, names) -> DataFrame:
    """Items a merge would touch and the most frequent spelling."""
    return counts.where(F.col("name").isin(*names)).agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("affected"),
        F.min_by("name", F.struct((-F.col("n")).alias("n"), F.col("name").alias("s"))).alias("canonical"),
        F.count("*").alias("variations"))

