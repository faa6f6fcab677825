"""Samples, pages, sort orders and running groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from minutebook.functions.dates import office_rank, office_section
from minutebook.functions.text import squeeze, strip
from minutebook.operators.tables import materialize


def samples_per_group(df: DataFrame, group, order: list[str], n: int) -> DataFrame:
    """At most ``n`` rows per group, first in order.

    Spark cuts a ranked window to its limit before the shuffle, so a group that
    holds most rows sends ``n`` rows per task and no more.
    """
    keys = [group] if isinstance(group, str) else list(group)
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n) \
        .withColumnRenamed("_rn", "sample_no")


def page_ranges(bookmarks: DataFrame, totals: DataFrame | None = None) -> DataFrame:
    """``page_end``: next start minus one, the package's last page at the end."""
    w = Window.partitionBy("package_id").orderBy("seq")
    df = bookmarks.withColumn("_next", F.lead("page_start").over(w))
    if totals is not None:
        df = df.join(totals, "package_id", "left")
    last = F.col("total_pages") if "total_pages" in df.columns else F.lit(None).cast("int")
    return df.withColumn("page_end", F.coalesce("_next", last) - 1).drop("_next")


def group_lines(lines: DataFrame, doc: str, pos: str, line: str,
                start: str = r"^\d+\s+\d{5}\s+", chunk: int = 10_000) -> DataFrame:
    """Join every line that opens a record with the lines that follow it.

    Lines before the first opening line are dropped; ``pos`` is a whole number.
    Lines are numbered inside chunks of ``chunk`` positions, and each chunk
    starts from the number of records opened before it, so a document of any
    length is spread over tasks and a record may run over the borders of chunks.
    """
    text = strip(F.col(line))
    opens = F.when(text.rlike(start), 1).otherwise(0)
    rows = lines.select(doc, pos, text.alias("_t"), opens.alias("_o"), F.floor(F.col(pos) / chunk).alias("_chunk"))
    sums = rows.groupBy(doc, "_chunk").agg(F.sum("_o").alias("_n"))
    before = Window.partitionBy(doc).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select(F.col(doc).alias("_d"), F.col("_chunk").alias("_c"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_carried"))
    w = Window.partitionBy(doc, "_chunk").orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    return (rows.withColumn("_own", F.sum("_o").over(w))
            .join(carried, F.col(doc).eqNullSafe(F.col("_d")) & (F.col("_chunk") == F.col("_c")))
            .select(doc, pos, "_t", (F.col("_carried") + F.col("_own")).alias("record"))
            .where((F.col("record") > 0) & (F.col("_t") != ""))
            .groupBy(doc, "record")
            .agg(F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col("_t").alias("t")))).alias("_l"))
            .select(doc, "record", squeeze(F.array_join(F.transform("_l", lambda s: s["t"]), " ")).alias("text")))


def failure_cutoff(results: DataFrame, n: int, id_col: str = "id", miss: str = "miss",
                   bucket: int = 1 << 20) -> DataFrame:
    """Id of the first try at which ``n`` tries in a row have missed (NULL if none).

    Tries are counted, not ids: ids that were skipped do not end a run.  Tries
    are numbered inside ranges of ids and the ranges' counts added up; the last
    ``n - 1`` numbers of a bucket are also given to the next one, so runs across
    a border are seen without one global order.
    """
    if not 1 <= n <= bucket:
        raise ValueError("n must be at least 1 and at most the width of a bucket")
    rows = results.select(F.col(id_col).alias("_id"), F.coalesce(F.col(miss).cast("int"), F.lit(0)).alias("_m"),
                          F.floor(F.col(id_col) / bucket).alias("_range"))
    sizes = rows.groupBy("_range").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_range").orderBy("_id"))
    tries = rows.withColumn("_row", within).join(offsets, "_range").select(
        "_id", "_m", (F.col("_before") + F.col("_row")).alias("_try"))
    key = F.floor(F.col("_try") / bucket)
    tail = F.pmod(F.col("_try"), F.lit(bucket)) >= bucket - (n - 1)
    copies = F.when(tail, F.array(key, key + 1)).otherwise(F.array(key))
    spread = tries.select("_id", "_try", "_m", F.explode(copies).alias("_b"))
    back = Window.partitionBy("_b").orderBy("_try").rangeBetween(-(n - 1), 0)
    return (spread.withColumn("_run", F.sum("_m").over(back))
            .where((F.col("_run") == n) & (F.col("_m") == 1))
            .agg(F.min("_id").alias("cutoff_id")))


def page(df: DataFrame, order: list, number: int, size: int) -> DataFrame:
    """Ordered page; only the rows up to the page end are kept while sorting."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def page_count(df: DataFrame, size: int) -> DataFrame:
    return df.agg(F.count("*").alias("total"), F.ceil(F.count("*") / size).alias("pages"))


def page_after(df: DataFrame, key: str, last, size: int, descending: bool = True) -> DataFrame:
    """Deep pages: continue after the last key seen instead of counting rows off."""
    if last is not None:
        df = df.where(F.col(key) < last if descending else F.col(key) > last)
    return df.orderBy(F.col(key).desc() if descending else F.col(key).asc()).limit(size)


def positions(ordered: DataFrame, name: str = "pos") -> DataFrame:
    """Number the rows of a sorted table from 1.

    Range partitions are counted and the counts added up, so no task sees more
    than its own part.  The sorted table is written once, as its cut must not
    change between the two passes.
    """
    number = F.monotonically_increasing_id()
    kept = materialize(ordered.select("*", F.shiftright(number, 33).alias("_part"),
                                      number.bitwiseAND(F.lit((1 << 33) - 1)).alias("_row")), "ordered")
    sizes = kept.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return (kept.join(offsets, "_part").withColumn(name, F.col("_before") + F.col("_row") + 1)
            .drop("_part", "_row", "_before"))


def sort_rows(df: DataFrame, column: str, descending: bool = False, tie: str = "id") -> DataFrame:
    """Sort by one column, empty values last in both directions."""
    c = F.col(column)
    return df.orderBy(c.desc_nulls_last() if descending else c.asc_nulls_last(), F.col(tie).asc())


def sort_rows_admin(df: DataFrame, column: str, descending: bool = False, tie: str = "id") -> DataFrame:
    """Admin table: an empty value sorts like an empty string."""
    c = F.col(column)
    return df.orderBy(c.desc_nulls_last() if descending else c.asc_nulls_first(), F.col(tie).asc())


ROSTER_ORDERS = {
    "count-desc": ("n", True), "count-asc": ("n", False),
    "avg-desc": ("avg_per_meeting", True), "avg-asc": ("avg_per_meeting", False),
    "name-asc": ("name", False), "name-desc": ("name", True),
    "start-desc": ("start_date", True), "start-asc": ("start_date", False),
}
LIST_ORDERS = {k: ROSTER_ORDERS[k] for k in ("count-desc", "count-asc", "name-asc", "name-desc")}


def sort_roster(df: DataFrame, order: str, orders=ROSTER_ORDERS) -> DataFrame:
    """Roster or list order; a missing count or start sorts as 0 or ''."""
    column, descending = orders[order]
    c = F.col(column)
    key = c.desc_nulls_last() if descending else c.asc_nulls_first()
    return df.orderBy(key, F.col("name").asc())


def sample_endings(df: DataFrame, text: str, n: int, seed: int = 42, width: int = 100,
                   tie: str = "id") -> DataFrame:
    """Last characters of ``n`` randomly chosen texts; one seed always chooses the same."""
    t = F.col(text)
    return (df.where(F.coalesce(t, F.lit("")) != "")
            .orderBy(F.md5(F.concat_ws("-", F.lit(str(seed)), F.col(tie).cast("string"))), tie).limit(n)
            .select(F.right(F.trim(t), F.lit(width)).alias("ending")))


def office_members(terms: DataFrame) -> DataFrame:
    """Terms by office in office order, with an ordinal per member of the office."""
    held = terms.where(F.coalesce("office", F.lit("")) != "")
    first = held.groupBy("office", "name").agg(F.min(F.struct("start_date", "name")).alias("_first"))
    w = Window.partitionBy("office").orderBy("_first")
    numbered = first.withColumn("ordinal", F.dense_rank().over(w) - 1).drop("_first")
    rank = office_rank(F.col("office"))
    return (held.join(numbered, ["office", "name"])
            .withColumn("section", office_section(F.col("office")))
            .withColumn("office_group", rank["group"]).withColumn("office_seat", rank["seat"]))


def members_without_office(terms: DataFrame) -> DataFrame:
    """Members none of whose terms names an office, by first start."""
    named = F.max(F.when(F.coalesce("office", F.lit("")) != "", 1).otherwise(0))
    return (terms.groupBy("name").agg(named.alias("_o"), F.min("start_date").alias("first_start"))
            .where("_o = 0").drop("_o").orderBy("first_start", "name"))

