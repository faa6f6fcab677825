"""Roll-ups of items by period, action and type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from minutebook.functions.legislation import action_categories, final_action_category
from minutebook.operators.joins import with_share

PERIODS = {"year": 4, "month": 7, "date": 10, "term": 4}


def period_of(date: Column, group_by: str) -> Column:
    return F.substring(date, 1, PERIODS[group_by])


def in_range(df: DataFrame, start: str | None, end: str | None) -> DataFrame:
    if start:
        df = df.where(F.col("date") >= start)
    if end:
        df = df.where(F.col("date") <= end)
    return df


def prepared(items: DataFrame) -> DataFrame:
    """Items with the category and type name the roll-ups count."""
    return (items.withColumn("category", final_action_category(F.col("finalAction")))
            .withColumn("type_name", F.coalesce(F.nullif("legislationTypeName", F.lit("")),
                                                F.lit("Unknown"))))


def summary(items: DataFrame, meetings: DataFrame, start=None, end=None) -> DataFrame:
    """Total items and meetings; meetings without items count."""
    held = in_range(meetings, start, end).agg(F.countDistinct("date").alias("total_meetings"))
    return (in_range(items, start, end).agg(F.count("*").alias("total_items"))
            .withColumn("total_meetings", held.scalar()))


def distribution(items: DataFrame, column: str, start=None, end=None) -> DataFrame:
    counts = in_range(items, start, end).groupBy(F.col(column).alias("key")).agg(F.count("*").alias("n"))
    return with_share(counts)


def timeline(items: DataFrame, meetings: DataFrame, group_by: str = "year",
             start=None, end=None) -> DataFrame:
    """Per period: items, meetings and the maps action -> n and type -> n.

    Counting by (period, action, type) first leaves a few rows per period, so
    the maps are put together from counts and not from items.
    """
    cells = (in_range(items, start, end)
             .groupBy(period_of(F.col("date"), group_by).alias("period"), "category", "type_name")
             .agg(F.count("*").alias("n")))

    def as_map(key: str) -> DataFrame:
        return (cells.groupBy("period", key).agg(F.sum("n").alias("n"))
                .groupBy("period").agg(F.map_from_entries(F.sort_array(
                    F.collect_list(F.struct(key, "n")))).alias(f"{key}_counts"),
                    F.sum("n").alias(f"{key}_total")))

    held = (in_range(meetings, start, end).select("date").distinct()
            .groupBy(period_of(F.col("date"), group_by).alias("period"))
            .agg(F.count("*").alias("meetings")))
    by_action, by_type = as_map("category"), as_map("type_name").drop("type_name_total")
    return (held.join(by_action, "period", "full_outer").join(by_type, "period", "left")
            .select("period", F.coalesce("category_total", F.lit(0)).alias("total_items"),
                    F.coalesce("meetings", F.lit(0)).alias("meetings"),
                    F.col("category_counts").alias("actions"),
                    F.col("type_name_counts").alias("types")))


def council_terms(spark: SparkSession, min_year: int = 1984, max_year: int = 2026,
                  as_of_year: int = 2022) -> DataFrame:
    """Four-year terms that start where (year - 2) is divisible by 4."""
    start = min_year - (min_year - 2) % 4
    return term_rows(spark.range(start, max_year + 1, 4).select(F.col("id").cast("int").alias("start")),
                     as_of_year)


def term_rows(starts: DataFrame, as_of_year: int) -> DataFrame:
    end = F.col("start") + 3
    return starts.select(
        F.concat_ws("-", F.col("start").cast("string"), end.cast("string")).alias("label"),
        "start", end.alias("end"),
        ((F.col("start") <= as_of_year) & (end >= as_of_year)).alias("is_current"))


def term_start(year: Column) -> Column:
    return year - F.pmod(year - 2, F.lit(4))


def terms_spanned(meetings: DataFrame, as_of_year: int = 2022) -> DataFrame:
    """The terms from the first to the last meeting year of a table."""
    year = F.substring("date", 1, 4).cast("int")
    starts = meetings.agg(term_start(F.min(year)).alias("a"), F.max(year).alias("b")) \
        .select(F.explode(F.sequence("a", "b", F.lit(4))).alias("start"))
    return term_rows(starts, as_of_year)


def hierarchy(items: DataFrame) -> DataFrame:
    """Item counts at every level: all, term, year, month, date -- one rollup.

    Rows are first counted per date, so the rollup expands dates, not items.
    """
    year = F.substring("date", 1, 4).cast("int")
    per_day = (items.groupBy("date").agg(F.count("*").alias("n"))
               .select(term_start(year).alias("term"), year.alias("year"),
                       F.substring("date", 1, 7).alias("month"), "date", "n"))
    grouping = F.grouping_id()
    return (per_day.rollup("term", "year", "month", "date")
            .agg(F.sum("n").alias("total_items"), F.count("*").alias("meeting_days"),
                 grouping.alias("_g"))
            .withColumn("level", F.when(F.col("_g") == 15, "all").when(F.col("_g") == 7, "term")
                        .when(F.col("_g") == 3, "year").when(F.col("_g") == 1, "month")
                        .otherwise("date"))
            .drop("_g"))


def drill_bounds(level: str, value: str | None) -> tuple[str | None, str | None, str]:
    """Date bounds of a drill-down cell and the period its children have."""
    if level == "term" and value:
        first, last = value.split("-")
        return f"{first}-01-01", f"{last}-12-31", "year"
    if level == "year" and value:
        return f"{value}-01-01", f"{value}-12-31", "month"
    if level == "month" and value:
        return f"{value}-01", f"{value}-31", "date"
    return None, None, "year"


def drill_down(items: DataFrame, meetings: DataFrame, level: str = "all",
               value: str | None = None) -> DataFrame:
    """Children of one cell with items and meetings, empty children included.

    Children of ``all`` are terms, of a term its years, of a year its months,
    of a month the dates that had a meeting.
    """
    start, end, period = drill_bounds(level, value)
    spark = items.sparkSession
    if level == "all":
        cell = F.concat_ws("-", term_start(F.substring("date", 1, 4).cast("int")).cast("string"),
                           (term_start(F.substring("date", 1, 4).cast("int")) + 3).cast("string"))
        children = terms_spanned(meetings).select(F.col("label").alias("value"))
    else:
        cell = period_of(F.col("date"), period)
        if level == "term":
            first, last = (int(y) for y in value.split("-"))
            children = spark.range(first, last + 1).select(F.col("id").cast("string").alias("value"))
        elif level == "year":
            children = spark.range(1, 13).select(
                F.format_string("%s-%02d", F.lit(value), F.col("id")).alias("value"))
        else:
            children = in_range(meetings, start, end).select(F.col("date").alias("value")).distinct()
    n = in_range(items, start, end).groupBy(cell.alias("value")).agg(F.count("*").alias("total_items"))
    held = (in_range(meetings, start, end).select("date").distinct()
            .groupBy(cell.alias("value")).agg(F.count("*").alias("meetings")))
    return (children.join(n, "value", "left").join(held, "value", "left")
            .select("value", F.coalesce("total_items", F.lit(0)).alias("total_items"),
                    F.coalesce("meetings", F.lit(0)).alias("meetings")))


def adoption_rate(items: DataFrame) -> DataFrame:
    """Integer percent of adopted items, first and last year."""
    adopted = F.sum(F.when(F.col("category").startswith("ADOPTED"), 1).otherwise(0))
    year = F.substring("date", 1, 4)
    return items.agg(
        F.floor(adopted * 100 / F.count("*") + F.lit(0.5).cast("decimal(2,1)")).cast("int").alias("adoption_rate"),
        F.min(year).alias("first_period"), F.max(year).alias("last_period"))


def action_pivot(items: DataFrame, categories: list[str] | None = None, group_by: str = "year") -> DataFrame:
    """Period x action matrix, zero filled, over all categories unless some are chosen.

    Naming the columns saves a pass over the data.
    """
    categories = categories or action_categories()
    return (items.groupBy(period_of(F.col("date"), group_by).alias("period"))
            .pivot("category", categories).count().na.fill(0))


def dates_by_year(items: DataFrame) -> DataFrame:
    """Per year its dates, newest first, with the number of dates and items."""
    per_day = items.groupBy("date").agg(F.count("*").alias("n"))
    return (per_day.groupBy(F.substring("date", 1, 4).alias("year"))
            .agg(F.sort_array(F.collect_list("date"), asc=False).alias("dates"),
                 F.count("*").alias("date_count"), F.sum("n").alias("item_count")))
