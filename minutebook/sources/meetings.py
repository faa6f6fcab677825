"""Meeting files, rosters, committees and API documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from minutebook import schemas

CORRUPT = "_corrupt"


def json_records(spark: SparkSession, path, schema: T.StructType, lines: bool | None = None) -> DataFrame:
    """Records of JSON files, with the file's name and folder year.

    Files that Spark wrote (``part-...``) hold one record per line; all others
    are one document each, however it is laid out.  ``lines`` forces one way
    for all files.  The test on the file name is decided before a file is opened.
    """
    with_corrupt = T.StructType(schema.fields + [T.StructField(CORRUPT, T.StringType())])

    def read(by_line: bool) -> DataFrame:
        raw = (spark.read.schema(with_corrupt)
               .option("multiLine", not by_line)
               .option("mode", "PERMISSIVE")
               .option("columnNameOfCorruptRecord", CORRUPT)
               .option("recursiveFileLookup", True)
               .option("pathGlobFilter", "*.json")
               .json(path))
        if lines is None:
            stored = F.col("_metadata.file_name").startswith("part-")
            raw = raw.where(stored if by_line else ~stored)
        return raw.select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.file_path").alias("_path"),
                          F.regexp_extract(F.col("_metadata.file_path"), r"/(?:year=)?(\d{4})/[^/]*$", 1).alias("_year"))

    return read(True).unionByName(read(False)) if lines is None else read(lines)


def _stem() -> Column:
    return F.regexp_replace("_file", r"\.json$", "")


def read_meetings(spark: SparkSession, path: str, date_from: str | None = None,
                  date_to: str | None = None, lines: bool | None = None) -> DataFrame:
    """Items of all meeting records with their date and position in the day.

    Reads single documents at ``YYYY/YYYY-MM-DD.json`` and the layout of
    :func:`write_meetings` alike.  With a bound, files of year folders outside
    it are not opened; a range without files gives no rows.  Records that do
    not parse are left out here and returned by :func:`read_rejects`.
    """
    raw = json_records(spark, path, schemas.MEETING, lines)
    if date_from:
        raw = raw.where((F.col("_year") == "") | (F.col("_year") >= date_from[:4]))
    if date_to:
        raw = raw.where((F.col("_year") == "") | (F.col("_year") <= date_to[:4]))
    raw = raw.where(F.col(CORRUPT).isNull())
    df = raw.select(F.coalesce("date", _stem()).alias("date"), "first", "data")
    if date_from:
        df = df.where(F.col("date") >= date_from)
    if date_to:
        df = df.where(F.col("date") <= date_to)
    return explode_items(df, outer=True)


def explode_items(meetings: DataFrame, outer: bool = False) -> DataFrame:
    """One row per item; ``first`` is where a part of a split day begins."""
    each = (F.posexplode_outer if outer else F.posexplode)("data").alias("_pos", "item")
    return (meetings.select("date", "first", each)
            .select("date", (F.col("_pos") + F.coalesce("first", F.lit(0))).cast("int").alias("pos"), "item.*"))


def read_meeting_dates(spark: SparkSession, path: str, lines: bool | None = None) -> DataFrame:
    """One row per meeting date with its item count, empty meetings included."""
    raw = json_records(spark, path, schemas.MEETING, lines).where(F.col(CORRUPT).isNull())
    return (raw.groupBy(F.coalesce("date", _stem()).alias("date"))
            .agg(F.sum(F.coalesce(F.array_size("data"), F.lit(0))).alias("items")))


def read_rejects(spark: SparkSession, path: str, schema: T.StructType = schemas.MEETING,
                 lines: bool | None = None) -> DataFrame:
    """Records of any of these readers that do not parse, with their raw text."""
    # The reader refuses plans that touch the raw text alone, hence the second test.
    some = schema.fields[0].name
    return (json_records(spark, path, schema, lines)
            .where(F.col(CORRUPT).isNotNull() & (F.col(some).isNull() | F.col(some).isNotNull()))
            .select(F.col("_file").alias("file_name"), CORRUPT))


def write_meetings(items: DataFrame, path: str, mode: str = "overwrite",
                   chunk: int = 5000) -> None:
    """Nested meeting records, one folder per year; days without items are not stored.

    Items keep the order of ``pos`` if they have it, else of their id.  A day
    with more than ``chunk`` items becomes several records of that date, each
    with the position at which it begins, so no record and no task grows with
    the busiest day and reading restores every position.
    """
    items = items.where(F.col("id").isNotNull())
    fields = [f.name for f in schemas.ITEM.fields if f.name in items.columns]
    if "pos" in items.columns:
        order, part = ["pos"], F.floor(F.col("pos") / chunk)
    else:
        sizes = items.groupBy("date").agg(F.ceil(F.count("*") / chunk).alias("_chunks"))
        items = items.join(sizes, "date")
        order, part = [], F.pmod(F.xxhash64("id"), F.col("_chunks"))
    parts = (items.groupBy("date", part.alias("_chunk"))
             .agg(F.sort_array(F.collect_list(F.struct(*order, F.struct(*fields).alias("item")))).alias("_rows")))
    before = Window.partitionBy("date").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    (parts.withColumn("first", F.coalesce(F.sum(F.size("_rows")).over(before), F.lit(0)))
     .select(F.substring("date", 1, 4).alias("year"), "date", "first",
             F.transform("_rows", lambda r: r["item"]).alias("data"))
     .write.mode(mode).partitionBy("year").json(path))


def write_items(items: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Flat item table partitioned by year; readers prune on ``year``.

    The rebalance hint gathers small years and splits large ones, so files come
    out at an even size whatever the spread of the years.
    """
    (items.where(F.col("id").isNotNull())
     .withColumn("year", F.substring("date", 1, 4).try_cast("int"))
     .hint("rebalance", "year")
     .write.mode(mode).partitionBy("year").parquet(path))


def read_items(spark: SparkSession, path: str, year_from: int | None = None,
               year_to: int | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    if year_from is not None:
        df = df.where(F.col("year") >= year_from)
    if year_to is not None:
        df = df.where(F.col("year") <= year_to)
    return df


def read_roster(spark: SparkSession, path: str, lines: bool | None = None) -> DataFrame:
    """One row per member with the array of terms; see :func:`read_rejects` for files that do not parse."""
    return (json_records(spark, path, schemas.ROSTER, lines).where(F.col(CORRUPT).isNull())
            .select(F.inline("councilmembers")))


def read_terms(spark: SparkSession, path: str, lines: bool | None = None) -> DataFrame:
    """One row per term of office."""
    return roster_terms(read_roster(spark, path, lines))


def roster_terms(roster: DataFrame) -> DataFrame:
    return (roster.select("name", F.posexplode("terms").alias("pos", "term"))
            .select("name", "pos", F.col("term.start").alias("start_date"),
                    F.col("term.end").alias("end_date"), F.col("term.office").alias("office")))


def read_committees(spark: SparkSession, path: str, lines: bool | None = None) -> DataFrame:
    return (json_records(spark, path, schemas.COMMITTEES, lines).where(F.col(CORRUPT).isNull())
            .select(F.inline("committees")))


def replace_committees(committees: DataFrame, path: str) -> None:
    """Replace the whole dimension, in the wrapped layout the reader expects.

    The dimension is a council's list of committees; it is written as one row
    per committee so that no task has to hold it whole.
    """
    (committees.select(F.array(F.struct("name", "start", "end")).alias("committees"))
     .write.mode("overwrite").json(path))


def read_api_docs(spark: SparkSession, path: str) -> DataFrame:
    """API documents with the id taken from ``meeting_doc_00123.json``, as a file or as a folder of parts."""
    raw = json_records(spark, path, schemas.API_DOCUMENT)
    doc_id = F.regexp_extract("_path", r"meeting_doc_(\d+)", 1)
    return (raw.where(F.col(CORRUPT).isNull())
            .select(doc_id.try_cast("long").alias("doc_id"), "FormalNumber"))
