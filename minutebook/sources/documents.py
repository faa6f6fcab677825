"""Document texts, detail pages, run logs and value lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from minutebook import schemas
from minutebook.sources.meetings import CORRUPT, json_records
from minutebook.functions.text import strip

# --- fixed values -----------------------------------------------------------
PLACEHOLDER = "# PDF already contains searchable text"
SKIP_MARKER = "[OCR skipped on page"
RUN_LINE = r"^(\d{4}-\d\d-\d\d \d\d:\d\d:\d\d) \| ID (\d+) \| (.*?) \| (.*)$"
APP_LINE = r"^(\d{4}-\d\d-\d\d \d\d:\d\d:\d\d,\d{3}) (\w+): (.*) \[in (.*):(\d+)\]$"
# ----------------------------------------------------------------------------


def clean_corpus(df: DataFrame, text: str = "text") -> DataFrame:
    """Blank out placeholder texts and add the character count."""
    content = F.when(strip(F.col(text)) == PLACEHOLDER, "").otherwise(F.col(text))
    return df.withColumn(text, content).withColumn("char_count", F.length(text))


def read_text_corpus(spark: SparkSession, path: str) -> DataFrame:
    """One row per text file: file stem, name of its folder, text, character count."""
    raw = (spark.read.option("pathGlobFilter", "*.txt").option("recursiveFileLookup", True)
           .text(path, wholetext=True))
    stem = F.regexp_replace(F.col("_metadata.file_name"), r"\.txt$", "")
    folder = F.regexp_extract(F.col("_metadata.file_path"), "/([^/]*)/[^/]*$", 1)
    return clean_corpus(raw.select(stem.alias("stem"), folder.alias("folder"), F.col("value").alias("text")))


def skipped_ocr_docs(corpus: DataFrame, manifest: DataFrame, key: str = "stem") -> DataFrame:
    """Texts that open with the skip marker and whose file exists."""
    marked = corpus.where(strip(F.col("text")).startswith(SKIP_MARKER))
    return marked.join(manifest.select(key), key, "left_semi")


def read_details(spark: SparkSession, path: str) -> DataFrame:
    """Detail pages in either layout, ``content`` or ``results[0].content``; one per file or one per stored line."""
    return detail_content(json_records(spark, path, schemas.DETAIL_FILE).where(F.col(CORRUPT).isNull()))


def detail_content(raw: DataFrame) -> DataFrame:
    """(id, content) of detail records; the id may have to come from the file name."""
    stem = F.regexp_replace("_file", r"\.json$", "")
    first = F.get("results", F.lit(0))
    return raw.select(
        F.coalesce(F.col("id"), first["id"], stem.try_cast("long")).alias("id"),
        F.coalesce(F.col("content"), first["content"]).alias("content"))


def store_details(results: DataFrame, path: str, buckets: int = 64, mode: str = "overwrite") -> None:
    """Store the results worth keeping by id: one folder per id modulo ``buckets``."""
    (split_details(results).withColumn("bucket", F.pmod("id", F.lit(buckets)).cast("int"))
     .write.mode(mode).partitionBy("bucket").parquet(path))


def stored_detail(spark: SparkSession, path: str, detail_id: int, buckets: int = 64) -> DataFrame:
    """The stored result of one id; reads one folder."""
    kept = spark.read.parquet(path)
    return kept.where((F.col("bucket") == detail_id % buckets) & (F.col("id") == detail_id)).drop("bucket")


def classify_results(results: DataFrame) -> DataFrame:
    """Add ``outcome``: successful, failed or skipped (no id)."""
    no_id = F.col("id").isNull() | (F.col("id") == 0)
    return results.withColumn("outcome", F.when(no_id, "skipped")
                              .when(F.coalesce("success", F.lit(False)), "successful")
                              .otherwise("failed"))


def split_details(results: DataFrame) -> DataFrame:
    """The results worth keeping, ready to be stored by id."""
    return classify_results(results).where(F.col("outcome") == "successful").drop("outcome")


def detail_outcomes(results: DataFrame) -> DataFrame:
    return classify_results(results).groupBy("outcome").agg(F.count("*").alias("n"))


def parse_run_log(lines: DataFrame, value: str = "value") -> DataFrame:
    """``ts | ID n | status | message`` lines; other lines are left out."""
    v = F.col(value)
    part = [F.regexp_extract(v, RUN_LINE, i) for i in range(1, 5)]
    return lines.where(v.rlike(RUN_LINE)).select(
        F.try_to_timestamp(part[0]).alias("ts"), part[1].try_cast("long").alias("id"),
        part[2].alias("status"), part[3].alias("message"))


def parse_app_log(lines: DataFrame, value: str = "value") -> DataFrame:
    v = F.col(value)
    part = [F.regexp_extract(v, APP_LINE, i) for i in range(1, 6)]
    return lines.where(v.rlike(APP_LINE)).select(
        F.try_to_timestamp(F.replace(part[0], F.lit(","), F.lit("."))).alias("ts"),
        part[1].alias("level"), part[2].alias("message"), part[3].alias("file"),
        part[4].try_cast("int").alias("line"))


def read_run_log(spark: SparkSession, path: str) -> DataFrame:
    return parse_run_log(spark.read.text(path))


def latest(log: DataFrame, n: int = 500, ts: str = "ts", tie: str = "id") -> DataFrame:
    return log.orderBy(F.col(ts).desc(), F.col(tie).desc()).limit(n)
