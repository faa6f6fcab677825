"""Bounded samples of labelled texts for the classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from minutebook.llm.common import text_bytes


def held_out(id_col: str, folds: int, fold: int):
    """Whether a row's label may not be learned from: crc32 of the id as text, modulo ``folds``."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, folds: int, fold: int, limit: int,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(_id, _body, _label, _share): up to ``limit`` texts of either label, chosen by hash of the id.

    _share is the number of labelled rows of that label over all labelled
    rows, not only the chosen ones.  Labels other than 0 and 1, null labels
    and null ids count as none; a text with both labels counts as 1, an id
    with several texts lends its least one.
    """
    known = (labels.select(F.col(id_col).alias("_id"), F.col(label).cast("int").alias("_label"))
             .where("_id is not null and _label in (0, 1)").where(~held_out("_id", folds, fold))
             .groupBy("_id").agg(F.max("_label").alias("_label")))
    totals = {r["_label"]: r["n"] for r in known.groupBy("_label").agg(F.count("*").alias("n")).collect()}
    every = sum(totals.values())
    chosen = None
    for value, n in sorted(totals.items()):
        part = (known.where(F.col("_label") == value).orderBy(F.xxhash64("_id"), "_id").limit(limit)
                .withColumn("_share", F.lit(n / every)))
        chosen = part if chosen is None else chosen.union(part)
    if chosen is None:
        chosen = known.withColumn("_share", F.lit(0.0))
    # At most 2 * limit rows of three numbers: small by construction.
    return (docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(chosen), "_id")
            .groupBy("_id", "_label", "_share").agg(F.min("_text").alias("_text"))
            .select(F.col("_id").cast("string").alias("_id"), text_bytes("_text").alias("_body"), "_label", "_share"))


def fitted(rows: DataFrame, fit) -> bytes:
    """The model that ``fit`` makes of a bounded sample, in one task; ``fit`` takes (bodies, labels, shares)."""
    import pyarrow as pa

    def run(part: pa.Table) -> pa.Table:
        part = part.sort_by("_id")
        model = fit(*(part.column(n).to_pylist() for n in ("_body", "_label", "_share")))
        return pa.table({"model": pa.array([model], pa.binary())})

    found = rows.groupBy(F.lit(0).alias("_all")).applyInArrow(run, "model binary").first()
    return found["model"] if found else fit([], [], [])
