"""A cleaned, mixed and packed corpus: five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
each result to the shared folder and reads it again as the docs of the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from minutebook.llm import minhash, mixing, packing, substring, toxicity
from minutebook.llm.common import load, materialize
from minutebook.llm.queries import tokenizer_path


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the toxicity classifier rejects; all others stay as they are."""
    return toxicity.keep_clean(docs, load(spark, sf_dir, "labels"))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of least id of each class of near-duplicates."""
    return minhash.keep_one(docs)


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes the words of passages that stand earlier; every document stays, if need be with an empty text.

    The text of a document that loses words is the kept words joined by one
    space; a null text stays null.
    """
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    inner = {c: f"other{i}" for i, c in enumerate(others)}  # no name can clash with the operator's
    renamed = docs.select("doc_id", "text", *(F.col(f"`{c}`").alias(n) for c, n in inner.items()))
    parsed = substring.remove_repeats(renamed, with_text=True, keep=tuple(inner.values()))
    columns = {c: F.col(n) for c, n in inner.items()} | {"doc_id": F.col("doc_id"), "text": F.col("kept_text")}
    if "n_chars" in columns:
        columns["n_chars"] = F.when(F.col("n_removed") > 0, F.length("kept_text").cast("long")).otherwise(columns["n_chars"])
    return parsed.select(*(columns[c].alias(c) for c in docs.columns))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mixture; the stored files hold that order."""
    return mixing.in_order(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 ids, documents following each other in stored order."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("toxicity", without_toxic),
    ("near_duplicates", without_near_copies),
    ("repeated_passages", without_repeated_passages),
    ("mixing", mixed),
    ("packing", packed),
]

# No stage but the mixture can be expressed in SQL; tests compare each with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
