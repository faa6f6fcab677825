"""Preference formatting of conversations, as DataFrame expressions.

A chosen and a rejected conversation share their first turns.  The longest
common prefix is rendered once as the prompt; what follows on either side is
a completion with the spans of text that are trained on: what the assistant
says, with the mark that ends it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values: the public chat mark-up ---
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
# ---------------------------------------------


def _turns(side: DataFrame, pair_col: str, turn_col: str, role_col: str, text_col: str, name: str) -> DataFrame:
    role = F.coalesce(role_col, F.lit("user")).alias("role")
    # Marks inside a text must not read as mark-up.
    text = F.replace(F.coalesce(text_col, F.lit("")), F.lit("<|"), F.lit("< |")).alias("text")
    return (side.where(F.col(pair_col).isNotNull()).select(F.col(pair_col).alias("pair"), F.struct(F.col(turn_col).alias("turn"), role, text).alias("t"))
            .groupBy("pair").agg(F.sort_array(F.collect_list("t")).alias(name)))


def _head(t: Column) -> Column:
    return F.concat(F.lit(OPEN), t["role"], F.lit("\n"))


def _rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_head(t), t["text"], F.lit(CLOSE + "\n"))), "")


def _spans(turns: Column, trained: str) -> Column:
    """Start and end, in characters of the rendered turns, of all that the trained role says."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(acc, t):
        begin = acc["at"] + F.length(_head(t))
        end = begin + F.length(t["text"]) + len(CLOSE)
        span = F.array(F.struct(begin.alias("start"), end.alias("end")))
        return F.struct((end + 1).alias("at"), F.when(t["role"] == trained, F.concat(acc["spans"], span))
                        .otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(turns, start, step, lambda acc: acc["spans"])


def preference_pairs(chosen: DataFrame, rejected: DataFrame, pair_col: str = "conv_id", turn_col: str = "turn",
                     role_col: str = "role", text_col: str = "text", trained: str = "assistant") -> DataFrame:
    """One row per pair: pair_col, prefix_turns, prompt, chosen, chosen_spans, rejected, rejected_spans.

    Both tables hold one turn per row.  Turns are ordered by number, then role
    and text, so equal rows stay and ties are settled.  A pair that has only
    one side gets an empty prompt and an empty other completion; two equal
    sides give a prompt and two empty completions.  Null roles count as user
    and null texts as empty; rows without pair id belong to no pair.  A
    conversation becomes one row, so it must fit into one; pairs are spread
    by id, and other columns are not looked at.
    """
    a = _turns(chosen, pair_col, turn_col, role_col, text_col, "a")
    b = _turns(rejected, pair_col, turn_col, role_col, text_col, "b")
    none = F.array().cast(a.schema["a"].dataType)
    both = a.join(b, "pair", "full").select("pair", F.coalesce("a", none).alias("a"), F.coalesce("b", none).alias("b"))
    apart = F.array_position(F.transform(F.arrays_zip("a", "b"), lambda z: (z["a"]["role"] == z["b"]["role"]) & (z["a"]["text"] == z["b"]["text"])
                                         & z["a"].isNotNull() & z["b"].isNotNull()), False)
    cut = both.withColumn("n", F.when(apart > 0, apart - 1).otherwise(F.least(F.size("a"), F.size("b"))).cast("int"))
    rest = {s: F.slice(F.col(s), F.col("n") + 1, F.greatest(F.size(s) - F.col("n"), F.lit(0))) for s in "ab"}
    return cut.select(
        F.col("pair").alias(pair_col), F.col("n").alias("prefix_turns"), _rendered(F.slice(F.col("a"), 1, F.col("n"))).alias("prompt"),
        _rendered(rest["a"]).alias("chosen"), _spans(rest["a"], trained).alias("chosen_spans"),
        _rendered(rest["b"]).alias("rejected"), _spans(rest["b"], trained).alias("rejected_spans"))


def with_other_answer(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                      text_col: str = "text", trained: str = "assistant") -> DataFrame:
    """Each conversation up to its last answer, which is that of its neighbor: ids 2i and 2i + 1 swap answers.

    A conversation without an answer keeps its turns; one whose neighbor has
    none ends before its answer.
    """
    own = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    last = (own.where((F.col("role") == trained) & F.col("conv").isNotNull()).groupBy("conv")
            .agg(F.max("turn").alias("at"), F.max(F.struct("turn", F.coalesce("text", F.lit("")).alias("text")))["text"].alias("answer")))
    before = own.join(last.select("conv", "at"), "conv", "left").where("at is null or turn < at").select("conv", "turn", "role", "text")
    neighbor = last.select(F.col("conv").bitwiseXOR(F.lit(1)).alias("conv"), F.col("answer").alias("text"))
    swapped = last.select("conv", F.col("at").alias("turn"), F.lit(trained).alias("role")).join(neighbor, "conv")
    return before.unionByName(swapped).select(F.col("conv").alias(conv_col), F.col("turn").alias(turn_col),
                                              F.col("role").alias(role_col), F.col("text").alias(text_col))
