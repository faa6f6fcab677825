"""Mixing of sources to target weights by Pfair scheduling.

The rows of a source follow each other in a fixed random order and are cut
into blocks of equal size.  A source of share w / W releases its block j at
slot floor(j * W / w), and block j is due before slot ceil((j + 1) * W / w).
Every slot takes the released block that is due first.  As the shares fill
all slots, every block then lies inside its window, so after any number of
slots each source is less than one block away from its target.

Shares are whole numbers, so releases and deadlines repeat every W slots: the
order of one period, at most ``MOST_SLOTS`` slots, is found by a fold over
its slots, and block j of a source is its block j mod w of period j div w.
Places of rows come from sums per chunk of a source and windows inside
chunks, so a source that holds most rows is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from minutebook.llm.common import materialize

MOST_SLOTS = 10_000
CHUNK_ROWS = 2_000
BLOCK = 1 << 16


def period(spark: SparkSession, shares: DataFrame) -> DataFrame:
    """(source, nth, slot, release, deadline) of the blocks of one period; shares: (source, share)."""
    each = F.sort_array(F.collect_list(F.struct("source", F.col("share").cast("long").alias("share"))))
    one = shares.agg(each.alias("each"), F.sum("share").cast("long").alias("slots"))
    due = "CAST(ceil((acc.done[i] + 1) * slots / each[i].share) AS BIGINT)"
    free = f"""transform(filter(sequence(0, size(each) - 1), i -> acc.done[i] * slots div each[i].share <= t),
                         i -> struct({due} AS due, i AS i))"""
    fold = f"""
      aggregate(sequence(0L, slots - 1),
        struct(transform(each, x -> 0L) AS done, CAST(array() AS ARRAY<INT>) AS order),
        (acc, t) -> transform(array(array_min({free})), m -> struct(
            transform(acc.done, (d, i) -> IF(i = m.i, d + 1, d)) AS done, array_append(acc.order, m.i) AS order))[0]).order"""
    turns = one.select("each", "slots", F.posexplode(F.expr(fold)).alias("slot", "i"))
    turn = turns.select(F.col("each")[F.col("i")].alias("e"), "slots", F.col("slot").cast("long").alias("slot"))
    nth = F.row_number().over(Window.partitionBy("e").orderBy("slot")) - 1
    return (turn.withColumn("nth", nth.cast("long"))
            .select("e.source", "nth", "slot", F.col("e.share").alias("share"), "slots",
                    F.expr("nth * slots div e.share").alias("release"),
                    F.expr("CAST(ceil((nth + 1) * slots / e.share) AS BIGINT)").alias("deadline")))


def root_shares(sizes: DataFrame, slots: int = 1000) -> DataFrame:
    """Shares after the square root of each source's size: (source, share); small sources count for more."""
    whole = F.sum(F.sqrt("size")).over(Window.partitionBy())
    return sizes.select("source", F.greatest(F.lit(1), F.round(F.sqrt("size") / whole * slots)).cast("long").alias("share"))


def mix(docs: DataFrame, shares: dict[str | None, int] | None = None, source_col: str = "source",
        id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, chunk_rows: int = CHUNK_ROWS,
        size: Column | None = None, into: str = "mix") -> DataFrame:
    """All rows and columns of ``docs`` and a struct ``into``: block, release, deadline, slot, start, share.

    Ordered by (mix.slot, mix.start) the rows are the mixture.  ``shares``
    gives each source a positive whole number; sources not named get 1, and
    without it shares follow the square root of the sources' sizes.  The size
    of a row is its number of characters (null: 0) unless given; a row belongs
    to the block in which it starts, so a row longer than a block leaves the
    following ones empty.  A source that runs out leaves its slots unused, and
    the others keep their proportions.  A null source is a source of its own;
    equal rows stay, in any order among themselves.  An empty table gives an
    empty result.  ``into`` must not be a column of the input.
    """
    if into.lower() in [c.lower() for c in docs.columns]:
        raise ValueError(f"the table already has a column {into}")
    if block < 1 or any(int(s) != s or s < 1 for s in (shares or {}).values()):
        raise ValueError("block and shares must be positive whole numbers")
    spark = docs.sparkSession
    length = F.coalesce(size if size is not None else F.length(text_col), F.lit(0)).cast("long")
    # A hash that other engines have as well; the order it gives is the random order of a source.
    key = F.conv(F.substring(F.md5(F.concat_ws("|", F.col(id_col).cast("string"), text_col)), 1, 15), 16, 10).cast("long")
    inner = {c: f"c{i}" for i, c in enumerate(docs.columns)}  # no input name can clash with those used here
    rows = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in inner.items()), F.col(source_col).alias("_source"),
                       length.alias("_size"), key.alias("_key"))
    light = rows.select("_source", "_size", "_key")
    counts = materialize(light.groupBy("_source").agg(F.count("*").alias("rows"), F.sum("_size").alias("size")), "sources")
    given = counts.select(F.col("_source").alias("source"), "size")
    if shares is None:
        goal = root_shares(given)
    else:
        named = spark.createDataFrame(list(shares.items()), "named string, share long")
        goal = (given.join(named, F.col("source").cast("string").eqNullSafe(F.col("named")), "left")
                .select("source", F.coalesce("share", F.lit(1)).alias("share")))
    goal = materialize(goal, "shares")
    slots = goal.agg(F.sum("share")).first()[0] or 0
    if slots > MOST_SLOTS:
        raise ValueError(f"shares add up to {slots}; at most {MOST_SLOTS} slots make a period")
    turns = F.broadcast(materialize(period(spark, goal), "period"))  # at most MOST_SLOTS rows
    # Sources are at most as many as slots, so their counts are small as well.
    spread = F.broadcast(counts.select(F.col("_source").alias("_s"), F.ceil(F.col("rows") / chunk_rows).alias("_chunks")))

    def chunked(df: DataFrame) -> DataFrame:
        return (df.join(spread, F.col("_source").eqNullSafe(F.col("_s")))
                .withColumn("_chunk", F.pmod("_key", F.col("_chunks"))).drop("_s", "_chunks"))

    sums = chunked(light).groupBy("_source", "_chunk").agg(F.sum("_size").alias("size"))
    before = Window.partitionBy("_source").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = materialize(sums.select(F.col("_source").alias("_s"), F.col("_chunk").alias("_c"),
                                     F.coalesce(F.sum("size").over(before), F.lit(0)).alias("_base")), "chunks")
    inside = Window.partitionBy("_source", "_chunk").orderBy("_key").rowsBetween(Window.unboundedPreceding, -1)
    placed = (chunked(rows).withColumn("_at", F.coalesce(F.sum("_size").over(inside), F.lit(0)))
              .join(starts, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_chunk") == F.col("_c")))
              .withColumn("_start", F.col("_base") + F.col("_at")).withColumn("_block", F.expr(f"_start div {block}")))
    match = F.col("_source").eqNullSafe(F.col("source")) & (F.expr("_block % share") == F.col("nth"))
    turn = F.expr("_block div share * slots")
    return placed.join(turns, match).select(*(F.col(n).alias(c) for c, n in inner.items()), F.struct(
        F.col("_block").alias("block"), (turn + F.col("release")).alias("release"), (turn + F.col("deadline")).alias("deadline"),
        (turn + F.col("slot")).alias("slot"), F.col("_start").alias("start"), "share").alias(into))


def in_order(docs: DataFrame, **options) -> DataFrame:
    """``docs`` in the order of the mixture, columns unchanged: stored files follow each other in that order."""
    into = "mix"
    while into in [c.lower() for c in docs.columns]:
        into += "_"
    mixed = mix(docs, into=into, **options)
    return mixed.orderBy(f"{into}.slot", f"{into}.start").drop(into)
