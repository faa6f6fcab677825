"""Records of one long document over chunks of lines."""

from pyspark.sql import functions as F

from minutebook.operators import ranking


def test_records_run_over_chunks(spark):
    def text(p):
        return f"{p} 00{p % 1000:03d} open" if p % 7 == 3 else ("" if p % 11 == 0 else f"line {p}")

    rows = [(d, p, text(p)) for d in ("a", "b", None) for p in range(200)]
    lines = spark.createDataFrame(rows, "doc string, pos int, line string").repartition(3)
    want = []
    for d in ("a", "b", None):
        record, held = 0, {}
        for p in range(200):
            t = text(p)
            record += p % 7 == 3
            if record and t:
                held.setdefault(record, []).append(t)
        want += [(d, r, " ".join(v)) for r, v in held.items()]
    for chunk in (5, 64, 10_000):
        got = ranking.group_lines(lines, "doc", "pos", "line", chunk=chunk).collect()
        assert sorted((tuple(r) for r in got), key=str) == sorted(want, key=str)


def test_one_long_document_is_spread(spark):
    """200,000 lines of one document: no task numbers more than a chunk of them."""
    lines = spark.range(200_000).select(F.lit(1).alias("doc"), F.col("id").alias("pos"), F.when(
        F.col("id") % 1000 == 10, F.lit("1 12345 open")).otherwise(F.lit("x")).alias("line"))
    got = ranking.group_lines(lines, "doc", "pos", "line", chunk=5_000)
    assert got.agg(F.count("*"), F.max("record")).first() == (200, 200)
    assert got.where("record = 3").first().text.count("x") == 999
