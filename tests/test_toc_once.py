"""The layout of a contents record is matched once, whatever is read of it."""

from pyspark.sql import functions as F

from minutebook.functions import toc

TEXTS = ["1 12345 26-R-1 230 Smith A study  of parks Resolution Finance", "1 12345 no layout", "", "\u0001\u0001\u0001\u0001\u0001\u0001\u0001",
         "2 00007 26-O-4567 O\u0001Neil Two words Ordinance", "3 00008 26-R-300 Smith a resolution b ORDINANCE x\nnext"]


def test_one_match_a_record(spark):
    rows = spark.createDataFrame([(t,) for t in TEXTS], "g string").select(toc.toc_row(F.col("g")).alias("r")).select("r.*")
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("(Resolution|Ordinance)") == 1


def test_rows(values):
    got = values(toc.toc_row, *TEXTS, None)
    assert [r and tuple(r) for r in got] == [
        (1, "12345", "26-R-1230", "Smith", "A study  of parks", "Resolution", "Finance"), None, None, None,
        (2, "00007", "26-O-4567", "O", "Neil", "Two words", "Ordinance"),
        (3, "00008", "26-R-300", "Smith", "a", "resolution", "b ORDINANCE x\nnext"), None]
