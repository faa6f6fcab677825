"""A cross-section of the registered queries against their SQL on the smallest data.

tools/check.py compares all of them.
"""

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check import rows

FOLDER = "/root/testdata/sf0.001"
SAMPLE = ("a1_rollup_timeline", "a3_drill_down", "a12_settlement_report", "a16_action_keyword_report", "f1_search_all_relevance",
          "f10_lookup_items", "h5_meeting_history", "j4_tenure_meetings", "j7_substring_dedupe", "m5_patch_donations",
          "t13_extract_final_action", "t16_extract_sponsors", "t31_display_case", "w2_normalized_causes", "w5_group_lines",
          "x2_match_phrase", "i3_upsert_stream", "s6_write_report")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in ("region nation customer supplier part orders lineitem events documents "
              "embeddings pages benchmark labels conversations").split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, db, name):
    df = entry.queries()[name](spark, FOLDER)
    cur = db.execute(entry.oracle_sql()[name])
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows([d[0] for d in cur.description], cur.fetchall())


def test_entry_and_names(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
