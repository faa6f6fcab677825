"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS choose data and cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

from minutebook.plans.catalog import QUERIES
from minutebook.plans.fixtures import SHARED, fixture
from minutebook.plans.search_queries import index
from minutebook.session import build_session

HEADLINE = (
    "a1_rollup_timeline", "a3_hierarchy", "a5_action_pivot", "a7_sponsor_counts", "a9_donation_summary",
    "a12_settlement_report", "a15_exact_duplicate_report", "a16_action_keyword_report", "a17_sponsor_pattern_report",
    "f1_search_all_relevance", "f1_search_typed", "f8_news_page", "f10_lookup_items",
    "j1_attach_doc_ids", "j4_tenure_meetings", "j6_paper_type_analysis", "j7_substring_dedupe", "j8_duplicate_pairs",
    "m1_patch_items", "m2_merge_sponsors", "m6_upsert_news", "h1_extract_links",
    "t13_extract_final_action", "t16_extract_sponsors", "t27_parse_donations", "t31_display_case",
    "w1_dedupe_exact", "w2_dedupe_normalized", "w6_failure_cutoff", "w8_page",
    "x1_build_index", "x2_match_phrase", "x3_rank_top", "x4_filtered_page", "x5_snippet", "x6_search_news",
    "s1_read_meetings", "i3_upsert_stream", "i4_rollup_stream",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = [n for n in HEADLINE if not sys.argv[1:] or any(n.startswith(a) for a in sys.argv[1:])]
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus if cpus.isdigit() else "8",
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": os.environ.get("BENCH_MEMORY", "5g")})
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{folder}/orders.parquet").count()  # start the engine
    # Inputs and the index that many queries share are timed on their own.
    start, setup = time.perf_counter(), {}
    for name in SHARED:
        fixture(spark, folder, name)
    setup["shared_inputs"] = round(time.perf_counter() - start, 3)
    start = time.perf_counter()
    if any(n[:2] in ("x2", "x3", "x4", "x5") for n in wanted):
        index(spark, folder)
    setup["index"] = round(time.perf_counter() - start, 3)
    times = {}
    for name in wanted:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {times[name]}", file=sys.stderr)
    print(json.dumps({"metric": "total_query_time", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "setup": setup, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
