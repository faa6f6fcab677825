"""A document that is empty from the start keeps its digest; only placeholders are blanked."""

import hashlib

from minutebook.plans.catalog import QUERIES


def test_empty_document_is_no_placeholder(spark, tmp_path):
    rows = [(1, ""), (2, None), (3, "aé"), (4, " \n"), (10, "x"), (20, ""), (30, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.body, r.char_count) for r in QUERIES["s4_read_text_corpus"](spark, str(tmp_path)).collect()}

    def md5(text):
        return hashlib.md5(text.encode()).hexdigest()

    assert got == {1: (md5(""), 0), 2: (None, None), 3: (md5("aé"), 2), 4: (md5(" \n"), 2), 10: ("", 0), 20: ("", 0), 30: ("", 0)}
