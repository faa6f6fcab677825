"""Token files: exact round trip, order, access to single texts, damaged files."""

import glob

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from minutebook.llm import tokenfile


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(4)
    words = ["council", "budget", "Ünïté", "x1", "2024", "—", "vote", "a\u0000b", "<|endoftext|>"]
    text = lambda n: " ".join(rng.choice(words, n))
    out = [(int(i), text(int(rng.integers(0, 60)))) for i in rng.permutation(300)]
    out += [(None, "no id"), (None, None), (5, None), (5, ""), (7, text(20)), (7, text(20)), (-3, "first"), (400, text(30_000))]
    return out + [(9, "copy")] * 120


def write(spark, rows, tokenizer, folder, **options):
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    table = table.withColumn("_id", F.lit(1)).withColumn("ids", F.lit("x")).withColumn("body", F.lit(2)).withColumn("start", F.lit(3))
    tokenfile.write_tokens(table, folder, tokenizer, **options)


def ids_of(tokenizer, rows):
    tok = Tokenizer.from_file(tokenizer)
    return [(i, np.array(tok.encode(t or "", add_special_tokens=False).ids + [2], "<u4").tobytes()) for i, t in rows]


@pytest.mark.parametrize("options", [dict(), dict(block_bytes=700, blocks_a_file=3), dict(sample_texts=1)])
def test_files_give_back_every_id_in_order(spark, rows, tokenizer, tmp_path, options):
    folder = str(tmp_path / "out")
    write(spark, rows, tokenizer, folder, **options)
    got = sorted(tokenfile.read_tokens(spark, folder).collect(), key=lambda r: r.start)
    want = ids_of(tokenizer, rows)
    assert [r.doc_id for r in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i or 0))
    key = lambda x: (x[0] is not None, x[0] or 0, x[1])
    assert sorted(((r.doc_id, bytes(r.ids)) for r in got), key=key) == sorted(want, key=key)
    at = 0
    for r in got:
        assert r.start == at and r.n_tokens == len(r.ids) // 4
        at += r.n_tokens
    if "block_bytes" in options:
        index = spark.read.parquet(f"{folder}/index")
        assert index.count() > 20 and index.groupBy("file").count().agg(F.max("count")).first()[0] == 3


def test_single_texts_open_only_their_files(spark, rows, tokenizer, tmp_path):
    folder = str(tmp_path / "out")
    write(spark, rows, tokenizer, folder, block_bytes=700, blocks_a_file=2)
    whole = {(r.doc_id, r.start): bytes(r.ids) for r in tokenfile.read_tokens(spark, folder).collect()}
    some = tokenfile.read_tokens(spark, folder, only=[7, 120, 9999])
    assert {(r.doc_id, r.start): bytes(r.ids) for r in some.collect()} == {k: v for k, v in whole.items() if k[0] in (7, 120)}
    opened = {f for f in some.inputFiles() if "/blocks/" in f}
    assert 0 < len(opened) <= 4 < len(glob.glob(f"{folder}/blocks/part-*"))
    assert tokenfile.read_tokens(spark, folder, only=[9999]).count() == 0 == tokenfile.read_tokens(spark, folder, only=[]).count()


def test_empty_table_and_texts(spark, tokenizer, tmp_path):
    write(spark, [], tokenizer, str(tmp_path / "none"))
    assert tokenfile.read_tokens(spark, str(tmp_path / "none")).count() == 0
    write(spark, [(1, None), (2, "")], tokenizer, str(tmp_path / "blank"))
    got = tokenfile.read_tokens(spark, str(tmp_path / "blank")).orderBy("start").collect()
    assert [(r.doc_id, r.start, r.n_tokens, bytes(r.ids)) for r in got] == [(1, 0, 1, b"\x02\0\0\0"), (2, 1, 1, b"\x02\0\0\0")]


def test_another_dictionary_and_damage_are_refused(spark, rows, tokenizer, tmp_path):
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    write(spark, rows, tokenizer, a)
    write(spark, rows[:50], tokenizer, b)
    with pytest.raises(Exception, match="another dictionary"):
        list(tokenfile._texts(b"other", None, "doc_id")(iter([pa.table({"content": [bytes(
            spark.read.format("binaryFile").load(f"{a}/blocks").where("length > 0").first()["content"])]}).to_batches()[0]])))
    with pytest.raises(ValueError, match="does not end with a block"):
        list(tokenfile.blocks_of(b"x" * 200))
    body = bytearray(spark.read.format("binaryFile").load(f"{b}/blocks").where("length > 0").first()["content"])
    body[20] ^= 255
    with pytest.raises(Exception):
        list(tokenfile._texts(tokenfile._dictionary(spark, b), None, "doc_id")(iter([pa.table({"content": [bytes(body)]}).to_batches()[0]])))
