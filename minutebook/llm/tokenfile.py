"""Token ids in binary files: one zstandard frame for each text, one dictionary for all.

Short texts compress badly alone, so a dictionary is trained on serialized
ids of a bounded sample and shared by all frames.  Rows are put in the order
of their ids by a range partitioning; every task encodes its texts, packs
frames into blocks and hands the blocks to Spark's text writer, whose line
mark closes them, so commits, retries and any file system are Spark's.

A folder holds
  ``dictionary``  the dictionary and its SHA-256,
  ``blocks``      the files,
  ``index``       one row for each block: file, place, least and largest id, ids of all texts before it.
A block holds frames, then for each text its id, whether it is null, where its
frame ends and how many ids it has, then a footer of fixed size with the
dictionary's hash, then the mark.  Files are read from their last footer
backwards; one text is read by cutting out its frame alone.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from minutebook.llm import packing
from minutebook.llm import wordhash as W
from minutebook.llm.common import partitions, ship, text_bytes

ship(W.__name__)
ship(packing.__name__)
ship(__name__)

MARK = "<TOKENS>"
FOOTER = "<4sB3xIIIIQQ32s"  # format, bytes of an id, shard, block, texts, 0, bytes of frames, ids, dictionary
FOOTER_BYTES = struct.calcsize(FOOTER)
FORMAT = b"TKZ1"
SAMPLE_TEXTS, SAMPLE_PIECES, PIECE_IDS = 2_000, 4_000, 1_024
DICTIONARY_BYTES = 64 << 10
BLOCK_BYTES, BLOCKS_A_FILE = 4 << 20, 16


def _narrow(ids: bytes, width: int) -> bytes:
    return ids if width == 4 else np.frombuffer(ids, "<u4").astype("<u2").tobytes()


def _wide(ids: bytes, width: int) -> bytes:
    return ids if width == 4 else np.frombuffer(ids, "<u2").astype("<u4").tobytes()


def _pieces(tokenizer: str, end: bytes, width: int, size: int):
    def run(parts):
        encoder = packing.Encoder(tokenizer)
        for part in parts:
            out = []
            for _, some in W.batches(part.column("_body").to_pylist(), 4 << 20):
                for ids in encoder.encode(some):
                    ids += end
                    out.extend(_narrow(ids[a:a + 4 * size], width) for a in range(0, len(ids), 4 * size))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["piece"])
    return run


def trained_dictionary(rows: DataFrame, tokenizer: str, end_id: int, width: int, texts: int = SAMPLE_TEXTS,
                       pieces: int = SAMPLE_PIECES, size: int = DICTIONARY_BYTES) -> bytes:
    """A zstandard dictionary for serialized ids, of at most ``size`` bytes.

    Trained in one task on at most ``pieces`` stretches of 1,024 ids, chosen
    by hash among the stretches of ``texts`` texts, which are chosen by hash
    of their place.  Samples too small to train on serve as they are; none
    gives an empty dictionary.
    """
    chosen = rows.select("_file", "_row").orderBy(F.xxhash64("_file", "_row")).limit(texts)  # two values for each text
    sample = rows.select("_file", "_row", "_body").join(F.broadcast(chosen), ["_file", "_row"]).select("_body")
    cut = sample.mapInArrow(_pieces(tokenizer, struct.pack("<I", end_id), width, PIECE_IDS), "piece binary")
    bounded = cut.orderBy(F.xxhash64("piece"), "piece").limit(pieces)

    def train(part: pa.Table) -> pa.Table:
        import zstandard
        found = sorted(part.column("piece").to_pylist())
        try:
            made = zstandard.train_dictionary(size, found).as_bytes()
        except zstandard.ZstdError:
            made = b"".join(found)[:size]
        return pa.table({"made": pa.array([made], pa.binary())})

    made = bounded.groupBy(F.lit(0).alias("_all")).applyInArrow(train, "made binary").first()
    return bytes(made["made"]) if made else b""


def _compressor(dictionary: bytes):
    import zstandard
    if not dictionary:
        return zstandard.ZstdCompressor(level=3, write_checksum=True)
    shared = zstandard.ZstdCompressionDict(dictionary)
    shared.precompute_compress(level=3)
    return zstandard.ZstdCompressor(level=3, write_checksum=True, dict_data=shared)


def _decompressor(dictionary: bytes):
    import zstandard
    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)


class _Block:
    """Frames of texts that follow each other, and the bytes of the closed block."""

    def __init__(self, shard: int, number: int, width: int, digest: bytes):
        self.shard, self.number, self.width, self.digest = shard, number, width, digest
        self.frames, self.ids, self.counts, self.size = [], [], [], 0

    def add(self, key: int | None, frame: bytes, count: int) -> None:
        self.frames.append(frame)
        self.ids.append(key)
        self.counts.append(count)
        self.size += len(frame)

    def closed(self) -> bytes:
        n = len(self.ids)
        keys = np.array([k or 0 for k in self.ids], "<i8").tobytes()
        empty = np.array([k is None for k in self.ids], "u1").tobytes()
        ends = np.cumsum([len(f) for f in self.frames]).astype("<u8").tobytes()
        counts = np.array(self.counts, "<u8").tobytes()
        footer = struct.pack(FOOTER, FORMAT, self.width, self.shard, self.number, n, 0, self.size, sum(self.counts), self.digest)
        return b"".join(self.frames) + keys + empty + ends + counts + footer


def blocks_of(content: bytes | memoryview):
    """(offset, bytes of a block without its mark) from the last block of a file to its first."""
    stop = len(content)
    while stop:
        foot = stop - len(MARK) - FOOTER_BYTES
        if foot < 0 or bytes(content[stop - len(MARK):stop]) != MARK.encode():
            raise ValueError("the file does not end with a block of token ids")
        kind, _, _, _, texts, _, frames, _, _ = struct.unpack_from(FOOTER, content, foot)
        start = foot - frames - 25 * texts
        if kind != FORMAT or start < 0:
            raise ValueError("the file holds no block of token ids")
        yield start, content[start:stop - len(MARK)]
        stop = start


def parsed(block: bytes | memoryview):
    """(shard, block, width, dictionary hash, ids or None, ends of frames, numbers of ids)"""
    _, width, shard, number, n, _, frames, _, digest = struct.unpack_from(FOOTER, block, len(block) - FOOTER_BYTES)
    keys = np.frombuffer(block, "<i8", n, frames)
    empty = np.frombuffer(block, "u1", n, frames + 8 * n).astype(bool)
    ends = np.frombuffer(block, "<u8", n, frames + 9 * n).astype(np.int64)
    counts = np.frombuffer(block, "<u8", n, frames + 17 * n).astype(np.int64)
    return shard, number, width, digest, keys, empty, ends, counts


def _write(tokenizer: str, end: bytes, width: int, dictionary: bytes, block_bytes: int):
    digest = hashlib.sha256(dictionary).digest()

    def run(parts):
        from pyspark import TaskContext
        shard, encoder, compressor = TaskContext.get().partitionId(), packing.Encoder(tokenizer), _compressor(dictionary)
        block = _Block(shard, 0, width, digest)
        for part in parts:
            keys, at = part.column("_id").to_pylist(), 0
            for _, some in W.batches(part.column("_body").to_pylist(), 4 << 20):
                for ids in encoder.encode(some):
                    ids += end
                    block.add(keys[at], compressor.compress(_narrow(ids, width)), len(ids) // 4)
                    at += 1
                    if block.size >= block_bytes:
                        yield pa.RecordBatch.from_arrays([pa.array([block.closed()], pa.binary())], ["body"])
                        block = _Block(shard, block.number + 1, width, digest)
        if block.ids:
            yield pa.RecordBatch.from_arrays([pa.array([block.closed()], pa.binary())], ["body"])
    return run


def _footers(parts):
    names = ["file", "place", "size", "shard", "block", "texts", "tokens", "least", "most", "nulls"]
    kinds = [pa.string()] + [pa.int64()] * 9
    for part in parts:
        rows = []
        for file, content in zip(part.column("path").to_pylist(), part.column("content")):
            for place, block in blocks_of(content.as_buffer()):
                shard, number, _, _, keys, empty, _, counts = parsed(block)
                known = keys[~empty]
                bounds = (int(known.min()), int(known.max())) if len(known) else (None, None)
                rows.append((file.rpartition("/")[2], place, len(block), shard, number, len(keys), int(counts.sum()), *bounds, int(empty.sum())))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2,
                 block_bytes: int = BLOCK_BYTES, blocks_a_file: int = BLOCKS_A_FILE, sample_texts: int = SAMPLE_TEXTS) -> None:
    """Write the ids of every whole text to ``folder``, in ascending order of the texts' ids.

    Ids come from the tokenizer without special tokens, each text closed by
    ``end_id``; a null text counts as empty.  Ids of texts are whole numbers;
    null ones come first.  Texts of one id are ordered by a hash of the text,
    equal rows stand side by side, spread over tasks by their place if they
    are many.  An empty table gives a folder without blocks.  Other columns
    are not looked at.
    """
    from tokenizers import Tokenizer
    spark = docs.sparkSession
    width = 2 if max(Tokenizer.from_file(tokenizer).get_vocab_size(), end_id + 1) <= 1 << 16 else 4
    rows = packing.stored_order(docs).select(F.col(id_col).cast("long").alias("_id"), text_bytes(text_col).alias("_body"), "_file", "_row")
    dictionary = trained_dictionary(rows, tokenizer, end_id, width, sample_texts)
    spark.createDataFrame([(hashlib.sha256(dictionary).hexdigest(), dictionary)], "sha256 string, body binary").coalesce(1).write.parquet(
        f"{folder}/dictionary")
    order = [F.col("_id").asc_nulls_first(), "_tie", "_place"]
    sorted_rows = (rows.select("_id", "_body", F.xxhash64("_body").alias("_tie"), F.xxhash64("_file", "_row").alias("_place"))
                   .repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order))
    bodies = sorted_rows.select("_id", "_body").mapInArrow(
        _write(tokenizer, struct.pack("<I", end_id), width, dictionary, block_bytes), "body binary")
    (bodies.select(F.col("body").cast("string").alias("value")).write.option("lineSep", MARK)
     .option("maxRecordsPerFile", blocks_a_file).text(f"{folder}/blocks"))
    found = _files(spark, f"{folder}/blocks").mapInArrow(_footers, "file string, place long, size long, shard long, block long, texts long, "
                                                         "tokens long, least long, most long, nulls long")
    found.write.parquet(f"{folder}/footers")
    blocks = spark.read.parquet(f"{folder}/footers")
    earlier = lambda w: F.coalesce(F.sum("tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shards = blocks.groupBy("shard").agg(F.sum("tokens").alias("tokens"))  # one row for each task that wrote
    bases = shards.select("shard", earlier(Window.orderBy("shard")).alias("base"))
    inside = blocks.withColumn("inside", earlier(Window.partitionBy("shard").orderBy("block")))
    (inside.join(bases, "shard").withColumn("start", F.col("base") + F.col("inside")).drop("base", "inside")
     .write.parquet(f"{folder}/index"))


def _files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.format("binaryFile").load(path).where("length > 0").select("path", "content")


def _dictionary(spark: SparkSession, folder: str) -> bytes:
    row = spark.read.parquet(f"{folder}/dictionary").first()
    if hashlib.sha256(row["body"]).hexdigest() != row["sha256"]:
        raise ValueError(f"the dictionary in {folder} is damaged")
    return bytes(row["body"])


def _texts(dictionary: bytes, wanted: set[int] | None, id_col: str):
    digest = hashlib.sha256(dictionary).digest()

    def run(parts):
        decompressor = _decompressor(dictionary)
        for part in parts:
            for content in part.column("content"):
                buffer = content.as_buffer()
                for _, block in blocks_of(buffer):
                    shard, number, width, written_with, keys, empty, ends, counts = parsed(block)
                    if written_with != digest:
                        raise ValueError("a block was compressed with another dictionary")
                    starts, before = np.concatenate([[0], ends[:-1]]), np.cumsum(counts) - counts
                    some = range(len(keys)) if wanted is None else [i for i in range(len(keys)) if not empty[i] and int(keys[i]) in wanted]
                    out, size, view = [], 0, memoryview(block)
                    for i in some:
                        ids = _wide(decompressor.decompress(view[starts[i]:ends[i]]), width)
                        if len(ids) != 4 * counts[i]:
                            raise ValueError("a text does not have the ids that its block tells")
                        out.append((shard, number, None if empty[i] else int(keys[i]), int(before[i]), int(counts[i]), ids))
                        size += len(ids)
                        if size >= 8 << 20:
                            yield _batch(out, id_col)
                            out, size = [], 0
                    if out:
                        yield _batch(out, id_col)
    return run


def _batch(rows: list[tuple], id_col: str) -> pa.RecordBatch:
    kinds = [pa.int64()] * 5 + [pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)],
                                      ["_shard", "_block", id_col, "_before", "n_tokens", "ids"])


def read_tokens(spark: SparkSession, folder: str, only: list[int] | None = None, id_col: str = "doc_id",
                columns: dict[str, Column] | None = None) -> DataFrame:
    """One row for each text of ``folder``: id_col, start, n_tokens and ``columns``, by default ids.

    ``start`` counts the ids of all texts before it; ids are little-endian
    unsigned 32-bit numbers.  ``columns`` are made of ids where they are
    read.  ``only``, a short list of ids of texts, opens just the files whose
    blocks can hold them and decompresses just their frames.  Blocks written
    with another dictionary, damaged frames and damaged files raise an error.
    """
    index, files = spark.read.parquet(f"{folder}/index"), [f"{folder}/blocks"]
    if only is not None:
        may = [F.col("least").isNotNull() & F.lit(k).between(F.col("least"), F.col("most")) for k in only]
        hit = index.where(may[0] if len(may) == 1 else F.array_contains(F.array(*may), True)) if may else index.limit(0)
        files = [f"{folder}/blocks/{r['file']}" for r in hit.select("file").distinct().collect()]  # files of a few texts
    kind = f"_shard long, _block long, `{id_col}` long, _before long, n_tokens long, ids binary"
    if not files:
        rows = spark.createDataFrame([], kind)
    else:
        rows = _files(spark, files).select("content").mapInArrow(
            _texts(_dictionary(spark, folder), None if only is None else set(only), id_col), kind)
    columns = {"ids": F.col("ids")} if columns is None else columns
    made = rows.select("_shard", "_block", id_col, "_before", "n_tokens", *(c.alias(n) for n, c in columns.items()))
    at = index.select(F.col("shard").alias("_shard"), F.col("block").alias("_block"), F.col("start").alias("_start"))
    return made.join(at, ["_shard", "_block"]).select(id_col, (F.col("_start") + F.col("_before")).alias("start"), "n_tokens", *columns)
