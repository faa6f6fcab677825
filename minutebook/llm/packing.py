"""Packing of texts into sequences of fixed length: concatenate and cut.

One pass encodes the texts where they lie and stores the ids with their
running count inside each run of stored rows (a file split).  The totals of
the runs, a few numbers, are summed up in stored order; run base plus count
gives every text its place in one endless stream of ids.  Sequence k is the
stream from k * length on, so a text knows by itself which sequences it meets
and where it is cut: one record for each piece, no further exchange of ids.
"""

from __future__ import annotations

import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from minutebook.llm import wordhash as W
from minutebook.llm.common import materialize, ship, text_bytes

ship(W.__name__)
ship(__name__)

BROADCAST_ROWS = 200_000

# Letters for which lower case, NFC and the pre-tokenizer's classes leave no doubt; all other texts and words
# go through the tokenizer as a whole.
_ODD_LETTER = re.compile("[^\t\n\x0b\x0c\r -~¡-ÿĀ-įı-ɏ]")
_PLAIN_LETTERS = re.compile("[a-zß-öø-ÿ]+")
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


def _odd(text: str) -> bool:
    if "<|" in text:
        return True
    return not text.isprintable() and bool(_ODD_LETTER.search(text)) if text.isascii() else bool(_ODD_LETTER.search(text))


class Encoder(dict):
    """word -> packed ids; fills itself, and starts anew beyond ``most`` words."""

    def __init__(self, path: str, most: int = 400_000):
        super().__init__()
        from tokenizers import Tokenizer
        self.tokenizer, self.most, self.marks = Tokenizer.from_file(path), most, {}
        self.pieces = self.tokenizer.model.tokenize
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in printable]
        self.letters = {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(rest)}

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def __missing__(self, word: str) -> bytes:
        letters = word.rstrip(_MARKS)
        if letters != word and letters and _PLAIN_LETTERS.fullmatch(letters):
            mark = word[len(letters):]
            if mark not in self.marks:
                self.marks[mark] = self.whole(mark)
            return self[letters] + self.marks[mark]
        if word.isascii() and word.isalpha():
            ids = array("I", [x.id for x in self.pieces(word)]).tobytes()
        elif _PLAIN_LETTERS.fullmatch(word):
            ids = array("I", [x.id for x in self.pieces(word.encode().decode("latin-1").translate(self.letters))]).tobytes()
        else:
            ids = self.whole(word)
        if len(self) >= self.most:
            self.clear()
        self[word] = ids
        return ids

    def encode(self, bodies: list[bytes]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit numbers, equal to those of the tokenizer.

        The words of many texts are told apart by hash at once, so each
        different word is looked up once and its ids are copied by numpy.
        """
        texts = [b.decode() for b in bodies]
        odd = [_odd(t) for t in texts]
        t = W.Texts([b"" if o else x.lower().encode() for x, o in zip(texts, odd)])
        _, where, which = np.unique(t.words, return_index=True, return_inverse=True)
        spans = zip(t.starts[where].tolist(), t.ends[where].tolist())
        known = [self[t.data[a:b].decode()] for a, b in spans]
        ids = np.frombuffer(b"".join(known), "<u4")
        sizes = np.fromiter(map(len, known), np.int64, len(known)) // 4
        begins = np.cumsum(sizes) - sizes
        counts = sizes[which]
        ends = np.cumsum(counts)
        out = ids[np.repeat(begins[which] - ends + counts, counts) + np.arange(counts.sum())]
        cut = np.concatenate([[0], ends])[t.bounds]
        return [self.whole(x) if o else out[a:b].tobytes() for x, o, a, b in zip(texts, odd, cut[:-1], cut[1:])]


def _encode(path: str, end: int):
    close = array("I", [end]).tobytes()

    def run(parts):
        encoder, file, row, head, before = Encoder(path), None, -1, -1, 0
        for part in parts:
            out, coded = [], []
            for _, some in W.batches(part.column("_body").to_pylist(), 4 << 20):
                coded.extend(encoder.encode(some))
            for ids, f, r in zip(coded, part.column("_file").to_pylist(), part.column("_row").to_pylist()):
                if f != file or r <= row:
                    file, head, before = f, r, 0
                row = r
                ids += close
                out.append((ids, len(ids) // 4, f, head, before))
                before += len(ids) // 4
            ids, n, files, heads, counts = zip(*out) if out else [()] * 5
            yield pa.RecordBatch.from_arrays(
                [part.column("_id"), pa.array(ids, pa.binary()), pa.array(n, pa.int64()), pa.array(files, pa.string()),
                 pa.array(heads, pa.int64()), pa.array(counts, pa.int64())], ["_id", "ids", "n", "file", "head", "before"])
    return run


def stored_order(docs: DataFrame) -> DataFrame:
    """Adds _file and _row: place in the stored files, or in the partitions of a table that is not stored."""
    try:
        return docs.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    except AnalysisException:
        number = F.monotonically_increasing_id()
        return docs.select("*", F.format_string("%012d", F.shiftright(number, 33)).alias("_file"), number.alias("_row"))


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", length: int = 2048,
         end_id: int = 1) -> DataFrame:
    """One row per piece: id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Texts follow each other in stored order (file, row), each closed by
    ``end_id``, and are cut every ``length`` ids; only the last sequence is
    short.  A null text counts as empty and is packed as ``end_id`` alone.
    Null or repeated ids are carried along; an empty table gives no piece.
    Other columns are not looked at.
    """
    if not isinstance(length, int) or length < 1:
        raise ValueError("length must be a positive number of ids")
    rows = stored_order(docs).select(F.col(id_col).alias("_id"), text_bytes(text_col).alias("_body"), "_file", "_row")
    kind = rows.schema["_id"].dataType.simpleString()
    coded = materialize(rows.mapInArrow(
        _encode(tokenizer, end_id), f"_id {kind}, ids binary, n long, file string, head long, before long"), "ids")
    totals = materialize(coded.groupBy("file", "head").agg(F.sum("n").alias("total")), "totals")
    base = F.coalesce(F.sum("total").over(Window.orderBy("file", "head").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = totals.select("file", "head", base.alias("base"))
    if totals.count() <= BROADCAST_ROWS:
        bases = F.broadcast(bases)
    at = F.col("base") + F.col("before")
    placed = coded.join(bases, ["file", "head"]).select("_id", "ids", "n", at.alias("at"))

    def piece(k):
        start = F.greatest(k * length - F.col("at"), F.lit(0))
        size = F.least((k + 1) * length - F.col("at"), F.col("n")) - start
        body = F.substr(F.col("ids"), (start * 4 + 1).cast("int"), (size * 4).cast("int"))
        return F.struct(start.alias("start"), size.alias("length"), F.crc32(body).alias("ids_crc32"),
                        k.alias("sequence_id"), (F.col("at") + start - k * length).alias("offset"))

    first, last = F.expr(f"at div {length}"), F.expr(f"(at + n - 1) div {length}")
    return (placed.select("_id", F.col("n").alias("doc_tokens"), F.explode(F.transform(F.sequence(first, last), piece)).alias("p"))
            .select(F.col("_id").alias(id_col), "p.start", "p.length", "p.ids_crc32", "doc_tokens", "p.sequence_id", "p.offset"))
