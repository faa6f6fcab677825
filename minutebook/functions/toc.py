"""Table-of-contents records of a meeting package."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from minutebook.functions.text import rx, squeeze, strip

# --- fixed values: layout of one record -------------------------------------
RECORD_START = r"[^\S\n]*\d+[^\S\n]+\d{5}[^\S\n]+\S"
RECORD = (r"^(\d+)\s+(\d{5})\s+(\d{2}-[OR]-[\d ]{3,7})\s+(\S+)\s+(.+?)\s+"
          r"(Resolution|Ordinance)\s*(.*)")
# ----------------------------------------------------------------------------
SEPARATOR = "\u0001"
LINE_BREAKS = "\r\f\v\x1c\x1d\x1e\x85\u2028\u2029"


def toc_records(text: Column) -> Column:
    """Array of records in one text: a start line and the lines that follow it."""
    lines = F.translate(text, LINE_BREAKS, "\n" * len(LINE_BREAKS))
    chunks = F.split(lines, rx(rf"\n(?={RECORD_START})"), -1)
    return F.transform(F.filter(chunks, lambda g: g.rlike(rx("^" + RECORD_START))), squeeze)


def toc_row(record: Column) -> Column:
    """Struct of the seven parts of a record, NULL where it has another layout.

    The layout is matched once a record: what it leaves begins with a
    separator, so a record that is left as it was has another layout.
    """
    parted = F.regexp_replace(record, rx(RECORD, True), "".join(f"{SEPARATOR}${i}" for i in range(1, 8)))
    split = F.transform(F.array(parted), lambda s: F.when(s != record, F.split(s, SEPARATOR, -1)))

    def row(parts: Column) -> Column:
        def part(i: int) -> Column:
            return F.get(parts, F.lit(i + 1))

        return F.struct(
            part(0).try_cast("int").alias("row"),
            part(1).alias("elms_id"),
            F.regexp_replace(part(2), r"\s+", "").alias("leg_id"),
            part(3).alias("sponsor"),
            strip(part(4)).alias("description"),
            part(5).alias("leg_type"),
            strip(part(6)).alias("committee"),
        )

    return F.get(F.transform(split, lambda parts: F.when(parts.isNotNull(), row(parts))), F.lit(0))
