"""Readable case for all-capital descriptions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: words with a case of their own ---------------------------
UPPER_WORDS = (
    "marta", "apd", "aps", "atl", "dba", "llc", "llp", "inc", "corp", "ltd",
    "usa", "us", "ga", "tv", "am", "pm", "id", "rfp", "rfq", "rfi", "aka",
    "nw", "ne", "sw", "se", "ii", "iii", "iv", "vi", "vii",
    "fema", "hud", "doj", "epa", "cdc", "ada", "fy", "fy24", "fy25", "fy26",
    "cip", "csr", "dpr", "dot", "dar", "der", "faa", "fta", "gdot", "gema",
    "apab",
)
HONORIFICS = ("mr", "mrs", "ms", "miss", "dr", "hon", "rev", "prof", "atty")
SUFFIX_WORDS = ("jr", "sr", "esq", "st")
NAME_REACH = 5
UPPER_SHARE = 0.6
# ----------------------------------------------------------------------------


def _first_upper(w: Column) -> Column:
    return F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30))


def display_case(c: Column) -> Column:
    """Sentence case for texts that are mostly capitals, others unchanged.

    Every word is judged from its own neighbourhood: it is part of a name if an
    honorific stands at most five words before it with no sentence end between,
    and it opens a sentence if the word before it closed one.  So no state has
    to be carried along the text.
    """
    letters = F.length(F.regexp_replace(c, "[^a-zA-Z]", ""))
    capitals = F.length(F.regexp_replace(c, "[^A-Z]", ""))
    words = F.transform(
        F.split(F.lower(c), r"(?U)\s+", -1),
        lambda w: F.struct(
            w.alias("w"),
            F.lower(F.regexp_replace(w, r"(?i)^[^a-z]+|[^a-z]+$", "")).alias("base")))

    def mark(w: Column) -> Column:
        word, base = w["w"], w["base"]
        honorific = base.isin(*HONORIFICS)
        short = honorific | base.isin(*SUFFIX_WORDS) | (F.length(base) == 1)
        return F.struct(
            word.alias("w"),
            honorific.alias("hon"),
            (word.rlike(r"[.?!]$") & ~short).alias("end"),
            F.when(base.isin(*UPPER_WORDS), 2)
            .when(honorific | base.isin(*SUFFIX_WORDS), 1)
            .when(F.length(base) == 1, 2)
            .otherwise(0).alias("kind"))

    marked = F.transform(words, mark)

    def cased(seq: Column) -> Column:
        def before(i: Column, field: str, step: int) -> Column:
            return F.coalesce(F.get(seq, i - step)[field], F.lit(False))

        def one(w: Column, i: Column) -> Column:
            named, open_run = F.lit(False), F.lit(True)
            for step in range(1, NAME_REACH + 1):
                open_run = open_run & ~before(i, "end", step)
                named = named | (before(i, "hon", step) & open_run)
            opens = (i == 0) | before(i, "end", 1)
            return (F.when(w["kind"] == 2, F.upper(w["w"]))
                    .when((w["kind"] == 1) | opens | named, _first_upper(w["w"]))
                    .otherwise(w["w"]))
        return F.array_join(F.transform(seq, one), " ")

    # Binding the marked words to a lambda variable evaluates them once per row.
    shown = F.element_at(F.transform(F.array(marked), cased), 1)
    return F.when((letters > 0) & (capitals / F.greatest(letters, F.lit(1)) >= UPPER_SHARE), shown) \
            .otherwise(c)
