"""Text folding, trimming, casing and pairwise comparison.

Patterns carry explicit flags because the JVM defaults differ from the ones
the records were prepared with: ``U`` makes ``\\s``, ``\\w`` and ``\\b`` cover
all of Unicode and ``d`` lets only a line feed end a line.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- fixed values: characters folded before comparing -----------------------
SEARCH_FOLD = ("‘’“”", "''\"\"")
QUOTE_FOLD = ("‘’“”–—", "''\"\"--")
FULL_FOLD = (
    "‘’‚‛“”„‟–—‐‑‒―",
    "''''\"\"\"\"------",
)
INDEX_FOLD = ("“”‘'", "\"\"’’")
# ----------------------------------------------------------------------------


def rx(pattern: str, ignore_case: bool = False, dot_all: bool = False) -> str:
    flags = "Ud" + ("i" if ignore_case else "") + ("s" if dot_all else "")
    return f"(?{flags}){pattern}"


def extract(c: Column, pattern: str, group: int = 1) -> Column:
    """Group of the first match, NULL where nothing (or nothing but '') matched."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def any_of(patterns) -> str:
    return "|".join(f"(?:{p})" for p in patterns)


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def squeeze(c: Column) -> Column:
    """Collapse whitespace runs to one space and trim."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


HOME = "Atlanta"  # the city whose name stands in the fixed wordings


def for_city(wording, city: str = HOME, pattern: bool = True):
    """A wording, or each of several, with the name of another city; as a pattern the name is taken literally."""
    if not isinstance(wording, str):
        return tuple(for_city(w, city, pattern) for w in wording)
    name = (lambda n: re.escape(n)) if pattern else (lambda n: n)
    return wording if city == HOME else wording.replace(HOME.upper(), name(city.upper())).replace(HOME, name(city))


def fold_quotes_lower(c: Column) -> Column:
    return F.translate(F.lower(c), *SEARCH_FOLD)


def simple_needle(q: Column) -> Column:
    """Search needle: folded, trimmed, without one pair of enclosing quotes."""
    folded = strip(fold_quotes_lower(q))
    quoted = folded.startswith('"') & folded.endswith('"') & (F.length(folded) > 2)
    return F.when(quoted, strip(F.substring(folded, F.lit(2), F.length(folded) - 2))) \
            .otherwise(folded)


def fts_query_text(q: Column) -> Column:
    return F.translate(q, *INDEX_FOLD)


def normalize_quotes(c: Column) -> Column:
    return F.translate(c, *QUOTE_FOLD)


def normalize_whitespace(c: Column) -> Column:
    return squeeze(c)


def normalize_text(c: Column) -> Column:
    return squeeze(F.translate(c, *FULL_FOLD))


def normalize_all_strings(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    return df.select([
        normalize_text(F.col(f.name)).alias(f.name)
        if isinstance(f.dataType, T.StringType) and f.name not in keep else F.col(f.name)
        for f in df.schema.fields
    ])


def trim_fields(df: DataFrame, columns: list[str], flag: str = "trimmed_fields") -> DataFrame:
    """Trim the columns; ``flag`` holds how many of them changed in the row."""
    changed = reduce(
        lambda a, b: a + b,
        [F.when(F.col(c).eqNullSafe(strip(F.col(c))), 0).otherwise(1) for c in columns])
    return df.withColumn(flag, changed).withColumns({c: strip(F.col(c)) for c in columns})


def title_case(c: Column) -> Column:
    """Capital after every non-letter ("O'Neil-Smith"), small letters elsewhere.

    ``initcap`` restarts only after a blank, so a blank tagged with a control
    character is slipped in behind the other separators and taken out again.
    """
    spread = F.regexp_replace(F.lower(c), r"([^\p{L} ])(?=\p{L})", "$1\u0001 ")
    return F.replace(F.initcap(spread), F.lit("\u0001 "), F.lit(""))


def capitalize(c: Column) -> Column:
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 1 << 30)))


def truncate(c: Column, n: int) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def occurrences(haystack: Column, needle: str) -> Column:
    """Non-overlapping occurrences of a literal."""
    if not needle:
        return F.lit(0)
    gone = F.length(haystack) - F.length(F.replace(haystack, F.lit(needle), F.lit("")))
    return F.floor(gone / len(needle)).cast("int")


def pair_difference(a: Column, b: Column) -> Column:
    """First kind of difference that explains why two values are not equal."""
    return (
        F.when(a.eqNullSafe(b), "identical")
        .when(a.isNull() | b.isNull(), "type_difference")
        .when(normalize_quotes(a) == normalize_quotes(b), "quote_difference")
        .when(squeeze(a) == squeeze(b), "whitespace_difference")
        .when(F.lower(a) == F.lower(b), "case_difference")
        .when(F.contains(a, b) | F.contains(b, a), "substring_difference")
        .otherwise("text_difference")
    )
