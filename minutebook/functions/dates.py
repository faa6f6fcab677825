"""Partial dates, spoken dates and terms of office."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from minutebook.functions.text import extract, rx, squeeze, strip

# --- fixed values -----------------------------------------------------------
MONTHS = ("january|february|march|april|may|june|july|august|september|"
          "october|november|december")
SECTIONS = ("Districts", "At-Large", "President", "Other")
# ----------------------------------------------------------------------------


def expand_date_from(s: Column) -> Column:
    """``YYYY`` or ``YYYY-MM`` to its first day; anything else unchanged."""
    t = F.nullif(strip(s), F.lit(""))
    return (F.when(t.rlike(r"^\d{4}$"), F.concat(t, F.lit("-01-01")))
            .when(t.rlike(r"^\d{4}-\d{2}$"), F.concat(t, F.lit("-01")))
            .otherwise(t))


def expand_date_to(s: Column) -> Column:
    """``YYYY`` or ``YYYY-MM`` to its last day; anything else unchanged."""
    t = F.nullif(strip(s), F.lit(""))
    month_end = F.last_day(F.try_to_date(F.concat(t, F.lit("-01")), "yyyy-MM-dd"))
    return (F.when(t.rlike(r"^\d{4}$"), F.concat(t, F.lit("-12-31")))
            .when(t.rlike(r"^\d{4}-\d{2}$"), month_end.cast("string"))
            .otherwise(t))


def meeting_date_in_text(text: Column) -> Column:
    """First "Month d, yyyy" in a text as an ISO date."""
    spoken = F.regexp_extract(text, rx(rf"({MONTHS})\s+\d{{1,2}},?\s+\d{{4}}", True), 0)
    plain = squeeze(F.replace(spoken, F.lit(","), F.lit(" ")))
    return F.try_to_date(plain, "MMMM d yyyy").cast("string")


def office_rank(office: Column) -> Column:
    """Sortable struct: districts by number, posts by number, president, rest."""
    district = extract(office, r"(?i)^District\s+(\d+)").try_cast("int")
    post = extract(office, r"(?i)^Post\s+(\d+)").try_cast("int")
    group = (F.when(F.coalesce(office, F.lit("")) == "", 99)
             .when(district.isNotNull(), 0)
             .when(post.isNotNull(), 1)
             .when(office == "President", 2)
             .otherwise(3))
    return F.struct(group.alias("group"),
                    F.coalesce(district, post, F.lit(0)).alias("seat"),
                    F.coalesce(office, F.lit("")).alias("office"))


def office_section(office: Column) -> Column:
    names = F.array(*[F.lit(s) for s in SECTIONS])
    return F.get(names, F.least(office_rank(office)["group"], F.lit(3)))


def term_label(start: Column, end: Column) -> Column:
    """``2002–2005``, ``2002`` within one year, ``2002–present`` while open."""
    first, last = F.substring(start, 1, 4), F.substring(end, 1, 4)
    return (F.when(end.isNull(), F.concat(first, F.lit("–present")))
            .when(first == last, first)
            .otherwise(F.concat(first, F.lit("–"), last)))
