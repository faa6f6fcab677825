"""Dollar amounts in running text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
FIGURE = r"([\d,]+(?:\.\d{2})?)"
NOT_TO_EXCEED = r"(?i)NOT TO EXCEED\s*\$?\s*" + FIGURE
STATED = r"(?i)(?:AMOUNT OF|TOTALING|TOTAL OF|TOTAL AMOUNT OF)\s*\$?\s*" + FIGURE
DOLLAR_SIGN = r"\$\s*" + FIGURE
# ----------------------------------------------------------------------------


def to_money(figure: Column) -> Column:
    return F.replace(figure, F.lit(","), F.lit("")).try_cast("decimal(18,2)")


def first_dollar_amount(text: Column) -> Column:
    return to_money(F.regexp_extract(text, DOLLAR_SIGN, 1))


def dollar_amount(text: Column) -> Column:
    """"Not to exceed", then a stated amount, then the first dollar sign.

    The first form present decides, even if its figure is empty or zero.
    """
    cap, stated, first = (F.regexp_extract(text, p, 1) for p in (NOT_TO_EXCEED, STATED, DOLLAR_SIGN))
    figure = F.when(cap != "", cap).when(stated != "", stated).otherwise(first)
    return F.nullif(to_money(figure), F.lit(0).cast("decimal(18,2)"))
