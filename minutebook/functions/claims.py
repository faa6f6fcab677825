"""Claims: which records are claims and how they ended."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from minutebook.functions.text import strip

# --- fixed values -----------------------------------------------------------
SETTLED_WORDS = ("SETTLEMENT", "SETTLED", "ADOPT", "ACCEPT", "CONFIRM")
# ----------------------------------------------------------------------------


def is_claim(description: Column) -> Column:
    low = F.lower(strip(description))
    return F.coalesce(low.startswith("for") & F.contains(low, F.lit("claim")), F.lit(False))


def claim_type(action: Column) -> Column:
    up = F.upper(action)
    return (F.when(action.isNull() | action.isin("", "MISSING"), None)
            .when(F.contains(up, F.lit("ADVERS")), "adversed")
            .when(up.rlike("|".join(SETTLED_WORDS)), "settlement"))
