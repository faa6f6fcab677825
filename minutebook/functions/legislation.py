"""Record types, final actions, suffix moves and flags."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from minutebook.functions.text import HOME, any_of, extract, for_city, strip

# --- fixed values: codes, keywords, endings and patterns of the records -----
TYPE_NAMES = {
    "R": "Resolution",
    "O": "Ordinance",
    "C": "Communication",
    "RT": "Report",
    "TR": "Transfer",
}
TYPE_PATTERNS = (
    r"^\d{2}-([A-Z]+)-\d+[A-Z]?",
    r"^\d{2}-([A-Z]+)\d+",
    r"-([A-Z]+)-",
)
STRICT_TYPE = r"^\d{2}-([A-Z]+)-\d+$"

ACTION_KEYWORDS = (
    "ADOPTED", "FILED", "REFERRED", "HELD", "FAILED", "APPROVED",
    "TABLED", "CARRIED", "PASSED", "WITHDRAWN", "VETOED", "REJECTED",
    "DEFERRED", "DEFEATED", "ADVERSED", "CONFIRMED", "ACCEPTED",
)
CAPS = r"[A-Z][A-Z\s,;():/\-]*?"
VOTE_ENDING = (r"\s+(" + CAPS + r"(?:ROLL CALL VOTE|VOTE)[^.]*?"
               r"(?:\d+\s*YEAS?;?\s*\d+\s*NAYS?|Y\/\d+N|\(\d+Y\/\d+N\))[^.]*?)$")
ACTION_TAIL = r"(?d)(?<![A-Z\s,;():/\-])[A-Z\s,;():/\-]++$"
CONSENT_ENDING = r"\s+(" + CAPS + r"(?:ON CONSENT|WITHOUT OBJECTION)[^.]*?)$"

ADVERSED_ENDINGS = (
    "ADVERSED BY A UNANIMOUS CONSENT OF COUNCIL WITH ALL MEMBERS PRESENT",
)
TERMINATION_ENDINGS = (
    "AUTOMATICALLY TERMINATED AND FILED BY CLERK PER CHARTER SECTION 2-407 WITHOUT OBJECTION",
    "AUTOMATICALLY TERMINATED AND FILED BY CLERK PER CHARTER SECTION 2-407",
    "AUTOMATICALLY TERMINATED AND FILED PER CHARTER SECTION 2-407 WITHOUT OBJECTION",
)
CHARTER_PHRASE = "TO AMEND THE CHARTER OF THE CITY OF ATLANTA"

# phrase -> category, first hit wins
ACTION_CATEGORIES = (
    ("ADOPTED SUBSTITUTE AS AMENDED", "ADOPTED_SUBSTITUTE_AMENDED"),
    ("ADOPTED AS AMENDED", "ADOPTED_AMENDED"),
    ("ADOPTED SUBSTITUTE", "ADOPTED_SUBSTITUTE"),
    ("ADOPTED ON CONSENT", "ADOPTED_CONSENT"),
    ("ADOPTED", "ADOPTED"),
    ("ADVERSED", "ADVERSED"),
    ("FILED", "FILED"),
    ("CONFIRMED", "CONFIRMED"),
    ("ACCEPTED", "ACCEPTED"),
)
# ----------------------------------------------------------------------------


def legislation_type(number: Column) -> Column:
    n = strip(number)
    return F.coalesce(*[extract(n, p) for p in TYPE_PATTERNS])


def legislation_type_name(code: Column) -> Column:
    named = reduce(lambda acc, kv: acc.when(code == kv[0], kv[1]), TYPE_NAMES.items(), F)
    return named.otherwise(code)


def legislation_type_strict(number: Column) -> Column:
    return extract(strip(number), STRICT_TYPE)


def with_legislation_type(df: DataFrame, number: str = "number") -> DataFrame:
    return (df.withColumn("legislationType", legislation_type(F.col(number)))
            .withColumn("legislationTypeName", legislation_type_name(F.col("legislationType"))))


def number_to_url(number: Column, base: str) -> Column:
    return F.concat(F.lit(base), F.lower(F.replace(number, F.lit("-"), F.lit(""))), F.lit(".pdf"))


def pdf_stem(url: Column) -> Column:
    path = F.try_parse_url(url, F.lit("PATH"))
    return F.lower(F.replace(F.substring_index(path, "/", -1), F.lit(".pdf"), F.lit("")))


def is_charter_amendment(description: Column, city: str = HOME) -> Column:
    phrase = for_city(CHARTER_PHRASE, city, pattern=False)
    return F.coalesce(F.contains(F.upper(description), F.lit(phrase)), F.lit(False))


def _keyword_ending(tail: Column) -> Column:
    """Whole match of the first keyword that starts an ending within the tail.

    The tail is the closing stretch of capitals, blanks and marks; no ending
    can begin before it.  Patterns are tried only for keywords it contains.
    """
    def ending(keyword: str) -> Column:
        found = F.regexp_extract(tail, rf"(?d)\s+({keyword}(?:\s+{CAPS})?)$", 0)
        # Bound to a lambda variable so that the pattern runs once.
        kept = F.transform(F.array(found), lambda f: F.when(
            (f != "") & (F.length(strip(f)) <= len(keyword) + 50), f))
        return F.when(F.contains(tail, F.lit(keyword)), F.get(kept, F.lit(0)))
    return F.coalesce(*[ending(k) for k in ACTION_KEYWORDS])


def extract_final_action(df: DataFrame, description: str = "description",
                         anchored: bool = False, prefix: str = "") -> DataFrame:
    """Split the closing action off a description.

    Adds ``cleaned``, ``action`` and ``needs_review``.  A vote ending is tried
    first, then consent, then a plain keyword.  The vote and consent forms
    start at the first capital from which they can be reached; with
    ``anchored`` they start at the last action keyword instead.
    """
    d = F.col(description)
    body = F.regexp_replace(d, r"\n$", "")
    vote, consent = VOTE_ENDING, CONSENT_ENDING
    if anchored:
        lead = rf"\s+((?:{'|'.join(ACTION_KEYWORDS)})(?:(?!{'|'.join(ACTION_KEYWORDS)})[^.])*?"
        vote = lead + r"VOTE[^.]*?(?:\d+\s*YEAS?;?\s*\d+\s*NAYS?|Y\/\d+N|\(\d+Y\/\d+N\))[^.]*?)$"
        consent = lead + r"(?:ON CONSENT|WITHOUT OBJECTION)[^.]*?)$"
    voted = F.when(F.contains(body, F.lit("VOTE")), extract(body, "(?d)" + vote, 0))
    agreed = F.when(F.contains(body, F.lit("ON CONSENT")) | F.contains(body, F.lit("WITHOUT OBJECTION")),
                    extract(body, "(?d)" + consent, 0))
    keyword_len = reduce(lambda acc, k: acc.when(F.col("_act").startswith(k), len(k)),
                         ACTION_KEYWORDS, F)
    return (
        df.withColumn("_sure", F.coalesce(voted, agreed))
        .withColumn("_tail", F.when(F.col("_sure").isNull(), F.regexp_extract(body, ACTION_TAIL, 0)))
        .withColumn("_end", F.coalesce(F.col("_sure"), _keyword_ending(F.col("_tail"))))
        .withColumn("_act", strip(F.col("_end")))
        .withColumn(prefix + "cleaned", F.when(
            F.col("_end").isNotNull(),
            strip(F.substring(body, F.lit(1), F.length(body) - F.length("_end")))).otherwise(d))
        .withColumn(prefix + "action", F.col("_act"))
        .withColumn(prefix + "needs_review", F.when(F.col("_sure").isNotNull(), False)
                    .when(F.col("_act").isNotNull(), F.length("_act") <= keyword_len + 5)
                    .otherwise(True))
        .drop("_sure", "_tail", "_end", "_act")
    )


def move_suffix(df: DataFrame, suffixes, description: str = "description",
                action: str = "finalAction") -> DataFrame:
    """Move the first listed ending from the description to the action column."""
    d = F.col(description)
    hit = reduce(lambda acc, s: acc.when(d.endswith(s), s), suffixes, F)
    old = F.col(action) if action in df.columns else F.lit(None).cast("string")
    return (
        df.withColumn("_hit", hit)
        .withColumn(action, F.coalesce(F.col("_hit"), old))
        .withColumn(description, F.when(
            F.col("_hit").isNotNull(),
            strip(F.substring(d, F.lit(1), F.length(d) - F.length("_hit")))).otherwise(d))
        .drop("_hit")
    )


def action_categories() -> list[str]:
    """Every value of :func:`final_action_category`."""
    return list(dict.fromkeys(c for _, c in ACTION_CATEGORIES)) + ["MISSING", "OTHER"]


def final_action_category(action: Column) -> Column:
    up = F.upper(action)
    missing = F.coalesce(action, F.lit("")).isin("", "MISSING")
    chain = F.when(missing, "MISSING")
    for phrase, category in ACTION_CATEGORIES:
        chain = chain.when(F.contains(up, F.lit(phrase)), category)
    return chain.otherwise("OTHER")


def vote_outcome(result: Column) -> Column:
    passed = F.contains(result, F.lit("FILED")) | F.contains(result, F.lit("ADOPTED"))
    return F.when(result.isNull() | (result == ""), None).when(passed, "passed").otherwise("referred")
