"""Sponsor names, committees and the kind of paper."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from minutebook.functions.text import any_of, capitalize, extract, rx, squeeze, strip

# --- fixed values: how sponsors are announced in a description --------------
NAME_CHARS = r"[A-Z][A-Z\s.,\-'&]"
BY_MEMBERS = r"BY\s+COUNCIL\s*MEMBERS?\s+"
SPONSOR_MAIN = (BY_MEMBERS + r"(" + NAME_CHARS + r"+?)"
                r"(?:\s+AS\s+(?:AMENDED|SUBSTITUTED|INTRODUCED)|DIRECTING|AUTHORIZING|"
                r"TO\s+(?:AMEND|AUTHORIZE|ZONE|PROHIBIT|CONVERT)|"
                r"REQUESTING|EXPRESSING|RECOGNIZING)")
SPONSOR_INTRODUCED = (r"AS\s+INTRODUCED\s+" + BY_MEMBERS + r"(" + NAME_CHARS + r"+?)"
                      r"(?:\s+(?:AUTHORIZING|TO\s+|DIRECTING|REQUESTING|AS\s+))")
SPONSOR_OPENING = (r"^(?:AN?\s+(?:RESOLUTION|ORDINANCE)\s+)?" + BY_MEMBERS +
                   r"(" + NAME_CHARS + r"{5,100}?)"
                   r"\s+(?:DIRECTING|AUTHORIZING|TO\s|REQUESTING|EXPRESSING|RECOGNIZING|AS\s+)")
OPENINGS = (
    "A RESOLUTION BY COUNCILMEMBER", "AN ORDINANCE BY COUNCILMEMBER",
    "A RESOLUTION BY COUNCIL MEMBER", "AN ORDINANCE BY COUNCIL MEMBER",
)
NOT_NAMES = (
    "AS AMENDED", "AS SUBSTITUTED", "COMMITTEE", "DIRECTING",
    "AUTHORIZING", "REQUESTING", "THE", "TO",
)
NAME_SUFFIXES = ("II", "III", "IV", "JR", "SR")
COMMITTEE_OPENING = r"^AN?\s+(?:RESOLUTION|ORDINANCE)\s+BY\s+(?:THE\s+)?([^;.]+?COMMITTEE)"
INVALID_SPONSOR = (" as substitut", " as amend", "(as substitut", "(as amend")
INVALID_SPONSOR_SHOWN = (" AS SUBSTITUTED BY ", " AS AMENDED BY ")
# ----------------------------------------------------------------------------


def _name_part(part: Column) -> Column:
    bare = F.regexp_replace(part, r"[.,]+$", "")
    return (
        F.when(F.upper(bare).isin(*NAME_SUFFIXES),
               F.concat(F.upper(bare), F.substring(part, F.length(bare) + 1, F.length(part))))
        .when((F.length(bare) <= 2) & bare.rlike(r"^\p{Lu}"), part)
        .when(F.contains(part, F.lit("-")),
              F.array_join(F.transform(F.split(part, "-", -1), capitalize), "-"))
        .otherwise(capitalize(part))
    )


def name_case(name: Column) -> Column:
    return F.array_join(F.transform(F.split(squeeze(name), " ", -1), _name_part), " ")


def split_names(text: Column, compat: bool = False) -> Column:
    """Individual names from "A, B AND C".

    ``compat`` tests the stop words as plain substrings, which also drops
    names such as ANTONIO; the default tests whole words.
    """
    plain = F.regexp_replace(squeeze(text), r"[,;]+$", "")
    stop = any_of(NOT_NAMES) if compat else rf"\b(?:{any_of(NOT_NAMES)})\b"

    def is_name(n: Column) -> Column:
        return ((F.length(n) >= 3) & ~F.upper(n).rlike(stop)
                & (F.contains(n, F.lit(" ")) | n.rlike(r"[A-Z]\.\s*[A-Z]\.")))

    parts = F.transform(F.split(plain, r"(?i)\s+AND\s+|,", -1), lambda n: F.trim(n))
    return F.transform(F.filter(parts, is_name), name_case)


def extract_sponsors(df: DataFrame, description: str = "description",
                     compat: bool = False) -> DataFrame:
    """Add ``sponsors`` and ``sponsorConfidence``, NULL where none were found."""
    d = F.col(description)
    # "COUNCIL" must be present for any form; skip the patterns elsewhere.
    candidate = F.contains(F.upper(d), F.lit("COUNCIL"))
    opening = F.upper(strip(d)).rlike("^(?:" + "|".join(OPENINGS) + ")")
    opened = SPONSOR_OPENING.replace("AN?", "A") if compat else SPONSOR_OPENING
    return (
        df.withColumn("_sure", F.when(candidate, F.coalesce(
            extract(d, rx(SPONSOR_MAIN, True)), extract(d, rx(SPONSOR_INTRODUCED, True)))))
        .withColumn("_text", F.coalesce(
            F.col("_sure"), F.when(candidate & opening, extract(d, rx(opened, True)))))
        .withColumn("_names", split_names(F.col("_text"), compat))
        .withColumn("sponsors", F.when(F.size("_names") > 0, F.col("_names")))
        .withColumn("sponsorConfidence", F.when(F.col("sponsors").isNull(), None)
                    .when(F.col("_sure").isNotNull(), "high").otherwise("medium"))
        .drop("_sure", "_text", "_names")
    )


def committee_text(description: Column) -> Column:
    return squeeze(extract(description, rx(COMMITTEE_OPENING, True)))


def extract_committee(df: DataFrame, known: DataFrame, description: str = "description",
                      name: str = "name") -> DataFrame:
    """Add ``committee`` and ``committee_known``; a known spelling wins."""
    # Names differing only by case collapse to one, so the join adds no rows.
    dim = (known.groupBy(F.upper(F.col(name)).alias("_key"))
           .agg(F.min(name).alias("_known")))
    return (
        df.withColumn("_raw", committee_text(F.col(description)))
        .withColumn("_key", F.upper("_raw"))
        .join(dim, "_key", "left")
        .withColumn("committee", F.coalesce("_known", "_raw"))
        .withColumn("committee_known", F.col("_known").isNotNull())
        .drop("_key", "_raw", "_known")
    )


def add_committee_sponsor(df: DataFrame, committee: str = "committee") -> DataFrame:
    have = F.coalesce(F.col("sponsors"), F.array().cast("array<string>"))
    missing = F.col(committee).isNotNull() & ~F.array_contains(have, F.col(committee))
    return (df.withColumn("_add", missing)
            .withColumn("sponsors", F.when(F.col("_add"), F.array_append(have, F.col(committee)))
                        .otherwise(F.col("sponsors")))
            .withColumn("sponsorConfidence", F.when(F.col("_add"), "auto-committee")
                        .otherwise(F.col("sponsorConfidence")))
            .drop("_add"))


def invalid_sponsor(name: Column) -> Column:
    low = F.lower(name)
    hit = F.lit(False)
    for piece in INVALID_SPONSOR:
        hit = hit | F.contains(low, F.lit(piece))
    return hit


def shown_invalid_sponsor(name: Column) -> Column:
    up = F.upper(name)
    return F.contains(up, F.lit(INVALID_SPONSOR_SHOWN[0])) | F.contains(up, F.lit(INVALID_SPONSOR_SHOWN[1]))


def drop_invalid_sponsors(sponsors: Column, shown: bool = False) -> Column:
    test = shown_invalid_sponsor if shown else invalid_sponsor
    return F.filter(sponsors, lambda s: ~test(s))


def co_sponsors(sponsors: Column, own: Column) -> Column:
    return F.filter(sponsors, lambda s: (s != own) & ~shown_invalid_sponsor(s))


def paper_type_from_flags(has_sponsors: Column, committee: Column, member: Column) -> Column:
    return (F.when(~has_sponsors, None)
            .when(committee & ~member, "Committee Paper")
            .when(member & ~committee, "Personal Paper")
            .when(member & committee, "Mixed")
            .otherwise("Unknown"))
