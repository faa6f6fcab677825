"""Donations accepted or made by the city."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from minutebook.functions.text import HOME, any_of, extract, for_city, rx, strip, title_case

# --- fixed values: donation wording -----------------------------------------
SKIP = (
    r"\bEASEMENT\b.{0,80}\bDONAT",
    r"\bDONAT.{0,80}\bEASEMENT\b",
    r"\bRIGHT.OF.WAY\b.{0,60}\bDONAT",
    r"\bRECONVEYANCE OF DONATED",
    r"\bDONATED SURPLUS FOOD",
    r"\bCOLLECT DONATIONS FROM ORGANIZATIONS AND INDIVIDUALS",
)
ACCEPT = (
    r"\bACCEPT\b.{0,60}\bDONAT",
    r"\bRECEIVE\b.{0,60}\bDONAT",
    r"\bDONAT\w*\b.{0,80}\bON BEHALF OF THE CITY",
    r"\bDONAT\w*\b.{0,80}\bTO THE CITY OF ATLANTA",
    r"\bDONAT\w*\b.{0,80}\bTO THE CITY\b",
    r"\bACCEPTANCE OF.{0,30}\bDONAT",
)
MADE = (
    r"\bAUTHORIZING A DONATION.{0,60}\bTO\b",
    r"\bAUTHORIZING THE DONATION.{0,60}\bTO\b",
    r"\bCITY.{0,60}\bDONATE.{0,60}\bTO\b",
    r"\bDONATE.{0,80}\bTO\b.{0,80}\bINC\b",
    r"\bDONATE.{0,80}\bTO\b.{0,80}\bASSOCIAT",
    r"\bDONATE.{0,80}\bTO\b.{0,80}\bFOUNDAT",
    r"\bDONATE.{0,80}\bTO\b.{0,80}\bORGANIZAT",
    r"\bDONATE AN AMOUNT",
    r"\bDONATION.{0,30}NOT TO EXCEED.{0,60}\bTO\b",
)
MADE_WINS = r"AUTHORIZING.{0,30}DONATION.{0,60}TO\b"
ORG_SUFFIXES = (
    "INC|LLC|LTD|CORP|CO|COMPANY|FOUNDATION|ASSOCIATION|ASSOC|AUTHORITY|CENTER|CENTRE|"
    "FUND|TRUST|COMMISSION|DEPARTMENT|DEPT|UNIVERSITY|COLLEGE|SCHOOL|CHURCH|HOSPITAL|"
    "SOCIETY|CLUB|COMMITTEE|ALLIANCE|INSTITUTE|INTERNATIONAL|BANK|GROUP"
)
PARTY = r"((?:[A-Z][A-Z&\-'\., ]+?)(?:(?:" + ORG_SUFFIXES + r")\.?)?)\s*"
DONOR = (
    r"\bFROM\s+" + PARTY + r"(?:IN THE AMOUNT|FOR|,|\.|TOTALING|AND|TO PROVIDE|TO FUND)",
    r"\bFROM\s+" + PARTY + r"(?:FOR|,|\.|\s*$)",
)
RECIPIENT = r"\bTO\s+" + PARTY + r"(?:FOR|,|\.|ON BEHALF|IN ORDER|TO PROVIDE|\s*$)"
NOT_RECIPIENTS = ("THE CITY", "CITY OF ATLANTA", "CITY", "ATLANTA")
PURPOSE_TOPICS = (
    "SUMMER|PARKS?|PROGRAM|RECREATION|ARTS?|FUND|BENEFIT|SUPPORT|BENEFIT|ENRICH|CAMP|"
    "FESTIVAL|FILM|YOUTH|HOMELESS|VIOLENCE|FIRE|MUSIC|COMMUNITY|CHILDREN|CITY|HOUSING|"
    "PUBLIC|POLICE|HISTORIC|STREET|CULTURE|GARDEN|TRAIL|SENIOR|VETERAN|HEALTH"
)
PURPOSE = (
    r"\bFOR THE PURPOSE OF\s+(.+?)(?:\.|;|,\s+(?:AND|SAID|AUTHORIZ))",
    r"\bTO BE USED FOR\s+(.+?)(?:\.|;|,)",
    r"\bFOR\s+((?:THE\s+)?(?:" + PURPOSE_TOPICS + r").+?)(?:\.|;|,| AND FOR)",
)
ITEM_OF = (r"\bDONATION OF\s+(?:A\s+|AN\s+|THE\s+)?(.+?)\s+"
           r"(?:FROM\b|TO\b|FOR\b|;|\.|,\s+(?:AND|SAID|AUTHOR))")
ITEM_DONATE = r"\bDONATE\s+(?:A\s+|AN\s+|THE\s+)?(.+?)\s+TO\b"
MONEY_ITEM = r"^(?:AN AMOUNT|FUNDS?|\$)"
IN_KIND = r"\bVALUED AT\b|\bIN[-\s]KIND\b|\bNON[-\s]MONETARY\b"
ARTICLE = r"^(?:THE|A|AN)\s+"
COLUMNS = (
    "id", "meeting_doc_id", "number", "legislation_date", "legislation_type",
    "donation_direction", "donation_type", "amount", "donor", "recipient", "item_donated",
    "purpose", "final_action", "sponsors", "pdf_url", "description",
)
# ----------------------------------------------------------------------------


def _found(c: Column, patterns) -> Column:
    return c.rlike(rx(any_of(patterns), True))


def mentions_donation(description: Column) -> Column:
    return F.contains(F.lower(description), F.lit("donat"))


def donation_direction(description: Column, compat: bool = False, city: str = HOME) -> Column:
    """'accepted', 'made' or NULL.

    ``compat`` keeps the three accept patterns that ask for the bare word
    DONAT and therefore never match.
    """
    accept = [p.replace(r"DONAT\w*\b", r"DONAT\b") for p in ACCEPT] if compat else ACCEPT
    accept = for_city(accept, city)
    accepted, made = _found(description, accept), _found(description, MADE)
    return F.when(mentions_donation(description) & ~_found(description, SKIP), (
        F.when(accepted & made,
               F.when(_found(description, [MADE_WINS]), "made").otherwise("accepted"))
        .when(accepted, "accepted")
        .when(made, "made")))


def _bound(c: Column, then) -> Column:
    """``then(c)`` with ``c`` evaluated once, however often it is used."""
    return F.get(F.transform(F.array(c), then), F.lit(0))


def _party(raw: Column) -> Column:
    tail_off = F.regexp_replace(strip(raw), r"[,. ]+$", "")
    return F.regexp_replace(tail_off, rx(ARTICLE, True), "")


def donor(description: Column) -> Column:
    raw = F.coalesce(*[extract(description, rx(p, True)) for p in DONOR])
    return _bound(_party(raw), lambda name: F.when(F.length(name) > 2, title_case(name)))


def recipient(description: Column, city: str = HOME) -> Column:
    own = for_city(NOT_RECIPIENTS, city, pattern=False)
    return _bound(_party(extract(description, rx(RECIPIENT, True))), lambda name: F.when(
        (F.length(name) >= 3) & ~F.upper(name).isin(*own), title_case(name)))


def purpose(description: Column) -> Column:
    raw = F.coalesce(*[extract(description, rx(p, True)) for p in PURPOSE])
    return title_case(F.regexp_replace(strip(raw), r"[;,. ]+$", ""))


def item_donated(description: Column) -> Column:
    given = F.regexp_replace(strip(extract(description, rx(ITEM_OF, True))), r"[;,. ]+$", "")
    item = F.coalesce(given, strip(extract(description, rx(ITEM_DONATE, True))))
    return _bound(item, lambda i: F.when(
        ~i.rlike(rx(MONEY_ITEM, True)) & (F.length(i) > 2), title_case(i)))


def donation_type(description: Column, item: Column) -> Column:
    kind = F.coalesce(item, F.lit("")) != ""
    return F.when(kind | description.rlike(rx(IN_KIND, True)), "in_kind").otherwise("monetary")
