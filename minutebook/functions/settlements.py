"""Individual claim settlements and court settlements."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from minutebook.functions.money import DOLLAR_SIGN, FIGURE, to_money
from minutebook.functions.text import HOME, extract, for_city, rx, strip, title_case

# --- fixed values: settlement wording ---------------------------------------
DAMAGE = r"^FOR\s+(.+?)\s+ALLEGED\s+TO\s+HAVE"
INCIDENT = r"AS A RESULT OF (?:A\s+)?(.+?)\s+ON\s+"
INCIDENT_DATE = r"\bON\s+(\w+ \d{1,2},\s*\d{4}|\d{1,2}/\d{1,2}/\d{2,4})"
LOCATION = r"\bAT\s+(.+?)\s*[\.\(]"
UNKNOWN_LOCATION = "AN UNKNOWN LOCATION"
DEPARTMENT_AMOUNT = r"\(([A-Z0-9 /]+)\s*[-–]\s*\$" + FIGURE + r"\)"
DEPARTMENT = r"\(([A-Z0-9 /]+)\)"
CLAIM_NUMBER = r"#(\d+)"
CLAIM_OF = r"CLAIM OF\s*:?\s*(.+)"
PLAINTIFF = r"[Cc]ase of\s+(.+?)\s+[Vv]\.?\s+[Cc]ity of Atlanta"
CASE_TITLE = " v. City of Atlanta"
CASE_NUMBER = r"Civil Action (?:File )?No\.?\s*([A-Z0-9\-]+)"
COURT = (r"((?:Superior|State|Magistrate|Civil|Municipal|Federal|U\.?S\.? District|"
         r"Fulton|DeKalb|Gwinnett|Clayton)\s+"
         r"(?:Court|County Superior Court|County State Court|County Magistrate Court)[^,;\.]*)")
TOTAL_AMOUNT = r"[Tt]otal (?:Settlement )?[Aa]mount\s*(?:of\s*)?\$?\s*" + FIGURE
COURT_PHRASE = "SETTLEMENT AMOUNT"
COLUMNS = (
    "id", "number", "legislation_date", "legislation_type", "settlement_category",
    "claim_type_raw", "damage_type", "incident_type", "incident_date", "incident_location",
    "department_code", "amount", "claim_number", "claimant_name", "claimant_address",
    "plaintiff", "case_name", "case_number", "court", "final_action", "sponsors",
    "pdf_url", "description",
)
# ----------------------------------------------------------------------------


def incident_date(description: Column) -> Column:
    """ISO date for the three written forms, the raw text for any other."""
    raw = strip(extract(description, rx(INCIDENT_DATE, True)))
    spoken = F.try_to_date(F.regexp_replace(raw, r",\s+", ", "), "MMMM d, yyyy")
    numeric = r"^(\d{1,2})/(\d{1,2})/(\d{2}|\d{4})$"
    month, day, year = (F.regexp_extract(raw, numeric, i) for i in (1, 2, 3))
    century = (F.when(F.length(year) == 4, "")
               .when(year.try_cast("int") >= 69, "19").otherwise("20"))
    slashed = F.try_to_date(
        F.when(raw.rlike(numeric), F.concat(month, F.lit("/"), day, F.lit("/"), century, year)),
        "M/d/yyyy")
    return F.coalesce(spoken.cast("string"), slashed.cast("string"), raw)


def incident_location(description: Column) -> Column:
    place = strip(extract(description, rx(LOCATION, True)))
    return F.when(F.upper(place) == UNKNOWN_LOCATION, "Unknown").otherwise(title_case(place))


def claimant_parts(description: Column) -> Column:
    pieces = F.split(strip(extract(description, rx(CLAIM_OF, True, dot_all=True))), "[;,]", -1)
    return F.filter(F.transform(pieces, strip), lambda p: p != "")


def individual_claim(d: Column) -> dict[str, Column]:
    coded = F.regexp_extract(d, DEPARTMENT_AMOUNT, 1)
    parts = claimant_parts(d)
    address = F.array_join(F.slice(parts, 2, 1 << 20), ", ")
    return {
        "damage_type": title_case(strip(extract(d, rx(DAMAGE, True)))),
        "incident_type": title_case(strip(extract(d, rx(INCIDENT, True)))),
        "incident_date": incident_date(d),
        "incident_location": incident_location(d),
        "department_code": F.when(coded != "", strip(coded)).otherwise(strip(extract(d, DEPARTMENT))),
        "amount": to_money(F.regexp_extract(d, DEPARTMENT_AMOUNT, 2)),
        "claim_number": extract(d, CLAIM_NUMBER),
        "claimant_name": title_case(F.get(parts, F.lit(0))),
        "claimant_address": F.when(F.size(parts) > 1, title_case(address)),
    }


def court_settlement(d: Column, city: str = HOME) -> dict[str, Column]:
    plaintiff = title_case(strip(extract(d, rx(for_city(PLAINTIFF, city), True))))
    total = F.regexp_extract(d, TOTAL_AMOUNT, 1)
    figure = F.when(total != "", total).otherwise(F.regexp_extract(d, DOLLAR_SIGN, 1))
    return {
        "plaintiff": plaintiff,
        "case_name": F.concat(plaintiff, F.lit(for_city(CASE_TITLE, city, pattern=False))),
        "case_number": extract(d, rx(CASE_NUMBER, True)),
        "court": title_case(strip(extract(d, rx(COURT, True)))),
        "amount": to_money(figure),
    }
