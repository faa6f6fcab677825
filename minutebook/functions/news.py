"""News releases: boilerplate, previews and kinds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from minutebook.functions.text import HOME, extract, for_city, strip

# --- fixed values: boilerplate of the releases ------------------------------
HEADERS = (
    r"^FOR IMMEDIATE RELEASE.*?(?=\n(?:WHO:|WHAT:|WHEN:|WHERE:|ATLANTA\s*—|ATLANTA\s*–))",
    r"^Council Communications.*?Atlanta, GA.*?\n",
)
FOOTERS = (
    r"\n[^\n]*?(?:12 districts and three at-large posts|Council is comprised of|"
    r"Council is composed of).*$",
    r"\nTo learn more about the Atlanta City Council.*$",
    r"\n#{2,}.*$",
    r"\n[^\n]*?Office of Council Communications Contact.*$",
    r"\nContacts?:\s*\n.*$",
    r"\nCouncil President:.*$",
)
RELEASE_IMAGE = ("iVBORw0KGgoAAAANSUhEUgAAA88AAAD0CAYAAACl3hQwAAAAAXNSR0IArs4c6QAAAAR"
                 "nQU1BAACxjwv8YQUAAAAJcEhZcwAAFxEAABcR")
ADVISORY_IMAGE = ("iVBORw0KGgoAAAANSUhEUgAAA88AAAD1CAYAAABugseVAAAAAXNSR0IArs4c6QAAAAR"
                  "nQU1BAACxjwv8YQUAAAAJcEhZcwAAFxEAABcR")
IMAGE_ALT = r"(?i)<img[^>]*alt=\"([^\"]+)\"[^>]*>"
NEWS_TYPES = ("News Release", "Media Advisory", "Unknown")
# ----------------------------------------------------------------------------


def strip_boilerplate(text: Column, city: str = HOME) -> Column:
    out = F.coalesce(text, F.lit(""))
    for pattern in for_city(HEADERS + FOOTERS, city):
        out = F.regexp_replace(out, "(?smUd)" + pattern, "")
    return strip(F.regexp_replace(out, r"\n{3,}", "\n\n"))


def _last_index(c: Column, piece: str) -> Column:
    """Zero-based start of the last occurrence, -1 where there is none."""
    back = F.instr(F.reverse(c), piece[::-1])
    return F.when(back == 0, -1).otherwise(F.length(c) - back - len(piece) + 1)


def preview(text: Column, n: int = 300, city: str = HOME) -> Column:
    """Cleaned text cut at the last sentence past 60 % of ``n``, else at a word."""
    clean = strip_boilerplate(text, city)
    head = F.substring(clean, 1, n)
    sentence, word = _last_index(head, ". "), _last_index(head, " ")
    return (F.when(F.length(clean) <= n, clean)
            .when(sentence > n * 0.6, F.substring(head, F.lit(1), sentence + 1))
            .when(word > 0, F.concat(F.substring(head, F.lit(1), word), F.lit("...")))
            .otherwise(F.concat(head, F.lit("..."))))


def news_type(html: Column) -> Column:
    alt = F.lower(extract(html, IMAGE_ALT))
    low = F.lower(html)

    def has(c: Column, s: str) -> Column:
        return F.contains(c, F.lit(s))

    release, advisory, unknown = NEWS_TYPES
    return (F.when(html.isNull() | (html == ""), unknown)
            .when(has(html, RELEASE_IMAGE), release)
            .when(has(html, ADVISORY_IMAGE), advisory)
            .when(has(alt, "media advisory"), advisory)
            .when(has(alt, "news release"), release)
            .when(has(low, "media advisory"), advisory)
            .when(has(low, "news release"), release)
            .otherwise(unknown))
