"""Legislation-shaped inputs derived from the test tables.

``FIXTURES`` runs unchanged in Spark and in the checking database (tables are
written in braces).  ``DERIVED`` holds further steps that only the check needs.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from minutebook.functions import legislation as leg
from minutebook.operators.tables import materialize

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

FIXTURES: dict[str, str] = {
    "fx_line": """
SELECT l.l_orderkey AS k, l.l_linenumber AS n, UPPER(p.p_name) AS nm
FROM {lineitem} l JOIN {part} p ON l.l_partkey = p.p_partkey""",
    "fx_sp": "SELECT k, MIN(nm) AS s1, MAX(nm) AS s2 FROM fx_line GROUP BY k",
    "fx_base": """
SELECT o.o_orderkey AS id, CAST(CAST(o.o_orderdate AS DATE) AS STRING) AS date,
       o.o_orderkey % 12 AS tpl, o.o_orderkey % 6 AS tc,
       CAST(CAST(FLOOR(o.o_totalprice) AS BIGINT) AS STRING) AS amt,
       UPPER(r.r_name) AS committee, UPPER(c.c_mktsegment) AS seg,
       COALESCE(s.s1, 'NO NAME') AS s1, COALESCE(s.s2, 'NO NAME') AS s2
FROM {orders} o
JOIN {customer} c ON o.o_custkey = c.c_custkey
JOIN {nation} n ON c.c_nationkey = n.n_nationkey
JOIN {region} r ON n.n_regionkey = r.r_regionkey
LEFT JOIN fx_sp s ON s.k = o.o_orderkey""",
    "legis_items": """
SELECT id, date,
  CASE tc WHEN 5 THEN CONCAT('X', CAST(id AS STRING))
          ELSE CONCAT(SUBSTR(date, 3, 2), '-',
               CASE tc WHEN 0 THEN 'R' WHEN 1 THEN 'O' WHEN 2 THEN 'C' WHEN 3 THEN 'RT' ELSE 'TR' END,
               '-', LPAD(CAST(id AS STRING), 6, '0')) END AS number,
  CASE tpl
    WHEN 0 THEN CONCAT('A RESOLUTION BY COUNCILMEMBERS ', s1, ' AND ', s2, ' AUTHORIZING A DONATION NOT TO EXCEED $', amt, '.00 TO ', seg, ' FOUNDATION FOR YOUTH PROGRAMS; ADOPTED')
    WHEN 1 THEN CONCAT('AN ORDINANCE BY ', committee, ' COMMITTEE TO AMEND THE CHARTER OF THE CITY OF ATLANTA. ADOPTED BY A ROLL CALL VOTE OF 14 YEAS; 0 NAYS')
    WHEN 2 THEN CONCAT('FOR PROPERTY DAMAGE ALLEGED TO HAVE BEEN SUSTAINED AS A RESULT OF A MOTOR VEHICLE ACCIDENT ON 01/16/2013 AT ', seg, ' STREET. (APD/04 - $', amt, '.50) #', CAST(id AS STRING), ' CLAIM OF: ', s1, '; 12 MAIN ST; ATLANTA')
    WHEN 3 THEN CONCAT('A RESOLUTION AUTHORIZING THE SETTLEMENT AMOUNT IN THE CASE OF ', s1, ' V. CITY OF ATLANTA, CIVIL ACTION FILE NO. ', CAST(id AS STRING), ', FULTON COUNTY SUPERIOR COURT, IN THE TOTAL AMOUNT OF $', amt, '.00')
    WHEN 4 THEN CONCAT('A RESOLUTION TO ACCEPT A DONATION OF EQUIPMENT FROM ', seg, ' INC FOR THE PURPOSE OF PARKS; FILED')
    WHEN 5 THEN CONCAT('A RESOLUTION BY COUNCIL MEMBER ', s1, ' REQUESTING A STUDY ADVERSED BY A UNANIMOUS CONSENT OF COUNCIL WITH ALL MEMBERS PRESENT')
    WHEN 6 THEN CONCAT('AN ORDINANCE BY COUNCILMEMBER ', s1, ' AS AMENDED BY ', committee, ' COMMITTEE. ADOPTED ON CONSENT')
    WHEN 7 THEN CONCAT('A COMMUNICATION FROM ', s2, ' AUTOMATICALLY TERMINATED AND FILED BY CLERK PER CHARTER SECTION 2-407')
    WHEN 8 THEN CONCAT('FOR BODILY INJURY ALLEGED TO HAVE BEEN SUSTAINED AS A RESULT OF A FALL ON JANUARY 5, 2014 AT AN UNKNOWN LOCATION. (NA/UNK) CLAIM OF: ', s2)
    WHEN 9 THEN CONCAT('A RESOLUTION OF THE ', committee, ' COMMITTEE; REFERRED')
    WHEN 10 THEN CONCAT('  ', seg, ' REPORT  ')
    ELSE '' END AS description
FROM fx_base""",
    "docs_variants": """
SELECT doc_id, text, lang, source FROM {documents}
UNION ALL SELECT doc_id + 1000000, CONCAT('  ', REPLACE(text, ' ', '  ')), lang, source FROM {documents} WHERE doc_id % 7 = 0
UNION ALL SELECT doc_id + 2000000, SUBSTR(text, 1, CAST(FLOOR(LENGTH(text) * 0.8) AS INT)), lang, source FROM {documents} WHERE doc_id % 5 = 0""",
    "item_sponsors": """
SELECT DISTINCT l.l_orderkey AS id, CAST(CAST(o.o_orderdate AS DATE) AS STRING) AS date, s.s_name AS sponsor
FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey JOIN {supplier} s ON l.l_suppkey = s.s_suppkey""",
    "roster_terms": """
SELECT s_name AS name, CONCAT(CAST(1995 + s_suppkey % 5 AS STRING), '-01-01') AS start_date,
       CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE CONCAT(CAST(1997 + s_suppkey % 5 AS STRING), '-12-31') END AS end_date,
       CASE WHEN s_suppkey % 10 = 0 THEN 'President' ELSE CONCAT('District ', CAST(s_suppkey % 12 + 1 AS STRING)) END AS office
FROM {supplier} WHERE s_suppkey % 3 <> 0""",
    "committees": "SELECT s_name AS name, CAST(NULL AS STRING) AS end_date FROM {supplier} WHERE s_suppkey % 3 = 0",
    "meetings": "SELECT DISTINCT CAST(CAST(o_orderdate AS DATE) AS STRING) AS date FROM {orders}",
    "news": """
SELECT event_id AS id, ts, event_type AS type,
       CASE WHEN event_id % 11 = 0 THEN 1 WHEN event_id % 5 = 0 THEN NULL ELSE 0 END AS is_hidden, props AS content
FROM {events}""",
    "run_log": """
SELECT CONCAT('2024-01-01 00:00:00 | ID ', LPAD(CAST(event_id AS STRING), GREATEST(6, LENGTH(CAST(event_id AS STRING))), '0'), ' | ', event_type, ' | msg') AS value
FROM {events}""",
    "bookmarks": """
SELECT l_orderkey AS package_id, l_linenumber AS seq, MIN(l_linenumber * 3) AS page_start
FROM {lineitem} GROUP BY l_orderkey, l_linenumber""",
    "patches": """
SELECT o_orderkey AS id, CONCAT('PATCHED ', CAST(o_orderkey AS STRING)) AS description
FROM {orders} WHERE o_orderkey % 50 = 0""",
}


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sql_first(pattern: str, group: int = 1, column: str = "description") -> str:
    return f"NULLIF(regexp_extract({column}, {lit(pattern)}, {group}), '')"


def _action_sql() -> str:
    """The closing action of a description, written out in SQL."""
    tails = []
    for k in leg.ACTION_KEYWORDS:
        m = sql_first(rf"\s+({k}(?:\s+{leg.CAPS})?)$", 0)
        tails.append(f"CASE WHEN length(trim({m})) <= {len(k) + 50} THEN {m} END")
    size = " ".join(f"WHEN starts_with(act, '{k}') THEN {len(k)}" for k in leg.ACTION_KEYWORDS)
    return f"""
SELECT id, date, number, description,
  CASE WHEN fin IS NULL THEN description
       ELSE trim(substr(description, 1, length(description) - length(fin))) END AS cleaned,
  act AS action,
  CASE WHEN sure IS NOT NULL THEN false
       WHEN act IS NOT NULL THEN length(act) <= 5 + CASE {size} END
       ELSE true END AS needs_review
FROM (SELECT *, trim(fin) AS act
      FROM (SELECT *, COALESCE(sure, {', '.join(tails)}) AS fin
            FROM (SELECT *, COALESCE({sql_first(leg.VOTE_ENDING, 0)},
                                     {sql_first(leg.CONSENT_ENDING, 0)}) AS sure FROM legis_items)))"""


def _type_sql() -> str:
    code = ", ".join(sql_first(p, 1, "trim(number)") for p in leg.TYPE_PATTERNS)
    names = " ".join(f"WHEN '{c}' THEN '{n}'" for c, n in leg.TYPE_NAMES.items())
    return f"""
SELECT *, CASE type_code {names} ELSE type_code END AS type_name
FROM (SELECT *, COALESCE({code}) AS type_code FROM acted)"""


def _category_sql(column: str) -> str:
    chain = " ".join(f"WHEN contains(upper({column}), '{p}') THEN '{c}'" for p, c in leg.ACTION_CATEGORIES)
    return f"CASE WHEN COALESCE({column}, '') IN ('', 'MISSING') THEN 'MISSING' {chain} ELSE 'OTHER' END"


DERIVED: dict[str, str] = {
    "acted": _action_sql(),
    "typed": _type_sql(),
    "items": f"""
SELECT id, date, number, description, action AS finalAction, type_code, type_name,
       {_category_sql('action')} AS category FROM typed""",
}


def _with(sql: str, pool: dict[str, str]) -> list[str]:
    """Names of the fixtures a statement needs, dependencies first."""
    order: list[str] = []

    def visit(text: str) -> None:
        for name in pool:
            if name not in order and re.search(rf"\b{name}\b", text):
                visit(pool[name])
                if name not in order:
                    order.append(name)

    visit(sql)
    return order


def compose(sql: str) -> str:
    """A self-contained statement for the checking database."""
    pool = {**FIXTURES, **DERIVED}
    names = _with(sql, pool)
    head = ",\n".join(f"{n} AS ({pool[n]})" for n in names)
    body = sql.strip()
    if head and body[:5].upper() == "WITH ":
        text = f"WITH {head},\n{body[5:]}"
    else:
        text = f"WITH {head}\n{body}" if head else body
    for t in TABLES:
        text = text.replace("{" + t + "}", t)
    return text


# Inputs of costly text work, and derived inputs that many queries share.
TEXT_TABLES = ("documents", "pages")
SHARED = ("fx_base", "legis_items", "docs_variants", "item_sponsors")
_READY: dict[tuple[str, str, str], DataFrame] = {}


def _stored(df: DataFrame, name: str) -> DataFrame:
    """Write an input to the scratch folder once.

    The small test files hold one row group each, which would leave all text
    work to one core; they are spread over as many files as there are cores.
    """
    if name in DEALT:  # has parts enough
        return materialize(df, name)
    cores = df.sparkSession.sparkContext.defaultParallelism
    return materialize(df.repartition(cores) if len(df.inputFiles()) < cores else df, name)


def _ready(spark: SparkSession, sf: str, name: str, make) -> DataFrame:
    """Inputs are resolved, and the shared ones derived, once per application."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _READY:
        df = make()
        few = name in TEXT_TABLES and len(df.inputFiles()) < spark.sparkContext.defaultParallelism
        _READY[key] = _stored(df, name) if name in SHARED or few else df
    return _READY[key]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return _ready(spark, sf, name, lambda: spark.read.parquet(f"{sf}/{name}.parquet"))


def fixture(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return _ready(spark, sf, name, lambda: _derived(spark, sf, name))


LINES = 400_000  # line items that one task holds at most, whatever the input's size


def _parts(spark: SparkSession, sf: str) -> int:
    return max(spark.sparkContext.defaultParallelism, -(-table(spark, sf, "lineitem").count() // LINES))


def _item_sponsors(spark: SparkSession, sf: str) -> DataFrame:
    """``item_sponsors`` of ``FIXTURES``: lines and orders are dealt by item into parts of a bounded size, joined and made distinct there."""
    parts = _parts(spark, sf)
    named = (table(spark, sf, "lineitem").join(table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
             .select(F.col("l_orderkey").alias("id"), F.col("s_name").alias("sponsor")).repartition(parts, "id"))
    days = table(spark, sf, "orders").selectExpr("o_orderkey AS id", "CAST(CAST(o_orderdate AS DATE) AS STRING) AS date").repartition(parts, "id")
    return named.join(days, "id").select("id", "date", "sponsor").distinct()


def _first_and_last_name(spark: SparkSession, sf: str) -> DataFrame:
    """``fx_sp`` of ``FIXTURES``, dealt the same way, as least and greatest strings are found by sorting."""
    return (table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
            .select(F.col("l_orderkey").alias("k"), F.upper("p_name").alias("nm")).repartition(_parts(spark, sf), "k")
            .groupBy("k").agg(F.min("nm").alias("s1"), F.max("nm").alias("s2")))


# Inputs whose Spark plan deals its rows out by size; the check keeps to the SQL.
DEALT = {"item_sponsors": _item_sponsors, "fx_sp": _first_and_last_name}


def _derived(spark: SparkSession, sf: str, name: str) -> DataFrame:
    if name in DEALT:
        return DEALT[name](spark, sf)
    pool = {k: f"SELECT * FROM {{dealt_{k}}}" if k in DEALT else v for k, v in FIXTURES.items() if k != name}
    names = _with(FIXTURES[name], pool)
    head = ",\n".join(f"{n} AS ({pool[n]})" for n in names)
    sql = f"WITH {head}\n{FIXTURES[name]}" if head else FIXTURES[name]
    used = {t: table(spark, sf, t) for t in TABLES if "{" + t + "}" in sql}
    return spark.sql(sql, **used, **{f"dealt_{n}": DEALT[n](spark, sf) for n in names if n in DEALT})
