"""Bindings of the column functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from minutebook.functions import dates, display, donations, legislation as leg, money, news
from minutebook.functions import settlements, sponsors as sp, text as tx, toc
from minutebook.functions.claims import claim_type, is_claim
from minutebook.operators import joins, reports
from minutebook.plans.fixtures import fixture, lit, sql_first, table
from minutebook.plans.registry import query

WS = r"[\s\x0b\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def sql_strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def sql_squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, '{WS}+', ' ', 'g'))"


def sql_translate(x: str, pair) -> str:
    return f"translate({x}, {lit(pair[0])}, {lit(pair[1])})"


def sql_title(x: str) -> str:
    return (f"array_to_string(list_transform(regexp_extract_all(lower({x}), '\\p{{L}}+|\\P{{L}}+'), "
            f"lambda w: upper(w[1]) || w[2:]), '')")


def sql_money(figure: str) -> str:
    return f"TRY_CAST(replace({figure}, ',', '') AS DECIMAL(18,2))"


def items(spark, sf):
    """Items with their type and final action, as the extraction steps leave them."""
    acted = leg.extract_final_action(fixture(spark, sf, "legis_items"))
    return (leg.with_legislation_type(acted)
            .withColumnRenamed("action", "finalAction"))


FOLD1 = sql_translate("lower(text)", tx.SEARCH_FOLD)


@query("t1_fold_quotes_lower", f"SELECT doc_id, md5({FOLD1}) AS folded FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", F.md5(tx.fold_quotes_lower(F.col("text"))).alias("folded"))


NEEDLE = sql_strip(sql_translate("lower(concat(' “', text, '” '))", tx.SEARCH_FOLD))


@query("t2_simple_needle", f"""
SELECT conv_id, turn, role,
       CASE WHEN starts_with(q, '"') AND ends_with(q, '"') AND length(q) > 2
            THEN {sql_strip('substr(q, 2, length(q) - 2)')} ELSE q END AS needle
FROM (SELECT *, {NEEDLE} AS q FROM conversations)""")
def _(spark, sf):
    q = F.concat(F.lit(" “"), F.col("text"), F.lit("” "))
    return table(spark, sf, "conversations").select("conv_id", "turn", "role", tx.simple_needle(q).alias("needle"))


@query("t3_fts_query_text", f"""
SELECT conv_id, turn, role, {sql_translate('text', tx.INDEX_FOLD)} AS q FROM conversations""")
def _(spark, sf):
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", "role", tx.fts_query_text(F.col("text")).alias("q"))


NORM = sql_squeeze(sql_translate("text", tx.FULL_FOLD))


@query("t4_normalize_text", f"SELECT doc_id, md5({NORM}) AS norm, length({NORM}) AS n FROM docs_variants")
def _(spark, sf):
    n = tx.normalize_text(F.col("text"))
    return fixture(spark, sf, "docs_variants").select("doc_id", F.md5(n).alias("norm"), F.length(n).cast("long").alias("n"))


@query("t5_normalize_all_strings", f"SELECT doc_id, md5({NORM}) AS text, lang, source FROM docs_variants")
def _(spark, sf):
    return tx.normalize_all_strings(fixture(spark, sf, "docs_variants")).withColumn("text", F.md5("text"))


@query("t6_normalize_quotes_whitespace", f"""
SELECT doc_id, md5({sql_translate('text', tx.QUOTE_FOLD)}) AS quotes, md5({sql_squeeze('text')}) AS spaces
FROM docs_variants""")
def _(spark, sf):
    t = F.col("text")
    return fixture(spark, sf, "docs_variants").select(
        "doc_id", F.md5(tx.normalize_quotes(t)).alias("quotes"), F.md5(tx.normalize_whitespace(t)).alias("spaces"))


@query("t7_trim_fields", f"""
SELECT id, date, {sql_strip('number')} AS number, {sql_strip('description')} AS description,
       CAST(number <> {sql_strip('number')} AS INT) + CAST(description <> {sql_strip('description')} AS INT) AS trimmed_fields
FROM legis_items""")
def _(spark, sf):
    return tx.trim_fields(fixture(spark, sf, "legis_items"), ["number", "description"])


@query("t8_legislation_type", "SELECT id, type_code, type_name FROM typed")
def _(spark, sf):
    return leg.with_legislation_type(fixture(spark, sf, "legis_items")).select(
        "id", F.col("legislationType").alias("type_code"), F.col("legislationTypeName").alias("type_name"))


@query("t9_legislation_type_strict", f"SELECT id, {sql_first(leg.STRICT_TYPE, 1, 'trim(number)')} AS type_code FROM legis_items")
def _(spark, sf):
    return fixture(spark, sf, "legis_items").select("id", leg.legislation_type_strict(F.col("number")).alias("type_code"))


FILES = "https://files.example.org/finalactions/"


@query("t10_number_to_url", f"""
SELECT id, concat('{FILES}', lower(replace(number, '-', '')), '.pdf') AS url FROM legis_items""")
def _(spark, sf):
    return fixture(spark, sf, "legis_items").select("id", leg.number_to_url(F.col("number"), FILES).alias("url"))


@query("t11_pdf_stem", "SELECT id, lower(replace(number, '-', '')) AS stem FROM legis_items")
def _(spark, sf):
    url = F.concat(leg.number_to_url(F.col("number"), FILES), F.lit("?v=1#page=2"))
    return fixture(spark, sf, "legis_items").select("id", leg.pdf_stem(url).alias("stem"))


@query("t12_is_charter_amendment", f"""
SELECT id, contains(upper(description), {lit(leg.CHARTER_PHRASE)}) AS flag FROM legis_items""")
def _(spark, sf):
    return fixture(spark, sf, "legis_items").select("id", leg.is_charter_amendment(F.col("description")).alias("flag"))


@query("t13_extract_final_action", "SELECT id, cleaned, action, needs_review FROM acted")
def _(spark, sf):
    return leg.extract_final_action(fixture(spark, sf, "legis_items")).select("id", "cleaned", "action", "needs_review")


ENDINGS = leg.ADVERSED_ENDINGS + leg.TERMINATION_ENDINGS
HIT = "CASE " + " ".join(f"WHEN ends_with(description, {lit(s)}) THEN {lit(s)}" for s in ENDINGS) + " END"


@query("t14_move_suffix", f"""
SELECT id, CASE WHEN hit IS NULL THEN description
                ELSE trim(substr(description, 1, length(description) - length(hit))) END AS description,
       hit AS "finalAction"
FROM (SELECT *, {HIT} AS hit FROM legis_items)""")
def _(spark, sf):
    return leg.move_suffix(fixture(spark, sf, "legis_items"), ENDINGS).select("id", "description", "finalAction")


@query("t15_final_action_category", "SELECT id, category FROM items")
def _(spark, sf):
    return items(spark, sf).select("id", leg.final_action_category(F.col("finalAction")).alias("category"))


# --- sponsors ---------------------------------------------------------------

def sql_name_part(p: str) -> str:
    bare = f"regexp_replace({p}, '[.,]+$', '')"
    suffixes = ", ".join(lit(s) for s in sp.NAME_SUFFIXES)

    def cap(x):
        return f"(upper({x}[1]) || lower({x}[2:]))"
    return (f"CASE WHEN upper({bare}) IN ({suffixes}) THEN upper({bare}) || substr({p}, length({bare}) + 1) "
            f"WHEN length({bare}) <= 2 AND regexp_matches({bare}, '^\\p{{Lu}}') THEN {p} "
            f"WHEN contains({p}, '-') THEN array_to_string(list_transform(string_split({p}, '-'), lambda h: {cap('h')}), '-') "
            f"ELSE {cap(p)} END")


def sql_name_case(n: str) -> str:
    return (f"array_to_string(list_transform(string_split({sql_squeeze(n)}, ' '), "
            f"lambda p: {sql_name_part('p')}), ' ')")


def sql_split_names(t: str) -> str:
    stop = r"\b(?:" + tx.any_of(sp.NOT_NAMES) + r")\b"
    plain = f"regexp_replace({sql_squeeze(t)}, '[,;]+$', '')"
    parts = f"list_transform(regexp_split_to_array({plain}, '(?i)\\s+AND\\s+|,'), lambda x: trim(x))"
    keep = (f"list_filter({parts}, lambda x: length(x) >= 3 AND NOT regexp_matches(upper(x), {lit(stop)}) "
            f"AND (contains(x, ' ') OR regexp_matches(x, '[A-Z]\\.\\s*[A-Z]\\.')))")
    return f"list_transform({keep}, lambda x: {sql_name_case('x')})"


SURE = (f"COALESCE({sql_first('(?i)' + sp.SPONSOR_MAIN)}, {sql_first('(?i)' + sp.SPONSOR_INTRODUCED)})")
OPENED = (f"CASE WHEN regexp_matches(upper(trim(description)), '^(?:{'|'.join(sp.OPENINGS)})') "
          f"THEN {sql_first('(?i)' + sp.SPONSOR_OPENING)} END")
SPONSORED = f"""
SELECT *, CASE WHEN len(names) = 0 OR names IS NULL THEN NULL WHEN sure IS NOT NULL THEN 'high' ELSE 'medium' END AS confidence
FROM (SELECT *, {sql_split_names("COALESCE(sure, opened)")} AS names
      FROM (SELECT *, {SURE} AS sure, {OPENED} AS opened FROM legis_items))"""


@query("t16_extract_sponsors", f"""
SELECT id, CASE WHEN confidence IS NOT NULL THEN array_to_string(names, '|') END AS sponsors, confidence
FROM ({SPONSORED})""")
def _(spark, sf):
    return sp.extract_sponsors(fixture(spark, sf, "legis_items")).select(
        "id", F.array_join("sponsors", "|").alias("sponsors"), F.col("sponsorConfidence").alias("confidence"))


NAMES_SQL = "concat(s1, ', ', s2, ', JR. AND J. R. ', seg, ' and Antonio ', committee, ';')"


@query("t17_split_names", f"""
SELECT id, array_to_string({sql_split_names('names')}, '|') AS names
FROM (SELECT id, {NAMES_SQL} AS names FROM fx_base)""")
def _(spark, sf):
    df = fixture(spark, sf, "fx_base").selectExpr("id", f"{NAMES_SQL} AS names")
    return df.select("id", F.array_join(sp.split_names(F.col("names")), "|").alias("names"))


@query("t18_name_case", f"""
SELECT p_partkey, {sql_name_case("concat(upper(p_name), ' J. o''neil-SMITH, jr.')")} AS name FROM part""")
def _(spark, sf):
    name = F.concat(F.upper("p_name"), F.lit(" J. o'neil-SMITH, jr."))
    return table(spark, sf, "part").select("p_partkey", sp.name_case(name).alias("name"))


COMMITTEE_RAW = sql_squeeze(sql_first("(?i)" + sp.COMMITTEE_OPENING))
KNOWN_SQL = "SELECT concat(r_name, ' Committee') AS name FROM region WHERE r_name <> 'ASIA'"


def known(spark, sf):
    return (table(spark, sf, "region").where("r_name <> 'ASIA'")
            .select(F.concat("r_name", F.lit(" Committee")).alias("name")))


COMMITTEED = f"""
SELECT i.id, i.date, COALESCE(k.name, raw) AS committee, k.name IS NOT NULL AS committee_known
FROM (SELECT *, {COMMITTEE_RAW} AS raw FROM legis_items) i LEFT JOIN ({KNOWN_SQL}) k ON upper(k.name) = upper(i.raw)"""


@query("t19_extract_committee", f"SELECT id, committee, committee_known FROM ({COMMITTEED})")
def _(spark, sf):
    return sp.extract_committee(fixture(spark, sf, "legis_items"), known(spark, sf)) \
        .select("id", "committee", "committee_known")


@query("t20_add_committee_sponsor", f"""
SELECT c.id, CASE WHEN committee IS NULL THEN array_to_string(s.names, '|')
       ELSE array_to_string(list_append(COALESCE(s.names, []), committee), '|') END AS sponsors,
       CASE WHEN committee IS NULL THEN s.confidence ELSE 'auto-committee' END AS confidence
FROM ({COMMITTEED}) c JOIN (SELECT id, confidence, CASE WHEN confidence IS NOT NULL THEN names END AS names FROM ({SPONSORED})) s ON s.id = c.id""")
def _(spark, sf):
    df = sp.extract_sponsors(fixture(spark, sf, "legis_items"))
    df = sp.add_committee_sponsor(sp.extract_committee(df, known(spark, sf)))
    return df.select("id", F.array_join("sponsors", "|").alias("sponsors"),
                     F.col("sponsorConfidence").alias("confidence"))


@query("t21_drop_invalid_sponsors", """
SELECT id, concat_ws('|', s1, committee) AS valid,
       concat_ws('|', s1, concat(seg, ' (as Amended)'), committee) AS shown
FROM fx_base""")
def _(spark, sf):
    names = F.array(F.col("s1"), F.concat("s2", F.lit(" As Substituted By "), "committee"),
                    F.concat("seg", F.lit(" (as Amended)")), F.col("committee"))
    return fixture(spark, sf, "fx_base").select(
        "id", F.array_join(sp.drop_invalid_sponsors(names), "|").alias("valid"),
        F.array_join(sp.drop_invalid_sponsors(names, shown=True), "|").alias("shown"))


def sponsor_arrays(spark, sf):
    """One row per item with its sorted sponsors."""
    return (fixture(spark, sf, "item_sponsors").groupBy("id", "date")
            .agg(F.sort_array(F.collect_list("sponsor")).alias("sponsors")))


@query("t22_co_sponsors", """
SELECT a.id, a.sponsor, COALESCE(string_agg(b.sponsor, '|' ORDER BY b.sponsor), '') AS others
FROM item_sponsors a LEFT JOIN item_sponsors b ON a.id = b.id AND a.sponsor <> b.sponsor
GROUP BY a.id, a.sponsor""")
def _(spark, sf):
    df = sponsor_arrays(spark, sf).select("id", "sponsors", F.explode("sponsors").alias("sponsor"))
    return df.select("id", "sponsor",
                     F.array_join(sp.co_sponsors(F.col("sponsors"), F.col("sponsor")), "|").alias("others"))


CLAIM = "starts_with(lower(trim(description)), 'for') AND contains(lower(description), 'claim')"


def sql_claim_type(a: str) -> str:
    return (f"CASE WHEN COALESCE({a}, '') IN ('', 'MISSING') THEN NULL WHEN contains(upper({a}), 'ADVERS') THEN 'adversed' "
            f"WHEN regexp_matches(upper({a}), 'SETTLEMENT|SETTLED|ADOPT|ACCEPT|CONFIRM') THEN 'settlement' END")


@query("t23_claim_type", f"""
SELECT id, {CLAIM} AS claim, {sql_claim_type('"finalAction"')} AS claim_type FROM items""")
def _(spark, sf):
    return items(spark, sf).select("id", is_claim(F.col("description")).alias("claim"),
                                   claim_type(F.col("finalAction")).alias("claim_type"))


# --- donations --------------------------------------------------------------

def sql_rlike(patterns, c="description"):
    return f"regexp_matches({c}, {lit('(?i)' + tx.any_of(patterns))})"


def sql_direction(compat=False):
    accept = [p.replace(r"DONAT\w*\b", r"DONAT\b") for p in donations.ACCEPT] if compat else donations.ACCEPT
    a, m = sql_rlike(accept), sql_rlike(donations.MADE)
    return (f"CASE WHEN NOT contains(lower(description), 'donat') OR {sql_rlike(donations.SKIP)} THEN NULL "
            f"WHEN {a} AND {m} THEN CASE WHEN {sql_rlike([donations.MADE_WINS])} THEN 'made' ELSE 'accepted' END "
            f"WHEN {a} THEN 'accepted' WHEN {m} THEN 'made' END")


@query("t24_donation_direction", f"""
SELECT id, {sql_direction()} AS direction, {sql_direction(True)} AS direction_compat FROM legis_items""")
def _(spark, sf):
    d = F.col("description")
    return fixture(spark, sf, "legis_items").select(
        "id", donations.donation_direction(d).alias("direction"),
        donations.donation_direction(d, compat=True).alias("direction_compat"))


def sql_amount(c="description"):
    cap, stated, first = (sql_first(p, 1, c) for p in (money.NOT_TO_EXCEED, money.STATED, money.DOLLAR_SIGN))
    return f"NULLIF({sql_money(f'COALESCE({cap}, {stated}, {first})')}, 0)"


@query("t25_dollar_amount", f"""
SELECT id, CAST({sql_amount()} AS DOUBLE) AS amount,
       CAST({sql_money(sql_first(money.DOLLAR_SIGN))} AS DOUBLE) AS first_amount FROM legis_items""")
def _(spark, sf):
    d = F.col("description")
    return fixture(spark, sf, "legis_items").select(
        "id", money.dollar_amount(d).cast("double").alias("amount"),
        money.first_dollar_amount(d).cast("double").alias("first_amount"))


def sql_party(raw):
    return f"regexp_replace(regexp_replace(trim({raw}), '[,. ]+$', ''), '(?i){donations.ARTICLE}', '')"


def sql_i(pattern, group=1):
    return sql_first("(?i)" + pattern, group)


DONOR_NAME = sql_party(f"COALESCE({', '.join(sql_i(p) for p in donations.DONOR)})")
DONOR_SQL = f"CASE WHEN length({DONOR_NAME}) > 2 THEN {sql_title(DONOR_NAME)} END"
RECIPIENT_NAME = sql_party(sql_i(donations.RECIPIENT))
RECIPIENT_SQL = (f"CASE WHEN length({RECIPIENT_NAME}) >= 3 AND upper({RECIPIENT_NAME}) NOT IN "
                 f"({', '.join(lit(x) for x in donations.NOT_RECIPIENTS)}) THEN {sql_title(RECIPIENT_NAME)} END")
PURPOSE_SQL = sql_title(
    f"regexp_replace(trim(COALESCE({', '.join(sql_i(p) for p in donations.PURPOSE)})), '[;,. ]+$', '')")
ITEM_RAW = f"COALESCE(regexp_replace(trim({sql_i(donations.ITEM_OF)}), '[;,. ]+$', ''), trim({sql_i(donations.ITEM_DONATE)}))"
ITEM_SQL = (f"CASE WHEN NOT regexp_matches({ITEM_RAW}, {lit('(?i)' + donations.MONEY_ITEM)}) "
            f"AND length({ITEM_RAW}) > 2 THEN {sql_title(ITEM_RAW)} END")
KIND_SQL = (f"CASE WHEN COALESCE({ITEM_SQL}, '') <> '' OR {sql_rlike([donations.IN_KIND])} "
            f"THEN 'in_kind' ELSE 'monetary' END")


@query("t26_donation_fields", f"""
SELECT id, {DONOR_SQL} AS donor, {RECIPIENT_SQL} AS recipient, {PURPOSE_SQL} AS purpose,
       {ITEM_SQL} AS item_donated, {KIND_SQL} AS donation_type FROM legis_items""")
def _(spark, sf):
    d = F.col("description")
    df = fixture(spark, sf, "legis_items").withColumn("item_donated", donations.item_donated(d))
    return df.select("id", donations.donor(d).alias("donor"), donations.recipient(d).alias("recipient"),
                     donations.purpose(d).alias("purpose"), "item_donated",
                     donations.donation_type(d, F.col("item_donated")).alias("donation_type"))


DONATIONS_SQL = f"""
SELECT id, CAST(NULL AS BIGINT) AS meeting_doc_id, number, date AS legislation_date, type_name AS legislation_type,
       direction AS donation_direction, {KIND_SQL} AS donation_type, {sql_amount()} AS amount,
       CASE WHEN direction = 'accepted' THEN {DONOR_SQL} END AS donor,
       CASE WHEN direction = 'made' THEN {RECIPIENT_SQL} END AS recipient,
       {ITEM_SQL} AS item_donated, {PURPOSE_SQL} AS purpose, COALESCE("finalAction", '') AS final_action,
       '' AS sponsors, CAST(NULL AS VARCHAR) AS pdf_url, description
FROM (SELECT *, {sql_direction()} AS direction FROM items) WHERE direction IS NOT NULL"""


def donation_rows(spark, sf):
    return reports.parse_donations(items(spark, sf))


@query("t27_parse_donations", f"SELECT * REPLACE (CAST(amount AS DOUBLE) AS amount) FROM ({DONATIONS_SQL})")
def _(spark, sf):
    return donation_rows(spark, sf).withColumn("amount", F.col("amount").cast("double"))


# --- settlements ------------------------------------------------------------

LOC_RAW = f"trim({sql_i(settlements.LOCATION)})"
DATE_RAW = f"trim({sql_i(settlements.INCIDENT_DATE)})"
INDIVIDUAL_SQL = f"""
SELECT id, date, number, description,
       {sql_title(f"trim({sql_i(settlements.DAMAGE)})")} AS damage_type,
       {sql_title(f"trim({sql_i(settlements.INCIDENT)})")} AS incident_type,
       COALESCE(CAST(CAST(COALESCE(try_strptime({DATE_RAW}, '%B %d, %Y'), try_strptime({DATE_RAW}, '%m/%d/%Y')) AS DATE) AS VARCHAR), {DATE_RAW}) AS incident_date,
       CASE WHEN upper({LOC_RAW}) = 'AN UNKNOWN LOCATION' THEN 'Unknown' ELSE {sql_title(LOC_RAW)} END AS incident_location,
       COALESCE(trim({sql_first(settlements.DEPARTMENT_AMOUNT)}), trim({sql_first(settlements.DEPARTMENT)})) AS department_code,
       {sql_money(sql_first(settlements.DEPARTMENT_AMOUNT, 2))} AS amount,
       {sql_first(settlements.CLAIM_NUMBER)} AS claim_number,
       {sql_title('parts[1]')} AS claimant_name,
       CASE WHEN len(parts) > 1 THEN {sql_title("array_to_string(parts[2:], ', ')")} END AS claimant_address
FROM (SELECT *, list_filter(list_transform(regexp_split_to_array(trim({sql_first('(?is)' + settlements.CLAIM_OF)}), '[;,]'), lambda x: trim(x)), lambda x: x <> '') AS parts FROM {{source}})"""
IND_COLS = ["damage_type", "incident_type", "incident_date", "incident_location", "department_code",
            "amount", "claim_number", "claimant_name", "claimant_address"]


@query("t28_parse_individual_claims", f"""
SELECT id, {', '.join('CAST(amount AS DOUBLE) AS amount' if c == 'amount' else c for c in IND_COLS)}
FROM ({INDIVIDUAL_SQL.replace('{source}', 'legis_items')})""")
def _(spark, sf):
    parsed = settlements.individual_claim(F.col("description"))
    return fixture(spark, sf, "legis_items").select("id", *[
        (c.cast("double") if k == "amount" else c).alias(k) for k, c in parsed.items()])


PLAINTIFF_SQL = sql_title(f"trim({sql_i(settlements.PLAINTIFF)})")
COURT_SQL = f"""
SELECT id, date, number, description, {PLAINTIFF_SQL} AS plaintiff,
       {PLAINTIFF_SQL} || {lit(settlements.CASE_TITLE)} AS case_name,
       {sql_i(settlements.CASE_NUMBER)} AS case_number,
       {sql_title(f"trim({sql_i(settlements.COURT)})")} AS court,
       {sql_money(f"COALESCE({sql_first(settlements.TOTAL_AMOUNT)}, {sql_first(money.DOLLAR_SIGN)})")} AS amount
FROM {{source}}"""


@query("t29_parse_court_settlements", f"""
SELECT id, plaintiff, case_name, case_number, court, CAST(amount AS DOUBLE) AS amount
FROM ({COURT_SQL.replace('{source}', 'legis_items')})""")
def _(spark, sf):
    parsed = settlements.court_settlement(F.col("description"))
    return fixture(spark, sf, "legis_items").select("id", *[
        (c.cast("double") if k == "amount" else c).alias(k) for k, c in parsed.items()])


# The templates close no claim with an action, so one is put in by record type.
CLAIM_ACTION = "CASE WHEN number LIKE '%-C-%' THEN 'ADOPTED ON CONSENT' ELSE 'ADVERSED' END"
TAGGED_SQL = f"""SELECT id, date, number, description, type_name, claim_action AS act,
  CASE WHEN {CLAIM} THEN {sql_claim_type('claim_action')} END AS ct
FROM (SELECT *, {CLAIM_ACTION} AS claim_action FROM items)"""
SETTLEMENTS_SQL = f"""
SELECT id, number, date AS legislation_date, description, 'individual_claim' AS settlement_category, 'settlement' AS claim_type_raw,
       {', '.join(IND_COLS)}, NULL AS plaintiff, NULL AS case_name, NULL AS case_number, NULL AS court
FROM ({INDIVIDUAL_SQL.replace('{source}', f"({TAGGED_SQL}) WHERE ct = 'settlement'")})
UNION ALL
SELECT id, number, date, description, 'court_litigation', '', NULL, NULL, NULL, NULL, NULL, amount, NULL, NULL, NULL,
       plaintiff, case_name, case_number, court
FROM ({COURT_SQL.replace('{source}', f"({TAGGED_SQL}) WHERE ct IS NULL AND contains(upper(description), 'SETTLEMENT AMOUNT')")})"""


def settlement_rows(spark, sf):
    acted = items(spark, sf).withColumn("finalAction", F.expr(CLAIM_ACTION))
    return reports.parse_settlements(reports.tag_claims(acted))


@query("t30_parse_settlements", f"SELECT * REPLACE (CAST(amount AS DOUBLE) AS amount) FROM ({SETTLEMENTS_SQL})")
def _(spark, sf):
    return settlement_rows(spark, sf).withColumn("amount", F.col("amount").cast("double")) \
        .drop("legislation_type", "final_action", "sponsors", "pdf_url")


# --- display, dates, papers, news -------------------------------------------

def sql_display(c: str, key: str, source: str) -> str:
    """Word rows instead of neighbourhoods: the same rule, reached another way."""
    def inlist(words):
        return "(" + ", ".join(lit(w) for w in words) + ")"
    base = r"lower(regexp_replace(w, '(?i)^[^a-z]+|[^a-z]+$', '', 'g'))"
    short = f"(base IN {inlist(display.HONORIFICS + display.SUFFIX_WORDS)} OR length(base) = 1)"
    cap = "(upper(w[1]) || w[2:])"
    return f"""
WITH src AS (SELECT {key} AS k, {c} AS t FROM {source}),
words AS (SELECT k, t, unnest(regexp_split_to_array(lower(t), '\\s+')) AS w,
                 unnest(range(len(regexp_split_to_array(lower(t), '\\s+')))) AS i FROM src),
based AS (SELECT *, {base} AS base FROM words),
flagged AS (SELECT *, regexp_matches(w, '[.?!]$') AND NOT {short} AS ends,
                   base IN {inlist(display.HONORIFICS)} AS hon FROM based),
runs AS (SELECT *, COALESCE(lag(ends) OVER (PARTITION BY k ORDER BY i), true) AS opens,
                COALESCE(sum(CAST(ends AS INT)) OVER (PARTITION BY k ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s
         FROM flagged),
named AS (SELECT *, COALESCE(max(CASE WHEN hon THEN i END) OVER (PARTITION BY k, s ORDER BY i ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) IS NOT NULL, false) AS nm FROM runs),
shown AS (SELECT k, string_agg(CASE WHEN base IN {inlist(display.UPPER_WORDS)} THEN upper(w)
                 WHEN base IN {inlist(display.HONORIFICS + display.SUFFIX_WORDS)} THEN {cap}
                 WHEN length(base) = 1 THEN upper(w) WHEN nm OR opens THEN {cap} ELSE w END, ' ' ORDER BY i) AS d
          FROM named GROUP BY k)
SELECT src.k AS id, CASE WHEN length(regexp_replace(t, '[^a-zA-Z]', '', 'g')) > 0
  AND length(regexp_replace(t, '[^A-Z]', '', 'g')) >= 0.6 * length(regexp_replace(t, '[^a-zA-Z]', '', 'g'))
  THEN d ELSE t END AS shown FROM src LEFT JOIN shown ON shown.k = src.k"""


NAMED_DESC = "concat('MR. ', s1, ' AND DR. J. ', s2, ' JR. OF ', seg, ', INC. MET. ', committee, ' WON! THE HON. ', s1, ' LEFT.')"


@query("t31_display_case", sql_display(NAMED_DESC, "id", "fx_base"))
def _(spark, sf):
    df = fixture(spark, sf, "fx_base").selectExpr("id", f"{NAMED_DESC} AS t")
    return df.select("id", display.display_case(F.col("t")).alias("shown"))


@query("t32_expand_dates", """
SELECT id, concat(substr(date, 1, 4), '-01-01') AS year_from, concat(substr(date, 1, 4), '-12-31') AS year_to,
       concat(substr(date, 1, 7), '-01') AS month_from,
       CAST(last_day(CAST(date AS DATE)) AS VARCHAR) AS month_to, date AS day_from, date AS day_to
FROM legis_items""")
def _(spark, sf):
    y, m, d = F.substring("date", 1, 4), F.concat(F.lit(" "), F.substring("date", 1, 7)), F.col("date")
    return fixture(spark, sf, "legis_items").select(
        "id", dates.expand_date_from(y).alias("year_from"), dates.expand_date_to(y).alias("year_to"),
        dates.expand_date_from(m).alias("month_from"), dates.expand_date_to(m).alias("month_to"),
        dates.expand_date_from(d).alias("day_from"), dates.expand_date_to(d).alias("day_to"))


PAPER_SQL = """
SELECT i.id, CASE WHEN f.id IS NULL THEN NULL WHEN c = 1 AND m = 0 THEN 'Committee Paper' WHEN m = 1 AND c = 0 THEN 'Personal Paper'
       WHEN m = 1 AND c = 1 THEN 'Mixed' ELSE 'Unknown' END AS paper_type
FROM legis_items i LEFT JOIN (
  SELECT s.id, max(CAST(s.sponsor IN (SELECT name FROM committees) AS INT)) AS c,
         max(CAST(s.sponsor IN (SELECT name FROM roster_terms) AS INT)) AS m
  FROM item_sponsors s GROUP BY s.id) f ON f.id = i.id"""


def papers(spark, sf):
    return joins.with_paper_type(
        fixture(spark, sf, "legis_items"), fixture(spark, sf, "item_sponsors").select("id", "sponsor"),
        fixture(spark, sf, "committees"), fixture(spark, sf, "roster_terms"))


@query("t33_paper_type", PAPER_SQL)
def _(spark, sf):
    return papers(spark, sf).select("id", F.col("paperType").alias("paper_type"))


def releases(spark, sf):
    """Documents framed like a news release."""
    body = F.translate(F.col("text"), "\n", " ")
    return table(spark, sf, "documents").select("doc_id", F.concat(
        F.lit("FOR IMMEDIATE RELEASE\nCity Hall\nJanuary 5, 2024\nATLANTA — "), body,
        F.lit("\n\n\n\nSaid today.\nTo learn more about the Atlanta City Council call us.\nContacts:\nA\n###\nB")).alias("content"))


CLEAN_SQL = sql_strip("concat('ATLANTA — ', translate(text, chr(10), ' '), chr(10), chr(10), 'Said today.')")


@query("t34_strip_boilerplate", f"SELECT doc_id, md5({CLEAN_SQL}) AS clean FROM documents")
def _(spark, sf):
    return releases(spark, sf).select("doc_id", F.md5(news.strip_boilerplate(F.col("content"))).alias("clean"))


@query("t35_preview", f"""
SELECT doc_id, CASE WHEN length(c) <= 300 THEN c
   WHEN p > 180 THEN substr(h, 1, p + 1) WHEN w > 0 THEN concat(substr(h, 1, w), '...') ELSE concat(h, '...') END AS preview
FROM (SELECT *, CASE WHEN contains(h, '. ') THEN length(h) - instr(reverse(h), ' .') - 1 ELSE -1 END AS p,
             CASE WHEN contains(h, ' ') THEN length(h) - instr(reverse(h), ' ') ELSE -1 END AS w
      FROM (SELECT doc_id, c, substr(c, 1, 300) AS h FROM (SELECT doc_id, {CLEAN_SQL} AS c FROM documents)))""")
def _(spark, sf):
    return releases(spark, sf).select("doc_id", news.preview(F.col("content")).alias("preview"))


TAGGED_HTML = ("CASE WHEN page_id % 4 = 0 THEN concat(html, '<img src=\"a.png\" alt=\"News Release\">') "
               "WHEN page_id % 4 = 1 THEN concat('<IMG class=x alt=\"The Media Advisory\">', html) "
               "WHEN page_id % 4 = 2 THEN concat(html, '<p>a Media Advisory</p>') ELSE html END")


@query("t36_news_type", """
SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'News Release' WHEN page_id % 4 IN (1, 2) THEN 'Media Advisory' ELSE 'Unknown' END AS type
FROM pages""")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", news.news_type(F.expr(TAGGED_HTML)).alias("type"))


@query("t37_truncate", """
SELECT id, CASE WHEN length(description) > 60 THEN concat(substr(description, 1, 60), '...') ELSE description END AS short
FROM legis_items""")
def _(spark, sf):
    return fixture(spark, sf, "legis_items").select("id", tx.truncate(F.col("description"), 60).alias("short"))


@query("t38_meeting_date_in_text", "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS meeting_date FROM orders")
def _(spark, sf):
    said = F.upper(F.date_format("o_orderdate", "MMMM d, yyyy"))
    text = F.concat(F.lit("FULL COUNCIL\nMEETING OF "), said, F.lit(" AT CITY HALL, NOT APRIL 1, 1999"))
    return table(spark, sf, "orders").select("o_orderkey", dates.meeting_date_in_text(text).alias("meeting_date"))


@query("t39_office_rank", """
SELECT name, office, CASE WHEN office = 'President' THEN 2 ELSE 0 END AS office_group,
       CASE WHEN office = 'President' THEN 0 ELSE CAST(substr(office, 10) AS INT) END AS seat,
       CASE WHEN office = 'President' THEN 'President' ELSE 'Districts' END AS section,
       CASE WHEN end_date IS NULL THEN concat(substr(start_date, 1, 4), '–present')
            WHEN substr(start_date, 1, 4) = substr(end_date, 1, 4) THEN substr(start_date, 1, 4)
            ELSE concat(substr(start_date, 1, 4), '–', substr(end_date, 1, 4)) END AS label
FROM roster_terms""")
def _(spark, sf):
    o = F.col("office")
    return fixture(spark, sf, "roster_terms").select(
        "name", "office", dates.office_rank(o)["group"].alias("office_group"), dates.office_rank(o)["seat"].alias("seat"),
        dates.office_section(o).alias("section"), dates.term_label(F.col("start_date"), F.col("end_date")).alias("label"))


@query("t40_vote_outcome", """
SELECT id, CASE WHEN COALESCE("finalAction", '') = '' THEN NULL
  WHEN contains("finalAction", 'FILED') OR contains("finalAction", 'ADOPTED') THEN 'passed' ELSE 'referred' END AS outcome
FROM items""")
def _(spark, sf):
    return items(spark, sf).select("id", leg.vote_outcome(F.col("finalAction")).alias("outcome"))


def sql_difference(a: str, b: str) -> str:
    return (f"CASE WHEN {a} IS NOT DISTINCT FROM {b} THEN 'identical' WHEN {a} IS NULL OR {b} IS NULL THEN 'type_difference' "
            f"WHEN {sql_translate(a, tx.QUOTE_FOLD)} = {sql_translate(b, tx.QUOTE_FOLD)} THEN 'quote_difference' "
            f"WHEN {sql_squeeze(a)} = {sql_squeeze(b)} THEN 'whitespace_difference' "
            f"WHEN lower({a}) = lower({b}) THEN 'case_difference' "
            f"WHEN contains({a}, {b}) OR contains({b}, {a}) THEN 'substring_difference' ELSE 'text_difference' END")


@query("t41_pair_difference", f"""
SELECT v.doc_id, {sql_difference('d.text', 'v.text')} AS difference,
       {sql_difference('d.text', "upper(d.text)")} AS cased
FROM docs_variants v JOIN documents d ON d.doc_id = v.doc_id % 1000000""")
def _(spark, sf):
    v = fixture(spark, sf, "docs_variants").withColumn("_d", F.pmod("doc_id", F.lit(1000000)))
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("_d"), F.col("text").alias("original"))
    a, b = F.col("original"), F.col("text")
    return v.join(d, "_d").select("doc_id", tx.pair_difference(a, b).alias("difference"),
                                  tx.pair_difference(a, F.upper(a)).alias("cased"))


def toc_texts(spark, sf):
    """Contents pages: one record of two or three lines per line item."""
    line = F.concat(
        F.col("l_linenumber").cast("string"), F.lit(" "), F.lpad(F.pmod("l_partkey", F.lit(100000)).cast("string"), 5, "0"),
        F.lit("  26-R-"), F.lpad(F.pmod("l_suppkey", F.lit(1000)).cast("string"), 3, "0"), F.lit(" 0 Smith\n  A study of "),
        F.col("l_returnflag"), F.lit(" parks \n\nResolution  Finance\n"))
    return (table(spark, sf, "lineitem").groupBy("l_orderkey")
            .agg(F.array_sort(F.collect_list(F.struct("l_linenumber", line.alias("t")))).alias("ls"))
            .select("l_orderkey", F.concat(F.lit("MARCH 2, 2026\nPersonal papers\n"), F.array_join(
                F.transform("ls", lambda s: s["t"]), "")).alias("text")))


@query("t42_toc_rows", """
SELECT l_orderkey AS package_id, l_linenumber AS "row", lpad(CAST(l_partkey % 100000 AS VARCHAR), 5, '0') AS elms_id,
       concat('26-R-', lpad(CAST(l_suppkey % 1000 AS VARCHAR), 3, '0'), '0') AS leg_id, 'Smith' AS sponsor,
       concat('A study of ', l_returnflag, ' parks') AS description, 'Resolution' AS leg_type, 'Finance' AS committee
FROM lineitem""")
def _(spark, sf):
    rows = toc_texts(spark, sf).select(F.col("l_orderkey").alias("package_id"),
                                       F.explode(toc.toc_records(F.col("text"))).alias("g"))
    return rows.select("package_id", toc.toc_row(F.col("g")).alias("r")).select("package_id", "r.*")
