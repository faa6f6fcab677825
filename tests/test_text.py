from pyspark.sql import functions as F

from minutebook.functions import dates, display, legislation as leg, money, news, text as tx, toc


def test_search_folding(values):
    assert values(tx.fold_quotes_lower, "It’s “OK”") == ["it's \"ok\""]
    assert values(tx.simple_needle, ' “City Budget” ', '"', '""', "a") == ["city budget", '"', '""', "a"]
    assert values(tx.fts_query_text, "“x” it's ‘y’") == ["\"x\" it’s ’y’"]


def test_normalize(values):
    assert values(tx.normalize_text, " a –  “b” \n c‟ ") == ['a - "b" c"']
    assert values(tx.normalize_quotes, "a‑b — c") == ["a‑b - c"]
    assert values(tx.title_case, "o'neil-smith III 3rd st.", "éCOLE d'ART") == ["O'Neil-Smith Iii 3Rd St.", "École D'Art"]
    assert values(lambda c: tx.truncate(c, 3), "abc", "abcd", None) == ["abc", "abc...", None]
    assert values(lambda c: tx.occurrences(c, "aa"), "aaaaa", "") == [2, 0]


def test_trim_fields(spark):
    df = spark.createDataFrame([(" a ", "b"), ("c", None)], "x string, y string")
    rows = tx.trim_fields(df, ["x", "y"]).collect()
    assert sorted((r.x, r.y, r.trimmed_fields) for r in rows) == [("a", "b", 1), ("c", None, 0)]


def test_pair_difference(spark):
    pairs = [("a", "a"), (None, None), (None, "a"), ("it’s", "it's"), ("a  b", "a b"), ("A", "a"), ("ab", "xaby"), ("a", "b")]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string")
    got = [r.d for r in df.select("i", tx.pair_difference(F.col("a"), F.col("b")).alias("d")).orderBy("i").collect()]
    assert got == ["identical", "identical", "type_difference", "quote_difference", "whitespace_difference",
                   "case_difference", "substring_difference", "text_difference"]


def test_record_numbers(values):
    assert values(leg.legislation_type, "13-C0626", "84-R-15428", "84-RT-1A", "x-TR-y", "abc", None) == ["C", "R", "RT", "TR", None, None]
    assert values(lambda c: leg.legislation_type_name(leg.legislation_type(c)), "84-R-1", "84-ZZ-1") == ["Resolution", "ZZ"]
    assert values(leg.legislation_type_strict, " 84-R-1 ", "84-R-1A") == ["R", None]
    assert values(lambda c: leg.number_to_url(c, "b/"), "84-R-15428") == ["b/84r15428.pdf"]
    assert values(leg.pdf_stem, "https://h.org/a/20R3001.pdf?x=1", None) == ["20r3001", None]


def action_of(spark, *texts, **kw):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, description string")
    rows = leg.extract_final_action(df, **kw).orderBy("i").collect()
    return [(r.cleaned, r.action, r.needs_review) for r in rows]


def test_final_action(spark):
    got = action_of(
        spark, "A study of 5 parks. ADOPTED BY A ROLL CALL VOTE OF 14 YEAS; 0 NAYS", "Paving 3 roads. ADOPTED ON CONSENT",
        "A plan FILED", "A plan FILED BY THE CLERK", "A plan", None, "", "A plan FILED BY " + "X" * 60,
        "A plan FILED BY " + "X" * 60 + " HELD")
    assert got == [
        ("A study of 5 parks.", "ADOPTED BY A ROLL CALL VOTE OF 14 YEAS; 0 NAYS", False),
        ("Paving 3 roads.", "ADOPTED ON CONSENT", False),
        ("A plan", "FILED", True),
        ("A plan", "FILED BY THE CLERK", False),
        ("A plan", None, True), (None, None, True), ("", None, True),
        ("A plan FILED BY " + "X" * 60, None, True),
        ("A plan FILED BY " + "X" * 60, "HELD", True)]


def test_final_action_anchored(spark):
    text = "AN ORDINANCE TO PAVE ROADS; ADOPTED BY ROLL CALL VOTE OF 14 YEAS; 0 NAYS"
    assert action_of(spark, text)[0][1].startswith("ORDINANCE")  # starts at the first capital
    assert action_of(spark, text, anchored=True)[0][1] == "ADOPTED BY ROLL CALL VOTE OF 14 YEAS; 0 NAYS"


def test_move_suffix_and_category(spark, values):
    end = leg.TERMINATION_ENDINGS[1]
    df = spark.createDataFrame([("A memo " + end, "old"), ("A memo", "old")], "description string, finalAction string")
    rows = {(r.description, r.finalAction) for r in leg.move_suffix(df, leg.TERMINATION_ENDINGS).collect()}
    assert rows == {("A memo", end), ("A memo", "old")}
    assert values(leg.final_action_category, "Adopted Substitute as amended", "ADOPTED AS AMENDED", "ADOPTED SUBSTITUTE",
                  "ADOPTED ON CONSENT", "adopted", "ADVERSED", "FILED", "CONFIRMED", "ACCEPTED", "HELD", "", None, "MISSING") == [
        "ADOPTED_SUBSTITUTE_AMENDED", "ADOPTED_AMENDED", "ADOPTED_SUBSTITUTE", "ADOPTED_CONSENT", "ADOPTED", "ADVERSED",
        "FILED", "CONFIRMED", "ACCEPTED", "OTHER", "MISSING", "MISSING", "MISSING"]


def test_money(values):
    got = values(money.dollar_amount, "not to exceed $1,250.50 of $9", "AMOUNT OF 7", "pay $ 12", "NOT TO EXCEED ,  then $5", "none", "$0")
    assert [None if g is None else float(g) for g in got] == [1250.5, 7.0, 12.0, None, None, None]


def test_dates(values):
    assert values(dates.expand_date_from, "1994", " 1994-02", "1994-02-03", "") == ["1994-01-01", "1994-02-01", "1994-02-03", None]
    assert values(dates.expand_date_to, "1994", "1996-02", "x") == ["1994-12-31", "1996-02-29", "x"]
    assert values(dates.meeting_date_in_text, "on MARCH 2, 2026 at", "May 5  2020", "February 30, 2020", "no") == ["2026-03-02", "2020-05-05", None, None]
    assert values(dates.office_section, "District 3", "post 2 at large", "President", "Clerk", None) == [
        "Districts", "At-Large", "President", "Other", "Other"]


def test_display_case(values):
    got = values(display.display_case,
                 "MR. JOHN A. DOE OF MARTA FILED A CLAIM. IT WAS PAID BY APD, INC.", "Mixed Case stays", "12", None,
                 "A TALE OF DR. X. THE END OF ALL WORDS HERE")
    assert got[0] == "Mr. John A. Doe Of MARTA filed A claim. It was paid by APD, INC."
    assert got[1:4] == ["Mixed Case stays", "12", None]
    assert got[4] == "A tale of Dr. X. The End Of All words here"


def test_boilerplate_and_preview(values):
    text = ("FOR IMMEDIATE RELEASE\nCouncil\nJan 1\nATLANTA — The council met.\n\n\n\nMore.\n"
            "Contacts:\n Jo\n###\nend")
    assert values(news.strip_boilerplate, text, None) == ["ATLANTA — The council met.\n\nMore.", ""]
    assert values(lambda c: news.preview(c, 20), "One two three. Four five six.", "short", "x" * 30, "aaa bbb ccc ddd eee fff") == [
        "One two three.", "short", "x" * 20 + "...", "aaa bbb ccc ddd eee..."]


def test_news_type(values):
    assert values(news.news_type, None, "", f"<img src='{news.ADVISORY_IMAGE}'>", f"x{news.RELEASE_IMAGE}", '<img a alt="Media Advisory 3">',
                  "a NEWS RELEASE", "nothing") == ["Unknown", "Unknown", "Media Advisory", "News Release", "Media Advisory",
                                                   "News Release", "Unknown"]


def test_toc(values):
    text = "MARCH 2, 2026\n12\n 1 12345 26-R-330 0 Smith A study\n\n of parks\nResolution  Finance\r\n2 22222  bad\f3 33333 26-O-1111 Lee Roads Ordinance"
    got = values(lambda c: F.transform(toc.toc_records(c), toc.toc_row), text)[0]
    assert [g and (g.row, g.elms_id, g.leg_id, g.sponsor, g.description, g.leg_type, g.committee) for g in got] == [
        (1, "12345", "26-R-3300", "Smith", "A study of parks", "Resolution", "Finance"), None,
        (3, "33333", "26-O-1111", "Lee", "Roads", "Ordinance", "")]
