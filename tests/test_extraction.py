from datetime import date  # noqa: F401

from pyspark.sql import functions as F

from minutebook.functions import donations as don, settlements as stl, sponsors as sp
from minutebook.functions.claims import claim_type, is_claim
from minutebook.operators import reports


def test_split_names(values):
    assert values(sp.split_names, "JOHN DOE, JANE SMITH AND BOB JONES", "ANTONIO BROWN, THE COMMITTEE AND X",
                  "J. R. O'NEIL-SMITH, JR. AND A.B.;", None, ". ,") == [
        ["John Doe", "Jane Smith", "Bob Jones"], ["Antonio Brown"], ["J. R. O'neil-Smith", "A.b."], None, []]
    assert values(lambda c: sp.split_names(c, compat=True), "ANTONIO BROWN AND BOB JONES") == [["Bob Jones"]]


def test_sponsors(spark):
    texts = ["A RESOLUTION BY COUNCILMEMBERS JOHN DOE AND JANE ROE AUTHORIZING X", "AN ORDINANCE BY COUNCIL MEMBER ANN LEE AS AMENDED BY X",
             "A memo", None, "A RESOLUTION BY COUNCILMEMBER THE AUTHORIZING X"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, description string")
    got = [(r.sponsors, r.sponsorConfidence) for r in sp.extract_sponsors(df).orderBy("i").collect()]
    assert got == [(["John Doe", "Jane Roe"], "high"), (["Ann Lee"], "high"), (None, None), (None, None), (None, None)]


def test_committee(spark):
    df = spark.createDataFrame([(1, "A RESOLUTION BY THE FINANCE  COMMITTEE TO X", ["Ann"]), (2, "AN ORDINANCE BY PARKS COMMITTEE; Y", None),
                                (3, "NONE", None)], "id int, description string, sponsors array<string>") \
        .withColumn("sponsorConfidence", F.lit("high"))
    known = spark.createDataFrame([("Finance Committee",), ("FINANCE Committee",)], "name string")
    found = sp.add_committee_sponsor(sp.extract_committee(df, known))
    rows = {r.id: (r.committee, r.committee_known, r.sponsors, r.sponsorConfidence) for r in found.collect()}
    assert rows == {1: ("FINANCE Committee", True, ["Ann", "FINANCE Committee"], "auto-committee"),
                    2: ("PARKS COMMITTEE", False, ["PARKS COMMITTEE"], "auto-committee"), 3: (None, False, None, "high")}


def test_claims(values):
    assert values(is_claim, " For damage CLAIM", "A claim", None) == [True, False, False]
    assert values(claim_type, "ADVERSED", "Adopted", "FILED", "", None, "MISSING") == ["adversed", "settlement", None, None, None, None]


def test_donation_direction(values):
    texts = ["ACCEPT A DONATION", "A DONATION ON BEHALF OF THE CITY", "DONATE FUNDS TO X INC", "ACCEPT AN EASEMENT DONATION",
             "AUTHORIZING A DONATION TO X; ACCEPT A DONATION", "nothing"]
    assert values(don.donation_direction, *texts) == ["accepted", "accepted", "made", None, "made", None]
    assert values(lambda c: don.donation_direction(c, compat=True), texts[1]) == [None]


def test_donation_fields(values):
    d = "ACCEPT A DONATION OF A TRUCK FROM THE ACME CO. FOR THE PURPOSE OF FIRE SAFETY; X"
    assert values(don.donor, d, "FROM A.", "x") == ["Acme Co", None, None]
    assert values(don.item_donated, d, "DONATION OF FUNDS TO X", "DONATE A BUS TO Y") == ["Truck", None, "Bus"]
    assert values(don.purpose, d) == ["Fire Safety"]
    assert values(don.recipient, "DONATE $5 TO THE ARTS FUND FOR X", "GIVE TO THE CITY.") == ["Arts Fund", None]


def test_settlements(spark):
    rows = [(1, "FOR BODILY INJURY ALLEGED TO HAVE BEEN SUSTAINED AS A RESULT OF A FALL ON JANUARY 5, 2014 AT AN UNKNOWN LOCATION. "
                "(NA/UNK) #24 CLAIM OF: JOE O'DAY; 1 MAIN ST; X", "settlement"),
            (2, "FOR PROPERTY DAMAGE ALLEGED TO HAVE BEEN ON 1/6/69 AT OAK. (APD/04 - $1,201.54) CLAIM OF ANN", "Settlement"),
            (3, "SETTLEMENT AMOUNT IN THE CASE OF JO V. CITY OF ATLANTA, CIVIL ACTION FILE NO. 12-3, FULTON COUNTY SUPERIOR COURT, "
                "Total Amount of $5,000.00 for $1", None),
            (4, "FOR X", "adversed"), (5, None, None)]
    items = spark.createDataFrame(rows, "id long, description string, claimType string") \
        .withColumn("number", F.lit("n")).withColumn("date", F.lit("2014-02-03"))
    got = {r.id: r for r in reports.parse_settlements(items).collect()}
    assert set(got) == {1, 2, 3}
    a, b, c = got[1], got[2], got[3]
    assert (a.damage_type, a.incident_type, a.incident_date, a.incident_location, a.department_code, a.amount, a.claim_number,
            a.claimant_name, a.claimant_address) == ("Bodily Injury", "Fall", "2014-01-05", "Unknown", "NA/UNK", None, "24",
                                                     "Joe O'Day", "1 Main St, X")
    assert (b.incident_date, b.department_code, float(b.amount), b.claimant_address) == ("1969-01-06", "APD/04", 1201.54, None)
    assert (c.plaintiff, c.case_name, c.case_number, c.court, float(c.amount), c.settlement_category) == (
        "Jo", "Jo v. City of Atlanta", "12-3", "Fulton County Superior Court", 5000.0, "court_litigation")
    assert got[1].legislation_date == "2014-02-03" and stl.COLUMNS == tuple(c.__fields__)


def test_upper_median(spark):
    df = spark.createDataFrame([("a", x) for x in (1, 2, 3, 4)] + [("b", x) for x in (5, 5, 9)] + [("c", None)],
                               "g string, amount int").withColumn("amount", F.col("amount").cast("decimal(18,2)"))
    got = {r.g: r.median and float(r.median) for r in reports.amount_report(df, "g", median=True).collect()}
    assert got == {"a": 3.0, "b": 5.0, "c": None}
