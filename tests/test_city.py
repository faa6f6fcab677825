"""Wordings that name the city, for another city."""

from minutebook.functions import donations as don, legislation as leg, news, settlements as stl
from minutebook.functions.text import for_city


def test_wordings_follow_the_city(values):
    for city, other in (("Atlanta", "Savannah"), ("Savannah", "Atlanta")):
        up = city.upper()
        charter = f"An ordinance to amend the charter of the City of {city} again"
        assert values(lambda c: leg.is_charter_amendment(c, city), charter, charter.replace(city, other)) == [True, False]
        gift = f"A RESOLUTION FOR A DONATION OF TREES TO THE CITY OF {up}."
        assert values(lambda c: don.donation_direction(c, city=city), gift) == ["accepted"]
        to = f"AUTHORIZING A DONATION TO CITY OF {up}."
        assert values(lambda c: don.recipient(c, city=city), to, "AUTHORIZING A DONATION TO OAK CLUB.") == [None, "Oak Club"]
        case = f"THE CASE OF ANN LEE V. CITY OF {up}, CIVIL ACTION FILE NO. 12-A"
        assert values(lambda c: stl.court_settlement(c, city)["case_name"], case.title()) == [f"Ann Lee v. City of {city}"]
        assert values(lambda c: news.strip_boilerplate(c, city), f"Body.\nTo learn more about the {city} City Council, call.") == ["Body."]


def test_names_are_taken_literally():
    assert for_city(r"\bCITY OF ATLANTA", "St. Paul") == r"\bCITY OF ST\.\ PAUL"
    assert for_city(("Atlanta", "x"), "A+B", pattern=False) == ("A+B", "x")
