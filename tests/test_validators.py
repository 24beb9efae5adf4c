"""Checks of venues and dates, case by case."""

import pytest

from lakeweave.operators import pipelines as PL
from lakeweave.operators import validators as V

COLUMNS = ["venue_name", "city", "state", "event_date", "year", "decade", "door_time", "show_time"]
SCHEMA = "id int, " + ", ".join(f"{c} {'int' if c == 'year' else 'string'}" for c in COLUMNS)


def rows(spark, **fields):
    df = spark.createDataFrame([(1, *[fields.get(c) for c in COLUMNS])], SCHEMA)
    return sorted((r.field, r.confidence, r.status, r.validated) for r in V.record_checks(df, "id", this_year=2020).collect())


@pytest.mark.parametrize(
    ("name", "confidence", "status"),
    [
        ("The Grand Theatre", 1.0, "match"), ("Park Hall", 0.9, "match"), ("SOMEWHERE", 0.4, "unverified"), ("Zed", 0.5, "partial"), ("ab", 0.3, "unverified"), ("The Zed", 0.6, "partial"),
        ("the ab", 0.4, "unverified"), ("1999", 0.3, "mismatch"), ("March 3", 0.3, "mismatch"), ("3/4 Bar", 0.3, "mismatch"), ("Marching 3", 0.5, "partial"), ("Barn", 0.5, "partial"), ("CLUB", 0.8, "match"),
    ],
)
def test_venues(spark, name, confidence, status):
    assert rows(spark, venue_name=name) == [("venue_name", confidence, status, None if status == "mismatch" else name)]


@pytest.mark.parametrize(
    ("city", "state", "want"),
    [
        ("Boston", "ma", [("city", 0.95, "match", "Boston"), ("state", 0.95, "match", "Massachusetts")]),
        ("Québec", "QC", [("city", 0.4, "unverified", "Québec"), ("state", 0.95, "match", "Quebec")]),
        ("Smallville", "new york", [("city", 0.7, "partial", "Smallville"), ("state", 0.3, "mismatch", "Smallville"), ("state", 0.95, "match", "New York")]),
        ("TX", "Dallas", [("city", 0.3, "mismatch", "Dallas"), ("city", 0.7, "partial", "TX"), ("state", 0.6, "partial", "Dallas")]),
        ("", "Ontario", [("state", 0.6, "partial", "Ontario")]),
        (None, "9", [("state", 0.3, "unverified", "9")]),
    ],
)
def test_places(spark, city, state, want):
    assert rows(spark, city=city, state=state) == want


@pytest.mark.parametrize(
    ("date", "year", "want"),
    [
        ("Friday, March 3rd 1995", 1995, [("event_date", 1.0, "match", "Friday, March 3rd 1995"), ("year", 0.9, "match", "1995")]),
        ("31 April 1995", 1996, [("event_date", 0.3, "mismatch", None), ("year", 0.4, "mismatch", "1995")]),
        ("29 Feb 1930", None, [("event_date", 0.75, "match", "29 Feb 1930")]),
        ("someday", 1949, [("event_date", 0.3, "unverified", "someday"), ("year", 0.3, "mismatch", None)]),
        ("1995-12-05", 2023, [("event_date", 0.7, "match", "1995-12-05"), ("year", 0.3, "mismatch", None)]),
        (" ", 2022, [("year", 0.9, "match", "2022")]),
    ],
)
def test_dates(spark, date, year, want):
    assert rows(spark, event_date=date, year=year) == want


def test_decades_and_times(spark):
    assert rows(spark, year=1987, decade="The 1980s!")[0] == ("decade", 0.95, "match", "1980s")
    assert rows(spark, year=1987, decade="80s")[0] == ("decade", 0.3, "mismatch", "1980s")
    assert rows(spark, door_time="7 pm", show_time="19:30") == [("door_time", 0.9, "match", "7 pm"), ("show_time", 0.9, "match", "19:30")]
    assert rows(spark, door_time="12 am", show_time="7:61") == [("door_time", 0.9, "match", "12 am"), ("show_time", 0.4, "unverified", None)]
    assert rows(spark, door_time="8:30pm", show_time="show 8 PM") == [("door_time", 0.4, "mismatch", None), ("door_time", 0.9, "match", "8:30pm"), ("show_time", 0.7, "partial", "show 8 PM")]
    assert rows(spark, door_time="24", show_time="") == [("door_time", 0.4, "unverified", None)]


def test_nothing_to_check_gives_no_row(spark):
    assert rows(spark) == [] and rows(spark, venue_name=" ", decade="1990s") == []
    assert V.record_checks(spark.createDataFrame([], SCHEMA), "id").count() == 0


def test_scores_of_records(spark):
    df = spark.createDataFrame([(1, "Park Hall", "Boston", None, None, None, None, None, None), (2, "1999", None, None, None, None, None, None, None), (3, None, "9", None, None, None, None, None, None), (4, *[None] * 8)], SCHEMA)
    assert sorted(map(tuple, PL.check_records(df, "id", 2020).collect())) == [(1, 91, "validated"), (2, 0, "mismatch"), (3, 0, "unverified")]
