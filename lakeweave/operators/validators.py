"""Checks of venues, places, dates and times of a table of records, one row a check.

A check row is: <id>, field, original, validated, confidence, status, message. Status is match, partial, mismatch or
unverified. Null and blank fields give no row; a record of blank fields alone has none. All checks are column expressions in
one pass over the table, without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: Words that speak for a venue.
VENUE_WORDS = (
    "theater", "theatre", "hall", "arena", "stadium", "club", "bar", "pub", "lounge", "room", "house", "center", "centre", "pavilion",
    "amphitheater", "amphitheatre", "ballroom", "auditorium", "coliseum", "colosseum", "garden", "gardens", "field", "park", "bowl",
    "dome", "complex", "venue", "showroom", "cabaret", "café", "cafe", "tavern", "saloon", "brewery", "winery", "civic", "memorial",
    "convention", "forum", "palace", "royal", "grand", "metro", "underground", "basement", "loft", "warehouse", "factory", "mill",
    "church", "cathedral", "temple", "chapel",
)

#: States by their codes.
STATES = {
    "AL": "Alabama", "AK": "Alaska", "AZ": "Arizona", "AR": "Arkansas", "CA": "California", "CO": "Colorado", "CT": "Connecticut",
    "DE": "Delaware", "FL": "Florida", "GA": "Georgia", "HI": "Hawaii", "ID": "Idaho", "IL": "Illinois", "IN": "Indiana", "IA": "Iowa",
    "KS": "Kansas", "KY": "Kentucky", "LA": "Louisiana", "ME": "Maine", "MD": "Maryland", "MA": "Massachusetts", "MI": "Michigan",
    "MN": "Minnesota", "MS": "Mississippi", "MO": "Missouri", "MT": "Montana", "NE": "Nebraska", "NV": "Nevada", "NH": "New Hampshire",
    "NJ": "New Jersey", "NM": "New Mexico", "NY": "New York", "NC": "North Carolina", "ND": "North Dakota", "OH": "Ohio",
    "OK": "Oklahoma", "OR": "Oregon", "PA": "Pennsylvania", "RI": "Rhode Island", "SC": "South Carolina", "SD": "South Dakota",
    "TN": "Tennessee", "TX": "Texas", "UT": "Utah", "VT": "Vermont", "VA": "Virginia", "WA": "Washington", "WV": "West Virginia",
    "WI": "Wisconsin", "WY": "Wyoming", "DC": "District of Columbia",
}

#: Provinces by their codes.
PROVINCES = {
    "AB": "Alberta", "BC": "British Columbia", "MB": "Manitoba", "NB": "New Brunswick", "NL": "Newfoundland and Labrador",
    "NS": "Nova Scotia", "NT": "Northwest Territories", "NU": "Nunavut", "ON": "Ontario", "PE": "Prince Edward Island", "QC": "Quebec",
    "SK": "Saskatchewan", "YT": "Yukon",
}

#: Cities taken as known.
CITIES = (
    "new york", "los angeles", "chicago", "houston", "phoenix", "philadelphia", "san antonio", "san diego", "dallas", "san jose",
    "austin", "jacksonville", "san francisco", "columbus", "fort worth", "indianapolis", "charlotte", "seattle", "denver", "washington",
    "boston", "el paso", "detroit", "nashville", "portland", "memphis", "oklahoma city", "las vegas", "louisville", "baltimore",
    "milwaukee", "albuquerque", "tucson", "fresno", "sacramento", "atlanta", "kansas city", "miami", "oakland", "minneapolis",
    "cleveland", "orlando",
    "london", "paris", "berlin", "tokyo", "sydney", "melbourne", "toronto", "vancouver", "montreal", "amsterdam", "barcelona", "madrid",
    "rome", "dublin", "manchester", "birmingham", "glasgow", "edinburgh", "liverpool",
)

FIRST_YEAR = 1950


def _check(field: str, original: Column, confidence: Column, status: Column | str, message: Column | str, validated: Column | None = None) -> Column:
    as_column = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(F.lit(field).alias("field"), original.cast("string").alias("original"), (F.lit(None) if validated is None else validated).cast("string").alias("validated"), F.round(confidence, 6).alias("confidence"), as_column(status).alias("status"), as_column(message).alias("message"))


def _fixed(field: str, original: Column, confidence: float, status: str, message: str, validated: Column | None = None) -> Column:
    return _check(field, original, F.lit(confidence), status, message, validated)


def _filled(c: Column) -> Column:
    return F.length(F.trim(c)) > 0


def _graded(confidence: Column, match: float = 0.7) -> Column:
    return F.when(confidence >= match, "match").when(confidence >= 0.5, "partial").otherwise("unverified")


def venue_check(v: Column) -> Column:
    """0.5, + 0.4 for a venue word, - 0.2 for names under three characters, - 0.1 in capitals, + 0.1 after 'the'; dates and years
    are no venues."""
    date_like = v.rlike(r"^\d{4}$") | F.lower(v).rlike(rf"^({'|'.join(T.MONTHS)})\s+\d") | v.rlike(r"^\d{1,2}[/-]\d{1,2}")
    word = F.lower(v).rlike(rf"\b({'|'.join(VENUE_WORDS)})\b")
    c = F.lit(0.5) + F.when(word, 0.4).otherwise(0.0) - F.when(F.length(T.normalise(v)) < 3, 0.2).otherwise(0.0) - F.when((F.upper(v) == v) & (F.length(v) > 3), 0.1).otherwise(0.0) + F.when(F.lower(v).rlike(r"^the\s"), 0.1).otherwise(0.0)
    c = F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), c)), 6)
    said = F.when(word, "venue word").otherwise("no venue word")
    return F.when(_filled(v), F.when(date_like, _fixed("venue_name", v, 0.3, "mismatch", "a date, not a venue")).otherwise(_check("venue_name", v, c, _graded(c), said, v)))


def city_check(c: Column) -> Column:
    """0.95 for a known city, 0.7 for letters, blanks and -'. alone, else 0.4."""
    known, formed = T.normalise(c).isin(*CITIES), c.rlike(r"^[a-zA-Z\s'.-]+$") & (F.length(c) >= 2)
    said = F.when(known, _fixed("city", c, 0.95, "match", "known city", c)).when(formed, _fixed("city", c, 0.7, "partial", "city-like", c)).otherwise(_fixed("city", c, 0.4, "unverified", "not city-like", c))
    return F.when(_filled(c), said)


def _code(x: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(v) for kv in (STATES | PROVINCES).items() for v in kv]), F.upper(F.trim(x)))


def state_check(s: Column) -> Column:
    """Codes of states and provinces and full names of states are 0.95; else 0.6 if formed like one, 0.3 if not."""
    full = F.element_at(F.create_map(*[F.lit(v) for n in STATES.values() for v in (n.lower(), n)]), T.normalise(s))
    name, formed = F.coalesce(_code(s), full), s.rlike(r"^[a-zA-Z\s-]+$") & (F.length(s) >= 2)
    said = F.when(name.isNotNull(), _fixed("state", s, 0.95, "match", "known state", name)).when(formed, _fixed("state", s, 0.6, "partial", "state-like", s)).otherwise(_fixed("state", s, 0.3, "unverified", "not state-like", s))
    return F.when(_filled(s), said)


def swap_check(city: Column, state: Column) -> Column:
    """A mismatch where the city is a code of a state, or the state is a known city; the other field is proposed."""
    swapped = _code(T.normalise(city)).isNotNull()
    is_city = F.lower(F.trim(state)).isin(*CITIES)
    return F.when(_filled(city) & _filled(state), F.when(swapped, _fixed("city", city, 0.3, "mismatch", "a state, not a city", state)).when(is_city, _fixed("state", state, 0.3, "mismatch", "a city, not a state", city)))


def _parts(d: Column) -> tuple[Column, Column, Column, Column]:
    """Year, month, day (null if not found) and whether a weekday is named."""
    low = F.lower(d)
    number = lambda c: F.nullif(c, F.lit("")).cast("int")
    month = F.coalesce(*[F.when(F.contains(low, F.lit(m[:3])), i) for i, m in enumerate(T.MONTHS, 1)])
    named = low.rlike("sun|mon|tue|wed|thu|fri|sat")
    return number(F.regexp_extract(d, r"\b((19|20)\d{2})\b", 1)), month, number(F.regexp_extract(d, r"\b([1-9]|[12]\d|3[01])(st|nd|rd|th)?\b", 1)), named


def date_check(d: Column, last_year: Column) -> Column:
    """0.3, + 0.25 for a year, + 0.25 for a month, + 0.15 for a day, + 0.05 for a weekday, - 0.2 for years out of range; a day that
    its month has not is a mismatch."""
    year, month, day, named = _parts(d)
    bad = day > F.get(F.array(*[F.lit(n) for n in (31, 29, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)]), month - 1)
    c = F.lit(0.3) + F.when(year.isNotNull(), 0.25).otherwise(0.0) + F.when(month.isNotNull(), 0.25).otherwise(0.0) + F.when(day.isNotNull(), 0.15).otherwise(0.0) + F.when(named, 0.05).otherwise(0.0)
    c = F.round(F.greatest(F.lit(0.0), c - F.when((year < FIRST_YEAR) | (year > last_year), 0.2).otherwise(0.0)), 6)
    found = F.concat_ws(", ", F.when(year.isNotNull(), "year"), F.when(month.isNotNull(), "month"), F.when(day.isNotNull(), "day"), F.when(named, "weekday"))
    return F.when(_filled(d), F.when(bad, _fixed("event_date", d, 0.3, "mismatch", "day not in month")).otherwise(_check("event_date", d, c, _graded(c), found, d)))


def year_check(y: Column, d: Column, last_year: Column) -> Column:
    """Out of range, unlike the year that the date names, or right."""
    named = _parts(d)[0]
    said = F.when(y < FIRST_YEAR, _fixed("year", y, 0.3, "mismatch", "too early")).when(y > last_year, _fixed("year", y, 0.3, "mismatch", "too late"))
    return F.when(y.isNotNull(), said.when(named != y, _fixed("year", y, 0.4, "mismatch", "not the year of the date", named)).otherwise(_fixed("year", y, 0.9, "match", "in range", y)))


def decade_check(decade: Column, y: Column) -> Column:
    right = F.concat((F.floor(y / 10) * 10).cast("string"), F.lit("s"))
    same = F.lower(F.regexp_replace(decade, "[^0-9sS]", "")) == right
    return F.when(_filled(decade) & y.isNotNull(), F.when(same, _fixed("decade", decade, 0.95, "match", "decade of the year", right)).otherwise(_fixed("decade", decade, 0.3, "mismatch", "not the decade of the year", right)))


def time_check(field: str, t: Column) -> Column:
    """19:00, 7:00 pm, 7 pm and 19 are times; a text that speaks of doors or a show is half of one."""
    x = F.lower(F.trim(t))
    part = lambda p, g: F.coalesce(F.nullif(F.regexp_extract(x, p, g), F.lit("")).cast("int"), F.lit(0))
    shaped = x.rlike(r"^\d{1,2}(:\d{2})?\s*(am|pm)?$")
    valid = shaped & (part(r"^(\d{1,2})", 1) <= 23) & (part(r"^\d{1,2}:(\d{2})", 1) <= 59)
    said = F.when(valid, _fixed(field, t, 0.9, "match", "a time", t)).when(x.rlike("doors|show"), _fixed(field, t, 0.7, "partial", "words about a time", t)).otherwise(_fixed(field, t, 0.4, "unverified", "no time"))
    return F.when(_filled(t), said)


def _minutes(t: Column) -> Column:
    p = r"(?i)(\d{1,2})(?::(\d{2}))?\s*(am|pm)?"
    hour, minute, half = F.nullif(F.regexp_extract(t, p, 1), F.lit("")).cast("int"), F.nullif(F.regexp_extract(t, p, 2), F.lit("")).cast("int"), F.lower(F.regexp_extract(t, p, 3))
    hour = F.when((half == "pm") & (hour != 12), hour + 12).when((half == "am") & (hour == 12), 0).otherwise(hour)
    return hour * 60 + F.coalesce(minute, F.lit(0))


def order_check(door: Column, show: Column) -> Column:
    return F.when(_minutes(door) > _minutes(show), _fixed("door_time", door, 0.4, "mismatch", "doors after the show"))


def _rows(df: DataFrame, id: str, checks: list[Column]) -> DataFrame:
    return df.select(F.col(id), F.explode(F.array_compact(F.array(*checks))).alias("_x")).select(id, "_x.*")


def _venue_list(venue: str, city: str, state: str) -> list[Column]:
    v, c, s = F.col(venue), F.col(city), F.col(state)
    return [venue_check(v), city_check(c), state_check(s), swap_check(c, s)]


def _date_list(date: str, year: str, decade: str, door: str, show: str, this_year: int | None) -> list[Column]:
    d, y, last = F.col(date), F.col(year), (F.year(F.current_date()) if this_year is None else F.lit(this_year)) + 2
    return [date_check(d, last), year_check(y, d, last), decade_check(F.col(decade), y), time_check("door_time", F.col(door)), time_check("show_time", F.col(show)), order_check(F.col(door), F.col(show))]


def venue_checks(df: DataFrame, id: str, venue: str = "venue_name", city: str = "city", state: str = "state") -> DataFrame:
    """Check rows of venue names, cities, states, and of cities and states that changed places."""
    return _rows(df, id, _venue_list(venue, city, state))


def date_checks(df: DataFrame, id: str, date: str = "event_date", year: str = "year", decade: str = "decade", door: str = "door_time", show: str = "show_time", this_year: int | None = None) -> DataFrame:
    """Check rows of dates, years, decades, times and their order. Years may be up to two after `this_year` (the clock's)."""
    return _rows(df, id, _date_list(date, year, decade, door, show, this_year))


def record_checks(df: DataFrame, id: str, this_year: int | None = None) -> DataFrame:
    """venue_checks and date_checks of columns of the usual names, in one pass."""
    return _rows(df, id, _venue_list("venue_name", "city", "state") + _date_list("event_date", "year", "decade", "door_time", "show_time", this_year))
