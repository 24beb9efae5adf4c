"""Types by evidence, confidences of phases and fields to review, case by case."""

import pytest
from pyspark.sql import functions as F

from lakeweave.operators import phases as P


def value(spark, column):
    return spark.range(1).select(column).first()[0]


@pytest.mark.parametrize(("raw", "name"), [("Album", "album"), (" FILM ", "film"), ("live show", "concert"), ("a movie", "film"), ("release", "album"), ("stand up", "comedy"), ("odd", "unknown"), (None, "unknown")])
def test_type_names(spark, raw, name):
    assert value(spark, P.type_name(F.lit(raw).cast("string"))) == name


@pytest.mark.parametrize(("given", "unit"), [(80.0, 0.8), (1.0, 1.0), (0.25, 0.25), (None, 0.5)])
def test_unit_confidence(spark, given, unit):
    assert value(spark, P.unit_confidence(F.lit(given).cast("double"))) == unit


def plain_pattern(text, kind):
    if not P.TYPE_WORDS[kind]:
        return 0.5
    held = {t: sum(w in (text or "").lower() for w in ws) for t, ws in P.TYPE_WORDS.items()}
    return max(0.0, held[kind] / len(P.TYPE_WORDS[kind]) - min(0.05 * sum(n for t, n in held.items() if t != kind), 0.3))


def test_pattern_confidence(spark):
    texts = ["", None, "DOORS at 8, live with tickets", "A festival fest: Day 1, day 2, lineup and gates", "comedy museum musical film shop streaming pg-13", "album release show"]
    rows = [(t, k) for t in texts for k in P.TYPE_WORDS]
    got = spark.createDataFrame(rows, "text string, kind string").select("text", "kind", P.pattern_confidence(F.col("text"), F.col("kind")).alias("p")).collect()
    assert len(got) == len(rows) and all(r.p == pytest.approx(plain_pattern(r.text, r.kind)) for r in got)


def test_neighbours_and_inferred_types(spark):
    r = spark.createDataFrame([(1, "", "hybrid", 90.0), (2, None, "unknown", 0.95), (3, "", "album", None)], "id int, text string, kind string, conf double")
    n = spark.createDataFrame([(1, "album"), (2, "what"), (2, None), (9, "album")], "id int, type string")
    e = P.type_evidence(r, "id", "text", "kind", "conf", n)
    got = {x.id: (x.type, round(x.blended, 6), round(x.confidence, 6), x.ready) for x in e.collect()}
    assert got == {1: ("hybrid", 0.63, 0.63, True), 2: ("unknown", 0.815, 0.915, True), 3: ("album", 0.35, 0.35, False)}
    assert sorted((x.id, x.type, round(x.confidence, 6)) for x in P.inferred_types(e, "id").collect()) == [(1, "album", 0.567), (1, "concert", 0.5355), (1, "hybrid", 0.63), (2, "unknown", 0.815), (3, "album", 0.35)]
    assert P.type_evidence(r.limit(0), "id", "text", "kind", "conf").count() == 0


def test_confidences(spark):
    no, some = F.lit(None).cast("double"), lambda *xs: F.array(*map(F.lit, xs)).cast("array<double>")
    artist = lambda t, h, x, s: round(value(spark, P.artist_confidence(F.lit(t), h, x, s)), 6)
    assert artist("concert", F.lit(0.5), F.lit("x"), some(0.2, 0.6)) == 0.52 and artist("promo", no, F.lit(None), some()) == 0.45 and artist("film", no, F.lit("x"), some()) == 0.15
    venue = lambda t, *xs: round(value(spark, P.venue_confidence(F.lit(t), *xs)), 6)
    assert venue("film", no, F.lit("c"), no, no) == 0.6 and venue("concert", no, F.lit("c"), no, no) == 0.0 and venue("concert", F.lit(0.5), F.lit(""), F.lit(7), F.lit("v")) == 0.75 and venue("concert", F.lit(0.9), F.lit("c"), F.lit(7), no) == 1.0
    yes, none = F.lit(True), F.lit(None).cast("boolean")
    event = lambda t, *xs: round(value(spark, P.event_confidence(F.lit(t), *xs)), 6)
    assert event("concert", F.lit(0.6), yes, F.lit("7 pm"), F.lit(None), ~yes, ~yes) == 0.55 and event("promo", no, none, F.lit(""), F.lit(None), none, none) == 0.5 and event("film", no, none, F.lit(""), F.lit(None), ~yes, yes) == 0.0


def test_review(spark):
    p = spark.createDataFrame([(1, 0.8, 0.5, 0.0, None), (2, 0.9, 0.9, 0.9, 0.9), (3, None, None, None, None)], "id int, type double, artist double, venue double, event double")
    c = spark.createDataFrame([(1, "city", "partial"), (1, "city", "mismatch"), (1, "year", "match"), (2, "state", "mismatch"), (7, "city", "partial")], "id int, field string, status string")
    got = {r.id: (round(r.overall, 6), r.fields) for r in P.review(p, c, "id").collect()}
    assert got == {1: (0.65, ["artist_phase", "city", "venue_phase"]), 2: (0.9, ["state"]), 3: (0.0, [])}


def test_activity(spark):
    h = spark.createDataFrame([("a", 1990), ("a", 2000), ("a", None), ("b", None), (None, 1950)], "name string, year int")
    c = spark.createDataFrame([("a", y) for y in (1984, 1985, 1990, 2010, 2011, None)] + [("b", 1), ("z", 1), (None, 1)], "name string, year int")
    ok = lambda span: sorted((str(r.name), r.year or 0) for r in P.activity(c, h, span).collect() if r.valid)
    rest = [("None", 1), ("b", 1), ("z", 1)]
    assert ok(P.ARTIST_SPAN) == sorted([("a", 0), ("a", 1985), ("a", 1990), ("a", 2010), *rest])
    assert ok(P.VENUE_SPAN) == sorted([("a", 0), ("a", 1990), ("a", 2010), ("a", 2011), *rest])


def test_strict_votes(spark):
    from lakeweave.operators import quality as Q

    v = spark.createDataFrame([(1, "poster_type", "film", 0.9), (1, "genre", "rock", 0.8), (2, "poster_type", "film", 0.5), (2, "poster_type", "film", 0.7)], "subject int, field string, value string, confidence double")
    got = {(r.subject, r.field): (r.value, round(r.confidence, 6)) for r in Q.consensus_categorical(v, strict=("poster_type",)).collect()}
    assert got == {(1, "poster_type"): (None, 0.0), (1, "genre"): ("rock", 0.8), (2, "poster_type"): ("film", 0.6)}
    assert {r.value for r in Q.consensus_categorical(v).collect()} == {"film", "rock"}
