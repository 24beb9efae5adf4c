"""What a record's type, artist, venue and event are worth: evidence in texts and neighbours, confidences, fields to review.

All are column expressions in one pass; neighbours and checks are reduced to a row a record before they are joined."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that speak for a type of record.
TYPE_WORDS = {
    "concert": ("venue", "doors", "show", "tickets", "live", "with", "featuring", "opens"),
    "festival": ("festival", "fest", "day 1", "day 2", "stages", "lineup", "gates"),
    "album": ("out now", "available", "new album", "new single", "streaming", "pre-order", "release date"),
    "film": ("in theaters", "coming soon", "directed by", "starring", "pg", "pg-13", "rated r", "nc-17"),
    "theater": ("broadway", "off-broadway", "now playing", "written by", "a play", "musical"),
    "comedy": ("comedy", "stand-up", "standup", "comedian", "laughs", "funny"),
    "promo": ("merchandise", "tour dates", "available at", "shop", "order now"),
    "exhibition": ("exhibition", "gallery", "museum", "on view", "opening reception", "curated"),
    "hybrid": ("album release show", "release party", "record release"),
    "unknown": (),
}
#: Confidence that a phase needs.
THRESHOLDS = {"type": 0.7, "artist": 0.6, "venue": 0.6, "event": 0.5}


def type_name(raw: Column) -> Column:
    """One of TYPE_WORDS: as it is, by a word that the text holds, else unknown."""
    t = F.lower(F.trim(raw))
    near = (("concert", "concert|show"), ("festival", "festival"), ("album", "album|release"), ("film", "movie|film"), ("theater", "play|theater|theatre"), ("comedy", "comedy|stand"))
    out = F.when(t.isin(*TYPE_WORDS), t)
    for name, words in near:
        out = out.when(t.rlike(words), name)
    return F.coalesce(out, F.lit("unknown"))


def unit_confidence(c: Column) -> Column:
    """Percentages over 1 as shares; 0.5 for none."""
    return F.coalesce(F.when(c > 1, c / 100).otherwise(c), F.lit(0.5)).cast("double")


def pattern_confidence(text: Column, type: Column) -> Column:
    """The share of the type's words that the text holds, less 0.05 for each word of other types (0.3 at most); from 0 up. A type
    without words is 0.5. `text` is read once into a flag a word."""
    low = F.lower(F.coalesce(text, F.lit("")))
    hits = {t: sum((F.contains(low, F.lit(w)).cast("int") for w in ws), F.lit(0)) for t, ws in TYPE_WORDS.items()}
    counts = F.create_map(*[x for t, h in hits.items() for x in (F.lit(t), h)])
    sizes = F.create_map(*[F.lit(x) for t, ws in TYPE_WORDS.items() for x in (t, len(ws))])

    def value(m: Column) -> Column:
        own, others = F.element_at(m, type), F.aggregate(F.map_values(m), F.lit(0), lambda a, x: a + x)
        return F.greatest(F.lit(0.0), own / F.element_at(sizes, type) - F.least((others - own) * 0.05, F.lit(0.3)))

    # A lambda over one element keeps the map from being worked out at each use.
    return F.when(F.element_at(sizes, type) == 0, 0.5).otherwise(F.get(F.transform(F.array(counts), value), F.lit(0)))


def type_evidence(records: DataFrame, id: str, text: str, type: str, confidence: str, neighbours: DataFrame | None = None, least: float = 0.5) -> DataFrame:
    """<id>, type, pattern, blended, confidence, ready of records: 0.7 of the given confidence and 0.3 of pattern_confidence, 0.1 more
    (to 1) if any of the record's `neighbours` (<id>, type) is of its type; ready from `least` up."""
    r = records.select(id, type_name(F.col(type)).alias("type"), unit_confidence(F.col(confidence)).alias("_c"), F.col(text).alias("_text"))
    r = r.withColumn("pattern", pattern_confidence(F.col("_text"), F.col("type"))).withColumn("blended", F.col("_c") * 0.7 + F.col("pattern") * 0.3)
    agrees = F.lit(False)
    if neighbours is not None:
        near = neighbours.select(id, type_name(F.col("type")).alias("type")).distinct().withColumn("_near", F.lit(True))
        r, agrees = r.join(near, [id, "type"], "left"), F.coalesce("_near", F.lit(False))
    final = F.when(agrees, F.least(F.col("blended") + 0.1, F.lit(1.0))).otherwise(F.col("blended"))
    return r.select(id, "type", "pattern", "blended", final.alias("confidence")).withColumn("ready", F.col("confidence") >= least)


def inferred_types(evidence: DataFrame, id: str) -> DataFrame:
    """<id>, type, confidence, is_primary: each record's type; for hybrids album (0.9 of it) and concert (0.85) as well."""
    row = lambda t, w, first: F.struct(t.alias("type"), (F.col("blended") * w).alias("confidence"), F.lit(first).alias("is_primary"))
    more = F.when(F.col("type") == "hybrid", F.array(row(F.lit("album"), 0.9, False), row(F.lit("concert"), 0.85, False))).otherwise(F.array())
    return evidence.select(id, F.explode(F.concat(F.array(row(F.col("type"), 1.0, True)), more)).alias("x")).select(id, "x.*")


def artist_confidence(type: Column, headliner: Column, external: Column, supports: Column) -> Column:
    """0.6 of the headliner's confidence, 0.1 if known elsewhere; 0.3 without one where the type needs none; 0.3 of the supports'
    mean, of 0.5 without any."""
    lead = F.when(headliner.isNotNull(), headliner * 0.6 + F.when(external.isNotNull(), 0.1).otherwise(0.0)).when(type.isin("exhibition", "promo"), 0.3).otherwise(0.0)
    mean = F.when(F.size(supports) > 0, F.aggregate(supports, F.lit(0.0), lambda a, x: a + x) / F.size(supports)).otherwise(0.5)
    return F.least(lead + mean * 0.3, F.lit(1.0))


def venue_confidence(type: Column, venue: Column, city: Column, known: Column, validated: Column) -> Column:
    """The venue's confidence, + 0.1 for a city, + 0.15 for a known venue, + 0.1 for a validated name; without a venue 0.6 where the
    type needs none, else 0."""
    more = lambda c, w: F.when(F.length(c.cast("string")) > 0, w).otherwise(0.0)
    return F.when(venue.isNotNull(), F.least(venue + more(city, 0.1) + more(known, 0.15) + more(validated, 0.1), F.lit(1.0))).when(type.isin("album", "promo", "film"), 0.6).otherwise(0.0)


def event_confidence(type: Column, date: Column, parsed: Column, door: Column, show: Column, artist_valid: Column, venue_valid: Column) -> Column:
    """The date's confidence (without one 0.5 where the type needs none, else 0), + 0.1 for a time, + 0.1 for a full date, - 0.15 and
    - 0.1 where artist or venue were not there at the time; from 0 to 1."""
    timed = (F.length(door) > 0) | (F.length(show) > 0)
    base = F.coalesce(date, F.when(type.isin("promo", "unknown"), 0.5).otherwise(0.0))
    c = base + F.when(timed, 0.1).otherwise(0.0) - F.when(~artist_valid, 0.15).otherwise(0.0) - F.when(~venue_valid, 0.1).otherwise(0.0) + F.when(parsed, 0.1).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.least(c, F.lit(1.0)))


def review(phases: DataFrame, checks: DataFrame, id: str) -> DataFrame:
    """<id>, overall, fields: the mean of the phases' confidences above 0 (columns of THRESHOLDS' names; null: not run), and the
    fields to review: those of partial or mismatched `checks` (<id>, field, status) and phases under their threshold, sorted."""
    shares = F.filter(F.array(*THRESHOLDS), lambda x: x > 0)
    overall = F.when(F.size(shares) > 0, F.aggregate(shares, F.lit(0.0), lambda a, x: a + x) / F.size(shares)).otherwise(0.0)
    weak = F.array_compact(F.array(*[F.when(F.col(p) < t, F.lit(f"{p}_phase")) for p, t in THRESHOLDS.items()]))
    # A record has as many fields as there are checks, so the set is bounded.
    bad = checks.where(F.col("status").isin("partial", "mismatch")).groupBy(id).agg(F.collect_set("field").alias("_bad"))
    fields = F.sort_array(F.array_union(F.coalesce("_bad", F.array().cast("array<string>")), weak))
    return phases.join(bad, id, "left").select(id, overall.alias("overall"), fields.alias("fields"))


#: Years before the first and after the last known one in which artists and venues may still be met.
ARTIST_SPAN, VENUE_SPAN = (5, 10), (0, 20)


def activity(claims: DataFrame, history: DataFrame, span: tuple[int, int]) -> DataFrame:
    """`claims` (with name, year) with first_year, last_year, valid: whether the year is within `span` of the years that `history`
    (name, year) has for the name. Names without history, and claims without a year, are valid. History is reduced to a row a name
    before the join."""
    seen = history.where("year is not null").groupBy("name").agg(F.min("year").alias("first_year"), F.max("year").alias("last_year"))
    return claims.join(seen, "name", "left").withColumn("valid", F.coalesce(F.col("year").between(F.col("first_year") - span[0], F.col("last_year") + span[1]), F.lit(True)))
