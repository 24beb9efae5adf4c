"""Matching of venues, artists and titles, checks of dates and places, and domain rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.scratch import cut
from . import text_join as J
from .tables import contained


def venue_score(a: Column, b: Column) -> Column:
    """1 if equal, 0.9 if one holds the other, else the shared part of their words."""
    x, y = T.normalise(a), T.normalise(b)
    p, q = F.split(x, " "), F.split(y, " ")
    return F.when(x == y, 1.0).when(F.contains(x, y) | F.contains(y, x), 0.9).otherwise(F.size(F.array_intersect(p, q)) / F.size(F.array_union(p, q)))


def _either_holds(a: DataFrame, b: DataFrame) -> DataFrame:
    """a, b: texts of two columns of which one holds the other."""
    return contained(a, b).toDF("a", "b").union(contained(b, a).select(F.col("y"), F.col("x")))


def match_venues(names: DataFrame, venues: DataFrame, least: float = 0.7) -> DataFrame:
    """name, venue, city, score: the best known venue (venue, city) of a score above `least`. Names meet venues that hold them or
    that they hold, and those of similar words, by the keys of `text_join`; a word that all have costs nothing."""
    n = names.select("name").where("name is not null").distinct().withColumn("a", T.normalise(F.col("name")))
    v = venues.select("venue", "city").where("venue is not null").distinct().withColumn("b", T.normalise(F.col("venue")))
    a, b = n.select("a"), v.select("b")
    pairs = _either_holds(a, b).union(J.similar_sets(a, b, least).select("a", "b")).distinct()
    scored = n.join(pairs, "a").join(v, "b").withColumn("score", venue_score(F.col("name"), F.col("venue"))).where(F.col("score") > least)
    r = F.row_number().over(W.partitionBy("name").orderBy(F.desc("score"), "venue", "city"))
    return scored.withColumn("r", r).where("r = 1").select("name", "venue", "city", "score")


def match_titles(rows: DataFrame, reference: DataFrame, k: int = 1, least: float = 0.7) -> DataFrame:
    """title, year, found, found_year, score, status: the best references (found, found_year) whose letters and digits are `least`
    alike; more than a year apart counts 0.7 and makes the match partial. Titles without such a reference have no row."""
    compact = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    a = rows.select("title", "year").where("title is not null").distinct().withColumn("a", compact("title"))
    b = reference.select("found", "found_year").where("found is not null").distinct().withColumn("b", compact("found"))
    x, y = a.select("a"), b.select("b")
    met = _either_holds(x, y).union(J.similar_strings(x, y, least).select("a", "b")).distinct()
    far = F.coalesce(F.abs(F.col("year") - F.col("found_year")) > 1, F.lit(False))
    pairs = a.join(met, "a").join(b, "b").withColumn("alike", T.title_confidence(F.col("title"), F.col("found"))).where(F.col("alike") >= least)
    pairs = pairs.withColumn("score", F.col("alike") * F.when(far, 0.7).otherwise(1.0))
    status = F.when(far & (F.col("score") >= 0.5), "partial").otherwise(T.match_status(F.col("score")))
    r = F.row_number().over(W.partitionBy("title", "year").orderBy(F.desc("score"), "found", "found_year"))
    return pairs.withColumns({"status": status, "r": r}).where(F.col("r") <= k).select("title", "year", "found", "found_year", "score", "status")


def match_people(names: DataFrame, credits: DataFrame, bonus: float = 0.05, least: float = 0.7) -> DataFrame:
    """name, film, person, department, score, status: the best credit (film, person, department) of a film for each name
    (name, film, department), by edit similarity of normalised names, with a bonus where the departments agree."""
    n = names.select("name", "film", "department").where("name is not null").distinct().withColumn("a", T.normalise(F.col("name")))
    c = credits.select(F.col("film").alias("_f"), "person", F.col("department").alias("_d")).where("person is not null").distinct().withColumn("b", T.normalise(F.col("person")))
    # A film's credits are few: names meet those of their film alone.
    pairs = n.join(c, n["film"] == c["_f"]).withColumn("alike", T.levenshtein_similarity(F.col("a"), F.col("b"))).where(F.col("alike") >= least)
    same = F.coalesce(F.col("department") == F.col("_d"), F.lit(False))
    scored = pairs.withColumn("score", F.least(F.lit(1.0), F.col("alike") + F.when(same, bonus).otherwise(0.0)))
    r = F.row_number().over(W.partitionBy("name", "film", "department").orderBy(F.desc("score"), "person", "_d"))
    return scored.withColumn("r", r).where("r = 1").select("name", "film", "person", F.col("_d").alias("department"), "score", T.match_status(F.col("score")).alias("status"))


def match_names(names: DataFrame, reference: DataFrame, least: float = 0.7, k: int = 4) -> DataFrame:
    """name, candidate, score, rank: each distinct name's k most similar other candidates, by edit similarity, however low.

    Candidates of `least` or more are found by the keys of `text_join`. Only names with fewer than k of those are compared with
    all candidates, block by block, without a broadcast."""
    n, c = names.select("name").where("name is not null").distinct(), reference.select("candidate").where("candidate is not null").distinct()
    score = T.levenshtein_similarity(F.col("name"), F.col("candidate"))
    near = cut(J.similar_strings(n, c, least).where("a != b").select(F.col("a").alias("name"), F.col("b").alias("candidate"), "score"))
    full = near.groupBy("name").agg(F.count("*").alias("n")).where(F.col("n") >= k).select("name")
    rest = n.join(full, "name", "left_anti").hint("shuffle_replicate_nl").crossJoin(c).where("name != candidate").withColumn("score", score)
    r = F.row_number().over(W.partitionBy("name").orderBy(F.desc("score"), "candidate"))
    return near.join(full, "name", "left_semi").union(rest).withColumn("rank", r).where(F.col("rank") <= k)


def pattern_scores(df: DataFrame, id: str, text: str, patterns: dict[str, list[str]], penalty: float = 0.3) -> DataFrame:
    """<id>, type, score: share of a type's words that a text holds, less `penalty` of the best other type's share."""
    low = F.lower(F.coalesce(text, F.lit("")))
    share = {t: sum((F.contains(low, F.lit(w)).cast("int") for w in ws), F.lit(0)) / len(ws) for t, ws in patterns.items()}
    rows = F.array(*[F.struct(F.lit(t).alias("type"), (s - penalty * F.greatest(*[o for u, o in share.items() if u != t], F.lit(0.0))).alias("score")) for t, s in share.items()])
    return df.select(id, F.explode(rows).alias("x")).select(id, "x.type", "x.score").where("score > 0")


def allowed(relations: DataFrame, areas: DataFrame) -> DataFrame:
    """Relations whose type no area row (relation_type) allows, with the least allowed type that contains it or is contained,
    if any."""
    a = areas.select("relation_type").distinct()
    bad = relations.join(a, "relation_type", "left_anti")
    kinds = bad.select("relation_type").distinct()
    near = contained(kinds, a).toDF("relation_type", "suggestion").union(contained(a, kinds).select(F.col("y"), F.col("x")))
    return bad.join(near.groupBy("relation_type").agg(F.min("suggestion").alias("suggestion")), "relation_type", "left")


def match_artists(names: DataFrame, artists: DataFrame) -> DataFrame:
    """name, artist: the first artist entity, by name, whose text contains the name or is contained in it, both normalised.
    Both tables may be large: nothing is broadcast, however well names compress."""
    n = names.select("name").where("name is not null").distinct().withColumn("a", T.normalise_artist(F.col("name")))
    e = artists.select(F.col("name").alias("artist")).where("artist is not null").distinct().withColumn("b", T.normalise_artist(F.col("artist")))
    pairs = contained(n.select("a"), e.select("b")).toDF("a", "b").union(contained(e.select("b"), n.select("a")).select("y", "x")).distinct()
    return n.join(pairs.hint("merge"), "a").join(e.hint("merge"), "b").groupBy("name").agg(F.min("artist").alias("artist"))
