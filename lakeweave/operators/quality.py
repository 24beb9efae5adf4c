"""Quality scores, reports, votes and consensus over tables of checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Weights of fields; others weigh 0.05.
WEIGHTS = {
    "headliner": 0.20, "title": 0.10, "supporting_acts": 0.10, "venue_name": 0.15, "event_date": 0.10, "year": 0.05, "city": 0.05,
    "state": 0.05, "country": 0.05, "record_label": 0.05, "tour_name": 0.03, "promoter": 0.03, "door_time": 0.02, "show_time": 0.02,
}


def overall(checks: DataFrame, weights: dict[str, float] = WEIGHTS, penalise_unverified: bool = False, mismatch: float = 0.3, unverified: float = 0.1) -> DataFrame:
    """entity_id, score (0 to 100), status of each entity's checks (entity_id, field, confidence, status). A half is rounded up, by
    six digits of the share, so that it doesn't hang on the order in which checks are added up."""
    w = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]), F.col("field")), F.lit(0.05))
    counts = F.lit(True) if penalise_unverified else F.col("status") != "unverified"
    c = F.col("confidence")
    value = F.when(F.col("status") == "unverified", F.greatest(F.lit(0.0), c - unverified)).when(F.col("status") == "mismatch", F.greatest(F.lit(0.0), c - mismatch)).otherwise(c)
    n = lambda s: F.count_if(F.col("status") == s)
    g = checks.groupBy("entity_id").agg(F.sum(F.when(counts, w * value)).alias("a"), F.sum(F.when(counts, w)).alias("b"), n("match").alias("m"), n("partial").alias("p"), n("mismatch").alias("x"), n("unverified").alias("u"), F.count("*").alias("t"))
    status = F.when(F.col("x") > 0, "mismatch").when(F.col("p") > F.col("m"), "warning").when(F.col("u") == F.col("t"), "unverified").when(F.col("m") > 0, "validated").otherwise("warning")
    return g.select("entity_id", F.when(F.col("b") > 0, F.floor(F.round(F.col("a") / F.col("b") * 100, 6) + 0.5)).otherwise(0).cast("int").alias("score"), status.alias("status"))


def batch_statistics(scores: DataFrame) -> DataFrame:
    """One row: entities by status and by score bucket, and the mean score."""
    s = F.col("score")
    n = lambda v: F.count_if(F.col("status") == v)
    return scores.agg(
        F.count("*").alias("total"), n("validated").alias("validated"), n("warning").alias("warning"), n("mismatch").alias("mismatch"), n("unverified").alias("unverified"), F.floor(F.avg("score") + 0.5).cast("int").alias("mean_score"),
        F.count_if(s >= 90).alias("high"), F.count_if((s >= 70) & (s < 90)).alias("medium"), F.count_if((s >= 50) & (s < 70)).alias("low"), F.count_if(s < 50).alias("very_low"),
    )


def top_issues(checks: DataFrame, fields: int = 5, examples: int = 3) -> DataFrame:
    """field, n, examples of the fields with most mismatches; an entity's value counts once."""
    bad = checks.where(F.col("status") == "mismatch").dropDuplicates(["entity_id", "field", "original"])
    r = F.row_number().over(W.partitionBy("field").orderBy("original", "entity_id"))
    g = bad.withColumn("r", r).groupBy("field").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("r") <= examples, F.col("original")))), "|").alias("examples"))
    return g.orderBy(F.desc("n"), "field").limit(fields)


def recommendations(statistics: DataFrame) -> DataFrame:
    """What to do, from the one row of batch_statistics."""
    share = lambda c: F.col(c) / F.greatest(F.col("total"), F.lit(1))
    advice = F.array_compact(F.array(F.when(share("mismatch") > 0.3, "review mismatches"), F.when(share("unverified") > 0.5, "add sources"), F.when(F.col("mean_score") < 70, "raise data quality"), F.when(share("warning") > 0.2, "check partial matches")))
    return statistics.select(F.array_join(advice, "|").alias("recommendations"))


def completeness(required: list[Column], optional: list[Column]) -> Column:
    """Share of filled fields, required ones counting double."""
    filled = lambda c: (c.isNotNull() & (c.cast("string") != "")).cast("int")
    total = 2 * len(required) + len(optional)
    return (sum((2 * filled(c) for c in required), F.lit(0)) + sum((filled(c) for c in optional), F.lit(0))) / total


def product_score(missing: Column, present: Column, errors: Column) -> Column:
    """100 less 15 for each missing required field, 2 back (to 100) for each optional one, less 5 for each error."""
    return F.greatest(F.lit(0), F.least(F.lit(100), 100 - 15 * missing + 2 * present) - 5 * errors)


def consensus_categorical(votes: DataFrame, agreement: float = 0.5, strict: tuple[str, ...] = ()) -> DataFrame:
    """subject, field, value, confidence, conflict: majority of votes (subject, field, value, confidence); ties go to the
    larger total confidence, then to the lesser value; below `agreement` there is no value. A single vote on a `strict` field
    counts for nothing."""
    v = votes.groupBy("subject", "field", "value").agg(F.count("*").alias("n"), F.sum("confidence").alias("t"))
    w = W.partitionBy("subject", "field")
    r = F.row_number().over(w.orderBy(F.desc("n"), F.desc("t"), "value"))
    best = v.withColumns({"r": r, "all": F.sum("n").over(w), "kinds": F.count("*").over(w)}).where("r = 1")
    share, alone = F.col("n") / F.col("all"), F.col("field").isin(*strict) & (F.col("all") == 1)
    value = F.when((share >= agreement) & ~alone, F.col("value"))
    return best.select("subject", "field", value.alias("value"), F.when(alone, 0.0).otherwise(F.col("t") / F.col("n") * share).alias("confidence"), (F.col("kinds") > 1).alias("conflict"))


def consensus_value(votes: DataFrame, prefer_longest: bool = True, least: float = 0.3) -> DataFrame:
    """subject, field, value, confidence, conflict of scalar votes: agreement takes the most confident; a conflict takes the
    longest value at 0.8 of its confidence if that is `least` or more, else the most confident at 0.7."""
    key = F.trim(F.regexp_replace(F.lower("value"), r"\s+", " "))
    g = votes.groupBy("subject", "field").agg(
        F.count_distinct(key).alias("kinds"),
        F.max(F.struct("confidence", F.col("value"))).alias("best"),
        F.max(F.struct(F.length("value").alias("n"), "confidence", F.col("value"))).alias("long"),
    )
    longest = F.lit(prefer_longest) & (F.col("long.confidence") >= least)
    value = F.when((F.col("kinds") > 1) & longest, F.col("long.value")).otherwise(F.col("best.value"))
    conf = F.when(F.col("kinds") == 1, F.col("best.confidence")).when(longest, F.col("long.confidence") * 0.8).otherwise(F.col("best.confidence") * 0.7)
    return g.select("subject", "field", value.alias("value"), conf.alias("confidence"), (F.col("kinds") > 1).alias("conflict"))


def overall_of_fields() -> Column:
    """0.6 of the mean confidence of a subject's fields + 0.4 of the share without conflict, as an aggregate."""
    return (F.avg("confidence") * 0.6 + F.avg((~F.col("conflict")).cast("int")) * 0.4).alias("confidence")


def overall_confidence(fields: DataFrame) -> DataFrame:
    """subject, confidence: the overall one of its fields."""
    return fields.groupBy("subject").agg(overall_of_fields())


def fuzzy_best(names: DataFrame, reference: DataFrame, score, block, k: int = 4) -> DataFrame:
    """name, candidate, score, rank: each distinct name's k best reference rows among those of the same block key (an array of
    keys; a pair meets once). `score(a, b)` is any column function. Values, not rows, are compared."""
    n = names.select("name").where("name is not null").distinct()
    c = reference.select("candidate").where("candidate is not null").distinct()
    pairs = n.withColumn("_b", F.explode(block(F.col("name")))).join(c.withColumn("_b", F.explode(block(F.col("candidate")))), "_b").select("name", "candidate").distinct()
    scored = pairs.withColumn("score", score(F.col("name"), F.col("candidate")))
    r = F.row_number().over(W.partitionBy("name").orderBy(F.desc("score"), "candidate"))
    return scored.withColumn("rank", r).where(F.col("rank") <= k)


#: User-registered rules of areas: area -> name -> column function of a DataFrame.
_rules: dict[str, dict] = {}


def register_rule(area: str, name: str, rule) -> None:
    _rules.setdefault(area, {})[name] = rule


def apply_rules(df: DataFrame, area: str) -> DataFrame:
    """`df` with broken: the registered rules of the area that a row breaks, in one select."""
    from .tables import audit_rows

    return audit_rows(df, {n: r(df) for n, r in _rules.get(area, {}).items()}).withColumnRenamed("faults", "broken")
