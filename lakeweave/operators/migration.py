"""Links from entities to their types, made from what older rows say of them: assessed first, carried out or not, and undone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Types of records, and those that stand for two.
KINDS = ("concert", "festival", "comedy", "theater", "film", "release", "promo", "exhibition", "unknown")
DOUBLE = {"hybrid": ("release", "concert")}
HAS_TYPE, SOURCE = "HAS_TYPE", "migration"


def assess(entities: DataFrame, relations: DataFrame, types: DataFrame, prefix: str, kinds: tuple[str, ...] = KINDS, double: dict[str, tuple[str, ...]] = DOUBLE) -> DataFrame:
    """name, found, targets, status of each entity (name, observations, and legacy if it has a column for the old type).

    found is the old type: legacy, else the word after 'type:' in the first observation that has one. targets are the names (prefix
    and type) among `types` (name) that it leads to, the primary one first; a word that is no type leads to unknown. status: linked
    (has a HAS_TYPE relation), untyped (nothing found), planned, or no target (no such type row). Rows without a name are left out;
    of repeated names the least found one counts. This is the dry run: nothing is written."""
    said = F.transform("observations", lambda o: F.regexp_extract(o, r"(?i)(?:poster_type|type):\s*(\w+)", 1))
    found = F.get(F.filter(said, lambda x: x != ""), F.lit(0))
    if "legacy" in entities.columns:
        found = F.coalesce(F.when(F.trim("legacy") != "", F.col("legacy")), found)
    e = entities.where("name is not null").select("name", found.alias("found")).groupBy("name").agg(F.min("found").alias("found"))
    key = F.lower(F.trim("found"))
    wanted = F.when(key.isin(*kinds), F.array(key)).otherwise(F.array(F.lit("unknown")))
    for one, many in double.items():
        wanted = F.when(key == one, F.array(*map(F.lit, many))).otherwise(wanted)
    linked = relations.where(F.col("relation_type") == HAS_TYPE).select(F.col("src").alias("name")).distinct().withColumn("_linked", F.lit(True))
    # At most as many names as there are kinds come back, so no entity is shuffled for them.
    names = [prefix + k for k in dict.fromkeys([*kinds, *[k for ks in double.values() for k in ks], "unknown"])]
    there = sorted(r.name for r in types.where(F.col("name").isin(names)).select("name").distinct().collect())
    j = e.join(linked, "name", "left")
    targets = F.when(F.col("_linked").isNull() & F.col("found").isNotNull(), F.filter(F.transform(wanted, lambda k: F.concat(F.lit(prefix), k)), lambda n: n.isin(there)))
    j = j.withColumn("targets", F.coalesce(targets, F.array().cast("array<string>")))
    status = F.when(F.col("_linked"), "linked").when(F.col("found").isNull(), "untyped").when(F.size("targets") == 0, "no target").otherwise("planned")
    return j.select("name", "found", "targets", status.alias("status"))


def statistics(assessed: DataFrame) -> DataFrame:
    """One row: total, linked, typed, untyped, doubled, no_target, links: what carrying it out would make."""
    n = lambda *s: F.count_if(F.col("status").isin(*s))
    return assessed.agg(F.count("*").alias("total"), n("linked").alias("linked"), n("planned", "no target").alias("typed"), n("untyped").alias("untyped"), F.count_if(F.size("targets") > 1).alias("doubled"), n("no target").alias("no_target"), F.coalesce(F.sum(F.size("targets")), F.lit(0)).cast("long").alias("links"))


def links(assessed: DataFrame, by: str, at: int) -> DataFrame:
    """src, dst, relation_type, confidence (0.5 for unknown), is_primary, source, inferred_by, evidence, valid_from of planned rows."""
    x = assessed.where("status = 'planned'").select("name", "found", F.posexplode("targets").alias("_i", "dst"))
    sure = F.when(F.col("found") == "unknown", 0.5).otherwise(1.0)
    return x.select(F.col("name").alias("src"), "dst", F.lit(HAS_TYPE).alias("relation_type"), sure.alias("confidence"), (F.col("_i") == 0).alias("is_primary"), F.lit(SOURCE).alias("source"), F.lit(by).alias("inferred_by"), F.concat(F.lit("type was "), F.col("found")).alias("evidence"), F.lit(at).cast("long").alias("valid_from"))


def undo(relations: DataFrame, by: str) -> DataFrame:
    """Relations without the links that `by` made; links of others and rows without a source stay."""
    made = (F.col("relation_type") == HAS_TYPE) & (F.col("source") == SOURCE) & (F.col("inferred_by") == by)
    return relations.where(~F.coalesce(made, F.lit(False)))
