"""Versioned tables: history from change logs, views as of a time, merges of batches, audits."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def history(changes: DataFrame, key: str, at: str, order: list[str], value: str) -> DataFrame:
    """key, value, version, valid_from, valid_to from an ordered change log. One shuffle by key."""
    w = W.partitionBy(key).orderBy(*order)
    return changes.select(key, F.col(value).alias("value"), F.row_number().over(w).alias("version"), F.col(at).alias("valid_from"), F.lead(at).over(w).alias("valid_to"))


def latest(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The last row of each key."""
    r = F.row_number().over(W.partitionBy(key).orderBy(*order))
    return df.withColumn("_r", r).where("_r = 1").drop("_r")


def as_of(df: DataFrame, t: Column | int) -> DataFrame:
    """Rows valid at t: from valid_from on, before valid_to."""
    t = t if isinstance(t, Column) else F.lit(t)
    return df.where((F.col("valid_from") <= t) & (F.col("valid_to").isNull() | (F.col("valid_to") > t)))


def as_of_each(df: DataFrame, times: DataFrame, bucket_ms: int) -> DataFrame:
    """Rows valid at each of many times (column t): an equi join on time buckets with the exact condition, so that no row
    meets every time. Validity is cut at the last time."""
    b = lambda c: F.floor(c / bucket_ms)
    last = times.agg(F.max("t").alias("last"), F.min("t").alias("least"))
    spans = df.join(F.broadcast(last)).where("valid_from <= last")
    spans = spans.withColumn("_b", F.explode(F.sequence(b(F.greatest("valid_from", "least")), b(F.greatest(F.least(F.coalesce("valid_to", "last"), F.col("last")), F.col("valid_from"), F.col("least"))))))
    hit = spans.join(times.withColumn("_b", b(F.col("t"))), "_b")
    return hit.where("valid_from <= t and (valid_to is null or valid_to > t)").drop("_b", "last", "least")


def decayed(relations: DataFrame, now: int, half_life_days: float = 30, floor: float = 0.1) -> DataFrame:
    """Confidence decayed with age, not below `floor`; rows without confidence keep null."""
    age = F.greatest(F.lit(now) - F.col("valid_from"), F.lit(0))
    k = math.log(0.5) / (half_life_days * 86_400_000)
    return relations.withColumn("decayed", F.when(F.col("confidence").isNotNull(), F.greatest(F.lit(floor), F.col("confidence") * F.exp(age * k))))


def chain_audit(df: DataFrame, key: str) -> DataFrame:
    """key and the faults of its versions: gaps, overlaps, more than one open row, versions out of order."""
    w = W.partitionBy(key).orderBy("version")
    marked = df.select(key, "version", "valid_from", "valid_to", F.lag("version").over(w).alias("pv"), F.lag("valid_to").over(w).alias("pt"), F.lag("valid_from").over(w).alias("pf"))
    return (
        marked.groupBy(key)
        .agg(
            F.count_if(F.col("pv").isNotNull() & (F.col("version") != F.col("pv") + 1)).alias("version_gaps"),
            F.count_if(F.col("pv").isNotNull() & (F.col("pt").isNull() | (F.col("pt") > F.col("valid_from")))).alias("n_overlaps"),
            F.count_if(F.col("pt") < F.col("valid_from")).alias("time_gaps"),
            F.count_if(F.col("valid_to").isNull()).alias("open_rows"),
            F.count_if(F.col("pf") > F.col("valid_from")).alias("backwards"),
        )
        .where("version_gaps > 0 or n_overlaps > 0 or time_gaps > 0 or open_rows != 1 or backwards > 0")
    )


def insert_new(existing: DataFrame, batch: DataFrame, key: str, now: int) -> tuple[DataFrame, DataFrame]:
    """(rows to append, keys skipped): keys without an open row get version 1; the others are reported. A key that the
    batch repeats is inserted once."""
    live = existing.where("valid_to is null").select(key).distinct()
    fresh = batch.dropDuplicates([key]).join(live, key, "left_anti")
    added = fresh.withColumns({"version": F.lit(1), "valid_from": F.lit(now).cast("long"), "valid_to": F.lit(None).cast("long")})
    return added, batch.join(live, key, "left_semi").select(key).distinct()


def merge_relations(existing: DataFrame, batch: DataFrame, now: int) -> DataFrame:
    """Insert relations, or raise the version of an open row of the same (src, dst, relation_type) and take what is new of
    strength and confidence. Both endpoints are the caller's to check (endpoints_exist)."""
    key = ["src", "dst", "relation_type"]
    b = batch.dropDuplicates(key).select(*key, F.col("strength").alias("_s"), F.col("confidence").alias("_c"), F.lit(True).alias("_new"))
    live = existing.where("valid_to is null")
    j = live.withColumn("_old", F.lit(True)).join(b, key, "full")
    merged = j.select(
        *key,
        F.coalesce("_s", "strength").alias("strength"),
        F.coalesce("_c", "confidence").alias("confidence"),
        F.when(F.col("_old") & F.col("_new"), F.col("version") + 1).when(F.col("_old"), F.col("version")).otherwise(1).alias("version"),
        F.coalesce("valid_from", F.lit(now).cast("long")).alias("valid_from"),
        "valid_to",
    )
    return merged.unionByName(existing.where("valid_to is not null").select(*merged.columns))


def endpoints_exist(relations: DataFrame, entities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(relations with both ends among the open entities, the others)."""
    n = entities.where("valid_to is null").select("name").distinct()
    marked = relations.join(n.select(F.col("name").alias("src"), F.lit(True).alias("_a")), "src", "left").join(n.select(F.col("name").alias("dst"), F.lit(True).alias("_b")), "dst", "left")
    ok = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    back = [*relations.columns]
    return marked.where(ok).select(*back), marked.where(~ok).select(*back)


def apply_observations(entities: DataFrame, changes: DataFrame, now: int) -> DataFrame:
    """changes: name, added, removed (arrays). Open rows that really change are closed at `now`; a next version opens."""
    c = changes.groupBy("name").agg(F.array_distinct(F.flatten(F.collect_list("added"))).alias("_add"), F.array_distinct(F.flatten(F.collect_list("removed"))).alias("_del"))
    j = entities.join(c, "name", "left")
    kept = F.filter("observations", lambda o: ~F.array_contains(F.coalesce("_del", F.array().cast("array<string>")), o))
    new = F.concat(kept, F.array_except(F.coalesce("_add", F.array().cast("array<string>")), kept))
    j = j.withColumn("_new", F.when(F.col("valid_to").isNull(), new).otherwise(F.col("observations")))
    j = j.withColumn("_changed", F.col("valid_to").isNull() & (F.col("_new") != F.col("observations")))
    closed = j.withColumn("valid_to", F.when(F.col("_changed"), F.lit(now)).otherwise(F.col("valid_to"))).select(*entities.columns)
    opened = j.where("_changed").withColumns({"observations": F.col("_new"), "version": F.col("version") + 1, "valid_from": F.lit(now).cast("long")}).select(*entities.columns)
    return closed.unionByName(opened)


def soft_delete(df: DataFrame, keys: DataFrame, on: list[str], now: int) -> DataFrame:
    """Open rows of the given keys end at `now`."""
    k = keys.select(*on).distinct().withColumn("_gone", F.lit(True))
    return df.join(k, on, "left").withColumn("valid_to", F.when(F.col("_gone") & F.col("valid_to").isNull(), F.lit(now).cast("long")).otherwise(F.col("valid_to"))).select(*df.columns)


def hard_delete(entities: DataFrame, relations: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All versions of the named entities go, with their relations."""
    n = names.select("name").distinct()
    left = relations.join(n.withColumnRenamed("name", "src"), "src", "left_anti").join(n.withColumnRenamed("name", "dst"), "dst", "left_anti")
    return entities.join(n, "name", "left_anti"), left.select(*relations.columns)
