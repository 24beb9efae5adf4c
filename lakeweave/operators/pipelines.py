"""Compositions: all checks of a table, bulk fixes, enrichment, shows of records, search over one kind of entity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import quality as Q
from . import temporal as TM
from . import validators as V


def check_records(df: DataFrame, id: str, this_year: int | None = None) -> DataFrame:
    """entity_id, score, status of a table's records (venue_name, city, state, event_date, year, decade, door_time, show_time):
    all checks put together; a record of which nothing can be checked has no row."""
    return Q.overall(V.record_checks(df, id, this_year).withColumnRenamed(id, "entity_id"))


def apply_fixes(entities: DataFrame, fixes: DataFrame, now: int) -> tuple[DataFrame, DataFrame]:
    """(entities with a new version of each fixed one, outcome rows name, applied). fixes: name, old, new: an observation to
    replace; a fix applies where the open row holds the old one."""
    live = entities.where("valid_to is null").select("name", "observations")
    marked = fixes.join(live, "name", "left").withColumn("applied", F.coalesce(F.array_contains("observations", F.col("old")), F.lit(False)))
    changes = marked.where("applied").select("name", F.array("new").alias("added"), F.array("old").alias("removed"))
    return TM.apply_observations(entities, changes, now), marked.select("name", "applied")


def enrich(df: DataFrame, key: str, reference: DataFrame, columns: list[str]) -> DataFrame:
    """`df` with null columns filled from a reference table of the same key (one row a key), and enriched_fields."""
    r = reference.select(key, *[F.col(c).alias(f"_{c}") for c in columns]).dropDuplicates([key])
    j = df.join(r, key, "left")
    filled = F.array_compact(F.array(*[F.when(F.col(c).isNull() & F.col(f"_{c}").isNotNull(), F.lit(c)) for c in columns]))
    return j.withColumn("enriched_fields", filled).withColumns({c: F.coalesce(c, f"_{c}") for c in columns}).drop(*[f"_{c}" for c in columns])


def shows(df: DataFrame, id: str, dates: Column, year: Column) -> DataFrame:
    """<id>, number, of, date: a row for each date of a record; without readable dates, one with the year alone."""
    each = F.filter(F.transform(T.expand_dates(dates), lambda x: T.normalise_date(x)), lambda x: x.isNotNull())
    listed = F.when(F.size(each) > 0, each).when(year.isNotNull(), F.array(year.cast("string")))
    return df.select(id, listed.alias("_l")).where("_l is not null").select(id, F.size("_l").alias("of"), F.posexplode("_l").alias("_n", "date")).select(id, (F.col("_n") + 1).alias("number"), "of", "date")


def hits_with_relations(hits: DataFrame, relations: DataFrame) -> DataFrame:
    """query_id, src, dst, relation_type: relations between the hits (query_id, name) of one query."""
    h = hits.select("query_id", "name").distinct()
    return relations.join(h.withColumnRenamed("name", "src"), "src").join(h.withColumnRenamed("name", "dst"), ["query_id", "dst"]).select("query_id", "src", "dst", "relation_type")
