"""Records to graph rows: observation lines, typed fan-out, cleaning, splitting, corrections, undo."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def observation_lines(fields: dict[str, Column]) -> Column:
    """'Label: value' for each filled field."""
    return F.array_compact(F.array(*[F.when(c.isNotNull() & (c.cast("string") != ""), F.concat(F.lit(f"{k}: "), c.cast("string"))) for k, c in fields.items()]))


def fan_out(records: DataFrame, name: str, links: list[tuple[str, str, str, float]]) -> tuple[DataFrame, DataFrame]:
    """(entities name, entity_type; relations src, dst, relation_type, confidence) of records. links: (column, entity type,
    relation type, confidence); an array column gives a row each. Entities are made once."""
    parts, rels = [records.select(F.col(name).alias("name"), F.lit("record").alias("entity_type"))], []
    for column, kind, relation, confidence in links:
        many = records.schema[column].dataType.typeName() == "array"
        value = records.select(F.col(name).alias("src"), (F.explode(column) if many else F.col(column)).alias("v")).where("v is not null and v != ''")
        dst = T.slug(F.col("v"), f"{kind}_")
        rels.append(value.select("src", dst.alias("dst"), F.lit(relation).alias("relation_type"), F.lit(confidence).alias("confidence")))
        parts.append(value.select(dst.alias("name"), F.lit(kind).alias("entity_type")))
    return reduce(DataFrame.unionByName, parts).dropDuplicates(["name"]), reduce(DataFrame.unionByName, rels).distinct()


def clean_records(df: DataFrame, text_columns: list[str], date_columns: list[str]) -> DataFrame:
    """`df` with cleaned columns, and for each <c>_rejected: why a value went (commentary, length, date)."""
    out = {}
    for c in text_columns:
        out[c] = T.clean_text(F.col(c))
        out[f"{c}_rejected"] = F.when(F.col(c).isNull(), None).when(T.is_commentary(F.col(c)), "commentary").when(T.clean_text(F.col(c)).isNull(), "length")
    for c in date_columns:
        out[c] = T.normalise_date(F.col(c))
        out[f"{c}_rejected"] = F.when(F.col(c).isNotNull() & T.normalise_date(F.col(c)).isNull(), "date")
    return df.withColumns(out)


def split_validated(df: DataFrame, id: str, column: str, known: DataFrame) -> DataFrame:
    """<id>, names: the parts of a concatenated name if more than half of them are known (column name, normalised), else the
    name as it was."""
    parts = df.select(id, F.col(column).alias("_whole"), F.posexplode(T.candidate_names(F.col(column))).alias("_i", "_part"))
    hit = parts.withColumn("_n", T.normalise(F.col("_part"))).join(known.select(F.col("name").alias("_n")).distinct().withColumn("_k", F.lit(1)), "_n", "left")
    g = hit.groupBy(id).agg(F.first("_whole").alias("_whole"), F.count("*").alias("n"), F.sum(F.coalesce("_k", F.lit(0))).alias("k"), F.array_sort(F.collect_list(F.struct("_i", "_part"))).alias("p"))
    return g.select(id, F.when((F.col("n") > 1) & (F.col("k") * 2 > F.col("n")), F.transform("p", lambda x: x["_part"])).otherwise(F.array("_whole")).alias("names"))


def apply_corrections(df: DataFrame, corrections: DataFrame, id: str, columns: list[str], least: float = 0.5) -> DataFrame:
    """`df` with accepted values of corrections (<id>, field, value, confidence): the most confident one of `least` or more."""
    good = corrections.where((F.col("confidence") >= least) & F.col("field").isin(columns))
    wide = good.groupBy(id).pivot("field", columns).agg(F.max_by("value", F.struct("confidence", "value")))
    wide = wide.select(id, *[F.col(c).alias(f"_{c}") for c in columns])
    return df.join(wide, id, "left").withColumns({c: F.coalesce(f"_{c}", c) for c in columns}).drop(*[f"_{c}" for c in columns])


def fill_missing(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Null columns taken from other rows of the same keys (their most frequent value, then the least), and filled: which."""
    modes = df.groupBy(*keys).agg(*[F.mode(c, True).alias(f"_{c}") for c in columns])
    j = df.join(modes, keys, "left")
    filled = F.array_compact(F.array(*[F.when(F.col(c).isNull() & F.col(f"_{c}").isNotNull(), F.lit(c)) for c in columns]))
    return j.withColumn("filled", filled).withColumns({c: F.coalesce(c, f"_{c}") for c in columns}).drop(*[f"_{c}" for c in columns])


def infer_type(headliner: Column, supports: Column, venue: Column, date: Column, title: Column) -> Column:
    """struct(type, confidence) from a record's structure."""
    made = lambda t, c: F.struct(F.lit(t).alias("type"), F.lit(c).alias("confidence"))
    return F.when(headliner.isNotNull() & (F.size(supports) >= 2), made("festival", 0.7)).when(venue.isNotNull() & date.isNotNull() & headliner.isNotNull(), made("concert", 0.75)).when(headliner.isNotNull() & title.isNotNull(), made("album", 0.6))


def cascade_delete(entities: DataFrame, relations: DataFrame, roots: DataFrame, candidates: list[str], exempt: str = "type") -> tuple[DataFrame, DataFrame]:
    """Without the roots (column name) and their relations, and without entities of the candidate types that then have no
    relation left (the exempt type stays)."""
    r = roots.select("name").distinct()
    left = relations.join(r.withColumnRenamed("name", "src"), "src", "left_anti").join(r.withColumnRenamed("name", "dst"), "dst", "left_anti")
    ends = left.select(F.col("src").alias("name")).union(left.select("dst")).distinct()
    stay = entities.join(r, "name", "left_anti")
    orphans = stay.where(F.col("entity_type").isin(candidates) & (F.col("entity_type") != exempt)).join(ends, "name", "left_anti").select("name")
    return stay.join(orphans, "name", "left_anti"), left.select(*relations.columns)


def gate(confidence: Column, flags: Column, least: float = 0.6) -> Column:
    """process, review or reject."""
    return F.when(confidence < least - 0.1, "reject").when((confidence < least) | (F.size(flags) > 0), "review").otherwise("process")
