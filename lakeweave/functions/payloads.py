"""JSON payloads as Variant values: typed columns, arrays as rows, and unreadable ones kept aside.

Null and empty payloads are neither typed nor faulty. A payload that is no JSON is a fault with its text. A field of another type
than wanted gives null in its column and a fault that names the field, so nothing is lost in silence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parsed(payload: Column) -> Column:
    """The payload as a Variant; null if it is none."""
    return F.try_parse_json(F.when(F.trim(payload) != "", payload))


def typed(df: DataFrame, payload: str, fields: dict[str, tuple[str, str]]) -> DataFrame:
    """`df` with a column for each of `fields` (name -> path and type) and faults: 'payload' if it is no JSON, the
    names of fields that are there but not of that type."""
    given = df.withColumn("_v", parsed(F.col(payload)))
    out = given.withColumns({n: F.try_variant_get("_v", path, kind) for n, (path, kind) in fields.items()})
    found = lambda path: F.try_variant_get("_v", path, "variant")
    there = lambda path: found(path).isNotNull() & ~F.is_variant_null(found(path))
    bad = [F.when(there(path) & F.col(n).isNull(), F.lit(n)) for n, (path, _) in fields.items()]
    broken = F.when(F.col("_v").isNull() & (F.trim(payload) != ""), F.lit("payload"))
    return out.withColumn("faults", F.array_compact(F.array(broken, *bad))).drop("_v")


def split_faulty(df: DataFrame, payload: str, fields: dict[str, tuple[str, str]]) -> tuple[DataFrame, DataFrame]:
    """(rows whose payload is as wanted, with typed columns; the others, as they were, with faults)."""
    t = typed(df, payload, fields)
    return t.where(F.size("faults") == 0).drop("faults"), t.where(F.size("faults") > 0).drop(*[n for n in fields if n not in df.columns])


def schema_of(df: DataFrame, payload: str) -> DataFrame:
    """One row, one column: the schema that all payloads have together, fields of several types as their common one."""
    return df.select(parsed(F.col(payload)).alias("v")).agg(F.schema_of_variant_agg("v").alias("schema"))


def items(df: DataFrame, payload: str, path: str, keep: list[str]) -> DataFrame:
    """`keep`, pos, key, value (as text): a row for each element or field of the array or object at `path`."""
    at = df.select(*keep, F.try_variant_get(parsed(F.col(payload)), path, "variant").alias("_v"))
    at.createOrReplaceTempView("_lakeweave_items")
    listed = ", ".join(f"`{k}`" for k in keep)
    return df.sparkSession.sql(f"SELECT {listed}, x.pos, x.key, CAST(x.value AS STRING) AS value FROM _lakeweave_items, LATERAL variant_explode(_v) AS x")
