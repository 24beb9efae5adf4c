"""The versioned graph that the queries work on, from the star schema; the same tables as SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import spread
from .registry import table


def _text(prefix: str, column: str) -> Column:
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


def _ms(column: str) -> Column:
    return F.unix_millis(F.col(column).cast("timestamp"))


def entities(spark: SparkSession, d: str, kinds: tuple[str, ...] = ("region", "nation", "supplier", "customer", "part", "order")) -> DataFrame:
    """name, entity_type, observations, valid_from, valid_to."""
    made = {
        "region": ("region", "r_regionkey", [("Name: ", "r_name")], F.lit(0).cast("long")),
        "nation": ("nation", "n_nationkey", [("Name: ", "n_name"), ("Region: ", "n_regionkey")], F.lit(0).cast("long")),
        "supplier": ("supplier", "s_suppkey", [("Name: ", "s_name"), ("Nation: ", "s_nationkey")], F.lit(0).cast("long")),
        "customer": ("customer", "c_custkey", [("Name: ", "c_name"), ("Segment: ", "c_mktsegment")], F.lit(0).cast("long")),
        "part": ("part", "p_partkey", [("Name: ", "p_name"), ("Brand: ", "p_brand"), ("Type: ", "p_type")], F.lit(0).cast("long")),
        "order": ("orders", "o_orderkey", [("Status: ", "o_orderstatus"), ("Priority: ", "o_orderpriority")], _ms("o_orderdate") if "order" in kinds else None),
    }
    parts = []
    for kind in kinds:
        source, key, observations, since = made[kind]
        parts.append(table(spark, d, source).select(_text(f"{kind}_", key).alias("name"), F.lit(kind).alias("entity_type"), F.array(*[_text(p, c) for p, c in observations]).alias("observations"), since.alias("valid_from"), F.lit(None).cast("long").alias("valid_to")))
    return reduce(DataFrame.unionByName, parts)


def relations(spark: SparkSession, d: str, kinds: tuple[str, ...] = ("IN_REGION", "SUPPLIER_IN", "CUSTOMER_IN", "PLACED_BY", "CONTAINS", "SUPPLIED_BY")) -> DataFrame:
    """src, dst, relation_type, strength, confidence, valid_from, valid_to. Suppliers' and customers' places are both LOCATED_IN."""

    def link(df: DataFrame, src: Column, dst: Column, kind: str, strength: Column, confidence: Column, since: Column) -> DataFrame:
        return df.select(src.alias("src"), dst.alias("dst"), F.lit(kind).alias("relation_type"), strength.alias("strength"), confidence.alias("confidence"), since.alias("valid_from"), F.lit(None).cast("long").alias("valid_to"))

    one, zero = F.lit(1.0), F.lit(0).cast("long")
    parts = []
    for kind in kinds:
        if kind == "IN_REGION":
            parts.append(link(table(spark, d, "nation"), _text("nation_", "n_nationkey"), _text("region_", "n_regionkey"), kind, one, one, zero))
        elif kind == "SUPPLIER_IN":
            parts.append(link(table(spark, d, "supplier"), _text("supplier_", "s_suppkey"), _text("nation_", "s_nationkey"), "LOCATED_IN", F.lit(0.8), F.lit(0.9), zero))
        elif kind == "CUSTOMER_IN":
            parts.append(link(table(spark, d, "customer"), _text("customer_", "c_custkey"), _text("nation_", "c_nationkey"), "LOCATED_IN", F.lit(0.7), F.lit(0.8), zero))
        elif kind == "PLACED_BY":
            parts.append(link(table(spark, d, "orders"), _text("order_", "o_orderkey"), _text("customer_", "o_custkey"), kind, one, one, _ms("o_orderdate")))
        else:
            a, b = ("l_orderkey", "l_partkey") if kind == "CONTAINS" else ("l_partkey", "l_suppkey")
            lines = table(spark, d, "lineitem")
            grouped = spread(lines, lines.count(), a, b).groupBy(a, b).agg(F.max(1 - F.col("l_discount")).alias("s"), F.max(1 - F.col("l_tax")).alias("c"), F.min(_ms("l_shipdate")).alias("v"))
            p, q = ("order_", "part_") if kind == "CONTAINS" else ("part_", "supplier_")
            parts.append(link(grouped, _text(p, a), _text(q, b), kind, F.col("s"), F.col("c"), F.col("v")))
    return reduce(DataFrame.unionByName, parts)


#: Days by which the next line has to ship later.
LATER = 1500


def followed(spark: SparkSession, d: str) -> DataFrame:
    """src, dst: a part and the part of the order's next line, where that ships LATER days after or more: edges with cycles."""
    lines = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    nxt = table(spark, d, "lineitem").select("l_partkey", F.lead("l_partkey").over(lines).alias("n"), (F.unix_date(F.lead(F.to_date("l_shipdate")).over(lines)) - F.unix_date(F.to_date("l_shipdate"))).alias("days"))
    return nxt.where(f"days >= {LATER}").select(_text("part_", "l_partkey").alias("src"), _text("part_", "n").alias("dst"))


FOLLOWED = f"""followed AS (SELECT DISTINCT 'part_' || l_partkey AS src, 'part_' || n AS dst FROM (
  SELECT l_partkey, l_shipdate, lead(l_partkey) OVER w AS n, lead(l_shipdate) OVER w AS s FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey))
  WHERE date_diff('day', l_shipdate::DATE, s::DATE) >= {LATER})"""

ENT = """entities AS (
  SELECT 'region_' || r_regionkey AS name, 'region' AS entity_type, ['Name: ' || r_name] AS observations, 0::BIGINT AS valid_from, NULL::BIGINT AS valid_to FROM region
  UNION ALL SELECT 'nation_' || n_nationkey, 'nation', ['Name: ' || n_name, 'Region: ' || n_regionkey], 0, NULL FROM nation
  UNION ALL SELECT 'supplier_' || s_suppkey, 'supplier', ['Name: ' || s_name, 'Nation: ' || s_nationkey], 0, NULL FROM supplier
  UNION ALL SELECT 'customer_' || c_custkey, 'customer', ['Name: ' || c_name, 'Segment: ' || c_mktsegment], 0, NULL FROM customer
  UNION ALL SELECT 'part_' || p_partkey, 'part', ['Name: ' || p_name, 'Brand: ' || p_brand, 'Type: ' || p_type], 0, NULL FROM part
  UNION ALL SELECT 'order_' || o_orderkey, 'order', ['Status: ' || o_orderstatus, 'Priority: ' || o_orderpriority], (epoch_us(o_orderdate::TIMESTAMP) // 1000), NULL FROM orders)"""
REL = """relations AS (
  SELECT 'nation_' || n_nationkey AS src, 'region_' || n_regionkey AS dst, 'IN_REGION' AS relation_type, 1.0::DOUBLE AS strength, 1.0::DOUBLE AS confidence, 0::BIGINT AS valid_from, NULL::BIGINT AS valid_to FROM nation
  UNION ALL SELECT 'supplier_' || s_suppkey, 'nation_' || s_nationkey, 'LOCATED_IN', 0.8, 0.9, 0, NULL FROM supplier
  UNION ALL SELECT 'customer_' || c_custkey, 'nation_' || c_nationkey, 'LOCATED_IN', 0.7, 0.8, 0, NULL FROM customer
  UNION ALL SELECT 'order_' || o_orderkey, 'customer_' || o_custkey, 'PLACED_BY', 1.0, 1.0, (epoch_us(o_orderdate::TIMESTAMP) // 1000), NULL FROM orders
  UNION ALL SELECT 'order_' || l_orderkey, 'part_' || l_partkey, 'CONTAINS', max(1 - l_discount), max(1 - l_tax), min((epoch_us(l_shipdate::TIMESTAMP) // 1000)), NULL FROM lineitem GROUP BY l_orderkey, l_partkey
  UNION ALL SELECT 'part_' || l_partkey, 'supplier_' || l_suppkey, 'SUPPLIED_BY', max(1 - l_discount), max(1 - l_tax), min((epoch_us(l_shipdate::TIMESTAMP) // 1000)), NULL FROM lineitem GROUP BY l_partkey, l_suppkey)"""
