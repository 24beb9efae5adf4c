"""Queries of the compositions over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import pipelines as PL
from .derived import ENT, REL, entities, relations
from .registry import plan, table

NOW = 1_000_000_000_000


@plan(f"WITH {ENT} SELECT name, ends_with(name, '2') AS applied FROM entities WHERE entity_type = 'customer' AND (ends_with(name, '2') OR ends_with(name, '3'))")
def dq9_fix_outcomes(spark, d):
    e = entities(spark, d, ("customer",)).withColumn("version", F.lit(1))
    some = e.where(F.col("name").endswith("2") | F.col("name").endswith("3"))
    fixes = some.select("name", F.when(F.col("name").endswith("2"), F.get("observations", F.lit(1))).otherwise("no such").alias("old"), F.lit("Segment: FIXED").alias("new"))
    return PL.apply_fixes(e, fixes, NOW)[1]


@plan("SELECT c_custkey, n_name AS nation, CASE WHEN c_custkey % 2 = 0 THEN 'nation' ELSE '' END AS enriched FROM customer JOIN nation ON n_nationkey = c_nationkey")
def dq11_enrich(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("nation"))
    c = table(spark, d, "customer").join(F.broadcast(n), F.col("k") == F.col("c_nationkey")).select("c_custkey", F.col("c_nationkey").alias("k"), F.when(F.col("c_custkey") % 2 == 1, F.col("nation")).alias("nation"))
    return PL.enrich(c, "k", n, ["nation"]).select("c_custkey", "nation", F.array_join("enriched_fields", "|").alias("enriched"))


@plan("""WITH o AS (SELECT o_orderkey, o_orderdate, CASE WHEN o_orderkey % 2 = 0 AND day(o_orderdate) <= 20 THEN 3 ELSE 1 END AS n FROM orders)
SELECT o_orderkey, i AS number, n AS of, CASE WHEN o_orderkey % 5 = 1 THEN year(o_orderdate)::VARCHAR ELSE strftime(o_orderdate + to_days(i - 1), '%d/%m/%Y') END AS date FROM (SELECT o_orderkey, o_orderdate, CASE WHEN o_orderkey % 5 = 1 THEN 1 ELSE n END AS n, unnest(range(1, CASE WHEN o_orderkey % 5 = 1 THEN 2 ELSE n + 1 END))::INT AS i FROM o)""")
def asm5_shows(spark, d):
    k, day = F.col("o_orderkey"), F.dayofmonth("o_orderdate")
    raw = F.when(k % 5 == 1, "someday").when((k % 2 == 0) & (day <= 20), F.concat(day.cast("string"), F.lit("-"), (day + 2).cast("string"), F.date_format("o_orderdate", " MMMM yyyy"))).otherwise(F.date_format("o_orderdate", "d MMMM yyyy"))
    return PL.shows(table(spark, d, "orders"), "o_orderkey", raw, F.year("o_orderdate"))


@plan(f"WITH {ENT}, {REL}, h AS (SELECT 1 AS query_id, name FROM entities WHERE entity_type = 'nation' UNION ALL SELECT 1, name FROM entities WHERE entity_type = 'region' UNION ALL SELECT 2, name FROM entities WHERE entity_type = 'nation') SELECT a.query_id, src, dst, relation_type FROM relations JOIN h a ON a.name = src JOIN h b ON b.name = dst AND b.query_id = a.query_id")
def jn22_hits_with_relations(spark, d):
    q = lambda kinds, n: entities(spark, d, kinds).select(F.lit(n).alias("query_id"), "name")
    return PL.hits_with_relations(q(("nation", "region"), 1).union(q(("nation",), 2)), relations(spark, d, ("IN_REGION", "SUPPLIER_IN")))


@plan(f"WITH {ENT}, {REL} SELECT src, dst, relation_type FROM relations WHERE starts_with(src, 'order_') AND CAST(split_part(src, '_', 2) AS BIGINT) % 50 = 0")
def srch6_document_graph(spark, d):
    e = entities(spark, d, ("order",)).where(F.expr("cast(split_part(name, '_', 2) as bigint) % 50 = 0"))  # the documents asked about
    return G.induced(relations(spark, d, ("PLACED_BY", "CONTAINS")), e, "incident").select("src", "dst", "relation_type")
