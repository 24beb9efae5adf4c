"""Queries of directed components and of cheapest paths over the whole derived graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import strong as S
from .derived import FOLLOWED, REL, followed, relations
from .registry import plan, table

_NODES = "nodes AS (SELECT src AS node FROM relations UNION SELECT dst FROM relations UNION SELECT src FROM followed UNION SELECT dst FROM followed)"


# In SQL, the closure is of the only relation that can close a cycle: all others lead from orders down to regions.
@plan(f"""WITH RECURSIVE {REL}, {FOLLOWED}, {_NODES}, f AS MATERIALIZED (SELECT src AS a, dst AS b FROM followed),
reach AS (SELECT a, b FROM f UNION SELECT reach.a, f.b FROM reach JOIN f ON reach.b = f.a),
mutual AS (SELECT x.a AS node, min(x.b) AS least FROM reach x JOIN reach y ON x.a = y.b AND x.b = y.a GROUP BY x.a)
SELECT node, least(node, coalesce(least, node)) AS component FROM nodes LEFT JOIN mutual USING (node)""")
def gr8_strong_components(spark, d):
    """Of the whole graph with the parts that follow each other, which has cycles."""
    return S.strong_components(relations(spark, d).select("src", "dst").union(followed(spark, d)))


#: Rounds in which the SQL relaxes every edge; more change nothing on the tables it is run on.
_ROUNDS = 12
_FELL = ", ".join(f"c{k} AS MATERIALIZED (SELECT source, node, min(cost) AS cost FROM (SELECT * FROM c{k - 1} UNION ALL SELECT source, v, cost + w FROM c{k - 1} JOIN adj ON u = node) GROUP BY source, node)" for k in range(1, _ROUNDS + 1))
_COSTS = f"""WITH RECURSIVE {REL}, adj AS MATERIALIZED (SELECT u, v, min((round(w * 1000000)::BIGINT << 20) + 1) AS w FROM (SELECT src AS u, dst AS v, strength AS w FROM relations UNION ALL SELECT dst, src, strength FROM relations) WHERE u <> v GROUP BY u, v),
c0 AS (SELECT 'region_' || r_regionkey AS source, 'region_' || r_regionkey AS node, 0::BIGINT AS cost FROM region), {_FELL},
leads AS MATERIALIZED (SELECT x.source, x.node, x.cost, min(a.u) AS before FROM c{_ROUNDS} x LEFT JOIN (adj a JOIN c{_ROUNDS} y ON y.node = a.u) ON a.v = x.node AND y.source = x.source AND y.cost + a.w = x.cost GROUP BY ALL)"""


def _from_regions(spark, d):
    starts = table(spark, d, "region").select(F.concat(F.lit("region_"), F.col("r_regionkey").cast("string")))
    return S.cheapest(relations(spark, d).select("src", "dst", F.col("strength").alias("weight")), starts)


@plan(f"{_COSTS} SELECT source, node, round((cost >> 20) / 1000000, 6) AS cost, (cost & 1048575)::INT AS steps, before FROM leads")
def gr13_costs(spark, d):
    """From every region to every node, to convergence, with the node before."""
    return _from_regions(spark, d).withColumn("cost", F.round("cost", 6))


@plan(f"""{_COSTS}, walk AS (SELECT source, node, cost, node AS pos, [node] AS path FROM leads JOIN supplier ON node = 'supplier_' || s_suppkey
UNION ALL SELECT w.source, w.node, w.cost, l.before, list_prepend(l.before, path) FROM walk w JOIN leads l ON l.source = w.source AND l.node = w.pos WHERE w.pos <> w.source)
SELECT source, node, round((cost >> 20) / 1000000, 6) AS cost, array_to_string(path, '>') AS path FROM walk WHERE pos = source""")
def gr13_paths(spark, d):
    """Every supplier's cheapest path from each region."""
    suppliers = table(spark, d, "supplier").select(F.concat(F.lit("supplier_"), F.col("s_suppkey").cast("string")).alias("name"))
    paths = S.cheapest_paths(_from_regions(spark, d), suppliers)
    return paths.select("source", "node", F.round("cost", 6).alias("cost"), F.array_join("path", ">").alias("path"))
