"""Queries over the derived graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators.strong import only_met
from ..sources.scratch import cut, drop
from .derived import ENT, REL, entities, relations
from .registry import plan, table

WITH = f"WITH {ENT}, {REL}"
UND = "und AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM relations WHERE src <> dst), adj AS (SELECT a AS u, b AS v FROM und UNION ALL SELECT b, a FROM und)"

#: The entities that two-hop listings are asked for: those whose number is divisible by 50.
ASKED = "asked AS (SELECT name FROM entities WHERE CAST(split_part(name, '_', 2) AS BIGINT) % 50 = 0)"


def _asked(spark, d):
    return entities(spark, d).where(F.expr("cast(split_part(name, '_', 2) as bigint) % 50 = 0")).select("name")


@plan(f"{WITH} SELECT 'entity' AS kind, entity_type AS type, count(*) AS n FROM entities GROUP BY ALL UNION ALL SELECT 'relation', relation_type, count(*) FROM relations GROUP BY ALL")
def agg1_type_distribution(spark, d):
    e = entities(spark, d).groupBy(F.lit("entity").alias("kind"), F.col("entity_type").alias("type")).agg(F.count("*").alias("n"))
    return e.unionByName(relations(spark, d).groupBy(F.lit("relation").alias("kind"), F.col("relation_type").alias("type")).agg(F.count("*").alias("n")))


@plan(f"{WITH} SELECT n, r, round(r / (n * (n - 1)), 12) AS density, round(2 * r / n, 6) AS average_connections FROM (SELECT count(*)::DOUBLE AS n FROM entities), (SELECT count(*)::DOUBLE AS r FROM relations)")
def agg2_totals(spark, d):
    n = entities(spark, d).agg(F.count("*").cast("double").alias("n"))
    return n.join(F.broadcast(relations(spark, d).agg(F.count("*").cast("double").alias("r")))).select("n", "r", F.round(G.density(F.col("n"), F.col("r")), 12).alias("density"), F.round(2 * F.col("r") / F.col("n"), 6).alias("average_connections"))


_COUNTS = "counts AS (SELECT e.name, count(x.name) AS connections FROM entities e LEFT JOIN (SELECT src AS name FROM relations UNION ALL SELECT dst FROM relations) x ON x.name = e.name GROUP BY e.name)"


@plan(f"{WITH}, {_COUNTS} SELECT name, connections FROM counts ORDER BY connections DESC, name LIMIT 10")
def agg3_top_connected(spark, d):
    return G.connection_counts(entities(spark, d), relations(spark, d)).orderBy(F.desc("connections"), "name").limit(10)


@plan(f"{WITH}, {_COUNTS} SELECT name FROM counts WHERE connections = 0")
def agg3_isolated(spark, d):
    return G.connection_counts(entities(spark, d), relations(spark, d)).where("connections = 0").select("name")


@plan(f"{WITH}, {_COUNTS} SELECT name, connections FROM counts ORDER BY connections DESC, name LIMIT 25")
def srt1_top_connected(spark, d):
    return G.connection_counts(entities(spark, d), relations(spark, d)).orderBy(F.desc("connections"), "name").limit(25)


@plan(f"""{WITH} SELECT name, entity_type, coalesce(i, 0) AS in_degree, coalesce(o, 0) AS out_degree, coalesce(i, 0) + coalesce(o, 0) AS total_degree, len(observations) AS n_observations
FROM entities LEFT JOIN (SELECT src AS name, count(*) AS o FROM relations GROUP BY 1) USING (name) LEFT JOIN (SELECT dst AS name, count(*) AS i FROM relations GROUP BY 1) USING (name)""")
def gr1_degrees(spark, d):
    return G.degrees(entities(spark, d), relations(spark, d))


@plan(f"""{WITH}, items AS (SELECT DISTINCT src AS name, 'out' AS direction, relation_type || '>' || dst AS item FROM relations UNION SELECT dst, 'in', relation_type || '>' || src FROM relations),
ranked AS (SELECT *, row_number() OVER (PARTITION BY name, direction ORDER BY item) AS r FROM items)
SELECT name, direction, string_agg(item, '|' ORDER BY item) AS items FROM ranked WHERE r <= 10 GROUP BY ALL""")
def gr2_neighbours(spark, d):
    return G.neighbours(relations(spark, d))


@plan(f"""{WITH}, {UND}, {ASKED}
SELECT x.u AS a, y.v AS c, min(x.v) AS via FROM asked JOIN adj x ON x.u = asked.name JOIN adj y ON x.v = y.u WHERE x.u <> y.v
AND NOT EXISTS (SELECT 1 FROM adj z WHERE z.u = x.u AND z.v = y.v) GROUP BY x.u, y.v""")
def gr3_two_hops(spark, d):
    return G.two_hops(relations(spark, d), _asked(spark, d))


@plan(f"{WITH}, {_COUNTS} SELECT name, connections AS degree, round(connections / ((SELECT count(*) FROM entities) - 1), 10) AS normalised FROM counts")
def gr4_degree_centrality(spark, d):
    return G.degree_centrality(entities(spark, d), relations(spark, d)).withColumn("normalised", F.round("normalised", 10))


def _levels(depth: int) -> str:
    before = lambda k: " UNION ALL ".join(f"SELECT * FROM d{i}" for i in range(k))
    return ", ".join(f"d{k} AS MATERIALIZED (SELECT DISTINCT target, u AS node FROM d{k - 1} JOIN adj ON v = node EXCEPT ({before(k)}))" for k in range(1, depth + 1))


_BFS = f"""WITH {REL}, {UND}, d0 AS (SELECT 'supplier_' || s_suppkey AS target, 'supplier_' || s_suppkey AS node FROM supplier WHERE s_suppkey <= 20), {_levels(4)},
dist AS ({" UNION ALL ".join(f"SELECT node, {k} AS distance, count(*) AS n FROM d{k} GROUP BY node" for k in range(1, 5))})"""


def _distances(spark, d):
    """Of every entity to the first 20 suppliers, as the closeness report samples its targets."""
    targets = table(spark, d, "supplier").where("s_suppkey <= 20").select(F.concat(F.lit("supplier_"), F.col("s_suppkey").cast("string")))
    return G.distances_to_targets(relations(spark, d), targets, 4).where("distance > 0")


@plan(f"{_BFS} SELECT node AS name, sum(n)::BIGINT AS reached, round(sum(n) / sum(n * distance), 8) AS closeness FROM dist GROUP BY node")
def gr5_closeness(spark, d):
    n = F.sum("n")
    return _distances(spark, d).groupBy(F.col("node").alias("name")).agg(n.alias("reached"), F.round(n / F.sum(F.col("n") * F.col("distance")), 8).alias("closeness"))


@plan(f"{_BFS} SELECT node AS name, round(sum(n * distance) / sum(n), 8) AS mean_distance, max(distance) AS eccentricity, sum(n)::BIGINT AS reachable FROM dist GROUP BY node")
def gr6_path_metrics(spark, d):
    mean = F.round(F.sum(F.col("n") * F.col("distance")) / F.sum("n"), 8)
    return _distances(spark, d).groupBy(F.col("node").alias("name")).agg(mean.alias("mean_distance"), F.max("distance").alias("eccentricity"), F.sum("n").alias("reachable"))


@plan(f"{_BFS} SELECT round(sum(n * distance) / sum(n), 8) AS average_path_length, sum(n)::BIGINT AS pairs FROM dist")
def gr7_average_path(spark, d):
    return _distances(spark, d).agg(F.round(F.sum(F.col("n") * F.col("distance")) / F.sum("n"), 8).alias("average_path_length"), F.sum("n").alias("pairs"))


_LABELS = ", ".join(f"l{k} AS MATERIALIZED (SELECT x.node, least(any_value(x.component), min(y.component)) AS component FROM l{k - 1} x JOIN adj ON u = x.node JOIN l{k - 1} y ON y.node = v GROUP BY x.node)" for k in range(1, 13))


@plan(f"WITH {REL}, {UND}, l0 AS (SELECT DISTINCT u AS node, u AS component FROM adj), {_LABELS} SELECT node, component FROM l12")
def gr8_components(spark, d):
    """Of the whole graph. Strong components are reported equal to weak ones."""
    return G.components(relations(spark, d))


@plan(f"""WITH {ENT}, {REL}, {UND}, deg AS (SELECT u AS name, count(*) AS d FROM adj GROUP BY u),
tri AS (SELECT x.a AS p, x.b AS q, y.b AS r FROM und x JOIN und y ON x.b = y.a JOIN und z ON z.a = x.a AND z.b = y.b),
t AS (SELECT name, count(*) AS t FROM (SELECT p AS name FROM tri UNION ALL SELECT q FROM tri UNION ALL SELECT r FROM tri) GROUP BY name)
SELECT name, coalesce(t, 0) AS triangles, coalesce(d * (d - 1) // 2, 0) AS possible, round(CASE WHEN d > 1 THEN coalesce(t, 0) / (d * (d - 1) // 2) ELSE 0 END, 10) AS coefficient
FROM entities LEFT JOIN deg USING (name) LEFT JOIN t USING (name)""")
def gr9_clustering(spark, d):
    return G.clustering(entities(spark, d), relations(spark, d)).withColumn("coefficient", F.round("coefficient", 10))


@plan(f"""{WITH}, {UND}, {ASKED},
two AS (SELECT DISTINCT x.u AS a, y.v AS c FROM asked JOIN adj x ON x.u = asked.name JOIN adj y ON x.v = y.u WHERE x.u <> y.v AND NOT EXISTS (SELECT 1 FROM adj z WHERE z.u = x.u AND z.v = y.v)),
c AS (SELECT name, coalesce(p.n, 0) AS direct, coalesce(q.n, 0) AS indirect FROM asked LEFT JOIN (SELECT u AS name, count(*) AS n FROM adj GROUP BY u) p USING (name) LEFT JOIN (SELECT a AS name, count(*) AS n FROM two GROUP BY a) q USING (name))
SELECT *, CASE WHEN indirect > 0 THEN 2 WHEN direct > 0 THEN 1 ELSE 0 END AS radius FROM c""")
def gr10_influence(spark, d):
    return G.influence(_asked(spark, d), cut(relations(spark, d)))


@plan(f"""{WITH} SELECT src AS u, dst AS v, relation_type, strength AS weight, true AS forward FROM relations WHERE relation_type IN ('IN_REGION', 'LOCATED_IN')
UNION ALL SELECT dst, src, relation_type, strength, false FROM relations WHERE relation_type IN ('IN_REGION', 'LOCATED_IN')""")
def gr11_adjacency(spark, d):
    return G.adjacency(relations(spark, d, ("IN_REGION", "SUPPLIER_IN", "CUSTOMER_IN")), include=["IN_REGION", "LOCATED_IN"], weighted=True)


_PATHS = f"""WITH {REL}, {UND},
ends AS (SELECT 'supplier_' || a.s_suppkey AS source, 'supplier_' || b.s_suppkey AS target FROM supplier a JOIN supplier b ON b.s_suppkey = a.s_suppkey + 1),
h1 AS (SELECT source, target, [source, v] AS p, v AS node FROM ends JOIN adj ON u = source),
h2 AS MATERIALIZED (SELECT source, target, list_append(p, v) AS p, v AS node FROM h1 JOIN adj ON u = node WHERE node <> target AND NOT list_contains(p, v)),
g1 AS (SELECT source, target, [v, target] AS p, v AS node FROM ends JOIN adj ON u = target),
short AS MATERIALIZED (SELECT source, target, p AS path FROM h1 WHERE node = target UNION ALL SELECT source, target, h1.p || g1.p[2:] FROM h1 JOIN g1 USING (source, target, node)
  UNION ALL SELECT source, target, h2.p || g1.p[2:] FROM h2 JOIN g1 USING (source, target, node)),
open AS MATERIALIZED (SELECT source, target FROM ends ANTI JOIN (SELECT source, target FROM short GROUP BY source, target HAVING count(*) >= 10) USING (source, target)),
g2 AS MATERIALIZED (SELECT source, target, list_prepend(v, p) AS p, v AS node FROM g1 JOIN open USING (source, target) JOIN adj ON u = node WHERE node <> source AND NOT list_contains(p, v)),
met AS (SELECT * FROM short UNION ALL SELECT source, target, h2.p || g2.p[2:] FROM h2 JOIN g2 USING (source, target, node) WHERE h2.p[2] <> g2.p[2]),
found AS (SELECT source, target, path, len(path) - 1 AS length, row_number() OVER (PARTITION BY source, target ORDER BY len(path), array_to_string(path, '>')) AS rank FROM met),
paths AS MATERIALIZED (SELECT * FROM found WHERE rank <= 10)"""


def _paths(spark, d, r=None):
    """Between each supplier and the next one."""
    s = table(spark, d, "supplier").select("s_suppkey")
    name = lambda c: F.concat(F.lit("supplier_"), c.cast("string"))
    pairs = s.select(F.col("s_suppkey").alias("a")).join(s.select((F.col("s_suppkey") - 1).alias("a"), F.col("s_suppkey").alias("b")), "a").select(name(F.col("a")), name(F.col("b")))
    return G.simple_paths(relations(spark, d) if r is None else r, pairs, depth=4)


@plan(f"{_PATHS} SELECT source, target, array_to_string(path, '>') AS path, length, rank FROM paths")
def gr12_paths(spark, d):
    return _paths(spark, d).withColumn("path", F.array_join("path", ">"))


_COSTS = ", ".join(f"c{k} AS MATERIALIZED (SELECT source, node, min(cost) AS cost FROM (SELECT * FROM c{k - 1} UNION ALL SELECT source, v, cost + w FROM c{k - 1} JOIN adj ON u = node) GROUP BY source, node)" for k in range(1, 5))


@plan(f"""WITH {REL}, adj AS (SELECT u, v, min(w) AS w FROM (SELECT src AS u, dst AS v, strength AS w FROM relations UNION ALL SELECT dst, src, strength FROM relations) GROUP BY u, v),
c0 AS (SELECT 'region_' || r_regionkey AS source, 'region_' || r_regionkey AS node, 0.0::DOUBLE AS cost FROM region), {_COSTS}
SELECT source, node, round(cost, 8) AS cost FROM c4""")
def gr13_cheapest(spark, d):
    starts = table(spark, d, "region").select(F.concat(F.lit("region_"), F.col("r_regionkey").cast("string")))
    return G.cheapest_costs(relations(spark, d), starts, 4).withColumn("cost", F.round("cost", 8))


@plan(f"""{_PATHS}, steps AS (SELECT source, target, rank, unnest(range(1, len(path))) AS step, path FROM paths)
SELECT s.source, s.target, s.rank, step::INT AS step, path[step] AS step_from, path[step + 1] AS step_to, min(r.relation_type) AS relation_type, bool_or(r.src = path[step]) AS forward
FROM steps s JOIN relations r ON (r.src = path[step] AND r.dst = path[step + 1]) OR (r.dst = path[step] AND r.src = path[step + 1]) GROUP BY ALL""")
def gr14_path_details(spark, d):
    r = cut(relations(spark, d))
    steps = _paths(spark, d, r).select("source", "target", "rank", "path", F.explode(F.expr("sequence(1, size(path) - 1)")).alias("step"))
    steps = steps.select("source", "target", "rank", "step", F.expr("path[step - 1]").alias("step_from"), F.expr("path[step]").alias("step_to"))
    steps = cut(steps.withColumns({"a": F.least("step_from", "step_to"), "b": F.greatest("step_from", "step_to")}))
    e = only_met(r.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "relation_type", "src"), steps, steps.count(), "a", "b")
    met = cut(steps.join(e, ["a", "b"]).groupBy("source", "target", "rank", "step", "step_from", "step_to").agg(F.min("relation_type").alias("relation_type"), F.bool_or(F.col("src") == F.col("step_from")).alias("forward")))
    drop(r, steps)
    return met


@plan(f"""{_PATHS} SELECT node, count(*) AS n_paths, count(DISTINCT source || '>' || target) AS n_pairs FROM (SELECT source, target, unnest(path[2:-2]) AS node FROM paths) GROUP BY node""")
def gr15_intermediates(spark, d):
    inner = _paths(spark, d).where("length > 1").select("source", "target", F.explode(F.expr("slice(path, 2, size(path) - 2)")).alias("node"))
    return inner.groupBy("node").agg(F.count("*").alias("n_paths"), F.countDistinct(F.concat_ws(">", "source", "target")).alias("n_pairs"))


@plan(f"{_PATHS} SELECT node, count(*) AS n_paths FROM (SELECT unnest(path[2:-2]) AS node FROM paths) GROUP BY node HAVING count(*) > 1 ORDER BY n_paths DESC, node LIMIT 5")
def gr15_bottlenecks(spark, d):
    """The five nodes inside most paths."""
    inner = _paths(spark, d).where("length > 1").select(F.explode(F.expr("slice(path, 2, size(path) - 2)")).alias("node"))
    return inner.groupBy("node").agg(F.count("*").alias("n_paths")).where("n_paths > 1").orderBy(F.desc("n_paths"), "node").limit(5)


@plan(f"""{_PATHS}, o AS (SELECT x.source, x.target, avg(len(list_intersect(x.path, y.path)) / greatest(len(x.path), len(y.path))) AS mean FROM paths x JOIN paths y ON x.source = y.source AND x.target = y.target AND x.rank < y.rank GROUP BY ALL)
SELECT source, target, count(*) AS n_paths, round(1 - coalesce(any_value(mean), 0), 8) AS uniqueness FROM paths LEFT JOIN o USING (source, target) GROUP BY source, target""")
def gr15_uniqueness(spark, d):
    return G.path_overlaps(cut(_paths(spark, d))).withColumn("uniqueness", F.round("uniqueness", 8))


@plan(f"{_PATHS} SELECT length, count(*) AS n FROM paths GROUP BY length")
def gr15_length_histogram(spark, d):
    return _paths(spark, d).groupBy("length").agg(F.count("*").alias("n"))


@plan(f"""{WITH}, {UND}, deg AS (SELECT u AS name, count(*) AS d FROM adj GROUP BY u),
tri AS (SELECT count(*) AS t FROM und x JOIN und y ON x.b = y.a JOIN und z ON z.a = x.a AND z.b = y.b), {_COUNTS}
SELECT (SELECT count(*) FROM entities) AS n_entities, (SELECT count(*) FROM relations) AS n_relations, (SELECT max(connections) FROM counts) AS most_connections,
(SELECT count(*) FROM counts WHERE connections = 0) AS n_isolated, (SELECT t FROM tri) AS n_triangles, (SELECT round(3 * t / (SELECT sum(d * (d - 1) // 2) FROM deg), 10) FROM tri) AS global_clustering""")
def gr16_statistics(spark, d):
    e, r = entities(spark, d), cut(relations(spark, d))
    counts = G.connection_counts(e, r).agg(F.count("*").alias("n_entities"), F.max("connections").alias("most_connections"), F.count_if(F.col("connections") == 0).alias("n_isolated"))
    c = G.clustering(e, r).agg(F.expr("sum(triangles) div 3").alias("n_triangles"), F.round(F.sum("triangles") / F.sum("possible"), 10).alias("global_clustering"))
    return counts.join(F.broadcast(r.agg(F.count("*").alias("n_relations")))).join(F.broadcast(c))


@plan(f"{WITH} SELECT r.src, r.dst, r.relation_type, a.entity_type AS src_type, b.entity_type AS dst_type FROM relations r JOIN entities a ON a.name = r.src JOIN entities b ON b.name = r.dst")
def jn1_resolve(spark, d):
    e = entities(spark, d)
    t = lambda c: e.select(F.col("name").alias(c), F.col("entity_type").alias(f"{c}_type"))
    return relations(spark, d).join(t("src"), "src").join(t("dst"), "dst").select("src", "dst", "relation_type", "src_type", "dst_type")


_PICK = "picked AS (SELECT name FROM entities WHERE entity_type IN ('customer', 'nation'))"


@plan(f"{WITH}, {_PICK} SELECT src, dst, relation_type FROM relations WHERE src IN (SELECT name FROM picked) AND dst IN (SELECT name FROM picked)")
def jn2_induced(spark, d):
    return G.induced(relations(spark, d), entities(spark, d, ("customer", "nation"))).select("src", "dst", "relation_type")


@plan(f"{WITH}, {_PICK} SELECT src, dst, relation_type FROM relations WHERE src IN (SELECT name FROM picked) OR dst IN (SELECT name FROM picked)")
def jn2_incident(spark, d):
    return G.induced(relations(spark, d), entities(spark, d, ("customer", "nation")), "incident").select("src", "dst", "relation_type")
