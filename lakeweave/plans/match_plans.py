"""Queries of matching, checks, rules and product texts over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import embedding as EM
from ..operators import matching as M
from ..operators import search as S
from .derived import ENT, entities, relations
from .registry import plan, table
from .stream_plans import vector_sql

_SCORE = "CASE WHEN a = b THEN 1.0 WHEN contains(a, b) OR contains(b, a) THEN 0.9 ELSE len(list_intersect(string_split(a, ' '), string_split(b, ' ')))::DOUBLE / len(list_distinct(string_split(a, ' ') || string_split(b, ' '))) END"


@plan(f"""WITH n AS (SELECT DISTINCT p_name || ' ' || lower(p_brand[1:5]) AS a FROM part), v AS (SELECT DISTINCT p_name AS b, p_brand AS city FROM part), s AS (SELECT a AS name, b AS venue, city, {_SCORE} AS score FROM n, v WHERE list_has_any(string_split(a, ' '), string_split(b, ' ')))
SELECT name, venue, city, round(score, 8) AS score FROM s WHERE score > 0.7 QUALIFY row_number() OVER (PARTITION BY name ORDER BY score DESC, venue, city) = 1""")
def jn14_venues(spark, d):
    p = table(spark, d, "part")
    names = p.select(F.concat_ws(" ", "p_name", F.lower(F.substring("p_brand", 1, 5))).alias("name"))
    return M.match_venues(names, p.select(F.col("p_name").alias("venue"), F.col("p_brand").alias("city")).distinct()).withColumn("score", F.round("score", 8))


_TYPED = "CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN substr(p_name, 2) ELSE replace(p_name, 'e', 'ee') END"
_COMPACT = "x AS (SELECT *, replace(title, ' ', '') AS t, replace(found, ' ', '') AS f FROM a, b)"


@plan(f"""WITH a AS (SELECT DISTINCT {_TYPED} AS title, 1990 + p_size AS year FROM part), b AS (SELECT DISTINCT p_name AS found, 1990 + p_size AS found_year FROM part), {_COMPACT},
p AS (SELECT *, CASE WHEN t = f THEN 1 WHEN contains(t, f) OR contains(f, t) THEN 0.9 ELSE 1 - levenshtein(t, f) / greatest(length(t), length(f)) END AS alike, CASE WHEN abs(year - found_year) > 1 THEN 0.7 ELSE 1.0 END AS w FROM x),
s AS (SELECT *, alike * w AS score FROM p WHERE alike >= 0.7)
SELECT title, year, found, found_year, round(score, 8) AS score, CASE WHEN w < 1 AND score >= 0.5 THEN 'partial' WHEN score >= 0.9 THEN 'match' WHEN score >= 0.7 THEN 'partial' ELSE 'mismatch' END AS status FROM s QUALIFY row_number() OVER (PARTITION BY title, year ORDER BY score DESC, found, found_year) = 1""")
def jn13_titles(spark, d):
    """Of all parts, names typed with faults against names as they are."""
    p = table(spark, d, "part").select("p_name", (F.col("p_size") + 1990).alias("y"), F.expr(_TYPED).alias("typed"))
    return M.match_titles(p.select(F.col("typed").alias("title"), F.col("y").alias("year")), p.select(F.col("p_name").alias("found"), F.col("y").alias("found_year"))).withColumn("score", F.round("score", 8))


@plan(f"""WITH n AS (SELECT DISTINCT {_TYPED} AS name, p_brand AS film, CASE WHEN p_size < 25 THEN 'Directing' ELSE 'Acting' END AS department FROM part),
c AS (SELECT DISTINCT p_name AS person, p_brand AS film, CASE WHEN p_size % 2 = 0 THEN 'Directing' ELSE 'Acting' END AS d FROM part),
s AS (SELECT n.*, person, d, 1 - levenshtein(name, person) / greatest(length(name), length(person)) AS alike FROM n JOIN c USING (film)),
t AS (SELECT *, least(1.0, alike + CASE WHEN department = d THEN 0.05 ELSE 0 END) AS score FROM s WHERE alike >= 0.7)
SELECT name, film, person, d AS department, round(score, 8) AS score, CASE WHEN score >= 0.9 THEN 'match' WHEN score >= 0.7 THEN 'partial' ELSE 'mismatch' END AS status FROM t QUALIFY row_number() OVER (PARTITION BY name, film, department ORDER BY score DESC, person, d) = 1""")
def jn13_people(spark, d):
    p = table(spark, d, "part").withColumn("typed", F.expr(_TYPED))
    names = p.select(F.col("typed").alias("name"), F.col("p_brand").alias("film"), F.when(F.col("p_size") < 25, "Directing").otherwise("Acting").alias("department"))
    credits = p.select(F.col("p_name").alias("person"), F.col("p_brand").alias("film"), F.when(F.col("p_size") % 2 == 0, "Directing").otherwise("Acting").alias("department"))
    return M.match_people(names, credits).withColumn("score", F.round("score", 8))


@plan("""WITH n AS (SELECT DISTINCT c_name AS name, lower(regexp_replace(c_name, '[^A-Za-z0-9_ ]', '', 'g')) AS a FROM customer), e AS (SELECT DISTINCT substr(c_name, 1, length(c_name) - c_custkey % 2) AS artist FROM customer),
x AS (SELECT artist, lower(regexp_replace(artist, '[^A-Za-z0-9_ ]', '', 'g')) AS b FROM e) SELECT name, min(artist) AS artist FROM n JOIN x ON contains(a, b) OR contains(b, a) GROUP BY name""")
def jn15_artists(spark, d):
    c = table(spark, d, "customer")
    known = c.select(F.expr("substr(c_name, 1, length(c_name) - cast(c_custkey % 2 as int))").alias("name"))
    return M.match_artists(c.select(F.col("c_name").alias("name")), known)


_PATTERNS = {"metal": ["steel", "brass", "tin"], "plated": ["plated", "polished"], "size": ["small", "large"]}


@plan("""WITH s AS (SELECT p_partkey, (contains(lower(p_type), 'steel')::INT + contains(lower(p_type), 'brass')::INT + contains(lower(p_type), 'tin')::INT) / 3 AS m, (contains(lower(p_type), 'plated')::INT + contains(lower(p_type), 'polished')::INT) / 2 AS p, (contains(lower(p_type), 'small')::INT + contains(lower(p_type), 'large')::INT) / 2 AS z FROM part),
r AS (SELECT p_partkey, 'metal' AS type, m - 0.3 * greatest(p, z, 0) AS score FROM s UNION ALL SELECT p_partkey, 'plated', p - 0.3 * greatest(m, z, 0) FROM s UNION ALL SELECT p_partkey, 'size', z - 0.3 * greatest(m, p, 0) FROM s) SELECT p_partkey, type, round(score, 8) AS score FROM r WHERE score > 0""")
def dq6_patterns(spark, d):
    return M.pattern_scores(table(spark, d, "part"), "p_partkey", "p_type", _PATTERNS).withColumn("score", F.round("score", 8))


@plan("SELECT 'SUPPLIED_BY' AS relation_type, count(*) AS n, 'SUPPLIED' AS suggestion FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)")
def dq13_allowed(spark, d):
    areas = relations(spark, d, ("IN_REGION",)).select("relation_type").distinct().union(table(spark, d, "region").where("r_regionkey = 0").select(F.lit("SUPPLIED")))
    return M.allowed(relations(spark, d, ("IN_REGION", "SUPPLIED_BY")), areas).groupBy("relation_type", "suggestion").agg(F.count("*").alias("n"))


@plan(f"WITH t AS (SELECT 'part_' || p_partkey AS name, 'Name: ' || p_name AS text FROM part), v AS (SELECT name, {vector_sql('text')} AS e FROM t) SELECT name, len(e) AS dim, round(e[1], 3) + 0.0 AS v1, round(e[2], 3) + 0.0 AS v2, round(e[64], 3) + 0.0 AS v64 FROM v")
def fn30_embed(spark, d):
    e = EM.embed(entities(spark, d, ("part",)).select("name", F.get("observations", F.lit(0)).alias("text")), "text")
    v = lambda i: F.round(F.get("embedding", F.lit(i)).cast("double"), 3) + 0.0
    return e.select("name", F.size("embedding").alias("dim"), v(0).alias("v1"), v(1).alias("v2"), v(63).alias("v64"))


@plan(f"WITH {ENT} SELECT query_id, vec_id AS id, name, entity_type, round(score, 6) AS score FROM (SELECT q.vec_id AS query_id, v.vec_id, list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS score FROM embeddings v JOIN embeddings q ON q.vec_id % 50 = 0 AND v.vec_id <> q.vec_id QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY score DESC, v.vec_id) <= 20) JOIN entities ON name = 'part_' || vec_id")
def vec3_similar_entities(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    hits = S.knn(v.where("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("q")), v, 20)
    return hits.withColumn("name", F.concat(F.lit("part_"), F.col("id").cast("string"))).join(entities(spark, d, ("part",)), "name").select("query_id", "id", "name", "entity_type", F.round("score", 6).alias("score"))
