"""Queries of records, components, stores and streams (the batch side) over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import records as R
from ..sources import io
from ..streaming import streams as ST
from .derived import ENT, REL, entities, relations
from .registry import plan, table


@plan("SELECT c_custkey, concat_ws('|', 'Name: ' || c_name, 'Segment: ' || c_mktsegment, CASE WHEN c_custkey % 2 = 0 THEN 'Even: yes' END) AS lines FROM customer")
def asm1_observations(spark, d):
    f = {"Name": F.col("c_name"), "Segment": F.col("c_mktsegment"), "Even": F.when(F.col("c_custkey") % 2 == 0, "yes")}
    return table(spark, d, "customer").select("c_custkey", F.array_join(R.observation_lines(f), "|").alias("lines"))


def _parts(spark, d):
    return table(spark, d, "part").select(F.concat(F.lit("part_"), F.col("p_partkey").cast("string")).alias("name"), "p_brand", F.split("p_type", " ").alias("types"))


_LINKS = [("p_brand", "brand", "MADE_BY", 0.9), ("types", "type", "HAS_TYPE", 0.6)]
_SLUG = "trim(regexp_replace(lower({}), '[^a-z0-9]+', '_', 'g'), '_')"


@plan(f"SELECT DISTINCT 'part_' || p_partkey AS src, 'brand_' || {_SLUG.format('p_brand')} AS dst, 'MADE_BY' AS relation_type, 0.9 AS confidence FROM part UNION SELECT DISTINCT 'part_' || p_partkey, 'type_' || {_SLUG.format('t')}, 'HAS_TYPE', 0.6 FROM (SELECT p_partkey, unnest(string_split(p_type, ' ')) AS t FROM part)")
def asm2_relations(spark, d):
    return R.fan_out(_parts(spark, d), "name", _LINKS)[1]


@plan(f"SELECT 'part_' || p_partkey AS name, 'record' AS entity_type FROM part UNION SELECT 'brand_' || {_SLUG.format('p_brand')}, 'brand' FROM part UNION SELECT 'type_' || {_SLUG.format('t')}, 'type' FROM (SELECT unnest(string_split(p_type, ' ')) AS t FROM part)")
def asm2_entities(spark, d):
    return R.fan_out(_parts(spark, d), "name", _LINKS)[0]


@plan("SELECT o_orderkey, type, confidence FROM (SELECT o_orderkey, unnest(CASE WHEN o_orderkey % 3 = 0 THEN ['album', 'concert'] ELSE ['concert'] END) AS type, unnest(CASE WHEN o_orderkey % 3 = 0 THEN [0.9, 0.85] ELSE [0.85] END) AS confidence FROM orders)")
def asm3_hybrid_types(spark, d):
    t = lambda n, c: F.struct(F.lit(n).alias("type"), F.lit(c).alias("confidence"))
    both = F.when(F.col("o_orderkey") % 3 == 0, F.array(t("album", 0.9), t("concert", 0.85))).otherwise(F.array(t("concert", 0.85)))
    return table(spark, d, "orders").select("o_orderkey", F.explode(both).alias("x")).select("o_orderkey", "x.type", "x.confidence")


@plan(f"WITH {ENT} SELECT name, CASE WHEN k = 'release' THEN 'album' ELSE k END AS type FROM (SELECT name, lower(split_part(substr(observations[3], 7), ' ', 1)) AS k FROM entities WHERE entity_type = 'part') WHERE NOT ends_with(name, '5')")
def asm4_backfill(spark, d):
    e = entities(spark, d, ("part",))
    have = e.where(F.col("name").endswith("5")).select("name")
    k = F.lower(F.regexp_extract(F.array_join("observations", "\n"), r"(?m)^Type: (\w+)", 1))
    return e.join(have, "name", "left_anti").select("name", F.when(k == "release", "album").otherwise(k).alias("type"))


@plan("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_name END AS c_name, CASE WHEN c_custkey % 3 = 0 THEN 'commentary' END AS c_name_rejected FROM customer")
def dq1_clean(spark, d):
    raw = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, "name not visible").otherwise(F.concat(F.lit(" "), "c_name")).alias("c_name"))
    return R.clean_records(raw, ["c_name"], [])


@plan("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_brand || '|' || p_type ELSE p_brand || ' & nobody' END AS names FROM part")
def dq2_split(spark, d):
    p = table(spark, d, "part")
    from ..functions.text import normalise

    known = p.select(normalise(F.col("p_brand")).alias("name")).union(p.select(normalise(F.col("p_type"))))
    raw = p.select("p_partkey", F.when(F.col("p_partkey") % 2 == 0, F.concat_ws(" & ", "p_brand", "p_type")).otherwise(F.concat("p_brand", F.lit(" & nobody"))).alias("x"))
    return R.split_validated(raw, "p_partkey", "x", known).select("p_partkey", F.array_join("names", "|").alias("names"))


@plan("SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'festival' WHEN c_custkey % 5 = 1 THEN 'concert' WHEN c_custkey % 5 = 2 THEN 'album' END AS type, CASE WHEN c_custkey % 5 = 0 THEN 0.7 WHEN c_custkey % 5 = 1 THEN 0.75 WHEN c_custkey % 5 = 2 THEN 0.6 END AS confidence FROM customer")
def dq5_infer(spark, d):
    k = F.col("c_custkey") % 5
    name = F.when(k < 3, F.col("c_name"))
    t = R.infer_type(name, F.when(k == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array().cast("array<string>")), F.when(k == 1, F.lit("v")), F.when(k == 1, F.lit("d")), F.when(k == 2, F.lit("t")))
    return table(spark, d, "customer").select("c_custkey", t.alias("t")).select("c_custkey", "t.type", "t.confidence")


@plan("SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'FIXED' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def dq10_corrections(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    fixes = c.where("c_custkey % 2 = 0").select("c_custkey", F.lit("c_mktsegment").alias("field"), F.lit("FIXED").alias("value"), F.when(F.col("c_custkey") % 4 == 0, 0.9).otherwise(0.4).alias("confidence"))
    return R.apply_corrections(c, fixes, "c_custkey", ["c_mktsegment"])


@plan("WITH x AS (SELECT s_suppkey, s_nationkey, CASE WHEN s_suppkey % 3 > 0 THEN n_name END AS n FROM supplier JOIN nation ON n_nationkey = s_nationkey), k AS (SELECT s_nationkey, max(n) AS m FROM x GROUP BY 1) SELECT s_suppkey, coalesce(n, m) AS n, CASE WHEN n IS NULL AND m IS NOT NULL THEN 'n' ELSE '' END AS filled FROM x JOIN k USING (s_nationkey)")
def jn16_infer_missing(spark, d):
    s = table(spark, d, "supplier").join(F.broadcast(table(spark, d, "nation")), F.col("n_nationkey") == F.col("s_nationkey"))
    x = s.select("s_suppkey", "s_nationkey", F.when(F.col("s_suppkey") % 3 > 0, F.col("n_name")).alias("n"))
    return R.fill_missing(x, ["s_nationkey"], ["n"]).select("s_suppkey", "n", F.array_join("filled", "|").alias("filled"))


@plan(f"""WITH {ENT}, {REL}, e AS (SELECT * FROM entities WHERE entity_type IN ('customer', 'nation')), r AS (SELECT * FROM relations WHERE starts_with(src, 'customer_')), gone AS (SELECT name FROM e WHERE entity_type = 'customer' AND NOT ends_with(name, '1')),
left_r AS (SELECT * FROM r WHERE src NOT IN (SELECT name FROM gone)) SELECT name, entity_type FROM e WHERE name NOT IN (SELECT name FROM gone) AND (entity_type <> 'nation' OR name IN (SELECT dst FROM left_r))""")
def jn21_cascade(spark, d):
    e = entities(spark, d, ("customer", "nation"))
    roots = e.where("entity_type = 'customer'").where(~F.col("name").endswith("1"))
    return R.cascade_delete(e, relations(spark, d, ("CUSTOMER_IN",)), roots, ["nation"])[0].select("name", "entity_type")


@plan("SELECT 'type_' || i AS instance_id, term, is_primary FROM (SELECT DISTINCT p_partkey AS i, unnest([lower(p_name)] || [lower(p_brand)]) AS term, unnest([true, false]) AS is_primary FROM part WHERE p_size > 10)")
def src9_term_index(spark, d):
    c = table(spark, d, "part").select(F.lit("part").alias("entity_type"), (F.col("p_size") > 10).alias("enabled"), F.concat(F.lit("type_"), F.col("p_partkey").cast("string")).alias("instance_id"), F.col("p_name").alias("primary_term"), F.array("p_brand").alias("synonyms"))
    return io.term_index(c).select("instance_id", "term", "is_primary")


@plan(f"WITH {ENT} SELECT name FROM entities WHERE entity_type = 'nation'")
def src10_seed(spark, d):
    return io.seed_missing(entities(spark, d, ("region", "part")), entities(spark, d, ("region", "nation"))).select("name")


@plan("SELECT vec_id AS entity_id, CASE WHEN vec_id % 2 = 0 THEN 2 ELSE 1 END AS updated_at FROM embeddings")
def snk2_upsert(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("entity_id"), "embedding", F.lit(1).alias("updated_at"))
    b = v.where("entity_id % 2 = 0").withColumn("updated_at", F.lit(2)).unionByName(v.where("entity_id % 7 = 0").withColumns({"embedding": F.slice("embedding", 1, 3), "updated_at": F.lit(9)}))
    return io.upsert_vectors(v, b, 64).select("entity_id", "updated_at")


@plan("SELECT vec_id AS entity_id FROM embeddings WHERE vec_id % 5 <> 0")
def snk3_delete(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("entity_id"))
    return io.delete_vectors(v, v.where("entity_id % 5 = 0"))


@plan("SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'page ' || page_id END AS entity_name FROM pages WHERE page_id % 4 = 0 OR page_id % 2 = 1")
def snk6_move(spark, d):
    p = table(spark, d, "pages").select("page_id")
    _, live = io.move(p.where("page_id % 2 = 0"), p.where("page_id % 2 = 1"), p.where("page_id % 4 = 0"), "page_id", F.concat(F.lit("page "), F.col("page_id").cast("string")))
    return live


@plan("WITH f AS (SELECT 'runs/' || (page_id % 9) || CASE page_id % 3 WHEN 0 THEN '/products/' WHEN 1 THEN '/categories/' ELSE '/files/' END || page_id || CASE WHEN page_id % 4 = 0 THEN '.pdf' ELSE '.json' END AS path, length(html) AS length, page_id % 9 AS r FROM pages) SELECT r::VARCHAR AS run_id, CASE WHEN count(*) FILTER (WHERE contains(path, '/products/')) > 0 AND count(*) FILTER (WHERE contains(path, '/categories/')) > 0 THEN 'FULL' ELSE 'PARTIAL' END AS kind, count(*) AS n_files, count(*) FILTER (WHERE ends_with(path, '.pdf')) AS n_pdf, sum(length) AS bytes FROM f GROUP BY r")
def src5_runs(spark, d):
    k = F.col("page_id")
    folder = F.when(k % 3 == 0, "/products/").when(k % 3 == 1, "/categories/").otherwise("/files/")
    path = F.concat(F.lit("runs/"), (k % 9).cast("string"), folder, k.cast("string"), F.when(k % 4 == 0, ".pdf").otherwise(".json"))
    return io.run_inventory(table(spark, d, "pages").select(path.alias("path"), F.length("html").alias("length")))


@plan("SELECT date_trunc('day', ts::TIMESTAMP) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def str4_rolling(spark, d):
    return ST.rolling_counts(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "event_type")


@plan("WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), g AS (SELECT user_id, ts, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e) SELECT user_id, min(ts)::TIMESTAMP AS start, count(*) AS n FROM g GROUP BY user_id, k")
def str4_sessions(spark, d):
    return ST.sessions(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "user_id")


@plan("SELECT user_id AS entity, CASE WHEN user_id % 5 = 0 THEN 'pending' WHEN user_id % 3 = 0 AND user_id % 4 < 3 THEN 'pending' WHEN user_id % 3 = 0 THEN 'failed' ELSE 'completed' END AS status, CASE WHEN user_id % 5 = 0 THEN 0 ELSE user_id % 4 END AS attempts FROM (SELECT DISTINCT user_id FROM events)")
def str3_work(spark, d):
    k = F.col("user_id")
    work = table(spark, d, "events").select("user_id").distinct().select(k.alias("entity"), F.when(k % 3 == 0, "error").otherwise("completed").alias("status"), (k % 4).cast("int").alias("attempts"), F.lit(1_000_000_000_000).alias("finished_at"))
    return ST.refresh_work(work, work.where("entity % 5 = 0"), 1_000_000_000_001).select("entity", "status", "attempts")
