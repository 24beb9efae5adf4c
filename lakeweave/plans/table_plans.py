"""Filters, joins, aggregations, windows, sorts and set merges over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import tables as O
from ..sources.scratch import spread
from .derived import ENT, REL, entities, relations
from .registry import plan, table

E = f"WITH {ENT}"


def q(sql, name=None):
    return plan(sql, name)


@q(f"{E} SELECT name, entity_type FROM entities WHERE contains(lower(name), 'green') OR contains(lower(entity_type), 'green') OR len(list_filter(observations, lambda o: contains(lower(o), 'green'))) > 0")
def flt2_keyword(spark, d):
    return O.keyword(entities(spark, d), "green").select("name", "entity_type")


@q(f"{E}, {REL}, hit AS (SELECT name FROM entities WHERE entity_type IN ('nation', 'region') AND (contains(lower(name), 'a') OR contains(lower(array_to_string(observations, '|')), 'a'))) SELECT src, dst, relation_type FROM relations WHERE src IN (SELECT name FROM hit) AND dst IN (SELECT name FROM hit)")
def flt2_keyword_relations(spark, d):
    from ..operators.graph import induced

    return induced(relations(spark, d, ("IN_REGION",)), O.keyword(entities(spark, d, ("nation", "region")), "a", ["nation", "region"])).select("src", "dst", "relation_type")


@q(f"{E}, wanted AS (SELECT 'customer_' || c_custkey AS name FROM customer WHERE c_custkey % 10 = 0 UNION ALL SELECT 'region_1') SELECT name, entity_type, array_to_string(observations, '|') AS observations FROM entities WHERE name IN (SELECT name FROM wanted)")
def flt3_open(spark, d):
    wanted = table(spark, d, "customer").where("c_custkey % 10 = 0").select(F.concat(F.lit("customer_"), F.col("c_custkey").cast("string")).alias("name"))
    wanted = wanted.union(table(spark, d, "region").where("r_regionkey = 1").select(F.lit("region_1")))
    return entities(spark, d).join(wanted, "name", "left_semi").select("name", "entity_type", F.array_join("observations", "|").alias("observations"))


@q(f"{E}, wanted AS (SELECT 'part_' || (p_partkey * 3) AS name FROM part) SELECT w.name, e.entity_type, e.name IS NOT NULL AS found FROM wanted w LEFT JOIN entities e ON e.name = w.name AND e.valid_to IS NULL")
def flt4_lookup(spark, d):
    wanted = table(spark, d, "part").select(F.concat(F.lit("part_"), (F.col("p_partkey") * 3).cast("string")).alias("name"))
    return wanted.join(entities(spark, d, ("part",)).withColumn("f", F.lit(True)), "name", "left").select("name", "entity_type", F.coalesce("f", F.lit(False)).alias("found"))


@q(f"{E} SELECT name, entity_type FROM entities WHERE entity_type = 'customer' ORDER BY name LIMIT 20 OFFSET 40")
def src3_page(spark, d):
    return O.page(entities(spark, d, ("customer",)), ["name"], 40, 20).select("name", "entity_type")


@q("SELECT count(*) AS total, 3 AS current_page, ceil(count(*) / 20)::INT AS total_pages, count(*) > 60 AS has_more FROM customer")
def flt5_page_info(spark, d):
    return O.page_info(table(spark, d, "customer"), 40, 20)


@q("SELECT c_custkey, c_mktsegment FROM customer")
def flt6_project(spark, d):
    return O.project(table(spark, d, "customer"), ["c_custkey", "no_such_field", "c_mktsegment"])


_TERMS = "SELECT DISTINCT p_brand AS term FROM part UNION SELECT DISTINCT split_part(p_name, ' ', 1) FROM part"


@q(f"""WITH terms AS ({_TERMS}), names AS (SELECT DISTINCT p_name AS name FROM part UNION SELECT DISTINCT p_brand FROM part),
g AS (SELECT name, term, replace(lower(name), '_', ' ') AS n, lower(term) AS t FROM names, terms),
m AS (SELECT name, term, CASE WHEN n = t THEN 'exact' WHEN contains(n, t) OR contains(t, n) THEN 'substring' WHEN list_has_any(string_split(n, ' '), string_split(t, ' ')) THEN 'partial' END AS kind FROM g)
SELECT name, term, kind, CASE kind WHEN 'exact' THEN 1.0 WHEN 'substring' THEN 0.9 ELSE 0.8 END AS confidence FROM m WHERE kind IS NOT NULL""")
def flt7_terms(spark, d):
    p = table(spark, d, "part")
    terms = p.select(F.col("p_brand").alias("term")).union(p.select(F.split_part("p_name", F.lit(" "), F.lit(1))))
    return O.match_terms(p.select(F.col("p_name").alias("name")).union(p.select("p_brand")), terms)


@q("SELECT c_custkey FROM customer WHERE c_acctbal > 5000 AND c_mktsegment <> 'BUILDING' AND contains(c_name, '7')")
def flt8_predicates(spark, d):
    p = [O.predicate("c_acctbal", "gt", 5000), O.predicate("c_mktsegment", "ne", "BUILDING"), O.predicate("c_name", "contains", "7")]
    return table(spark, d, "customer").where(p[0] & p[1] & p[2]).select("c_custkey")


@q("WITH m AS (SELECT event_id, '{\"kind\":\"' || event_type || '\",\"user\":\"' || (user_id % 5) || '\"}' AS meta FROM events) SELECT event_id FROM m WHERE json_extract_string(meta, '$.kind') = 'click' AND json_extract_string(meta, '$.user') = '2'")
def flt9_metadata(spark, d):
    m = table(spark, d, "events").select("event_id", F.to_json(F.struct(F.col("event_type").alias("kind"), (F.col("user_id") % 5).cast("string").alias("user"))).alias("meta"))
    return O.metadata_equals(m, "meta", {"kind": "click", "user": "2"}).select("event_id")


@q(f"WITH {REL} SELECT relation_type, count(*) FILTER (WHERE valid_to IS NULL OR valid_from <= valid_to) AS n_range, count(*) FILTER (WHERE valid_from <= 800000000000 AND (valid_to IS NULL OR valid_to >= 800000000000)) AS n_valid FROM relations GROUP BY relation_type")
def flt10_validity(spark, d):
    at = F.lit(800000000000)
    return relations(spark, d).groupBy("relation_type").agg(F.count_if(F.col("valid_to").isNull() | (F.col("valid_from") <= F.col("valid_to"))).alias("n_range"), F.count_if((F.col("valid_from") <= at) & (F.col("valid_to").isNull() | (F.col("valid_to") >= at))).alias("n_valid"))


@q(f"WITH {REL}, m AS (SELECT *, strength * 1.02 AS s FROM relations) SELECT src, dst, relation_type, array_to_string(list_filter([CASE WHEN NOT (s BETWEEN 0 AND 1) THEN 'strength' END, CASE WHEN NOT (confidence BETWEEN 0.93 AND 1) THEN 'confidence' END], lambda x: x IS NOT NULL), ',') AS faults FROM m WHERE NOT (s BETWEEN 0 AND 1) OR NOT (confidence BETWEEN 0.93 AND 1)")
def flt11_audit(spark, d):
    r = relations(spark, d).withColumn("strength", F.col("strength") * 1.02)
    bad = O.audit_rows(r, {"strength": F.col("strength").between(0, 1), "confidence": F.col("confidence").between(0.93, 1)}).where(F.size("faults") > 0)
    return bad.select("src", "dst", "relation_type", F.array_join("faults", ",").alias("faults"))


@q(f"{E} SELECT name FROM entities WHERE entity_type IN ('region', 'nation')")
def flt12_area(spark, d):
    return entities(spark, d).where(F.col("entity_type").isin("region", "nation")).select("name")


@q(f"{E} SELECT entity_type, count(*) AS n FROM entities WHERE entity_type IN ('part', 'supplier') GROUP BY entity_type")
def flt13_by_type(spark, d):
    return entities(spark, d).where(F.col("entity_type").isin("part", "supplier")).groupBy("entity_type").agg(F.count("*").alias("n"))


# Typed records: an order has its status, priority and its customer's segment as types.
TYPES = """types AS (SELECT o_orderkey, 'status_' || o_orderstatus AS type, 0.9 AS confidence FROM orders UNION ALL SELECT o_orderkey, 'priority_' || split_part(o_orderpriority, '-', 1), round((o_orderkey % 50) / 50.0, 2) FROM orders
  UNION ALL SELECT o_orderkey, 'segment_' || lower(c_mktsegment), 0.7 FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderkey % 3 = 0)"""


def _types(spark, d):
    o = table(spark, d, "orders")
    seg = o.where("o_orderkey % 3 = 0").join(table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    parts = [
        o.select("o_orderkey", F.concat(F.lit("status_"), "o_orderstatus").alias("type"), F.lit(0.9).alias("confidence")),
        o.select("o_orderkey", F.concat(F.lit("priority_"), F.split_part("o_orderpriority", F.lit("-"), F.lit(1))).alias("type"), F.round((F.col("o_orderkey") % 50) / 50.0, 2).alias("confidence")),
        seg.select("o_orderkey", F.concat(F.lit("segment_"), F.lower("c_mktsegment")).alias("type"), F.lit(0.7).alias("confidence")),
    ]
    return parts[0].union(parts[1]).union(parts[2])


@q(f"WITH {TYPES} SELECT o_orderkey, confidence FROM types WHERE type = 'segment_building' AND confidence >= 0.6 ORDER BY confidence DESC, o_orderkey")
def jn5_of_type(spark, d):
    return _types(spark, d).where("type = 'segment_building' and confidence >= 0.6").select("o_orderkey", "confidence").orderBy(F.desc("confidence"), "o_orderkey")


@q(f"WITH {TYPES} SELECT DISTINCT o_orderkey FROM types WHERE type IN ('status_F', 'segment_building') ORDER BY o_orderkey")
def jn6_of_types(spark, d):
    return _types(spark, d).where(F.col("type").isin("status_F", "segment_building")).select("o_orderkey").distinct().orderBy("o_orderkey")


@q(f"WITH {TYPES} SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM types WHERE starts_with(type, 'segment_'))")
def jn7_other(spark, d):
    return table(spark, d, "orders").select("o_orderkey").join(_types(spark, d).where(F.col("type").startswith("segment_")), "o_orderkey", "left_anti")


@q(f"WITH {TYPES} SELECT o_orderkey, type, confidence, row_number() OVER (PARTITION BY o_orderkey ORDER BY confidence DESC, type) AS rank FROM types")
def jn8_types(spark, d):
    return O.top_per_group(_types(spark, d), ["o_orderkey"], [F.desc("confidence"), "type"])


@q(f"WITH {TYPES} SELECT o_orderkey, coalesce((SELECT string_agg(type || ':' || confidence, '|' ORDER BY type) FROM types t WHERE t.o_orderkey = o.o_orderkey AND starts_with(type, 's')), '') AS types FROM orders o")
def jn9_nested(spark, d):
    t = _types(spark, d).where(F.col("type").startswith("s"))
    n = O.nested(table(spark, d, "orders").select("o_orderkey"), t, "o_orderkey", ["type", "confidence"], [F.desc("confidence")], "types")
    return n.select("o_orderkey", F.array_join(F.transform("types", lambda x: F.concat(x["type"], F.lit(":"), x["confidence"].cast("string"))), "|").alias("types"))


@q("SELECT c_custkey, string_agg(initcap_name, '|' ORDER BY initcap_name) AS suppliers FROM (SELECT DISTINCT o_custkey AS c_custkey, replace(s_name, '#', ' ') AS initcap_name FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey WHERE l_quantity > 45) GROUP BY c_custkey")
def jn10_nested_names(spark, d):
    j = table(spark, d, "lineitem").where("l_quantity > 45").join(table(spark, d, "supplier"), F.col("s_suppkey") == F.col("l_suppkey")).join(table(spark, d, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    names = j.select(F.col("o_custkey").alias("c_custkey"), F.initcap(F.regexp_replace("s_name", "#", " ")).alias("x")).distinct()
    return names.groupBy("c_custkey").agg(F.array_join(F.array_sort(F.collect_list("x")), "|").alias("suppliers"))


@q("SELECT l_suppkey, l_partkey, min(year(l_shipdate)) AS first_year, max(year(l_shipdate)) AS last_year, count(*) FILTER (WHERE year(l_shipdate) > f + 2) AS n_out FROM lineitem JOIN (SELECT l_suppkey AS k, min(year(l_shipdate)) AS f FROM lineitem GROUP BY 1) ON k = l_suppkey GROUP BY ALL")
def jn17_active_range(spark, d):
    li = table(spark, d, "lineitem").select("l_suppkey", "l_partkey", F.year("l_shipdate").alias("y"))
    f = li.groupBy("l_suppkey").agg(F.min("y").alias("f"))
    n = li.count()
    return spread(spread(li, n, "l_suppkey").join(f, "l_suppkey"), n, "l_suppkey", "l_partkey").groupBy("l_suppkey", "l_partkey").agg(F.min("y").alias("first_year"), F.max("y").alias("last_year"), F.count_if(F.col("y") > F.col("f") + 2).alias("n_out"))


@q("WITH s AS (SELECT doc_id, substr(sha256(text), 1, 16) AS hash FROM documents WHERE text IS NOT NULL), live AS (SELECT doc_id AS live_id, hash FROM s WHERE doc_id % 2 = 0), m AS (SELECT s.doc_id, min(live_id) AS live_id FROM s LEFT JOIN live USING (hash) WHERE doc_id % 2 = 1 GROUP BY 1) SELECT doc_id, live_id FROM m WHERE live_id IS NOT NULL")
def jn18_by_hash(spark, d):
    s = table(spark, d, "documents").where("text is not null").select("doc_id", F.substring(F.sha2("text", 256), 1, 16).alias("hash"))
    live = s.where("doc_id % 2 = 0").select(F.col("doc_id").alias("live_id"), "hash")
    return s.where("doc_id % 2 = 1").join(live, "hash").groupBy("doc_id").agg(F.min("live_id").alias("live_id"))


@q("SELECT CASE WHEN l.doc_id IS NOT NULL AND l.toxic = 1 THEN 'live' WHEN l.doc_id IS NOT NULL THEN 'matched' ELSE 'legacy' END AS bucket, count(*) AS n FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1")
def jn19_split(spark, d):
    j = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels").withColumn("_l", F.lit(True)), "doc_id", "left")
    b = F.when(F.col("_l") & (F.col("toxic") == 1), "live").when(F.col("_l"), "matched").otherwise("legacy")
    return j.groupBy(b.alias("bucket")).agg(F.count("*").alias("n"))


@q("SELECT page_id, url, coalesce(d.source, 'page_' || page_id) AS name FROM pages LEFT JOIN documents d ON d.doc_id = page_id * 3 ORDER BY page_id DESC")
def jn20_listing(spark, d):
    j = table(spark, d, "pages").select("page_id", "url").join(table(spark, d, "documents").select((F.col("doc_id")).alias("k"), "source"), F.col("page_id") * 3 == F.col("k"), "left")
    return j.select("page_id", "url", F.coalesce("source", F.concat(F.lit("page_"), F.col("page_id").cast("string"))).alias("name")).orderBy(F.desc("page_id"))


@q(f"WITH {TYPES} SELECT type, count(DISTINCT o_orderkey) AS n, round(avg(confidence), 6) AS mean_confidence FROM types GROUP BY type ORDER BY n DESC, type")
def agg4_type_statistics(spark, d):
    return _types(spark, d).groupBy("type").agg(F.countDistinct("o_orderkey").alias("n"), F.round(F.avg("confidence"), 6).alias("mean_confidence")).orderBy(F.desc("n"), "type")


@q(f"WITH {TYPES} SELECT type, count(*) AS n FROM types GROUP BY ROLLUP (type)")
def agg5_type_counts(spark, d):
    return _types(spark, d).rollup("type").agg(F.count("*").alias("n"))


@q(f"WITH {TYPES} SELECT o_orderkey, count(*) AS n, string_agg(type, '|' ORDER BY type) AS types FROM types GROUP BY o_orderkey HAVING count(*) > 2")
def agg6_multi_typed(spark, d):
    return _types(spark, d).groupBy("o_orderkey").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("type")), "|").alias("types")).where("n > 2")


@q("SELECT event_type, count(*) AS n, count(*) FILTER (WHERE value > 50) AS n_success, round(avg(value), 6) AS mean_value FROM events GROUP BY event_type")
def agg13_outcomes(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 50).alias("n_success"), F.round(F.avg("value"), 6).alias("mean_value"))


@q("SELECT count(*) AS n, sum(length(text)) AS chars, min(doc_id) AS oldest, max(doc_id) AS newest FROM documents")
def agg14_live_statistics(spark, d):
    return table(spark, d, "documents").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"), F.min("doc_id").alias("oldest"), F.max("doc_id").alias("newest"))


@q(f"{E}, {REL} SELECT (SELECT count(*) FROM entities) AS nodes, (SELECT count(*) FROM relations) AS edges, (SELECT string_agg(DISTINCT entity_type, '|' ORDER BY entity_type) FROM entities) AS labels, (SELECT count(*) FROM embeddings) AS vectors")
def agg15_database(spark, d):
    e = entities(spark, d).agg(F.count("*").alias("nodes"), F.array_join(F.array_sort(F.collect_set("entity_type")), "|").alias("labels"))
    return e.join(F.broadcast(relations(spark, d).agg(F.count("*").alias("edges")))).join(F.broadcast(table(spark, d, "embeddings").agg(F.count("*").alias("vectors"))))


@q("SELECT p_type AS category, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, category LIMIT 10")
def agg17_top_categories(spark, d):
    return table(spark, d, "part").groupBy(F.col("p_type").alias("category")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "category").limit(10)


@q("SELECT count(DISTINCT p_type) AS types, count(*) AS instances, sum(len(string_split(p_name, ' '))) AS synonyms, count(*) FILTER (WHERE p_size < 5) AS pending FROM part")
def agg18_catalog(spark, d):
    return table(spark, d, "part").agg(F.countDistinct("p_type").alias("types"), F.count("*").alias("instances"), F.sum(F.size(F.split("p_name", " "))).alias("synonyms"), F.count_if(F.col("p_size") < 5).alias("pending"))


@q("SELECT count(*) FILTER (WHERE o_orderstatus = 'F') AS completed, count(*) FILTER (WHERE o_orderstatus = 'O') AS pending, count(*) FILTER (WHERE o_orderstatus = 'P') AS processing, count(*) AS total FROM orders")
def agg19_queue(spark, d):
    c = lambda s: F.count_if(F.col("o_orderstatus") == s)
    return table(spark, d, "orders").agg(c("F").alias("completed"), c("O").alias("pending"), c("P").alias("processing"), F.count("*").alias("total"))


@q("SELECT user_id AS run_id, count(*) AS processed, count(*) FILTER (WHERE event_type = 'purchase') AS success, count(*) FILTER (WHERE event_type = 'error') AS failed, count(*) FILTER (WHERE event_type NOT IN ('purchase', 'error')) AS skipped FROM events GROUP BY 1")
def agg20_runs(spark, d):
    t = F.col("event_type")
    return table(spark, d, "events").groupBy(F.col("user_id").alias("run_id")).agg(F.count("*").alias("processed"), F.count_if(t == "purchase").alias("success"), F.count_if(t == "error").alias("failed"), F.count_if(~t.isin("purchase", "error")).alias("skipped"))


@q("SELECT lang, source, round(avg((quality = toxic)::INT), 6) AS accuracy, round(avg(n_chars), 6) AS mean_ms, min(n_chars) AS least, max(n_chars) AS most FROM documents JOIN labels USING (doc_id) GROUP BY ROLLUP (lang, source)")
def agg21_accuracy(spark, d):
    j = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id")
    return j.rollup("lang", "source").agg(F.round(F.avg((F.col("quality") == F.col("toxic")).cast("int")), 6).alias("accuracy"), F.round(F.avg("n_chars"), 6).alias("mean_ms"), F.min("n_chars").alias("least"), F.max("n_chars").alias("most"))


@q("SELECT 'c_mktsegment' AS field, c_mktsegment AS value, count(*) AS n FROM customer GROUP BY ALL UNION ALL SELECT 'c_nationkey', c_nationkey::VARCHAR, count(*) FROM customer GROUP BY ALL")
def agg22_facets(spark, d):
    return O.facets(table(spark, d, "customer"), ["c_mktsegment", "c_nationkey"])


@q("SELECT ext AS extension, count(*) AS n, sum(l) AS bytes FROM (SELECT CASE WHEN regexp_matches(u, '\\.([A-Za-z0-9]+)$') THEN lower(regexp_extract(u, '\\.([A-Za-z0-9]+)$', 1)) ELSE '' END AS ext, length(html) AS l FROM (SELECT regexp_replace(url, '[?#].*$', '') AS u, html FROM pages)) GROUP BY ROLLUP (ext)")
def agg23_extensions(spark, d):
    return O.pick_files(table(spark, d, "pages").select(F.regexp_replace("url", "[?#].*$", "").alias("path"), F.length("html").alias("length")))


@q("SELECT conv_id, count(*) AS n, sum(length(text)) AS bytes FROM conversations GROUP BY conv_id ORDER BY conv_id DESC")
def agg24_sessions(spark, d):
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("bytes")).orderBy(F.desc("conv_id"))


@q("SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_name) - 1 AS rank FROM customer")
def win3_rank_lists(spark, d):
    w = W.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_name")
    return table(spark, d, "customer").select("c_nationkey", "c_custkey", (F.row_number().over(w) - 1).alias("rank"))


@q("WITH r AS (SELECT c_nationkey, c_name, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_name) AS k FROM customer) SELECT c_nationkey, max(c_name) FILTER (WHERE k = 1) AS best, coalesce(string_agg(c_name, '|' ORDER BY k) FILTER (WHERE k BETWEEN 2 AND 4), '') AS alternatives FROM r WHERE k <= 4 GROUP BY 1")
def win4_best_and_alternatives(spark, d):
    r = O.top_per_group(table(spark, d, "customer"), ["c_nationkey"], [F.desc("c_acctbal"), "c_name"], 4)
    alt = F.array_sort(F.collect_list(F.when(F.col("rank") > 1, F.struct("rank", "c_name"))))
    return r.groupBy("c_nationkey").agg(F.max(F.when(F.col("rank") == 1, F.col("c_name"))).alias("best"), F.array_join(F.transform(alt, lambda x: x["c_name"]), "|").alias("alternatives"))


@q("SELECT p_partkey, pos AS billing, string_split(p_name, ' ')[pos] AS name FROM (SELECT p_partkey, p_name, unnest(range(1, len(string_split(p_name, ' ')) + 1)) AS pos FROM part)")
def win5_billing(spark, d):
    return table(spark, d, "part").select("p_partkey", F.posexplode(F.split("p_name", " ")).alias("p", "name")).select("p_partkey", (F.col("p") + 1).alias("billing"), "name")


@q("SELECT conv_id, turn, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS followed_by FROM conversations")
def win6_adjacency(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.lead("turn").over(W.partitionBy("conv_id").orderBy("turn")).alias("followed_by"))


@q("SELECT p_partkey, split_part(p_type, ' ', 1) AS primary_type FROM part")
def win7_primary(spark, d):
    return table(spark, d, "part").select("p_partkey", F.get(F.split("p_type", " "), F.lit(0)).alias("primary_type"))


@q("SELECT l_orderkey, l_linenumber, 'Show ' || row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) || ' of ' || count(*) OVER (PARTITION BY l_orderkey) AS label FROM lineitem")
def win8_number_within(spark, d):
    w = W.partitionBy("l_orderkey")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.concat_ws(" ", F.lit("Show"), F.row_number().over(w.orderBy("l_linenumber")).cast("string"), F.lit("of"), F.count("*").over(w).cast("string")).alias("label"))


@q(f"WITH {REL} SELECT src, dst, valid_from FROM relations WHERE relation_type = 'PLACED_BY' ORDER BY valid_from, src")
def srt3_history(spark, d):
    return relations(spark, d, ("PLACED_BY",)).select("src", "dst", "valid_from").orderBy("valid_from", "src")


@q("SELECT c_custkey, c_name FROM customer ORDER BY c_name DESC, c_custkey LIMIT 50 OFFSET 25")
def srt4_sorted_page(spark, d):
    return O.page(table(spark, d, "customer"), [F.desc("c_name"), "c_custkey"], 25, 50).select("c_custkey", "c_name")


@q("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderpriority, o_orderdate, o_orderkey LIMIT 40")
def srt5_next_batch(spark, d):
    return table(spark, d, "orders").where("o_orderstatus = 'O'").orderBy("o_orderpriority", "o_orderdate", "o_orderkey").limit(40).select("o_orderkey", "o_orderpriority")


@q("SELECT DISTINCT p_name AS term, length(p_name) AS n FROM part ORDER BY n DESC, term")
def srt6_longest_first(spark, d):
    return table(spark, d, "part").select(F.col("p_name").alias("term"), F.length("p_name").alias("n")).distinct().orderBy(F.desc("n"), "term")


# Collection merges: a part's words against its type's words.
@q("SELECT p_partkey, array_to_string(list_sort(list_distinct(string_split(p_name, ' ') || string_split(lower(p_type), ' '))), '|') AS merged FROM part")
def set1_union(spark, d):
    return table(spark, d, "part").select("p_partkey", F.array_join(F.array_sort(F.array_union(F.split("p_name", " "), F.split(F.lower("p_type"), " "))), "|").alias("merged"))


@q("SELECT p_partkey, array_to_string(list_sort(list_distinct(list_filter(string_split(p_name, ' '), lambda x: NOT list_contains(['green', 'red', 'blue'], x)))), '|') AS added FROM part")
def set2_new_only(spark, d):
    return table(spark, d, "part").select("p_partkey", F.array_join(F.array_sort(F.array_except(F.split("p_name", " "), F.array(*map(F.lit, ("green", "red", "blue"))))), "|").alias("added"))


@q("SELECT p_partkey, array_to_string(list_filter(string_split(p_name, ' '), lambda x: x <> 'green'), '|') AS kept FROM part")
def set3_remove(spark, d):
    return table(spark, d, "part").select("p_partkey", F.array_join(F.filter(F.split("p_name", " "), lambda x: x != "green"), "|").alias("kept"))


@q("SELECT DISTINCT l_orderkey, l_partkey FROM lineitem")
def set4_dedupe_relations(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_partkey").dropDuplicates(["l_orderkey", "l_partkey"])


@q("SELECT user_id, string_agg(DISTINCT event_type, '|' ORDER BY event_type) AS items FROM events GROUP BY user_id")
def set5_union_votes(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set(F.trim("event_type"))), "|").alias("items"))


@q("SELECT DISTINCT p_brand, lower(word) AS norm FROM (SELECT p_brand, unnest(string_split(p_name, ' ')) AS word FROM part)")
def set6_unique_names(spark, d):
    return table(spark, d, "part").select("p_brand", F.explode(F.split("p_name", " ")).alias("w")).select("p_brand", F.lower("w").alias("norm")).dropDuplicates(["p_brand", "norm"])


@q("SELECT coalesce(a.k, b.k) AS k, a.n AS n_customers, b.n AS n_suppliers FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1) a FULL JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1) b ON a.k = b.k")
def set7_merge_ranked(spark, d):
    a = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.count("*").alias("n_customers"))
    return a.join(table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("n_suppliers")), "k", "full")


@q("SELECT substr(sha256(text), 1, 16) AS hash, count(*) AS n, min(doc_id) AS first_id FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def src7_duplicates(spark, d):
    return table(spark, d, "documents").where("text is not null").groupBy(F.substring(F.sha2("text", 256), 1, 16).alias("hash")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


@q("SELECT page_id, regexp_extract(url, '^(https?)://([^/?#]+)', 2) AS host, regexp_extract(url, '/([0-9]+)[^/]*$', 1) AS key FROM pages")
def src8_parse_keys(spark, d):
    return table(spark, d, "pages").select("page_id", F.regexp_extract("url", "^(https?)://([^/?#]+)", 2).alias("host"), F.regexp_extract("url", "/([0-9]+)[^/]*$", 1).alias("key"))


@q(f"{E}, {REL} SELECT 'entity' AS kind, count(*) AS n FROM entities WHERE valid_to IS NULL UNION ALL SELECT 'relation', count(*) FROM relations WHERE valid_to IS NULL")
def src2_current_graph(spark, d):
    from ..operators.graph import current

    c = lambda df, k: current(df).agg(F.count("*").alias("n")).select(F.lit(k).alias("kind"), "n")
    return c(entities(spark, d), "entity").union(c(relations(spark, d), "relation"))
