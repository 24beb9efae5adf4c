"""Queries of flows, files and streams over the driver's tables. Files are written from whole tables to the shared folder first."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import flows as FL
from ..sources import io
from ..sources.scratch import cut, folder
from ..streaming import streams as ST
from .derived import ENT, REL, entities, relations
from .registry import plan, table
from .temporal_plans import HIST, changes

_SLUG = "trim(regexp_replace(lower({}), '[^a-z0-9]+', '_', 'g'), '_')"


# Records of orders: two readers' votes on the headliner, one on the venue (with a date in it for even orders) and the date.
def _votes(spark, d):
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    k, day = F.col("o_orderkey"), F.date_format("o_orderdate", "d MMMM yyyy")
    vote = lambda field, value, confidence: F.struct(F.lit(field).alias("field"), value.alias("value"), F.lit(confidence).alias("confidence"))
    hall = F.concat("c_mktsegment", F.lit(" Hall"))
    rows = F.array(vote("headliner", F.col("c_name"), 0.9), vote("headliner", F.when(k % 5 == 0, F.concat("c_name", F.lit(" Band"))).otherwise(F.col("c_name")), 0.6), vote("venue_name", F.when(k % 2 == 0, F.concat_ws(" ", hall, day)).otherwise(hall), 0.8), vote("event_date", F.when(k % 2 == 1, day), 0.7))
    return o.select(k.alias("subject"), F.explode(rows).alias("x")).select("subject", "x.*").where("value is not null")


def _flow(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("subject"))
    fixes = o.where("subject % 13 = 0").select("subject", F.lit("headliner").alias("field"), F.lit("FIXED").alias("value"), F.lit(0.9).alias("confidence"))
    return FL.process_records(cut(_votes(spark, d)), o.where("subject % 11 = 0"), fixes)


_RECORDS = """records AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 13 = 0 THEN 'FIXED' WHEN o_orderkey % 5 = 0 THEN c_name || ' Band' ELSE c_name END AS headliner, c_mktsegment || ' Hall' AS venue, strftime(o_orderdate, '%d/%m/%Y') AS date,
  CASE WHEN o_orderkey % 11 = 0 THEN 'done' WHEN o_orderkey % 10 = 0 THEN 'review' ELSE 'process' END AS decision FROM orders JOIN customer ON c_custkey = o_custkey)"""


@plan(f"WITH {_RECORDS} SELECT k AS subject, decision, CASE WHEN decision = 'process' THEN 3 ELSE 0 END AS n_relations FROM records")
def asm6_outcomes(spark, d):
    return _flow(spark, d).outcomes


@plan(f"""WITH {_RECORDS}, r AS (SELECT 'record_' || k AS src, * FROM records WHERE decision = 'process')
SELECT src, 'artist_' || {_SLUG.format('headliner')} AS dst, 'HEADLINED_BY' AS relation_type FROM r UNION ALL SELECT src, 'venue_' || {_SLUG.format('venue')}, 'ADVERTISES_VENUE' FROM r
UNION ALL SELECT src, 'show_' || {_SLUG.format("headliner || ' ' || venue || ' ' || date")}, 'ADVERTISES_SHOW' FROM r""")
def asm6_relations(spark, d):
    return _flow(spark, d).relations.select("src", "dst", "relation_type")


# Entities with notes of unreadable dates: several days, words, none, no quotes.
def _noted(spark, d):
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    k, day = F.col("o_orderkey"), F.dayofmonth("o_orderdate")
    raw = F.when(day <= 20, F.concat(day.cast("string"), F.lit("-"), (day + 2).cast("string"), F.date_format("o_orderdate", " MMMM yyyy"))).otherwise(F.date_format("o_orderdate", "EEEE, d MMM yyyy"))
    note = F.when(k % 4 == 0, F.concat(F.lit('Extraction notes: Date could not be parsed: "'), raw, F.lit('"'))).when(k % 4 == 1, F.lit('Date could not be parsed: "someday"')).when(k % 4 == 3, F.lit("Date could not be parsed: lost"))
    e = o.select(F.concat(F.lit("record_"), k.cast("string")).alias("name"), F.array_compact(F.array(F.concat(F.lit("Headliner: "), "c_name"), F.concat(F.lit("Venue: "), "c_mktsegment"), note)).alias("observations"))
    events = o.where(k % 8 == 0).select(F.concat(F.lit("record_"), k.cast("string")).alias("src"), F.concat(F.lit("event_"), k.cast("string")).alias("dst"), F.lit("ADVERTISES_EVENT").alias("relation_type"))
    return e, events


_DATES = "dates AS (SELECT o_orderkey AS k, c_name, c_mktsegment, o_orderdate + to_days(i::INT) AS t FROM (SELECT *, unnest(CASE WHEN day(o_orderdate) <= 20 THEN [0, 1, 2] ELSE [0] END) AS i FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderkey % 4 = 0))"


@plan("""SELECT 'record_' || o_orderkey AS name, CASE WHEN o_orderkey % 4 = 0 THEN 'repaired' ELSE 'skipped' END AS status, [NULL, 'still unreadable', 'no unparsed date', 'no date in the note'][o_orderkey % 4 + 1] AS message,
CASE WHEN o_orderkey % 4 > 0 THEN 0 WHEN day(o_orderdate) <= 20 THEN 3 ELSE 1 END AS n_dates FROM orders JOIN customer ON c_custkey = o_custkey""")
def dq12_repair(spark, d):
    return FL.repair_dates(*_noted(spark, d)).outcomes.select("name", "status", "message", F.greatest(F.size("dates"), F.lit(0)).alias("n_dates"))


@plan(f"""WITH {_DATES}, s AS (SELECT *, 'show_' || {_SLUG.format("c_name || ' ' || c_mktsegment || ' ' || strftime(t, '%d/%m/%Y')")} AS own FROM dates)
SELECT DISTINCT 'record_' || k AS src, own AS dst, 'ADVERTISES_SHOW' AS relation_type FROM s UNION SELECT own, 'venue_' || {_SLUG.format('c_mktsegment')}, 'HELD_AT' FROM s
UNION SELECT 'artist_' || {_SLUG.format('c_name')}, own, 'PERFORMS_IN' FROM s UNION SELECT own, 'event_' || k, 'PART_OF_EVENT' FROM s WHERE k % 8 = 0""")
def dq12_relations(spark, d):
    return FL.repair_dates(*_noted(spark, d)).relations


@plan(f"""WITH {ENT}, {REL} SELECT 'entity' AS kind, name, NULL::BIGINT AS session_id FROM entities WHERE entity_type IN ('customer', 'nation') AND NOT (entity_type = 'customer' AND CAST(split_part(name, '_', 2) AS BIGINT) % 10 = 3)
UNION ALL SELECT 'relation', src, NULL FROM relations WHERE starts_with(src, 'customer_') AND CAST(split_part(src, '_', 2) AS BIGINT) % 10 <> 3
UNION ALL SELECT CASE WHEN c_custkey % 10 = 3 THEN 'queued' ELSE 'live' END, 'image_' || c_custkey, CASE WHEN c_custkey % 10 = 3 THEN 99 ELSE c_custkey % 10 END FROM customer""")
def asm7_undo(spark, d):
    key = F.col("c_custkey").cast("string")
    live = table(spark, d, "customer").select(F.concat(F.lit("image_"), key).alias("image"), F.concat(F.lit("customer_"), key).alias("entity_name"), (F.col("c_custkey") % 10).alias("session_id"))
    e, r, left, queued = FL.undo_and_requeue(entities(spark, d, ("customer", "nation")), relations(spark, d, ("CUSTOMER_IN",)), live, live.where("session_id = 3"), F.lit(99).cast("long"))
    none = F.lit(None).cast("long").alias("session_id")
    rows = lambda df, kind: df.select(F.lit(kind).alias("kind"), F.col("image").alias("name"), F.col("session_id").cast("long").alias("session_id"))
    return e.select(F.lit("entity").alias("kind"), "name", none).union(r.select(F.lit("relation").alias("kind"), F.col("src").alias("name"), none)).union(rows(left, "live")).union(rows(queued, "queued"))


@plan("SELECT 'customer_' || c_custkey AS name, CASE WHEN c_custkey % 2 = 0 THEN 'old' ELSE lower(c_mktsegment) END AS kind FROM customer WHERE c_custkey % 2 = 0 OR c_acctbal > 0")
def udf2_hooks(spark, d):
    c = table(spark, d, "customer").select(F.concat(F.lit("customer_"), F.col("c_custkey").cast("string")).alias("name"), "c_custkey", "c_acctbal", F.lower("c_mktsegment").alias("kind"))
    seen = []
    FL.clear_hooks("customers")
    FL.register_hook("customers", "before", lambda df: df.where("c_acctbal > 0"))
    FL.register_hook("customers", "after", seen.append)
    FL.create_with_hooks(c.where("c_custkey % 2 = 0").select("name", F.lit("old").alias("kind")), c, "customers")
    return c.where("c_custkey % 2 = 0").select("name", F.lit("old").alias("kind")).unionByName(seen[0])


# Product sheets as observations.
def _sheets(spark, d):
    s = F.col("p_size")
    text = lambda c: c.cast("string")
    a, b = s % 14 + 1, s % 10
    ph = F.when(s % 4 == 0, F.array(F.concat(F.lit("pH: "), text(a), F.lit(" - "), text(b)))).when(s % 4 == 1, F.array(F.concat(F.lit("pH min: "), text(b)), F.concat(F.lit("pH max: "), text(s)))).when(s % 4 == 2, F.array(F.concat(F.lit("Ph: "), text(s), F.lit(".5")))).otherwise(F.array().cast("array<string>"))
    colour = F.concat(F.lit("Colour: "), F.when(s % 5 == 0, text(s)).otherwise(F.split_part("p_name", F.lit(" "), F.lit(1))))
    description = F.concat(F.lit("Description: How Does It Work? CAUTION: keep from "), "p_brand", F.lit("."), F.when(s % 3 > 0, F.concat(F.lit(" Dilute 1:"), text(s), F.lit("."))).otherwise(""))
    more = F.array(F.concat(F.lit("Product: "), "p_name"), colour, description, F.concat(F.lit("Overview: "), "p_type"), F.concat(F.lit("Container Sizes: "), text(s), F.lit(" L, drum, 20l")), F.concat(F.lit("Note: "), "p_brand"))
    return table(spark, d, "part").select("p_partkey", F.concat(more, ph).alias("observations"))


@plan("""WITH p AS (SELECT *, p_size % 14 + 1 AS a, p_size % 10 AS b, p_size AS s FROM part), q AS (SELECT *, CASE s % 4 WHEN 0 THEN least(a, b) WHEN 1 THEN b END AS lo, CASE WHEN s % 4 = 0 THEN greatest(a, b) WHEN s % 4 = 1 AND s <= 14 THEN s END AS hi FROM p)
SELECT p_partkey, p_name AS product_name, substr(upper(regexp_replace(p_name, '[^A-Za-z0-9]', '', 'g')), 1, 20) AS product_code, p_type AS overview, s || 'L|20L' AS sizes, lo::DOUBLE AS ph_min, hi::DOUBLE AS ph_max,
CASE WHEN s % 4 = 2 AND s <= 13 THEN s + 0.5 ELSE (lo + hi) / 2 END::DOUBLE AS ph, CASE WHEN s % 5 > 0 THEN split_part(p_name, ' ', 1) END AS colour, 'CAUTION: keep from ' || p_brand AS warnings,
CASE WHEN s % 3 > 0 THEN '1:' || s ELSE '' END AS ratios, s % 3 = 0 AS ready_to_use, 'Note: ' || p_brand AS other FROM q""")
def txt8_product_record(spark, d):
    j = lambda c: F.array_join(c, "|").alias({"container_sizes": "sizes"}.get(c, c))
    r = FL.product_record(_sheets(spark, d))
    return r.select("p_partkey", "product_name", "product_code", "overview", j("container_sizes"), "ph_min", "ph_max", "ph", "colour", j("warnings"), j("ratios"), "ready_to_use", j("other"))


# Files.
@plan(f"WITH {REL} SELECT src, dst, relation_type FROM relations")
def src1_read_graph(spark, d):
    path = f"{folder(spark)}/graph"
    e = entities(spark, d).select(F.to_json(F.struct(F.lit("entity").alias("type"), "name", F.col("entity_type").alias("entityType"), "observations")).alias("value"))
    r = relations(spark, d).select(F.to_json(F.struct(F.lit("relation").alias("type"), F.col("src").alias("from"), F.col("dst").alias("to"), F.col("relation_type").alias("relationType"))).alias("value"))
    bad = table(spark, d, "region").select(F.concat(F.lit('{"type": "relation", broken '), "r_name").alias("value"))
    e.union(r).union(bad).write.text(path)
    return io.read_graph(spark, path).relations


@plan(f"WITH {ENT} SELECT entity_type, count(*) AS n FROM entities GROUP BY entity_type")
def snk1_write_graph(spark, d):
    path = f"{folder(spark)}/graph"
    io.write_graph(io.Graph(entities(spark, d), relations(spark, d)), path)
    return spark.read.parquet(f"{path}/entities").groupBy("entity_type").agg(F.count("*").alias("n"))


@plan("SELECT p_name AS name, p_partkey::VARCHAR AS code, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_type END AS categories, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE p_size || 'L' END AS sizes, p_partkey % 7 = 0 AS has_pds, false AS has_sds FROM part")
def src4_products(spark, d):
    path = f"{folder(spark)}/products"
    k = F.col("p_partkey")
    even = lambda x: F.when(k % 2 == 0, x)
    odd = lambda x: F.when(k % 2 == 1, x)
    code, size = k.cast("string"), F.when(k % 5 > 0, F.array(F.concat(F.col("p_size").cast("string"), F.lit("L"))))
    columns = [even(F.col("p_name")).alias("product_name"), odd(F.col("p_name")).alias("name"), even(code).alias("product_code"), odd(code).alias("code"), F.when(k % 3 > 0, F.array("p_type")).alias("product_categories"), even(size).alias("product_skus"), odd(size).alias("container_sizes"), F.when(k % 7 == 0, "x.pdf").alias("pds_url")]
    table(spark, d, "part").select(*columns).write.json(path)
    p = io.read_products(spark, path, lines=True)
    return p.select("name", "code", F.array_join("categories", "|").alias("categories"), F.array_join("sizes", "|").alias("sizes"), "has_pds", "has_sds")


@plan("SELECT n_nationkey::VARCHAR AS nation, count(*) AS n_files FROM (SELECT DISTINCT n_nationkey FROM nation JOIN customer ON c_nationkey = n_nationkey) GROUP BY n_nationkey")
def src6_list_files(spark, d):
    path = f"{folder(spark)}/files"
    table(spark, d, "customer").repartition("c_nationkey").write.partitionBy("c_nationkey").json(path)
    files = io.list_files(spark, path, "*.json").where("length > 0")
    return files.groupBy(F.regexp_extract("path", r"c_nationkey=(\d+)", 1).alias("nation")).agg(F.count("*").alias("n_files"))


@plan("SELECT 'customer' AS name, count(*) AS n FROM customer UNION ALL SELECT 'part', count(*) FROM part UNION ALL SELECT 'embeddings', count(*) FROM embeddings")
def snk4_backup(spark, d):
    path = folder(spark)
    io.backup({t: table(spark, d, t) for t in ("customer", "part", "embeddings")}, path, "1")
    return spark.read.schema("name string, n long").json(f"{path}/snapshot=1/manifest")


@plan("SELECT 'archived' AS kind, count(*) AS n FROM pages UNION ALL SELECT 'live', 0")
def snk5_archive(spark, d):
    path = folder(spark)
    _, live = io.archive(table(spark, d, "pages"), path, "1")
    archived = spark.read.parquet(f"{path}/archive_ts=1").agg(F.count("*").alias("n")).select(F.lit("archived").alias("kind"), "n")
    return archived.union(live.agg(F.count("*").alias("n")).select(F.lit("live").alias("kind"), "n"))


# Streams, each run to its end over files of a whole table.
@plan("SELECT event_type, count(*) AS n FROM (SELECT DISTINCT * FROM events) GROUP BY event_type")
def str1_ingest(spark, d):
    path = folder(spark)
    e = table(spark, d, "events").withColumns({"ts": F.col("ts").cast("timestamp")}).withColumn("content", F.to_json(F.struct(*table(spark, d, "events").columns)))
    e.union(e).write.parquet(f"{path}/source")
    for _ in range(2):  # the second run finds nothing new
        ST.ingest_once(spark.readStream.schema(e.schema).parquet(f"{path}/source"), f"{path}/target", f"{path}/checkpoint", "content", "ts").awaitTermination()
    return spark.read.parquet(f"{path}/target").groupBy("event_type").agg(F.count("*").alias("n"))


@plan(f"WITH {HIST} SELECT * FROM hist")
def str2_history(spark, d):
    path = folder(spark)
    c = changes(spark, d)
    c.write.parquet(f"{path}/source")
    ST.append_changes(spark.readStream.schema(c.schema).parquet(f"{path}/source"), f"{path}/log", f"{path}/checkpoint").awaitTermination()
    return ST.history_of(spark.read.schema(c.schema).parquet(f"{path}/log"), "user_id", "at", ["at", "event_id"], "event_type")
