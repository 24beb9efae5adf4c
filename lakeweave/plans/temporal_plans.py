"""Queries over histories: user event types as versions, and validity of the derived graph."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import temporal as T
from .derived import ENT, REL, entities, relations
from .registry import plan, table

NOW = 1_000_000_000_000
HIST = "hist AS (SELECT user_id, event_type AS value, row_number() OVER w AS version, (epoch_us(ts::TIMESTAMP) // 1000) AS valid_from, lead((epoch_us(ts::TIMESTAMP) // 1000)) OVER w AS valid_to FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"


def changes(spark, d):
    """The change log: each user's events."""
    return table(spark, d, "events").select("user_id", "event_type", "event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("at"))


def _history(spark, d):
    return T.history(changes(spark, d), "user_id", "at", ["at", "event_id"], "event_type")


@plan(f"WITH {HIST} SELECT * FROM hist")
def tmp9_history(spark, d):
    return _history(spark, d)


@plan(f"WITH {HIST} SELECT user_id, value, version, valid_from FROM hist WHERE valid_to IS NULL")
def win1_latest(spark, d):
    return T.latest(_history(spark, d), "user_id", [F.desc("valid_from"), F.desc("version")]).select("user_id", "value", "version", "valid_from")


@plan(f"WITH {HIST} SELECT user_id, version, valid_from, valid_to FROM hist")
def win2_version_chain(spark, d):
    return _history(spark, d).select("user_id", "version", "valid_from", "valid_to")


@plan(f"WITH {HIST}, t AS (SELECT (min(valid_from) + max(valid_from)) // 2 AS t FROM hist) SELECT user_id, value, version FROM hist, t WHERE valid_from <= t AND (valid_to IS NULL OR valid_to > t)")
def tmp5_graph_as_of(spark, d):
    h = _history(spark, d)
    t = h.agg(F.expr("(min(valid_from) + max(valid_from)) div 2").alias("t"))
    return T.as_of(h.join(F.broadcast(t)), F.col("t")).select("user_id", "value", "version")


@plan(f"""WITH {HIST}, times AS (SELECT DISTINCT (epoch_us(date_trunc('day', ts::TIMESTAMP)) // 1000) AS t FROM events)
SELECT t, value, count(*) AS n FROM hist JOIN times ON valid_from <= t AND (valid_to IS NULL OR valid_to > t) GROUP BY ALL""")
def tmp5_many_times(spark, d):
    times = table(spark, d, "events").select(F.unix_millis(F.date_trunc("day", F.col("ts").cast("timestamp"))).alias("t")).distinct()
    return T.as_of_each(_history(spark, d), times, 86_400_000).groupBy("t", "value").agg(F.count("*").alias("n"))


@plan(f"WITH {HIST} SELECT * FROM hist ORDER BY user_id, valid_from")
def tmp6_entity_history(spark, d):
    return _history(spark, d).orderBy("user_id", "valid_from")


@plan(f"WITH {REL} SELECT src, dst, relation_type, valid_from, valid_to FROM relations ORDER BY src, dst, valid_from")
def tmp6_relation_history(spark, d):
    return relations(spark, d).select("src", "dst", "relation_type", "valid_from", "valid_to").orderBy("src", "dst", "valid_from")


@plan(f"WITH {REL} SELECT src, dst, relation_type, round(greatest(0.1, confidence * exp(greatest({NOW} - valid_from, 0) * ln(0.5) / (30 * 86400000.0))), 8) AS decayed FROM relations")
def tmp7_decayed(spark, d):
    return T.decayed(relations(spark, d), NOW).select("src", "dst", "relation_type", F.round("decayed", 8).alias("decayed"))


@plan(f"""WITH {HIST}, broken AS (SELECT user_id, version + CASE WHEN user_id % 10 = 3 AND version > 2 THEN 1 ELSE 0 END AS version, valid_from, CASE WHEN user_id % 10 = 4 THEN valid_to + 5 ELSE valid_to END AS valid_to FROM hist),
m AS (SELECT *, lag(version) OVER w AS pv, lag(valid_to) OVER w AS pt, lag(valid_from) OVER w AS pf FROM broken WINDOW w AS (PARTITION BY user_id ORDER BY version))
SELECT user_id, count(*) FILTER (WHERE pv IS NOT NULL AND version <> pv + 1) AS version_gaps, count(*) FILTER (WHERE pv IS NOT NULL AND (pt IS NULL OR pt > valid_from)) AS n_overlaps, count(*) FILTER (WHERE pt < valid_from) AS time_gaps,
count(*) FILTER (WHERE valid_to IS NULL) AS open_rows, count(*) FILTER (WHERE pf > valid_from) AS backwards FROM m GROUP BY user_id HAVING version_gaps > 0 OR n_overlaps > 0 OR time_gaps > 0 OR open_rows <> 1 OR backwards > 0""")
def tmp8_audit(spark, d):
    broken = _history(spark, d).withColumns({"version": F.expr("version + case when user_id % 10 = 3 and version > 2 then 1 else 0 end"), "valid_to": F.expr("case when user_id % 10 = 4 then valid_to + 5 else valid_to end")})
    return T.chain_audit(broken, "user_id")


_OLD = "old AS (SELECT name, entity_type, 1 AS version, valid_from, valid_to FROM entities WHERE entity_type IN ('supplier', 'part'))"


@plan(f"""WITH {ENT}, {_OLD}, batch AS (SELECT name, entity_type FROM entities WHERE entity_type IN ('part', 'customer'))
SELECT name, entity_type, 1 AS version, {NOW} AS valid_from FROM batch WHERE name NOT IN (SELECT name FROM old)""")
def tmp1_insert(spark, d):
    added, _ = T.insert_new(entities(spark, d, ("supplier", "part")), entities(spark, d, ("part", "customer")).select("name", "entity_type"), "name", NOW)
    return added.select("name", "entity_type", "version", "valid_from")


@plan(f"WITH {ENT} SELECT name FROM entities WHERE entity_type = 'part'")
def jn3_skipped(spark, d):
    return T.insert_new(entities(spark, d, ("supplier", "part")), entities(spark, d, ("part", "customer")).select("name"), "name", NOW)[1]


@plan(f"WITH {ENT}, {REL} SELECT src, dst, relation_type FROM relations WHERE relation_type IN ('LOCATED_IN', 'IN_REGION') AND NOT (src IN (SELECT name FROM entities WHERE entity_type IN ('nation', 'supplier')) AND dst IN (SELECT name FROM entities WHERE entity_type IN ('nation', 'supplier')))")
def jn4_rejected(spark, d):
    return T.endpoints_exist(relations(spark, d, ("IN_REGION", "SUPPLIER_IN", "CUSTOMER_IN")), entities(spark, d, ("nation", "supplier")))[1].select("src", "dst", "relation_type")


_BATCH = "SELECT src, dst, relation_type, strength / 2 AS strength, NULL::DOUBLE AS confidence FROM relations WHERE relation_type = 'SUPPLIED_BY' AND ends_with(src, '3') UNION ALL SELECT src || 'x', dst, relation_type, 0.25, 0.5 FROM relations WHERE relation_type = 'SUPPLIED_BY' AND ends_with(src, '7')"


@plan(f"""WITH {REL}, old AS (SELECT *, 1 AS version FROM relations WHERE relation_type = 'SUPPLIED_BY'), batch AS ({_BATCH})
SELECT src, dst, relation_type, coalesce(b.strength, o.strength) AS strength, coalesce(b.confidence, o.confidence) AS confidence, CASE WHEN o.src IS NOT NULL AND b.src IS NOT NULL THEN 2 ELSE 1 END AS version, coalesce(o.valid_from, {NOW}) AS valid_from
FROM old o FULL JOIN batch b USING (src, dst, relation_type)""")
def tmp2_merge(spark, d):
    old = relations(spark, d, ("SUPPLIED_BY",)).withColumn("version", F.lit(1))
    b = old.where(F.col("src").endswith("3")).select("src", "dst", "relation_type", (F.col("strength") / 2).alias("strength"), F.lit(None).cast("double").alias("confidence"))
    b = b.unionByName(old.where(F.col("src").endswith("7")).select(F.concat("src", F.lit("x")).alias("src"), "dst", "relation_type", F.lit(0.25).alias("strength"), F.lit(0.5).alias("confidence")))
    return T.merge_relations(old, b, NOW).drop("valid_to")


@plan(f"""WITH {ENT}, e AS (SELECT * FROM entities WHERE entity_type = 'customer'), c AS (SELECT *, ends_with(name, '1') AS hit, [o FOR o IN observations IF NOT starts_with(o, 'Segment')] || ['Reviewed: yes'] AS fresh FROM e)
SELECT name, array_to_string(observations, '|') AS observations, 1 AS version, valid_from, CASE WHEN hit THEN {NOW} END AS valid_to FROM c
UNION ALL SELECT name, array_to_string(fresh, '|'), 2, {NOW}, NULL FROM c WHERE hit""")
def tmp3_observations(spark, d):
    e = entities(spark, d, ("customer",)).withColumn("version", F.lit(1))
    hit = e.where(F.col("name").endswith("1")).select("name", F.array(F.lit("Reviewed: yes")).alias("added"), F.filter("observations", lambda o: o.startswith("Segment")).alias("removed"))
    return T.apply_observations(e, hit, NOW).select("name", F.array_join("observations", "|").alias("observations"), "version", "valid_from", "valid_to")


@plan(f"WITH {REL} SELECT src, dst, relation_type, CASE WHEN ends_with(src, '5') THEN {NOW} END AS valid_to FROM relations WHERE relation_type = 'PLACED_BY'")
def tmp4_soft_delete(spark, d):
    r = relations(spark, d, ("PLACED_BY",))
    return T.soft_delete(r, r.where(F.col("src").endswith("5")), ["src", "dst", "relation_type"], NOW).select("src", "dst", "relation_type", "valid_to")


@plan(f"WITH {REL} SELECT src, dst FROM relations WHERE relation_type = 'PLACED_BY' AND NOT ends_with(dst, '5')")
def tmp4_hard_delete(spark, d):
    e = entities(spark, d, ("customer",))
    return T.hard_delete(e, relations(spark, d, ("PLACED_BY",)), e.where(F.col("name").endswith("5")))[1].select("src", "dst")


@plan(f"WITH {HIST} SELECT value, count(*) AS n FROM hist WHERE valid_to IS NULL GROUP BY value")
def flt1_current(spark, d):
    return _history(spark, d).where(F.col("valid_to").isNull()).groupBy("value").agg(F.count("*").alias("n"))


@plan("SELECT event_id, user_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 8) AS running_mean FROM events")
def win9_running_mean(spark, d):
    w = W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, 0)
    return table(spark, d, "events").select("event_id", "user_id", F.round(F.avg("value").over(w), 8).alias("running_mean"))
