"""Queries of closures and of payloads over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import payloads as PL
from ..operators import documents as D
from ..operators import trees as T
from .registry import plan, table

#: Categories of parts, as paths, and of pages, by their urls' parts.
_PATHS = "paths AS (SELECT replace(p_type, ' ', '/') || '/' || p_brand AS path FROM part UNION ALL SELECT split_part(url, '://', 2) FROM pages WHERE url IS NOT NULL)"
_TREE = f"{_PATHS}, parts AS (SELECT DISTINCT string_split(path, '/') AS p FROM paths), tree AS (SELECT DISTINCT array_to_string(p[1:i], '/') AS node, CASE WHEN i > 1 THEN array_to_string(p[1:i - 1], '/') END AS parent FROM parts, unnest(range(1, len(p) + 1)) AS r(i))"
_CLOSURE = f"WITH RECURSIVE {_TREE}, up AS (SELECT node AS descendant, min(parent) AS ancestor FROM tree WHERE parent IS NOT NULL AND node <> parent GROUP BY node), closure AS (SELECT ancestor, descendant, 1 AS depth FROM up UNION SELECT up.ancestor, c.descendant, c.depth + 1 FROM closure c JOIN up ON up.descendant = c.ancestor AND up.ancestor <> c.descendant)"


def _links(spark, d):
    p = table(spark, d, "part").select(F.concat(F.replace("p_type", F.lit(" "), F.lit("/")), F.lit("/"), "p_brand").alias("path"))
    u = table(spark, d, "pages").where("url is not null").select(F.split_part("url", F.lit("://"), F.lit(2)).alias("path"))
    tree = D.category_tree(p.union(u), "path").select(F.col("path").alias("node"), "parent")
    return T.closure(tree)


@plan(f"{_CLOSURE} SELECT ancestor, descendant, min(depth) AS depth FROM closure GROUP BY ALL")
def txt12_closure(spark, d):
    return _links(spark, d)


@plan(f"{_CLOSURE} SELECT ancestor AS node, count(*) FILTER (depth = 1) AS n_children, count(*) AS n_descendants, max(depth) AS height FROM closure GROUP BY ancestor")
def txt12_subtrees(spark, d):
    return T.subtree_counts(_links(spark, d))


#: Each event's payload with more in it: nested values, an array, and, for some, faults.
_RAW = """raw AS (SELECT event_id, (json_extract(props, '$.k'))::BIGINT AS k, CASE WHEN event_id % 11 = 0 THEN props[:5] WHEN event_id % 13 = 0 THEN '{"k": "many", "user": {"id": ' || user_id || '}, "tags": []}' WHEN event_id % 17 = 0 THEN ''
  ELSE '{"k": ' || json_extract(props, '$.k') || ', "user": {"id": ' || user_id || '}, "value": ' || floor(value)::BIGINT || ', "tags": ["' || event_type || '", ' || event_id % 3 || ', null]}' END AS payload, user_id, value, event_type FROM events)"""
_FIELDS = {"k": ("$.k", "bigint"), "user_id": ("$.user.id", "bigint"), "value": ("$.value", "double"), "first_tag": ("$.tags[0]", "string")}


def _raw(spark, d):
    e, k = table(spark, d, "events"), F.get_json_object("props", "$.k")
    text = lambda *xs: F.concat(*[F.lit(x) if i % 2 == 0 else x.cast("string") for i, x in enumerate(xs)])
    full = text('{"k": ', k, ', "user": {"id": ', F.col("user_id"), '}, "value": ', F.floor("value"), ', "tags": ["', F.col("event_type"), '", ', F.col("event_id") % 3, ", null]}")
    odd = text('{"k": "many", "user": {"id": ', F.col("user_id"), '}, "tags": []}')
    payload = F.when(F.col("event_id") % 11 == 0, F.substring("props", 1, 5)).when(F.col("event_id") % 13 == 0, odd).when(F.col("event_id") % 17 == 0, "").otherwise(full)
    return e.select("event_id", payload.alias("payload"))


@plan(f"""WITH {_RAW} SELECT event_id, CASE WHEN payload <> '' THEN k END AS k, CASE WHEN payload <> '' THEN user_id END AS user_id, CASE WHEN payload <> '' THEN floor(value) END AS value, CASE WHEN payload <> '' THEN event_type END AS first_tag
FROM raw WHERE event_id % 11 <> 0 AND event_id % 13 <> 0""")
def fn23_typed(spark, d):
    good, _ = PL.split_faulty(_raw(spark, d), "payload", _FIELDS)
    return good.select("event_id", *_FIELDS)


@plan(f"WITH {_RAW} SELECT event_id, payload, CASE WHEN event_id % 11 = 0 THEN 'payload' ELSE 'k' END AS faults FROM raw WHERE event_id % 11 = 0 OR event_id % 13 = 0")
def fn23_faulty(spark, d):
    return PL.split_faulty(_raw(spark, d), "payload", _FIELDS)[1].select("event_id", "payload", F.array_join("faults", ",").alias("faults"))


@plan(f"WITH {_RAW}, good AS (SELECT * FROM raw WHERE event_id % 11 <> 0 AND event_id % 13 <> 0 AND event_id % 17 <> 0) SELECT event_id, 0 AS pos, event_type AS value FROM good UNION ALL SELECT event_id, 1, (event_id % 3)::VARCHAR FROM good UNION ALL SELECT event_id, 2, NULL FROM good")
def fn23_items(spark, d):
    return PL.items(_raw(spark, d), "payload", "$.tags", ["event_id"]).select("event_id", "pos", "value")
