"""Types of parts from their texts, and the rules of areas on all documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import areas as A
from ..operators import migration as MG
from .derived import ENT, entities
from .registry import plan, table

_KINDS, _DOUBLE, _BY = ("standard", "small", "medium", "economy", "unknown"), {"promo": ("standard", "economy")}, "types-of-parts"
_ASSESSED = f"""{ENT}, a AS (SELECT name, regexp_extract(observations[3], 'Type: (\\w+)', 1) AS found, ends_with(name, '5') AS linked, CASE lower(found) WHEN 'promo' THEN ['type_standard', 'type_economy'] WHEN 'standard' THEN ['type_standard'] WHEN 'small' THEN ['type_small'] WHEN 'medium' THEN ['type_medium'] WHEN 'economy' THEN ['type_economy'] ELSE ['type_unknown'] END AS wanted FROM entities WHERE entity_type = 'part'),
types AS (SELECT 'type_' || lower(split_part(p_type, ' ', 1)) AS name FROM part WHERE p_type NOT LIKE 'SMALL%' UNION SELECT 'type_unknown' FROM part),
b AS (SELECT name, found, linked, CASE WHEN linked THEN [] ELSE list_filter(wanted, lambda w: list_contains(l, w)) END AS targets FROM a, (SELECT list(name) AS l FROM types))"""


def _assessed(spark, d):
    """Types come from all parts but small ones; parts whose key ends with 5 have a link."""
    parts, p = entities(spark, d, ("part",)), table(spark, d, "part")
    types = p.where(~F.col("p_type").startswith("SMALL")).select(F.concat(F.lit("type_"), F.lower(F.split_part("p_type", F.lit(" "), F.lit(1)))).alias("name")).union(p.select(F.lit("type_unknown"))).distinct()
    have = parts.where(F.col("name").endswith("5")).select(F.col("name").alias("src"), F.lit("type_unknown").alias("dst"), F.lit("HAS_TYPE").alias("relation_type"))
    return MG.assess(parts, have, types, "type_", _KINDS, _DOUBLE)


@plan(f"WITH {_ASSESSED} SELECT name, found, array_to_string(targets, '|') AS targets, CASE WHEN linked THEN 'linked' WHEN len(targets) = 0 THEN 'no target' ELSE 'planned' END AS status FROM b")
def asm4_dry_run(spark, d):
    return _assessed(spark, d).withColumn("targets", F.array_join("targets", "|"))


@plan(f"WITH {_ASSESSED} SELECT count(*) AS total, count(*) FILTER (WHERE linked) AS linked, count(*) FILTER (WHERE NOT linked) AS typed, 0::BIGINT AS untyped, count(*) FILTER (WHERE len(targets) > 1) AS doubled, count(*) FILTER (WHERE NOT linked AND len(targets) = 0) AS no_target, sum(len(targets))::BIGINT AS links FROM b")
def asm4_statistics(spark, d):
    return MG.statistics(_assessed(spark, d))


@plan(f"WITH {_ASSESSED} SELECT name AS src, unnest(targets) AS dst, 'HAS_TYPE' AS relation_type, 1.0::DOUBLE AS confidence, unnest(list_transform(range(len(targets)), lambda i: i = 0)) AS is_primary, 'type was ' || found AS evidence FROM b")
def asm4_links(spark, d):
    return MG.links(_assessed(spark, d), _BY, 1000).drop("source", "inferred_by", "valid_from")


def _subjects(spark, d):
    """Documents as entities of four types, a line an observation."""
    kind = F.get(F.array(*map(F.lit, ("bug", "feature", "patient", "kpi"))), (F.col("doc_id") % 4).cast("int"))
    return table(spark, d, "documents").select(F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("name"), kind.alias("entity_type"), F.split("text", "\n").alias("observations"))


_SAYS = lambda w: f"regexp_matches(lower(coalesce(text, '')), '{w}')"


@plan(f"""WITH n AS (SELECT 'doc_' || doc_id AS name, doc_id % 4 AS k, {_SAYS('severity|priority')} AS sev, {_SAYS('requirement|spec')} AS req, regexp_matches(coalesce(text, ''), '\\b\\d{{3}}-\\d{{2}}-\\d{{4}}\\b') OR regexp_matches(coalesce(text, ''), '\\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Z|a-z]{{2,}}\\b') AS pii, {_SAYS('target|goal')} AS goal FROM documents)
SELECT name, 'warning' AS level, 'severity or priority missing' AS rule FROM n WHERE k = 0 AND NOT sev UNION ALL SELECT name, 'suggestion', 'add a severity' FROM n WHERE k = 0 AND NOT sev
UNION ALL SELECT name, 'suggestion', 'add a requirement or specification' FROM n WHERE k = 1 AND NOT req UNION ALL SELECT name, 'warning', 'personal data' FROM n WHERE k = 2 AND pii UNION ALL SELECT name, 'suggestion', 'add a target or goal' FROM n WHERE k = 3 AND NOT goal""")
def dq13_rules(spark, d):
    e = _subjects(spark, d)
    return A.rule_notes(e, "software").unionByName(A.rule_notes(e, "medical")).unionByName(A.rule_notes(e, "business"))


@plan("""SELECT 'doc_' || doc_id AS name, len(coalesce(string_split(text, chr(10)), [])) + CASE doc_id % 4 WHEN 0 THEN 4 WHEN 1 THEN 3 ELSE 0 END AS n_observations, CASE doc_id % 4 WHEN 0 THEN 'Related to quality in software domain' WHEN 1 THEN 'Related to user_story in software domain' ELSE string_split(text, chr(10))[-1] END AS last FROM documents""")
def dq13_enriched(spark, d):
    e = A.enrich(_subjects(spark, d), "software", 1000)
    return e.select("name", F.size("observations").cast("long").alias("n_observations"), F.get("observations", F.size("observations") - 1).alias("last"))
