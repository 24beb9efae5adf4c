"""Rules of areas of knowledge on entities, and concepts that belong to their types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _says(*words: str) -> Column:
    return F.exists("observations", lambda o: F.lower(o).rlike("|".join(words)))


def _personal() -> Column:
    return F.exists("observations", lambda o: o.rlike(r"\b\d{3}-\d{2}-\d{4}\b") | o.rlike(r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"))


#: Area, type, level, rule, and when it is broken.
RULES = (
    ("software", "bug", "warning", "severity or priority missing", lambda: ~_says("severity", "priority")),
    ("software", "bug", "suggestion", "add a severity", lambda: ~_says("severity", "priority")),
    ("software", "feature", "suggestion", "add a requirement or specification", lambda: ~_says("requirement", "spec")),
    ("medical", "patient", "warning", "personal data", _personal),
    ("business", "kpi", "suggestion", "add a target or goal", lambda: ~_says("target", "goal")),
)
#: Area, type and its related concepts.
CONCEPTS = (
    ("software", "bug", ("test", "fix", "regression", "quality")),
    ("software", "feature", ("requirement", "specification", "user_story")),
    ("software", "project", ("team", "repository", "deployment", "architecture")),
    ("medical", "condition", ("symptom", "treatment", "diagnosis", "prognosis")),
    ("medical", "medication", ("dosage", "side_effects", "interactions", "contraindications")),
    ("medical", "patient", ("medical_history", "allergies", "vital_signs", "lab_results")),
    ("business", "kpi", ("metric", "target", "performance", "measurement")),
    ("business", "project", ("timeline", "budget", "resources", "deliverables")),
    ("business", "customer", ("satisfaction", "retention", "acquisition", "lifetime_value")),
)


def rule_notes(entities: DataFrame, area: str, rules=RULES) -> DataFrame:
    """name, level, rule: what the area's rules say of entities (name, entity_type, observations), in one pass. Null observations
    say nothing, so what they miss is noted; an entity that no rule is for has no row."""
    e = entities.withColumn("observations", F.coalesce("observations", F.array().cast("array<string>"))).withColumn("observations", F.filter("observations", lambda o: o.isNotNull()))
    notes = [F.when((F.col("entity_type") == kind) & broken(), F.struct(F.lit(level).alias("level"), F.lit(rule).alias("rule"))) for a, kind, level, rule, broken in rules if a == area]
    if not notes:
        return e.select("name", F.lit("").alias("level"), F.lit("").alias("rule")).limit(0)
    return e.select("name", F.explode(F.array_compact(F.array(*notes))).alias("x")).select("name", "x.*")


def enrich(entities: DataFrame, area: str, at: int, concepts=CONCEPTS) -> DataFrame:
    """`entities` with area, enriched_at, and an observation more for each concept of their type that they don't have yet, so that
    a second run adds nothing."""
    lines = {kind: [f"Related to {c} in {area} domain" for c in cs] for a, kind, cs in concepts if a == area}
    own = F.coalesce("observations", F.array().cast("array<string>"))
    more = F.array().cast("array<string>")
    for kind, said in lines.items():
        more = F.when(F.col("entity_type") == kind, F.array(*map(F.lit, said))).otherwise(more)
    return entities.withColumns({"observations": F.concat(own, F.array_except(more, own)), "area": F.lit(area), "enriched_at": F.lit(at).cast("long")})
