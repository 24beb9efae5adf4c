"""Types from older rows and their undo; rules and concepts of areas."""

from pyspark.sql import functions as F

from lakeweave.operators import areas as A
from lakeweave.operators import migration as MG

ENTITIES = [
    ("a", ["x", "Type: Concert"], None), ("b", ["poster_type: hybrid", "type: film"], None), ("c", ["type: film"], "promo"), ("d", ["none"], None), ("e", None, None), ("f", ["TYPE:  odd"], " "),
    ("g", [None, "type: festival"], None), ("h", ["type: film"], None), (None, ["type: film"], None), ("i", ["type: unknown"], None), ("a", ["type: zz"], None),
]
TYPES = [("t_concert",), ("t_release",), ("t_promo",), ("t_unknown",), ("t_unknown",), ("other",)]


def assessed(spark, entities=ENTITIES, types=TYPES):
    have = spark.createDataFrame([("h", "t_film", "HAS_TYPE"), ("h", "t_film", "HAS_TYPE"), ("a", "x", "PLAYS")], "src string, dst string, relation_type string")
    return MG.assess(spark.createDataFrame(entities, "name string, observations array<string>, legacy string"), have, spark.createDataFrame(types, "name string"), "t_")


def test_assess_and_statistics(spark):
    got = {r.name: (r.found, r.targets, r.status) for r in assessed(spark).collect()}
    assert got == {
        "a": ("Concert", ["t_concert"], "planned"), "b": ("hybrid", ["t_release", "t_concert"], "planned"), "c": ("promo", ["t_promo"], "planned"), "d": (None, [], "untyped"), "e": (None, [], "untyped"),
        "f": ("odd", ["t_unknown"], "planned"), "g": ("festival", [], "no target"), "h": ("film", [], "linked"), "i": ("unknown", ["t_unknown"], "planned"),
    }
    assert tuple(MG.statistics(assessed(spark)).first()) == (9, 1, 6, 2, 1, 1, 6)
    assert tuple(MG.statistics(assessed(spark, ENTITIES[:0], TYPES[:0])).first()) == (0, 0, 0, 0, 0, 0, 0)


def test_links_and_undo(spark):
    made = MG.links(assessed(spark), "me", 5)
    assert {(r.src, r.dst, r.confidence, r.is_primary) for r in made.collect()} == {("a", "t_concert", 1.0, True), ("b", "t_release", 1.0, True), ("b", "t_concert", 1.0, False), ("c", "t_promo", 1.0, True), ("f", "t_unknown", 1.0, True), ("i", "t_unknown", 0.5, True)}
    other = made.limit(1).withColumn("inferred_by", F.lit("you")).unionByName(made.limit(1).withColumn("source", F.lit(None).cast("string")))
    assert MG.undo(made.unionByName(other), "me").count() == 2
    # What was carried out is not planned again.
    again = MG.assess(spark.createDataFrame(ENTITIES, "name string, observations array<string>, legacy string"), made, spark.createDataFrame(TYPES, "name string"), "t_")
    assert {r.name for r in again.where("status = 'linked'").collect()} == {"a", "b", "c", "f", "i"}


def test_rules(spark):
    rows = [("1", "bug", ["Severity: low"]), ("2", "bug", ["x"]), ("3", "feature", None), ("4", "patient", ["ssn 123-45-6789"]), ("5", "patient", ["mail a.b@c.org now", None]), ("6", "patient", ["1123-45-6789"]), ("7", "kpi", ["GOAL"]), ("8", "kpi", []), ("9", None, ["x"])]
    e = spark.createDataFrame(rows, "name string, entity_type string, observations array<string>")
    notes = lambda area: sorted(map(tuple, A.rule_notes(e, area).collect()))
    assert notes("software") == [("2", "suggestion", "add a severity"), ("2", "warning", "severity or priority missing"), ("3", "suggestion", "add a requirement or specification")]
    assert notes("medical") == [("4", "warning", "personal data"), ("5", "warning", "personal data")]
    assert notes("business") == [("8", "suggestion", "add a target or goal")] and notes("none") == []


def test_concepts_are_added_once(spark):
    e = spark.createDataFrame([("1", "project", ["x", "Related to team in software domain"]), ("2", "odd", None), ("3", None, ["y", "y"])], "name string, entity_type string, observations array<string>")
    once = A.enrich(e, "software", 7)
    got = {r.name: r.observations for r in once.collect()}
    assert got == {"1": ["x", "Related to team in software domain", *[f"Related to {c} in software domain" for c in ("repository", "deployment", "architecture")]], "2": [], "3": ["y", "y"]}
    assert {r.name: r.observations for r in A.enrich(once, "software", 8).collect()} == got
