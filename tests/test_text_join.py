"""Similarity joins against all pairs."""

import random

import pytest

from lakeweave.operators import matching as M
from lakeweave.operators import text_join as J


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def strings(seed, n):
    rnd = random.Random(seed)
    out = ["".join(rnd.choice("abc") for _ in range(rnd.randrange(1, 13))) for _ in range(n)]
    return [*out, "a", "ab", "é", "éa", "", None]


@pytest.mark.parametrize("least", [0.5, 0.7, 0.85, 1.0])
def test_similar_strings(spark, least):
    x, y = strings(1, 120), strings(2, 120)
    got = J.similar_strings(spark.createDataFrame([(s,) for s in x], "s string"), spark.createDataFrame([(s,) for s in y], "t string"), least).collect()
    want = {(a, b) for a in x if a for b in y if b and 1 - edits(a, b) / max(len(a), len(b)) >= least - 1e-9}
    assert {(r["a"], r["b"]) for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("least", [0.3, 0.6, 0.8, 1.0])
def test_similar_sets(spark, least):
    rnd = random.Random(5)
    make = lambda: " ".join(["the", *rnd.choices("red green blue new old big small hot cold".split(), k=rnd.randrange(0, 7))])
    x, y = [make() for _ in range(80)] + ["", None, "the the"], [make() for _ in range(80)] + ["  ", "red"]
    jac = lambda a, b: len(set(a.split()) & set(b.split())) / len(set(a.split()) | set(b.split()))
    got = J.similar_sets(spark.createDataFrame([(s,) for s in x], "s string"), spark.createDataFrame([(s,) for s in y], "t string"), least).collect()
    want = {(a, b) for a in x if a and a.split() for b in y if b.split() and jac(a, b) >= least - 1e-9}
    assert {(r["a"], r["b"]) for r in got} == want and len(got) == len(want)


def test_common_word_makes_no_candidates(spark):
    """A thousand names that share one word: the keys are their rare words."""
    names = spark.createDataFrame([(f"theatre w{i} x{i} y{i}",) for i in range(1000)], "s string")
    counts = J.words(names["s"])
    frequent = names.select(counts.alias("w")).selectExpr("explode(w) as w").groupBy("w").count().where("count > 10")
    keys = J._prefixes(names.toDF("text"), frequent, 0.7)
    assert keys.where("w = 'theatre'").count() == 0 and keys.count() == 2000


def test_match_venues_and_people(spark):
    names = spark.createDataFrame([("The Grand Hall",), ("grand hall london",), ("hall",), (None,), ("nothing like it",)], "name string")
    venues = spark.createDataFrame([("Grand Hall", "Leeds"), ("Grand Hall London", "London"), (None, "x")], "venue string, city string")
    got = {r["name"]: (r["venue"], r["score"]) for r in M.match_venues(names, venues).collect()}
    assert got == {"The Grand Hall": ("Grand Hall", 1.0), "grand hall london": ("Grand Hall London", 1.0), "hall": ("Grand Hall", 0.9)}
    people = spark.createDataFrame([("Jon Smith", "f", "Directing"), ("Jon Smith", "g", None)], "name string, film string, department string")
    credits = spark.createDataFrame([("f", "John Smith", "Acting"), ("f", "John Smith", "Directing"), ("g", "Ann Lee", "Acting"), ("g", "Jon Smith", "Acting")], "film string, person string, department string")
    got = {r["film"]: (r["person"], r["department"], round(r["score"], 6), r["status"]) for r in M.match_people(people, credits).collect()}
    assert got == {"f": ("John Smith", "Directing", 0.95, "match"), "g": ("Jon Smith", "Acting", 1.0, "match")}
