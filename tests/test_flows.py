"""Flows, dates and venues, containment joins, blocked neighbours and graph searches on known answers."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakeweave.functions import text as T
from lakeweave.operators import flows as FL
from lakeweave.operators import graph as G
from lakeweave.operators import matching as M
from lakeweave.operators import products as P
from lakeweave.operators import search as S
from lakeweave.operators import tables as TB


def test_dates(spark):
    want = {
        "31/03-95 (released on March 31, 1995)": "31/03/1995", "6453": None, "Sunday 27 January": "27/01", "March 3rd, 1999": "03/03/1999", "5 May 68": "05/05/1968", "29/02/1999": None, "1999-12-31": "31/12/1999",
        "17.10.05": "17/10/2005", "2-9-06": "02/09/2006", "Until 16 January 2008": "16/01/2008", "Jul 17 08": "17/07/2008", "Sat 17th September": "17/09", "17 Jul. 08": "17/07/2008", "ONLY AT THE MOVIES 10 JANUARY": "10/01", "soon": None,
    }
    got = spark.createDataFrame([(x,) for x in want], "raw string").select("raw", T.normalise_date(F.col("raw")).alias("d")).collect()
    assert {r.raw: r.d for r in got} == want


def test_venues_and_dates(spark):
    want = {
        "Rod Laver Arena 27 January 2001": ("Rod Laver Arena", "27/01/2001", 2001, 0.85), "Rod Laver Arena": ("Rod Laver Arena", None, None, 1.0), "In cinemas March 3, 1999": ("In cinemas", "03/03/1999", 1999, 0.9),
        "The Forum 3/4/95": ("The Forum", "03/04/1995", 1995, 0.9), "The Forum 3-4": ("The Forum", "03/04", None, 0.8), "27 January 2001": (None, "27/01/2001", 2001, 0.8), "": (None, None, None, 0.0), "Hall 99/99": ("Hall 99/99", None, None, 1.0),
    }
    df = spark.createDataFrame([(x,) for x in [*want, None]], "raw string")
    got = {r.raw: (r.venue, r.date, r.venue_year, r.venue_confidence) for r in P.split_venue_date(df, "raw").collect()}
    assert got.pop(None) == (None, None, None, 0.0) and got == want


def test_contained_texts_are_all_found(spark):
    rng = np.random.default_rng(1)
    words = ["".join(rng.choice(list("abc "), n)).strip() or "a" for n in rng.integers(1, 12, 120)]
    got = {tuple(r) for r in TB.contained(spark.createDataFrame([(w,) for w in words[:80]], "w string"), spark.createDataFrame([(w,) for w in words[40:]] + [("",), (None,)], "p string")).collect()}
    assert got == {(x, y) for x, y in itertools.product(set(words[:80]), set(words[40:])) if y in x}
    artists = spark.createDataFrame([("The Night Owls",), ("Owls",), ("Zed",)], "name string")
    found = M.match_artists(spark.createDataFrame([("Night Owls",), ("nobody",), (None,), ("Zed Trio",)], "name string"), artists)
    assert {tuple(r) for r in found.collect()} == {("Night Owls", "Owls"), ("Zed Trio", "Zed")}


def test_allowed_types_have_no_cap(spark):
    areas = spark.createDataFrame([(f"T{i:05d}",) for i in range(1500)], "relation_type string")
    relations = spark.createDataFrame([("a", "b", "XT01499X"), ("a", "c", "T00000"), ("a", "d", "none")], "src string, dst string, relation_type string")
    assert {(r.relation_type, r.suggestion) for r in M.allowed(relations, areas).collect()} == {("XT01499X", "T01499"), ("none", None)}


@pytest.mark.parametrize("metric", ["cosine", "l2", "inner"])
def test_blocked_neighbours_are_exact(spark, monkeypatch, metric):
    monkeypatch.setattr(S, "QUERY_BLOCK", 3)
    monkeypatch.setattr(S, "VECTOR_BLOCK", 40)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(150, 6))
    x[70] = x[3]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(500, None), (501, [0.0] * 6 if metric == "cosine" else [])], "id long, embedding array<double>")
    got = {(r.query_id, r["rank"]): r.id for r in S.knn(df.where("id % 15 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("q")), df, 5, metric).collect()}
    for q in range(0, 150, 15):
        s = {"inner": x @ x[q], "l2": -np.linalg.norm(x - x[q], axis=1), "cosine": x @ x[q] / np.linalg.norm(x, axis=1)}[metric].copy()
        s[q] = -np.inf
        assert [got[q, r] for r in range(1, 6)] == np.lexsort((np.arange(150), -np.round(s, 12)))[:5].tolist()


def graph(spark, seed=3, n=30, m=60):
    rng = np.random.default_rng(seed)
    links = {(int(a), int(b)) for a, b in rng.integers(0, n, (m, 2)) if a != b}
    near = {i: set() for i in range(n)}
    for a, b in links:
        near[a].add(b)
        near[b].add(a)
    return spark.createDataFrame([(f"n{a:02d}", f"n{b:02d}", "r", 1.0) for a, b in links], "src string, dst string, relation_type string, strength double"), {f"n{k:02d}": {f"n{v:02d}" for v in vs} for k, vs in near.items()}


def test_distances_and_paths_by_brute_force(spark):
    relations, near = graph(spark)
    targets = ["n00", "n01", "n02"]
    want = {}
    for t in targets:
        level, seen = {t}, {t}
        for distance in range(1, 5):
            level = {v for u in level for v in near[u]} - seen
            seen |= level
            for v in level:
                want[v, distance] = want.get((v, distance), 0) + 1
    got = G.distances_to_targets(relations, spark.createDataFrame([(t,) for t in targets], "t string"), 4).where("distance > 0").collect()
    assert {(r.node, r.distance): r.n for r in got} == want

    def simple(path, target, depth):
        if path[-1] == target:
            yield path
        elif len(path) <= depth:
            for v in near[path[-1]] - set(path):
                yield from simple([*path, v], target, depth)

    pairs = [("n03", "n04"), ("n05", "n06"), ("n00", "n00"), ("n07", "absent")]
    got = G.simple_paths(relations, spark.createDataFrame(pairs, "s string, t string"), depth=4, per_pair=7).orderBy("source", "rank").collect()
    for s, t in pairs[:2]:
        found = sorted(simple([s], t, 4), key=lambda p: (len(p), ">".join(p)))[:7]
        assert [r.path for r in got if r.source == s] == found
    assert {r.source for r in got} <= {"n03", "n05"}


def test_repaired_dates(spark):
    e = spark.createDataFrame(
        [("a", ["Headliner: The Owls", "Venue: The Hall", 'Date could not be parsed: "12-13 May 1999"']), ("b", ['Extraction notes: Date could not be parsed: "soon"']), ("c", ["Year: 1990"]), ("d", None)],
        "name string, observations array<string>",
    )
    r = FL.repair_dates(e, spark.createDataFrame([("a", "event_x", "ADVERTISES_EVENT")], "src string, dst string, relation_type string"))
    assert {x.name: (x.status, x.message) for x in r.outcomes.collect()} == {"a": ("repaired", None), "b": ("skipped", "still unreadable"), "c": ("skipped", "no unparsed date"), "d": ("skipped", "no unparsed date")}
    new = r.entities.collect()[0].observations
    assert not any("could not be parsed" in x for x in new) and "Event dates: 12/05/1999, 13/05/1999" in new and "Year: 1999" in new
    assert r.shows.count() == 2 and r.relations.groupBy("relation_type").count().orderBy("relation_type").collect() == [("ADVERTISES_SHOW", 2), ("HELD_AT", 2), ("PART_OF_EVENT", 2), ("PERFORMS_IN", 2)]


def test_hooks_and_product_record(spark):
    have = spark.createDataFrame([("a", 1)], "name string, n int")
    FL.clear_hooks("t")
    seen = []
    FL.register_hook("t", "before", lambda df: df.where("n > 1"))
    FL.register_hook("t", "after", lambda df: seen.append(df.count()))
    got = FL.create_with_hooks(have, spark.createDataFrame([("a", 9), ("b", 2), ("b", 2), ("c", 0)], "name string, n int"), "t")
    assert {tuple(r) for r in got.collect()} == {("a", 1), ("b", 2)} and seen == [1]
    with pytest.raises(ValueError):
        FL.register_hook("t", "during", lambda df: df)
    r = FL.product_record(spark.createDataFrame([(["Product: Demo 7", "Ph: 13.0-12.0", "Colour: fastness", "What is Demo? Demo is a cleaner", "Container Sizes: 5 L, 20l"],), ([],)], "observations array<string>")).collect()
    assert (r[0].product_code, r[0].ph_min, r[0].ph_max, r[0].ph, r[0].colour, r[0].container_sizes, r[0].ready_to_use) == ("DEMO7", 12.0, 13.0, 12.5, None, ["5L", "20L"], True)
    assert r[0].overview == "Demo is a cleaner" and (r[1].product_name, r[1].container_sizes, r[1].ph) == ("", [], None)
