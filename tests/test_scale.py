"""Steps that have to stay bounded as tables grow."""

import os
import random
import re

import pytest
from pyspark.sql import functions as F

from lakeweave.operators import graph as G
from lakeweave.operators import matching as M


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_artists_are_matched_without_broadcast(spark, tmp_path):
    """Names compress well, so the size of a shuffle says little about the memory that the driver needs to broadcast it."""
    names = spark.createDataFrame([(f"The Customer{i:09d}",) for i in range(40)] + [(None,), ("x",)], "name string")
    known = spark.createDataFrame([(f"Customer{i:09d}"[: 17 - i % 2],) for i in range(40)], "name string")
    names.write.parquet(f"{tmp_path}/names")
    known.write.parquet(f"{tmp_path}/known")
    got = M.match_artists(spark.read.parquet(f"{tmp_path}/names"), spark.read.parquet(f"{tmp_path}/known"))
    assert "Broadcast" not in plan_of(got)
    assert {r["name"]: r["artist"] for r in got.collect()}["The Customer000000013"] == "Customer00000001"


def simple(near, path, target, depth):
    if path[-1] == target:
        yield path
    elif len(path) <= depth:
        for v in near.get(path[-1], set()) - set(path):
            yield from simple(near, [*path, v], target, depth)


@pytest.mark.parametrize("both", [True, False])
@pytest.mark.parametrize("mark", ["", ">"])
def test_paths_by_hubs(spark, both, mark):
    """Against all paths of a graph with two hubs of common and of own neighbours, and others below the limit."""
    rnd = random.Random(3)
    names = [f"n{i}{mark if i % 3 == 0 else ''}" for i in range(24)]
    edges = {(h, n) if rnd.random() < 0.5 else (n, h) for h in ("hub_a", "hub_b") for n in names if rnd.random() < 0.6} | {tuple(rnd.sample(names, 2)) for _ in range(14)}
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        if both:
            near.setdefault(b, set()).add(a)
    relations = spark.createDataFrame(sorted(edges), "src string, dst string").withColumn("relation_type", F.lit("x"))
    pairs = [("hub_a", "hub_b"), *((names[i], names[i + 1]) for i in range(0, 22, 3))]
    got = G.simple_paths(relations, spark.createDataFrame(pairs, "s string, t string"), depth=4, per_pair=9, both=both, hub=5).orderBy("source", "target", "rank").collect()
    for s, t in pairs:
        want = sorted(simple(near, [s], t, 4), key=lambda p: (len(p), ">".join(p)))[:9]
        assert [r.path for r in got if (r.source, r.target) == (s, t)] == want


def test_paths_list_no_hub_for_each_pair(spark, monkeypatch):
    edges = [(f"n{i:04d}", "hub") for i in range(2100)]
    relations = spark.createDataFrame(edges, "src string, dst string").withColumn("relation_type", F.lit("x"))
    sizes = []
    keep = G.cut
    monkeypatch.setattr(G, "cut", lambda df: sizes.append((out := keep(df)).count()) or out)
    pairs = spark.createDataFrame([(f"n{i:04d}", f"n{i + 1:04d}") for i in range(20)], "s string, t string")
    assert G.simple_paths(relations, pairs, depth=4).count() == 20 and max(sizes) <= 4200


def test_edges_read_relations_once(spark, monkeypatch, tmp_path):
    spark.createDataFrame([("a", "b"), ("b", "a"), ("a", "a"), ("c", None), ("b", "c")], "src string, dst string").withColumn("relation_type", F.lit("x")).write.parquet(f"{tmp_path}/r")
    plans = []
    keep = G.cut
    monkeypatch.setattr(G, "cut", lambda df: plans.append(plan_of(df)) or keep(df))
    got = G.edges(spark.read.parquet(f"{tmp_path}/r"))
    assert sorted(map(tuple, got.collect())) == [("a", "b"), ("b", "a"), ("b", "c"), ("c", "b")]
    assert plans[0].count("FileScan") == 1


def test_names_without_similar_ones_have_their_best(spark):
    names = ["green bolt", "green bolts", "green boltz", "green volts", "green bold", "x", "", None, "anvil"]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    got = M.match_names(df, df.toDF("candidate"), k=3).orderBy("name", "rank").collect()

    def like(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return 1 - row[-1] / max(len(a), len(b))

    known = [n for n in names if n is not None]
    for a in known:
        want = sorted(((-like(a, b), b) for b in known if a != b))[:3]
        assert [r.candidate for r in got if r.name == a] == [b for _, b in want]


def near_of(edges):
    near = {}
    for a, b in edges:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    return near


@pytest.mark.parametrize("seed,hub", [(1, 3), (2, 8), (3, 100)])
def test_influence_and_clustering_by_brute_force(spark, seed, hub):
    rnd = random.Random(seed)
    names = [f"n{i}" for i in range(40)]
    edges = [(rnd.choice(("h", "g")), n) for n in names if rnd.random() < 0.6] + [tuple(rnd.choices(names, k=2)) for _ in range(60)] + [("h", "g"), ("n1", "n1")]
    near = near_of(edges)
    relations = spark.createDataFrame(edges, "src string, dst string").withColumn("relation_type", F.lit("x"))
    entities = spark.createDataFrame([(n,) for n in [*names, "h", "g", "alone"]], "name string")
    two = {n: set().union(*(near[b] for b in near.get(n, ()))) - near.get(n, set()) - {n} for n in [*names, "h", "g", "alone"]}
    got = {r.name: (r.direct, r.indirect, r.radius) for r in G.influence(entities, relations, hub).collect()}
    assert got == {n: (len(near.get(n, ())), len(c), 2 if c else 1 if near.get(n) else 0) for n, c in two.items()}
    tri = {n: sum(b in near[a] for a in near.get(n, ()) for b in near[n] if a < b) for n in two}
    assert {r.name: r.triangles for r in G.clustering(entities, relations).collect()} == tri


def test_influence_lists_no_hub_for_each_entity(spark, monkeypatch):
    """Of 600 entities next to one hub, 360,000 pairs."""
    edges = [(f"n{i:04d}", "hub") for i in range(600)] + [(f"n{i:04d}", f"m{i % 7}") for i in range(600)]
    relations = spark.createDataFrame(edges, "src string, dst string").withColumn("relation_type", F.lit("x"))
    entities = relations.select(F.col("src").alias("name")).distinct()
    asked = []
    keep = G.two_hops
    monkeypatch.setattr(G, "two_hops", lambda *a: asked.append(a) or keep(*a))
    got = G.influence(entities, relations, hub=100)
    assert {(r.direct, r.indirect) for r in got.collect()} == {(2, 599)} and not asked


@pytest.mark.parametrize("hub,group,most", [(5, 20, 1000), (5, 20, 0), (100, 10**6, 1000)])
def test_two_hops_send_lists_not_pairs(spark, monkeypatch, hub, group, most):
    rnd = random.Random(2)
    names = [f"n{i}" for i in range(40)]
    edges = [(rnd.choice(("h", "g")), n) for n in names if rnd.random() < 0.6] + [tuple(rnd.choices(names, k=2)) for _ in range(60)] + [("h", "g"), ("n1", "n1")]
    near = near_of(edges)
    monkeypatch.setattr(G, "PAIRS_A_GROUP", group, raising=False)
    monkeypatch.setattr(G, "MOST_ENDS", most, raising=False)
    asked = spark.createDataFrame([(n,) for n in [*names[::2], "h", "alone"]], "name string")
    got = G.two_hops(spark.createDataFrame(edges, "src string, dst string").withColumn("relation_type", F.lit("x")), asked, hub)
    assert sorted(map(tuple, got.collect())) == sorted((a, c, min(near[a] & near[c])) for a in [*names[::2], "h"] if a in near for c in near if a != c and c not in near[a] and near[a] & near[c])
    assert not re.search(r"hashpartitioning\(a#\d+, c#\d+", plan_of(got))


def test_tasks_group_a_bounded_number_of_rows(spark, monkeypatch):
    """As many tasks as the rows ask for, whatever their bytes are."""
    from lakeweave.operators import flows as FL
    from lakeweave.plans import derived, flow_plans, table_plans
    from lakeweave.sources import scratch

    d, rows = "/root/testdata/sf0.001", 500
    monkeypatch.setattr(scratch, "TASK_ROWS", rows)
    n = spark.read.parquet(f"{d}/lineitem.parquet").count() // rows + 1
    assert n > 8
    for kind in ("CONTAINS", "SUPPLIED_BY"):
        assert derived.relations(spark, d, (kind,)).rdd.getNumPartitions() == n
    assert table_plans.jn17_active_range(spark, d).rdd.getNumPartitions() == n

    tasks = []
    keep = FL.cut
    monkeypatch.setattr(FL, "cut", lambda df: tasks.append(df.rdd.getNumPartitions()) or keep(df))
    flow_plans._flow(spark, d)
    votes, orders = flow_plans._votes(spark, d).count(), spark.read.parquet(f"{d}/orders.parquet").where("o_orderkey % 11 != 0").count()
    assert tasks == [votes // rows + 1, orders // rows + 1]


def test_paths_leave_no_edges_and_send_no_paths_of_one_step(spark, monkeypatch):
    written, keep = [], G.cut
    monkeypatch.setattr(G, "cut", lambda df: written.append(out := keep(df)) or out)
    rows = [(f"a{i % 5}", f"b{i}") for i in range(20)] + [(f"b{i}", f"a{i % 3}") for i in range(20)]
    got = G.simple_paths(spark.createDataFrame(rows, "src string, dst string").withColumn("relation_type", F.lit("r")), spark.createDataFrame([("a0", "a1"), ("a3", "a4")], "s string, t string"), per_pair=30, hub=9)
    assert got.count() == 15
    left = [df.columns for df in written if os.path.isdir(df._lakeweave_path)]
    assert ["source", "target", "path", "rank", "length"] in left and ["source", "target", "node"] not in left
    assert written[0].columns == ["u", "v"] and not os.path.isdir(written[0]._lakeweave_path)
    assert sum(df.columns == ["source", "target", "node"] for df in written) >= 2


def test_influence_and_clustering_leave_no_edges(spark, monkeypatch):
    """Of influence, only edges of hubs are met for an entity's largest hub."""
    written, keep = [], G.cut
    monkeypatch.setattr(G, "cut", lambda df: written.append(out := keep(df)) or out)
    edges = [(f"n{i}", "hub") for i in range(12)] + [(f"n{i}", f"n{i * 5 % 12}") for i in range(12)] + [("n1", "m")]
    relations = spark.createDataFrame(edges, "src string, dst string").withColumn("relation_type", F.lit("x"))
    entities = relations.select(F.col("src").alias("name")).distinct()
    got = G.influence(entities, relations, hub=9)
    assert [df.count() for df in written if df.columns == ["top", "c"]] == [12] and got.count() == 12
    assert G.clustering(entities, relations).count() == 12
    left = [tuple(df.columns) for df in written if os.path.isdir(df._lakeweave_path)]
    assert not {("a", "b"), ("x", "y"), ("a", "b", "top"), ("x", "y", "by_y")} & set(left)


@pytest.mark.parametrize("bits", [58, 3])
def test_nodes_are_numbered_by_hash_unless_two_share_one(spark, bits):
    from lakeweave.operators.strong import numbered

    edges = [(f"n{i}", f"n{i * 7 % 20}") for i in range(20)] + [("n3", "n3"), ("n4", None)]
    nodes, e = numbered(spark.createDataFrame(edges, "src string, dst string"), bits)
    name = {r["id"]: r["name"] for r in nodes.collect()}
    assert sorted(name.values()) == sorted({f"n{i}" for i in range(20)})
    assert sorted((name[r.u], name[r.v]) for r in e.collect()) == sorted((a, b) for a, b in edges if b and a != b)
    assert ("join" in plan_of(e).lower()) == (bits == 3)


@pytest.mark.parametrize("seed", range(3))
def test_components_by_contraction(spark, seed):
    """Against union and find: chains, a hub with what hangs on it, random pairs, a loop; the hub's edges go in the first round."""
    rnd = random.Random(seed)
    edges = [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(40) if i % 9] + [(f"a{rnd.randrange(60):02d}", f"a{rnd.randrange(60):02d}") for _ in range(50)]
    star = [(f"m{i:02d}", "z_hub") for i in range(30)] + [(f"m{i:02d}", f"leaf{i}") for i in range(30)]
    root = {n: n for e in edges + star for n in e}

    def find(n):
        return n if root[n] == n else find(root[n])

    for a, b in edges + star:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    df = lambda rows: spark.createDataFrame(rows, "src string, dst string")
    got = {r.node: r.component for r in G.components(df(edges + star + [("loop", "loop")])).collect()}
    linked = {n for e in edges + star for n in e if e[0] != e[1]}
    assert got == {n: find(n) for n in linked}

    written = []
    keep = G.cut
    G.components(df(star), lambda x: written.append(out := keep(x)) or out)
    assert [t.count() for t in written if t.columns == ["u", "v"]] == [len(star), 0]


def test_cheapest_costs_group_no_edges_first(spark, monkeypatch):
    edges = [("a", "b", 1.0), ("b", "a", 0.4), ("a", "b", 0.7), ("b", "c", None), ("c", "d", 0.5), ("a", "c", 2.0), ("d", "e", 0.1)]
    relations = spark.createDataFrame(edges, "src string, dst string, strength double").withColumn("relation_type", F.lit("x"))
    plans = []
    keep = G.cut
    monkeypatch.setattr(G, "cut", lambda df: plans.append(plan_of(df)) or keep(df))
    got = {(r.source, r.node): round(r.cost, 6) for r in G.cheapest_costs(relations, spark.createDataFrame([("a",), ("z",)], "s string"), 3).collect()}
    assert got == {("a", "a"): 0, ("a", "b"): 0.4, ("a", "c"): 1.4, ("a", "d"): 1.9, ("a", "e"): 2.6, ("z", "z"): 0}
    assert "Exchange" not in plans[0]
