"""Graph analytics over whole tables: entities (name, entity_type, observations, ...) and relations (src, dst, ...)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import cut, drop
from .strong import ID_BITS, few_broadcast, numbered

#: Targets of one bit-parallel search: the bits of a long without its sign.
MOST_TARGETS = 62
#: Neighbours beyond which a node's are not listed for each path that comes by, but looked up from the other end.
HUB = 2000
#: Pairs at distance two, with repeats, that one task groups; ends of all hubs together up to which they are broadcast.
PAIRS_A_GROUP, MOST_ENDS = 1_000_000, 2_000_000
#: Components whose names are broadcast.
MOST_ROOTS = 50_000


def current(df: DataFrame) -> DataFrame:
    """Rows of open validity."""
    return df.where(F.col("valid_to").isNull())


def adjacency(relations: DataFrame, include: list[str] | None = None, exclude: list[str] | None = None, weighted: bool = False, both: bool = True) -> DataFrame:
    """u, v, relation_type, weight, forward: edges in both directions (or as they are)."""
    if include:
        relations = relations.where(F.col("relation_type").isin(include))
    if exclude:
        relations = relations.where(~F.col("relation_type").isin(exclude))
    weight = F.coalesce("strength", F.lit(1.0)) if weighted else F.lit(1.0)
    ahead = relations.select(F.col("src").alias("u"), F.col("dst").alias("v"), "relation_type", weight.alias("weight"), F.lit(True).alias("forward"))
    back = relations.select(F.col("dst").alias("u"), F.col("src").alias("v"), "relation_type", weight.alias("weight"), F.lit(False).alias("forward"))
    return ahead.unionByName(back) if both else ahead


def undirected(relations: DataFrame) -> DataFrame:
    """Distinct unordered pairs (a < b), without loops."""
    return relations.where("src != dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()


def connection_counts(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """name, connections (in + out), 0 for isolated ones. Relations are read once for both ends; counts are partial before the
    shuffle, so hubs don't hurt."""
    ends = relations.select(F.explode(F.array("src", "dst")).alias("name"))
    return entities.select("name").join(ends.groupBy("name").agg(F.count("*").alias("n")), "name", "left").select("name", F.coalesce("n", F.lit(0)).alias("connections"))


def degrees(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """name, entity_type, in_degree, out_degree, total_degree, n_observations."""
    end = lambda c, out: F.struct(F.col(c).alias("name"), F.lit(out).alias("out"))
    ends = relations.select(F.explode(F.array(end("src", True), end("dst", False))).alias("x"))
    counts = ends.groupBy("x.name").agg(F.count_if("x.out").alias("o"), F.count_if(~F.col("x.out")).alias("i"))
    e = entities.select("name", "entity_type", F.size("observations").cast("long").alias("n_observations")).join(counts, "name", "left")
    i, o = F.coalesce("i", F.lit(0)), F.coalesce("o", F.lit(0))
    return e.select("name", "entity_type", i.alias("in_degree"), o.alias("out_degree"), (i + o).alias("total_degree"), "n_observations")


def degree_centrality(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """name, degree, normalised: degree / (entities - 1)."""
    n = entities.agg(F.count("*").alias("n"))
    d = connection_counts(entities, relations).withColumnRenamed("connections", "degree")
    return d.join(F.broadcast(n)).select("name", "degree", F.when(F.col("n") > 1, F.col("degree") / (F.col("n") - 1)).otherwise(0.0).alias("normalised"))


def neighbours(relations: DataFrame, cap: int = 10) -> DataFrame:
    """name, direction, and up to `cap` neighbours as 'type>name' in order; the cap is by rank, before rows are gathered."""
    both = adjacency(relations).select(F.col("u").alias("name"), F.when(F.col("forward"), "out").otherwise("in").alias("direction"), F.concat_ws(">", "relation_type", "v").alias("item")).distinct()
    r = F.row_number().over(W.partitionBy("name", "direction").orderBy("item"))
    return both.withColumn("r", r).where(F.col("r") <= cap).groupBy("name", "direction").agg(F.array_join(F.array_sort(F.collect_list("item")), "|").alias("items"))


def edges(relations: DataFrame, both: bool = True) -> DataFrame:
    """Distinct u, v without loops, written once: the operators below read it at every level. Of both directions, relations are read
    once and pairs told apart before they are turned."""
    if not both:
        return cut(adjacency(relations, both=False).where("u != v").select("u", "v").distinct())
    turned = F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))
    return cut(undirected(relations).select(F.inline(turned)))


def two_hops(relations: DataFrame, asked: DataFrame | None = None, hub: int = HUB) -> DataFrame:
    """a, c, via: pairs at distance two exactly, with the least node between; a of `asked` (column name), else any.

    The listing is as long as the neighbourhoods of the neighbours of `asked`; of a whole graph with hubs it is quadratic in
    their degrees, so large graphs need a stated set. Its rows are made in the task that groups them: lists of neighbours are sent
    there, not pairs, and lists of hubs (more than `hub` neighbours) once for all. A node with more than PAIRS_A_GROUP steps is
    dealt over tasks by its ends. Between is the least position in the node's own list; its neighbours have the position -1."""
    e = edges(relations)
    first = e.select(F.col("u").alias("a"), F.col("v").alias("b"))
    if asked is not None:
        first = cut(first.join(asked.select(F.col("name").alias("a")).distinct(), "a", "left_semi"))
    degree = cut(e.groupBy(F.col("u").alias("b")).agg(F.count("*").alias("n")))
    hubs = cut(degree.where(F.col("n") > hub))
    piece = F.pmod(F.xxhash64("v"), F.coalesce(F.expr(f"n div {hub} + 1"), F.lit(1)))
    lists = e.withColumnRenamed("u", "b").join(hubs, "b", "left").groupBy("b", piece.alias("piece")).agg(F.collect_list("v").alias("ends"))
    lists = cut(lists.select("b", "ends"))
    if asked is not None:
        drop(e)
    own = first.join(degree, "b").groupBy("a").agg(F.sort_array(F.collect_list("b")).alias("near"), (F.sum("n") + F.count("*")).alias("n"))
    own = cut(own.withColumn("blocks", F.expr(f"n div {PAIRS_A_GROUP} + 1")))
    tasks = int((own.agg(F.sum("n")).first()[0] or 0) // PAIRS_A_GROUP + 1)
    block = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block")
    steps = own.select("a", "blocks", F.posexplode("near").alias("at", "b")).union(own.select("a", "blocks", F.lit(-1), "a"))
    of_block = lambda c: (F.col("blocks") == 1) | (F.pmod(F.xxhash64(c), F.col("blocks")) == F.col("block"))
    once = (hubs.agg(F.sum("n")).first()[0] or 0) <= MOST_ENDS
    sent = steps.join(F.broadcast(hubs.select("b")), "b", "left_anti") if once else steps
    sent = sent.join(lists, "b").select("a", "blocks", block, "at", "b", "ends").withColumn("ends", F.filter("ends", of_block))
    if once:
        sent = sent.union(steps.join(F.broadcast(hubs.select("b")), "b", "left_semi").select("a", "blocks", block, "at", "b", F.lit(None).cast("array<string>")))
    dealt = sent.repartition(tasks, "a", "block")
    if once:
        of_hubs = lists.join(F.broadcast(hubs.select("b")), "b", "left_semi").withColumnRenamed("ends", "hub_ends")
        dealt = dealt.join(F.broadcast(of_hubs), "b", "left").withColumn("ends", F.coalesce("ends", "hub_ends"))
    ends = dealt.select("a", "blocks", "block", "at", F.explode("ends").alias("c")).where(of_block("c")).where("a != c")
    far = ends.groupBy("a", "block", "c").agg(F.min("at").alias("at")).where("at >= 0")
    names = own.select("a", block, "near").repartition(tasks, "a", "block").hint("shuffle_hash")
    return far.join(names, ["a", "block"]).select("a", "c", F.get("near", F.col("at")).alias("via"))


def influence(entities: DataFrame, relations: DataFrame, hub: int = HUB) -> DataFrame:
    """name, direct, indirect, radius (0, 1 or 2) of `entities`, over all relations.

    Of the neighbours that are hubs (more than `hub` neighbours), an entity's largest is never listed: its neighbours are counted
    by its degree, less those next to the entity too, and of the others' only those not next to it are listed."""
    turned = F.inline(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v"))))
    nodes, e = numbered(relations.select("src", "dst"), shape=lambda e: e.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct().select(turned))
    names = entities.select("name").distinct().join(nodes, "name").select(F.col("id").alias("a"))
    first = cut(e.toDF("a", "b").join(names, "a", "left_semi"))
    hubs = cut(e.groupBy(F.col("u").alias("b")).agg(F.count("*").alias("n")).where(F.col("n") > hub))
    of_hubs = cut(e.join(few_broadcast(hubs.select(F.col("b").alias("u"))), "u", "left_semi").select(F.col("u").alias("top"), F.col("v").alias("c")))
    top = cut(first.join(hubs, "b").groupBy("a").agg(F.max(F.struct("n", F.col("b").alias("top"))).alias("t")).select("a", "t.top", "t.n"))
    plain, first = first, cut(first.join(top.select("a", "top"), "a", "left"))
    drop(plain)
    far = first.where("top is null or b != top").join(e.toDF("b", "c"), "b").where("a != c").select("a", "c", "top", F.lit(False).alias("near"))
    far = far.union(first.select("a", F.col("b").alias("c"), "top", F.lit(True))).groupBy("a", "c", "top").agg(F.bool_or("near").alias("near")).where("not near")
    other = far.where("top is not null").join(of_hubs, ["top", "c"], "left_anti")
    listed = far.where("top is null").select("a").union(other.select("a")).groupBy("a").agg(F.count("*").alias("listed"))
    listed = cut(listed)
    both = cut(first.where("b != top").join(of_hubs.toDF("top", "b"), ["top", "b"]).groupBy("a").agg(F.count("*").alias("both")))
    one = cut(first.groupBy("a").agg(F.count("*").alias("d")))
    drop(e, first)
    of_top = F.coalesce(F.col("n") - 1 - F.coalesce("both", F.lit(0)), F.lit(0))
    known = one.join(listed, "a", "left").join(top, "a", "left").join(both, "a", "left").join(nodes.select(F.col("id").alias("a"), "name"), "a")
    j = entities.select("name").join(known.select("name", "d", (of_top + F.coalesce("listed", F.lit(0))).alias("i")), "name", "left")
    d, i = F.coalesce("d", F.lit(0)), F.coalesce("i", F.lit(0))
    return j.select("name", d.alias("direct"), i.alias("indirect"), F.when(i > 0, 2).when(d > 0, 1).otherwise(0).alias("radius"))


def clustering(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """name, triangles, possible, coefficient. Edges lead to the end of higher degree, so hubs give no quadratic number of open
    pairs, and a triangle is x to y, y to z and x to z. For each edge x to y the shorter list is tried: what y leads to, or what x
    leads to; of both only ends that something leads to by a node between."""
    pairs = cut(undirected(relations))
    ends = pairs.select(F.col("a").alias("n")).unionAll(pairs.select(F.col("b").alias("n"))).groupBy("n").agg(F.count("*").alias("deg"))
    ends = cut(ends)
    da, db = ends.select(F.col("n").alias("a"), F.col("deg").alias("da")), ends.select(F.col("n").alias("b"), F.col("deg").alias("db"))
    lower = (F.col("da") < F.col("db")) | ((F.col("da") == F.col("db")) & (F.col("a") < F.col("b")))
    to = pairs.join(da, "a").join(db, "b").select(F.when(lower, F.col("a")).otherwise(F.col("b")).alias("x"), F.when(lower, F.col("b")).otherwise(F.col("a")).alias("y"))
    to = cut(to)
    drop(pairs)
    entered = to.select(F.col("y").alias("x")).distinct()
    last = cut(to.join(entered, "x", "left_semi").select("x", "y"))  # can be y to z
    whole = cut(to.join(last.select("y").distinct(), "y", "left_semi").select("x", "y"))  # can be x to z
    sized = to.join(whole.groupBy("x").agg(F.count("*").alias("nx")), "x").join(last.groupBy(F.col("x").alias("y")).agg(F.count("*").alias("ny")), "y")
    sized = cut(sized.select("x", "y", (F.col("ny") <= F.col("nx")).alias("by_y")))
    drop(to)
    by_y = sized.where("by_y").join(last.toDF("y", "z"), "y").join(whole.toDF("x", "z"), ["x", "z"])
    by_x = sized.where("not by_y").join(whole.toDF("x", "z"), "x").where("y != z").join(last.toDF("y", "z"), ["y", "z"])
    # One after the other, so that open pairs of the two are not on disk at once.
    found = [cut(closed.select(F.explode(F.array("x", "y", "z")).alias("name")).groupBy("name").agg(F.count("*").alias("t"))) for closed in (by_y, by_x)]
    drop(sized, last, whole)
    count = found[0].union(found[1]).groupBy("name").agg(F.sum("t").alias("t"))
    j = entities.select("name").join(ends.withColumnRenamed("n", "name"), "name", "left").join(count, "name", "left")
    t, d = F.coalesce("t", F.lit(0)), F.coalesce("deg", F.lit(0))
    possible = F.expr("coalesce(deg, 0) * (coalesce(deg, 0) - 1) div 2")
    return j.select("name", t.alias("triangles"), possible.alias("possible"), F.when(d > 1, t / possible).otherwise(0.0).alias("coefficient"))


def distances_to_targets(relations: DataFrame, targets: DataFrame, depth: int, both: bool = True) -> DataFrame:
    """node, distance, n: how many of `targets` (one column, up to MOST_TARGETS rows) are at that distance from each node.

    All targets are searched at once: a node holds a bit for each target that it is known to reach, and a level is one join
    with the edges and one bit-or by node, whose partial results keep hubs from meeting in one task."""
    e = edges(relations, both)
    t = targets.toDF("node").distinct()
    if t.count() > MOST_TARGETS:
        raise ValueError(f"more than {MOST_TARGETS} targets")
    bit = F.expr("shiftleft(1L, cast(row_number() OVER (ORDER BY node) - 1 as int))")
    frontier = cut(t.select("node", bit.alias("mask")))
    found, seen = frontier.withColumn("distance", F.lit(0)), frontier
    for level in range(1, depth + 1):
        # Edges point away from a node, so what it reaches comes from its edges' ends.
        near = e.join(frontier.select(F.col("node").alias("v"), "mask"), "v").groupBy(F.col("u").alias("node")).agg(F.bit_or("mask").alias("mask"))
        new = near.join(seen.select("node", F.col("mask").alias("had")), "node", "left")
        frontier = cut(new.select("node", F.expr("mask & ~coalesce(had, 0L)").alias("mask")).where("mask != 0"))
        found = found.unionByName(frontier.withColumn("distance", F.lit(level)))
        seen = cut(seen.unionByName(frontier).groupBy("node").agg(F.bit_or("mask").alias("mask")))
    return found.select("node", "distance", F.bit_count("mask").cast("long").alias("n"))


def shortest_distances(relations: DataFrame, sources: DataFrame, depth: int, both: bool = True) -> DataFrame:
    """source, node, distance for nodes within `depth` hops of each row of `sources` (one column), by a frontier join a level."""
    e = edges(relations, both)
    s = sources.toDF("source").distinct()
    seen = frontier = cut(s.select("source", F.col("source").alias("node"), F.lit(0).alias("distance")))
    for level in range(1, depth + 1):
        reached = frontier.select("source", F.col("node").alias("u")).join(e, "u").select("source", F.col("v").alias("node")).distinct()
        frontier = cut(reached.join(seen.select("source", "node"), ["source", "node"], "left_anti").withColumn("distance", F.lit(level)))
        seen = seen.unionByName(frontier)
    return seen


def simple_paths(relations: DataFrame, pairs: DataFrame, depth: int = 4, per_pair: int = 10, both: bool = True, hub: int = HUB) -> DataFrame:
    """source, target, path (array), length, rank: up to `per_pair` simple paths a pair, shortest first, then in order of names.

    Half-paths grow from both ends and meet in the middle, length by length; a pair with `per_pair` paths looks no further,
    since longer ones rank below. So work is that of half the depth, and plans don't grow with it.

    Up to depth 4, no half-path lists the neighbours of a hub (more than `hub` of them) that it comes by. Paths of length 3 are
    made of edges whose ends are next to a source and to a target. Of length 4, those by a hub first are made from the triples
    hub, node next to it, node next to that; then other first steps go on, as far as in the order of names they come before
    `per_pair` paths. Where both halves have two steps, the paths by each first step are counted before any is made.

    Half-paths of one step are written and sent as the node they end at; tables go as soon as nothing reads them again."""
    e = edges(relations, both)
    back = e if both else cut(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    live = cut(pairs.toDF("source", "target").distinct().where("source != target"))
    n_pairs = live.count()
    ahead = {0: live.select("source", "target", F.array("source").alias("path"), F.col("source").alias("node"))}
    behind = {0: live.select("source", "target", F.array("target").alias("path"), F.col("target").alias("node"))}
    pair = ["source", "target"]
    passing: list[DataFrame] = []

    def brief(df: DataFrame) -> DataFrame:
        """Written until the paths of this length are found."""
        passing.append(cut(df))
        return passing[-1]

    def step(front: bool) -> Column:
        return F.array("source", "node") if front else F.array("node", "target")

    def half(halves: dict[int, DataFrame], i: int, front: bool) -> DataFrame:
        return halves[i].withColumn("path", step(front)) if i == 1 else halves[i]

    def longer(front: bool) -> Column:
        return F.concat("path", F.array("v")) if front else F.concat(F.array("v"), F.col("path"))

    def grown(half: DataFrame, by: DataFrame, stop: str, front: bool) -> DataFrame:
        step = half.where(F.col("node") != F.col(stop)).join(by, half["node"] == by["u"]).where(~F.array_contains("path", F.col("v")))
        return step.select("source", "target", longer(front).alias("path"), F.col("v").alias("node"))

    def of_hubs(by: DataFrame) -> DataFrame:
        return cut(by.join(cut(by.groupBy("u").agg(F.count("*").alias("n")).where(F.col("n") > hub).select("u")), "u", "left_semi"))

    def by_hubs(half: DataFrame, near: DataFrame, met: DataFrame, stop: str, front: bool) -> DataFrame:
        """Half-paths of one step, at a hub, grown by the nodes of `met` (source, target, node) that are next to it."""
        known = met.select("source", "target", F.col("node").alias("v")).distinct().join(near, "v").withColumnRenamed("u", "node")
        step = half.where(F.col("node") != F.col(stop)).join(known, [*pair, "node"]).where(~F.array_contains("path", F.col("v")))
        return step.select("source", "target", longer(front).alias("path"), F.col("v").alias("node"))

    # The order of joined names is that of their first steps as long as no name has the mark that joins them.
    marked = lambda c: F.contains(c, F.lit(">"))
    lazy = depth <= 4 and e.where(marked("u") | marked("v")).isEmpty()
    if lazy:
        near = of_hubs(e)
        near_back = near if both else of_hubs(back)
        hubs, hubs_back = cut(near.select(F.col("u").alias("node")).distinct()), cut(near_back.select(F.col("u").alias("node")).distinct())

    def ends(half: DataFrame, name: str) -> DataFrame:
        """The nodes that half-paths end at, written, so that few of them meet the edges without a shuffle of those."""
        return brief(half.select(F.col("node").alias(name)).distinct())

    def of_three(one: DataFrame, other: DataFrame) -> DataFrame:
        """Halves of two steps that end next to their pair's target."""
        to = brief(e.join(ends(one, "u"), "u", "left_semi").join(ends(other, "v"), "v", "left_semi").select("u", "v"))
        plain = grown(one.join(hubs, "node", "left_anti"), to, "target", True)
        return plain.union(by_hubs(one.join(hubs, "node", "left_semi"), near, other, "target", True))

    def of_four(one: DataFrame, other: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """(paths by a hub first, halves of two steps from the sources by other nodes, halves to the targets)."""
        first = brief(one.join(hubs, "node", "left_semi").where("node != target").select(*pair, F.col("node").alias("g")))
        last = other.where("node != source").select(*pair, F.col("node").alias("v"))
        by_first = near.toDF("g", "m").join(first.select("g").distinct(), "g", "left_semi")
        triples = by_first.join(e.toDF("m", "v").join(ends(other, "v"), "v", "left_semi"), "m").where("g != v")
        whole = first.join(last, pair).join(triples, ["g", "v"]).where("m != source and m != target and g != v")
        whole = brief(whole.select(*pair, F.array("source", "g", "m", "v", "target").alias("path")))
        n = whole.groupBy(*pair, F.get("path", F.lit(1)).alias("node")).agg(F.count("*").alias("n"))
        rest = one.join(hubs, "node", "left_anti")
        steps = rest.select(*pair, "node", F.lit(0).cast("long").alias("n"), F.lit(True).alias("asked")).union(n.select(*pair, "node", "n", F.lit(False)))
        before = W.partitionBy(*pair).orderBy(F.concat("node", F.lit(">"))).rowsBetween(W.unboundedPreceding, W.currentRow)
        open_ = brief(steps.withColumn("before", F.sum("n").over(before)).where("asked").where(F.col("before") < per_pair).select(*pair, "node"))
        a = brief(grown(open_.select(*pair, F.array("source", "node").alias("path"), "node"), e, "target", True))
        other = brief(other.join(open_.select(*pair).distinct(), pair, "left_semi"))
        b = brief(grown(other.join(hubs_back, "node", "left_anti").select(*pair, "path", "node"), back, "source", False))
        return whole, a, brief(b.union(by_hubs(other.join(hubs_back, "node", "left_semi"), near_back, a, "source", False)))

    def of_first_steps(a: DataFrame, b: DataFrame) -> DataFrame:
        """Rows of `a` by the first steps, in order, that come before `per_pair` paths are sure; of those of one node between,
        one at most comes by the first step again."""
        n = b.groupBy("source", "target", "node").agg(F.count("*").alias("n"))
        first = F.get("path", F.lit(1))
        sure = a.join(n, [*pair, "node"]).groupBy("source", "target", first.alias("first")).agg(F.sum(F.col("n") - 1).alias("sure"))
        before = W.partitionBy("source", "target").orderBy(F.concat("first", F.lit(">"))).rowsBetween(W.unboundedPreceding, -1)
        kept = sure.withColumn("before", F.coalesce(F.sum("sure").over(before), F.lit(0))).where(F.col("before") < per_pair).select(*pair, "first")
        return a.withColumn("first", first).join(kept, [*pair, "first"], "left_semi").drop("first")

    found, halves = None, []
    for length in range(1, depth + 1):
        i, j = (length + 1) // 2, length // 2
        left = lambda half: half.join(live, pair, "left_semi")
        whole = None
        if lazy and length == 3:
            few = 2 * live.count() < n_pairs
            halves = [ahead[1], behind[1]]
            ahead[1], behind[1] = left(ahead[1]), left(behind[1])
            if few:
                ahead[1], behind[1] = cut(ahead[1]), cut(behind[1])
                drop(*halves)
            a, b = of_three(half(ahead, 1, True), behind[1]), behind[1]
        elif lazy and length == 4:
            whole, a, b = of_four(left(ahead[1]), left(half(behind, 1, False)))
            a = of_first_steps(a, b)
        else:
            lean = lambda df, k: df.drop("path") if k == 1 else df
            if i not in ahead:
                ahead[i] = cut(lean(grown(left(half(ahead, i - 1, True)), e, "target", True), i))
            if j not in behind:
                behind[j] = cut(lean(grown(left(half(behind, j - 1, False)), back, "source", False), j))
            a, b = ahead[i], behind[j]
        # What is left out of halves of one step comes back after they have met.
        b = b.withColumnRenamed("path", "rest")
        met = a.join(b, ["source", "target", "node"])
        met = met if "path" in a.columns else met.withColumn("path", step(True))
        met = met if "rest" in b.columns else met.withColumn("rest", step(False))
        met = met.where(F.size(F.array_intersect("path", "rest")) == 1)
        met = met.select("source", "target", F.concat("path", F.expr("slice(rest, 2, greatest(size(rest) - 1, 0))")).alias("path"))
        met = met if whole is None else met.union(whole)
        r = F.row_number().over(W.partitionBy("source", "target").orderBy(F.array_join("path", ">")))
        met = met.withColumn("rank", r).where(F.col("rank") <= per_pair).withColumn("length", F.lit(length))
        shorter, found = found, cut(met if found is None else found.unionByName(met))
        drop(*passing, *([] if shorter is None else [shorter]))
        passing.clear()
        if length < depth:
            full = found.groupBy("source", "target").agg(F.count("*").alias("c")).where(F.col("c") >= per_pair)
            live = cut(live.join(full, ["source", "target"], "left_anti"))
            if live.isEmpty():
                break
    drop(e, back, *halves, *ahead.values(), *behind.values())
    r = F.row_number().over(W.partitionBy("source", "target").orderBy("length", F.array_join("path", ">")))
    return found.withColumn("rank", r).where(F.col("rank") <= per_pair).select("source", "target", "path", "length", "rank")


def path_overlaps(paths: DataFrame) -> DataFrame:
    """source, target, n_paths, uniqueness: 1 less the mean overlap (shared nodes by those of the longer path) of a pair's paths.
    A pair has at most as many paths as were listed, so the self join stays small."""
    p = paths.select("source", "target", "rank", "path")
    q = p.select("source", "target", F.col("rank").alias("other"), F.col("path").alias("path_b"))
    shared = p.join(q, ["source", "target"]).where("rank < other").select("source", "target", (F.size(F.array_intersect("path", "path_b")) / F.greatest(F.size("path"), F.size("path_b"))).alias("o"))
    mean = shared.groupBy("source", "target").agg(F.avg("o").alias("mean"))
    n = p.groupBy("source", "target").agg(F.count("*").alias("n_paths"))
    return n.join(mean, ["source", "target"], "left").select("source", "target", "n_paths", (1 - F.coalesce("mean", F.lit(0.0))).alias("uniqueness"))


def cheapest_costs(relations: DataFrame, sources: DataFrame, rounds: int) -> DataFrame:
    """source, node, cost: least sum of weights over at most `rounds` edges. In each round only nodes whose cost fell relax
    their edges. Of repeated edges the least weight wins in each round, where costs are combined before the shuffle anyway, so edges are
    not grouped first."""
    e = cut(adjacency(relations, weighted=True).select("u", "v", "weight"))
    s = sources.toDF("source").distinct()
    cost = moved = cut(s.select("source", F.col("source").alias("node"), F.lit(0.0).alias("cost")))
    for _ in range(rounds):
        step = moved.select("source", F.col("node").alias("u"), "cost").join(e, "u").groupBy("source", F.col("v").alias("node")).agg(F.min(F.col("cost") + F.col("weight")).alias("new"))
        both = cut(cost.join(step, ["source", "node"], "full"))
        cost = both.select("source", "node", F.least("cost", "new").alias("cost"))
        moved = both.where("cost is null or new < cost").select("source", "node", F.col("new").alias("cost"))
    return cost


def induced(relations: DataFrame, names: DataFrame, mode: str = "induced") -> DataFrame:
    """Relations with both ends (induced) or any end (incident) among `names` (column name)."""
    n = names.select("name").distinct()
    src, dst = n.withColumnRenamed("name", "src"), n.withColumnRenamed("name", "dst")
    if mode == "induced":
        return relations.join(src, "src", "left_semi").join(dst, "dst", "left_semi")
    flag = lambda df, c: df.withColumn(f"_{c}", F.lit(True))
    return relations.join(flag(src, "a"), "src", "left").join(flag(dst, "b"), "dst", "left").where(F.col("_a") | F.col("_b")).drop("_a", "_b").select(*relations.columns)


def density(n: Column, r: Column) -> Column:
    return F.when(n > 1, r / (n * (n - 1))).otherwise(0.0)


def components(relations: DataFrame, cut: Callable[[DataFrame], DataFrame] = cut) -> DataFrame:
    """node, component (its least reachable node) of an edge table (src, dst), by contraction: in a round each node hooks to its neighbour
    of highest degree (by powers of two, then by number) if that is above its own, paths to the roots are halved until still, and
    edges are those between roots that are left. What hangs on hubs goes in the first round, so rounds after it are small.
    cut(df) writes a table and reads it back, so that plans don't grow and lost executors don't matter."""
    nodes, edges = numbered(relations.where("src != dst").select("src", "dst"))
    edges, known = cut(edges), None
    while not edges.isEmpty():
        both = edges.union(edges.select("v", "u"))
        degree = F.floor(F.log2(F.count("*"))).cast("long")
        rank = cut(both.groupBy("u").agg(F.shiftleft(degree, ID_BITS).bitwiseOR(F.col("u")).alias("rank")).toDF("id", "rank"))
        told = both.join(rank.toDF("v", "r"), "v").groupBy("u").agg(F.max("r").alias("r"))
        up = F.greatest("r", "rank").bitwiseAND((1 << ID_BITS) - 1)
        to = cut(told.join(rank.toDF("u", "rank"), "u").select(F.col("u").alias("id"), up.alias("root")))
        while True:
            on = to.where("id != root").select(F.col("id").alias("root"), F.col("root").alias("next"))
            after = cut(to.join(on, "root", "left").select("id", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
            to, still = after.drop("moved"), after.where("moved").isEmpty()
            if still:
                break
        u, v = to.toDF("u", "a"), to.toDF("v", "b")
        edges = cut(edges.join(u, "u").join(v, "v").where("a != b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct())
        known = to if known is None else cut(known.join(to.toDF("root", "next"), "root", "left").select("id", F.coalesce("next", "root").alias("root")))
    if known is None:
        return nodes.select(F.col("name").alias("node"), F.col("name").alias("component"))
    named = cut(nodes.join(known, "id").select("name", "root"))
    least = cut(named.groupBy("root").agg(F.min("name").alias("component")))
    least = F.broadcast(least) if least.count() <= MOST_ROOTS else least
    return named.join(least, "root").select(F.col("name").alias("node"), "component")
