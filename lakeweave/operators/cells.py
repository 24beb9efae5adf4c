"""Cells of vectors around centroids, by distributed k-means, and an exact similarity join over them.

Vectors are scaled to length one, so that a cosine of c is a distance of sqrt(2 - 2 c), and the triangle inequality bounds
what a cell can hold. Vectors that are null, empty, zero or hold null or non-finite components take no part; all others have
one dimension.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import cut

#: Rows of the sample that centroids are fitted on, for each cell; rounds of k-means; cells at most; rows of a block.
FIT_ROWS, ROUNDS, MOST_CELLS, BLOCK = 200, 6, 2048, 4096
#: Rows whose distances to all centroids are held at once, and pairs whose vectors are.
SLICE, PAIRS = 256, 16_384
#: Copies of a vector, on average, up to which it is sent to each open cell; beyond, cells are packed in groups of about a block.
COPIES = 8
#: Slack of bounds and of the first comparison, above what rounding to doubles can move.
SLACK = 1e-9


def usable(v: Column) -> Column:
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.isNotNull() & finite & F.exists(v, lambda x: x != 0)


def _unit(vectors: pd.Series) -> np.ndarray:
    x = np.vstack(vectors.to_numpy()).astype(np.float64)
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, (x * x).sum(axis=1)[:, None] + (centroids * centroids).sum(axis=1) - 2 * x @ centroids.T))


def by_slices(vectors: pd.Series, centroids: np.ndarray) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """(rows, unit vectors, distances to all centroids), SLICE rows at a time: memory is that of a slice by the centroids,
    whatever the rows of a batch."""
    for a in range(0, len(vectors), SLICE):
        x = _unit(vectors.iloc[a : a + SLICE])
        yield slice(a, a + len(x)), x, distances(x, centroids)


def fit(vectors: DataFrame, cells: int, rounds: int = ROUNDS, rows_per_cell: int = FIT_ROWS) -> np.ndarray:
    """Centroids of column embedding, `cells` at most, fitted on the rows of least hash, about rows_per_cell for each cell. Only
    the centroids come to the driver; sums are made by cell and component on Spark."""
    v = vectors.select("embedding").where(usable(F.col("embedding")))
    n = v.count()
    if not n:
        return np.zeros((0, 0))
    hashed = v.withColumn("h", F.xxhash64("embedding"))
    share = min(1.0, (cells * rows_per_cell + 100) / n)
    sample = cut(hashed.where(F.lit(share >= 1) | (F.pmod("h", F.lit(1 << 20)) < int(share * (1 << 20)) + 1)))
    first = sample.dropDuplicates(["h"]).orderBy("h").limit(cells).toPandas()
    if first.empty:
        first = hashed.limit(1).toPandas()
    centroids = _unit(first["embedding"])

    def sums(batches: Iterator[pd.DataFrame], at: np.ndarray) -> Iterator[pd.DataFrame]:
        total, count = np.zeros_like(at), np.zeros(len(at), np.int64)
        for b in batches:
            for _, x, d in by_slices(b["embedding"], at):
                home = d.argmin(axis=1)
                np.add.at(total, home, x)
                count += np.bincount(home, minlength=len(at))
        cell = np.repeat(np.arange(len(at)), at.shape[1])
        yield pd.DataFrame({"cell": cell, "part": np.tile(np.arange(at.shape[1]), len(at)), "s": total.ravel(), "n": count[cell]})

    for _ in range(rounds):
        at = centroids
        got = sample.select("embedding").mapInPandas(lambda b, at=at: sums(b, at), "cell int, part int, s double, n long").groupBy("cell", "part").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).where("n > 0").toPandas()
        moved = centroids.copy()
        moved[got["cell"], got["part"]] = got["s"] / got["n"]
        centroids = moved
    return centroids


def homes(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """`vectors` (usable ones) with cell, the nearest centroid's number, and away, the distance to it."""

    @F.pandas_udf("cell int, away double")
    def home(v: pd.Series) -> pd.DataFrame:
        cell, away = np.zeros(len(v), np.int32), np.zeros(len(v))
        for rows, _, d in by_slices(v, centroids):
            cell[rows] = d.argmin(axis=1)
            away[rows] = d.min(axis=1)
        return pd.DataFrame({"cell": cell, "away": away})

    return vectors.where(usable(F.col("embedding"))).withColumn("_h", home("embedding")).select("*", "_h.cell", "_h.away").drop("_h")


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of the rows of two matrices, in doubles, as `search.similarity` has it."""
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def _pairs_of_block(least: float):
    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        _, i, j, guests = key
        out = []
        if len(left) and len(right):
            a, b = left["id"].to_numpy(), right["id"].to_numpy()
            x, y = (np.vstack(p["embedding"].to_numpy()).astype(np.float64) for p in (left, right))
            u, v = (m / np.sqrt((m * m).sum(axis=1))[:, None] for m in (x, y))
            for s in range(0, len(a), 512):
                p, q = np.nonzero(u[s : s + 512] @ v.T >= least - SLACK)
                p = p + s
                if not guests and i == j:
                    once = a[p] < b[q]
                    p, q = p[once], q[once]
                for c in range(0, len(p), PAIRS):
                    p_, q_ = p[c : c + PAIRS], q[c : c + PAIRS]
                    score = cosine(x[p_], y[q_])
                    ok = score >= least
                    out.append(pd.DataFrame({"a": np.minimum(a[p_], b[q_])[ok], "b": np.maximum(a[p_], b[q_])[ok], "score": score[ok]}))
        return pd.concat(out) if out else pd.DataFrame({"a": [], "b": [], "score": []}).astype({"a": "int64", "b": "int64", "score": "float64"})

    return run


def classes(vectors: DataFrame) -> DataFrame:
    """class_id (the least id), embedding of each distinct vector."""
    return vectors.where(usable(F.col("embedding"))).groupBy("embedding").agg(F.min(F.col("id").cast("long")).alias("class_id"))


def similar_pairs(distinct: DataFrame, least: float, rows_per_cell: int = BLOCK, block: int = BLOCK) -> DataFrame:
    """a, b (a < b), score: all pairs of vectors (class_id, embedding) whose cosine is `least` or more; none is missed.

    Every vector is at home in its nearest cell, and a guest in each cell of a higher number that may hold a partner. A partner's distance
    is r = sqrt(2 - 2 least) at most, so the cell's centroid is within r plus the cell's radius, and, as the partner is nearer
    to that centroid than to the guest's own, at most 2 r farther than the guest's own. Homes and guests of a cell are dealt into
    blocks; a task compares a block with a block and lets out pairs over the limit alone. Repeats of a vector were joined
    before, so copies make no pairs.

    Where bounds leave most cells open, a vector would be sent to each; there cells that follow each other are packed in groups of about a block, as
    one cell whose parts are open or not: a vector is sent once to a group above its own."""
    spark = distinct.sparkSession
    v = cut(distinct.select(F.col("class_id").alias("id"), "embedding"))
    n = v.count()
    if not n:
        return spark.createDataFrame([], "a long, b long, score double")
    centroids = fit(v, max(1, min(MOST_CELLS, -(-n // rows_per_cell))))
    h = cut(homes(v, centroids))
    sizes = {r["cell"]: r for r in h.groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("far")).collect()}  # a row a cell
    far = np.array([sizes[c]["far"] if c in sizes else -np.inf for c in range(len(centroids))])
    reach = float(np.sqrt(max(0.0, 2 - 2 * least))) + SLACK

    def visited(group: np.ndarray):
        """Groups of cells above a vector's own one, of which a cell is open to it."""
        first = np.flatnonzero(np.diff(group, prepend=-1))

        @F.pandas_udf("array<int>")
        def visits(e: pd.Series, cell: pd.Series, away: pd.Series) -> pd.Series:
            out, home, off = [], group[cell.to_numpy()][:, None], away.to_numpy()[:, None]
            for rows, _, d in by_slices(e, centroids):
                open_ = (d <= far + reach + SLACK) & (d - off[rows] <= 2 * reach + SLACK)
                open_ = np.logical_or.reduceat(open_, first, axis=1) & (np.arange(len(first)) > home[rows])
                out += [np.flatnonzero(row).astype(np.int32) for row in open_]
            return pd.Series(out)

        return visits("embedding", "cell", "away")

    group = np.arange(len(centroids), dtype=np.int32)
    if (h.agg(F.sum(F.size(visited(group)))).first()[0] or 0) > COPIES * n:
        rows = np.cumsum([sizes[c]["n"] if c in sizes else 0 for c in range(len(centroids))])
        group = np.unique((rows - 1).clip(0) // block, return_inverse=True)[1].astype(np.int32)
    guests = cut(h.withColumn("cell", F.explode(visited(group))).select("id", "embedding", "cell"))
    h = h.withColumn("cell", F.get(F.array(*map(F.lit, group.tolist())), F.col("cell")))
    blocks = h.groupBy("cell").agg(F.ceil(F.count("*") / block).cast("int").alias("own")).join(guests.groupBy("cell").agg(F.ceil(F.count("*") / block).cast("int").alias("more")), "cell", "left").fillna(0, ["more"])
    blocks = F.broadcast(blocks)  # a row a cell
    part = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    at = h.select("id", "embedding", "cell").join(blocks, "cell")
    up_to = lambda lo, hi: F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<int>"))
    own, more, zero = F.col("own"), F.col("more"), F.lit(0)
    task = lambda kind, other: F.transform(other, lambda j: F.struct(j.alias("j"), F.lit(kind).alias("guests")))
    left = at.withColumn("i", part(own)).withColumn("t", F.explode(F.concat(task(False, up_to(F.col("i"), own - 1)), task(True, up_to(zero, more - 1))))).select("cell", "i", "t.j", "t.guests", "id", "embedding")
    right = at.withColumn("j", part(own)).withColumn("i", F.explode(up_to(zero, F.col("j")))).select("cell", "i", "j", F.lit(False).alias("guests"), "id", "embedding")
    asked = guests.join(blocks, "cell").withColumn("j", part(more)).withColumn("i", F.explode(up_to(zero, own - 1))).select("cell", "i", "j", F.lit(True).alias("guests"), "id", "embedding")
    keys = ["cell", "i", "j", "guests"]
    right = right.union(asked)
    right = right.toDF(*right.columns)  # columns of its own: both sides come from the same table
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(_pairs_of_block(least), "a long, b long, score double")


def linked(vectors: DataFrame, least: float, pairs: DataFrame | None = None) -> DataFrame:
    """id, class_id, n_links of every vector (id, embedding) that takes part: how many other distinct vectors are within `least`."""
    c = cut(classes(vectors))
    p = similar_pairs(c, least) if pairs is None else pairs
    n = p.select(F.explode(F.array("a", "b")).alias("class_id")).groupBy("class_id").agg(F.count("*").alias("n_links"))
    members = vectors.where(usable(F.col("embedding"))).select(F.col("id").cast("long").alias("id"), "embedding").join(c, "embedding").select("id", "class_id")
    return members.join(n, "class_id", "left").select("id", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))
