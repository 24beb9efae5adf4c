"""Approximate nearest neighbours by largest inner product, with randomly rotated one-bit codes.

Vectors lie in cells around centroids (k-means on a bounded sample). A vector's residual, divided by its length, is rotated
at random; its code is the signs of the result, one bit a dimension, with two scalars: the residual's length and the inner
product of code and residual. From them comes an unbiased estimate of the residual's inner product with any query, and a
bound of its error that holds with high probability. In each group of a query's cells, only vectors whose upper bound
reaches the k-th largest lower bound are compared exactly, in double precision.

A query looks into its `probes` best cells by inner product with the centroid, and further ones until they hold more than k
vectors. Unless given, `probes` is the least number that finds TARGET of the true neighbours of some sample vectors in the
sample: few where vectors gather in clusters, most cells where they hardly do. Cells are dealt into groups of about BLOCK
vectors and BLOCK queries, so a cell with a third of all vectors is many groups.

Vectors that are null, empty or zero, or hold null or non-finite components take no part; a shorter vector counts as if zeros
followed. Candidates are all rows but the query's own, so a second row of its id is one, and repeated ids are ranked each. A
query row that is there more than once, with equal id and vector, is asked once; different vectors of one id are queries of
their own. Ties go to the smaller id. Other columns of the table are ignored, whatever their names; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .tables import cut, least_hashes

#: Vectors to fit centroids on: at least (if there are as many), a cell, at most; fewest vectors for more than one cell;
#: most cells. Cells grow with the root of the number of vectors, so up to MOST_CELLS**2 vectors cells stay that small.
SAMPLE, PER_CELL, MOST_SAMPLE, ONE_CELL, MOST_CELLS = 20_000, 6, 100_000, 2_000, 16_384
BLOCK = 4096
#: Share of the sample's true neighbours that the probed cells have to hold; queries of the sample to find that out.
TARGET, TRIALS = 0.97, 300
#: Error bounds hold with about this many standard deviations.
SIGMAS = 2.5


@dataclass
class Index:
    centroids: np.ndarray
    rotation: np.ndarray
    counts: np.ndarray

    def assign(self, x: np.ndarray) -> np.ndarray:
        c = self.centroids
        return np.concatenate([np.argmax(x[a : a + 2048] @ c.T - 0.5 * (c**2).sum(axis=1), axis=1) for a in range(0, len(x), 2048)] or [np.zeros(0, np.int64)])

    def encode(self, x: np.ndarray, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Packed bits, residual lengths, inner products of code and direction."""
        r = x - self.centroids[cell]
        length = np.sqrt((r**2).sum(axis=1))
        turned = (r / np.maximum(length, 1e-30)[:, None]) @ self.rotation
        d = turned.shape[1]
        return np.packbits(turned > 0, axis=1), length, np.abs(turned).sum(axis=1) / np.sqrt(d)


def usable(v: Column) -> Column:
    """Whether a vector takes part."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(8):
        of = Index(c, np.zeros(0), np.zeros(0)).assign(x)
        n = np.bincount(of, minlength=k)
        sums = np.zeros_like(c)
        np.add.at(sums, of, x)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def _probes(index: Index, x: np.ndarray, k: int) -> int:
    """Cells to look into, from exact neighbours within the sample."""
    cell = index.assign(x)
    ranks = []
    for a in range(0, min(TRIALS, len(x)), 50):
        q = x[a : a + 50]
        s = q @ x.T
        s[np.arange(len(q)), a + np.arange(len(q))] = -np.inf
        top = np.argpartition(-s, min(k, len(x) - 1), axis=1)[:, :k]
        order = np.argsort(-(q @ index.centroids.T), axis=1, kind="stable")
        place = np.argsort(order, axis=1)
        ranks.append(np.take_along_axis(place, cell[top], axis=1).reshape(-1))
    return int(np.quantile(np.concatenate(ranks), TARGET)) + 1


def _group(k: int, rotation: np.ndarray, centroids: np.ndarray):
    def run(key: tuple, vectors: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = [np.zeros(0, np.int64)] * 3 + [np.zeros(0)]
        if len(vectors) and len(queries):
            ids, rows = vectors["vec_id"].to_numpy(), vectors["row"].to_numpy()
            x = np.vstack(vectors["embedding"].to_numpy()).astype(np.float64)
            q = np.vstack(queries["embedding"].to_numpy()).astype(np.float64)
            d = rotation.shape[1]
            bits = np.unpackbits(np.frombuffer(b"".join(vectors["code"]), np.uint8).reshape(len(x), -1), axis=1)[:, :d].astype(np.float32) * 2 - 1
            length, with_code = vectors["length"].to_numpy(), np.maximum(vectors["with_code"].to_numpy(), 1e-6)
            c = centroids[key[0]]
            found = []
            for a in range(0, len(q), 256):
                some = q[a : a + 256]
                norm = np.sqrt((some**2).sum(axis=1))
                estimate = (some @ c)[:, None] + ((some @ rotation).astype(np.float32) @ bits.T) * (length / with_code / np.sqrt(d))
                error = norm[:, None] * (length * np.sqrt(np.maximum(1 - with_code**2, 0)) / with_code * SIGMAS / np.sqrt(max(d - 1, 1)))
                own = queries["query_row"].to_numpy()[a : a + 256, None] == rows
                low = np.where(own, -np.inf, estimate - error)
                near = ~own
                if len(x) > k:
                    near &= estimate + error >= np.partition(low, len(x) - k, axis=1)[:, [len(x) - k]]
                for i, (query, query_row) in enumerate(zip(queries["query_id"].to_numpy()[a : a + 256], queries["query_row"].to_numpy()[a : a + 256], strict=True)):
                    at = np.flatnonzero(near[i])
                    s = (x[at] * some[i]).sum(axis=1)
                    top = np.lexsort((ids[at], -s))[:k]
                    found.append((np.full(len(top), query), np.full(len(top), query_row), ids[at[top]], s[top]))
            out = [np.concatenate(x) for x in zip(*found, strict=True)]
        return pd.DataFrame(dict(zip(("query_id", "query_row", "vec_id", "score"), out, strict=True)))

    return run


def nearest(table: DataFrame, is_query: Column, k: int = 20, id: str = "vec_id", vector: str = "embedding", probes: int | None = None, seed: int = 11) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's k nearest found among all other rows of `table`, nearest first."""
    named = table.select(F.col(id).cast("long").alias("vec_id"), F.col(vector).cast("array<float>").alias("embedding"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    named = named.where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    d, n = named.agg(F.max(F.size("embedding")), F.count("*")).first()
    spark = table.sparkSession
    if d is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    size = F.size("embedding")
    named = named.withColumn("embedding", F.when(size == d, F.col("embedding")).otherwise(F.concat("embedding", F.array_repeat(F.lit(0.0).cast("float"), F.lit(d) - size))))
    rng = np.random.default_rng(seed)
    rotation = np.linalg.qr(rng.normal(size=(d, d)))[0]
    cells = 1 if n < ONE_CELL else min(MOST_CELLS, int(n**0.5))
    want = min(MOST_SAMPLE, max(SAMPLE, PER_CELL * cells)) if cells > 1 else 1
    sample = named.where(F.xxhash64("vec_id") <= least_hashes(want, F.lit(n))).select("vec_id", "embedding").orderBy(F.xxhash64("vec_id"), "vec_id").limit(want).toArrow()
    x = _matrix(sample.column("embedding").combine_chunks())
    fitted = Index(_kmeans(x, min(cells, len(x)), rng), rotation, np.zeros(0))
    probes = probes or (_probes(fitted, x, k) if cells > 1 else 1)
    sent = spark.sparkContext.broadcast(fitted)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            if batch.num_rows:
                v = _matrix(batch.column(1))
                cell = m.assign(v)
                bits, length, with_code = m.encode(v, cell)
                yield pa.record_batch([*batch.columns, pa.array(cell.astype(np.int32)), pa.array([b.tobytes() for b in bits], pa.binary()), pa.array(length), pa.array(with_code)], [*batch.schema.names, "cell", "code", "length", "with_code"])

    coded = named.mapInArrow(code, "vec_id long, embedding array<float>, asks boolean, cell int, code binary, length double, with_code double")
    coded = cut(coded.withColumn("row", F.monotonically_increasing_id()))
    sizes = coded.groupBy("cell").agg(F.count("*").alias("n")).collect()  # at most MOST_CELLS rows
    counts = np.zeros(len(sent.value.centroids), np.int64)
    for r in sizes:
        counts[r["cell"]] = r["n"]
    index = spark.sparkContext.broadcast(Index(sent.value.centroids, rotation, counts))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = index.value
        for batch in batches:
            v = _matrix(batch.column(2)) if batch.num_rows else np.zeros((0, d))
            for a in range(0, len(v), 512):
                order = np.argsort(-(v[a : a + 512] @ m.centroids.T), axis=1, kind="stable")
                held = np.cumsum(m.counts[order], axis=1)
                last = np.maximum(np.argmax(held > k, axis=1) + 1, probes)
                last = np.where(held[:, -1] > k, last, order.shape[1])
                take = (np.arange(order.shape[1]) < last[:, None]) & (m.counts[order] > 0)
                row, at = np.nonzero(take)
                pick = pa.array(a + row)
                yield pa.record_batch([batch.column(0).take(pick), batch.column(1).take(pick), batch.column(2).take(pick), pa.array(order[row, at].astype(np.int32))], ["query_id", "query_row", "embedding", "cell"])

    asks = coded.where("asks").groupBy("vec_id", F.md5(F.col("embedding").cast("string")).alias("of")).agg(F.min(F.struct("row", "embedding")).alias("q"))
    asked = cut(asks.select("vec_id", "q.row", "q.embedding").mapInArrow(probe, "query_id long, query_row long, embedding array<float>, cell int"))
    load = asked.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("q_parts"))
    parts = coded.groupBy("cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("v_parts")).join(load, "cell")
    parts = F.broadcast(parts)
    part = lambda column, n: F.pmod(F.xxhash64(column), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    v = coded.join(parts, "cell").withColumn("v_part", part("row", "v_parts")).withColumn("q_part", each("q_parts"))
    q = asked.join(parts, "cell").withColumn("q_part", part("query_row", "q_parts")).withColumn("v_part", each("v_parts"))
    key = ["cell", "v_part", "q_part"]
    found = v.select(*key, "row", "vec_id", "embedding", "code", "length", "with_code").groupBy(*key).cogroup(q.select(*key, "query_id", "query_row", "embedding").groupBy(*key)).applyInPandas(_group(k, rotation, sent.value.centroids), "query_id long, query_row long, vec_id long, score double")
    rank = F.row_number().over(W.partitionBy("query_row").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
