"""Vector search, keyword search and their fusion, for whole tables of queries."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def similarity(a: Column, b: Column, metric: str = "cosine") -> Column:
    """cosine: 1 - distance; l2: 1 - distance; inner: the product."""
    if metric == "inner":
        return dot(a, b)
    if metric == "l2":
        return 1 - F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) ** 2), F.lit(0.0), lambda s, x: s + x))
    return dot(a, b) / (norm(a) * norm(b))


#: Queries and vectors that one task compares.
QUERY_BLOCK, VECTOR_BLOCK = 2048, 32_768


def _nearest_of_block(k: int, metric: str, least: float | None):
    """Top k of each query of a block among the vectors of a block; scores in double precision."""

    def score(x: np.ndarray, q: np.ndarray) -> np.ndarray:
        if metric == "l2":
            return 1 - np.sqrt(((x - q) ** 2).sum(axis=1))
        s = (x * q).sum(axis=1)
        return s if metric == "inner" else s / (np.sqrt((x**2).sum(axis=1)) * np.sqrt((q**2).sum()))

    def run(key: tuple, vectors: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(vectors) and len(queries):
            ids, asked = vectors["id"].to_numpy(), queries["query_id"].to_numpy()
            x, q = (np.vstack(df[c].to_numpy()).astype(np.float64) for df, c in ((vectors, "embedding"), (queries, "q")))
            scaled = x / np.sqrt((x**2).sum(axis=1))[:, None] if metric == "cosine" else x
            half = (x**2).sum(axis=1) / 2 if metric == "l2" else 0.0
            for a in range(0, len(q), 128):
                rough = q[a : a + 128] @ scaled.T - half
                for i in range(len(rough)):
                    r = np.where(ids == asked[a + i], -np.inf, rough[i])
                    bar = np.partition(r, len(r) - k)[len(r) - k] if len(r) > k else -np.inf
                    at = np.flatnonzero((r >= bar - 1e-9 * max(1.0, abs(bar) if np.isfinite(bar) else 1.0)) & (r > -np.inf))
                    s = score(x[at], q[a + i])
                    top = np.lexsort((ids[at], -s))[:k]
                    top = top if least is None else top[s[top] >= least]
                    out.append(pd.DataFrame({"query_id": asked[a + i], "id": ids[at[top]], "score": s[top]}))
        return pd.concat(out) if out else pd.DataFrame({"query_id": [], "id": [], "score": []}).astype({"query_id": "int64", "id": "int64", "score": "float64"})

    return run


def knn(queries: DataFrame, vectors: DataFrame, k: int, metric: str = "cosine", least: float | None = None, where: Column | None = None) -> DataFrame:
    """query_id, id, score, rank: exact neighbours of a stated query set (query_id, q), without each query's own id. Filters
    come before the top k. Queries and vectors are dealt into blocks by hash; a task multiplies a block by a block and keeps
    its top k, so neither side is broadcast. Null, empty and, for cosine, zero vectors take no part; all others have one
    dimension."""
    usable = lambda c: F.exists(c, lambda x: x != 0) if metric == "cosine" else F.size(c) > 0
    v = (vectors.where(where) if where is not None else vectors).select(F.col("id").cast("long").alias("id"), "embedding").where(usable("embedding"))
    q = queries.select(F.col("query_id").cast("long").alias("query_id"), "q").where(usable("q"))
    v_parts, q_parts = max(1, -(-v.count() // VECTOR_BLOCK)), max(1, -(-q.count() // QUERY_BLOCK))
    own = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    v = v.withColumn("_v", own("id", v_parts)).withColumn("_q", every(q_parts))
    q = q.withColumn("_q", own("query_id", q_parts)).withColumn("_v", every(v_parts))
    found = v.groupBy("_v", "_q").cogroup(q.groupBy("_v", "_q")).applyInPandas(_nearest_of_block(k, metric, least), "query_id long, id long, score double")
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def vector_profile(vectors: DataFrame) -> DataFrame:
    """id, dim, norm, least, most, mean, valid for each vector."""
    v = F.col("embedding")
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select("id", F.size(v).alias("dim"), norm(v).alias("norm"), F.array_min(v).cast("double").alias("least"), F.array_max(v).cast("double").alias("most"), (F.aggregate(v, F.lit(0.0), lambda s, x: s + x) / F.size(v)).alias("mean"), (ok & (norm(v) > 0)).alias("valid"))


def fuse_weighted(keyword: DataFrame, vector: DataFrame, graph_weight: float = 0.4, vector_weight: float = 0.6) -> DataFrame:
    """query_id, name, score, source of a full outer merge of two scored lists (query_id, name, score)."""
    g = keyword.select("query_id", "name", F.col("score").alias("g"))
    j = g.join(vector.select("query_id", "name", F.col("score").alias("v")), ["query_id", "name"], "full")
    score = F.coalesce(F.col("g") * graph_weight, F.lit(0.0)) + F.coalesce(F.col("v") * vector_weight, F.lit(0.0))
    source = F.when(F.col("g").isNotNull() & F.col("v").isNotNull(), "hybrid").when(F.col("g").isNotNull(), "graph").otherwise("vector")
    return j.select("query_id", "name", score.alias("score"), source.alias("source"))


def fuse_ranks(lists: DataFrame, k: int = 60) -> DataFrame:
    """query_id, name, score: reciprocal rank fusion of ranked lists (query_id, source, name, rank from 0)."""
    return lists.groupBy("query_id", "name").agg(F.sum(1 / (F.lit(k) + F.col("rank") + 1)).alias("score"))


def search(keyword: DataFrame, vector: DataFrame, strategy: str = "hybrid", limit: int = 10) -> DataFrame:
    """Results by strategy: graph, vector, hybrid or rrf; an empty vector list falls back to keywords in hybrid."""
    if strategy == "graph":
        out = keyword.select("query_id", "name", "score")
    elif strategy == "vector":
        out = vector.select("query_id", "name", "score")
    elif strategy == "rrf":
        w = W.partitionBy("query_id").orderBy(F.desc("score"), "name")
        ranked = [df.select("query_id", F.lit(s).alias("source"), "name", (F.row_number().over(w) - 1).alias("rank")) for df, s in ((keyword, "g"), (vector, "v"))]
        out = fuse_ranks(ranked[0].union(ranked[1]))
    else:
        out = fuse_weighted(keyword, vector).select("query_id", "name", "score")
    r = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "name"))
    return out.withColumn("rank", r).where(F.col("rank") <= limit)
