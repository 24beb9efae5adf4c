"""A persistent index of vectors by cells, for approximate and for exact nearest neighbours.

An index is a folder: `centroids` (cell, centroid), `vectors`, a Parquet table partitioned by batch and cell, and `superseded`,
the ids that a batch brings anew. New vectors are added to their cells' folders; nothing is rewritten, and the centroids stay. A
batch that is added again takes its own place, so a job that was lost half way is just repeated. A search reads the folders of
the cells that its queries probe and no others. Of an id that several batches hold, the newest counts; ids are unique in a batch.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import cells as C
from ..operators.search import QUERY_BLOCK, VECTOR_BLOCK, _nearest_of_block
from .scratch import cut

#: Rows wanted in a cell, and rows of a file, so that a hot cell is written by several tasks.
CELL_ROWS, FILE_ROWS = 1000, 200_000


def build(vectors: DataFrame, path: str, cell_rows: int = CELL_ROWS, most: int = C.MOST_CELLS) -> None:
    """A new index of vectors (id, embedding) at `path`, with about cell_rows vectors a cell, and `most` cells."""
    n = vectors.count()
    centroids = C.fit(vectors, max(1, min(most, n // cell_rows)))
    rows = [(i, c.tolist()) for i, c in enumerate(centroids)]
    vectors.sparkSession.createDataFrame(rows, "cell int, centroid array<double>").coalesce(1).write.parquet(f"{path}/centroids")
    vectors.select(F.col("id").cast("long").alias("id")).limit(0).write.mode("overwrite").parquet(f"{path}/superseded/batch=0")
    _write(vectors, centroids, path, 0)


def append(vectors: DataFrame, path: str, batch: int) -> None:
    """Add vectors to the index, or newer vectors of ids it has; `batch` numbers rise."""
    spark = vectors.sparkSession
    new = vectors.select(F.col("id").cast("long").alias("id"))
    older = spark.read.schema(_STORED).parquet(f"{path}/vectors").where(F.col("batch") < batch).select("id")
    new.join(older, "id", "left_semi").distinct().write.mode("overwrite").parquet(f"{path}/superseded/batch={batch}")
    _write(vectors, read_centroids(spark, path), path, batch)


def read_centroids(spark: SparkSession, path: str) -> np.ndarray:
    rows = spark.read.parquet(f"{path}/centroids").orderBy("cell").toPandas()
    return np.vstack(rows["centroid"].to_numpy()) if len(rows) else np.zeros((0, 0))


def _write(vectors: DataFrame, centroids: np.ndarray, path: str, batch: int) -> None:
    if not len(centroids):
        return
    h = C.homes(vectors.select(F.col("id").cast("long").alias("id"), F.col("embedding")), centroids)
    h = cut(h)
    files = F.broadcast(h.groupBy("cell").agg(F.ceil(F.count("*") / FILE_ROWS).cast("int").alias("_n")))  # a row a cell
    h = h.join(files, "cell").withColumn("_f", F.pmod(F.xxhash64("id"), F.col("_n")))
    h.repartition("cell", "_f").drop("_n", "_f").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/vectors/batch={batch}")


_STORED = "id long, embedding array<float>, away double, batch long, cell int"


def stored(spark: SparkSession, path: str, only: list[int] | None = None) -> DataFrame:
    """id, embedding, away, batch, cell of the index; of `only` these cells: other cells' folders are not read."""
    v = spark.read.schema(_STORED).parquet(f"{path}/vectors")
    v = v if only is None else v.where(F.col("cell").isin(only))
    old = spark.read.schema("id long, batch long").parquet(f"{path}/superseded")
    if old.isEmpty():
        return v
    last = old.groupBy("id").agg(F.max("batch").alias("_b"))
    return v.join(last, (v["id"] == last["id"]) & (v["batch"] < last["_b"]), "left_anti")


def _probed(queries: DataFrame, centroids: np.ndarray, probes: int) -> DataFrame:
    """queries with cell: a row for each of their nearest `probes` cells."""

    @F.pandas_udf("array<int>")
    def near(q: pd.Series) -> pd.Series:
        return pd.Series([x for _, _, d in C.by_slices(q, centroids) for x in np.argsort(d, axis=1, kind="stable")[:, :probes].astype(np.int32)])

    return queries.withColumn("cell", F.explode(near("q")))


def _scored(asked: DataFrame, v: DataFrame, k: int) -> DataFrame:
    """query_id, id, score: each query's k best in each block of the cells it probes. Cells and their queries are dealt into
    blocks, so that neither a hot cell nor a cell of many queries is one task."""
    sizes = v.groupBy("cell").agg(F.ceil(F.count("*") / VECTOR_BLOCK).cast("int").alias("vs"))
    blocks = F.broadcast(sizes.join(asked.groupBy("cell").agg(F.ceil(F.count("*") / QUERY_BLOCK).cast("int").alias("qs")), "cell"))  # a row a cell
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    left = v.select("id", "embedding", "cell").join(blocks, "cell").withColumn("_v", own("id", "vs")).withColumn("_q", every("qs")).drop("vs", "qs")
    right = asked.join(blocks, "cell").withColumn("_q", own("query_id", "qs")).withColumn("_v", every("vs")).drop("vs", "qs")
    keys = ["cell", "_v", "_q"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(_nearest_of_block(k, "cosine", None), "query_id long, id long, score double")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    return found.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)


def search(spark: SparkSession, path: str, queries: DataFrame, k: int, probes: int = 8, exact: bool = False) -> DataFrame:
    """query_id, id, score, rank: of queries (query_id, q) the k vectors of largest cosine in their `probes` nearest cells, other
    than the query's own id; ties to smaller ids.

    exact: then each query visits all further cells that its k-th score does not rule out. A cell whose centroid is d away and
    whose vectors are within r of it holds nothing nearer than d - r, so the bound misses nothing; how many cells are left to
    visit depends on how well the vectors cluster."""
    centroids = read_centroids(spark, path)
    q = queries.where(C.usable(F.col("q"))).select(F.col("query_id").cast("long").alias("query_id"), "q")
    none = spark.createDataFrame([], "query_id long, id long, score double, rank int")
    if not len(centroids):
        return none
    asked = cut(_probed(q, centroids, probes))
    cells = [r[0] for r in asked.select("cell").distinct().collect()]  # at most as many as centroids
    if not cells:
        return none
    found = cut(_ranked(_scored(asked, stored(spark, path, cells), k), k))
    if not exact:
        return found
    sizes = {r["cell"]: r["far"] for r in stored(spark, path).groupBy("cell").agg(F.max("away").alias("far")).collect()}  # a row a cell
    far = np.array([sizes.get(c, -np.inf) for c in range(len(centroids))])
    kth = found.groupBy("query_id").agg(F.min("score").alias("s"), F.count("*").alias("n")).select("query_id", F.when(F.col("n") >= k, F.col("s")).alias("kth"))

    @F.pandas_udf("array<int>")
    def rest(v: pd.Series, s: pd.Series) -> pd.Series:
        out, bar = [], np.sqrt(np.maximum(0.0, 2 - 2 * s.fillna(-1.0).to_numpy(dtype=np.float64))) + C.SLACK
        for rows, _, d in C.by_slices(v, centroids):
            nearest = np.argsort(d, axis=1, kind="stable")[:, :probes]
            open_ = d - far <= bar[rows, None] + 1e-7
            open_[np.arange(len(d))[:, None], nearest] = False
            out += [np.flatnonzero(x).astype(np.int32) for x in open_]
        return pd.Series(out)

    more = cut(q.join(kth, "query_id", "left").withColumn("cell", F.explode(rest("q", "kth"))).select("query_id", "q", "cell"))
    cells = [r[0] for r in more.select("cell").distinct().collect()]
    if not cells:
        return found
    return _ranked(found.drop("rank").union(_scored(more, stored(spark, path, cells), k)), k)
