"""Queries of the cell index and of the exact similarity join over all vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cells as C
from ..operators import search as S
from ..sources import cell_index as X
from ..sources.scratch import folder
from .registry import plan, table

LEAST = 0.4


def _vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")


def _queries(spark, d):
    """The stated query set: every row whose id is divisible by 50."""
    return _vectors(spark, d).where("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("q"))


def _index(spark, d):
    """Of two thirds of the vectors, to which the rest is added as a second batch, and a few of the first anew."""
    path, v = folder(spark), _vectors(spark, d)
    X.build(v.where("id % 3 > 0"), f"{path}/index", cell_rows=20)
    X.append(v.where("id % 3 = 0 or id % 10 = 1"), f"{path}/index", 1)
    return f"{path}/index"


@plan()
def vec2_index_search(spark, d):
    """Approximate: each query's nearest cells alone; the recall is what vec2_recall says."""
    return X.search(spark, _index(spark, d), _queries(spark, d), 10, probes=48).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@plan()
def vec2_recall(spark, d):
    """probes, recall: the share of the exact ten nearest that are found, by number of cells probed."""
    path, q = _index(spark, d), _queries(spark, d)
    exact = S.knn(q, _vectors(spark, d), 10).select("query_id", "id")
    total = exact.agg(F.count("*").alias("total"))
    rows = None
    for probes in (4, 12, 24, 48):
        hit = X.search(spark, path, q, 10, probes=probes).select("query_id", "id").join(exact, ["query_id", "id"], "left_semi").agg(F.count("*").alias("hit")).select(F.lit(probes).alias("probes"), "hit")
        rows = hit if rows is None else rows.union(hit)
    return rows.join(total).select("probes", F.round(F.col("hit") / F.col("total"), 6).alias("recall"))


_V = "v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)"


@plan(f"WITH {_V}, s AS (SELECT q.vec_id AS query_id, v.vec_id AS id, list_cosine_similarity(v.e, q.e) AS score FROM v JOIN v q ON q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) SELECT query_id, id, round(score, 6) AS score, rank::INT AS rank FROM r WHERE rank <= 10")
def vec2_index_exact(spark, d):
    """The same index, read on as far as the cells' bounds leave room for a nearer vector."""
    return X.search(spark, _index(spark, d), _queries(spark, d), 10, probes=2, exact=True).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


_DISTINCT = "c AS (SELECT min(vec_id) AS id, embedding::DOUBLE[] AS e, embedding FROM embeddings GROUP BY embedding)"
_LINKS = f"{_DISTINCT}, links AS (SELECT a.id AS a, b.id AS b, list_cosine_similarity(a.e, b.e) AS score FROM c a JOIN c b ON a.id < b.id AND list_cosine_similarity(a.e, b.e) >= {LEAST})"


@plan(f"WITH {_LINKS} SELECT a, b, round(score, 6) AS score FROM links", name="vec5_similar_pairs")
def vec5_similar_pairs(spark, d):
    """Exact, between the classes of equal vectors."""
    return C.similar_pairs(C.classes(_vectors(spark, d)), LEAST, rows_per_cell=128).select("a", "b", F.round("score", 6).alias("score"))


@plan(f"""WITH {_LINKS}, n AS (SELECT id, count(*) AS n FROM (SELECT a AS id FROM links UNION ALL SELECT b FROM links) GROUP BY id)
SELECT vec_id AS id, c.id AS class_id, coalesce(n, 0) AS n_links FROM embeddings JOIN c USING (embedding) LEFT JOIN n ON n.id = c.id""")
def vec5_links(spark, d):
    """Every vector with its class and the class's number of links."""
    return C.linked(_vectors(spark, d), LEAST)
