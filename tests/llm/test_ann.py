"""Approximate neighbours against brute force; repeated, odd and few vectors."""

from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from lakeweave.llm import ann


def found_by(df, query, k):
    out = defaultdict(list)
    for r in ann.nearest(df, query, k=k).orderBy("query_id", "rank").collect():
        out[r.query_id].append((r.vec_id, r.score))
    return out


def test_recall_and_order(spark):
    rng = np.random.default_rng(1)
    x = np.vstack([rng.normal(size=(2500, 32)), np.tile(rng.normal(size=(1, 32)), (40, 1))]).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(9001, None), (9002, [0.0] * 32), (9003, [float("nan")] * 32), (9005, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"score": F.lit(1), "row": F.lit("clash"), "query_id": F.lit(2), "cell": F.lit(None)})
    got = found_by(df, F.col("vec_id") % 100 == 0, 10)
    hit = total = 0
    for q, found in got.items():
        s = x.astype(float) @ x[q].astype(float)
        s[q] = -np.inf
        true = np.lexsort((np.arange(len(s)), -s))[:10].tolist()
        hit, total = hit + len({i for i, _ in found} & set(true)), total + 10
        assert all(abs(v - s[i]) < 1e-9 for i, v in found) and found == sorted(found, key=lambda f: (-f[1], f[0]))
    assert len(got) == 26 and hit / total >= 0.9
    assert ann.nearest(df.limit(0), F.col("vec_id") == 0).count() == 0
    assert ann.nearest(df.where("vec_id < 5"), F.col("vec_id") == 0).count() == 4


def test_repeated_rows_and_shorter_vectors(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 8)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(0, x[0].tolist()), (20, (3 * x[1]).tolist()), (70, [5.0, -1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    full = np.array([[*v, *[0.0] * (8 - len(v))] for _, v in rows])
    ids = np.array([i for i, _ in rows])
    want = defaultdict(list)
    for q in [i for i in range(len(rows)) if ids[i] % 20 == 0 and i != 60]:
        s = full @ full[q]
        others = [j for j in np.lexsort((ids, -s)) if j != q][:12]
        want[int(ids[q])] += [(int(ids[j]), round(float(s[j]), 9)) for j in others]
    got = {q: [(i, round(s, 9)) for i, s in v] for q, v in found_by(df, F.col("vec_id") % 20 == 0, 12).items()}
    assert {q: sorted(v) for q, v in got.items()} == {q: sorted(v) for q, v in want.items()}
    assert 0 in {i for i, _ in got[0]} and len(got[20]) == 24
