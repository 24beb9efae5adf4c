"""Cell index and similarity join against all pairs by numpy; copies, hot cells, blocks, new and newer vectors."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lakeweave.operators import cells as C
from lakeweave.sources import cell_index as X


def vectors(n=300, d=12, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(7, d))
    x = (centres[rng.integers(0, 7, n)] + rng.normal(size=(n, d)) * 0.6).astype(np.float32)
    x[20:60] = x[19]  # copies
    x[61] = x[60] * 3
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    return rows, [(900, None), (901, []), (902, [0.0] * d), (903, [float("nan")] * d), (904, [None] * d)]


def cos(a, b):
    a, b = np.asarray(a, float), np.asarray(b, float)
    return float((a * b).sum() / (np.sqrt((a * a).sum()) * np.sqrt((b * b).sum())))


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "id long, embedding array<float>, cell string, away int").repartition(3)


@pytest.mark.parametrize("least,rows,block", [(0.9, 20, 1000), (0.5, 40, 16), (0.97, 1000, 7)])
def test_similar_pairs_misses_none(spark, least, rows, block):
    good, bad = vectors()
    df = frame(spark, good + bad)
    classes = {tuple(v): min(i for i, w in good if w == v) for _, v in good}
    reps = sorted((i, v) for v, i in classes.items())
    want = {(a, b) for n, (a, x) in enumerate(reps) for b, y in reps[n + 1 :] if cos(x, y) >= least}
    got = C.similar_pairs(C.classes(df), least, rows, block).collect()
    assert len(got) == len(want) and {(r["a"], r["b"]) for r in got} == want
    links = {r["id"]: (r["class_id"], r["n_links"]) for r in C.linked(df, least, spark.createDataFrame(got) if got else None).collect()}
    assert set(links) == {i for i, _ in good}
    assert links[45] == (19, sum(19 in p for p in want))


def test_similar_pairs_of_nothing(spark):
    assert C.similar_pairs(C.classes(frame(spark, vectors()[1])), 0.5).collect() == []


def brute(rows, queries, k):
    out = set()
    for q, v in queries:
        best = sorted((-round(cos(v, w), 9), i) for i, w in rows if i != q)[:k]
        out |= {(q, i, r + 1) for r, (_, i) in enumerate(best)}
    return out


def test_index(spark, tmp_path):
    good, bad = vectors(600)
    path = f"{tmp_path}/index"
    X.build(frame(spark, good[:400] + bad), path, cell_rows=25)
    moved = [(i, good[i + 100][1]) for i in range(5)]  # newer vectors of ids that are there, in other cells
    for _ in range(2):  # a batch that is added again changes nothing
        X.append(frame(spark, good[400:] + moved), path, 1)
    now = moved + good[5:]
    q = spark.createDataFrame([(i, v) for i, v in now if i % 50 == 0] + [(999, None)], "query_id long, q array<float>")
    asked = [(i, v) for i, v in now if i % 50 == 0]
    exact = X.search(spark, path, q, 5, probes=2, exact=True).collect()
    assert {(r["query_id"], r["id"], r["rank"]) for r in exact} == brute(now, asked, 5)
    near = X.search(spark, path, q, 5, probes=6).collect()
    found = {(r["query_id"], r["id"]) for r in near} & {(a, b) for a, b, _ in brute(now, asked, 5)}
    assert len(found) >= 0.95 * 5 * len(asked)
    plan = X.stored(spark, path, [1, 2])._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(cell" in plan or "PartitionFilters: [cell" in plan
    read = spark.read.parquet(f"{path}/vectors").where("cell in (1, 2)").select(F.input_file_name().alias("f")).distinct().collect()
    assert read and all("cell=1/" in r["f"] or "cell=2/" in r["f"] for r in read)


def test_index_of_nothing(spark, tmp_path):
    X.build(frame(spark, vectors()[1]), f"{tmp_path}/i")
    q = spark.createDataFrame([(1, [1.0])], "query_id long, q array<float>")
    assert X.search(spark, f"{tmp_path}/i", q, 3).collect() == []


def test_distances_are_held_by_slices(monkeypatch):
    """A batch of rows against thousands of centroids is never one matrix, and slices miss no row."""
    rng = np.random.default_rng(2)
    x, at = rng.normal(size=(1000, 8)), rng.normal(size=(300, 8))
    held, keep = [], C.distances
    monkeypatch.setattr(C, "distances", lambda a, b: held.append(len(a)) or keep(a, b))
    got = [(rows, d) for rows, _, d in C.by_slices(pd.Series(list(x)), at)]
    assert max(held) <= 256 and sum(held) == 1000
    unit = x / np.sqrt((x * x).sum(axis=1))[:, None]
    assert np.allclose(np.vstack([d for _, d in got]), keep(unit, at)) and [r.start for r, _ in got] == [0, 256, 512, 768]


def test_open_cells_are_packed_so_that_vectors_are_sent_to_blocks(spark, monkeypatch):
    """At a loose limit a vector is sent to a few groups instead of all cells; no pair is missed, none comes twice."""
    import numpy as np

    from lakeweave.operators import cells as C

    x = np.random.default_rng(5).normal(size=(300, 6))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "class_id long, embedding array<double>")
    sent, keep = [], C.cut
    monkeypatch.setattr(C, "cut", lambda d: sent.append((d.columns, (out := keep(d)).count())) or out)
    got = sorted((r.a, r.b) for r in C.similar_pairs(df, 0.1, rows_per_cell=5, block=80).collect())
    u = x / np.linalg.norm(x, axis=1)[:, None]
    a, b = np.nonzero(np.triu(u @ u.T >= 0.1, 1))
    assert got == sorted(zip(a.tolist(), b.tolist(), strict=True))
    assert [n for columns, n in sent if columns == ["id", "embedding", "cell"]][0] <= 300 * 4
