"""Histories by state from shuffled batches with a restart, and embeddings that are tried again."""

import random

import pandas as pd
import pytest

from lakeweave.functions.embedding import hash_vectors
from lakeweave.streaming import stateful as ST

CHANGES = "entity long, at long, seq long, value string, gone boolean"


def brute(rows):
    out = set()
    for e in {r[0] for r in rows}:
        mine, version = sorted({r[1:] for r in rows if r[0] == e}), 0
        for i, (at, _, value, gone) in enumerate(mine):
            if not gone:
                version += 1
                out.add((e, version, value, at, mine[i + 1][0] if i + 1 < len(mine) else None))
    return out


def run(spark, path, batches, horizon):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, CHANGES).coalesce(1).write.mode("append").parquet(f"{path}/src")
        if i in (1, len(batches) - 1):  # the second run goes on from the first one's checkpoint
            stream = spark.readStream.schema(CHANGES).option("maxFilesPerTrigger", 1).parquet(f"{path}/src")
            query = ST.follow_changes(stream, f"{path}/log", f"{path}/checkpoint", horizon)
            assert query.awaitTermination(120)
    versions, late = ST.versions_of(spark, f"{path}/log")
    return {tuple(r) for r in versions.select("entity", "version", "value", "valid_from", "valid_to").collect()}, {tuple(r) for r in late.collect()}


def test_shuffled_changes(spark, tmp_path):
    rnd = random.Random(2)
    rows = [(rnd.randrange(4), rnd.randrange(100), i, f"v{i}", rnd.random() < 0.2) for i in range(60)]
    rnd.shuffle(rows)
    got, late = run(spark, str(tmp_path), [rows[:25], rows[20:45], rows[45:] + rows[:3]], 1 << 40)
    assert got == brute(rows) and not late


def test_changes_before_the_horizon_are_late_not_lost(spark, tmp_path):
    got, late = run(spark, str(tmp_path), [[(1, 10, 1, "a", False), (1, 50, 2, "b", False), (1, 500, 3, "c", False)], [(1, 20, 4, "too late", False), (1, 450, 5, "in time", False)]], 100)
    assert got == {(1, 1, "a", 10, 50), (1, 2, "b", 50, 450), (1, 3, "in time", 450, 500), (1, 4, "c", 500, None)} and late == {(1, "too late", 20)}


def test_embeddings_are_tried_again(spark, tmp_path):
    path, texts = str(tmp_path), spark.createDataFrame([(1, "one"), (2, "bad"), (3, "one"), (4, None)], "entity long, text string")

    def fn(t: pd.Series):
        if (t == "bad").any():
            raise RuntimeError("no")
        return hash_vectors(t)

    some = lambda *ids: spark.createDataFrame([(i,) for i in ids], "entity long")
    for number, changed in enumerate([some(1, 2, 3, None), some(3), some(9)]):
        for _ in range(2):  # a batch that is repeated changes nothing
            ST.embed_batch(changed, texts, path, number, fn, 1000 + number)
    vectors, work = ST.embedded(spark, path)
    assert {r["entity"]: r["batch"] for r in vectors.collect()} == {1: 0, 3: 1}
    assert vectors.where("entity = 1").first()["embedding"] == pytest.approx(hash_vectors(pd.Series(["one"]))[0])
    assert {(r["entity"], r["status"], r["attempts"]) for r in work.collect()} == {(1, "completed", 1), (2, "failed", 3), (3, "completed", 1), (9, "error", 1)}
    ST.embed_batch(some(2), texts, path, 3, hash_vectors, 1003 + ST.RETENTION)
    vectors, work = ST.embedded(spark, path)
    assert {r["entity"] for r in vectors.collect()} == {1, 2, 3}
    assert {(r["entity"], r["status"]) for r in work.collect()} == {(2, "completed"), (9, "error")}
