"""Exact duplicates against a grouping in Python, with digests that several contents share."""

import hashlib

import pytest
from pyspark.sql import functions as F

from lakeweave.llm import exact_dedup

SPACE = dict.fromkeys(map(ord, " \t\n\v\f\r"))


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault((t or "").translate(SPACE), []).append((-len(t or ""), i is None, i))
    best = {k: (min(v), len(v)) for k, v in groups.items()}
    out = []
    for i, t in rows:
        body = (t or "").translate(SPACE)
        (n, _, keep), size = best[body]
        out.append((i, len(t or ""), keep, size, keep == i and -n == len(t or ""), body))
    return out


ROWS = [(1, "a b"), (2, "ab"), (3, "a  b"), (4, "a b"), (5, None), (6, ""), (7, " \n\t\x0b\x0c\r"), (8, "é x"), (9, "éx "), (10, "x" * 100_000), (11, "x" * 50_000 + "\n" + "x" * 50_000)]
ROWS += [(3, "a  b"), (None, "a   b"), (None, "only null"), (None, "only  null"), (12, "lone"), (0, "\x1f"), (13, "a\x1fb")] + [(100 + i, "hot text" + " " * (i % 3)) for i in range(400)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 5) for i, t in rows], "doc_id long, text string, digest string, salt int").repartition(7)


def result(df):
    return sorted([(r["doc_id"], r["n_chars"], r["keep_id"], r["group_size"], r["kept"], bytes(r["digest"])) for r in df.collect()], key=str)


@pytest.mark.parametrize("bytes_kept", [32, 1, 0])
def test_copies(spark, bytes_kept):
    """With one byte of the digest, and with none, different contents share digests and are told apart by content."""
    digest = exact_dedup.sha256 if bytes_kept == 32 else lambda body: F.substring(exact_dedup.sha256(body), 1, bytes_kept)
    got = result(exact_dedup.copies(frame(spark, ROWS), digest=digest))
    want = [(*x[:5], hashlib.sha256(x[5].encode()).digest()[:bytes_kept]) for x in brute(ROWS)]
    assert got == sorted(want, key=str)


def test_empty_and_single(spark):
    empty = frame(spark, ROWS[:1]).limit(0)
    assert exact_dedup.copies(empty).count() == 0 and exact_dedup.without_copies(empty).columns == empty.columns
    assert result(exact_dedup.copies(frame(spark, [(5, None)])))[0][:5] == (5, 0, 5, 1, True)


def test_without_copies(spark):
    out = exact_dedup.without_copies(frame(spark, ROWS))
    assert out.columns == ["doc_id", "text", "digest", "salt"]
    got = sorted([(r["doc_id"], (r["text"] or "").translate(SPACE)) for r in out.collect()], key=str)
    want = {(x[0], x[5]) for x in brute(ROWS) if x[4]}
    assert got == sorted(want, key=str)


def test_no_python_on_the_path(spark):
    plan = exact_dedup.copies(frame(spark, ROWS))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))
