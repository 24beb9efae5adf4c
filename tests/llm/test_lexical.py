"""Ranked search against scores worked out document by document."""

import math
import re
from collections import Counter

import pyarrow as pa
import numpy as np
import pytest

from lakeweave.llm import lexical, words

TERM = re.compile("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, items, k=10, b=90):
    bags = [(i, Counter(TERM.findall((t or "").translate(UPPER)))) for i, t in docs]
    full = [sum(x.values()) for _, x in bags if x]
    n_docs, total = len(full), sum(full)
    df = Counter(w for _, x in bags for w in x)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(TERM.findall((t or "").translate(UPPER)))
    out = []
    for item, terms in asked.items():
        scored = []
        for i, bag in bags:
            m = 100 - b + (b * sum(bag.values()) * n_docs) // max(1, total)
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * bag[t]) // (1000 * bag[t] + 8 * m)) for t in terms if t in bag)
            if s > 0:
                scored.append((-s, i is None, i))
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(out, key=str)


def got(df):
    return sorted([tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()], key=str)


DOCS = [(i, f"stone w{i % 7} paper {'green ' * (i % 4)}light") for i in range(60)]
DOCS += [(100, None), (101, ""), (102, "?!"), (103, "École-école ÉCOLE 42"), (104, "écoles"), (None, "stone paper"), (None, "stone paper"), (3, DOCS[3][1]), (105, "word " * 60_000 + "stone"), (106, "STONE Stone_stone"), (107, "stone paper")]
ITEMS = [(1, "Stone paper, light!"), (2, "w3 w4 W3 unheard"), (3, None), (4, "..."), (5, "École 42"), (None, "green"), (6, "paper"), (6, "w1"), (7, "nowhere at all")]


def frames(spark):
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in DOCS], "doc_id long, text string, key int, terms string").repartition(5)
    return docs, spark.createDataFrame([(i, t, "y") for i, t in ITEMS], "item_id long, text string, doc_id string")


@pytest.mark.parametrize("block", [lexical.BLOCK_TERMS, 4])
def test_search(spark, block):
    docs, items = frames(spark)
    out = lexical.search(docs, items, block_terms=block)
    assert out.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    assert got(out) == brute(DOCS, ITEMS)


def test_search_ties_and_small_k(spark):
    """Hundreds of documents of one class and of classes that tie: the smallest ids come first."""
    docs = [(1000 - i, ["stone x", "x stone", "stone y"][i % 3]) for i in range(300)] + [(2000 + i, f"other {i}") for i in range(300)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    items = spark.createDataFrame([(1, "stone"), (2, "stone x"), (3, "other")], "item_id long, text string")
    for k in (1, 3, 10):
        assert got(lexical.search(df, items, k)) == brute(docs, [(1, "stone"), (2, "stone x"), (3, "other")], k)


def test_search_empty(spark):
    docs, items = frames(spark)
    for d, i in ((docs.limit(0), items), (docs, items.limit(0))):
        assert lexical.search(d, i).count() == 0


def test_vocabulary_compares_bytes(monkeypatch):
    """All terms share one hash: still found by their bytes."""
    monkeypatch.setattr(words.Hasher, "__call__", lambda self, s, e: np.zeros(len(s), np.uint64))
    known = lexical.Vocabulary(["a", "ab", "b", "é"])
    for _, data, at in words.slices(pa.array(["ab b", "é ba a"])):
        s, e, _ = words.runs(data, at, lexical.GAP)
        assert known.find(data, s, e).tolist() == [1, 2, 3, -1, 0]
    assert lexical.terms_of("École-A1_b c") == ["École", "a1", "b c"]
