"""Kneser-Ney models against dictionaries, and scores of repeated, odd and held-out texts."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lakeweave.llm import toxicity, words

WORDS = "the of and to in is that for with on as by at from this be are was house river stone green light paper water".split()
BAD = ["moron", "scum", "idiot", "idiotic"]


def rows_of(n, seed=5):
    rng = np.random.default_rng(seed)
    return [(i, " ".join([*rng.choice(WORDS, 40), *(rng.choice(BAD, 3) if i % 4 == 0 else [])]), int(i % 4 == 0)) for i in range(n)]


def grams(word, n):
    x = b"\x01" + word.encode() + b"\x01"
    return [(x[max(p - n + 1, 0) : p + 1], x[max(p - n + 1, 0) : p]) for p in range(1, len(x))]


def brute(rows):
    """The log-likelihood of a word in a class, by plain dictionaries."""
    o, d = toxicity.ORDER, toxicity.D
    texts = [(re.findall(r"[a-z]+", t.lower()), y) for _, t, y in rows]
    count = [Counter(w for ws, y in texts if y == v for w in ws) for v in (0, 1)]
    vocabulary = set(count[0]) | set(count[1])
    lower = {n: Counter(g for g, _ in {(y[0], x[0]): 1 for w in vocabulary for y, x in zip(grams(w, n), grams(w, n + 1), strict=True)}) for n in range(1, o)}
    top = [Counter() for _ in (0, 1)]
    for v in (0, 1):
        for w, n in count[v].items():
            for g, _ in grams(w, o):
                top[v][g] += n

    def by_context(counter):
        out = defaultdict(list)
        for g, n in counter.items():
            out[g[:-1]].append(n)
        return out

    contexts = {n: by_context(c) for n, c in lower.items()} | {(o, v): by_context(top[v]) for v in (0, 1)}

    def word(w, v):
        """v: 0 or 1, None for the shared counts alone."""
        total = 0.0
        for p in range(len(w) + 1):
            q = 1 / 256
            for n in [*range(1, o), *([] if v is None else [(o, v)])]:
                g, c = grams(w, n if isinstance(n, int) else o)[p]
                table = lower[n] if isinstance(n, int) else top[v]
                seen = contexts[n].get(c, [])
                if seen:
                    q = max(table[g] - d, 0) / sum(seen) + d * len(seen) / sum(seen) * q
            total += math.log(q)
        return total

    return word


@pytest.fixture(scope="module")
def fitted(spark):
    rows = rows_of(60)
    sample = spark.createDataFrame([(y, i % 2, t) for i, t, y in rows], "label int, half int, text string")
    return rows, toxicity.tables(sample)


@pytest.mark.parametrize("fit", ["both", "f0", "f1"])
def test_probabilities_are_kneser_ney(fitted, fit):
    rows, tables = fitted
    word = brute([r for r in rows if fit == "both" or r[0] % 2 == int(fit[1])])
    m = toxicity.Model.collected(tables, fit)
    text = "the house moron of scum idiot unseenword the the river"
    tokens = text.split()
    x = m.likelihoods([w.encode() for w in tokens])
    assert np.allclose(x[:, :2], [[word(w, 1), word(w, 0)] for w in tokens], atol=1e-3)
    memo = words.Memo(m.likelihoods)
    for _, data, at in words.slices(pa.array([text, "", None, "The HOUSE, moron!"])):
        want = [sum(max(word(w, 1) - max(word(w, 0), word(w, None)) - 0.75, 0) for w in ws) / (len(ws) + toxicity.PRIOR) for ws in (tokens, [], [], ["the", "house", "moron"])]
        assert np.allclose(m.ratios(memo, data, at, (9.0, 0.75))[:, 1], want, atol=1e-3)


def test_scores_end_to_end(spark):
    """Scores of whole texts are the fitted curve over ratios that dictionaries give, and rise with them."""
    rows = rows_of(120)
    df = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    model = toxicity.learn(df, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))
    word = brute(rows)
    tokens = {i: re.findall(r"[a-z]+", t.lower()) for i, t, _ in rows}
    known = {w: max(word(w, 1) - max(word(w, 0), word(w, None)) - model.margin, 0) for w in {w for ws in tokens.values() for w in ws}}
    ratio = {i: sum(known[w] for w in ws) / (len(ws) + toxicity.PRIOR) for i, ws in tokens.items()}
    got = {r.doc_id: r.score for r in toxicity.score(df, model).collect()}
    a, b = model.curve
    assert b > 0 and all(abs(got[i] - 1 / (1 + math.exp(-(a + b * ratio[i])))) < 1e-3 for i in got)
    assert all((got[i] >= 0.5) == (y == 1) for i, _, y in rows)


def test_repetition(spark):
    """Ordinary words stay ordinary however often they are said."""
    rows = rows_of(160)
    df = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    model = toxicity.learn(df, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))
    texts = [w * n for w in ("word ", "river ", "moron ") for n in (1, 20, 200, 2000)] + [rows[1][1], (rows[1][1] + " ") * 50, "the " * 200_000]
    got = [r.score for r in toxicity.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1), model).orderBy("doc_id").collect()]
    assert max(*got[:8], *got[12:]) < 0.5 < min(got[8:12])
    assert got[13] <= got[12] + 0.02


def test_odd_labels_and_rows(spark):
    rows = rows_of(40)
    df = spark.createDataFrame([(i, t, 1, 2.0) for i, t, _ in rows] + [(7, rows[7][1], 1, 2.0), (None, None, None, None), (900, "", 0, 0.0)], "doc_id long, text string, label int, score double")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] * 2 + [(None, 1), (3, None)], "doc_id long, toxic int")
    got = toxicity.score(df, toxicity.learn(df, labels)).collect()
    assert len(got) == 43 and len({r.score for r in got if r.doc_id == 7}) == 1 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert toxicity.learn(df, labels.where("toxic = 0")) is None
    assert toxicity.learn(df, labels.where(F.col("doc_id") == 900)) is None
    assert toxicity.score(df.limit(0), toxicity.learn(df, labels)).count() == 0
