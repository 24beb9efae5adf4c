"""Language models against sums over all segmentations written out, and odd tables."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakeweave.llm import language

WORDS = "the of and to in is that for with on as by at from this be are was house river stone green light paper water".split()
SMALL = sorted({bytes([b]) for b in (*b"abc", *language.MARK)} | {language.MARK, language.MARK + b"a", b"ab", b"abc", b"ca", b"bca"})


def segmentations(word, pieces):
    if not word:
        return [[]]
    return [[p, *rest] for p in pieces if word.startswith(p) for rest in segmentations(word[len(p) :], pieces)]


def brute(word, p):
    """Likelihood and expected pieces of a word under piece probabilities."""
    ways = [(math.prod(p[x] for x in s), s) for s in segmentations(language.MARK + word, list(p))]
    total = sum(v for v, _ in ways)
    expected = Counter()
    for v, s in ways:
        for x in s:
            expected[x] += v / total
    return total, expected


def small_p(seed):
    x = np.random.default_rng(seed).random(len(SMALL)) + 0.1
    return x / x.sum()


def test_forward_and_backward_sum_all_segmentations():
    keys, order = language._hashed(SMALL)
    p = np.column_stack([small_p(1), small_p(2)])
    words = [b"", b"a", b"abca", b"cabcabc", b"bbbb"]
    lattice = language.Lattice(words, keys, order, max(map(len, SMALL)))
    got = lattice.log_likelihood(p)
    expected = lattice.expected(p, np.ones((len(words), 2)))
    for k in (0, 1):
        by = dict(zip(SMALL, p[:, k].tolist(), strict=True))
        assert np.allclose(got[:, k], [math.log(brute(w, by)[0]) for w in words])
        want = sum((brute(w, by)[1] for w in words), Counter())
        assert np.allclose(expected[:, k], [want[x] for x in SMALL])


def test_words_are_never_cut():
    keys, order = language._hashed(SMALL)
    p = small_p(3)
    by = dict(zip(SMALL, p.tolist(), strict=True))
    word = b"abcacb" * 700
    x, a = language.MARK + word, [0.0]
    for j in range(1, len(x) + 1):
        terms = [a[j - n] + math.log(by[x[j - n : j]]) for n in range(1, 7) if n <= j and x[j - n : j] in by]
        top = max(terms)
        a.append(top + math.log(sum(math.exp(t - top) for t in terms)))
    m = language.Model(["x"], keys, order, p[:, None], max(map(len, SMALL)))
    assert m.words([b"a", word])[1, 0] == pytest.approx(a[-1], rel=1e-6)
    assert b"".join(language.parts("日本語".encode() * 40)) == "日本語".encode() * 40
    assert all(len(t) <= 66 and t.decode() for t in language.parts("日本語".encode() * 40))


def test_learning_is_expectation_maximisation(spark, monkeypatch):
    monkeypatch.setattr(language, "vocabulary", lambda path: SMALL)
    rows = [(1, "abc ab, a", "x"), (2, "ca ca! bca", "y"), (3, "ABC b", "x"), (4, None, "x"), (5, "a", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    m = language.learn(df, "none")
    for k, texts in enumerate((["abc", "ab", "a", "abc", "b"], ["ca", "ca", "bca"])):
        p = {x: 1 / len(SMALL) for x in SMALL}
        for _ in range(language.ROUNDS):
            n = Counter({x: language.SMOOTH for x in SMALL}) + sum((brute(t.encode(), p)[1] for t in texts), Counter())
            p = {x: n[x] / sum(n.values()) for x in SMALL}
        assert np.allclose(m.p[:, k], [p[x] for x in SMALL])
        by = [dict(zip(SMALL, m.p[:, i].tolist(), strict=True)) for i in (0, 1)]
    got = {r.doc_id: r for r in language.predict(spark.createDataFrame([(1, "ab ca ab"), (2, "Ca?"), (2, "Ca?"), (3, "...")], "doc_id long, text string"), m).collect()}
    for i, ws in ((1, ["ab", "ca", "ab"]), (2, ["ca"])):
        like = [math.prod(brute(w.encode(), q)[0] for w in ws) for q in by]
        assert got[i].lang_pred == "xy"[int(like[1] > like[0])] and got[i].score == pytest.approx(max(like) / sum(like), rel=1e-4)
    assert got[3].lang_pred == "und" and got[3].score == 0


def test_the_least_hashes_are_sampled(spark):
    from lakeweave.llm.tables import least_hashes

    df = spark.range(20_000).select(F.xxhash64("id").alias("h"))
    some = df.where(F.col("h") <= least_hashes(500, F.lit(20_000)))
    assert 1000 <= some.count() <= 1500 and some.orderBy("h").limit(500).collect() == df.orderBy("h").limit(500).collect()
    assert df.where(F.col("h") <= least_hashes(500, F.lit(900))).count() == 20_000


def test_language(spark):
    french = "le la les des une dans pour que qui avec sur pas au être nous vous maison rivière lumière jardin fenêtre".split()
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(rng.choice(WORDS if i % 2 else french, 30)), "en" if i % 2 else "fr") for i in range(60)]
    df = spark.createDataFrame(rows + [(100, None, "en"), (101, "123 !?", "fr"), (102, "", None)], "doc_id long, text string, lang string").withColumn("n", F.lit(1))
    model = language.learn(df.where("doc_id < 40"), language.default_path())
    got = {r.doc_id: r for r in language.predict(df.select("doc_id", "text"), model).collect()}
    assert all(got[i].lang_pred == l for i, _, l in rows) and all(0 <= r.score <= 1 for r in got.values())
    assert [got[i].lang_pred for i in (100, 101, 102)] == ["und"] * 3
    assert language.predict(df.limit(0), model).count() == 0
    assert language.learn(df.limit(0), language.default_path()) is None
