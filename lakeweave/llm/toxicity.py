"""Toxicity by two class-conditional Kneser-Ney models, compared by length-normalised log-likelihoods.

A word is a run of letters, A-Z lower-cased, with a mark before and after it. Each class (toxic, ordinary) has its own
counts of character n-grams of ORDER bytes, discounted by D; below that order, both share one interpolated Kneser-Ney model
of continuation counts of all training texts. So an n-gram that neither class has seen is as likely in both, and a rare one
differs little. A word's likelihoods depend on the word alone and are worked out once a process.

A text's ratio is the mean over its words, and over PRIOR words that say nothing, of what a word's toxic log-likelihood is above
its ordinary one, and above that of the shared counts alone, by more than a margin; a word below that says nothing. (The class
with fewer texts leaves more to the shared counts, so a word that neither has seen would be likelier in it.) The margin is what ordinary words differ by through
chance in the two classes' counts, which in a long text adds up to more than its few toxic words; it shrinks as counts grow, so
the one of MARGINS is taken that tells training texts apart best which the counts haven't seen. The ratio is the score's only
ingredient: a logistic curve over it, rising, fitted on the same texts, makes it a probability.

Training rows are a bounded sample of labelled rows: for each class the `per_class` rows with the least hash of their id,
with their whole texts. Counting and the models' probabilities are Spark aggregations; the driver holds one model's table of
hashed n-grams. Null and empty texts have ratio 0; texts are read whole, repeated rows score alike.
Tables without a label of either class score 0.5 everywhere. Extra columns stay; score and predicted are replaced.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .tables import cut, drop, least_hashes

ORDER, D, PRIOR = 6, 0.9, 20
#: Margins that are tried.
MARGINS = (0.5, 0.75, 1.0, 1.5, 2.0)
#: Ordinary and toxic rows to learn from, at most.
PER_CLASS = (4000, 1500)
#: Kinds of tables: orders below ORDER, shared; n-grams of ORDER by class.
TOP = (ORDER, ORDER + 1)
_U = np.uint64
#: Bytes that aren't letters: ASCII other than a-z.
GAP = np.zeros(256, bool)
GAP[:128] = True
GAP[97:123] = False
MARK = 1


class _Grams:
    """Hashes of the n-grams that end at each byte of the marked words (contexts are cut at the word's start), an order at a
    time."""

    def __init__(self, texts: list[bytes]):
        size = np.array([len(t) + 2 for t in texts], np.int64)
        data = np.frombuffer(b"".join(b"\x01" + t + b"\x01" for t in texts), np.uint8)
        start = np.repeat((np.cumsum(size) - size).astype(np.int32), size)
        at = np.arange(len(data), dtype=np.int32)
        inner = at > start
        self.at, self.start, self.word = at[inner], start[inner], np.repeat(np.arange(len(texts), dtype=np.int32), size)[inner]
        self.size, self.hash = size - 1, words.Hasher(data)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """n-grams and their contexts."""
        s = np.maximum(self.at - n + 1, self.start)
        return self.hash(s, self.at + 1), self.hash(s, self.at)


def _lookup(keys: np.ndarray, values: np.ndarray, x: np.ndarray, missing: float = 0.0) -> np.ndarray:
    if not len(keys):
        return np.full(len(x), missing)
    at = np.minimum(np.searchsorted(keys, x), len(keys) - 1)
    return np.where(keys[at] == x, values[at], missing).astype(float)


@dataclass
class Model:
    #: For each kind from 1: n-grams, their discounted shares, contexts, and what each leaves to the next lower order.
    kinds: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    #: The curve's height at ratio 0 and its slope, 0 or more.
    curve: tuple[float, float] = (0.0, 0.0)
    margin: float = 1.0

    @staticmethod
    def collected(tables: DataFrame, fit: str) -> Model:
        """The model of one fit: a row for each n-gram and context of `tables`."""
        found = tables.where(F.col(fit).isNotNull()).select("kind", "is_context", "key", F.col(fit).cast("float").alias("value")).toArrow()
        kind, is_context = found["kind"].to_numpy(), found["is_context"].to_numpy()
        key, value = found["key"].to_numpy().view(np.uint64), found["value"].to_numpy()
        kinds = []
        for k in range(1, TOP[1] + 1):
            for context in (False, True):
                mine = np.flatnonzero((kind == k) & (is_context == context))
                mine = mine[np.argsort(key[mine])]
                kinds += [key[mine], value[mine]]
        return Model([tuple(kinds[i : i + 4]) for i in range(0, len(kinds), 4)])

    def likelihoods(self, texts: list[bytes]) -> np.ndarray:
        """For each word: log-likelihood by its characters if toxic, if ordinary, and by the counts that both share."""
        grams = _Grams(texts)

        def step(t, gram, context, below):
            return _lookup(t[0], t[1], gram) + _lookup(t[2], t[3], context, 1.0) * below

        p = np.full(len(grams.word), 1 / 256)
        for n in range(1, ORDER):
            p = step(self.kinds[n - 1], *grams(n), p)
        last = grams(ORDER)
        ordinary, toxic = (np.bincount(grams.word, np.log(step(self.kinds[k - 1], *last, p)), len(texts)) for k in TOP)
        shared = np.bincount(grams.word, np.log(p), len(texts))
        return np.column_stack([toxic, ordinary, shared]).astype(np.float32)

    def ratios(self, memo: words.Memo, data: np.ndarray, at: np.ndarray, margins: tuple[float, ...] | None = None) -> np.ndarray:
        """The length-normalised ratio of each row of a slice, at the model's margin; a column for each of `margins`."""
        margins = margins or (self.margin,)
        data = words.LOWER[data]
        s, e, first = words.runs(data, at, GAP)
        n = np.diff(first)
        if not len(s):
            return np.zeros((len(n), len(margins)))
        x = memo(data, s, e, words.Hasher(data)(s, e))
        apart, row = x[:, 0].astype(float) - x[:, 1:].max(axis=1), np.repeat(np.arange(len(n)), n)
        return np.column_stack([np.bincount(row, np.maximum(apart - m, 0), len(n)) / (n + PRIOR) for m in margins])

    def probability(self, ratio: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.curve[0] + self.curve[1] * ratio, -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Height and slope of a logistic curve, by Newton steps with a small ridge, and its loss; the two classes count alike."""
    scale = x.std() + 1e-9
    z = np.column_stack([np.ones(len(x)), x / scale])
    weight = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1)) * len(y)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        d = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + 1e-2 * np.eye(2), z.T @ (weight * (p - y)) + 1e-2 * w)
        w = w - d / max(1.0, np.abs(d).max() / 5)
        if np.abs(d).max() < 1e-6:
            break
    # A larger ratio is evidence of toxicity or none; few training texts may fit it otherwise.
    p = np.clip(1 / (1 + np.exp(-np.clip(z @ w, -30, 30))), 1e-12, 1 - 1e-12)
    return float(w[0]), max(0.0, float(w[1] / scale)), float(-(weight * np.where(y == 1, np.log(p), np.log(1 - p))).mean())


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From label, half, text: label, half, word, n for each slice."""
    for batch in batches:
        for i, data, at in words.slices(batch.column(2)):
            data = words.LOWER[data]
            s, e, first = words.runs(data, at, GAP)
            if not len(s):
                continue
            row = np.repeat(np.arange(len(at) - 1), np.diff(first))
            label, half = (np.asarray(batch.column(c))[i + row] for c in (0, 1))
            own = words.Hasher(data)(s, e)
            group = (2 * label + half).astype(np.uint64)
            _, one, n = np.unique(words.mix(own + group), return_index=True, return_counts=True)
            yield pa.record_batch([pa.array(label[one]), pa.array(half[one]), pa.array(words.spans(data, s[one], e[one]), pa.binary()), pa.array(n)], ["label", "half", "word", "n"])


def _gram_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From word, n00, n01, n10, n11 (counts by label and half): kind, gram, context, longer, w0, w1 for each n-gram. Below
    ORDER, `longer` is the n-gram one longer at the same place and w0, w1 say in which halves it is; in ORDER they count."""
    for batch in batches:
        for a in range(0, batch.num_rows, 20_000):
            part = batch.slice(a, 20_000)
            grams = _Grams(part.column(0).to_pylist())
            count = np.column_stack([np.asarray(c) for c in part.columns[1:]])[grams.word]
            longer, context = grams(ORDER)
            for label, kind in enumerate(TOP):
                yield _gram_rows(kind, longer, context, np.zeros(len(longer), np.uint64), count[:, 2 * label : 2 * label + 2])
            seen = np.minimum(count[:, :2] + count[:, 2:], 1)
            for n in range(ORDER - 1, 0, -1):
                gram, context = grams(n)
                yield _gram_rows(n, gram, context, longer, seen)
                longer = gram


def _gram_rows(kind: int, gram: np.ndarray, context: np.ndarray, longer: np.ndarray, w: np.ndarray) -> pa.RecordBatch:
    whole = [pa.array(x.view(np.int64)) for x in (gram, context, longer)]
    return pa.record_batch([pa.array(np.full(len(gram), kind, np.int32)), *whole, pa.array(w[:, 0]), pa.array(w[:, 1])], ["kind", "gram", "context", "longer", "w0", "w1"])


def tables(sample: DataFrame) -> DataFrame:
    """kind, is_context, key, both, f0, f1: of each n-gram its discounted share and of each context what it leaves to lower
    orders, in the models of both halves of `sample` (label, half, text) and of either half; null where a model lacks it."""
    counted = cut(sample.mapInArrow(_counts, "label int, half int, word binary, n long"))
    of = lambda v, k: F.sum(F.when((F.col("label") == v) & (F.col("half") == k), F.col("n")).otherwise(0)).cast("long").alias(f"n{v}{k}")
    vocabulary = counted.groupBy("word").agg(*[of(v, k) for v in (0, 1) for k in (0, 1)])
    rows = vocabulary.mapInArrow(_gram_batches, "kind int, gram long, context long, longer long, w0 long, w1 long")
    merged = lambda w: F.when(F.col("kind") < ORDER, F.max(w)).otherwise(F.sum(w)).alias(w)
    single = rows.groupBy("kind", "gram", "longer").agg(F.first("context").alias("context"), merged("w0"), merged("w1"))
    both = F.when(F.col("kind") < ORDER, F.greatest("w0", "w1")).otherwise(F.col("w0") + F.col("w1")).alias("both")
    grams = single.select("kind", "gram", "context", "w0", "w1", both)
    fits = {"both": "both", "f0": "w0", "f1": "w1"}
    grams = cut(grams.groupBy("kind", "gram").agg(F.first("context").alias("context"), *[F.sum(w).alias(f) for f, w in fits.items()]))
    taken = lambda f: F.when(F.col(f) >= 1, F.col(f) - D)
    contexts = grams.groupBy("kind", "context").agg(*[F.sum(f).alias(f"{f}_total") for f in fits], *[F.sum(taken(f)).alias(f"{f}_taken") for f in fits])
    shares = grams.join(contexts, ["kind", "context"]).select("kind", F.lit(False).alias("is_context"), F.col("gram").alias("key"), *[(taken(f) / F.col(f"{f}_total")).alias(f) for f in fits])
    left = contexts.select("kind", F.lit(True).alias("is_context"), F.col("context").alias("key"), *[F.when(F.col(f"{f}_taken").isNotNull(), 1 - F.col(f"{f}_taken") / F.col(f"{f}_total")).alias(f) for f in fits])
    out = cut(shares.unionByName(left).where("both is not null"))
    drop(counted, grams)
    return out


def learn(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic", per_class: tuple[int, int] = PER_CLASS) -> Model | None:
    """Fit on the texts of a bounded sample of `labels` (id, label 0 or 1). The counts of one half of the sample and the
    ratios of the other give the curve, so that it sees words as new texts have them; the final counts are those of both."""
    hashed = F.xxhash64("_id", F.lit(7))
    marked = labels.select(F.col(id).alias("_id"), F.col(label).alias("label"), F.pmod(F.xxhash64(F.col(id), F.lit(8)), F.lit(2)).cast("int").alias("half")).where("_id is not null").distinct()
    most = marked.groupBy("label").agg(*[least_hashes(n, F.count("*")).alias(f"m{v}") for v, n in enumerate(per_class)])
    most = {r["label"]: r for r in most.where("label in (0, 1)").collect()}
    picked = [marked.where((F.col("label") == v) & (hashed <= most[v][f"m{v}"] if v in most else F.lit(False))).withColumn("label", F.lit(v)).orderBy(hashed, "_id").limit(n) for v, n in enumerate(per_class)]
    texts = docs.select(F.col(id).alias("_doc"), F.col(text).alias("text"))
    sample = cut(texts.join(F.broadcast(picked[0].union(picked[1])), F.col("_doc") == F.col("_id")).select("label", "half", "text"))
    worded = {(r["label"], r["half"]) for r in sample.where(F.lower("text").rlike(r"[a-z\x80-\x{10FFFF}]")).select("label", "half").distinct().collect()}
    if {v for v, _ in worded} != {0, 1}:
        drop(sample)
        return None
    found = tables(sample)
    curve, margin = (-2.0, 10.0), 1.0  # where one half has no text of a class to fit on
    if len(worded) == 4:
        x, y = [], []
        for k in (0, 1):
            seen, sent = _apply(sample.where(F.col("half") == 1 - k), Model.collected(found, f"f{k}"), "text", ["label"], lambda m, r: [pa.array(c) for c in np.ascontiguousarray(r.T)], ", ".join(f"r{i} double" for i in range(len(MARGINS))), MARGINS)
            seen = seen.toArrow()
            sent.destroy()
            x.append(np.column_stack([seen.column(f"r{i}") for i in range(len(MARGINS))]))
            y.append(np.asarray(seen.column("label")))
        x, y = np.concatenate(x), np.concatenate(y)
        fits = {m: _logistic(x[:, i], y) for i, m in enumerate(MARGINS)}
        margin = min(MARGINS, key=lambda m: fits[m][2])
        curve = fits[margin][:2]
    model = Model.collected(found, "both")
    model.curve, model.margin = curve, margin
    drop(sample, found)
    return model


_loaded: dict[str, tuple[Model, words.Memo]] = {}


def _apply(df: DataFrame, model: Model, text: str, keep: list[str], columns, schema: str, margins: tuple[float, ...] | None = None) -> tuple[DataFrame, Broadcast]:
    """`keep` and what `columns(model, ratios)` gives for each row of `df`; and the model sent out for it."""
    name = uuid.uuid4().hex
    sent = df.sparkSession.sparkContext.broadcast(model)
    source = df.select(*keep, F.col(text).alias("_scored"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _loaded:
            _loaded.clear()
            _loaded[name] = sent.value, words.Memo(sent.value.likelihoods)
        m, memo = _loaded[name]
        for batch in batches:
            for i, data, at in words.slices(batch.column(len(keep))):
                n = len(at) - 1
                yield pa.record_batch([*[c.slice(i, n) for c in batch.columns[:-1]], *columns(m, m.ratios(memo, data, at, margins))], names)

    out = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1]], schema])
    names = [*keep, *[c.split()[0] for c in schema.split(", ")]]
    return source.mapInArrow(run, out), sent


def score(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """`docs` with score (0 to 1) and predicted (1 from 0.5 on)."""
    docs = docs.drop("score", "predicted")
    if model is None:
        return docs.withColumns({"score": F.lit(0.5), "predicted": F.lit(1)})

    def columns(m: Model, ratio: np.ndarray) -> list[pa.Array]:
        p = m.probability(ratio[:, 0])
        return [pa.array(p), pa.array((p >= 0.5).astype(np.int32))]

    return _apply(docs, model, text, docs.columns, columns, "score double, predicted int")[0]
