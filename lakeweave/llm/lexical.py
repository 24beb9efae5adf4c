"""Ranked lexical search of a set of items over all documents, by bag deduplication.

Documents are cut down to the items' vocabulary, once: a document becomes its length class m and its bag, the sorted numbers of
the vocabulary's terms it holds with their counts. Scores depend on nothing else, so documents of equal bag and m are one
class: classes are keyed by a hash with bag and m beside it, which the grouping compares in full. Each class is scored once,
against all items, and every task keeps an item's best classes by score, then by the class's smallest doc_id. The best k classes
of an item hold its best k documents, since each class ahead brings a document ahead. Their members are expanded by ascending
doc_id, k for each class at most.

A term's weight w is floor(1000 ln((2N + 2) / (2 df + 1))), m is 100 - b + (b n N) div L with b = 90, and a document scores
w ((10^9 tf) div (1000 tf + 8 m)) for each of an item's terms. N counts documents with a term, L all terms, n a document's terms.

Scale: items go in blocks of at most about BLOCK_TERMS terms, so that a block's vocabulary and postings fit into a task; a
block is one run over the documents. An item is an item_id: rows that repeat one add their terms. Documents' rows are shuffled
as bags alone, after partial grouping.

Nulls: a null text has no term; an item without terms and an item that no document scores above 0 for have no rows. A null
item_id is an item like others. Null doc_ids rank after all others of an equal score. Repeated rows of a document rank
each by itself. Very long texts are read whole. Empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import words
from .tables import cut, drop

#: Terms of a block of items; rows of classes scored together.
BLOCK_TERMS, STEP = 1 << 18, 512
#: All bytes that are no part of a term: ASCII but digits and letters.
GAP = np.ones(256, bool)
GAP[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def terms_of(text: str | None) -> list[str]:
    """The terms of one text with repeats, in order."""
    for _, data, at in words.slices(pa.array([text or ""]), 1 << 62):
        data = words.LOWER[data]
        s, e, _ = words.runs(data, at, GAP)
        return [x.decode() for x in words.spans(data, s, e)]
    return []


class Vocabulary:
    """Numbers of a sorted list of terms, found by whole arrays of spans: by hash, then byte by byte."""

    def __init__(self, terms: list[str]):
        raw = [t.encode() for t in terms]
        self.data = np.frombuffer(b"".join(raw), np.uint8)
        self.size = np.array([len(x) for x in raw], np.int64)
        self.start = np.cumsum(self.size) - self.size
        h = words.Hasher(self.data)(self.start, self.start + self.size)
        self.order = np.argsort(h, kind="stable")
        self.hashes = h[self.order]

    def find(self, data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        """The term number of each span, -1 for others. Terms of equal hash are tried one after the other."""
        out = np.full(len(s), -1, np.int64)
        if not len(self.hashes) or not len(s):
            return out
        h = words.Hasher(data)(s, e)
        at = np.searchsorted(self.hashes, h)
        left = np.arange(len(s))
        while len(left):
            left = left[at[left] < len(self.hashes)]
            left = left[self.hashes[at[left]] == h[left]]
            if not len(left):
                break
            term = self.order[at[left]]
            n = e[left] - s[left]
            same = self.size[term] == n
            i, t, n = left[same], term[same], n[same]
            if len(i):
                equal = np.logical_and.reduceat(data[words.gather(s[i], n)] == self.data[words.gather(self.start[t], n)], np.cumsum(n) - n)
                out[i[equal]] = t[equal]
            at[left] += 1
            left = left[out[left] < 0]
        return out


def _bag_batches(vocabulary: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Vocabulary(vocabulary)
        for batch in batches:
            for i, data, at in words.slices(batch.column(1)):
                data = words.LOWER[data]
                s, e, first = words.runs(data, at, GAP)
                term = known.find(data, s, e)
                row = np.repeat(np.arange(len(at) - 1), np.diff(first))
                hit = term >= 0
                key, tf = np.unique(row[hit] * len(vocabulary) + term[hit], return_counts=True)
                ends = np.searchsorted(key, np.arange(len(at)) * len(vocabulary)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, len(at) - 1), pa.array(np.diff(first), pa.int64()), pa.ListArray.from_arrays(ends, pa.array((key % max(1, len(vocabulary))).astype(np.int32))), pa.ListArray.from_arrays(ends, pa.array(tf.astype(np.int32)))],
                    ["id", "n", "terms", "tfs"],
                )

    return run


def bags(docs: DataFrame, vocabulary: list[str], id_col: str, text_col: str) -> DataFrame:
    """id, n (all terms of the text), terms (numbers in the vocabulary, ascending), tfs."""
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(_bag_batches(vocabulary), f"id {kind}, n long, terms array<int>, tfs array<int>")


def _score_batches(items: list[list[int]], weight: list[int], k: int):
    """Of each task's classes (key, m, terms, tfs, first): every item's k best by score, then first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = np.array(weight, np.int64)
        size = np.array([len(x) for x in items], np.int64)
        of = np.repeat(np.arange(len(items)), size)
        term = np.concatenate([np.array(x, np.int64) for x in items] or [np.zeros(0, np.int64)])
        by = np.argsort(term, kind="stable")
        posting = of[by]
        start = np.searchsorted(term[by], np.arange(len(w) + 1))
        # item, score, null first?, first, and the class's row
        best: tuple | None = None
        floor = np.zeros(len(items))
        for batch in batches:
            whole = batch
            for lo in range(0, whole.num_rows, STEP):
                part = whole.slice(lo, STEP)
                col = {c: part.column(c) for c in part.schema.names}
                m = np.asarray(col["m"], dtype=np.int64)
                n = np.asarray(pc.list_value_length(col["terms"])).astype(np.int64)
                t = np.asarray(col["terms"].flatten()).astype(np.int64)
                tf = np.asarray(col["tfs"].flatten()).astype(np.int64)
                row = np.repeat(np.arange(part.num_rows), n)
                gain = w[t] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[row]))
                many = start[t + 1] - start[t]
                cell = np.repeat(row, many) * len(items) + posting[words.gather(start[t], many)]
                # Sums stay far below 2**53, so doubles hold them exactly.
                score = np.bincount(cell, np.repeat(gain, many), part.num_rows * len(items)).reshape(part.num_rows, len(items))
                r, i = np.nonzero((score > 0) & (score >= floor))
                if not len(r):
                    continue
                first = col["first"]
                none = np.asarray(pc.is_null(first))
                id_ = np.asarray(first.fill_null(0), dtype=np.int64)
                new = (i, score[r, i].astype(np.int64), none[r], id_[r], r, part)
                best = _merge(best, new, k, floor)
        if best is not None:
            i, score, none, id_, key = best
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(score, pa.int64()), pa.array(id_, pa.int64(), mask=none), pa.array([x[0] for x in key], pa.int64()), pa.array([x[1] for x in key], pa.int64()), pa.array([x[2] for x in key], pa.list_(pa.int32())), pa.array([x[3] for x in key], pa.list_(pa.int32()))], ["item", "score", "first", "key", "m", "terms", "tfs"])

    return run


def _merge(best: tuple | None, new: tuple, k: int, floor: np.ndarray) -> tuple:
    i, score, none, id_, r, part = new
    old = len(best[0]) if best else 0
    if best:
        i, score, none, id_ = (np.concatenate([a, b]) for a, b in zip(best[:4], (i, score, none, id_), strict=True))
    order = np.lexsort((id_, none, -score, i))
    rank = np.arange(len(order)) - np.searchsorted(i[order], i[order])
    order = order[rank < k]
    full = np.bincount(i[order], minlength=len(floor)) >= k
    least = np.full(len(floor), np.inf)
    np.minimum.at(least, i[order], score[order])
    floor[full] = least[full]
    rows: dict[int, tuple] = {}
    key = []
    for x in order.tolist():
        if x < old:
            key.append(best[4][x])
            continue
        at = int(r[x - old])
        if at not in rows:
            one = part.slice(at, 1)
            rows[at] = (one.column("key")[0].as_py(), one.column("m")[0].as_py(), one.column("terms")[0].values.to_numpy(), one.column("tfs")[0].values.to_numpy())
        key.append(rows[at])
    return i[order], score[order], none[order], id_[order], key


def _totals(held: DataFrame) -> tuple[int, int]:
    n, total = held.agg(F.count(F.when(F.col("n") > 0, 1)), F.sum("n")).first()
    return n, total or 0


def _block(held: DataFrame, items: list[tuple], vocabulary: list[str], k: int, b: int) -> DataFrame:
    """item (number in the block), rank, id, score."""
    spark = held.sparkSession
    n_docs, total = _totals(held)
    df = {r[0]: r[1] for r in held.select(F.explode("terms").alias("t")).groupBy("t").count().collect()}  # as many as the block's terms
    w = F.floor(1000 * F.log((2.0 * n_docs + 2) / (2 * F.col("df") + 1)))
    counted = spark.createDataFrame([(t, df.get(t, 0)) for t in range(len(vocabulary))], "t int, df long")
    weight = [r[1] for r in sorted(counted.select("t", w.cast("long")).collect())]
    number = {t: i for i, t in enumerate(vocabulary)}
    asked = [sorted(number[t] for t in terms) for _, terms in items]
    m = F.lit(100 - b) + F.expr(f"({b} * n * {n_docs}L) div {max(1, total)}L")
    known = held.where(F.size("terms") > 0).select("id", m.alias("m"), "terms", "tfs").withColumn("key", F.xxhash64("m", "terms", "tfs"))
    bag = ["key", "m", "terms", "tfs"]
    # As long as ids are integers they go along as they are; the smallest of a class stands for it.
    classes = known.groupBy(*bag).agg(F.min("id").alias("first"))
    scored = classes.select(*bag, F.col("first").cast("long").alias("first")).mapInArrow(_score_batches(asked, weight, k), "item int, score long, first long, key long, m long, terms array<int>, tfs array<int>")
    best = W.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("first"))
    chosen = cut(scored.withColumn("at", F.row_number().over(best)).where(F.col("at") <= k).drop("at"))
    # At most k classes an item, so at most k * BLOCK_TERMS keys.
    keys = F.broadcast(chosen.select("key").distinct())
    by_id = W.partitionBy(*bag).orderBy(F.asc_nulls_last("id"))
    members = known.join(keys, "key", "left_semi").withColumn("at", F.row_number().over(by_id)).where(F.col("at") <= k).drop("at")
    rows = chosen.drop("first").join(members, bag)
    rank = F.row_number().over(W.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id")))
    return rows.select("item", "score", "id").withColumn("rank", rank).where(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = 10, b: int = 90, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", block_terms: int = BLOCK_TERMS) -> DataFrame:
    """item_col, rank, id_col, score: the k best documents of each item, equal scores by ascending id. Ids are integers."""
    spark = docs.sparkSession
    kinds = [docs.schema[id_col].dataType.simpleString(), items.schema[item_col].dataType.simpleString()]
    gaps = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    lower = F.translate(text_col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    asked = items.select(F.col(item_col).alias("item"), F.explode(F.regexp_extract_all(lower, F.lit(gaps), F.lit(0))).alias("term")).distinct()
    asked = cut(asked)
    blocks = max(1, -(-asked.count() // block_terms))
    out = None
    for block in range(blocks):
        here = asked.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block).groupBy("item").agg(F.collect_list("term")).collect()
        if not here:
            continue
        vocabulary = sorted({t for _, terms in here for t in terms})
        held = cut(bags(docs, vocabulary, id_col, text_col))
        names = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(here)], f"item int, {item_col} {kinds[1]}")
        found = cut(_block(held, [tuple(x) for x in here], vocabulary, k, b))
        drop(held)
        found = found.join(names, "item").select(item_col, F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")
        out = found if out is None else out.unionAll(found)
    drop(asked)
    return out if out is not None else spark.createDataFrame([], f"{item_col} {kinds[1]}, rank int, {id_col} {kinds[0]}, score long")
