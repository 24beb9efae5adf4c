"""Similarity joins of short texts above a threshold, exact, by keys that every pair over it shares.

Word sets (Jaccard): words have one order, rare ones first. Two sets of similarity t or more share a word among the first
n - ceil(t n) + 1 of each, so only those words are keys: a common word is last in every set and is hardly ever one. Lengths and
the places of a shared word bound the similarity before a pair is made.

Strings (1 - edits / longer length): strings within e edits share one of any e + 1 pieces that one of them is cut into, at a place
that those edits can have moved it to. Keys are pieces with both lengths, so a pair meets only where its lengths allow the
similarity.

Distinct values are compared, not rows, so repeats cost nothing. Nulls and empty texts have no partner. Candidates are verified on
whole texts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import levenshtein_similarity

#: Words that are ordered by their counts: those with more than one in so many of all words, so at most that many words, which
#: bounds the table that is broadcast. Rarer ones come before them in the order of their hashes.
FREQUENT = 50_000
EPS = 1e-9


def words(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(text, " "), lambda w: w != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Of two word arrays."""
    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))


def _prefixes(texts: DataFrame, frequent: DataFrame, least: float) -> DataFrame:
    """text, n, at, w: the first words of each text in the common order, as many as a partner has to share one of."""
    w = texts.select("text", F.explode(words(F.col("text"))).alias("w")).join(frequent, "w", "left")
    order = F.struct(F.coalesce("count", F.lit(0)).alias("c"), F.xxhash64("w").alias("h"), "w")
    sets = w.groupBy("text").agg(F.sort_array(F.collect_list(order)).alias("ws"))
    n = F.size("ws")
    keep = (n - F.ceil(n * least - EPS) + 1).cast("int")
    return sets.select("text", n.alias("n"), F.posexplode(F.slice("ws", F.lit(1), keep)).alias("at", "x")).select("text", "n", "at", "x.w")


def similar_sets(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """a, b, score: texts of `left` and `right` (a column each) whose word sets have a Jaccard similarity of `least` (above 0)
    or more."""
    a, b = (df.toDF("text").where("text != ''").distinct() for df in (left, right))
    every = a.union(b).select(F.explode(words(F.col("text"))).alias("w"))
    counts = every.groupBy("w").count()
    total = every.count()
    frequent = F.broadcast(counts.where(F.col("count") > total / FREQUENT))
    x = _prefixes(a, frequent, least).toDF("a", "n", "i", "w")
    y = _prefixes(b, frequent, least).toDF("b", "m", "j", "w")
    n, m = F.col("n"), F.col("m")
    need = F.ceil((n + m) * (least / (1 + least)) - EPS)
    room = F.least("i", "j") + 1 + F.least(n - F.col("i"), m - F.col("j")) - 1
    met = x.join(y, "w").where((n >= m * least - EPS) & (m >= n * least - EPS) & (room >= need)).select("a", "b").distinct()
    return met.withColumn("score", jaccard(words(F.col("a")), words(F.col("b")))).where(F.col("score") >= least - EPS)


def _edits(least: float, longer: int) -> int:
    return math.floor((1 - least) * longer + EPS)


def _pieces(n: int, parts: int) -> list[tuple[int, int]]:
    """Start and length of `parts` even pieces of n characters."""
    cuts = [n * k // parts for k in range(parts + 1)]
    return [(cuts[k], cuts[k + 1] - cuts[k]) for k in range(parts)]


def _lengths(least: float, n: int) -> range:
    return range(math.ceil(n * least - EPS), math.floor(n / least + EPS) + 1)


def _piece_keys(text: str, least: float) -> set[str]:
    """Keys of a text that is looked up: its pieces, for each number of edits that a partner's length allows."""
    n = len(text)
    return {f"{n}|{m}|{k}|{text[s : s + size]}" for m in _lengths(least, n) if m for k, (s, size) in enumerate(_pieces(n, _edits(least, max(n, m)) + 1))}


def _part_keys(text: str, least: float) -> set[str]:
    """Keys of a text that looks: its parts where pieces of a text of length n can be. A piece moved by d has |d| edits before
    it and |m - n - d| after it at least."""
    m, out = len(text), set()
    for n in _lengths(least, m):
        if not n:
            continue
        e = _edits(least, max(n, m))
        for k, (s, size) in enumerate(_pieces(n, e + 1)):
            for at in range(max(0, s - e), min(m - size, s + e) + 1):
                if abs(at - s) + abs(m - n - (at - s)) <= e:
                    out.add(f"{n}|{m}|{k}|{text[at : at + size]}")
    return out


def _keyed(texts: DataFrame, keys, least: float, name: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = batch["text"].map(lambda text: list(keys(text, least)))
            yield pd.DataFrame({name: batch["text"], "key": found}).explode("key")

    return texts.mapInPandas(run, f"{name} string, key string")


def similar_strings(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """a, b, score: texts of `left` and `right` (a column each) with 1 - edits / longer length of `least` (above 0) or more."""
    a, b = (df.toDF("text").where("text != ''").distinct() for df in (left, right))
    met = _keyed(a, _part_keys, least, "a").join(_keyed(b, _piece_keys, least, "b"), "key").select("a", "b").distinct()
    return met.withColumn("score", levenshtein_similarity(F.col("a"), F.col("b"))).where(F.col("score") >= least - EPS)
