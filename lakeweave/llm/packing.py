"""Packing of token pieces into sequences by a grouping genetic algorithm on islands.

Pieces are dealt at random into blocks of about BLOCK pieces. A block is packed on ISLANDS islands, each in a group (and so
a task) of its own, with a small population: best fit by falling length, and by disturbed orders. A child takes whole
well-filled bins of one parent, loses the other parent's bins that hold the same pieces, and gets the displaced pieces by
best fit. After each epoch an island's elite goes on to the next island as well. The best elite packs the block. Pieces in
bins that stayed below WELL_FILLED are dealt into new blocks and packed once more.

Nothing is larger than a block in one task. Lengths over the capacity aren't accepted (cut first); empty tables give empty
tables; nulls in other columns and repeated rows are carried along. The result is the same for the same input rows and
order of files.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .encode import encoder
from .tables import cut

CAPACITY = 4096
#: Pieces in a block, islands, individuals on each, epochs, children an epoch.
BLOCK, ISLANDS, POPULATION, EPOCHS, CHILDREN = 2048, 3, 4, 2, 12
WELL_FILLED = 0.985


def pieces(docs: DataFrame, tokenizer: str, id: str = "doc_id", text: str = "text", end: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """<id>, row, piece, start, length, ids_crc32: a text's ids and then `end`, cut only where longer than `capacity`.
    Null texts count as empty and give one piece, of `end` alone. row: unique for each piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, row = encoder(tokenizer), (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40
        for batch in batches:
            for i, data, at in words.slices(batch.column(1)):
                ids, off = encode(data, at)
                doc, start, length, crc = [], [], [], []
                for k, (a, b) in enumerate(zip(off[:-1].tolist(), off[1:].tolist(), strict=True)):
                    whole = np.append(ids[a:b], np.uint32(end)).astype("<u4")
                    for s in range(0, len(whole), capacity):
                        x = whole[s : s + capacity]
                        doc.append(i + k)
                        start.append(s)
                        length.append(len(x))
                        crc.append(zlib.crc32(x.tobytes()))
                start = np.array(start, np.int64)
                yield pa.record_batch(
                    [batch.column(0).take(pa.array(doc)), pa.array(row + np.arange(len(doc))), pa.array((start // capacity).astype(np.int32)), pa.array(start), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                    ["id", "row", "piece", "start", "length", "ids_crc32"],
                )
                row += len(doc)

    source = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"))
    return source.mapInArrow(run, "id long, row long, piece int, start long, length long, ids_crc32 long").withColumnRenamed("id", id)


def best_fit(length: np.ndarray, order: np.ndarray, room: list[int], into: np.ndarray) -> None:
    """Put the pieces of `order`, in turn, into the bin with the least sufficient room, or into a new one."""
    at: dict[int, list[int]] = {}
    free = 0
    for b, r in enumerate(room):
        if r > 0:
            at.setdefault(r, []).append(b)
            free |= 1 << r
    for i in order.tolist():
        n = int(length[i])
        above = free >> n
        if above:
            r = n + (above & -above).bit_length() - 1
            b = at[r].pop()
            if not at[r]:
                free ^= 1 << r
        else:
            b, r = len(room), CAPACITY
            room.append(r)
        into[i] = b
        r -= n
        room[b] = r
        if r:
            at.setdefault(r, []).append(b)
            free |= 1 << r


def score(length: np.ndarray, bins: np.ndarray) -> tuple[int, float]:
    """(bins, minus the mean squared fill): less is better."""
    fill = np.bincount(bins, length)
    fill = fill[fill > 0]
    return len(fill), -float(np.mean((fill / CAPACITY) ** 2)) if len(fill) else 0.0


def crossover(length: np.ndarray, a: np.ndarray, b: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Whole well-filled bins of b go into a; a's bins that share pieces with them are dissolved, and a few others."""
    fill = np.bincount(b, length)
    good = np.flatnonzero(fill >= max(1, np.quantile(fill[fill > 0], 0.5)))
    chosen = np.zeros(len(fill), bool)
    chosen[good[rng.random(len(good)) < rng.uniform(0.1, 0.6)]] = True
    injected = chosen[b]
    gone = np.zeros(int(a.max()) + 1, bool)
    gone[a[injected]] = True
    poor = np.bincount(a, length)
    weak = np.flatnonzero(poor < CAPACITY)
    if len(weak):
        gone[rng.choice(weak, max(1, len(weak) // 10))] = True
    displaced = gone[a] & ~injected
    child = np.where(injected, b + len(gone), a)
    child[displaced] = -1
    names, numbered = np.unique(child, return_inverse=True)
    child = numbered - (1 if len(names) and names[0] == -1 else 0)
    room = (CAPACITY - np.bincount(child[~displaced], length[~displaced])).astype(int).tolist() if (~displaced).any() else []
    out = np.flatnonzero(displaced)
    best_fit(length, out[np.argsort(-length[out], kind="stable")], room, child)
    return child


def evolve(length: np.ndarray, elites: list[np.ndarray], seed: int) -> np.ndarray:
    """The best individual of an island after an epoch. No children once the bins are as few as the sum allows."""
    rng = np.random.default_rng(seed)
    people = list(elites)
    least = -(-int(length.sum()) // CAPACITY)
    while len(people) < POPULATION:
        noise = rng.normal(0, 0 if not people else 0.15, len(length))
        into, room = np.zeros(len(length), np.int64), []
        best_fit(length, np.argsort(-length * np.exp(noise), kind="stable"), room, into)
        people.append(into)
    ranked = sorted(((score(length, p), i, p) for i, p in enumerate(people)), key=lambda x: x[:2])
    for k in range(CHILDREN):
        if ranked[0][0][0] <= least:
            break
        x, y = rng.choice(len(ranked), 2, replace=False)
        child = crossover(length, ranked[min(x, y)][2], ranked[max(x, y)][2], rng)
        ranked = sorted([*ranked, (score(length, child), POPULATION + k, child)], key=lambda x: x[:2])[:POPULATION]
    return ranked[0][2]


_ELITE = "block long, island int, bins long, fitness double, genome binary"


def _elite(block: int, island: int, length: np.ndarray, best: np.ndarray) -> pd.DataFrame:
    bins, fitness = score(length, best)
    return pd.DataFrame({"block": [block], "island": [island], "bins": [bins], "fitness": [fitness], "genome": [best.astype(np.int32).tobytes()]})


def _start(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("row")
    length = rows["length"].to_numpy()
    return _elite(key[0], key[1], length, evolve(length, [], zlib.crc32(f"{key}".encode())))


def _epoch(n: int):
    def run(key: tuple, rows: pd.DataFrame, elites: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("row")
        length = rows["length"].to_numpy()
        own = [np.frombuffer(g, np.int32).astype(np.int64) for g in elites.sort_values(["bins", "fitness"])["genome"]]
        return _elite(key[0], key[1], length, evolve(length, own[:POPULATION], zlib.crc32(f"{key} {n}".encode())))

    return run


def _place(key: tuple, rows: pd.DataFrame, best: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values("row")
    rows["bin"] = np.frombuffer(best["genome"].iloc[0], np.int32).astype(np.int64)
    rows = rows.sort_values(["bin", "row"])
    by = rows.groupby("bin")["length"]
    rows["offset"] = by.cumsum() - rows["length"]
    rows["fill"] = by.transform("sum")
    return rows[["block", "row", "length", "bin", "offset", "fill"]]


def _level(items: DataFrame, seed: int) -> DataFrame:
    """items: row, length. Adds block, bin, offset, fill."""
    n = items.count()
    blocks = max(1, -(-n // BLOCK))
    dealt = cut(items.select(F.pmod(F.xxhash64("row", F.lit(seed)), F.lit(blocks)).alias("block"), "row", "length"))
    on = dealt.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))))
    elites = cut(on.groupBy("block", "island").applyInPandas(_start, _ELITE))
    for epoch in range(1, EPOCHS):
        moved = elites.withColumn("island", ((F.col("island") + 1) % ISLANDS).cast("int"))
        elites = cut(on.groupBy("block", "island").cogroup(elites.union(moved).groupBy("block", "island")).applyInPandas(_epoch(epoch), _ELITE))
    best = elites.groupBy("block").agg(F.min_by("genome", F.struct("bins", "fitness", "island")).alias("genome"))
    return dealt.groupBy("block").cogroup(best.groupBy("block")).applyInPandas(_place, "block long, row long, length long, bin long, offset long, fill long")


def pack(made: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """`made` (row unique, length at most the capacity) with sequence_id and offset; other columns are carried along."""
    if capacity != CAPACITY:
        raise ValueError("bins hold CAPACITY tokens")
    made = cut(made)
    whole = made.where(F.col("length") == capacity).select("row", F.lit(0).alias("_level"), F.col("row").alias("_block"), F.lit(0).cast("long").alias("_bin"), F.lit(0).cast("long").alias("offset"))
    first = cut(_level(made.where(F.col("length") < capacity).select("row", "length"), 1))
    good = first.where(F.col("fill") >= WELL_FILLED * capacity)
    again = cut(_level(first.where(F.col("fill") < WELL_FILLED * capacity).select("row", "length"), 2))
    columns = lambda df, level: df.select("row", F.lit(level).alias("_level"), F.col("block").alias("_block"), F.col("bin").alias("_bin"), "offset")
    placed = whole.union(columns(good, 1)).union(columns(again, 2))
    number = F.when(F.col("_level") == 0, F.col("_block") * 4).otherwise((F.col("_block") * (1 << 20) + F.col("_bin")) * 4 + F.col("_level"))
    return made.drop("sequence_id", "offset").join(placed, "row").withColumn("sequence_id", number).drop("_level", "_block", "_bin")
