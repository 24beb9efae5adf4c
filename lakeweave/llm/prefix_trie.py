"""Prefix trie of conversations by truncation peeling.

A node is a distinct sequence of a conversation's first d turns (role, text); its members are the conversations that start with
it. Nodes come out from the deepest depth upwards: those that end at a depth join the nodes that survive from the depth below,
equal prefixes become one node with all its figures, its last turn is stripped, and the next depth regroups what is left. Each
node is found once, and its figures are final when it is found.

A prefix is known by a 128-bit chained digest of its turns. Conversations of equal content are one row from the start, with
their count, smallest id and the digest of their ids, so a conversation that a third of all rows repeat weighs as one. Texts are
never shuffled, digests of turns are.

Where prefixes are peeled follows from their weight, the turns that follow them: a prefix that over LIMIT turns follow is
heavy. Below the heavy prefixes every subtree fits into one task, which peels many of them together, depth by depth, in
memory bounded by LIMIT. Heavy prefixes are few, as only they have so many turns below, and are peeled by one small join a
depth, after the subtrees' tops were added up by parent. So rounds of jobs are as many as heavy prefixes are deep, not as
conversations are long.

The ids of equal conversations are hashed in ascending order. They are dealt by ranges and joined to chunks in parallel; the
hash, which is sequential by its definition, reads the chunks as a stream and holds one at a time.

Nulls: rows of a null conv_id belong to no conversation and are left out; null roles and texts are empty; a null turn comes
first. Turns that tie are ordered by role, then by the SHA-256 of their content, so repeated rows are repeated turns. A
conversation's digests, 16 bytes a turn, have to fit into one row; its texts, however long, need not. An empty table has no node,
not even the root. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .tables import cut, drop

#: Turns below a prefix that make it heavy; ids of a chunk; rows of heavy prefixes (24 bytes each) that are broadcast.
LIMIT, CHUNK, MANY = 200_000, 4096, 1 << 18
#: Bytes of a prefix's digest.
WIDE = 16
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
NONE = hashlib.sha256(b"").hexdigest()


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, key (of role and text), words (of the text)."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    content = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    return conversations.where("conv_id is not null").select(
        "conv_id", "turn", role.alias("role"), F.substring(F.unhex(F.sha2(content, 256)), 1, WIDE).alias("key"), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).alias("words")
    )


def sequences(conversations: DataFrame) -> DataFrame:
    """conv_id, turns: each conversation's turns in order, as (key, words)."""
    rows = turns(conversations).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "key", "words"))).alias("turns"))
    return rows.withColumn("turns", _key_words(F.col("turns")))


def _key_words(turns: Column) -> Column:
    return F.transform(turns, lambda x: F.struct(x["key"].alias("key"), x["words"].alias("words")))


def rebuilt(conversations: DataFrame, every: int = 20, most: int = 4) -> DataFrame:
    """conv_id, turns: conversation c with its first h = crc32(c) % most turns replaced by those of c - c % every.

    Conversations are dealt by the one they take from, so one shuffle brings both together: at most `every` conversations."""
    c = F.col("conv_id")
    rows = turns(conversations).withColumn("base", c - c % every).repartition("base")
    rows = rows.groupBy("base", "conv_id").agg(_key_words(F.sort_array(F.collect_list(F.struct("turn", "role", "key", "words")))).alias("turns"))
    head = F.max(F.when(c == F.col("base"), F.slice("turns", 1, most - 1))).over(W.partitionBy("base"))
    h = (F.crc32(c.cast("string").cast("binary")) % most).cast("int")
    taken = F.coalesce(F.slice(F.col("head"), F.lit(1), h), F.array().cast("array<struct<key:binary,words:int>>"))
    return rows.withColumn("head", head).select("conv_id", F.concat(taken, F.slice("turns", h + 1, F.greatest(F.size("turns"), F.lit(1)))).alias("turns"))


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """conv_id, keys, words -> conv_id, path (the digests of all its prefixes), words."""
    for batch in batches:
        out = []
        for keys in batch.column(1).to_pylist():
            h, path = hashlib.blake2b(digest_size=WIDE), []
            for k in keys:
                h.update(k)
                path.append(h.copy().digest())
            out.append(b"".join(path))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary()), batch.column(2)], ["conv_id", "path", "words"])


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, conv_id in order -> key, first, n, ids: the ids of up to CHUNK rows, comma-joined."""
    for batch in batches:
        keys, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        rows, a = [], 0
        for b in range(1, len(ids) + 1):
            if b == len(ids) or keys[b] != keys[a] or b - a == CHUNK:
                rows.append((keys[a], ids[a], b - a, ",".join(map(str, ids[a:b]))))
                a = b
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.binary(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["key", "first", "n", "ids"])


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks by key and first id -> key, conv_id (the first), n, ends_sha256. One chunk and one hash state at a time."""
    key, first, n, sha = None, 0, 0, None

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string()), strict=True)], ["conv_id", "n_ended", "ends_sha256"])

    for batch in batches:
        done = []
        for k, f, many, ids in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if sha is None or k != key:
                if sha is not None:
                    done.append((first, n, sha.hexdigest()))
                key, first, n, sha = k, f, 0, hashlib.sha256()
            else:
                sha.update(b",")
            sha.update(ids.encode())
            n += many
        if done:
            yield table(done)
    if sha is not None:
        yield table([(first, n, sha.hexdigest())])


def distinct_sequences(sequences: DataFrame) -> DataFrame:
    """conv_id (the smallest), n_ended, ends_sha256, path, words: a row for each distinct whole conversation."""
    flat = sequences.select("conv_id", F.transform("turns", lambda x: x["key"]).alias("keys"), F.transform("turns", lambda x: x["words"]).alias("words"))
    paths = cut(flat.mapInArrow(_paths, "conv_id long, path binary, words array<int>"))
    by_key = paths.select(F.expr(f"substring(path, greatest(1, length(path) - {WIDE - 1}), {WIDE})").alias("key"), "conv_id")
    chunks = by_key.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(_chunks, "key binary, first long, n long, ids string")
    ends = chunks.repartition("key").sortWithinPartitions("key", "first").mapInArrow(_ends, "conv_id long, n_ended long, ends_sha256 string")
    out = cut(ends.join(paths, "conv_id"))
    drop(paths)
    return out


class _Block:
    """Sequences of whole light subtrees, peeled together."""

    names = ["path", "words", "conv_id", "n_ended", "ends_sha256", "above", "parent_key"]

    def __init__(self, rows: pa.Table):
        col = {c: rows.column(c).combine_chunks() for c in self.names}
        self.length = np.asarray(pc.binary_length(col["path"])).astype(np.int64) // WIDE
        self.off = np.cumsum(self.length) - self.length
        self.path = np.frombuffer(b"".join(col["path"].to_pylist()), f"S{WIDE}")
        self.words = np.asarray(col["words"].flatten()).astype(np.int64)
        self.conv, self.ended, self.above = (np.asarray(col[c]).astype(np.int64) for c in ("conv_id", "n_ended", "above"))
        self.sha, self.parent = col["ends_sha256"], col["parent_key"]

    def peel(self) -> Iterator[pa.RecordBatch]:
        by_length = np.argsort(-self.length, kind="stable")
        lengths = -self.length[by_length]
        zero = np.zeros(0, np.int64)
        rep, conv, n, leaves, saved, below = zero, zero, zero, zero, zero, None
        for d in range(int(self.length.max(initial=0)), 0, -1):
            ended = by_length[np.searchsorted(lengths, -d, "left") : np.searchsorted(lengths, -d, "right")]
            alive = len(rep)
            rows = np.concatenate([rep, ended])
            _, first, at = np.unique(self.path[self.off[rows] + d - 1], return_index=True, return_inverse=True)
            many, up = len(first), at[:alive]
            members, least = np.zeros(many, np.int64), np.full(many, np.iinfo(np.int64).max)
            np.add.at(members, at, np.concatenate([n, self.ended[ended]]))
            np.minimum.at(least, at, np.concatenate([conv, self.conv[ended]]))
            children = np.bincount(up, minlength=many)
            sums = np.zeros((2, many), np.int64)
            np.add.at(sums[0], up, leaves)
            np.add.at(sums[1], up, saved)
            ends = np.full(many, -1)
            ends[at[alive:]] = ended
            if below is not None:
                yield self._rows(d + 1, *below, parent_conv=least[up])
            rep, conv, n = rows[first], least, members
            leaves = np.where(children == 0, 1, sums[0])
            saved = sums[1] + (n - 1) * self.words[self.off[rep] + d - 1]
            below = rep, conv, n, children, leaves, saved, ends
        if below is not None:
            yield self._rows(1, *below)

    def _rows(self, d, rep, conv, n, children, leaves, saved, ends, parent_conv=None) -> pa.RecordBatch:
        none = ends < 0
        sha = pc.fill_null(self.sha.take(pa.array(ends, mask=none)), NONE)
        parent = pa.nulls(len(rep), pa.int64()) if parent_conv is None else pa.array(parent_conv)
        key = self.parent.take(pa.array(rep)) if parent_conv is None else pa.nulls(len(rep), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(conv), pa.array(self.above[rep] + d), parent, pa.array(n), pa.array(children.astype(np.int64)), pa.array(leaves), pa.array(saved), sha, key], [x.split()[0] for x in NODE.split(", ")] + ["parent_key"])


def _peel(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by subtree; whole subtrees are peeled together until about `limit` turns."""
    held: list[pa.Table] = []
    size, last = 0, None
    for batch in batches:
        top = batch.column(0)
        keys = top.to_pylist()
        weight = np.asarray(pc.binary_length(batch.column(1))).astype(np.int64) // WIDE
        start = 0
        for i, k in enumerate(keys):
            if k != last and size >= limit:
                held.append(pa.Table.from_batches([batch.slice(start, i - start)]))
                yield from _Block(pa.concat_tables(held)).peel()
                held, size, start = [], 0, i
            size, last = size + int(weight[i]), k
        held.append(pa.Table.from_batches([batch.slice(start)]))
    if held:
        yield from _Block(pa.concat_tables(held)).peel()


def _few(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= MANY else df


def _heavy(whole: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """The heavy prefixes (key, depth, parent, words), and of each sequence that has any the depth of the deepest."""
    step = f"struct(d as depth, substring(path, {WIDE} * (d - 1) + 1, {WIDE}) as key, size(words) - d + 1 as weight)"
    steps = whole.where(F.size("words") > 0).select("conv_id", "path", "words", F.explode(F.expr(f"transform(sequence(1, size(words)), d -> {step})")).alias("s"))
    heavy = cut(steps.groupBy("s.key").agg(F.sum("s.weight").alias("weight")).where(F.col("weight") > limit).select("key"))
    on = steps.select("conv_id", "s.key", "s.depth", F.expr(f"substring(path, {WIDE} * (s.depth - 2) + 1, if(s.depth = 1, 0, {WIDE}))").alias("parent"), F.expr("words[s.depth - 1]").alias("words")).join(_few(heavy), "key")
    on = cut(on)
    nodes = on.groupBy("key").agg(F.min("depth").alias("depth"), F.min("parent").alias("parent"), F.min("words").cast("long").alias("words"))
    return nodes, on.groupBy("conv_id").agg(F.max("depth").alias("above"))


def trie(sequences: DataFrame, limit: int = LIMIT) -> DataFrame:
    """The nodes of conversations (conv_id, turns: key and words of each turn), conv_id unique: conv_id, depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    spark = sequences.sparkSession
    whole = distinct_sequences(sequences)
    nodes, above = _heavy(whole, limit)
    root = spark.createDataFrame([(bytearray(), 0, None, 0)], "key binary, depth int, parent binary, words long")
    nodes = cut(nodes.unionByName(root))
    dealt = whole.join(above, "conv_id", "left").fillna(0, ["above"])
    at = F.lit(WIDE) * F.col("above")
    key_at = F.expr(f"substring(path, {WIDE} * (above - 1) + 1, if(above = 0, 0, {WIDE}))")
    light = dealt.select(
        F.expr(f"substring(path, {WIDE} * above + 1, {WIDE})").alias("top"),
        F.expr(f"substring(path, {WIDE} * above + 1, length(path))").alias("path"),
        F.slice("words", F.col("above") + 1, F.greatest(F.size("words"), F.lit(1))).alias("words"),
        "conv_id", "n_ended", "ends_sha256", F.col("above").cast("long").alias("above"), key_at.alias("parent_key"),
    )
    light = light.where("length(path) > 0").repartition("top").sortWithinPartitions("top")
    found = cut(light.mapInArrow(lambda b: _peel(b, limit), NODE + ", parent_key binary"))
    tops = found.where("parent_key is not null").groupBy(F.col("parent_key").alias("key"))
    adds = tops.agg(F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n"), F.count("*").alias("children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
    ended = dealt.where(F.length("path") == at).select(key_at.alias("key"), "conv_id", F.col("n_ended").alias("n"), F.lit(0).alias("children"), F.lit(0).alias("leaves"), F.lit(0).alias("saved"), "ends_sha256")
    given = cut(adds.withColumn("ends_sha256", F.lit(None).cast("string")).unionByName(ended).join(nodes.select("key", "depth"), "key"))
    levels, lifted = [], None
    for d in range(nodes.agg(F.max("depth")).first()[0], -1, -1):
        here = given.where(F.col("depth") == d).drop("depth")
        here = here if lifted is None else here.unionByName(lifted)
        here = here.groupBy("key").agg(F.min("conv_id").alias("conv_id"), *[F.sum(c).alias(c) for c in ("n", "children", "leaves", "saved")], F.max("ends_sha256").alias("ends_sha256"))
        here = here.join(nodes.where(F.col("depth") == d), "key")
        here = here.withColumns({"leaves": F.when(F.col("children") == 0, 1).otherwise(F.col("leaves")), "saved": F.col("saved") + (F.col("n") - 1) * F.col("words")})
        here = cut(here)
        lifted = here.select(F.col("parent").alias("key"), "conv_id", "n", F.lit(1).alias("children"), "leaves", "saved", F.lit(None).cast("string").alias("ends_sha256"))
        levels.append(here)
    top = levels[0]
    for x in levels[1:]:
        top = top.unionByName(x)
    parents = _few(cut(top.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("by_key"))))
    heavy = top.select("conv_id", F.col("depth").cast("long").alias("depth"), F.lit(None).cast("long").alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("children").alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(NONE)).alias("ends_sha256"), F.col("parent").alias("parent_key"))
    out = found.unionByName(heavy).join(parents, "parent_key", "left")
    return out.withColumn("parent_conv_id", F.coalesce("parent_conv_id", "by_key")).drop("parent_key", "by_key")
