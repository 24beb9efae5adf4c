"""Line deduplication over a corpus by a deletion-neighbourhood join, for an edit bound of one character.

A line (between newlines) goes if an earlier line of the corpus, by (id, line number), is equal to it or one insertion,
deletion or substitution of a character away. Lines of every length but empty ones are compared; a caller may set a least length
for equal lines, `equal_chars`, and for lines one edit apart, `min_chars`. Lines are compared with all earlier ones, kept or not. A document all of whose text goes is left out with `drop_emptied`; else it stays, empty.

Equal lines are one class from the start. Two lines one edit apart share their first or their last half, so only classes
that share a hashed half with another one give their neighbourhood: the line itself and its variants with one character
deleted (in the half that may differ), as hashed keys. Lines that lack the same character position (substitution), and a
line that equals another's variant (deletion), meet on equal keys. In a group of equal keys and positions all lines are one
edit apart, so each is paired with the earliest alone: pairs grow with the rows, not with their square. Each pair's edit
distance is then verified on the texts.

Null texts stay null, empty ones empty. Rows with a null id are neither compared nor changed. Repeated rows of an id and text
count once and change alike. Other columns stay as they are. Very long lines are handled whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words
from .tables import cut, drop

MIN_CHARS = 1
#: Tables of documents with at most so many rows and listed lines are broadcast.
MANY_ROWS, MANY_LINES = 1 << 18, 1 << 20
_U = np.uint64
_NEWLINE = np.zeros(256, bool)
_NEWLINE[10] = True
_PREFIX, _SUFFIX = _U(0xA24BAED4963EE407), _U(0x9FB21C651E98DF25)


def _lines(data: np.ndarray, at: np.ndarray, min_chars: int):
    """row, line number, start, end, first character's index, characters of the lines that count; byte of each character."""
    s, e, first = words.runs(data, at, _NEWLINE)
    row = np.repeat(np.arange(len(at) - 1), np.diff(first))
    breaks = np.concatenate([[0], np.cumsum(_NEWLINE[data])])
    head = (data & 0xC0) != 0x80
    chars = np.concatenate([[0], np.cumsum(head)])
    n = chars[e] - chars[s]
    keep = n >= min_chars
    s, e, row, n = s[keep], e[keep], row[keep], n[keep]
    return row, breaks[s] - breaks[at[row]], s, e, chars[s], n, np.append(np.flatnonzero(head), len(data))


def _line_batches(min_chars: int, equal_chars: int):
    """From id, of, text: a row for each line, with its hash and the four hashed halves it may share (none below min_chars)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, data, at in words.slices(batch.column(2)):
                row, number, s, e, c, n, byte = _lines(data, at, min(min_chars, equal_chars))
                if not len(s):
                    continue
                h = words.Hasher(data)
                keys = np.empty((len(s), 4), np.uint64)
                for j, role in enumerate((n, n - 1)):
                    half = role // 2
                    tag = role.astype(np.uint64) * _U(0xD6E8FEB86659FD93)
                    keys[:, 2 * j] = words.mix(h.raw(s, byte[c + half]) + tag) ^ _PREFIX
                    keys[:, 2 * j + 1] = words.mix(h.raw(byte[c + n - (role - half)], e) + tag) ^ _SUFFIX
                pick = pa.array(row + i)
                long = n >= min_chars
                ends = np.concatenate([[0], np.cumsum(4 * long)]).astype(np.int32)
                yield pa.record_batch(
                    [batch.column(0).take(pick), batch.column(1).take(pick), pa.array(number.astype(np.int32)), pa.array(h(s, e).astype(np.int64)), pa.ListArray.from_arrays(ends, keys[long].astype(np.int64).reshape(-1))],
                    ["id", "of", "line", "h", "halves"],
                )

    return run


def _text_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From text and found (array of line, h, sides): h, sides, text of each listed line."""
    for batch in batches:
        h, sides, text = [], [], []
        for t, found in zip(batch.column(0), batch.column(1), strict=True):
            lines = t.as_py().split("\n")
            for x in found.as_py():
                h.append(x["h"])
                sides.append(x["sides"])
                text.append(lines[x["line"]])
        yield pa.record_batch([pa.array(h, pa.int64()), pa.array(sides, pa.int32()), pa.array(text, pa.string())], ["h", "sides", "text"])


def _variant_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From h, sides, text: a row for each variant: its hash, the deleted character's place (-1: none), h. Lines of more than
    a slice give their variants in parts."""
    for batch in batches:
        of, sides = np.asarray(batch.column(0)), np.asarray(batch.column(1))
        for i, data, at in words.slices(batch.column(2), 1 << 18):
            head = np.flatnonzero((data & 0xC0) != 0x80)
            byte = np.append(head, len(data))
            c = np.searchsorted(head, at)
            n = np.diff(c)
            h = words.Hasher(data)
            k = sides[i : i + len(n)]
            lo = np.where(k & 2, 0, (n - 1) // 2)
            hi = np.where(k & 1, n, n // 2 + 1)
            many = np.minimum(hi, n) - lo
            line = np.repeat(np.arange(len(n)), many)
            place = words.gather(lo, many)
            p = byte[c[line] + place]
            q = byte[c[line] + place + 1]
            s, e = at[line], at[line + 1]
            raw = h.raw(s, p) + words.power(p - s) * h.raw(q, e)
            size = (e - s - (q - p)).astype(np.uint64)
            key = words.mix(raw + size * _U(0xD6E8FEB86659FD93))
            own = h(at[:-1], at[1:])
            key, place, line = np.concatenate([key, own]), np.concatenate([place, np.full(len(n), -1)]), np.concatenate([line, np.arange(len(n))])
            for a in range(0, len(key), 1 << 17):
                b = slice(a, a + (1 << 17))
                yield pa.record_batch([pa.array(key[b].astype(np.int64)), pa.array(place[b].astype(np.int32)), pa.array(of[i + line[b]])], ["key", "place", "h"])


def within_one(a: str, b: str) -> bool:
    """Whether the edit distance is at most one."""
    if abs(len(a) - len(b)) > 1:
        return False
    i, n = 0, min(len(a), len(b))
    while i < n and a[i] == b[i]:
        i += 1
    return a[i:] == b[i:] or a[i + 1 :] == b[i + 1 :] or a[i + 1 :] == b[i:] or a[i:] == b[i + 1 :]


def _verify_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        good = [within_one(a, b) for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
        yield pa.record_batch([*batch.columns[:2], pa.array(good, pa.bool_())], ["a", "b", "near"])


def _sent(listed: DataFrame, lines: str) -> DataFrame:
    """`listed`, to be broadcast if it is small; its rows and the lengths of its arrays are counted first."""
    rows, many = listed.agg(F.count("*"), F.sum(F.size(lines))).first()
    return F.broadcast(listed) if rows <= MANY_ROWS and (many or 0) <= MANY_LINES else listed


def near_lines(docs: DataFrame, lines: DataFrame, text: str) -> tuple[DataFrame, DataFrame]:
    """Line classes (h, at: the earliest place, halves), and h of those one edit away from an earlier class.
    docs: id, of, text; lines: id, of, line, h, halves."""
    classes = lines.groupBy("h").agg(F.min(F.struct("id", "of", "line")).alias("at"), F.first("halves").alias("halves"))
    classes = cut(classes)
    halves = classes.select("h", F.posexplode("halves").alias("side", "half"))
    shared = halves.groupBy("half").agg(F.count("*").alias("c")).where("c > 1").select("half")
    some = halves.join(shared, "half").groupBy("h").agg(F.bit_or(F.expr("1 + side % 2")).cast("int").alias("sides"))
    some = cut(some.join(classes.select("h", "at"), "h"))
    by_doc = cut(some.groupBy("at.id", "at.of").agg(F.collect_list(F.struct("at.line", "h", "sides")).alias("found")))
    source = docs.join(_sent(by_doc, "found"), ["id", "of"])
    texts = cut(source.select(F.col(text).alias("text"), "found").mapInArrow(_text_batches, "h long, sides int, text string").dropDuplicates(["h"]))
    variants = texts.mapInArrow(_variant_batches, "key long, place int, h long").join(some.select("h", "at"), "h")
    variants = cut(variants)
    equal = variants.where("place >= 0").groupBy("key", "place").agg(F.count("*").alias("c"), F.min(F.struct("at", "h")).alias("m")).where("c > 1").select("key", "place", F.col("m.h").alias("other"))
    swapped = variants.join(equal, ["key", "place"]).where("h != other").select("h", "other")
    own = variants.where("place < 0").select("key", F.col("h").alias("other"))
    longer = variants.where("place >= 0").join(own, "key").where("h != other").select("h", "other")
    pairs = swapped.union(longer).select(F.least("h", "other").alias("a"), F.greatest("h", "other").alias("b")).distinct()
    t = lambda c: texts.select(F.col("h").alias(c), F.col("text").alias(f"text_{c}"))
    checked = pairs.join(t("a"), "a").join(t("b"), "b").select("a", "b", "text_a", "text_b").mapInArrow(_verify_batches, "a long, b long, near boolean").where("near")
    place = lambda c: some.select(F.col("h").alias(c), F.col("at").alias(f"at_{c}"))
    later = checked.join(place("a"), "a").join(place("b"), "b").select(F.when(F.col("at_a") < F.col("at_b"), F.col("b")).otherwise(F.col("a")).alias("h"))
    out = cut(later.distinct())
    drop(by_doc, texts, variants)
    return classes, out


def dedup_lines(docs: DataFrame, id: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, drop_emptied: bool = False, counts: bool = False, equal_chars: int | None = None) -> DataFrame:
    """`docs` without repeated lines. min_chars: least length of lines one edit apart; equal_chars: of equal lines, min_chars
    by default, 1 for all but empty ones. counts: add n_lines, n_equal and n_near, the lines there and those that went."""
    equal_chars = min_chars if equal_chars is None else min(equal_chars, min_chars)
    source = docs.select(F.col(id).cast("long").alias("id"), F.xxhash64(text).alias("of"), F.col(text).alias("text")).where("id is not null and text is not null")
    lines = cut(source.mapInArrow(_line_batches(min_chars, equal_chars), "id long, of long, line int, h long, halves array<long>"))
    classes, near = near_lines(source, lines, "text")
    marked = classes.select("h", "at").join(near.withColumn("near", F.lit(True)), "h", "left")
    repeated = lines.groupBy("h").agg(F.count("*").alias("c")).where("c > 1").select("h")
    marked = marked.join(repeated.withColumn("again", F.lit(True)), "h", "left").where("near or again").select("h", "at", F.coalesce("near", F.lit(False)).alias("near"))
    gone = lines.select("id", "of", "line", "h").join(marked, "h").where(F.col("near") | (F.struct("id", "of", "line") != F.col("at")))
    by_doc = cut(gone.groupBy("id", "of").agg(F.collect_set("line").alias("_lw_gone"), F.count_if("near").cast("int").alias("_lw_near")).withColumnsRenamed({"id": "_lw_id", "of": "_lw_of"}))
    d = docs.withColumn("_lw_text_of", F.xxhash64(text))
    d = d.join(_sent(by_doc, "_lw_gone"), (F.col(id) == F.col("_lw_id")) & (F.col("_lw_text_of") == F.col("_lw_of")), "left")
    all_lines = F.split(F.col(text), "\n", -1)
    kept = F.get(F.transform(F.array(all_lines), lambda a: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(a) - 1), F.col("_lw_gone")), lambda i: F.get(a, i)), "\n")), F.lit(0))
    d = d.withColumn("_lw_kept", F.when(F.col("_lw_gone").isNull(), F.col(text)).otherwise(kept))
    if counts:
        n, near_n = F.coalesce(F.size("_lw_gone"), F.lit(0)), F.coalesce("_lw_near", F.lit(0))
        d = d.withColumns({"n_lines": F.coalesce(F.size(all_lines), F.lit(0)), "n_equal": n - near_n, "n_near": near_n})
    if drop_emptied:
        d = d.where(F.col("_lw_gone").isNull() | F.col("_lw_kept").rlike(r"\S"))
    return d.withColumn(text, F.col("_lw_kept")).drop("_lw_text_of", "_lw_id", "_lw_of", "_lw_gone", "_lw_near", "_lw_kept")
