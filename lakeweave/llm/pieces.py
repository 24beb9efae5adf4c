"""SentencePiece models run by the tokenizers library.

The model's protobuf is read field by field (no generated classes): pieces with scores and types, the trainer's model type
and byte fallback, the normaliser's character map and white-space rules. From these a Tokenizer is put together: the
normaliser (character map, squeezed blanks, the blank's mark, a mark in front), a unigram model with the pieces' scores or a
BPE model whose merges are all splits of pieces in order of score, and byte fallback in the model and the decoder.

Texts are cut before blanks into chunks, which is safe where no piece holds a mark after anything but marks (checked when a
model is loaded; else whole texts are the chunks). Chunks are encoded in batches, on several threads, once a process; chunks without
further blanks go together as one text, and their ids part where a piece begins with the mark. Ids are decoded in the same
way: runs of ids that begin with a marked piece are decoded once a process.
The ids are the tokenizers library's. Parity: every new chunk is also encoded by the sentencepiece library, for comparison
alone; `differing` adds to each row how many of its chunks the two encode differently.

Null texts give null ids, empty texts empty ids, empty tables empty tables; repeated rows get equal ids, and very long texts
are encoded whole. Unknown ids in decoding are an error; null ids give null texts. Other columns stay, those named as the
results (`into`, `differing`) are replaced.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from . import words
from .encode import Pool

MARK = "▁"
#: Values of the model file's format: piece types, model types.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Chunks encoded as one text; threads of a task at least; ids decoded at once.
TOGETHER, THREADS, SLICE_IDS = 200, 2, 1 << 19


def fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protobuf message: integers, or bytes of strings, messages and fixed-width numbers."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = raw[at]
            at += 1
            out |= (b & 0x7F) << shift
            if b < 0x80:
                return out
            shift += 7

    while at < len(raw):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(kind) or (varint() if kind == 2 else 0)
        if not size and kind != 2:
            raise ValueError(f"wire type {kind}")
        yield tag >> 3, raw[at : at + size]
        at += size


@dataclass
class Model:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    unknown: int = 0
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze: bool = True

    @staticmethod
    def parse(raw: bytes) -> Model:
        m = Model()
        for number, value in fields(raw):
            if number == 1:
                piece = {1: b"", 2: b"\0\0\0\0", 3: NORMAL} | dict(fields(value))
                m.pieces.append((piece[1].decode(), struct.unpack("<f", piece[2])[0], piece[3]))
            elif number == 2:
                spec = dict(fields(value))
                m.kind, m.byte_fallback, m.unknown = spec.get(3, UNIGRAM), bool(spec.get(35, 0)), spec.get(40, 0)
            elif number == 3:
                spec = dict(fields(value))
                m.charsmap, m.dummy_prefix, m.squeeze = spec.get(2, b""), bool(spec.get(3, 1)), bool(spec.get(4, 1))
        return m

    def tokenizer(self):
        from tokenizers import Regex, Tokenizer, decoders, models, normalizers

        vocab = {p: i for i, (p, _, _) in enumerate(self.pieces)}
        if self.kind == UNIGRAM:
            model = models.Unigram([(p, s) for p, s, _ in self.pieces], self.unknown, self.byte_fallback)
        elif self.kind == BPE:
            merges = []
            for i, (p, score, kind) in enumerate(self.pieces):
                if kind in (NORMAL, USER):
                    merges += [(-score, i, len(p[:k]), (p[:k], p[k:])) for k in range(1, len(p)) if p[:k] in vocab and p[k:] in vocab]
            merges.sort(key=lambda x: x[:3])
            model = models.BPE(vocab, [m[3] for m in merges], unk_token=self.pieces[self.unknown][0], fuse_unk=True, byte_fallback=self.byte_fallback)
        else:
            raise ValueError(f"model type {self.kind}")
        t = Tokenizer(model)
        steps = [normalizers.Precompiled(self.charsmap)] if self.charsmap else []
        if self.squeeze:
            steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
        steps += [normalizers.Prepend(MARK)] if self.dummy_prefix else []
        t.normalizer = normalizers.Sequence([*steps, normalizers.Replace(" ", MARK)])
        t.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *([decoders.Strip(" ", 1, 0)] if self.dummy_prefix else [])])
        return t

    @property
    def cuts(self) -> bool:
        """Whether chunks may be cut before blanks."""
        return self.dummy_prefix and not self.squeeze and not self.charsmap and not any(MARK in p.lstrip(MARK) for p, _, k in self.pieces if k in (NORMAL, USER))


    @property
    def begins(self) -> np.ndarray:
        """Of each id, whether its piece begins with the mark."""
        return np.array([k in (NORMAL, USER) and p.startswith(MARK) for p, _, k in self.pieces])


def in_order(flat: np.ndarray, of: np.ndarray, size: np.ndarray) -> np.ndarray:
    """`flat` holds the values of parts of[0], of[1] and so on, size[part] of each; the same in order of the parts."""
    start = np.zeros(len(size), np.int64)
    start[of] = np.cumsum(size[of]) - size[of]
    return flat[words.gather(start, size)]


class PieceEncoder(Pool):
    def __init__(self, raw: bytes, threads: int = 1):
        os.environ["RAYON_NUM_THREADS"], os.environ["TOKENIZERS_PARALLELISM"] = str(threads), "true" if threads > 1 else "false"
        import sentencepiece

        super().__init__(600_000)
        self.model = Model.parse(raw)
        self.tokenizer = self.model.tokenizer()
        self.begins, self.cuts = self.model.begins, self.model.cuts
        self.check = sentencepiece.SentencePieceProcessor(model_proto=raw)
        self.threads, self.checked, self.differed = threads, 0, 0
        self.wrong = np.zeros(0, np.uint64)  # hashes of chunks on which the libraries differ

    def _both(self, texts: list[str]) -> tuple[list[np.ndarray], list[bool]]:
        """The tokenizers library's ids of each text, and whether the sentencepiece library has the same."""
        ours = [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        theirs = self.check.encode(texts, num_threads=self.threads)
        self.checked += len(texts)
        return [np.array(x, np.int32) for x in ours], [x == y for x, y in zip(ours, theirs, strict=True)]

    def _some(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Parts without blanks go together as one text if chunks may be cut before blanks; should the libraries differ on
        it, or its ids not part as its chunks do, each of its chunks is encoded on its own."""
        plain = [i for i, p in enumerate(parts) if self.cuts and p and " " not in p and MARK not in p]
        groups = [plain[a : a + TOGETHER] for a in range(0, len(plain), TOGETHER)]
        ids, same = self._both([" ".join(parts[i] for i in g) for g in groups])
        at = [np.flatnonzero(self.begins[x]) for x in ids]
        good = [ok and len(c) == len(g) and c[0] == 0 for ok, c, g in zip(same, at, groups, strict=True)]
        self.checked += sum(len(g) - 1 for g, ok in zip(groups, good, strict=True) if ok)
        of = np.array([i for g, ok in zip(groups, good, strict=True) if ok for i in g], np.int64)
        size = np.zeros(len(parts), np.int64)
        size[of] = np.concatenate([np.zeros(0, np.int64), *[np.diff(np.append(c, len(x))) for x, c, ok in zip(ids, at, good, strict=True) if ok]])
        flat = [x for x, ok in zip(ids, good, strict=True) if ok]
        rest = np.setdiff1d(np.arange(len(parts)), of)
        single, same = self._both([parts[i] for i in rest.tolist()])
        size[rest] = [len(x) for x in single]
        wrong = [parts[i] for i, ok in zip(rest.tolist(), same, strict=True) if not ok]
        self.differed += len(wrong)
        for _, data, ends in words.slices(pa.array(wrong, pa.string())):
            self.wrong = np.union1d(self.wrong, words.Hasher(data)(ends[:-1], ends[1:]))
        return in_order(np.concatenate([np.zeros(0, np.int32), *flat, *single]), np.concatenate([of, rest]), size), size

    def _made(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        found = [self._some([p.decode() for p in parts[a : a + 20_000]]) for a in range(0, len(parts), 20_000)]
        return np.concatenate([np.zeros(0, np.int32), *[x for x, _ in found]]), np.concatenate([np.zeros(0, np.int64), *[n for _, n in found]])

    def __call__(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all rows of a slice, one after the other, the rows' offsets in them, and their differing chunks."""
        row_start = np.zeros(len(data) + 1, bool)
        row_start[at[:-1][np.diff(at) > 0]] = True
        if self.cuts:
            blank = data == 0x20
            blank[at[1:][np.diff(at) > 0] - 1] = False  # a blank that ends its row has nothing to mark
            start = row_start[:-1] | blank
            start[1:] &= row_start[1:-1] | ~blank[:-1]
        else:
            start = row_start[:-1]
        s = np.flatnonzero(start)
        e = np.append(s[1:], len(data))
        a = s + (~row_start[s] if len(s) else 0)
        ids, n = self.values_of(data, a, e)
        first = np.searchsorted(s, at)
        wrong = np.isin(words.Hasher(data)(a, e), self.wrong) if len(self.wrong) else np.zeros(len(s), bool)
        return ids, np.concatenate([[0], np.cumsum(n)])[first], np.diff(np.concatenate([[0], np.cumsum(wrong)])[first])


class PieceDecoder(Pool):
    """Texts of ids. Byte pieces never run over a marked piece, so texts are put together from runs that begin with one."""

    def __init__(self, raw: bytes):
        from tokenizers import decoders

        super().__init__(600_000, np.uint8)
        self.model = Model.parse(raw)
        self.begins, self.tokenizer = self.model.begins, self.model.tokenizer()
        #: Bytes of each piece's text; 0 of byte pieces, whose texts depend on their neighbours.
        self.text_size = np.array([0 if k == BYTE else len(p.replace(MARK, " ").encode()) for p, _, k in self.model.pieces])
        self.tokenizer.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()])

    def _decoded(self, lists: list[np.ndarray]) -> list[bytes]:
        return [t.encode() for t in self.tokenizer.decode_batch([x.tolist() for x in lists], skip_special_tokens=False)]

    def _made(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Runs that begin with a marked piece and hold no byte pieces go together: their lengths are those of their pieces."""
        ids = np.frombuffer(b"".join(parts), np.int32)
        ends = np.concatenate([[0], np.cumsum([len(p) // 4 for p in parts])])
        size = np.add.reduceat(np.append(self.text_size[ids], 0), ends[:-1])
        plain = self.begins[ids[ends[:-1]]] & (np.maximum.reduceat(np.append(self.text_size[ids] == 0, False), ends[:-1]) == 0)
        of, rest = np.flatnonzero(plain), np.flatnonzero(~plain)
        groups = [of[a : a + TOGETHER] for a in range(0, len(of), TOGETHER)]
        together = self._decoded([ids[words.gather(ends[g], ends[g + 1] - ends[g])] for g in groups])
        if any(len(t) != size[g].sum() for t, g in zip(together, groups, strict=True)):
            raise ValueError("a piece of another length than its text")
        single = self._decoded([ids[ends[i] : ends[i + 1]] for i in rest.tolist()])
        size[rest] = [len(t) for t in single]
        return in_order(np.frombuffer(b"".join([*together, *single]), np.uint8), np.concatenate([of, rest]), size), size

    def __call__(self, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all rows, one after the other, and the rows' offsets in them."""
        if len(ids) and not 0 <= ids.min() <= ids.max() < len(self.begins):
            raise ValueError("an id without a piece")
        start = self.begins[ids]
        start[at[:-1][np.diff(at) > 0]] = True
        s = np.flatnonzero(start)
        e = np.append(s[1:], len(ids))
        out, n = self.values_of(ids.astype(np.int32).view(np.uint8), 4 * s, 4 * e)
        ends = np.concatenate([[0], np.cumsum(n)])[np.searchsorted(s, at)]
        if self.model.dummy_prefix:
            some = ends[:-1][np.diff(ends) > 0]
            keep = np.ones(len(out), bool)
            keep[some[out[some] == 0x20]] = False
            out, ends = out[keep], np.concatenate([[0], np.cumsum(keep)])[ends]
        return out, ends


_held: dict[tuple, PieceEncoder | PieceDecoder] = {}


def _held_for(kind: type, raw: bytes, *more) -> PieceEncoder | PieceDecoder:
    key = (kind, hash(raw), *more)
    if key not in _held:
        _held[key] = kind(raw, *more)
    return _held[key]


def _schema(df: DataFrame, more: str) -> str:
    return ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields], more])


def encode(docs: DataFrame, model: bytes, text: str = "text", into: str = "ids", threads: int | None = None, differing: str | None = None) -> DataFrame:
    """`docs` with a column of ids. model: the model file's bytes. threads: of each task; spark.task.cpus, but THREADS at least, by default.
    differing: a column with each row's number of chunks that the sentencepiece library encodes differently."""
    docs = docs.drop(into, *([differing] if differing else []))
    threads = threads or max(THREADS, int(docs.sparkSession.sparkContext.getConf().get("spark.task.cpus", "1")))
    sent = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = _held_for(PieceEncoder, sent.value, threads)
        for batch in batches:
            for i, data, at in words.slices(batch.column(place)):
                n = len(at) - 1
                ids, off, wrong = use(data, at)
                null = batch.column(place).slice(i, n).is_null()
                made = pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(ids), mask=null) if null.true_count else pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(ids))
                more, names = ([pa.array(wrong)], [differing]) if differing else ([], [])
                yield pa.record_batch([*[c.slice(i, n) for c in batch.columns], made, *more], [*batch.schema.names, into, *names])

    return docs.mapInArrow(run, _schema(docs, f"`{into}` array<int>" + (f", `{differing}` long" if differing else "")))


def decode(df: DataFrame, model: bytes, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """`df` with the texts of a column of ids."""
    df = df.drop(into)
    sent = df.sparkSession.sparkContext.broadcast(model)
    place = df.columns.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = _held_for(PieceDecoder, sent.value)
        for batch in batches:
            size = pc.list_value_length(batch.column(place)).fill_null(0).to_numpy(zero_copy_only=False)
            ends = np.cumsum(size)
            i = 0
            while i < batch.num_rows:
                n = max(1, int(np.searchsorted(ends, ends[i] - size[i] + SLICE_IDS, "right")) - i)
                part = batch.slice(i, n)
                lists = part.column(place)
                ids = lists.flatten()
                if ids.null_count:
                    raise ValueError("a null among the ids")
                data, at = use(ids.to_numpy(), np.concatenate([[0], np.cumsum(size[i : i + n])]))
                null = lists.is_valid() if lists.null_count else None
                text = pa.LargeStringArray.from_buffers(n, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(data), null.buffers()[1] if null is not None else None)
                yield pa.record_batch([*part.columns, text.cast(pa.string())], [*part.schema.names, into])
                i += n

    return df.mapInArrow(run, _schema(df, f"`{into}` string"))


def parity(docs: DataFrame, model: bytes, text: str = "text") -> DataFrame:
    """One row a partition: chunks encoded by both libraries, and those on which they differed."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = PieceEncoder(sent.value)
        for batch in batches:
            for _, data, at in words.slices(batch.column(0)):
                use(data, at)
        yield pa.record_batch([pa.array([use.checked]), pa.array([use.differed])], ["checked", "differed"])

    return docs.select(text).mapInArrow(run, "checked long, differed long")
