"""Language identification by unigram models over a fixed public vocabulary, summed over all segmentations.

A word is a run of letters, A-Z lower-cased, with the vocabulary's word mark before it. Under a language it has the
probability of all its segmentations into pieces of the vocabulary (single bytes are pieces too, so there always is one):
a forward algorithm over its bytes adds them up. The piece probabilities of each language are learned by expectation
maximisation, with forward and backward sums. A word's log-likelihoods are worked out once a process, for all languages;
words are never cut for that, however long: only the sums of the last bytes are held, scaled as they go.

A text's language is the one with the largest sum over its words (ties: the least name); its score is that language's
posterior with equal priors. Texts that are null or have no letter are `und` with score 0. Whole texts are read; repeated
rows are predicted alike.

Training rows are a bounded sample: for each language the `per_language` rows with the least hash of their id, with whole
texts; of words over LONG_WORD bytes, which have to be held whole for the backward sums, all parts of about that length
count, cut between characters. Without any language everything is `und`. Extra columns stay; lang_pred and score are replaced.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import words
from .tables import cut, drop, least_hashes
from .toxicity import GAP

#: Rows of each language to learn from, at most; rounds of expectation maximisation.
PER_LANGUAGE, ROUNDS = 600, 3
#: In training, longer words count in parts of so many bytes. Bytes of words summed at once in prediction.
LONG_WORD, AT_ONCE = 64, 1 << 17
SMOOTH = 0.1
MARK = "▁".encode()


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def vocabulary(path: str) -> list[bytes]:
    """Pieces of letters, with or without the mark, lower-cased as words are, and all single bytes."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = {bytes([b]) for b in range(256)} | {MARK}
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i).encode()
        bare = piece.removeprefix(MARK)
        if bare and MARK not in bare and not any(GAP[b] for b in words.LOWER[np.frombuffer(bare, np.uint8)]):
            found.add(words.LOWER[np.frombuffer(piece, np.uint8)].tobytes())
    return sorted(found)


def _hashed(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    size = np.array([len(p) for p in pieces], np.int64)
    end = np.cumsum(size)
    h = words.Hasher(np.frombuffer(b"".join(pieces), np.uint8))(end - size, end)
    order = np.argsort(h)
    return h[order], order


class Lattice:
    """The pieces that end at each byte of a batch of words; longest: bytes of the longest piece."""

    def __init__(self, texts: list[bytes], keys: np.ndarray, order: np.ndarray, longest: int):
        texts = [MARK + t for t in texts]
        self.n, self.size = len(texts), np.array([len(t) for t in texts], np.int64)
        self.keys, self.order, self.longest = keys, order, longest
        self.hash = words.Hasher(np.frombuffer(b"".join(texts), np.uint8))
        self.start = np.cumsum(self.size) - self.size

    def step(self, j: int, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words, begin positions and pieces of all pieces that end at position j of the words w."""
        ws, bs, ps = [], [], []
        for length in range(1, min(j, self.longest) + 1):
            x = self.hash(self.start[w] + j - length, self.start[w] + j)
            at = np.minimum(np.searchsorted(self.keys, x), len(self.keys) - 1)
            ok = self.keys[at] == x
            ws.append(w[ok])
            ps.append(self.order[at[ok]])
            bs.append(np.full(int(ok.sum()), j - length))
        return np.concatenate(ws), np.concatenate(bs), np.concatenate(ps)

    def steps(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        for j in range(1, int(self.size.max(initial=0)) + 1):
            yield j, *self.step(j, np.flatnonzero(self.size >= j))

    def log_likelihood(self, p: np.ndarray) -> np.ndarray:
        """Logarithms of the sums over all segmentations (words x languages). A ring holds the sums of the last positions."""
        ring = self.longest + 1
        alpha, scale = np.zeros((self.n, ring, p.shape[1])), np.zeros((self.n, p.shape[1]))
        alpha[:, 0] = 1.0
        out = np.zeros((self.n, p.shape[1]))
        for j, w, b, piece in self.steps():
            add = alpha[w, b % ring] * p[piece]
            for k in range(p.shape[1]):
                alpha[:, j % ring, k] = np.bincount(w, add[:, k], self.n)
            done = np.flatnonzero(self.size == j)
            out[done] = np.log(np.maximum(alpha[done, j % ring], 1e-300)) + scale[done]
            if j % 16 == 0:
                open_ = np.flatnonzero(self.size > j)
                top = np.maximum(alpha[open_].max(axis=1), 1e-300)
                alpha[open_] /= top[:, None]
                scale[open_] += np.log(top)
        return out

    def expected(self, p: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Expected numbers of pieces (pieces x languages), for words with `count` (words x languages)."""
        found = list(self.steps())
        alpha = np.zeros((self.n, len(found) + 1, p.shape[1]))
        alpha[:, 0] = 1.0
        for j, w, b, piece in found:
            add = alpha[w, b] * p[piece]
            for k in range(p.shape[1]):
                alpha[:, j, k] = np.bincount(w, add[:, k], self.n)
        beta = np.zeros_like(alpha)
        beta[np.arange(self.n), self.size] = 1.0
        total = np.maximum(alpha[np.arange(self.n), self.size], 1e-300)
        out = np.zeros_like(p)
        for j, w, b, piece in reversed(found):
            add = beta[w, j] * p[piece]
            np.add.at(beta, (w, b), add)
            seen = alpha[w, b] * add / total[w] * count[w]
            for k in range(p.shape[1]):
                out[:, k] += np.bincount(piece, seen[:, k], len(p))
        return out


def parts(word: bytes, size: int = LONG_WORD) -> list[bytes]:
    """The word in parts of at most `size` bytes (and a character), cut between characters."""
    out, a = [], 0
    while a < len(word):
        b = min(a + size, len(word))
        while b < len(word) and word[b] & 0xC0 == 0x80:
            b += 1
        out.append(word[a:b])
        a = b
    return out


@dataclass
class Model:
    languages: list[str]
    keys: np.ndarray
    order: np.ndarray
    p: np.ndarray

    longest: int

    def words(self, texts: list[bytes]) -> np.ndarray:
        out = np.zeros((len(texts), len(self.languages)))
        size = np.array([len(t) for t in texts], np.int64)
        todo = np.argsort(size, kind="stable")
        ends = np.cumsum(size[todo] + len(MARK))
        a = 0
        while a < len(todo):
            b = max(a + 1, int(np.searchsorted(ends, ends[a] + AT_ONCE)))
            some = todo[a:b]
            out[some] = Lattice([texts[i] for i in some.tolist()], self.keys, self.order, self.longest).log_likelihood(self.p)
            a = b
        return out.astype(np.float32)

    def sums(self, memo: words.Memo, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Log-likelihoods of a slice's rows (rows x languages)."""
        data = words.LOWER[data]
        s, e, first = words.runs(data, at, GAP)
        if not len(s):
            return np.zeros((len(at) - 1, len(self.languages)))
        x = memo(data, s, e, words.Hasher(data)(s, e))
        c = np.vstack([np.zeros((1, x.shape[1])), np.cumsum(x, axis=0, dtype=float)])
        return c[first[1:]] - c[first[:-1]]


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From lang, text: lang, word, n for each run of rows of one language."""
    for batch in batches:
        lang = np.asarray(batch.column(0).to_pylist(), object)
        for i, data, at in words.slices(batch.column(1)):
            data = words.LOWER[data]
            s, e, first = words.runs(data, at, GAP)
            h = words.Hasher(data)(s, e) if len(s) else np.zeros(0, np.uint64)
            of = np.repeat(lang[i : i + len(at) - 1], np.diff(first))
            for name in dict.fromkeys(of.tolist()):
                mine = np.flatnonzero(of == name)
                _, one, n = np.unique(h[mine], return_index=True, return_counts=True)
                yield pa.record_batch([pa.array([name] * len(one), pa.string()), pa.array(words.spans(data, s[mine[one]], e[mine[one]]), pa.binary()), pa.array(n)], ["lang", "word", "n"])


def learn(docs: DataFrame, path: str, id: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE) -> Model | None:
    """Fit on a bounded sample of the rows of `docs` with a language. Expected piece counts come from Spark's tasks; what
    reaches the driver is a table of vocabulary x languages."""
    known = docs.select(F.col(id).alias("doc"), F.col(text).alias("text"), F.col(lang).alias("lang")).dropna()
    hashed = F.xxhash64("_id", F.lit(5))
    named = known.select(F.col("lang").alias("_lang"), F.col("doc").alias("_id"))
    most = named.groupBy("_lang").agg(least_hashes(per_language, F.count("*")).alias("_most"))
    rank = F.row_number().over(W.partitionBy("_lang").orderBy(hashed, "_id"))
    ids = named.join(F.broadcast(most), "_lang").where(hashed <= F.col("_most")).withColumn("r", rank).where(F.col("r") <= per_language)
    picked = known.join(F.broadcast(ids.select("_id", "_lang")), (F.col("doc") == F.col("_id")) & (F.col("lang") == F.col("_lang"))).select("lang", "text")
    counted = cut(picked.mapInArrow(_counts, "lang string, word binary, n long").groupBy("word", "lang").agg(F.sum("n").alias("n")))
    languages = sorted(r[0] for r in counted.select("lang").distinct().collect())
    if not languages:
        drop(counted)
        return None
    vocab = vocabulary(path)
    keys, order = _hashed(vocab)
    longest = max(map(len, vocab))
    wide = cut(counted.groupBy("word").agg(F.collect_list(F.struct("lang", "n")).alias("by")))
    drop(counted)
    p = np.full((len(keys), len(languages)), 1 / len(keys))
    for _ in range(ROUNDS):
        sent = wide.sparkSession.sparkContext.broadcast(Model(languages, keys, order, p, longest))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            m = sent.value
            number = {x: k for k, x in enumerate(m.languages)}
            total = np.zeros_like(m.p)
            for batch in batches:
                cut_up = [parts(t) for t in batch.column(0).to_pylist()]
                texts = [x for t in cut_up for x in t]
                count = np.zeros((len(cut_up), len(number)))
                for i, by in enumerate(batch.column(1).to_pylist()):
                    for x in by:
                        count[i, number[x["lang"]]] = x["n"]
                count = np.repeat(count, [len(t) for t in cut_up], axis=0)
                todo = np.argsort([len(t) for t in texts], kind="stable")
                for a in range(0, len(todo), 4000):
                    w = todo[a : a + 4000]
                    total += Lattice([texts[i] for i in w], m.keys, m.order, m.longest).expected(m.p, count[w])
            piece, k = np.nonzero(total)
            yield pa.record_batch([pa.array(piece), pa.array(k), pa.array(total[piece, k])], ["piece", "k", "n"])

        found = wide.mapInArrow(run, "piece long, k long, n double").groupBy("piece", "k").agg(F.sum("n").alias("n")).toArrow()
        n = np.full_like(p, SMOOTH)
        n[found.column("piece").to_numpy(), found.column("k").to_numpy()] += found.column("n").to_numpy()
        p = n / n.sum(axis=0)
        sent.destroy()
    drop(wide)
    return Model(languages, keys, order, p, longest)


_loaded: dict[str, tuple[Model, words.Memo]] = {}


def predict(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """`docs` with lang_pred and score (0 to 1)."""
    docs = docs.drop("lang_pred", "score")
    if model is None:
        return docs.withColumns({"lang_pred": F.lit("und"), "score": F.lit(0.0)})
    name = uuid.uuid4().hex
    sent = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _loaded:
            _loaded.clear()
            _loaded[name] = sent.value, words.Memo(sent.value.words)
        m, memo = _loaded[name]
        for batch in batches:
            for i, data, at in words.slices(batch.column(place)):
                n = len(at) - 1
                x = m.sums(memo, data, at)
                best = x.argmax(axis=1)
                score = 1 / np.exp(np.maximum(x - x.max(axis=1, keepdims=True), -700)).sum(axis=1)
                ascii_letters = np.concatenate([[0], np.cumsum(~GAP[words.LOWER[data]] & (data < 128))])
                some = ascii_letters[at[1:]] > ascii_letters[at[:-1]]
                for r in np.flatnonzero(~some).tolist():
                    some[r] = any(c.isalpha() for c in data[at[r] : at[r + 1]].tobytes().decode("utf-8", "replace"))
                label = [m.languages[b] if ok else "und" for b, ok in zip(best.tolist(), some.tolist(), strict=True)]
                yield pa.record_batch([*[c.slice(i, n) for c in batch.columns], pa.array(label, pa.string()), pa.array(np.where(some, score, 0.0))], [*batch.schema.names, "lang_pred", "score"])

    out = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields], "lang_pred string, score double"])
    return docs.mapInArrow(run, out)
