"""Token ids of a word-end BPE vocabulary for whole columns, by the tokenizers library.

The vocabulary's normaliser and word pattern never look across white space, so a text's ids are those of its words, one
after the other. Each word is encoded once a process; ids of texts are put together by array lookups.
"""

from __future__ import annotations

import os

import numpy as np

from . import words

#: Characters that end a word's core as one further run.
_TAIL = np.zeros(256, bool)
_TAIL[[ord(c) for c in ".,;:!?)"]] = True
_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Pool:
    """Values of byte strings (ids of words, texts of ids), kept once worked out by `_made` (of a subclass): up to `limit`
    strings a process."""

    def __init__(self, limit: int = 600_000, dtype: type = np.int32):
        self.slots, self.dtype = words.Slots(limit), dtype
        self._empty()

    def _empty(self) -> None:
        self.slots.clear()
        self.pool, self.start, self.size, self.used = np.zeros(0, self.dtype), np.zeros(0, np.int64), np.zeros(0, np.int64), 0

    def _made(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Values of all parts, one after the other, and their numbers of values."""
        raise NotImplementedError

    def values_of(self, data: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values of all spans, one after the other, and their numbers of values."""
        u, first, back = np.unique(words.Hasher(data)(s, e), return_index=True, return_inverse=True)
        if len(self.slots.keys) + len(u) > self.slots.limit:
            self._empty()
        slot, there = self.slots.find(u)
        if not there.all():
            new = first[~there]
            ids, size = self._made(words.spans(data, s[new], e[new]))
            slot[~there] = self.slots.add(u[~there])
            if self.used + len(ids) > len(self.pool):
                self.pool = np.concatenate([self.pool[: self.used], np.zeros(self.used // 2 + 2 * len(ids), self.dtype)])
            self.pool[self.used : self.used + len(ids)] = ids
            self.start = np.concatenate([self.start, self.used + np.cumsum(size) - size])
            self.size = np.concatenate([self.size, size])
            self.used += len(ids)
        of = slot[back]
        n = self.size[of] if len(of) else np.zeros(0, np.int64)
        return self.pool[words.gather(self.start[of], n)] if len(of) else np.zeros(0, self.dtype), n


class WordEncoder(Pool):
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        super().__init__()
        self.model = Tokenizer.from_file(path)
        vocab = self.model.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for w, i in vocab.items() if w.endswith("</w>")]] = True

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def _made(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Parts of letters alone go together as one text: each is one word there, and its last id is a word end."""
        parts = [p.decode() for p in parts]
        size = np.zeros(len(parts), np.int64)
        plain = [i for i, p in enumerate(parts) if p.isalpha()]
        found: dict[int, np.ndarray] = {}
        for a in range(0, len(plain), 1000):
            group = plain[a : a + 1000]
            ids = np.array(self._ids([" ".join(parts[i] for i in group)])[0], np.int64)
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(group) and cuts[-1] == len(ids):
                size[group] = np.diff(cuts, prepend=0)
                for i, x in zip(group, np.split(ids, cuts[:-1]), strict=True):
                    found[i] = x
        rest = [i for i in range(len(parts)) if i not in found]
        for a in range(0, len(rest), 1000):
            group = rest[a : a + 1000]
            for i, x in zip(group, self._ids([parts[i] for i in group]), strict=True):
                found[i], size[i] = np.array(x, np.int64), len(x)
        return np.concatenate([found[i] for i in range(len(parts))] or [np.zeros(0, np.int64)]), size

    def __call__(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows of a slice, one after the other, and the rows' offsets in them."""
        data = words.LOWER[data]
        s, e, _ = words.runs(data, at)
        tail = (e - s > 1) & _TAIL[data[e - 1]] & _ALNUM[data[np.maximum(e - 2, 0)]]
        order = np.arange(len(s)) + np.cumsum(tail) - tail
        ps, pe = np.zeros(len(s) + int(tail.sum()), np.int64), np.zeros(len(s) + int(tail.sum()), np.int64)
        ps[order], pe[order] = s, e - tail
        ps[order[tail] + 1], pe[order[tail] + 1] = e[tail] - 1, e[tail]
        ids, n = self.values_of(data, ps, pe)
        return ids.astype(np.uint32), np.concatenate([[0], np.cumsum(n)])[np.searchsorted(ps, at)]


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]
