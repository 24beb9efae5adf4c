"""Tries against prefixes enumerated in Python, with heavy prefixes from the first turn on and with none."""

import hashlib
import re
import zlib
from collections import defaultdict

import pytest

from lakeweave.llm import prefix_trie

WORD = re.compile("[^\x20\x09-\x0d]+")


def content(role, text):
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16]


def brute_rebuilt(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", content(role or "", text or ""), text or ""))
    own = {c: [(x[2], x[4]) for x in sorted(v)] for c, v in own.items()}
    out = {}
    for c, mine in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        out[c] = own.get(c - c % 20, [])[:h] + mine[h:]
    return out


def brute(convs):
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    children = defaultdict(int)
    for k in members:
        if k:
            children[k[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for k, m in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += children[k] == 0
            saved[k[:d]] += (len(m) - 1) * len(WORD.findall(k[-1][1])) if k else 0
    sha = lambda k: hashlib.sha256(",".join(map(str, sorted(ends[k]))).encode()).hexdigest()
    return sorted(((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), children[k], leaves[k], saved[k], sha(k)) for k, m in members.items()), key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()), key=str)


def rows():
    out = []
    for c in range(130):
        for t in range(c % 6):
            out.append((c, t, ["user", "assistant"][t % 2], f"words of {c % 3 if t < 2 else c % 11} at {t}"))
    for c in range(1000, 1400):  # one hot conversation
        out += [(c, t, "user", f"hot {t}") for t in range(7)]
    out += [(2000 + i, t, "user", f"deep {t}") for i in range(3) for t in range(300 - i)]
    out += [(40, None, None, None), (40, None, "user", "\x1f x y"), (41, 0, "user", ""), (41, 0, "user", ""), (41, 0, "a", "tie"), (None, 1, "user", "no one's"), (-7, 0, "user", "negative"), (61, 5, "user", "z" * 200_000), (3, 1, "us", "er"), (3, 1, "use", "r")]
    return out


def frame(spark, data):
    return spark.createDataFrame([(*r, "x", b"k") for r in data], "conv_id long, turn long, role string, text string, words string, key binary").repartition(5)


@pytest.mark.parametrize("limit", [prefix_trie.LIMIT, 500, 3])
def test_trie(spark, limit, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK", 64)
    data = rows()
    want = brute(brute_rebuilt(data)) if limit > 3 else None
    if limit == 3:  # rounds of jobs as many as the deep conversations have turns: shorter ones here
        data = [r for r in data if r[0] is None or r[0] < 2000 or r[1] < 4]
        want = brute(brute_rebuilt(data))
    if limit == 500:
        data = [r for r in data if r[0] is None or r[0] < 2000 or r[1] < 12]
        want = brute(brute_rebuilt(data))
    assert got(prefix_trie.trie(prefix_trie.rebuilt(frame(spark, data)), limit)) == want


def test_plain_sequences(spark):
    data = [(c, t, "user", f"w {c // 2} {t}") for c in range(8) for t in range(3)]
    convs = defaultdict(list)
    for c, _, r, x in data:
        convs[c].append((r, x))
    assert got(prefix_trie.trie(prefix_trie.sequences(frame(spark, data)))) == brute(convs)


def test_turnless_and_empty(spark):
    """Conversations whose own turns are all replaced by those of one that isn't there have no turns."""
    data = [(c, 0, "user", "only") for c in range(1, 15)]
    want = brute(brute_rebuilt(data))
    assert any(x[1] == 0 and x[7] != prefix_trie.NONE for x in want)
    assert got(prefix_trie.trie(prefix_trie.rebuilt(frame(spark, data)))) == want
    assert got(prefix_trie.trie(prefix_trie.rebuilt(frame(spark, data).limit(0)))) == []
    alone = [(c, 0, "user", "only") for c in range(1, 15) if zlib.crc32(str(c).encode()) % 4]
    assert got(prefix_trie.trie(prefix_trie.rebuilt(frame(spark, alone)))) == brute(brute_rebuilt(alone))
