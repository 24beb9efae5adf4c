"""Sections and sentence chunks against a plain reading of their rules, closures against walks, payloads case by case."""

import math
import random
import re

import pytest

from lakeweave.functions import payloads as PL
from lakeweave.operators import sections as SE
from lakeweave.operators import trees as T


def plain_sections(text):
    """All sections first, then one pass that joins, then one that cuts."""
    raw, before = [], 0
    for number, page in enumerate(text.split("\f"), 1):
        heads = []
        for order, (pattern, kind) in enumerate(SE.HEADINGS):
            at = 0
            while m := re.compile(pattern, re.I).search(page, at):
                heads.append((m.start(), order, m.group(), kind))
                at = m.end()
        heads.sort()
        for i, (start, _, heading, kind) in enumerate(heads):
            end = heads[i + 1][0] if i + 1 < len(heads) else len(page)
            body = page[start:end].strip()
            raw.append([number, kind, heading, body, before + start, before + end, math.ceil(len(body) / 4)])
        before += len(page) + 1
    joined, i = [], 0
    while i < len(raw):
        x = list(raw[i])
        if x[6] < 50 and i + 1 < len(raw) and x[6] + raw[i + 1][6] <= 600:
            y = raw[i + 1]
            x[2:4] = [f"{x[2]} + {y[2]}", f"{x[3]}\n\n{y[3]}"]
            x[5:] = [y[5], x[6] + y[6]]
            i += 1
        joined.append(x)
        i += 1
    out = []
    for x in joined:
        if x[6] <= 600:
            out.append(x)
            continue
        part, size, number = "", 0, 1
        for s in re.split(r"[.!?]+\s+", x[3]):
            if not s.strip():
                continue
            n = math.ceil(len(s) / 4)
            if part and size + n > 400:
                out.append([*x[:2], f"{x[2]} (Part {number})", part.strip(), x[4], x[5], size])
                part, size, number = "", 0, number + 1
            part, size = part + s + " ", size + n
        out.append([*x[:2], f"{x[2]} (Part {number})", part.strip(), x[4], x[5], size])
    return [(k, *x) for k, x in enumerate(out)]


def sheets():
    rnd, heads = random.Random(4), ["What is Oxy clean?", "KEY BENEFITS", "How does it work?", "Directions", "first aid", "Quality", "Available in"]
    out = ["", None, "no heading at all", "Directions", "x\fQuality\f\fFirst Aid now"]
    for _ in range(25):
        parts = []
        for _ in range(rnd.randrange(1, 8)):
            parts.append(rnd.choice(heads))
            parts += [" ".join(rnd.choices(["clean", "rinse", "wipe", "dry", "store"], k=rnd.randrange(1, 60))) + rnd.choice([". ", "! ", "?\n", "\f"]) for _ in range(rnd.choice([0, 1, 3, 30]))]
        out.append("\n".join(parts))
    return out + ["Directions " + "word " * 5000 + ". end", "Properties " + "a. " * 3000]


def test_sections(spark):
    texts = sheets()
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(None, "Quality", "x"), (3, texts[3], "x")], "doc_id long, text string, section string")
    got = {}
    for r in SE.sections(df).collect():
        got.setdefault(r["doc_id"], []).append((r["section"], r["page"], r["kind"], r["heading"], r["content"], r["start"], r["end"], r["n_tokens"]))
    assert got.pop(None) == plain_sections("Quality") and len(got.pop(3)) == 2
    want = {i: plain_sections(t) for i, t in enumerate(texts) if t and i != 3}
    assert {k: sorted(v) for k, v in got.items()} == {k: v for k, v in want.items() if v}


def test_sentence_chunks(spark):
    texts = [(0, "One. Two!  Three? four", 2), (1, "a" * 30 + ". " + "b" * 5 + ". " + "c" * 3, 1), (2, None, 1), (3, "", 1), (4, "  \n ", 1), (5, "x. " * 400, 4)]
    df = spark.createDataFrame(texts, "doc_id long, text string, pages int")
    got = {}
    for r in sorted(SE.sentence_chunks(df, pages="pages", size=20).collect()):
        got.setdefault(r["doc_id"], []).append((r["content"], r["start"], r["end"], r["page"]))
    assert got[0] == [("One. Two! Three?", 0, 17, 2), ("four", 18, 22, 2)]
    assert [c[0] for c in got[1]] == ["a" * 30 + ".", "bbbbb. ccc"] and set(got) == {0, 1, 5}
    for i, t, pages in texts:
        for c, a, b, page in got.get(i, []):
            assert re.sub(r"\s+", " ", t[a:b]).strip() == c and (len(c) <= 20 or "." not in c[:-1]) and page == max(1, math.ceil(b / len(t) * pages))


@pytest.mark.parametrize("depth", [1, 5, 37])
def test_closure(spark, depth):
    rnd = random.Random(depth)
    parent = {f"n{i}": f"n{i - 1}" for i in range(1, depth + 1)} | {f"m{i}": rnd.choice([f"n{rnd.randrange(depth)}", f"m{rnd.randrange(i)}"]) if i else "n0" for i in range(30)}
    parent |= {f"c{i}": f"c{(i + 1) % 4}" for i in range(4)} | {"tail": "c2"}
    rows = [*parent.items(), ("n0", None), (None, "n0"), ("loop", "loop"), *list(parent.items())[:2], ("tail", "zz")]
    want = set()
    for x in parent:
        y, k, seen = parent.get(x), 1, {x}
        while y and y not in seen:
            want.add((y, x, k))
            seen.add(y)
            y, k = parent.get(y), k + 1
    got = T.closure(spark.createDataFrame(rows, "node string, parent string"))
    assert {tuple(r) for r in got.collect()} == want
    assert T.closure(spark.createDataFrame([], "node string, parent string")).count() == 0


def test_payloads(spark):
    rows = [(1, '{"k": 5, "u": {"id": 7}, "t": ["a", 1]}'), (2, '{"k": "x", "u": {"id": "8"}}'), (3, '{"k": 1'), (4, ""), (5, None), (6, '{"k": null}'), (7, "[1, 2]"), (8, '{"k": 12345678901234567890}')]
    df = spark.createDataFrame(rows, "id long, p string")
    fields = {"k": ("$.k", "int"), "user": ("$.u.id", "long")}
    good, bad = PL.split_faulty(df, "p", fields)
    assert {(r["id"], r["k"], r["user"]) for r in good.collect()} == {(1, 5, 7), (4, None, None), (5, None, None), (6, None, None), (7, None, None)}
    assert {(r["id"], tuple(r["faults"])) for r in bad.collect()} == {(2, ("k",)), (3, ("payload",)), (8, ("k",))} and bad.columns == ["id", "p", "faults"]
    assert {(r["id"], r["pos"], r["value"]) for r in PL.items(df, "p", "$.t", ["id"]).collect()} == {(1, 0, "a"), (1, 1, "1")}
    assert "k" in PL.schema_of(df.where("id in (1, 2)"), "p").first()["schema"]


def test_headings_are_found_as_by_patterns(monkeypatch):
    """Patterns are tried only where a page holds what they begin with, in any case, and the same headings are found."""
    from lakeweave.operators import sections as S

    rnd = random.Random(5)
    words = ["WHAT IS it?", "what is\nno?", "Key Benefıts", "KEY BENEFİTS", "Key benefits", "ſafety Precautions", "Quality application", "How Does It Work?", "how does it work", "x", "Straße\n", "\n"]
    tried = []

    class Seen:
        def __init__(self, pattern):
            self.pattern = pattern

        def finditer(self, *a):
            tried.append(a)
            return self.pattern.finditer(*a)

    whole = lambda page: sorted((m.start(), o, m.group(), k) for o, (h, k) in enumerate(S._COMPILED) for m in h.finditer(page))
    pages = [" ".join(rnd.choices(words, k=12)) for _ in range(200)]
    want = [whole(p) for p in pages]
    monkeypatch.setattr(S, "_COMPILED", [(Seen(p), k) for p, k in S._COMPILED])
    assert [S._heads(p) for p in pages] == want and sum(map(len, want)) > 500
    tried.clear()
    assert S._heads("a page without any of them") == [] and not tried
