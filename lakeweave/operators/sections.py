"""Sections of product sheets by their headings, and chunks of sentences with their places.

Both go over a text once, from left to right: work and memory are linear in its length, whatever the number of parts. Null texts
have none, empty texts neither; repeated rows have theirs each; ids may repeat or be null.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Headings (in any case) and the kind of section that each begins.
HEADINGS = (
    (r"What is .+\?", "overview"),
    (r"Key Benefits", "benefits"),
    (r"How Does It Work\?", "mechanism"),
    (r"For Use On", "applications"),
    (r"Suitable For", "applications"),
    (r"Technical Data", "technical"),
    (r"Composition", "technical"),
    (r"Properties", "technical"),
    (r"Environmental Care", "environmental"),
    (r"Colour Coding", "other"),
    (r"Quality", "quality_certification"),
    (r"Application", "instructions"),
    (r"Directions", "instructions"),
    (r"How to Use", "instructions"),
    (r"Safety Precautions", "safety"),
    (r"First Aid", "safety"),
    (r"Disposal Information", "disposal"),
    (r"Empty Packaging", "disposal"),
    (r"Available in", "availability"),
    (r"Dispensing Accessories", "accessories"),
)
#: Tokens under which a section joins the next one, tokens at most, tokens of a part of a longer one; characters of
#: a token and of a chunk of sentences.
LEAST, MOST, PART, TOKEN, CHUNK = 50, 600, 400, 4, 1000
PAGE = "\f"
_COMPILED = [(re.compile(p, re.IGNORECASE), kind) for p, kind in HEADINGS]
#: What every match of a heading begins with, in lower case, and characters that match others without regard to case.
_BEGINS = [re.split(r"\.\+|\\", p)[0].lower() for p, _ in HEADINGS]
_FOLDED = str.maketrans({**{chr(c): chr(c + 32) for c in range(65, 91)}, "\u0130": "i", "\u0131": "i", "\u017f": "s", "\u212a": "k"})
#: Rows of a frame that a task lets out.
ROWS = 2000


def _tokens(text: str) -> int:
    return math.ceil(len(text) / TOKEN)


def _heads(page: str) -> list[tuple[int, int, str, str]]:
    """(start, order, heading, kind) in order. Patterns are tried only on pages that hold what they begin with, from there on:
    a search for a plain string takes a small part of the time of one by a pattern."""
    folded = page.lower() if page.isascii() else page.translate(_FOLDED)
    out = []
    for order, ((head, kind), begins) in enumerate(zip(_COMPILED, _BEGINS, strict=True)):
        if (first := folded.find(begins)) >= 0:
            out += [(m.start(), order, m.group(), kind) for m in head.finditer(page, first)]
    return sorted(out)


def _found(text: str) -> Iterator[dict]:
    """Raw sections in order: from each heading to the next one on its page; pages are cut by form feeds."""
    before = 0
    for number, page in enumerate(text.split(PAGE), 1):
        heads = _heads(page)
        ends = [h[0] for h in heads[1:]] + [len(page)] * bool(heads)
        for (start, _, heading, kind), end in zip(heads, ends, strict=True):
            content = page[start:end].strip()
            yield {"page": number, "kind": kind, "heading": heading, "content": content, "start": before + start, "end": before + end, "n_tokens": _tokens(content)}
        before += len(page) + 1


def _joined(found: Iterator[dict]) -> Iterator[dict]:
    """Small sections joined with the one that follows, if both fit; a joined section does not join again."""
    held = None
    for section in found:
        if held is None:
            held = section
        elif held["n_tokens"] < LEAST and held["n_tokens"] + section["n_tokens"] <= MOST:
            yield held | {"heading": f"{held['heading']} + {section['heading']}", "content": f"{held['content']}\n\n{section['content']}", "end": section["end"], "n_tokens": held["n_tokens"] + section["n_tokens"]}
            held = None
        else:
            yield held
            held = section
    if held is not None:
        yield held


def _parts(section: dict) -> Iterator[dict]:
    """A section of more than MOST tokens in parts of about PART, at sentences; a longer sentence is a part of its own."""
    if section["n_tokens"] <= MOST:
        yield section
        return
    sentences = [s for s in re.split(r"[.!?]+\s+", section["content"]) if s.strip()]
    groups: list[list[str]] = [[]]
    size = 0
    for s in sentences:
        n = _tokens(s)
        if groups[-1] and size + n > PART:
            groups.append([])
            size = 0
        groups[-1].append(s)
        size += n
    for number, group in enumerate((g for g in groups if g), 1):
        yield section | {"heading": f"{section['heading']} (Part {number})", "content": " ".join(group).strip(), "n_tokens": sum(map(_tokens, group))}


def sections_of(text: str) -> list[dict]:
    return [part for section in _joined(_found(text)) for part in _parts(section)]


def chunks_of(text: str, pages: int = 1, size: int = CHUNK) -> list[dict]:
    """Runs of sentences of up to `size` characters, a longer sentence alone; where they are in the text, and the page that their
    end would be on if the text filled `pages` evenly."""
    spans, at = [], 0
    for gap in re.finditer(r"(?<=[.!?])\s+", text):
        spans.append((at, gap.start()))
        at = gap.end()
    spans.append((at, len(text)))
    out: list[dict] = []
    for a, b in spans:
        sentence = text[a:b].strip()
        if not sentence:
            continue
        if out and out[-1]["_n"] + 1 + len(sentence) <= size:
            out[-1]["_s"].append(sentence)
            out[-1] |= {"end": b, "_n": out[-1]["_n"] + 1 + len(sentence)}
        else:
            out.append({"start": a, "end": b, "_s": [sentence], "_n": len(sentence)})
    return [{"content": " ".join(c["_s"]), "start": c["start"], "end": c["end"], "page": max(1, math.ceil(c["end"] / len(text) * pages))} for c in out]


def _exploded(docs: DataFrame, id: str, text: str, parts: Callable[[str], list[dict]], number: str, schema: str, more: list[str] = ()) -> DataFrame:
    kind = docs.schema[id].dataType.simpleString()
    columns = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frame = lambda rows: pd.DataFrame(rows, columns=[id, number, *columns])
        for batch in batches:
            rows: list[tuple] = []
            for row in batch.itertuples(index=False):  # memory is that of one text and of ROWS parts
                rows += [(row[0], i, *(part[c] for c in columns)) for i, part in enumerate(parts(row[1], *row[2:]))]
                if len(rows) >= ROWS:
                    yield frame(rows)
                    rows = []
            if rows:
                yield frame(rows)

    source = docs.where(F.col(text).isNotNull() & (F.col(text) != "")).select(id, F.col(text).alias("_text"), *more)
    return source.mapInPandas(run, f"{id} {kind}, {number} int, {schema}")


def sections(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """<id>, section, page, kind, heading, content, start, end, n_tokens of each text's sections."""
    return _exploded(docs, id, text, sections_of, "section", "page int, kind string, heading string, content string, start int, end int, n_tokens int")


def sentence_chunks(docs: DataFrame, id: str = "doc_id", text: str = "text", pages: str | None = None, size: int = CHUNK) -> DataFrame:
    """<id>, chunk_index, content, start, end, page; pages: a column with each text's number of pages, else 1."""
    cut = lambda t, n=1: chunks_of(t, int(n or 1), size)
    return _exploded(docs, id, text, cut, "chunk_index", "content string, start int, end int, page int", [F.col(pages)] if pages else [])


def chunk_kind(content):
    """heading, list_item, paragraph or text."""
    heading = (F.length(content) < 100) & content.rlike(r"^[A-Z]") & ~content.rlike(r"[.!?]$")
    return F.when(heading, "heading").when(content.rlike(r"^\s*[-*•]\s"), "list_item").when(F.length(content) > 200, "paragraph").otherwise("text")
