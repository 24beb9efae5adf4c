"""SentencePiece models: a unigram model with byte fallback against the other library."""

import numpy as np
from pyspark.sql import functions as F

from lakeweave.llm import pieces


def unigram_model() -> bytes:
    """A model file of a few pieces with byte fallback, written field by field."""
    import struct

    def varint(n):
        return bytes([n]) if n < 128 else bytes([n & 127 | 128]) + varint(n >> 7)

    def number(field, n):
        return varint(field << 3) + varint(n)

    def raw(field, x):
        return varint(field << 3 | 2) + varint(len(x)) + x

    def piece(text, score, kind):
        return raw(1, raw(1, text.encode()) + varint(2 << 3 | 5) + struct.pack("<f", score) + number(3, kind))

    plain = {"▁": -2.0, "▁a": -1.0, "a": -3.0, "b": -3.5, "ab": -4.5, "▁ab": -4.0, "ba": -5.0, "é": -4.2, "aba": -6.1}
    parts = [piece("<unk>", 0, 2), piece("<s>", 0, 3), piece("</s>", 0, 3), *[piece(f"<0x{i:02X}>", -12, 6) for i in range(256)], *[piece(t, v, 1) for t, v in plain.items()]]
    return b"".join([*parts, raw(2, number(3, 1) + number(35, 1) + number(40, 0)), raw(3, number(3, 1) + number(4, 0) + number(5, 1))])


def test_unigram_with_byte_fallback_equals_the_other_library(spark):
    import sentencepiece

    raw = unigram_model()
    assert pieces.Model.parse(raw).kind == pieces.UNIGRAM and pieces.Model.parse(raw).byte_fallback
    rng = np.random.default_rng(9)
    rows = ["".join(rng.choice(list("aabbé 日c\n"), rng.integers(0, 30))) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").withColumns({"ids": F.lit("clash"), "decoded": F.lit(1), "n": F.lit(2)})
    sp = sentencepiece.SentencePieceProcessor(model_proto=raw)
    got = pieces.decode(pieces.encode(df, raw, differing="n", threads=3), raw).collect()
    assert len(got) == 400 and all((r.ids, r.n, r.decoded) == (sp.encode(r.text), 0, r.text) for r in got)
