"""I-Match fingerprints with randomised lexicons.

Terms are the distinct lower-cased runs of letters and digits of a text. The lexicon keeps the terms whose inverse
document frequency ln(N / df) lies in a band; a lower frequency bound `df >= f * N` means it never holds more than
(mean distinct terms of a document) / f terms, however large the corpus. Subsets of the lexicon are drawn once, alike for every
text: DRAWS random orders of the lexicon, and of each the first quarter, sixteenth, and so on, SHARES of them. A term's
place in an order is the number of leading pairs of zero bits of digits of its SHA-256. A fingerprint is the hash of all of a document's lexicon
terms, sorted (of its text, if there is none), and then one part for each subset: the hash of the sorted terms that it keeps,
'-' if it keeps none. Large subsets tell small edits of short texts apart; small ones keep a few terms of a long text and
outlive an edit of half of it. Every term is in a quarter of the largest subsets on average, so each can matter.

Likeness of two fingerprints: 1 if they begin alike; else equal parts among those that aren't empty in both; 0 if there is none.
Null texts count as empty, and two texts without lexicon terms are alike only if equal. Very long texts are read whole.
Repeated rows get equal fingerprints, empty tables none. Other columns stay; columns named fingerprint are replaced.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: idf band; random orders of the lexicon, and how many times its first part is quartered.
IDF_LOW, IDF_HIGH = 1.5, 6.5
DRAWS, SHARES = 12, 6
#: Largest lexicon that goes out with the plan; a larger one is joined.
MAX_TERMS = 1 << 17
GAPS = r"[^\p{L}\p{N}]+"


def terms_of(text: Column) -> Column:
    return F.array_remove(F.array_distinct(F.split(F.lower(F.coalesce(text, F.lit(""))), GAPS)), "")


def lexicon(docs: DataFrame, text: str = "text", idf_low: float = IDF_LOW, idf_high: float = IDF_HIGH) -> DataFrame:
    """term, df of the terms in the band. Document frequencies are counted over all documents."""
    n = docs.count()
    low, high = math.ceil(n * math.exp(-idf_high)), math.floor(n * math.exp(-idf_low))
    words = docs.select(F.explode(terms_of(F.col(text))).alias("term"))
    return words.groupBy("term").agg(F.count("*").alias("df")).where(F.col("df").between(low, high))


class Lexicon:
    """The band's terms and how often each draw's first part can be quartered and still hold them, ready for lookups inside expressions: an array of short
    lists, addressed by hash. So a term's hash is worked out once a lexicon, not wherever the term occurs."""

    def __init__(self, terms: DataFrame):
        number = lambda r: F.conv(F.substring(F.sha2("term", 256), 4 * r + 1, 4), 16, 10).cast("long")
        # Pairs of leading zeros of 16 bits.
        zeros = [16 - F.when(number(r) == 0, 0).otherwise(F.length(F.bin(number(r)))) for r in range(DRAWS)]
        self.terms = terms.select("term", F.array(*[F.shiftright(z.cast("long"), 1) for z in zeros]).alias("v"))
        n = self.terms.count()
        self.shipped = n <= MAX_TERMS
        if self.shipped:
            self.slots = 1 << max(1, (2 * n).bit_length())
            table: list[list[dict]] = [[] for _ in range(self.slots)]
            for r in self.terms.select("term", "v", F.pmod(F.xxhash64("term"), F.lit(self.slots)).alias("at")).collect():
                table[r["at"]].append({"w": r["term"], "v": r["v"]})
            self.table = F.from_json(F.lit(json.dumps(table, ensure_ascii=False, separators=(",", ":"))), "array<array<struct<w: string, v: array<bigint>>>>")

    def kept(self, text: Column) -> Column:
        """w, v of the text's distinct lexicon terms, sorted."""
        at = lambda w: F.element_at(self.table, (F.pmod(F.xxhash64(w), F.lit(self.slots)) + 1).cast("int"))
        return F.array_sort(F.flatten(F.transform(terms_of(text), lambda w: F.filter(at(w), lambda x: x["w"] == w))))


def _let(x: Column, body) -> Column:
    """`body(x)` with x worked out once."""
    return F.get(F.transform(F.array(x), body), F.lit(0))


def fingerprint_of(kept: Column, text: Column) -> Column:
    """Whole hash and parts of sorted lexicon terms (w, v), joined by blanks. A draw's subsets lie in each other, so each is
    filtered from the one before."""
    listed = lambda terms: F.array_join(F.transform(terms, lambda t: t["w"]), " ")
    short = lambda terms: F.when(F.size(terms) == 0, "-").otherwise(F.substring(F.md5(listed(terms)), 1, 8))

    def draw(terms: Column, r: Column) -> Column:
        def quarter(a: Column, k: Column) -> Column:
            return _let(F.filter(a["left"], lambda t: F.get(t["v"], r) >= k), lambda f: F.struct(f.alias("left"), F.concat_ws(" ", a["out"], short(f)).alias("out")))

        start = F.struct(terms.alias("left"), F.lit(None).cast("string").alias("out"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(SHARES)), start, quarter, lambda a: a["out"])

    def whole(terms: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.lit(DRAWS - 1)), lambda r: draw(terms, r))
        return F.concat_ws(" ", F.md5(F.when(F.size(terms) > 0, listed(terms)).otherwise(text)), parts)

    return _let(kept, whole)


def likeness(a: Column, b: Column) -> Column:
    def parts(x: Column, y: Column) -> Column:
        tail = lambda z: F.slice(z, 2, DRAWS * SHARES)
        pairs = F.filter(F.arrays_zip(tail(x).alias("a"), tail(y).alias("b")), lambda p: (p["a"] != "-") | (p["b"] != "-"))
        share = _let(pairs, lambda p: F.when(F.size(p) == 0, 0.0).otherwise(F.size(F.filter(p, lambda q: q["a"] == q["b"])) / F.size(p)))
        return F.when(F.get(x, F.lit(0)) == F.get(y, F.lit(0)), 1.0).otherwise(share)

    return _let(F.struct(F.split(a, " ").alias("x"), F.split(b, " ").alias("y")), lambda z: parts(z["x"], z["y"]))


def fingerprint(docs: DataFrame, held: Lexicon, text: str = "text", into: str = "fingerprint") -> DataFrame:
    """`docs` with a column `into`."""
    if held.shipped:
        return docs.withColumn(into, fingerprint_of(held.kept(F.col(text)), F.coalesce(F.col(text), F.lit(""))))
    row = F.xxhash64(F.coalesce(F.col(text), F.lit(""))), F.coalesce(F.md5(text), F.lit(""))
    keyed = docs.drop(into).withColumns({"_lw_a": row[0], "_lw_b": row[1]})
    words = keyed.select("_lw_a", "_lw_b", F.explode(terms_of(F.col(text))).alias("term")).distinct().join(held.terms, "term")
    found = words.groupBy("_lw_a", "_lw_b").agg(F.array_sort(F.collect_list(F.struct(F.col("term").alias("w"), "v"))).alias("_lw_terms"))
    kept = F.coalesce("_lw_terms", F.array().cast("array<struct<w: string, v: array<bigint>>>"))
    out = keyed.join(found, ["_lw_a", "_lw_b"], "left")
    return out.withColumn(into, fingerprint_of(kept, F.coalesce(F.col(text), F.lit("")))).drop("_lw_a", "_lw_b", "_lw_terms")


def edited(text: Column, following: Column) -> Column:
    """The last half of the code points replaced by as many of the next text's first (or by all of them, if fewer)."""
    n = F.length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - half), F.substring(following, F.lit(1), half))
