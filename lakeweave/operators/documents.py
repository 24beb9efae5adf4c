"""Documents: chunks, mentions, sections, dictionary terms; category trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import let

#: Words of a chunk and of the overlap.
CHUNK, OVERLAP = 533, 50
#: Capitalised words between ASCII word boundaries.
CAPITALISED = r"(?<![A-Za-z0-9_])[A-Z][a-zA-Z]{2,}(?![A-Za-z0-9_])"


def word_chunks(docs: DataFrame, id: str = "doc_id", text: str = "text", size: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """<id>, chunk_index, content, token_count. Chunk k starts at word k * (size - overlap); the rest of the text, if only the
    overlap, is a chunk too."""
    step = size - overlap

    def chunks(w: Column) -> Column:
        n = F.greatest(F.lit(0), F.floor((F.size(w) - size) / step) + 1).cast("int")
        starts = F.filter(F.transform(F.sequence(F.lit(0), n), lambda k: k * step), lambda s: s < F.size(w))
        part = lambda s: F.struct(F.array_join(F.slice(w, s + 1, F.lit(size)), " ").alias("content"), F.ceil(F.least(F.lit(size), F.size(w) - s) * 0.75).cast("int").alias("token_count"))
        return F.transform(starts, part)

    # Chunks are strings before they become rows, so that no row carries the whole text's words.
    made = let(F.split(text, r"\s+"), chunks)
    return docs.where(F.col(text).isNotNull()).select(id, F.posexplode(made).alias("chunk_index", "_c")).select(id, "chunk_index", "_c.content", "_c.token_count")


def mentions(docs: DataFrame, id: str = "doc_id", text: str = "text", most: int = 50) -> DataFrame:
    """<id>, target, confidence: the first `most` distinct capitalised words of a text (a feature of the extraction)."""
    w = F.filter(F.array_distinct(F.regexp_extract_all(text, F.lit(CAPITALISED), F.lit(0))), lambda x: F.length(x) < 50)
    return docs.select(id, F.explode(F.slice(w, 1, most)).alias("word")).select(id, F.concat(F.lit("entity_"), F.lower("word")).alias("target"), F.lit(0.6).alias("confidence"))


def term_hits(docs: DataFrame, terms: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """<id>, instance_id, term, confidence: dictionary terms found in texts as whole words, one hit an instance, the longest
    term first; primary terms 1.0, synonyms 0.95. Texts give their word n-grams up to the longest term's words, so terms are
    found by an equal join, however many there are."""
    t = terms.select("instance_id", F.lower("term").alias("term"), "is_primary").where("term != ''")
    longest = t.agg(F.max(F.size(F.split("term", " ")))).first()[0] or 1
    w = F.split(F.lower(text), r"[^\p{L}\p{N}]+")
    grams = [_grams(k) for k in range(1, longest + 1)]
    words = docs.where(F.col(text).isNotNull()).select(id, w.alias("_w")).select(id, F.explode(F.array_distinct(F.flatten(F.array(*grams)))).alias("term"))
    hit = words.join(t, "term")
    r = F.row_number().over(W.partitionBy(id, "instance_id").orderBy(F.desc(F.length("term")), "term"))
    return hit.withColumn("_r", r).where("_r = 1").select(id, "instance_id", "term", F.when(F.col("is_primary"), 1.0).otherwise(0.95).alias("confidence"))


def _grams(k: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size("_w") - (k - 1), F.lit(1))), lambda i: F.array_join(F.slice("_w", i, k), " "))


def category_tree(paths: DataFrame, column: str) -> DataFrame:
    """path, parent, depth for every prefix of slash-separated paths."""
    parts = F.split(column, "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    p = paths.where(F.col(column).isNotNull()).select(F.explode(prefixes).alias("path")).distinct()
    return p.select("path", F.when(F.contains("path", F.lit("/")), F.regexp_replace("path", "/[^/]*$", "")).alias("parent"), F.size(F.split("path", "/")).alias("depth"))


#: Category of a product by the first keyword in its name.
CATEGORIES = (
    ("Dishwashing", ("dish", "wash")), ("Laundry", ("laundry", "fabric")), ("Carpet Care", ("carpet", "upholstery")), ("Glass Cleaning", ("glass", "window")),
    ("Sanitization", ("sanitiser", "sanitizer", "disinfect")), ("Degreasing", ("degreaser", "grease")), ("Bathroom Cleaning", ("toilet", "bowl", "bathroom")),
    ("Floor Care", ("floor", "mop")), ("Kitchen Cleaning", ("kitchen", "oven", "grill")), ("Stain Removal", ("bleach", "stain")), ("Automotive", ("auto", "car", "truck")),
    ("Hand Care", ("hand", "soap")), ("Air Care", ("air", "fresh", "fragrance")),
)


def product_category(name: Column) -> Column:
    out = F.lit(None).cast("string")
    for label, keys in reversed(CATEGORIES):
        out = F.when(F.lower(name).rlike("|".join(keys)), label).otherwise(out)
    return F.coalesce(out, F.lit("General Purpose"))


def labelled_lines(text: Column, label: str, shortest: int = 3) -> Column:
    """Values of 'Label: value' lines."""
    return F.filter(F.transform(F.regexp_extract_all(text, F.lit(rf"(?im)^\s*{label}\s*[:=]\s*(.+)$"), F.lit(1)), lambda x: F.trim(x)), lambda x: F.length(x) >= shortest)


def discoveries(docs: DataFrame, known: DataFrame, id: str = "doc_id", text: str = "text", contexts: int = 3) -> DataFrame:
    """term, n, contexts: capitalised words that no known term (column term, lower case) names, how often, and the first ids."""
    w = docs.select(id, F.explode(F.regexp_extract_all(text, F.lit(CAPITALISED), F.lit(0))).alias("x")).select(id, F.lower("x").alias("term"))
    per = w.groupBy("term", id).agg(F.count("*").alias("k")).join(known.select(F.lower("term").alias("term")).distinct(), "term", "left_anti")
    r = F.row_number().over(W.partitionBy("term").orderBy(id))
    return per.withColumn("r", r).groupBy("term").agg(F.sum("k").alias("n"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("r") <= contexts, F.col(id)))).cast("array<string>"), "|").alias("contexts"))
