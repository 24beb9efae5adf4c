"""Exact duplicates of texts up to white space, by skew-safe combining.

Texts are equal when they are the same after every ASCII white space character is deleted. A digest names the group; the
content stands beside it in every key, so equality is always that of whole contents:

1. locally: the map side of the first aggregation leaves one row for each content and length of a partition;
2. salted: partitions are dealt to SALTS salts, and a content's rows of one salt meet in one task, at most one from each
   partition;
3. globally: the salts' winners, at most SALTS for each content and length, meet by digest.

The longest original text wins, then the smallest id. Rows find their winner by digest alone as long as the contents have
shown that no two of them share one; contents that do share a digest are joined by content. Winners of groups with copies are
repeated once for each of COPY_SALTS salts of their rows, so that a hot group's rows spread.

Nulls: a null text counts as empty, and all texts without other characters are one group. A null id loses against any other;
in a group of null ids alone keep_id is null and the longest rows are kept. Rows that repeat an id with an equally long equal text
are one document and share its decision; `without_copies` leaves one of them. Very long texts are compared whole. An empty
table gives an empty result. Other columns of the input are left out by `copies`, whatever their names, and kept by
`without_copies`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .tables import cut

SALTS, COPY_SALTS = 8, 16


def squeezed(text: Column) -> Column:
    """The text without ASCII white space; null is empty."""
    out = F.coalesce(text, F.lit(""))
    for space in " \t\n\v\f\r":
        out = F.replace(out, F.lit(space), F.lit(""))  # byte by byte: half the time of a regular expression
    return out


def sha256(body: Column) -> Column:
    return F.unhex(F.sha2(body, 256))


def winners(rows: DataFrame) -> DataFrame:
    """digest, body, keep_id, keep_chars, group_size of rows (id, n_chars, body, digest): a row for each distinct content. body
    is null unless other contents have the same digest."""
    salted = rows.withColumn("salt", F.spark_partition_id() % SALTS)
    salted = salted.groupBy("digest", "body", "n_chars", "salt").agg(F.min("id").alias("id"), F.count("*").alias("n"))
    met = salted.repartition("digest").groupBy("digest", "body", "n_chars").agg(F.min("id").alias("id"), F.sum("n").alias("n"))
    best = met.groupBy("digest", "body").agg(F.max_by("id", "n_chars").alias("keep_id"), F.max("n_chars").alias("keep_chars"), F.sum("n").alias("group_size"))
    shared = F.count("*").over(W.partitionBy("digest")) > 1
    return best.withColumn("shared", shared).withColumn("body", F.when(F.col("shared"), F.col("body"))).drop("shared")


def copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """id_col, n_chars, keep_id, group_size, kept, digest of every row, dropped ones too."""
    rows = docs.select(F.col(id_col).alias("id"), F.length(F.coalesce(text_col, F.lit(""))).alias("n_chars"), squeezed(F.col(text_col)).alias("body"))
    rows = rows.withColumn("digest", digest(F.col("body")))
    best = cut(winners(rows))
    copied = best.where("group_size > 1")
    key = ["digest", "salt"]
    salts = F.explode(F.sequence(F.lit(0), F.lit(COPY_SALTS - 1))).alias("salt")
    ask = rows.select("id", "n_chars", "digest", F.pmod(F.xxhash64("id"), F.lit(COPY_SALTS)).cast("int").alias("salt"), "body")
    if best.where("body is not null").limit(1).count():
        # Contents that share a digest are looked up by content, singles too.
        copied, key = best.withColumn("body", F.coalesce("body", F.lit(""))), [*key, "body"]
        ambiguous = best.where("body is not null").select("digest", F.lit(True).alias("ambiguous")).distinct()
        ask = ask.join(ambiguous, "digest", "left").withColumn("body", F.when(F.col("ambiguous"), F.col("body")).otherwise("")).drop("ambiguous")
    else:
        copied, ask = copied.drop("body"), ask.drop("body")
    out = ask.join(copied.select("*", salts), key, "left")
    alone = F.col("group_size").isNull()
    kept = alone | (F.col("keep_id").eqNullSafe(F.col("id")) & (F.col("keep_chars") == F.col("n_chars")))
    return out.select(
        F.col("id").alias(id_col),
        F.col("n_chars").cast("long").alias("n_chars"),
        F.when(alone, F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        kept.alias("kept"),
        "digest",
    )


def without_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that stay, one for each distinct content."""
    stay = cut(copies(docs, id_col, text_col).where("kept").select(F.col(id_col).alias("_lw_id"), F.col("n_chars").alias("_lw_n"), F.col("digest").alias("_lw_digest")).distinct())
    rows = docs.withColumns({"_lw_n_own": F.length(F.coalesce(text_col, F.lit(""))).cast("long"), "_lw_digest_own": sha256(squeezed(F.col(text_col)))})
    same = rows[id_col].eqNullSafe(stay["_lw_id"]) & (F.col("_lw_n_own") == F.col("_lw_n")) & (F.col("_lw_digest_own") == F.col("_lw_digest"))
    return rows.join(stay, same, "left_semi").dropDuplicates([id_col, "_lw_n_own", "_lw_digest_own"]).drop("_lw_n_own", "_lw_digest_own")
