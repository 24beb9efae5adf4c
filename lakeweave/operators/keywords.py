"""Keyword search of whole tables of queries over names, types and observations, and its choice against vectors."""

from __future__ import annotations

from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .search import fuse_weighted

#: Keywords, and characters of texts, that one task compares.
KEYWORD_BLOCK, TEXT_BLOCK = 100_000, 32_000_000
#: Stands between the fields of an entity, so that no keyword is found across two of them.
BETWEEN = "\u0001"


def _matches_of_block(limit: int | None):
    """Names of a block's texts that hold each keyword of a block: one pass over the texts for all keywords at once. With a
    limit only the least names of each keyword are held and leave."""

    def run(key: tuple, texts: pd.DataFrame, keywords: pd.DataFrame) -> pd.DataFrame:
        import ahocorasick

        found: dict[str, set] = defaultdict(set)
        if len(texts) and len(keywords):
            machine = ahocorasick.Automaton()
            for w in keywords["keyword"]:
                machine.add_word(w, w)
            machine.make_automaton()
            for name, text in zip(texts["name"], texts["text"]):
                for w in {w for _, w in machine.iter(text)}:
                    found[w].add(name)
                    if limit is not None and len(found[w]) > 4 * limit + 64:
                        found[w] = set(sorted(found[w])[:limit])
        rows = [(w, n) for w, names in found.items() for n in (names if limit is None else sorted(names)[:limit])]
        return pd.DataFrame(rows, columns=["keyword", "name"], dtype="object")

    return run


def keyword_search(queries: DataFrame, entities: DataFrame, limit: int | None = None, types: list[str] | None = None, case_sensitive: bool = False) -> DataFrame:
    """query_id, name, score (1.0): the entities (name, entity_type, observations) whose name, type or any observation holds a
    query's text (query_id, text) anywhere; per query the first `limit` by name, all of them without a limit.

    Distinct keywords are dealt into blocks, texts into blocks of about TEXT_BLOCK characters, and a task looks for a block of
    keywords in a block of texts; so a keyword that all texts hold costs no more than another. Null or empty query texts, and
    those with the character U+0001, find nothing; null fields hold nothing; entities without a name are left out; repeated
    names count once."""
    fold = (lambda c: c) if case_sensitive else F.lower
    asked = queries.select("query_id", fold(F.col("text")).alias("keyword")).where((F.length("keyword") > 0) & ~F.contains("keyword", F.lit(BETWEEN)))
    e = (entities.where(F.col("entity_type").isin(types)) if types else entities).where("name is not null")
    t = e.select("name", fold(F.concat_ws(BETWEEN, "name", "entity_type", F.array_join("observations", BETWEEN))).alias("text"))
    words = asked.select("keyword").distinct()
    k_parts = max(1, -(-words.count() // KEYWORD_BLOCK))
    t_parts = max(1, -(-(t.agg(F.sum(F.length("text"))).first()[0] or 0) // TEXT_BLOCK))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    # A name that many rows repeat is spread by the partition that each was read in.
    t = t.withColumn("_t", F.pmod(F.xxhash64("name", F.spark_partition_id()), F.lit(t_parts)).cast("int")).withColumn("_k", every(k_parts))
    words = words.withColumn("_k", F.pmod(F.xxhash64("keyword"), F.lit(k_parts)).cast("int")).withColumn("_t", every(t_parts))
    found = t.groupBy("_t", "_k").cogroup(words.groupBy("_t", "_k")).applyInPandas(_matches_of_block(limit), "keyword string, name string").distinct()
    if limit is not None:
        r = F.row_number().over(W.partitionBy("keyword").orderBy("name"))
        found = found.withColumn("_r", r).where(F.col("_r") <= limit).drop("_r")
    return asked.join(found, "keyword").select("query_id", "name", F.lit(1.0).alias("score"))


def search_or_keyword(keyword: DataFrame, vector: DataFrame, limit: int = 10) -> DataFrame:
    """query_id, name, score, rank, strategy: the weighted fusion of both lists for queries that found vectors; for all others,
    say of texts that have no vector yet, keyword hits alone."""
    have = vector.select("query_id").distinct().withColumn("_v", F.lit(True))
    fused = fuse_weighted(keyword, vector).join(have, "query_id", "left")
    score = F.when(F.col("_v"), F.col("score")).otherwise(F.lit(1.0))
    out = fused.select("query_id", "name", score.alias("score"), F.when(F.col("_v"), "hybrid").otherwise("graph").alias("strategy"))
    r = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "name"))
    return out.withColumn("rank", r).where(F.col("rank") <= limit).select("query_id", "name", "score", "rank", "strategy")
