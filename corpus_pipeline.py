"""A training corpus from raw documents: toxic documents go, repeated lines go, one document of each group of near copies
stays, personal data get pseudonyms, and what is left is packed into sequences.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; all but the last return the columns
of documents. None of them can be said in SQL, so ORACLE_SQL is None and tests compare small runs with brute force.

Null and empty texts are neither toxic nor near copies and keep their rows: they are packed as one piece of the end mark
alone. Rows with a null id keep theirs, unless toxic: no line of theirs is compared. Repeated rows share each decision, so of
equal rows of one id all stay or go. Lines go by line number, near copies by id, so ties have one outcome. Very long texts
are handled whole. Empty tables give empty results. Extra columns of documents are carried up to packing; those named
as an operator's own (score, predicted) are replaced there and left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeweave.llm import line_dedup, near_dup, packing, pii, toxicity
from lakeweave.llm.encode import default_path
from lakeweave.llm.tables import cut, drop, parquet

#: For this corpus; users set a secret of their own.
KEY = "a published key: links values, hides nothing"
ORACLE_SQL = None


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the toxicity models reject. Learned from all labelled rows' sample."""
    model = toxicity.learn(docs.select("doc_id", "text"), parquet(spark, sf_dir, "labels"))
    if model is None:
        return docs
    return toxicity.score(docs, model).where("predicted = 0").select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without lines that an earlier document has; documents all of whose text that was go too."""
    out = line_dedup.dedup_lines(docs, drop_emptied=True, equal_chars=1)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8."""
    found = near_dup.near_duplicates(docs.select("doc_id", "text"), near_dup.Options())
    return near_dup.only_ids(docs, cut(found.where("not kept").select("doc_id").distinct()), "doc_id", "left_anti").select(*docs.columns)


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by keyed pseudonyms."""
    return pii.pseudonymise(docs, KEY).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and their places in sequences of 4096 tokens."""
    made = packing.pieces(docs.select("doc_id", "text"), default_path())
    return packing.pack(made).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [("toxicity", toxic), ("line_dedup", lines), ("near_dedup", near), ("pii", private), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written as Parquet to the shared folder and read again by the next; a stage's table goes once the next
    one is written."""
    docs = parquet(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        before, docs = docs, cut(stage(spark, docs, sf_dir))
        drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
