"""Queries that run streams over whole tables, to their end, in batches that mix early and late changes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from ..functions.embedding import hash_vectors
from ..sources.scratch import folder
from ..streaming import stateful as ST
from .registry import plan, table

#: Files that the changes are dealt to by hash, each a batch.
FILES = 3

_VERSIONS = """WITH c AS (SELECT user_id AS entity, epoch_us(ts::TIMESTAMP) // 1000 AS at_ms, event_id AS seq, event_type AS value, event_id % 10 = 0 AS gone FROM events),
n AS (SELECT *, lead(at_ms) OVER (PARTITION BY entity ORDER BY at_ms, seq) AS valid_to FROM c)
SELECT entity, row_number() OVER (PARTITION BY entity ORDER BY at_ms, seq)::INT AS version, value, at_ms AS valid_from, valid_to FROM n WHERE NOT gone"""


@plan(_VERSIONS)
def str2_stateful(spark, d):
    """Versions of users from shuffled events, every tenth a deletion; each batch is given twice, the second run restarts."""
    path = folder(spark)
    c = table(spark, d, "events").select(F.col("user_id").alias("entity"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at"), F.col("event_id").alias("seq"), F.col("event_type").alias("value"), (F.col("event_id") % 10 == 0).alias("gone"))
    for part in range(FILES):
        c.where(F.pmod(F.xxhash64("seq"), F.lit(FILES)) == part).coalesce(1).write.mode("append").parquet(f"{path}/source")
        if part:
            stream = spark.readStream.schema(c.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/source")
            ST.follow_changes(stream, f"{path}/log", f"{path}/checkpoint", horizon=1 << 60).awaitTermination()
    return ST.versions_of(spark, f"{path}/log")[0]


#: The vector of a text as SQL: sines seeded by the first bytes of its MD5.
_SEED = "('0x' || substr(md5({t}), 7, 2) || substr(md5({t}), 5, 2) || substr(md5({t}), 3, 2) || substr(md5({t}), 1, 2))::BIGINT"
_SINES = f"list_transform(range(1, 65), lambda i: sin({_SEED} * 0.001::DOUBLE + i * 12.9898::DOUBLE))"


def vector_sql(text: str) -> str:
    return f"list_transform({_SINES.format(t=text)}, lambda x: x / sqrt(list_sum(list_transform({_SINES.format(t=text)}, lambda y: y * y))))"


def _picky(texts: pd.Series) -> list[list[float]]:
    """An embedding function of a user's own, which fails on some texts."""
    if texts.str.endswith("7").any():
        raise ValueError("no text that ends in 7")
    return hash_vectors(texts)


_TEXTS = "t AS (SELECT c_custkey AS entity, c_mktsegment || ' ' || c_custkey % 100 AS text FROM customer), u AS (SELECT DISTINCT user_id AS entity FROM events), j AS (SELECT * FROM u JOIN t USING (entity))"


def _embedded(spark, d):
    path = folder(spark)
    texts = table(spark, d, "customer").select(F.col("c_custkey").alias("entity"), F.concat_ws(" ", "c_mktsegment", (F.col("c_custkey") % 100).cast("string")).alias("text"))
    keys = table(spark, d, "events").select(F.col("user_id").alias("entity")).distinct().join(texts.select("entity"), "entity", "left_semi")
    keys.coalesce(1).write.parquet(f"{path}/source")
    for _ in range(2):  # keys that no one asks about, so that what failed is tried again
        keys.select((-F.col("entity") - 1).alias("entity")).limit(1).write.mode("append").parquet(f"{path}/source")
        stream = spark.readStream.schema("entity long").option("maxFilesPerTrigger", 1).parquet(f"{path}/source")
        ST.embed_changes(stream, texts, path, f"{path}/checkpoint", _picky, lambda n: 1_000 + n).awaitTermination()
    return ST.embedded(spark, path)


@plan(f"WITH {_TEXTS}, v AS (SELECT entity, {vector_sql('text')} AS e FROM j WHERE NOT ends_with(text, '7')) SELECT entity, round(e[1], 3) + 0.0 AS v1, round(e[2], 3) + 0.0 AS v2, round(e[64], 3) + 0.0 AS v64 FROM v")
def str3_vectors(spark, d):
    """Vectors of the changed users' texts; those that the function fails on have none."""
    e = lambda i: F.round(F.get("embedding", F.lit(i)).cast("double"), 3) + 0.0
    return _embedded(spark, d)[0].select("entity", e(0).alias("v1"), e(1).alias("v2"), e(63).alias("v64"))


@plan(f"WITH {_TEXTS} SELECT entity, CASE WHEN ends_with(text, '7') THEN 'failed' ELSE 'completed' END AS status, CASE WHEN ends_with(text, '7') THEN 3 ELSE 1 END AS attempts FROM j")
def str3_attempts(spark, d):
    """The work table after three batches: a text that fails is tried three times."""
    return _embedded(spark, d)[1].where("entity >= 0").select("entity", "status", "attempts")
