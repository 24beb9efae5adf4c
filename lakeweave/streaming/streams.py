"""Structured Streaming variants of ingestion and history."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import temporal as T


def ingest_once(stream: DataFrame, target: str, checkpoint: str, content: str, at: str, watermark: str = "1 day") -> StreamingQuery:
    """Append records of a stream once each, by the hash of their content: repeats within the watermark are dropped in the
    stream's state, older ones by an anti join with what the target holds."""
    hashed = stream.withColumn("hash", F.sha2(F.col(content).cast("string"), 256)).withWatermark(at, watermark).dropDuplicatesWithinWatermark(["hash"])

    def write(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        try:
            seen = spark.read.parquet(target).select("hash").distinct()
            batch = batch.join(seen, "hash", "left_anti")
        except Exception as x:  # the first batch finds no target
            if "PATH_NOT_FOUND" not in str(x) and "UNABLE_TO_INFER_SCHEMA" not in str(x):
                raise
        batch.write.mode("append").parquet(target)

    return hashed.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_changes(stream: DataFrame, log: str, checkpoint: str) -> StreamingQuery:
    """Append a stream of changes to a log, each batch in a folder of its own that a repeated batch overwrites: exactly once,
    and no batch rewrites what earlier ones wrote. `history_of` reads versions from the whole log, so late changes fall into
    place."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{log}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def history_of(log: DataFrame, key: str, at: str, order: list[str], value: str) -> DataFrame:
    """The versioned table of a log of changes; a change that is there twice counts once."""
    return T.history(log.dropDuplicates([key, *order]), key, at, order, value)


def refresh_work(work: DataFrame, changed: DataFrame, now: int, attempts: int = 3, retention_ms: int = 7 * 86_400_000) -> DataFrame:
    """The work table (entity, status, attempts, finished_at) after a batch of changed entities: they are pending anew;
    failures are retried up to `attempts`; finished work goes after the retention."""
    c = changed.select("entity").distinct().withColumn("_new", F.lit(True))
    j = work.join(c, "entity", "full")
    status = F.when(F.col("_new"), "pending").when((F.col("status") == "error") & (F.col("attempts") < attempts), "pending").when(F.col("status") == "error", "failed").otherwise(F.col("status"))
    out = j.select("entity", status.alias("status"), F.when(F.col("_new"), 0).otherwise(F.coalesce("attempts", F.lit(0))).alias("attempts"), F.when(~F.coalesce("_new", F.lit(False)), F.col("finished_at")).alias("finished_at"))
    return out.where(~(F.col("status").isin("completed", "failed") & (F.col("finished_at") < now - retention_ms)))


def rolling_counts(events: DataFrame, at: str, kind: str, length: str = "1 day", watermark: str = "1 day") -> DataFrame:
    """start, kind, n of event-time windows; the same for a stream and for a table."""
    base = events.withWatermark(at, watermark) if events.isStreaming else events
    return base.groupBy(F.window(at, length), kind).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), kind, "n")


def sessions(events: DataFrame, at: str, key: str, gap: str = "30 minutes", watermark: str = "1 day") -> DataFrame:
    """key, start, n of sessions without a gap of that length."""
    base = events.withWatermark(at, watermark) if events.isStreaming else events
    return base.groupBy(F.session_window(at, gap), key).agg(F.count("*").alias("n")).select(key, F.col("session_window.start").alias("start"), "n")
