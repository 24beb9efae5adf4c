"""Streams with state: histories of entities whose changes come in any order, and embeddings kept up with changed entities.

Both write a folder a batch, which a repeated batch overwrites, so a restart from the checkpoint repeats nothing and loses
nothing; readers take the newest row of a key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery
from pyspark.sql.types import ArrayType, FloatType

VERSION = "entity long, version int, value string, valid_from long, valid_to long, late boolean"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Versions(StatefulProcessor):
    """The versions of one entity. State: the changes of the last `horizon` (by their own times), by time and number, and the
    last one before them with its version's number. A change that comes late takes its place among those, and the versions from
    there on are given out again; a deletion closes the version before it and is none itself. A change before the horizon
    can't be placed any more: it is given out as late, not dropped. With `idle`, an entity that has
    been still for so many milliseconds keeps its last change alone."""

    def __init__(self, horizon: int, idle: int | None):
        self.horizon, self.idle = horizon, idle

    def init(self, handle) -> None:
        self.handle = handle
        self.before = handle.getValueState("before", "at long, seq long, value string, gone boolean, version int, since long")
        self.recent = handle.getMapState("recent", "at long, seq long", "value string, gone boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        entity = int(key[0])
        first = self.before.get() if self.before.exists() else None
        held = {(int(k[0]), int(k[1])): (v[0], bool(v[1])) for k, v in self.recent.iterator()}
        out, earliest = [], None
        for part in rows:
            for at, seq, value, gone in zip(part["at"], part["seq"], part["value"], part["gone"], strict=True):
                place = (int(at), int(seq))
                if first is not None and place <= (first[0], first[1]):
                    if place != (first[0], first[1]):
                        out.append((entity, None, value, place[0], None, True))
                    continue
                if place not in held:
                    held[place] = (value, bool(gone))
                    self.recent.updateValue(place, (value, bool(gone)))
                    earliest = place if earliest is None else min(earliest, place)
        order = sorted(held)
        if earliest is not None:
            out += self._versions(entity, first, order, held, earliest)
            self._fold(first, order, held, order[-1][0] - self.horizon)
            if self.idle is not None:
                for t in list(self.handle.listTimers()):
                    self.handle.deleteTimer(t)
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle)
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in VERSION.split(", ")]).astype({"version": "Int32", "valid_from": "Int64", "valid_to": "Int64"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = {(int(k[0]), int(k[1])): (v[0], bool(v[1])) for k, v in self.recent.iterator()}
        self._fold(self.before.get() if self.before.exists() else None, sorted(held), held, float("inf"))
        yield pd.DataFrame()

    @staticmethod
    def _versions(entity: int, first, order: list, held: dict, earliest: tuple) -> Iterator[tuple]:
        """Versions from the one before the earliest new change on."""
        steps = [((first[0], first[1]), first[2], first[3], first[4])] if first is not None else []
        version = first[4] if first is not None else 0
        for place in order:
            value, gone = held[place]
            version += not gone
            steps.append((place, value, gone, version))
        for i, (place, value, gone, number) in enumerate(steps):
            after = steps[i + 1][0] if i + 1 < len(steps) else None
            if not gone and (after is None or after >= earliest):
                yield entity, number, value, place[0], after[0] if after else None, False

    def _fold(self, first, order: list, held: dict, until: float) -> None:
        """Take out of the state the changes before `until` but the last change."""
        gone = [p for p in order[:-1] if p[0] < until]
        if not gone:
            return
        version = first[4] if first is not None else 0
        for p in gone:
            version += not held[p][1]
            self.recent.removeKey(p)
        last = gone[-1]
        self.before.update((last[0], last[1], held[last][0], held[last][1], version, last[0]))

    def close(self) -> None:
        pass


def follow_changes(stream: DataFrame, log: str, checkpoint: str, horizon: int = 30 * 86_400_000, idle: int | None = None) -> StreamingQuery:
    """Turn a stream of changes (entity long, at and seq long, value string, gone boolean), in any order and with repeats, into versions
    appended to `log`; `versions_of` reads them. Without `idle` the query ends once it has read what there is; with it, it goes on
    until it is stopped, since its timers make batches of their own."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _ROCKS)
    source = stream.select("entity", "at", "seq", "value", F.coalesce("gone", F.lit(False)).alias("gone")).where("entity is not null and at is not null and seq is not null")
    made = source.groupBy("entity").transformWithStateInPandas(Versions(horizon, idle), VERSION, "Append", "None" if idle is None else "ProcessingTime")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{log}/batch={number}")

    out = made.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if idle is None else out.trigger(processingTime="5 seconds")).start()


def versions_of(spark: SparkSession, log: str) -> tuple[DataFrame, DataFrame]:
    """(entity, version, value, valid_from, valid_to; changes that came too late to be placed: entity, value, valid_from)."""
    rows = spark.read.schema(f"{VERSION}, batch long").parquet(log)
    newest = F.row_number().over(W.partitionBy("entity", "version").orderBy(F.desc("batch")))
    versions = rows.where("not late").withColumn("_r", newest).where("_r = 1").drop("_r", "late", "batch")
    return versions, rows.where("late").select("entity", "value", "valid_from")


WORK = "entity long, status string, attempts int, finished_at long"
#: Attempts before an entity is given up, and milliseconds that finished work is kept.
ATTEMPTS, RETENTION = 3, 7 * 86_400_000


def guarded(fn: Callable[[pd.Series], list]):
    """A column function of texts that gives null where `fn` fails: it is tried on a whole batch, then text by text."""

    @F.pandas_udf(ArrayType(FloatType()))
    def run(texts: pd.Series) -> pd.Series:
        def one(text: str):
            try:
                return fn(pd.Series([text]))[0]
            except Exception:  # the caller's function may fail in any way; the work table counts it
                return None

        try:
            return pd.Series(list(fn(texts)))
        except Exception:
            return texts.map(one)

    return run


def _last(spark: SparkSession, path: str, schema: str, number: int) -> DataFrame:
    """The table as the newest batch before `number` left it."""
    empty = spark.createDataFrame([], schema)
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return empty
    there = [int(s.getPath().getName().split("=")[1]) for s in fs.listStatus(p) if s.getPath().getName().startswith("batch=")]
    there = [n for n in there if n < number]
    return spark.read.schema(schema).parquet(f"{path}/batch={max(there)}") if there else empty


def embed_batch(changed: DataFrame, texts: DataFrame, path: str, number: int, fn: Callable[[pd.Series], list], now: int) -> None:
    """One step: entities of `changed` (entity) become pending anew; all pending ones and those that failed before are embedded, each
    distinct text of `texts` (entity, text) once; vectors go to path/vectors, the work table to path/work, by batch."""
    spark = changed.sparkSession
    work = _last(spark, f"{path}/work", WORK, number)
    new = changed.select(F.col("entity").cast("long").alias("entity")).where("entity is not null").distinct().withColumn("new", F.lit(True))
    j = work.join(new, "entity", "full").withColumn("due", F.coalesce("new", F.lit(False)) | (F.col("status") == "error"))
    due = j.where("due").select("entity").join(texts.select("entity", "text").dropDuplicates(["entity"]), "entity")
    vectors = due.select("text").distinct().withColumn("embedding", guarded(fn)("text"))
    due.join(vectors, "text").where("embedding is not null").select("entity", "embedding").write.mode("overwrite").parquet(f"{path}/vectors/batch={number}")
    done = spark.read.schema("entity long, embedding array<float>").parquet(f"{path}/vectors/batch={number}").select("entity").distinct().withColumn("done", F.lit(True))
    j = j.join(done, "entity", "left")
    tries = F.when(F.col("new"), 0).otherwise(F.coalesce("attempts", F.lit(0))) + F.when(F.col("due"), 1).otherwise(0)
    failed: Column = F.when(tries >= ATTEMPTS, "failed").otherwise("error")
    status = F.when(~F.col("due"), F.col("status")).when(F.col("done"), "completed").otherwise(failed)
    out = j.select("entity", status.alias("status"), tries.cast("int").alias("attempts"), F.when(F.col("due"), now).otherwise(F.col("finished_at")).cast("long").alias("finished_at"))
    old = F.col("status").isin("completed", "failed") & (F.col("finished_at") < now - RETENTION)
    out.where(~old).write.mode("overwrite").parquet(f"{path}/work/batch={number}")


def embed_changes(stream: DataFrame, texts: DataFrame, path: str, checkpoint: str, fn: Callable[[pd.Series], list], clock: Callable[[int], int]) -> StreamingQuery:
    """Keep path/vectors up with a stream of changed keys (entity). clock(batch) gives a batch's time in milliseconds."""

    def step(batch: DataFrame, number: int) -> None:
        embed_batch(batch, texts, path, number, fn, clock(number))

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def embedded(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(entity, embedding, batch: the newest of each entity; the work table)."""
    rows = spark.read.schema("entity long, embedding array<float>, batch long").parquet(f"{path}/vectors")
    newest = F.row_number().over(W.partitionBy("entity").orderBy(F.desc("batch")))
    return rows.withColumn("_r", newest).where("_r = 1").drop("_r"), _last(spark, f"{path}/work", WORK, 1 << 62)
