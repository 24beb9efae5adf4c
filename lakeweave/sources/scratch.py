"""Tables in the shared folder that the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. A temporary one serves only where that is unset and master is local, as in
    tests: on a cluster each machine has its own, and tables would be read back incomplete."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
    return tempfile.gettempdir()


def folder(spark: SparkSession) -> str:
    """A new folder in the shared one; it goes when the driver ends."""
    path = f"{shared_dir(spark).rstrip('/')}/lakeweave-graph-{uuid.uuid4().hex}"
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(p)
    fs.deleteOnExit(p)
    return path


#: Shuffle files of a written table go at once: rounds would fill the disks with them, since Spark keeps them until the driver's garbage is collected.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame) -> DataFrame:
    """Write `df` to the shared folder and read it back; it goes when the driver ends."""
    spark = df.sparkSession
    path, before = folder(spark), spark.conf.get(CLEAN, "false")
    spark.conf.set(CLEAN, "true")
    try:
        df.write.mode("overwrite").parquet(path)
    finally:
        spark.conf.set(CLEAN, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._lakeweave_path = path
    return out


#: Rows that one task groups, so that its memory doesn't grow with the table.
TASK_ROWS = 250_000


def spread(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """`df` of about `rows` rows dealt by `keys` over as many tasks as it needs at TASK_ROWS each. Tasks that adaptive execution makes are of
    64 MB of compressed rows, and names and keys compress far below the memory that groups of them take. Not for keys with hubs."""
    return df.repartition(rows // TASK_ROWS + 1, *keys)


def drop(*frames: DataFrame) -> None:
    """Remove tables written by `cut` that nothing will read again."""
    for df in frames:
        if path := getattr(df, "_lakeweave_path", None):
            p = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)
