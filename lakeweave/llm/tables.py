"""Shared-folder tables: lineage is cut by writing Parquet where every executor can read it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. A temporary one serves only where that is unset and master is local, as in
    tests: on a cluster each machine has its own, and tables would be read back incomplete."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
    if "dir" not in _own:
        _own["dir"] = tempfile.mkdtemp(prefix="lakeweave-")
    return _own["dir"]


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def cut(df: DataFrame) -> DataFrame:
    """Write `df` once to the shared folder and read it back: later stages survive lost executors and don't recompute.

    The folder goes when the driver ends, or earlier by `drop`.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/lakeweave-{uuid.uuid4().hex}"
    df.write.parquet(path)
    fs, p = _fs(spark, path)
    fs.deleteOnExit(p)
    out = spark.read.schema(df.schema).parquet(path)
    out._lakeweave_path = path
    return out


def drop(*frames: DataFrame) -> None:
    """Remove tables written by `cut` that nothing will read again."""
    for df in frames:
        if path := getattr(df, "_lakeweave_path", None):
            fs, p = _fs(df.sparkSession, path)
            fs.delete(p, True)


def parquet(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def least_hashes(want: int, n: Column) -> Column:
    """A bound of a 64-bit hash that about 2 * want + 200 of n rows stay below (all, if there are fewer): the `want` rows with
    the least hashes are among them, and only those few have to be sorted."""
    share = F.least(F.lit(1.0), F.lit(2.0 * want + 200) / n)
    return F.when(share >= 1, F.lit((1 << 63) - 1)).otherwise(F.floor(F.lit(-(2.0**63)) + share * F.lit(2.0**64))).cast("long")
