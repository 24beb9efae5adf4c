"""The next row in an order over a whole table, without a window over one partition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Coarse cells of the order's range, and rows wanted in a fine one.
COARSE, FINE_ROWS, MOST_FINE = 256, 2000, 1 << 12


def range_bucket(df: DataFrame, key: str) -> Column:
    """A bucket number that never falls as the integer `key` rises; null keys come first, in bucket -1.

    256 quantiles give coarse cells, each cut into equal widths, so uneven keys still spread."""
    at = [i / COARSE for i in range(COARSE + 1)]
    n, cuts = df.agg(F.count(key), F.percentile_approx(key, at, 2000)).first()
    if not n:
        return F.lit(-1).cast("long")
    cuts = sorted(set(cuts))
    lo, hi = df.agg(F.min(key), F.max(key)).first()
    cuts = [lo, *[c for c in cuts if lo < c <= hi], hi + 1]
    fine = max(1, min(MOST_FINE, -(-n // (FINE_ROWS * (len(cuts) - 1)))))
    edges = F.split(F.lit(",".join(map(str, cuts))), ",").cast("array<double>")
    x = F.col(key).cast("double")
    cell = F.least(F.greatest(F.size(F.filter(edges, lambda e: e <= x)), F.lit(1)), F.lit(len(cuts) - 1))
    a, b = F.element_at(edges, cell), F.element_at(edges, cell + 1)
    part = F.least(F.floor((x - a) / (b - a) * fine), F.lit(fine - 1))
    return F.coalesce((cell - 1).cast("long") * fine + part, F.lit(-1).cast("long"))


def with_next(df: DataFrame, key: str, payload: list[str], tie: str, derive=lambda rows: rows) -> DataFrame:
    """Add next_<column> for each of `payload`: its value in the following row by (key, tie), the last row taking the first's.

    One shuffle of the table, by range bucket; only the first row of each bucket is looked up from elsewhere. `derive` adds
    columns to rows before the shuffle. The table of buckets is broadcast: it has at most COARSE * MOST_FINE rows."""
    b = df.withColumn("_lw_bucket", range_bucket(df, key))
    first = b.groupBy("_lw_bucket").agg(F.min(key).alias("_lw_first")).withColumn("_lw_before", F.lag("_lw_bucket").over(W.orderBy("_lw_bucket")))
    first = first.withColumn("_lw_before", F.coalesce("_lw_before", F.max("_lw_bucket").over(W.partitionBy())))
    first = first.withColumnRenamed("_lw_bucket", "_lw_of")
    heads = derive(b.join(F.broadcast(first), (F.col("_lw_bucket") == F.col("_lw_of")) & F.col(key).eqNullSafe(F.col("_lw_first"))))
    heads = heads.select(F.col("_lw_before").alias("_lw_bucket"), F.struct(tie, *[c for c in payload if c != tie]).alias("_lw_head"))
    heads = heads.groupBy("_lw_bucket").agg(F.min("_lw_head").alias("_lw_head"))
    order = W.partitionBy("_lw_bucket").orderBy(key, tie)
    led = derive(b).withColumns({f"next_{c}": F.lead(c).over(order) for c in payload} | {"_lw_inside": F.lead(F.lit(True)).over(order)})
    led = led.join(heads, "_lw_bucket", "left")
    return led.withColumns({f"next_{c}": F.when(F.col("_lw_inside"), F.col(f"next_{c}")).otherwise(F.col("_lw_head")[c]) for c in payload}).drop("_lw_bucket", "_lw_inside", "_lw_head")
