"""Histograms, ranges, order statistics, running sums and regressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from allometra.sources.scratch import written


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """bin and count; bin -1 holds what lies below, bin ``bins`` what lies above.

    The bin is (x - low) * bins / (high - low) truncated toward zero, so up to a bin's width below ``low`` is bin 0.
    """
    at = ((F.col(value) - low) * bins / (high - low)).cast("long")
    place = F.when(F.col(value).isNull(), None).when(at < 0, -1).when((F.col(value) - low) * bins / (high - low) <= -1, -1).when(at >= bins, bins).otherwise(at)
    return df.select(place.cast("int").alias("bin")).where("bin IS NOT NULL").groupBy("bin").agg(F.count(F.lit(1)).alias("count"))


def value_range(df: DataFrame, value: str) -> DataFrame:
    """low and high; 0 and 0 without values."""
    return df.agg(F.coalesce(F.min(value), F.lit(0)).alias("low"), F.coalesce(F.max(value), F.lit(0)).alias("high"))


def prefix_sum(df: DataFrame, key: list[str], order: str, value: str, inclusive: bool = True) -> DataFrame:
    """Add running_sum over the rows of each key; a key is one specimen, mesh or customer, never the whole table."""
    own = Window.partitionBy(*key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    return df.withColumn("running_sum", F.coalesce(F.sum(value).over(own), F.lit(0)))


def scan(df: DataFrame, order: list[str], value: str, inclusive: bool = True) -> DataFrame:
    """Add running_sum over all rows in an order, which should leave no ties.

    Rows are dealt to ranges of the order and written; each range has one sum, sums of the ranges before (as many as there
    are ranges) are joined back, and a window runs over one range at a time.
    """
    ranges = written(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    sums = ranges.groupBy("_range").agg(F.sum(value).alias("_sum")).orderBy("_range").collect()
    before, total = [], None
    for r in sums:
        before.append((r["_range"], total))
        if r["_sum"] is not None:
            total = r["_sum"] if total is None else total + r["_sum"]
    kind = ranges.select(F.sum(value)).schema[0].dataType.simpleString()
    offsets = df.sparkSession.createDataFrame(before, f"_range int, _before {kind}")
    own = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    out = ranges.withColumn("_own", F.coalesce(F.sum(value).over(own), F.lit(0))).join(F.broadcast(offsets), "_range")
    return out.withColumn("running_sum", F.coalesce("_before", F.lit(0)) + F.col("_own")).drop("_range", "_own", "_before")


def quartile_fence(df: DataFrame, key: list[str], value: str, tie: list[str], factor: float = 1.5) -> DataFrame:
    """Add q1, q3 and rejected (value > q3 + factor * (q3 - q1)) by key.

    Quartiles are the order statistics number n div 4 and 3n div 4, from 0. A key is one specimen.
    """
    own = Window.partitionBy(*key)
    df = df.withColumns({"_rn": F.row_number().over(own.orderBy(value, *tie)), "_n": F.count(F.lit(1)).over(own)})
    at = lambda n: F.max(F.when(F.col("_rn") == F.expr(n) + 1, F.col(value))).over(own)
    df = df.withColumns({"q1": at("_n div 4"), "q3": at("(3 * _n) div 4")})
    return df.withColumn("rejected", F.col(value) > F.col("q3") + factor * (F.col("q3") - F.col("q1"))).drop("_rn", "_n")


def regression(df: DataFrame, key: list[str], x: Column, y: Column, compat: bool = False) -> DataFrame:
    """slope, intercept and n of ordinary least squares by key, in one aggregation.

    ``compat`` divides the slope by n, as a known variant does. Slope null where x does not vary.
    """
    out = df.groupBy(*key).agg(F.regr_slope(y, x).alias("slope"), F.avg(x).alias("_mx"), F.avg(y).alias("_my"), F.count(F.lit(1)).alias("n"))
    if compat:
        out = out.withColumn("slope", F.col("slope") / F.col("n"))
    return out.select(*key, "slope", (F.col("_my") - F.col("slope") * F.col("_mx")).alias("intercept"), "n")
