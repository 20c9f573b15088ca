"""Numbers for all rows of a table in an order, without ordering them in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def dense_number(df: DataFrame, order: str, name: str, chunk: int = 65536) -> DataFrame:
    """Add ``name``: the rank, from 0, of a distinct non-negative long ``order``.

    Values are cut into chunks of equal span; the counts of lower chunks shift the rank within a chunk. The window over
    chunks has a row for ``chunk`` values, the one within a chunk at most ``chunk`` rows.
    """
    df = df.withColumn("_chunk", F.expr(f"{order} div {chunk}"))
    counts = df.groupBy("_chunk").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("_chunk", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_chunk").orderBy(order)) - 1
    out = df.withColumn("_inside", inside).join(counts, "_chunk")
    return out.withColumn(name, (F.col("_before") + F.col("_inside")).cast("int")).drop("_chunk", "_before", "_inside")
