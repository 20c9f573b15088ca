"""A folder for files that a query writes and reads again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_folder(spark: SparkSession) -> str:
    """A new folder under ``spark.checkpoint.dir``, which driver and executors share; on one machine, where that is unset, under /tmp."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        base = "/tmp/checkpoints"
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame, *by: str) -> DataFrame:
    """``df`` as Parquet in a scratch folder, in folders by the values of ``by``, read again: nothing is computed twice, whatever executors are lost."""
    path = scratch_folder(df.sparkSession)
    (df.write.partitionBy(*by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
