"""Small helpers that the training-data operators share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than these (ASCII white space).
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def packed(df: DataFrame) -> Column:
    """All columns of ``df`` as the struct ``_row``, in which no name can clash with an operator's own columns."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row")


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body``: the lambda variable stands for the result."""
    return F.transform(F.array(value), body)[0]


def word_array(text: Column) -> Column:
    return F.filter(F.split(text, SPACE_CLASS + "+"), lambda w: w != "")


_to_delete: set[str] = set()


def shared_folder(spark: SparkSession) -> str:
    """A folder of this application's own in the one that driver and executors share, deleted when the driver ends.

    The shared one is ``spark.checkpoint.dir``. Where that is unset, a session on one machine, as in tests, has a folder
    of its own; on a cluster this is an error, as each machine would write to its own disk.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        base = "/tmp/checkpoints"
    folder = f"{base.rstrip('/')}/{spark.sparkContext.applicationId}"
    if folder not in _to_delete:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
        _to_delete.add(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
