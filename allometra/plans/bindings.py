"""The morphometric reading of the given tables: embeddings as landmarks and as sheet meshes, others as specimen tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LANDMARKS = 21
SIDE = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def landmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cloud_id, label, vertex_id (0 to 20), x, y, z: vertex i is the i-th triple of an embedding."""
    e = F.col("embedding")
    points = F.transform(F.sequence(F.lit(0), F.lit(LANDMARKS - 1)), lambda i: F.struct(i.alias("vertex_id"), *[F.get(e, i * 3 + k).cast("double").alias(c) for k, c in enumerate("xyz")]))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("cloud_id"), "label", F.inline(points))


def landmark_clouds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, packed: cloud_id, label, pos."""
    pos = F.slice(F.col("embedding").cast("array<double>"), 1, 3 * LANDMARKS)
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("cloud_id"), "label", pos.alias("pos"))


def sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cloud_id, label, vertex_id (0 to 63), x, y, z: a height field over 8 by 8 places."""
    e = F.col("embedding")
    points = F.transform(
        F.sequence(F.lit(0), F.lit(SIDE * SIDE - 1)),
        lambda k: F.struct(k.alias("vertex_id"), (k % SIDE).cast("double").alias("x"), F.floor(k / SIDE).cast("double").alias("y"), F.get(e, k).cast("double").alias("z")),
    )
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("cloud_id"), "label", F.inline(points))


def sheet_clouds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sheets, packed: cloud_id, label, pos."""
    e = F.col("embedding")
    points = F.transform(F.sequence(F.lit(0), F.lit(SIDE * SIDE - 1)), lambda k: F.array((k % SIDE).cast("double"), F.floor(k / SIDE).cast("double"), F.get(e, k).cast("double")))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("cloud_id"), "label", F.flatten(points).alias("pos"))


def sheet_faces(spark: SparkSession) -> DataFrame:
    """The 98 triangles that all sheets share."""
    q = spark.range(49).select(F.col("id").cast("int").alias("q"), F.expr("cast((id div 7) * 8 + id % 7 as int)").alias("p"))
    two = F.array(
        F.struct((F.col("q") * 2).alias("face_id"), F.col("p").alias("i0"), (F.col("p") + 1).alias("i1"), (F.col("p") + 8).alias("i2")),
        F.struct((F.col("q") * 2 + 1).alias("face_id"), (F.col("p") + 1).alias("i0"), (F.col("p") + 9).alias("i1"), (F.col("p") + 8).alias("i2")),
    )
    return q.select(F.inline(two))


# SQL with the same rows.
LANDMARKS_SQL = """lm AS (
    SELECT vec_id AS cloud_id, label, i AS vertex_id, embedding[3 * i + 1]::DOUBLE AS x, embedding[3 * i + 2]::DOUBLE AS y,
        embedding[3 * i + 3]::DOUBLE AS z
    FROM embeddings, range(0, 21) AS r(i))"""
SHEETS_SQL = """sh AS (
    SELECT vec_id AS cloud_id, label, k AS vertex_id, (k % 8)::DOUBLE AS x, (k // 8)::DOUBLE AS y, embedding[k + 1]::DOUBLE AS z
    FROM embeddings, range(0, 64) AS r(k))"""
FACES_SQL = """faces AS (
    SELECT 2 * q AS face_id, p AS i0, p + 1 AS i1, p + 8 AS i2 FROM (SELECT q, q // 7 * 8 + q % 7 AS p FROM range(0, 49) AS r(q))
    UNION ALL SELECT 2 * q + 1, p + 1, p + 9, p + 8 FROM (SELECT q, q // 7 * 8 + q % 7 AS p FROM range(0, 49) AS r(q)))"""


def areas_sql(x: str = "{} % 8", y: str = "{} // 8", z: str = "embedding[{} + 1]") -> str:
    """corners, crossed and areas of every sheet's faces; x, y, z are those of a vertex by its number."""
    at = {c: lambda i, c=c: f"({c.format(i)})::DOUBLE" for c in (x, y, z)}
    step = lambda c, i, name: f"{at[c](i)} - {at[c]('i0')} AS {name}"
    steps = ", ".join(step(c, i, f"{v}{n}") for i, v in (("i1", "u"), ("i2", "v")) for c, n in zip((x, y, z), "xyz", strict=True))
    return f"""corners AS (SELECT vec_id AS cloud_id, f.*, {steps} FROM embeddings, faces AS f
), crossed AS (
    SELECT *, uy * vz - uz * vy AS cx, uz * vx - ux * vz AS cy, ux * vy - uy * vx AS cz FROM corners
), areas AS (SELECT *, 0.5 * sqrt(cx * cx + cy * cy + cz * cz) AS area FROM crossed)"""


AREAS_SQL = areas_sql()
