"""A project: tables as Parquet beside a manifest of entries, links between tables, and generated meshes."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from allometra.operators.table import merge

ENTRY = "id long, name string, kind string, deps array<long>, payload string"


def save_project(spark: SparkSession, path: str, tables: dict[str, DataFrame], entries: list[dict]) -> None:
    """A new version of the project: every table as Parquet, then the manifest, one row for each entry (id, name, kind, deps, table, and what it was made with).

    Tables go to a folder of their own; the version counts from the moment its manifest is renamed into place, which is one
    step of the file system. A save that fails before leaves the project as it was, and so does one of two at the same time.
    Columns' roles and levels are kept with the tables.
    """
    version, folder = (latest(spark, path) or 0) + 1, f"tables/{uuid.uuid4().hex}"
    for name, df in tables.items():
        df.write.parquet(f"{path}/{folder}/{name}.parquet")
    rows = []
    for e in entries:
        made_with = {k: v for k, v in e.items() if k not in ("id", "name", "kind", "deps")} | {"folder": folder}
        rows.append((e["id"], e["name"], e["kind"], e.get("deps", []), json.dumps(made_with, sort_keys=True)))
    waiting = f"{path}/{folder}/manifest"
    spark.createDataFrame(rows, ENTRY).coalesce(1).write.json(waiting)
    files, at = _file_system(spark, path)
    files.mkdirs(at(f"{path}/manifests"))
    if not files.rename(at(waiting), at(f"{path}/manifests/{version}")) or files.exists(at(f"{path}/manifests/{version}/manifest")):
        raise OSError(f"version {version} of the project exists already")


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path
    return at(path).getFileSystem(spark._jsc.hadoopConfiguration()), at


def latest(spark: SparkSession, path: str) -> int | None:
    """The newest version of a project, None if there is none."""
    files, at = _file_system(spark, path)
    folder = at(f"{path}/manifests")
    names = [s.getPath().getName() for s in files.listStatus(folder)] if files.exists(folder) else []
    return max((int(n) for n in names if n.isdecimal()), default=None)


def entries(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """The entries of the project's newest manifest, of one kind if asked for."""
    version = latest(spark, path)
    if version is None:
        raise ValueError(f"no project at {path}")
    found = spark.read.schema(ENTRY).json(f"{path}/manifests/{version}")
    return found if kind is None else found.where(F.col("kind") == kind)


def _table(spark: SparkSession, path: str, payload: str) -> DataFrame:
    facts = json.loads(payload)
    return spark.read.parquet(f"{path}/{facts['folder']}/{facts['table']}.parquet")


def entry_table(spark: SparkSession, path: str, entry_id: int) -> DataFrame:
    row = entries(spark, path).where(F.col("id") == entry_id).first()
    if row is None:
        raise ValueError(f"no entry {entry_id}")
    return _table(spark, path, row.payload)


def full_table(spark: SparkSession, path: str, entry_id: int) -> DataFrame:
    """The table of a result merged, by row_index, with that of the entry it depends on first."""
    row = entries(spark, path).where(F.col("id") == entry_id).first()
    own = entry_table(spark, path, entry_id)
    return merge(own, entry_table(spark, path, row.deps[0])) if row and row.deps else own


def summary(spark: SparkSession, path: str, entry_id: int) -> DataFrame:
    """A report on an entry: place, section, key and value, from its manifest row and its table.

    Sections: entry (id, name, kind, what it depends on), settings (all it was made with, nested ones by dotted names), table
    (rows and columns), and, where the table has a column ``status``, how many rows ended in each.
    """
    row = entries(spark, path).where(F.col("id") == entry_id).first()
    if row is None:
        raise ValueError(f"no entry {entry_id}")
    facts, table = json.loads(row.payload), _table(spark, path, row.payload)
    said = [("entry", "id", row.id), ("entry", "name", row.name), ("entry", "kind", row.kind), ("entry", "depends on", ", ".join(f"#{d}" for d in row.deps))]

    def settings(value: object, name: str) -> None:
        if isinstance(value, dict) and value:
            for k in sorted(value):
                settings(value[k], f"{name}.{k}" if name else k)
        else:
            said.append(("settings", name, "none" if value is None else str(value)))

    settings({k: v for k, v in facts.items() if k not in ("folder", "table")}, "")
    said += [("table", "rows", table.count()), ("table", "columns", ", ".join(table.columns))]
    if "status" in table.columns:
        said += [("status", str(r.status), r["n"]) for r in table.groupBy("status").agg(F.count(F.lit(1)).alias("n")).orderBy("status").collect()]
    return spark.createDataFrame([(k, s, n, str(v)) for k, (s, n, v) in enumerate(said)], "place int, section string, key string, value string")


def columns_of(spark: SparkSession, path: str) -> DataFrame:
    """entry_id, entry, column and type of every column of every table of the project."""
    rows = [(r.id, r.name, f.name, f.dataType.simpleString()) for r in entries(spark, path).collect() for f in _table(spark, path, r.payload).schema]
    return spark.createDataFrame(rows, "entry_id long, entry string, column string, type string")


def dereference(df: DataFrame, link: str, refs: DataFrame, *take: str) -> DataFrame:
    """``df`` with the columns ``take`` of the row of ``refs`` (ref_id, ...) that its link names; null where there is none."""
    return df.join(refs.select(F.col("ref_id").alias(link), *take), link, "left")


def reference_statistics(refs: DataFrame) -> DataFrame:
    """How many references there are, and how many lie outside of the project."""
    return refs.agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("internal")).alias("n_external"))


# The two triangles of each side of a cube with corners numbered by their signs, and those of an icosahedron.
_CUBE = [(0, 1, 3), (0, 3, 2), (4, 6, 7), (4, 7, 5), (0, 4, 5), (0, 5, 1), (2, 3, 7), (2, 7, 6), (0, 2, 6), (0, 6, 4), (1, 5, 7), (1, 7, 3)]


def cube(spark: SparkSession, side: float = 2.0) -> tuple[DataFrame, DataFrame]:
    """vertices (cloud_id 0) and faces of a cube around the origin."""
    half = [-side / 2, side / 2]
    corners = [(0, i, half[i >> 2], half[i >> 1 & 1], half[i & 1]) for i in range(8)]
    return (
        spark.createDataFrame(corners, "cloud_id long, vertex_id int, x double, y double, z double"),
        spark.createDataFrame([(k, *f) for k, f in enumerate(_CUBE)], "face_id int, i0 int, i1 int, i2 int"),
    )


def double_point(spark: SparkSession, offset: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """vertices (cloud_id 0) of two points on either side of the origin, and no faces."""
    rows = [(0, 0, -offset, 0.0, 0.0), (0, 1, offset, 0.0, 0.0)]
    return spark.createDataFrame(rows, "cloud_id long, vertex_id int, x double, y double, z double"), spark.createDataFrame([], "face_id int, i0 int, i1 int, i2 int")


def icosahedron(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """vertices (cloud_id 0) and faces of an icosahedron of edge 2: three golden rectangles, and the triples of corners at that distance."""
    golden = (1 + 5**0.5) / 2
    points = [p[-k:] + p[:-k] for k in range(3) for a in (-1.0, 1.0) for b in (-golden, golden) for p in [(0.0, a, b)]]
    near = lambda p, q: abs(sum((u - v) ** 2 for u, v in zip(p, q, strict=True)) - 4) < 1e-9
    faces = []
    for i in range(12):
        for j in range(i + 1, 12):
            for k in range(j + 1, 12):
                if near(points[i], points[j]) and near(points[j], points[k]) and near(points[i], points[k]):
                    (ax, ay, az), (bx, by, bz), (cx, cy, cz) = points[i], points[j], points[k]
                    outward = ax * (by * cz - bz * cy) + ay * (bz * cx - bx * cz) + az * (bx * cy - by * cx) > 0
                    faces.append((i, j, k) if outward else (i, k, j))
    return (
        spark.createDataFrame([(0, i, *p) for i, p in enumerate(points)], "cloud_id long, vertex_id int, x double, y double, z double"),
        spark.createDataFrame([(n, *f) for n, f in enumerate(faces)], "face_id int, i0 int, i1 int, i2 int"),
    )
