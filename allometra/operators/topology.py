"""Mesh topology on faces(face_id, i0, i1, i2) and vertices: edges, rings, boundary, fairing, normals, merging."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from allometra.functions import geometry as g

XYZ = ("x", "y", "z")


def corners(faces: DataFrame, *keep: str) -> DataFrame:
    """One row for each corner: face_id, corner (0 to 2), vertex_id."""
    return faces.select(*keep, "face_id", F.posexplode(F.array("i0", "i1", "i2")).alias("corner", "vertex_id"))


def vertex_faces(faces: DataFrame) -> DataFrame:
    """vertex_id with the sorted list of its faces and their number; a vertex has few faces."""
    return corners(faces).groupBy("vertex_id").agg(F.array_sort(F.collect_list("face_id")).alias("faces"), F.count(F.lit(1)).alias("valence"))


def valence(faces: DataFrame) -> DataFrame:
    return corners(faces).groupBy("vertex_id").agg(F.count(F.lit(1)).alias("valence"))


def one_ring(faces: DataFrame) -> DataFrame:
    """Directed edges, each once: vertex_id, neighbour."""
    ends = F.array(*[F.struct(F.col(a).alias("vertex_id"), F.col(b).alias("neighbour")) for a in ("i0", "i1", "i2") for b in ("i0", "i1", "i2") if a != b])
    return faces.select(F.inline(ends)).where("vertex_id <> neighbour").distinct()


def boundary(faces: DataFrame) -> DataFrame:
    """Vertices of edges that just one face has."""
    key = lambda a, b: F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    edges = faces.select(F.inline(F.array(key("i0", "i1"), key("i1", "i2"), key("i2", "i0"))))
    single = edges.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).where("n = 1")
    return single.select(F.explode(F.array("a", "b")).alias("vertex_id")).distinct()


def grow(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """vertex_id of the given vertices and of their neighbours."""
    ring = one_ring(faces).join(vertices.select("vertex_id"), "vertex_id").select(F.col("neighbour").alias("vertex_id"))
    return vertices.select("vertex_id").union(ring).distinct()


def fair(vertices: DataFrame, faces: DataFrame, strength: float = 1.0) -> DataFrame:
    """One step of smoothing: (1 - s) p + s mean(ring) inside, boundary and loose vertices as they are."""
    near = vertices.select("cloud_id", F.col("vertex_id").alias("neighbour"), *[F.col(c).alias(f"_{c}") for c in XYZ])
    means = one_ring(faces).join(near, "neighbour").groupBy("cloud_id", "vertex_id").agg(*[F.avg(f"_{c}").alias(f"_{c}") for c in XYZ])
    edge = boundary(faces).withColumn("_fixed", F.lit(True))
    out = vertices.join(edge, "vertex_id", "left").join(means, ["cloud_id", "vertex_id"], "left")
    free = F.col("_fixed").isNull() & F.col("_x").isNotNull()
    return out.select(*[(F.when(free, F.col(c) * (1 - strength) + F.col(f"_{c}") * strength).otherwise(F.col(c))).alias(c) if c in XYZ else F.col(c) for c in vertices.columns])


def normals(areas: DataFrame, robust: bool = False) -> DataFrame:
    """cloud_id, vertex_id, nx, ny, nz: the normalised sum of the cross products of the vertex's faces.

    ``areas`` come from ``face_areas``. ``robust`` leaves out faces with a squared edge below 1e-10 and, where nothing
    is left, takes the normalised position; otherwise such normals are null.
    """
    a, b, c = (g.point(f"a{k}") for k in range(3))
    cross = g.cross(g.minus(b, a), g.minus(c, a))
    usable = F.lit(True)
    if robust:
        for p, q in ((a, b), (b, c), (c, a)):
            usable = usable & (g.dot(g.minus(p, q), g.minus(p, q)) >= 1e-10)
    spread = areas.select("cloud_id", F.posexplode(F.array("i0", "i1", "i2")).alias("k", "vertex_id"), F.array("a0", "a1", "a2").alias("_at"), *[F.when(usable, v).alias(f"_{n}") for n, v in zip(XYZ, cross, strict=True)])
    sums = spread.groupBy("cloud_id", "vertex_id").agg(*[F.coalesce(F.sum(f"_{n}"), F.lit(0.0)).alias(f"_{n}") for n in XYZ], F.max(F.get("_at", F.col("k"))).alias("_p"))
    total = [F.col(f"_{n}") for n in XYZ]
    length = g.norm(total)
    own = [F.col(f"_p.{n}") for n in XYZ]
    fallback = g.unit(own) if robust else [F.lit(None).cast("double")] * 3
    return sums.select("cloud_id", "vertex_id", *[F.when(length > 0, t / length).otherwise(f).alias(f"n{n}") for n, t, f in zip(XYZ, total, fallback, strict=True)])


def merge_vertices(vertices: DataFrame, faces: DataFrame, bits: int = 20) -> tuple[DataFrame, DataFrame]:
    """Vertices of one mesh that fall in the same of 2**bits cells an axis become one, numbered as the faces show them first.

    Returns vertices(vertex_id, x, y, z) and faces. Cells are triples of ints. New numbers are ranks over cells, taken
    in levels so that no task orders all of them.
    """
    from allometra.operators.ranking import dense_number

    box = vertices.agg(*[f(c).alias(f"_{n}{c}") for n, f in (("lo", F.min), ("hi", F.max)) for c in XYZ])
    cell = [F.coalesce(F.least(F.floor(F.try_divide((F.col(c) - F.col(f"_lo{c}")) * (1 << bits), F.col(f"_hi{c}") - F.col(f"_lo{c}"))), F.lit((1 << bits) - 1)), F.lit(0)).cast("int").alias(f"c{c}") for c in XYZ]
    # The box is one row.
    placed = vertices.join(F.broadcast(box)).select("vertex_id", *XYZ, *cell)
    seen = corners(faces).withColumn("_order", F.col("face_id").cast("long") * 3 + F.col("corner")).join(placed, "vertex_id")
    cells = seen.groupBy("cx", "cy", "cz").agg(F.min(F.struct("_order", *XYZ)).alias("_first"))
    cells = dense_number(cells.withColumn("_order", F.col("_first._order")), "_order", "new_id")
    to = seen.join(cells.select("cx", "cy", "cz", "new_id"), ["cx", "cy", "cz"])
    new_faces = to.groupBy("face_id").agg(*[F.max(F.when(F.col("corner") == k, F.col("new_id"))).alias(f"i{k}") for k in range(3)])
    return cells.select(F.col("new_id").alias("vertex_id"), *[F.col(f"_first.{c}").alias(c) for c in XYZ]), new_faces
