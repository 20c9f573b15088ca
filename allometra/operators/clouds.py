"""Point clouds in long form, vertices(cloud_id, vertex_id, x, y, z): means, sizes, fields between clouds, rejection."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from allometra.functions import geometry as g
from allometra.operators.statistics import quartile_fence

XYZ = ("x", "y", "z")
#: Faces of a mesh that go out as a broadcast (16 bytes each), and faces of one row of it.
MAX_FACES = 4_000_000
FACE_BLOCK = 65_536


def mean_shape(vertices: DataFrame, *by: str) -> DataFrame:
    """Mean of each vertex over the clouds (of each group); nulls are left out."""
    return vertices.groupBy(*by, "vertex_id").agg(*[F.avg(c).alias(c) for c in XYZ])


def weighted_mean_shape(vertices: DataFrame, weight: str, *by: str) -> DataFrame:
    """Sum of weight times position over the number of clouds, not over the sum of weights."""
    return vertices.groupBy(*by, "vertex_id").agg(*[(F.sum(F.col(weight) * F.col(c)) / F.count(F.lit(1))).alias(c) for c in XYZ])


def cloud_stats(vertices: DataFrame) -> DataFrame:
    """Box, centroid and size (root mean square distance from the centroid) of each cloud, in one aggregation."""
    size = F.sqrt(F.var_pop("x") + F.var_pop("y") + F.var_pop("z"))
    facts = [f(c).alias(f"{name}_{c}") for name, f in (("min", F.min), ("max", F.max), ("centre", F.avg)) for c in XYZ]
    out = vertices.groupBy("cloud_id").agg(*facts, size.alias("size"))
    return out.withColumn("max_side", F.greatest(*[F.col(f"max_{c}") - F.col(f"min_{c}") for c in XYZ]))


def best_plane(points: DataFrame, *by: str) -> DataFrame:
    """By key the plane with the least sum of squared distances: n, centre cx to cz, unit normal nx to nz and rms distance.

    One aggregation of moments, then columns only. Rows without three coordinates do not count; points all in one place have a normal, too.
    """
    rows = points.where(" AND ".join(f"{k} IS NOT NULL" for k in XYZ))
    moments = [F.covar_pop(a, b).alias(f"_{a}{b}") for a, b in ("xx", "yy", "zz", "xy", "xz", "yz")]
    out = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[F.avg(k).alias(f"c{k}") for k in XYZ], *moments)
    out = out.withColumn("_e", g.least_eigen(*[F.col(f"_{ab}") for ab in ("xx", "yy", "zz", "xy", "xz", "yz")]))
    return out.select(*by, "n", "cx", "cy", "cz", *[F.col(f"_e.{k}").alias(f"n{k}") for k in XYZ], F.sqrt(F.greatest(F.lit(0.0), F.col("_e.value"))).alias("rms"))


def add_clouds(a: DataFrame, b: DataFrame, factor: float = 1.0) -> DataFrame:
    """Positions of ``a`` plus ``factor`` times those of ``b``, by cloud and vertex; other columns of ``a`` stay."""
    other = b.select("cloud_id", "vertex_id", *[F.col(k).alias(f"_{k}") for k in XYZ])
    return a.join(other, ["cloud_id", "vertex_id"]).withColumns({k: F.col(k) + factor * F.col(f"_{k}") for k in XYZ}).select(*a.columns)


def homologous(a: DataFrame, b: DataFrame, *on: str) -> DataFrame:
    """Vertices of the same number side by side: x, y, z of a and bx, by, bz."""
    other = b.select("vertex_id", *on, *[F.col(c).alias(f"b{c}") for c in XYZ], *[F.col(c).alias(f"b{c}") for c in ("nx", "ny", "nz") if c in b.columns])
    return a.join(other, ["vertex_id", *on])


def _step() -> g.Point:
    return [F.col(f"b{c}") - F.col(c) for c in XYZ]


def vertex_distance() -> Column:
    return g.norm(_step())


def signed_surface_distance() -> Column:
    """The step from a to b along b's normal."""
    return g.dot(_step(), [F.col(f"bn{c}") for c in XYZ])


def surface_distance() -> Column:
    return F.abs(signed_surface_distance())


def signed_vertex_distance() -> Column:
    return F.when(signed_surface_distance() < 0, -vertex_distance()).otherwise(vertex_distance())


def rms_distance(pairs: DataFrame, *by: str) -> DataFrame:
    """Root mean square of homologous distances (Procrustes distance of clouds that are already aligned)."""
    return pairs.groupBy(*by).agg(F.sqrt(F.avg(g.dot(_step(), _step()))).alias("rms"), F.count(F.lit(1)).alias("n_vertices"))


def dispersion(vertices: DataFrame, *by: str) -> DataFrame:
    """Of each vertex, the root mean square distance from its mean over the clouds."""
    return vertices.groupBy(*by, "vertex_id").agg(F.sqrt(F.var_pop("x") + F.var_pop("y") + F.var_pop("z")).alias("dispersion"))


def face_areas(clouds: DataFrame, faces: DataFrame) -> DataFrame:
    """cloud_id, face_id, i0, i1, i2, a0 to a2 (corner structs) and area.

    ``clouds`` are packed, or in long form and are packed first; a face with a corner that a cloud lacks, by number or by
    coordinates, has no row there. Faces go to the clouds in blocks, as a broadcast up to ``MAX_FACES``, and each cloud reads
    its corners from its own array, so no vertex is shuffled. Larger meshes are joined corner by corner.
    """
    if faces.count() > MAX_FACES:
        return _face_areas_by_joins(unpack(clouds) if "pos" in clouds.columns else clouds, faces)
    packed = clouds if "pos" in clouds.columns else pack(clouds, gaps=True)
    ids = ("face_id", "i0", "i1", "i2")
    blocks = faces.groupBy(F.expr(f"face_id div {FACE_BLOCK}")).agg(F.collect_list(F.struct(*ids)).alias("_faces")).select("_faces")
    corner = lambda i: F.struct(*[F.get("pos", i * 3 + k).alias(c) for k, c in enumerate(XYZ)])
    of = lambda f: F.struct(*[f[n].alias(n) for n in ids], *[corner(f[f"i{k}"]).alias(f"a{k}") for k in range(3)])
    out = packed.select("cloud_id", "pos").join(F.broadcast(blocks)).select("cloud_id", F.inline(F.transform("_faces", of)))
    return _with_area(out)


def _with_area(faces: DataFrame) -> DataFrame:
    return faces.withColumn("area", g.triangle_area(*[g.point(f"a{k}") for k in range(3)])).where("area IS NOT NULL")


def _face_areas_by_joins(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    out = faces.select("face_id", "i0", "i1", "i2")
    for k in range(3):
        own = vertices.select("cloud_id", F.col("vertex_id").alias(f"i{k}"), F.struct(*XYZ).alias(f"a{k}"))
        out = out.join(own, ["cloud_id", f"i{k}"] if k else f"i{k}")
    return _with_area(out.select("cloud_id", "face_id", "i0", "i1", "i2", "a0", "a1", "a2"))


def face_scaling(base: DataFrame, other: DataFrame, logarithm: bool = False, vertices: DataFrame | None = None) -> DataFrame:
    """Per cloud and vertex the mean ratio of the areas of its faces, other over base; 0 where no face has a usable ratio.

    ``base`` and ``other`` come from ``face_areas``; ``base`` is one cloud. Ratios that are 0 or no finite number are left
    out. Vertices without a face have rows, of 0, if ``vertices`` (cloud_id, vertex_id) name them.
    """
    ratio = F.try_divide(F.col("area"), F.col("_base"))
    usable = F.when((ratio > 2.3e-308) & (ratio < float("inf")), F.log10(ratio) if logarithm else ratio)
    both = other.join(base.select("face_id", F.col("area").alias("_base")), "face_id")
    corners = both.select("cloud_id", F.explode(F.array("i0", "i1", "i2")).alias("vertex_id"), usable.alias("_r"))
    out = corners.groupBy("cloud_id", "vertex_id").agg(F.coalesce(F.avg("_r"), F.lit(0.0)).alias("scaling"))
    if vertices is not None:
        out = vertices.select("cloud_id", "vertex_id").join(out, ["cloud_id", "vertex_id"], "left").fillna(0.0, ["scaling"])
    return out


def reject_by_scaling(base: DataFrame, other: DataFrame, low: float = 0.25, high: float = 4.0) -> DataFrame:
    """cloud_id, vertex_id of the corners of faces that vanish (area below 1e-10) or scale outside [low, high]."""
    both = other.join(base.select("face_id", F.col("area").alias("_base")), "face_id")
    ratio = F.try_divide(F.col("area"), F.col("_base"))
    bad = (F.col("area") < 1e-10) | (F.col("_base") < 1e-10) | ratio.isNull() | (ratio < low) | (ratio > high)
    return both.where(bad).select("cloud_id", F.explode(F.array("i0", "i1", "i2")).alias("vertex_id")).distinct()


def reject_by_distance(pairs: DataFrame, factor: float = 1.5) -> DataFrame:
    """cloud_id, vertex_id, distance and rejected: vertices that lie far out after the mean step of their cloud is taken away.

    Too far is above the third quartile plus ``factor`` times the range between quartiles.
    """
    step = pairs.groupBy("cloud_id").agg(*[F.avg(f"d{c}").alias(f"_m{c}") for c in XYZ])
    moved = pairs.join(step, "cloud_id")
    off = g.norm([F.col(f"d{c}") - F.col(f"_m{c}") for c in XYZ])
    moved = moved.select("cloud_id", "vertex_id", off.alias("distance"))
    return quartile_fence(moved, ["cloud_id"], "distance", ["vertex_id"], factor).select("cloud_id", "vertex_id", "distance", "rejected")


def rejection_rates(rejected: DataFrame, n_clouds: int) -> DataFrame:
    """vertex_id, n_rejected and rate over all clouds; vertices that no cloud rejects are not listed."""
    return rejected.groupBy("vertex_id").agg(F.count(F.lit(1)).alias("n_rejected")).withColumn("rate", F.col("n_rejected") / F.lit(n_clouds))


def rejections_by_cloud(rejected: DataFrame, n_vertices: int) -> DataFrame:
    """cloud_id, n_rejected and rate over the vertices; clouds without a rejected vertex are not listed."""
    return rejected.groupBy("cloud_id").agg(F.count(F.lit(1)).alias("n_rejected")).withColumn("rate", F.col("n_rejected") / F.lit(n_vertices))


def whitelist(vertices: DataFrame, rates: DataFrame, most: int) -> DataFrame:
    """vertex_id of the vertices that at most ``most`` clouds reject."""
    out = vertices.select("vertex_id").distinct().join(rates.select("vertex_id", "n_rejected"), "vertex_id", "left")
    return out.where(F.coalesce("n_rejected", F.lit(0)) <= most).select("vertex_id")


def restore_size(vertices: DataFrame, sizes: DataFrame) -> DataFrame:
    """Positions times their cloud's ``cs``."""
    out = vertices.join(sizes.select("cloud_id", "cs"), "cloud_id")
    return out.withColumns({c: F.col(c) * F.col("cs") for c in XYZ}).drop("cs")


def pack(vertices: DataFrame, *keep: str, gaps: bool = False) -> DataFrame:
    """One row a cloud: cloud_id, ``keep`` and pos, its vertices in order as one array of doubles x0 y0 z0 x1 ...

    With ``gaps`` a vertex stands at the place that its number, from 0, says, and missing numbers have nulls; otherwise
    vertices close up, whatever their numbers are.
    """
    point = F.struct(F.col("vertex_id").cast("int").alias("vertex_id"), *XYZ)
    rows = vertices.groupBy("cloud_id", *keep).agg(F.array_sort(F.collect_list(point)).alias("_p"))
    if gaps:
        last = F.element_at("_p", -1)["vertex_id"]
        lacking = F.array_except(F.sequence(F.lit(0), last), F.col("_p.vertex_id"))
        nothing = [F.lit(None).cast("double").alias(c) for c in XYZ]
        filled = F.array_sort(F.concat("_p", F.transform(lacking, lambda i: F.struct(i.alias("vertex_id"), *nothing))))
        rows = rows.withColumn("_p", F.when(F.size("_p") == last + 1, F.col("_p")).otherwise(filled))
    return rows.select("cloud_id", *keep, F.flatten(F.transform("_p", lambda p: F.array(p["x"], p["y"], p["z"]))).alias("pos"))


def unpack(clouds: DataFrame, *keep: str) -> DataFrame:
    """The long form of packed clouds."""
    at = lambda k: F.get("pos", F.col("vertex_id") * 3 + k)
    long = clouds.select("cloud_id", *keep, "pos", F.explode(F.sequence(F.lit(0), F.expr("size(pos) div 3 - 1"))).alias("vertex_id"))
    return long.select("cloud_id", *keep, F.col("vertex_id").cast("int").alias("vertex_id"), *[at(k).alias(c) for k, c in enumerate(XYZ)])


def permute(vertices: DataFrame, order: list[int]) -> DataFrame:
    """Vertices ``order`` of each cloud, renumbered from 0 in that order; a number may stand more than once."""
    places = vertices.sparkSession.createDataFrame(pa.table({"vertex_id": pa.array(order, pa.int32()), "_new": pa.array(range(len(order)), pa.int32())}))
    return vertices.join(places, "vertex_id").withColumn("vertex_id", F.col("_new")).select(*vertices.columns)


def scale_positions(vertices: DataFrame, factor: float) -> DataFrame:
    return vertices.withColumns({c: F.col(c) * factor for c in XYZ})


def flip(vertices: DataFrame, *axes: str) -> DataFrame:
    """The signs of some coordinates turned round: ``flip(v, "x")`` is the mirror image in the plane x = 0."""
    return vertices.withColumns({c: -F.col(c) for c in axes})


def masked_rms(pairs: DataFrame, allowed: DataFrame, *by: str) -> DataFrame:
    """``rms_distance`` over the vertices (vertex_id) of ``allowed``."""
    return rms_distance(pairs.join(allowed.select("vertex_id"), "vertex_id", "left_semi"), *by)
