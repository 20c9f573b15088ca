"""Whole analyses as compositions of operators: dense correspondence, group comparison, symmetrisation, repeated measurements."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from allometra.operators import clouds as c
from allometra.operators import drift, fits, spatial, spline, statistics, table, topology
from allometra.sources.meshes import slices
from allometra.sources.scratch import written

XYZ = ("x", "y", "z")
_DOUBLES = pa.list_(pa.float64())


# Dense correspondence


@dataclass(frozen=True)
class CorrespondenceOptions:
    """``base``: cloud_id of the template; ``fair``: smooth it once; ``by_ray``: project along normals; areas may scale within
    [low, high]; vertices farther out than the upper quartile and ``fence`` ranges between quartiles are rejected, too, if
    it is given; vertices that more than ``most`` clouds reject are rejected in all, if it is given; ``impute``: put rejected
    vertices where a spline takes them; ``refit``: align the results once more."""

    base: int = 0
    fair: bool = False
    by_ray: bool = True
    low: float = 0.25
    high: float = 4.0
    fence: float | None = None
    most: int | None = None
    impute: bool = True
    impute_cells: int = 8
    refit: bool = True
    registration: drift.DriftOptions = drift.DriftOptions()


def landmark_fit(landmarks: DataFrame, subset: list[int] | None = None) -> fits.GpaResult:
    """Generalised Procrustes of packed landmark clouds, of some of the landmarks if ``subset`` says so."""
    if subset is not None:
        landmarks = landmarks.withColumn("pos", F.concat(*[F.slice("pos", 3 * i + 1, 3) for i in subset]))
    return fits.gpa(landmarks)


def move(clouds: DataFrame, rigid: DataFrame, inverse: bool = False) -> DataFrame:
    """Packed clouds through the similarity (cloud_id, offs, cs, rot) of their own, or back through it: cloud_id, pos."""
    both = clouds.select("cloud_id", "pos").join(rigid.select("cloud_id", "offs", "cs", "rot"), "cloud_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for pos, offs, cs, rot in zip(*(batch.column(n) for n in ("pos", "offs", "cs", "rot")), strict=True):
                x, o, r = (v.values.to_numpy(zero_copy_only=False) for v in (pos, offs, rot))
                x, r = x.reshape(-1, 3), r.reshape(3, 3)
                out.append((x @ r.T * cs.as_py() + o if inverse else fits.apply(x, o, cs.as_py(), r)).ravel())
            yield pa.RecordBatch.from_arrays([batch.column("cloud_id"), pa.array(out, _DOUBLES)], ["cloud_id", "pos"])

    return both.mapInArrow(run, "cloud_id long, pos array<double>")


def base_mesh(clouds: DataFrame, faces: DataFrame, base: int, fair: bool = False) -> np.ndarray:
    """Points of the template, one cloud, smoothed once if asked for."""
    own = clouds.where(F.col("cloud_id") == base)
    if fair:
        own = c.pack(topology.fair(c.unpack(own), faces))
    row = own.select("pos").first()
    if row is None:
        raise ValueError(f"no cloud {base}")
    return np.array(row.pos).reshape(-1, 3)


def _sound(clouds: DataFrame, least: int) -> DataFrame:
    """Packed clouds with at least so many points, all with finite coordinates, not all in one place."""
    finite = F.forall("pos", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    axis = lambda k: F.filter("pos", lambda v, i: i % 3 == k)
    wide = F.greatest(*[F.array_max(axis(k)) - F.array_min(axis(k)) for k in range(3)]) > 0
    return clouds.where((F.size("pos") >= 3 * least) & finite & wide)


def _flagged(clouds: DataFrame, bad: DataFrame, lost: list[int]) -> DataFrame:
    """cloud_id, pos, rejected (a flag for each vertex) and n_rejected of packed clouds with gaps, which close up.

    Rejected are the vertices of a cloud that ``bad`` (cloud_id, vertex_id) names, and in all clouds those in ``lost``.
    """
    both = clouds.select("cloud_id", "pos").join(bad.groupBy("cloud_id").agg(F.collect_list("vertex_id").alias("_bad")), "cloud_id", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            places, flags = [], []
            for pos, own in zip(batch.column("pos"), batch.column("_bad"), strict=True):
                known = pos.values.is_valid().to_numpy(zero_copy_only=False).reshape(-1, 3).all(axis=1)
                out = np.zeros(len(known), dtype=bool)
                out[[i for i in lost if i < len(out)]] = True
                if own.is_valid:
                    out[own.values.to_numpy()] = True
                places.append(pos.values.to_numpy(zero_copy_only=False).reshape(-1, 3)[known].ravel())
                flags.append(out[known])
            n = pa.array([int(f.sum()) for f in flags], pa.int32())
            columns = [batch.column("cloud_id"), pa.array(places, _DOUBLES), pa.array(flags, pa.list_(pa.bool_())), n]
            yield pa.RecordBatch.from_arrays(columns, ["cloud_id", "pos", "rejected", "n_rejected"])

    return both.mapInArrow(run, "cloud_id long, pos array<double>, rejected array<boolean>, n_rejected int")


def correspond(meshes: DataFrame, faces: DataFrame, landmarks: DataFrame, options: CorrespondenceOptions | None = None) -> DataFrame:
    """One template brought onto every mesh: cloud_id, status, pos, cs (size), rejected (a flag for each vertex), n_rejected,
    rejection_rate, iterations and reason (of the registration).

    ``meshes`` and ``landmarks`` are packed (cloud_id, pos); ``faces`` are those of all meshes, the template's among them. Meshes are aligned
    by their landmarks, the template is registered to each by point drift and projected onto its surface, vertices of
    faces that scale too much, or that lie too far out, are rejected and imputed, and the results are aligned again. All steps
    are joins or maps by cloud; one cloud, the template, goes through the driver.

    Every mesh ends as a row. ``status`` is ok, or says where a cloud was lost, and then it has no pos: ``no landmarks`` (missing,
    without extent, or not as many as most have), ``broken mesh`` (a coordinate is missing, or no extent), ``not registered``,
    ``all vertices rejected``. It is an error if the template's own mesh is lost or no cloud is left.
    """
    o = options or CorrespondenceOptions()
    marks = _sound(landmarks.select("cloud_id", "pos"), 4)
    usual = marks.groupBy(F.size("pos").alias("_n")).agg(F.count(F.lit(1)).alias("_times")).orderBy(F.desc("_times"), "_n").first()
    if usual is None:
        raise ValueError("no landmarks")
    marks = written(marks.where(F.size("pos") == usual["_n"]))
    whole = written(_sound(meshes.select("cloud_id", "pos"), 4))
    rigid = written(landmark_fit(marks.join(whole.select("cloud_id"), "cloud_id", "left_semi")).fitted.select("cloud_id", "offs", "cs", "rot"))
    aligned = written(move(whole, rigid))
    template = base_mesh(aligned, faces, o.base, o.fair)
    registered = written(drift.register_all(aligned, template, o.registration))
    moved = registered.where("reason <> 'numeric'").select("cloud_id", "pos")
    points = c.unpack(moved).withColumn("point_id", F.col("vertex_id").cast("long"))
    if o.by_ray:
        points = points.join(topology.normals(c.face_areas(moved, faces), robust=True), ["cloud_id", "vertex_id"], "left")
    else:
        points = points.withColumns({f"n{k}": F.lit(None).cast("double") for k in XYZ})
    onto = spatial.project(points.withColumnRenamed("cloud_id", "mesh_id"), aligned.withColumnRenamed("cloud_id", "mesh_id"), faces)
    projected = onto.select(F.col("mesh_id").alias("cloud_id"), F.col("point_id").cast("int").alias("vertex_id"), *XYZ)
    found = written(c.pack(projected, gaps=True))  # from here on a cloud is a row: only rejected vertices are dealt out by number

    shape = meshes.sparkSession.createDataFrame(pa.table({"cloud_id": [o.base], "pos": pa.array([template.ravel()], _DOUBLES)}))
    bad = c.reject_by_scaling(c.face_areas(shape, faces), c.face_areas(found, faces), o.low, o.high).select("cloud_id", "vertex_id")
    if o.fence is not None:
        placed = c.unpack(found).where("x IS NOT NULL")
        pairs = c.homologous(placed, c.unpack(shape).drop("cloud_id")).withColumns({f"d{k}": F.col(f"b{k}") - F.col(k) for k in XYZ})
        bad = bad.union(c.reject_by_distance(pairs, o.fence).where("rejected").select("cloud_id", "vertex_id")).distinct()
    lost = []
    if o.most is not None:
        bad = written(bad)
        lost = [r.vertex_id for r in bad.groupBy("vertex_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > o.most).collect()]  # of the template's size
    judged = written(_flagged(found, bad, lost).withColumn("rejection_rate", F.col("n_rejected") / len(template)))
    left = judged.where(F.col("n_rejected") < len(template))
    if left.isEmpty():
        raise ValueError("every vertex of every cloud is rejected")
    full = spline.impute_clouds(left, template, o.impute_cells) if o.impute else left.select("cloud_id", "pos")
    sizes = rigid.select("cloud_id", "cs")
    if o.refit:
        again = fits.gpa(written(full)).fitted
        sizes = sizes.join(again.select("cloud_id", F.col("cs").alias("_cs")), "cloud_id").select("cloud_id", (F.col("cs") * F.col("_cs")).alias("cs"))
        full = again.select("cloud_id", "pos")
    out = meshes.select("cloud_id").join(full, "cloud_id", "left").join(sizes, "cloud_id", "left")
    out = out.join(judged.drop("pos"), "cloud_id", "left").join(registered.select("cloud_id", "iterations", "reason"), "cloud_id", "left")
    for name, frame in (("_whole", whole), ("_marks", marks)):
        out = out.join(frame.select("cloud_id", F.lit(True).alias(name)), "cloud_id", "left")
    status = (
        F.when(F.col("_whole").isNull(), "broken mesh")
        .when(F.col("_marks").isNull(), "no landmarks")
        .when(F.col("reason") == "numeric", "not registered")
        .when(F.col("n_rejected") == len(template), "all vertices rejected")
        .otherwise("ok")
    )
    return out.select("cloud_id", status.alias("status"), "pos", "cs", "rejected", "n_rejected", "rejection_rate", "iterations", "reason")


def result_table(found: DataFrame, specimens: DataFrame, landmarks: DataFrame, restore: bool = False, strict: float | None = None) -> DataFrame:
    """Specimens (cloud_id, ...) with what ``correspond`` found: points, landmarks, size, rejected vertices, their rate, and status.

    ``restore`` gives points their size back; ``strict`` leaves out clouds that lost more than this share of their vertices.
    """
    out = specimens.join(found.withColumnRenamed("pos", "points"), "cloud_id", "left").join(landmarks.select("cloud_id", F.col("pos").alias("landmarks")), "cloud_id", "left")
    if restore:
        out = out.withColumn("points", F.transform("points", lambda v: v * F.col("cs")))
    return out if strict is None else out.where((F.col("status") == "ok") & (F.col("rejection_rate") <= strict))


def landmark_diagnosis(landmarks: DataFrame, meshes: DataFrame, faces: DataFrame, hover: float = 0.003, outlier: float = 0.1) -> DataFrame:
    """cloud_id, vertex_id, offset (distance from the mesh), hovers (more than ``hover`` of the mesh's greatest side), off_mean and
    is_outlier (after alignment more than ``outlier`` of the mean shape's greatest side from the mean)."""
    fit = landmark_fit(landmarks)
    points = c.unpack(landmarks).select(F.col("cloud_id").alias("mesh_id"), F.col("vertex_id").cast("long").alias("point_id"), *XYZ)
    near = spatial.nearest_triangle(points, meshes.withColumnRenamed("cloud_id", "mesh_id"), faces)
    sides = c.cloud_stats(c.unpack(meshes)).select(F.col("cloud_id").alias("mesh_id"), "max_side")
    offsets = near.join(sides, "mesh_id").select(F.col("mesh_id").alias("cloud_id"), F.col("point_id").cast("int").alias("vertex_id"), F.col("distance").alias("offset"), (F.col("distance") > hover * F.col("max_side")).alias("hovers"))
    side = float(np.ptp(fit.mean, axis=0).max())
    mean = meshes.sparkSession.createDataFrame([(i, *map(float, p)) for i, p in enumerate(fit.mean)], "vertex_id int, x double, y double, z double")
    off = c.homologous(c.unpack(fit.fitted), mean).select("cloud_id", "vertex_id", c.vertex_distance().alias("off_mean"))
    return offsets.join(off, ["cloud_id", "vertex_id"]).withColumn("is_outlier", F.col("off_mean") > outlier * side)


# Group comparison

FIELDS = ("vertex_distance", "signed_vertex_distance", "surface_distance", "signed_surface_distance", "face_scaling", "log_face_scaling")


def group_mean(clouds: DataFrame, form: bool = False, register: bool = False) -> np.ndarray:
    """Mean of one group's packed clouds (cloud_id, pos, cs).

    A shape is the mean of the clouds as they are, a form that of the clouds times their size, over their number. With
    ``register`` the clouds are first aligned among themselves. A column ``weight`` weighs the clouds; weights of 0 in all, or
    a missing one, are an error.
    """
    weights = clouds.select("cloud_id", "weight") if "weight" in clouds.columns else None
    if register:
        fitted = fits.gpa(clouds)
        if not form and weights is None:
            return fitted.mean
        if not form:
            return _weighted_mean(fitted.fitted.select("cloud_id", "pos").join(weights, "cloud_id"))
        weight = fitted.fitted.select("cloud_id", F.col("cs").alias("_cs"))
        clouds = clouds.join(weight, "cloud_id").withColumn("cs", F.col("cs") / F.col("_cs"))
    if form:
        clouds = clouds.withColumn("pos", F.transform("pos", lambda v: v * F.col("cs")))
    return fits.mean_of(clouds) if weights is None else _weighted_mean(clouds)


def _weighted_mean(clouds: DataFrame) -> np.ndarray:
    facts = clouds.agg(F.avg("weight").alias("w"), F.count_if(F.col("weight").isNull()).alias("lacking")).first()
    if not facts.w or facts.lacking:
        raise ValueError("weights that are missing, or 0 in all")
    return fits.mean_of(clouds.select("cloud_id", F.transform("pos", lambda v: v * F.col("weight")).alias("pos"))) / facts.w


def compare_groups(a: DataFrame, b: DataFrame, faces: DataFrame, field: str = "vertex_distance", form: bool = False, register: bool = False) -> DataFrame:
    """vertex_id, value (field of the mean of b against that of a) and rms (distance of the means), for each vertex.

    ``a`` and ``b`` are packed clouds (cloud_id, pos, cs). With ``register`` each group is aligned in itself and the mean of b is then
    fitted to that of a; the field and rms are both taken of the fitted mean. Signed and surface fields use b's normals.
    """
    if field not in FIELDS:
        raise ValueError(f"no field {field}")
    mean_a, mean_b = (group_mean(df, form, register) for df in (a, b))
    if register:
        offs, cs, rot = fits.opa(mean_a, mean_b)
        # Forms keep their size.
        mean_b = (mean_b - mean_b.mean(axis=0)) @ rot + mean_a.mean(axis=0) if form else fits.apply(mean_b, offs, cs, rot)
    spark = a.sparkSession
    means = spark.createDataFrame(pa.table({"cloud_id": [0, 1], "pos": pa.array([mean_a.ravel(), mean_b.ravel()], _DOUBLES)}))
    long = c.unpack(means)
    areas = c.face_areas(means, faces)
    first, second = (long.where(F.col("cloud_id") == k).drop("cloud_id") for k in (0, 1))
    if field.endswith("face_scaling"):
        values = c.face_scaling(areas.where("cloud_id = 0"), areas.where("cloud_id = 1"), field.startswith("log"), long.where("cloud_id = 1")).select("vertex_id", F.col("scaling").alias("value"))
    else:
        normals = topology.normals(areas.where("cloud_id = 1"), robust=True).drop("cloud_id")
        both = c.homologous(first, second.join(normals, "vertex_id", "left"))
        values = both.select("vertex_id", getattr(c, field)().alias("value"))
    rms = float(np.sqrt(((mean_a - mean_b) ** 2).sum(axis=1).mean()))
    return values.withColumn("rms", F.lit(rms))


# Meshes to look at


def as_mesh(clouds: DataFrame, faces: DataFrame, robust: bool = False) -> DataFrame:
    """Packed clouds with the faces of a mesh as vertices with normals: cloud_id, vertex_id, x, y, z, nx, ny, nz; loose vertices have no normal."""
    normals = topology.normals(c.face_areas(clouds, faces), robust=robust)
    return c.unpack(clouds).join(normals, ["cloud_id", "vertex_id"], "left")


def _one(spark, points: np.ndarray) -> DataFrame:
    return spark.createDataFrame(pa.table({"cloud_id": [0], "pos": pa.array([points.ravel()], _DOUBLES)}))


def mean_mesh(clouds: DataFrame, faces: DataFrame, robust: bool = False) -> DataFrame:
    """The mean of packed clouds as a mesh with normals."""
    return as_mesh(_one(clouds.sparkSession, fits.mean_of(clouds)), faces, robust).drop("cloud_id")


def synthesise(model: fits.PcaModel, faces: DataFrame, scores: dict[int, float]) -> DataFrame:
    """The shape at some scores by component number (from 0), the others 0, as a mesh with normals."""
    place = np.zeros(len(model.components))
    for k, v in scores.items():
        place[k] = v
    return as_mesh(_one(faces.sparkSession, model.predict(place)), faces).drop("cloud_id")


def diagnostics(found: DataFrame, faces: DataFrame, field: str = "rejection") -> DataFrame:
    """The mean mesh of what ``correspond`` found with a value for each vertex: the share of clouds that reject it, or its number over the greatest."""
    rows = found.where("pos IS NOT NULL").select("cloud_id", "pos", "rejected")
    mesh = mean_mesh(rows, faces)
    if field == "index":
        last = mesh.agg(F.max("vertex_id")).first()[0]
        return mesh.withColumn("value", F.col("vertex_id") / F.lit(max(1, last or 1)))
    if field != "rejection":
        raise ValueError(f"no field {field}")
    rates = rows.select(F.posexplode("rejected").alias("vertex_id", "_bad")).groupBy("vertex_id").agg(F.avg(F.col("_bad").cast("double")).alias("value"))
    return mesh.join(rates, "vertex_id", "left").fillna(0.0, ["value"])


# Repeated measurements, vertex by vertex


def series_lines(series: DataFrame, vertices: DataFrame, compat: bool = False) -> DataFrame:
    """Of each series and vertex the regression of x, y and z on the place in the series: slope_x, intercept_x, ..., n.

    ``series`` (series_id, pos, row_index) is that of ``table.series``; row_index is the cloud. One join and one aggregation.
    """
    points = series.join(vertices.select(F.col("cloud_id").alias("row_index"), "vertex_id", *XYZ), "row_index")
    at = F.col("pos").cast("double")
    long = points.select("series_id", "vertex_id", at.alias("_t"), F.inline(F.array(*[F.struct(F.lit(k).alias("axis"), F.col(k).alias("_v")) for k in XYZ])))
    lines = statistics.regression(long, ["series_id", "vertex_id", "axis"], F.col("_t"), F.col("_v"), compat)
    pick = lambda k, v: F.max(F.when(F.col("axis") == k, F.col(v))).alias(f"{v}_{k}")
    return lines.groupBy("series_id", "vertex_id").agg(*[pick(k, v) for k in XYZ for v in ("slope", "intercept")], F.max("n").alias("n"))


def average_slopes(series: DataFrame, vertices: DataFrame) -> DataFrame:
    """Mean of the slopes of each vertex over the series: vertex_id, x, y, z, n_series."""
    lines = series_lines(series, vertices)
    return lines.groupBy("vertex_id").agg(*[F.avg(f"slope_{k}").alias(k) for k in XYZ], F.count(F.lit(1)).alias("n_series"))


def average_differences(pairs: DataFrame, vertices: DataFrame) -> DataFrame:
    """Mean of second less first of each vertex over the pairs (id, first_row, second_row): vertex_id, x, y, z, n_pairs."""
    ends = pairs.select(F.inline(F.array(F.struct(F.col("first_row").alias("cloud_id"), F.lit(-1.0).alias("_sign")), F.struct(F.col("second_row").alias("cloud_id"), F.lit(1.0).alias("_sign")))))
    both = ends.join(vertices, "cloud_id")
    n = F.count_if(F.col("_sign") > 0)
    return both.groupBy("vertex_id").agg(*[(F.sum(F.col("_sign") * F.col(k)) / n).alias(k) for k in XYZ], n.alias("n_pairs"))


# Symmetry


def repeated_measurements(rows: DataFrame, vertices: DataFrame, operation: str, ident: str, row_index: str, order: str | None = None, first: str = "", second: str = "", min_points: int = 2) -> DataFrame:
    """vertex_id, x, y, z: mean change a vertex over repeated measurements, by the operation chosen.

    ``difference``: the mean step from each id's row of order value ``first`` to that of ``second``. ``regression``: the mean
    slope of each id's rows in row order, of ``min_points`` rows at least. ``rows`` name clouds by ``row_index``.
    """
    if operation == "difference":
        if order is None:
            raise ValueError("a difference needs a column of order values")
        return average_differences(table.pairs(rows, ident, order, first, second, row_index), vertices)
    if operation == "regression":
        return average_slopes(table.series(rows, ident, row_index, min_points), vertices)
    raise ValueError(f"no operation {operation}")


def bilateral_order(points: np.ndarray) -> np.ndarray:
    """For each landmark the one that is its mirror image, by the best plane between two landmarks.

    A plane stands halfway between two landmarks at right angles to the line through them. Reflected there, each landmark takes the
    nearest one; the plane with the least sum of squared distances decides, the first of equal ones.
    """
    n = len(points)
    i, j = np.triu_indices(n, 1)
    step = points[j] - points[i]
    length = np.sqrt((step**2).sum(axis=1))
    i, j, step = i[length > 0], j[length > 0], step[length > 0] / length[length > 0][:, None]
    best, order = np.inf, np.arange(n)
    for a, b, normal in zip(i, j, step, strict=True):
        mirrored = points - 2 * ((points - (points[a] + points[b]) / 2) @ normal)[:, None] * normal
        squares = ((mirrored[:, None] - points[None]) ** 2).sum(axis=2)
        error = squares.min(axis=1).sum()
        if error < best:
            best, order = error, squares.argmin(axis=1)
    return order


def _align_pairs(a: np.ndarray, b: np.ndarray, rounds: int = 150) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Similarities that bring two clouds of each pair (pairs, points, 3) to their common mean of size 1; a pair that has settled takes no more rounds."""

    def normal(x: np.ndarray) -> np.ndarray:
        x = x - x.mean(axis=1, keepdims=True)
        return x / np.sqrt((x**2).sum(axis=2).mean(axis=1))[:, None, None]

    mean, going = normal(a), np.arange(len(a))
    for _ in range(rounds):
        new = normal(sum(fits._applied(x[going], *fits._opas(mean[going], x[going], None)) for x in (a, b)))
        still = np.abs(new - mean[going]).max(axis=(1, 2)) >= 1e-12
        going = going[still]
        if not len(going):
            break
        mean[going] = new[still]
    return [fits._opas(mean, x, None) for x in (a, b)]


def mirrored_pairs(meshes: DataFrame, landmarks: DataFrame) -> DataFrame:
    """Each mesh and its mirror image aligned by their landmarks: cloud_id, pos, mirror, offs, cs, rot (of pos)."""
    both = meshes.select("cloud_id", "pos").join(landmarks.select("cloud_id", F.col("pos").alias("marks")), "cloud_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            kinds: dict[int, list[int]] = {}  # rows by their number of landmarks
            cell = lambda name, i: batch.column(name)[i].values.to_numpy(zero_copy_only=False).reshape(-1, 3)
            for i in range(batch.num_rows):
                kinds.setdefault(len(batch.column("marks")[i]), []).append(i)
            for at in kinds.values():
                marks = np.stack([cell("marks", i) for i in at])
                found = _align_pairs(marks, np.stack([m[bilateral_order(m)] for m in marks]) * [-1, 1, 1])
                rows = []
                for i, own, other in zip(at, *(zip(*f) for f in found)):
                    x = cell("pos", i)
                    rows.append((fits.apply(x, *own).ravel(), fits.apply(x * [-1, 1, 1], *other).ravel(), own[0], own[1], own[2].ravel()))
                types = (_DOUBLES, _DOUBLES, _DOUBLES, pa.float64(), _DOUBLES)
                yield pa.RecordBatch.from_arrays([batch.column("cloud_id").take(pa.array(at)), *(pa.array(v, k) for v, k in zip(zip(*rows), types, strict=True))], ["cloud_id", "pos", "mirror", "offs", "cs", "rot"])

    return both.mapInArrow(run, "cloud_id long, pos array<double>, mirror array<double>, offs array<double>, cs double, rot array<double>")


def symmetrise(meshes: DataFrame, landmarks: DataFrame, faces: DataFrame) -> DataFrame:
    """Packed meshes made symmetric: cloud_id, pos.

    Each vertex meets its counterpart on the mirror image in two ways, as the mirror's nearest point and, at the same place of a face, where the
    mirror's own vertex lies nearest on the mesh. It moves half the way to the mean of both, back in the mesh's own position and size.
    """
    pair = written(mirrored_pairs(meshes, landmarks))
    own = pair.select(F.col("cloud_id").alias("mesh_id"), "pos")
    mirror = pair.select(F.col("cloud_id").alias("mesh_id"), F.col("mirror").alias("pos"))
    points = lambda df: c.unpack(df.withColumnRenamed("mesh_id", "cloud_id")).select(F.col("cloud_id").alias("mesh_id"), F.col("vertex_id").cast("long").alias("point_id"), *XYZ)
    key = ["mesh_id", "point_id"]
    first = spatial.nearest_triangle(points(own), mirror, faces).select(*key, *[F.col(f"p{k}").alias(f"_s{k}") for k in XYZ])
    second = spatial.place_on(spatial.nearest_triangle(points(mirror), own, faces).select(*key, "face_id", "u", "v"), mirror, faces)
    second = second.select(*key, *[F.col(k).alias(f"_m{k}") for k in XYZ])
    met = points(own).join(first, key).join(second, key)
    half = [(F.col(k) / 2 + (F.col(f"_s{k}") + F.col(f"_m{k}")) / 4).alias(k) for k in XYZ]
    snapped = c.pack(met.select(F.col("mesh_id").alias("cloud_id"), F.col("point_id").cast("int").alias("vertex_id"), *half))
    return move(snapped, pair, inverse=True)


def landmark_offsets(landmarks: DataFrame, meshes: DataFrame, faces: DataFrame) -> DataFrame:
    """cloud_id, vertex_id and offset: how far each landmark lies from its mesh."""
    points = c.unpack(landmarks).select(F.col("cloud_id").alias("mesh_id"), F.col("vertex_id").cast("long").alias("point_id"), *XYZ)
    near = spatial.nearest_triangle(points, meshes.withColumnRenamed("cloud_id", "mesh_id"), faces)
    return near.select(F.col("mesh_id").alias("cloud_id"), F.col("point_id").cast("int").alias("vertex_id"), F.col("distance").alias("offset"))
