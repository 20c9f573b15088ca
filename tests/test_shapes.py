"""Shapes whose answers are known, and brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from allometra.operators import clouds, fits, spatial, spline, table, topology

CORNERS = [(x, y, z) for x in (-1.0, 1.0) for y in (-1.0, 1.0) for z in (-1.0, 1.0)]
# Two triangles for each side of the cube.
SIDES = [(0, 1, 3), (0, 3, 2), (4, 6, 7), (4, 7, 5), (0, 4, 5), (0, 5, 1), (2, 3, 7), (2, 7, 6), (0, 2, 6), (0, 6, 4), (1, 5, 7), (1, 7, 3)]


@pytest.fixture
def cube(spark):
    vertices = spark.createDataFrame([(1, i, *p) for i, p in enumerate(CORNERS)], "cloud_id long, vertex_id int, x double, y double, z double")
    return vertices, spark.createDataFrame([(i, *f) for i, f in enumerate(SIDES)], "face_id int, i0 int, i1 int, i2 int")


def test_cube(cube):
    vertices, faces = cube
    assert clouds.face_areas(vertices, faces).agg(F.sum("area")).first()[0] == pytest.approx(24)
    assert topology.boundary(faces).isEmpty()
    assert topology.valence(faces).agg(F.sum("valence")).first()[0] == 36
    assert topology.one_ring(faces).count() == 2 * 18


def test_boundary_of_two_triangles(spark):
    faces = spark.createDataFrame([(0, 0, 1, 2), (1, 1, 3, 2)], "face_id int, i0 int, i1 int, i2 int")
    assert {r.vertex_id for r in topology.boundary(faces).collect()} == {0, 1, 2, 3}


def similarity(rng):
    q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    return q * np.sign(np.linalg.det(q))


def test_fit_recovers_a_similarity(spark):
    rng = np.random.default_rng(3)
    shape = rng.normal(size=(12, 3))
    rows = [(k, (shape @ similarity(rng) * (k + 1) + k).ravel().tolist()) for k in range(5)]
    df = spark.createDataFrame(rows, "cloud_id long, pos array<double>")
    target = fits._normalised(shape)
    for row in fits.fit_to(df, target).collect():
        assert np.allclose(np.reshape(row.pos, (-1, 3)), target, atol=1e-9)
    fitted = [np.reshape(r.pos, (-1, 3)) for r in fits.gpa(df).fitted.collect()]
    assert all(np.allclose(f, fitted[0], atol=1e-6) for f in fitted)
    same_size = df.withColumn("pos", F.transform("pos", lambda v: v / (F.col("cloud_id") + 1)))
    assert fits.distance_matrix(same_size, align=True).agg(F.max("distance")).first()[0] < 1e-6


def test_pca_against_numpy(spark):
    rng = np.random.default_rng(5)
    data = rng.normal(size=(40, 6)) * [5, 3, 2, 1, 1, 1]
    df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(data)], "cloud_id long, pos array<double>")
    expected = np.sort(np.linalg.eigvalsh(np.cov(data.T)))[::-1]
    found = np.array(fits.pca(df).variances)
    assert np.allclose(found / found[0], expected / expected[0])


def test_spline_passes_through_its_points():
    rng = np.random.default_rng(7)
    a, b = rng.normal(size=(20, 3)), rng.normal(size=(20, 3))
    s = spline.fit_spline(a, b)
    filled = spline.impute(a, b, np.arange(20) > 3)
    assert np.allclose(filled[4:], b[4:])
    assert s is not None and filled.shape == (20, 3)


def test_nearest_triangle_and_ray(spark, cube):
    vertices, faces = cube
    mesh = vertices.withColumnRenamed("cloud_id", "mesh_id").withColumn("vertex_id", F.col("vertex_id").cast("long"))
    points = spark.createDataFrame([(1, 0, 3.0, 0.2, 0.1), (1, 1, 0.0, 0.0, 0.5)], "mesh_id long, point_id long, x double, y double, z double")
    found = {r.point_id: r.distance for r in spatial.nearest_triangle(points, mesh, faces).collect()}
    assert found == {0: pytest.approx(2.0), 1: pytest.approx(0.5)}
    rays = points.where("point_id = 0").withColumns({"dx": F.lit(-1.0), "dy": F.lit(0.0), "dz": F.lit(0.0)})
    assert spatial.raycast(rays, mesh, faces).first().t == pytest.approx(2.0)


def test_merge_vertices(spark, cube):
    vertices, faces = cube
    split = faces.select("face_id", F.posexplode(F.array("i0", "i1", "i2")).alias("c", "v"))
    own = split.join(vertices, split.v == vertices.vertex_id).select("cloud_id", (F.col("face_id") * 3 + F.col("c")).alias("vertex_id"), "x", "y", "z")
    own_faces = faces.select("face_id", *[(F.col("face_id") * 3 + k).alias(f"i{k}") for k in range(3)])
    merged, merged_faces = topology.merge_vertices(own, own_faces)
    assert (merged.count(), merged_faces.count()) == (8, 12)


def test_predicates_treat_null_as_no_match(spark):
    df = spark.createDataFrame([(1, None), (2, "a"), (3, "b")], "row_index long, name string")
    assert [r.row_index for r in table.select_rows(df, ("name", "eq", "a")).collect()] == [2]
    assert table.levels(df, "name", "row_index").count() == 2


def test_rounds_of_gpa_are_dealt_out_evenly(spark, monkeypatch):
    """Clouds of one partition go to all cores; rounds give the mean of plain ones, also where sums meet before the driver."""
    rng = np.random.default_rng(9)
    x = [(shape @ similarity(rng)) * rng.uniform(1, 4) + rng.normal(size=3) for shape in rng.normal(size=(6, 3)) + 0.3 * rng.normal(size=(40, 6, 3))]
    df = spark.createDataFrame([(i, c.ravel().tolist()) for i, c in enumerate(x)], "cloud_id long, pos array<double>").coalesce(1)
    mean = fits._normalised(x[0])
    for _ in range(4):
        target = fits._normalised(mean)
        mean = np.mean([fits.apply(c, *fits.opa(target, c)) for c in x], axis=0)
    for most in (fits.BLOCK_BYTES, 1):
        monkeypatch.setattr(fits, "BLOCK_BYTES", most)
        result = fits.gpa(df, max_iterations=4, tolerance=-1.0)
        assert len(result.errors) == 4 and np.allclose(result.mean, mean)
        assert result.fitted.select(F.spark_partition_id()).distinct().count() == spark.sparkContext.defaultParallelism
        assert fits.shapes(df).map(lambda row: row[0]).sum() == 40


def test_many_fits_at_once_equal_single_ones(spark, monkeypatch):
    """Slices, masks of rows and a mask for all; the mean of fitted clouds is that of ``fit_to``."""
    monkeypatch.setattr(fits, "SLICE_BYTES", 3 * 8 * 3 * 9)  # three clouds
    rng = np.random.default_rng(8)
    x, allow, target = rng.normal(size=(17, 9, 3)) + 5, rng.random((17, 9)) < 0.8, rng.normal(size=(9, 3))
    every = np.arange(9) != 4
    rows = [(i, c.ravel().tolist(), a.tolist()) for i, (c, a) in enumerate(zip(x, allow))]
    df = spark.createDataFrame(rows, "cloud_id long, pos array<double>, allow array<boolean>")
    for frame, common, mask in ((df, every, allow & every), (df, None, allow), (df.drop("allow"), every, np.tile(every, (17, 1))), (df.drop("allow"), None, np.ones((17, 9), dtype=bool))):
        found = fits.fit_to(frame, target, common).collect()
        assert len(found) == 17
        for r in found:
            offs, cs, rot = fits.opa(target, x[r.cloud_id], mask[r.cloud_id])
            assert np.allclose(r.offs, offs) and np.isclose(r.cs, cs) and np.allclose(r.rot, rot.ravel())
            assert np.allclose(r.pos, fits.apply(x[r.cloud_id], offs, cs, rot).ravel())
    assert np.allclose(fits.fitted_mean(df, target), fits.mean_of(fits.fit_to(df.drop("allow"), target)))
    ragged = spark.createDataFrame([(0, [1.0, 0.0, 0.0] * 8), (1, [0.0, 1.0, 0.0] * 10)], "cloud_id long, pos array<double>").coalesce(1)
    with pytest.raises(Exception, match="different length"):
        fits.fitted_mean(ragged, target)
