"""Small operations against their definitions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from allometra.functions import geometry as g
from allometra.operators import clouds, compose, fits, statistics, table, topology
from allometra.plans.bindings import sheet_faces

XYZ = "x double, y double, z double"


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def lits(p):
    return [F.lit(float(v)) for v in p]


def test_best_planes(spark):
    """Against numpy on scattered, flat, straight and single points, and on a sphere's axes, where no plane is best."""
    rng = np.random.default_rng(51)
    sets = [rng.normal(size=(40, 3)) @ np.diag([3, 2, s]) @ np.linalg.qr(rng.normal(size=(3, 3)))[0] + 5 for s in (1, 0.1, 0)]
    sets += [np.outer(np.arange(5.0), [1, 2, 3]), np.ones((4, 3)), np.vstack([np.eye(3), -np.eye(3)]), np.outer(np.arange(3.0), [1, 0, 0])]
    rows = [(k, i, *map(float, p)) for k, s in enumerate(sets) for i, p in enumerate(s)] + [(0, 99, None, 1.0, 1.0)]
    found = {r.cloud_id: r for r in clouds.best_plane(spark.createDataFrame(rows, f"cloud_id long, vertex_id int, {XYZ}"), "cloud_id").collect()}
    for k, s in enumerate(sets):
        r = found[k]
        normal, off = np.array([r.nx, r.ny, r.nz]), s - s.mean(axis=0)
        least = np.linalg.eigvalsh(off.T @ off / len(s))[0]
        assert r.n == len(s) and np.allclose([r.cx, r.cy, r.cz], s.mean(axis=0)) and np.linalg.norm(normal) == pytest.approx(1)
        assert normal[np.abs(normal).argmax()] > 0
        assert ((off @ normal) ** 2).mean() == pytest.approx(max(least, 0), abs=1e-9) and r.rms**2 == pytest.approx(max(least, 0), abs=1e-9)


@pytest.mark.parametrize("inclusive", [True, False])
def test_scans_of_odd_tables(spark, inclusive):
    df = spark.range(997).select(((F.col("id") * 613) % 997).alias("k"), F.when(F.col("id") % 5 != 0, F.col("id")).alias("v"))
    rows = statistics.scan(df.repartition(7), ["k"], "v", inclusive).orderBy("k").collect()
    total = 0
    for r in rows:
        assert r.running_sum == total + (r.v or 0 if inclusive else 0)
        total += r.v or 0
    assert len(rows) == 997 and statistics.scan(df.limit(0), ["k"], "v").isEmpty()
    nothing = statistics.scan(df.limit(3).withColumn("v", F.lit(None).cast("decimal(9,2)")), ["k"], "v")
    assert [r.running_sum for r in nothing.collect()] == [0, 0, 0]


def test_factors_and_columns(spark):
    df = spark.createDataFrame([(0, "a", True, 1.5, 3), (1, "c", True, 2.5, 1), (2, None, True, 0.5, 3)], "row_index long, f string, b boolean, r double, i int")
    df = table.declare(df, "f", "factor", ["c", "b", "a"])
    values = lambda c: [r.level for r in table.unique_values(df, c).orderBy("level_index").collect()]
    assert (values("f"), values("b"), values("r"), values("i")) == (["c", "b", "a"], ["false", "true"], [], ["1", "3"])
    assert {r.level: r.n for r in table.level_counts(df.where("row_index < 9").select("f"), "f").collect()} == {"a": 1, "b": 0, "c": 1}
    other = spark.createDataFrame([(0, 1.0), (1, None), (2, 3.0)], "row_index long, size double")
    assert [r["size"] for r in table.add_column(df, other, "row_index", "size").orderBy("row_index").collect()] == [1.0, None, 3.0]
    with pytest.raises(ValueError, match="rows"):
        table.add_column(df, other.limit(2), "row_index", "size")
    with pytest.raises(ValueError, match="exists"):
        table.add_column(df, other.withColumnRenamed("size", "r"), "row_index", "r")
    assert table.add_column(df, other.withColumnRenamed("size", "r"), "row_index", "r", force=True).agg(F.sum("r")).first()[0] == 4.0
    assert df.where(table.clear(df)).isEmpty()


def test_cells(spark):
    df = spark.createDataFrame([(0, "a", 1.5), (1, None, 2.5)], "row_index long, name string, r double")
    assert [x.v for x in df.select(table.display(df, "name").alias("v")).collect()] == ["a", "(null)"]
    assert [x.r for x in table.set_cell(df, "row_index", 1, "r", "7").orderBy("row_index").collect()] == [1.5, 7.0]
    assert [(x.row_index, x.name, x.r) for x in table.append_default(df, "row_index").orderBy("row_index").collect()][-1] == (2, "", 0.0)
    assert [x.row_index for x in table.delete_row(df, "row_index", 0).collect()] == [0]
    assert table.column_window(df, ["name", "r"], 1, 1).columns == ["PC1"]


def test_scalar_geometry(spark):
    a, b, c = lits([0, 0, 0]), lits([2, 0, 0]), lits([0, 2, 0])
    assert value(spark, F.array(*g.barycentric(a, b, c, F.lit(0.5), F.lit(0.25)))) == [1.0, 0.5, 0.0]
    assert value(spark, g.triangle_area_heron(a, b, c)) == pytest.approx(2) and value(spark, g.triangle_area_heron(a, b, b)) == 0
    assert value(spark, g.is_degenerate(F.lit(1), F.lit(2), F.lit(1))) and not value(spark, g.is_degenerate(F.lit(1), F.lit(2), F.lit(3)))
    assert value(spark, g.box_overlap(a, b, lits([2, 0, 0]), c)) and not value(spark, g.box_overlap(a, b, lits([3, 0, 0]), lits([4, 1, 1])))
    assert value(spark, F.array(*g.clamp_to_box(lits([5, -1, 0.5]), a, lits([1, 1, 1])))) == [1.0, 0.0, 0.5]
    assert value(spark, F.array(*g.reflect(lits([3, 1, 1]), lits([1, 0, 0]), lits([1, 0, 0])))) == [-1.0, 1.0, 1.0]
    axis = value(spark, g.quaternion_axis(*lits([0, 0, 2**-0.5, 2**-0.5])))
    assert (axis.x, axis.y, axis.z) == pytest.approx((0, 0, 1)) and axis.degrees == pytest.approx(90)
    assert value(spark, g.nan_to(F.lit(float("nan")), F.lit(3.0))) == 3.0 and value(spark, g.nan_to(F.lit(1.0), F.lit(3.0))) == 1.0


def test_clouds(spark):
    schema = f"cloud_id long, vertex_id int, {XYZ}"
    one = spark.createDataFrame([(1, 0, 1.0, 2.0, 3.0), (1, 1, 0.0, 0.0, 0.0)], schema)
    assert [tuple(r)[2:] for r in clouds.add_clouds(one, clouds.scale_positions(one, 2.0), -1.0).orderBy("vertex_id").collect()] == [(-1.0, -2.0, -3.0), (0.0, 0.0, 0.0)]
    sizes = spark.createDataFrame([(1, 3.0)], "cloud_id long, cs double")
    assert clouds.restore_size(one, sizes).agg(F.sum("z")).first()[0] == 9.0
    rejected = spark.createDataFrame([(1, 0), (2, 0), (2, 1)], "cloud_id long, vertex_id int")
    assert {(r.cloud_id, r.n_rejected, r.rate) for r in clouds.rejections_by_cloud(rejected, 4).collect()} == {(1, 1, 0.25), (2, 2, 0.5)}


def test_rings(spark):
    faces = spark.createDataFrame([(0, 0, 1, 2), (1, 1, 3, 2), (2, 3, 4, 5)], "face_id int, i0 int, i1 int, i2 int")
    found = {r.vertex_id: (r.faces, r.valence) for r in topology.vertex_faces(faces).collect()}
    assert found[1] == ([0, 1], 2) and found[3] == ([1, 2], 2) and found[5] == ([2], 1)
    grown = topology.grow(spark.createDataFrame([(0,)], "vertex_id int"), faces)
    assert sorted(r.vertex_id for r in grown.collect()) == [0, 1, 2]


def test_stored_models(spark, tmp_path):
    rng = np.random.default_rng(52)
    x = rng.normal(size=(20, 12)) * np.linspace(3, 1, 12)
    rejected = (np.arange(4)[None] == (np.arange(20) % 4)[:, None]) & (np.arange(20) < 18)[:, None]
    rejected[:, 3] = True
    rows = [(i, "lost" if i == 7 else "ok", None if i == 7 else r.tolist(), 2.0, b.tolist(), float(b.mean())) for i, (r, b) in enumerate(zip(x, rejected))]
    found = spark.createDataFrame(rows, "cloud_id long, status string, pos array<double>, cs double, rejected array<boolean>, rejection_rate double")
    fits.pca_stage(found, restore=True, most=0.5).write.parquet(str(tmp_path / "m"))
    stored = spark.read.parquet(str(tmp_path / "m"))
    model, allow = fits.load_model(stored)
    assert allow.tolist() == [True] * 9 + [False] * 3
    kept = np.delete(x, 7, axis=0) * 2
    assert np.allclose(model.mean, kept.mean(axis=0)) and len(model.variances) == len(model.components)
    scores = {r.id: r["values"] for r in fits.matrix(stored, fits.SCORES).collect()}
    assert len(scores) == 19 and np.allclose(scores[0], (2 * x[0] - model.mean)[allow] @ model.components[:, allow].T)
    assert fits.matrix(fits.pca_stage(found, strict=0.3), fits.SCORES).count() == int((rejected.mean(axis=1) <= 0.3).sum()) - 1  # cloud 7 is lost
    with pytest.raises(ValueError):
        fits.load_model(stored.limit(0))


def test_repeated_measurements(spark):
    points = spark.createDataFrame([(k, 0, float(k), 0.0, float(-k)) for k in range(6)], f"cloud_id long, vertex_id int, {XYZ}")
    rows = spark.createDataFrame([(k, k // 3, "first" if k % 3 == 0 else "second" if k % 3 == 2 else "between") for k in range(6)], "row_index long, id long, at string")
    change = compose.repeated_measurements(rows, points, "difference", "id", "row_index", "at", "first", "second").first()
    assert (change.x, change.z) == (2.0, -2.0)
    assert compose.repeated_measurements(rows, points, "regression", "id", "row_index").first().x == pytest.approx(1.0)
    with pytest.raises(ValueError):
        compose.repeated_measurements(rows, points, "median", "id", "row_index")


def test_meshes_to_look_at(spark):
    faces = sheet_faces(spark)
    flat = np.stack([np.arange(64) % 8, np.arange(64) // 8, np.zeros(64)], axis=1).astype(float)
    rows = [(0, flat.ravel().tolist(), [k == 3 for k in range(64)]), (1, (flat + [0, 0, 2.0]).ravel().tolist(), [False] * 64), (2, None, None)]
    found = spark.createDataFrame(rows, "cloud_id long, pos array<double>, rejected array<boolean>")
    mesh = {r.vertex_id: r for r in compose.diagnostics(found, faces).collect()}
    assert len(mesh) == 64 and all(r.z == 1.0 and (r.nx, r.ny, abs(r.nz)) == (0.0, 0.0, 1.0) for r in mesh.values())
    assert mesh[3].value == 0.5 and mesh[4].value == 0.0
    assert {r.value for r in compose.diagnostics(found, faces, "index").where("vertex_id IN (0, 63)").collect()} == {0.0, 1.0}
    model = fits.PcaModel(flat.ravel(), np.stack([np.tile([0, 0, 1.0], 64), np.tile([1.0, 0, 0], 64)]), np.ones(2))
    assert {(r.z, r.x - flat[r.vertex_id][0]) for r in compose.synthesise(model, faces, {0: 3.0, 1: -1.0}).collect()} == {(3.0, -1.0)}


def test_weighted_groups(spark):
    rng = np.random.default_rng(53)
    x, w = rng.normal(size=(5, 64, 3)), np.array([1.0, 0.0, 2.0, 0.5, 4.0])
    rows = [(i, c.ravel().tolist(), 2.0, float(v)) for i, (c, v) in enumerate(zip(x, w))]
    df = spark.createDataFrame(rows, "cloud_id long, pos array<double>, cs double, weight double")
    expected = (x * w[:, None, None]).sum(axis=0) / w.sum()
    assert np.allclose(compose.group_mean(df), expected) and np.allclose(compose.group_mean(df, form=True), 2 * expected)
    even = df.withColumn("weight", F.lit(3.0))
    assert np.allclose(compose.group_mean(even, register=True), compose.group_mean(df.drop("weight"), register=True), atol=1e-4)
    found = compose.compare_groups(df, even, sheet_faces(spark)).orderBy("vertex_id").collect()
    assert np.allclose([r.value for r in found], np.linalg.norm(expected - x.mean(axis=0), axis=1))
    for wrong in (F.lit(0.0), F.when(F.col("cloud_id") > 0, 1.0)):
        with pytest.raises(ValueError):
            compose.group_mean(df.withColumn("weight", wrong))


def test_clusters_are_found(spark):
    rng = np.random.default_rng(54)
    rows = [(i, (rng.normal(size=6) + 20 * (i % 3)).tolist()) for i in range(60)]
    found = fits.kmeans(spark.createDataFrame(rows, "cloud_id long, pos array<double>"), 3).collect()
    groups = {}
    for r in found:
        groups.setdefault(r.cluster, set()).add(r.cloud_id % 3)
    assert len(found) == 60 and sorted(map(sorted, groups.values())) == [[0], [1], [2]]
