"""Compositions and spatial joins against brute force and shapes whose answers are known."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from allometra.operators import clouds, compose, fits, spatial
from allometra.operators import table as t
from allometra.plans import queries
from allometra.plans.bindings import landmark_clouds, sheet_faces


@pytest.fixture(scope="module")
def scattered(spark):
    """Two meshes of loose triangles, a large one and one of three, with points and rays around them."""
    rng = np.random.default_rng(1)
    soups, vertices, faces, points, rays = {}, [], [], [], []
    for m, n in ((1, 1500), (2, 3)):
        v = (rng.normal(size=(n, 1, 3)) + 0.1 * rng.normal(size=(n, 3, 3))).reshape(-1, 3)
        soups[m] = v.reshape(-1, 3, 3)
        vertices += [(m, i, *map(float, x)) for i, x in enumerate(v)]
        faces += [(m, i, 3 * i, 3 * i + 1, 3 * i + 2) for i in range(n)]
        for i, x in enumerate(rng.normal(size=(600, 3)) * 1.5):
            points.append((m, i, *map(float, x)))
            rays.append((*points[-1], *map(float, rng.normal(size=3))))
    xyz = "x double, y double, z double"
    frames = [
        spark.createDataFrame(vertices, f"mesh_id long, vertex_id int, {xyz}"),
        spark.createDataFrame(faces, "mesh_id long, face_id int, i0 int, i1 int, i2 int"),
        spark.createDataFrame(points, f"mesh_id long, point_id long, {xyz}"),
        spark.createDataFrame(rays, f"mesh_id long, point_id long, {xyz}, dx double, dy double, dz double"),
    ]
    return soups, points, rays, *frames


def test_nearest_triangle_against_all(scattered):
    soups, points, _, vertices, faces, df, _ = scattered
    found = {(r.mesh_id, r.point_id): r for r in spatial.nearest_triangle(df, vertices, faces).collect()}
    assert len(found) == len(points)
    for m, i, *p in points:
        d, _, _ = spatial.closest_on_triangles(np.array([p]), *soups[m].transpose(1, 0, 2))
        assert found[m, i].distance == pytest.approx(np.sqrt(d.min()))
    near = spatial.nearest_triangle(df, vertices, faces, 0.5)
    assert near.count() == sum(r.distance <= 0.5 for r in found.values())


def test_rays_and_points_meet_few_triangles(scattered):
    """Every triangle of a cell, no other: rows of the joins stay far below all pairs."""
    *_, vertices, faces, df, rays = scattered
    soup = spatial.triangles(vertices, faces)
    grid = spatial._grid(soup)
    met = spatial._walk(rays, grid, False).join(spatial._filed(soup, grid, False), ["mesh_id", "cell"]).count()
    assert met < 0.2 * df.join(soup, "mesh_id").count()


@pytest.mark.parametrize("flat", [(1, 1, 0), (1, 0, 0), (1e-6, 1e6, 1), (0, 0, 0)])
def test_grids_of_flat_and_long_meshes(spark, flat):
    """Meshes without extent along an axis, far from the origin, with a triangle as large as all, against every triangle."""
    rng = np.random.default_rng(9)
    small = (rng.uniform(0, 9, size=(400, 1, 3)) + 0.2 * rng.normal(size=(400, 3, 3))) * flat + 100.0
    soup = np.concatenate([small, [[[100, 100, 100], [100 + 9 * flat[0], 100, 100], [100, 100 + 9 * flat[1], 100]]]])
    triangles = spark.createDataFrame([(1, i, *map(float, t.ravel())) for i, t in enumerate(soup)], f"mesh_id long, face_id long, {', '.join(f'{c} double' for c in spatial.CORNERS)}")
    p = np.concatenate([soup[:60].mean(axis=1), soup[:60, 0] + rng.normal(size=(60, 3)) * np.maximum(flat, 0.5), rng.uniform(-300, 300, size=(40, 3))])
    points = spark.createDataFrame([(1, i, *map(float, x)) for i, x in enumerate(p)], "mesh_id long, point_id long, x double, y double, z double")
    d, _, _ = spatial.closest_on_triangles(p, *soup.transpose(1, 0, 2))
    found = {r.point_id: r.distance for r in spatial.nearest_on(points, triangles).collect()}
    assert np.allclose([found[i] for i in range(len(p))], np.sqrt(d.min(axis=1)))
    ways = soup[rng.integers(len(soup), size=len(p))].mean(axis=1) - p
    rays = points.join(spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(ways)], "point_id long, dx double, dy double, dz double"), "point_id")
    t, _, _ = spatial.ray_hits(p, ways, *soup.transpose(1, 0, 2))
    hits = {r.point_id: r.ahead.t for r in spatial.first_hits(rays, triangles).collect()}
    assert np.allclose([hits.get(i, np.inf) for i in range(len(p))], t.min(axis=1))


def test_points_and_rays_without_numbers(spark, scattered):
    *_, vertices, faces, df, rays = scattered
    odd = df.limit(1).select("mesh_id", "point_id", F.lit(None).cast("double").alias("x"), F.lit(float("nan")).alias("y"), "z")
    assert spatial.nearest_triangle(odd, vertices, faces).isEmpty() and spatial.nearest_triangle(df.limit(0), vertices, faces).isEmpty()
    still = rays.limit(3).withColumns({c: F.lit(0.0) for c in ("dx", "dy", "dz")})
    assert spatial.raycast(still, vertices, faces).isEmpty() and spatial.raycast(rays, vertices.limit(0), faces).isEmpty()


def test_raycast_against_all(scattered):
    soups, _, rays, vertices, faces, _, df = scattered
    found = {(r.mesh_id, r.point_id): r for r in spatial.raycast(df, vertices, faces).collect()}
    back = {(r.mesh_id, r.point_id): r.t for r in spatial.raycast(df, vertices, faces, invert=True).collect()}
    for m, i, *r in rays:
        for sign, got in ((1, found[m, i].t if (m, i) in found else np.inf), (-1, back.get((m, i), np.inf))):
            t, _, _ = spatial.ray_hits(np.array([r[:3]]), sign * np.array([r[3:]]), *soups[m].transpose(1, 0, 2))
            assert got == pytest.approx(t.min())
    assert all(abs(r.u + r.v + r.w - 1) < 1e-12 for r in found.values())


def test_nearest_point_against_all(scattered):
    _, points, _, _, _, df, _ = scattered
    found = {(r.mesh_id, r.point_id): r.distance for r in spatial.nearest_point(df, df, "mesh_id").collect()}
    for m in (1, 2):
        x = np.array([p[2:] for p in points if p[0] == m])
        d = ((x[:, None] - x[None]) ** 2).sum(axis=2) + np.diag([np.inf] * len(x))
        assert np.allclose([found[m, i] for i in range(len(x))], np.sqrt(d.min(axis=1)))


def test_hit_objects(spark, scattered):
    soups, _, _, vertices, faces, *_ = scattered
    boxes = spark.createDataFrame([(m, *map(float, s.reshape(-1, 3).min(axis=0)), *map(float, s.reshape(-1, 3).max(axis=0))) for m, s in soups.items()], "mesh_id long, lox double, loy double, loz double, hix double, hiy double, hiz double")
    target = soups[2][0].mean(axis=0)
    assert 2 in {r.mesh_id for r in spatial.hit_objects(boxes, vertices, faces, (9.0, 9.0, 9.0), tuple(target - 9.0)).collect()}


def test_wide_components_against_numpy(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(30, 600)) * np.linspace(5, 1, 600)
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "cloud_id long, pos array<double>")
    centred = x - x.mean(axis=0)
    for scaled in (False, True):
        model = fits.pca(df, 5, correlation=scaled)
        part = centred / centred.std(axis=0, ddof=1) if scaled else centred
        values, vectors = np.linalg.eigh(part @ part.T / 29)
        expected = vectors[:, ::-1][:, :5].T @ centred
        expected /= np.sqrt((expected**2).sum(axis=1, keepdims=True))
        assert np.allclose(model.variances, values[::-1][:5])
        assert np.allclose(np.abs((model.components * expected).sum(axis=1)), 1)


def test_aligned_distances_against_pairs(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(12, 9, 3))
    x[1] = x[0] * [-1, 1, 1]  # a mirror image is no rotation
    df = spark.createDataFrame([(i, c.ravel().tolist()) for i, c in enumerate(x)], "cloud_id long, pos array<double>")
    for r in fits.distance_matrix(df, align=True).collect():
        a, b = (c - c.mean(axis=0) for c in (x[r.a_id], x[r.b_id]))
        u, _, vt = np.linalg.svd(b.T @ a)
        u[:, -1] *= np.sign(np.linalg.det(u @ vt))
        assert r.distance == pytest.approx(np.sqrt(((b @ u @ vt - a) ** 2).sum(axis=1).mean()), abs=1e-7)


def test_roots_of_pairs_are_singular_values(monkeypatch):
    """Fits by Newton's steps agree with singular values, also of flat, straight, mirrored, equal and empty clouds; those are few calls."""
    rng = np.random.default_rng(17)
    x, y = rng.normal(size=(40, 9, 3)), rng.normal(size=(30, 9, 3))
    x[0, :, 2], x[1, :, 1:], x[2], x[3], x[4], x[5] = 0, 0, 0, y[3], y[4] * [-1, 1, 1], y[5] @ np.linalg.qr(rng.normal(size=(3, 3)))[0] + 5
    x[6], y[6] = x[6] * 1e-60, y[6] * 1e-60
    plain = np.empty((2, len(x), len(y)))
    for i, a in enumerate(x):
        for j, b in enumerate(y):
            p, q = a - a.mean(axis=0), b - b.mean(axis=0)
            s, det = np.linalg.svd(p.T @ q, compute_uv=False), np.linalg.det(p.T @ q)
            squares = (p**2).sum() + (q**2).sum()
            plain[:, i, j] = squares - 2 * (s[0] + s[1] + np.sign(det) * s[2]), squares - 2 * (p * q).sum()
    decomposed, svd = [], np.linalg.svd
    monkeypatch.setattr(np.linalg, "svd", lambda c, **kind: decomposed.append(len(c.reshape(-1, 3, 3))) or svd(c, **kind))
    found = fits._rigid_rms(x.reshape(len(x), -1), y.reshape(len(y), -1), True, False)
    assert np.allclose(found, np.sqrt(np.maximum(plain, 0) / 9), rtol=1e-9, atol=1e-7)
    assert sum(decomposed) < len(x) * len(y) / 3
    mx, my = rng.random((40, 9)) < 0.7, rng.random((30, 9)) < 0.7
    raw = fits._masked_raw_rms(x.reshape(len(x), -1), mx, y.reshape(len(y), -1), my)
    for i, j in ((3, 3), (0, 1), (2, 2), (6, 6), (20, 20)):
        both = mx[i] & my[j]
        assert raw[i, j] == pytest.approx(np.sqrt(((x[i] - y[j])[both] ** 2).sum(axis=1).mean()), rel=1e-12, abs=1e-300)


def test_distances_are_rounded_as_spark_rounds(spark):
    rng = np.random.default_rng(18)
    halves = (rng.integers(0, 10**7, 3000) + 0.5) / 1e5
    values = np.concatenate([rng.random(3000) * 10, halves, np.nextafter(halves, 0), np.nextafter(halves, 99), rng.random(99) * 1e9, rng.random(9) * 10.0 ** np.arange(10, 19), [0.0, 5e-6, 4.9e-6, 1e-300, np.inf]])
    df = spark.createDataFrame([(float(v),) for v in values], "v double")
    assert fits._rounded(values, 5).tolist() == [r[0] for r in df.select(queries.r("v")).collect()]
    assert np.isnan(fits._rounded(np.array([np.nan]), 5)).all()


def test_masked_distances_against_pairs(spark):
    """Fitted and plain distances over what both clouds allow; forbidden points may lie anywhere, or nowhere."""
    rng = np.random.default_rng(16)
    x, allow = rng.normal(size=(11, 14, 3)) + 1e4, rng.random((11, 14)) < 0.6
    x[~allow] = rng.choice([np.nan, 1e9], size=(~allow).sum())[:, None]
    allow[3], allow[4, 1:] = False, False
    rows = [(i, c.ravel().tolist(), None if i == 3 else a.tolist()) for i, (c, a) in enumerate(zip(x, allow))]
    df = spark.createDataFrame(rows, "cloud_id long, pos array<double>, allow array<boolean>")
    for align in (False, True):
        found = fits.distance_matrix(df, align=align).collect()
        assert len(found) == 66
        for r in found:
            both = allow[r.a_id] & allow[r.b_id]
            if both.sum() < (3 if align else 1):
                assert r.distance is None
                continue
            a, b = x[r.a_id][both], x[r.b_id][both]
            if align:
                a, b = a - a.mean(axis=0), b - b.mean(axis=0)
                u, _, vt = np.linalg.svd(b.T @ a)
                u[:, -1] *= np.sign(np.linalg.det(u @ vt))
                b = b @ u @ vt
            assert r.distance == pytest.approx(np.sqrt(((b - a) ** 2).sum(axis=1).mean()), abs=1e-6)


def test_fits_by_own_masks(spark):
    rng = np.random.default_rng(17)
    shape = rng.normal(size=(12, 3))
    target, rows = fits._normalised(shape), []
    for k in range(4):
        q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
        moved, allow = shape @ (q * np.sign(np.linalg.det(q))) * (k + 1) - k, np.arange(12) % 4 != k
        moved[~allow] += 5
        rows.append((k, moved.ravel().tolist(), allow.tolist()))
    for row in fits.fit_to(spark.createDataFrame(rows, "cloud_id long, pos array<double>, allow array<boolean>"), target).collect():
        good = np.arange(12) % 4 != row.cloud_id
        assert np.allclose(np.reshape(row.pos, (-1, 3))[good], target[good], atol=1e-9)


def test_permute_and_flip(spark):
    df = spark.createDataFrame([(1, i, float(i), 0.0, 0.0) for i in range(4)], "cloud_id long, vertex_id int, x double, y double, z double")
    assert [(r.vertex_id, r.x) for r in clouds.permute(df, [2, 0, 2]).orderBy("vertex_id").collect()] == [(0, 2.0), (1, 0.0), (2, 2.0)]
    assert [r.x for r in clouds.flip(clouds.scale_positions(df, 2.0), "x").orderBy("vertex_id").collect()] == [0.0, -2.0, -4.0, -6.0]


def test_bilateral_order():
    half = np.array([[1.0, 0.2, 0.1], [2.0, 1.0, 0.5], [0.7, 3.0, -1.0]])
    points = np.concatenate([half, half[::-1] * [-1, 1, 1], [[0, 5.0, 5.0]]])
    assert compose.bilateral_order(points).tolist() == [5, 4, 3, 2, 1, 0, 6]


def test_symmetrised_sheets_are_symmetric(spark):
    """A sheet that is symmetric stays; a bump on one side is shared by both."""
    z = np.zeros(64)
    flat = np.stack([np.arange(64) % 8 - 3.5, np.arange(64) // 8, z], axis=1)
    bump = flat.copy()
    bump[26, 2] = 0.4
    marks = flat[[0, 7, 56, 63, 24, 31]] + [0, 0, 0.0]
    marks[4:, 2] = 1.0
    rows = lambda *x: spark.createDataFrame([(i, v.ravel().tolist()) for i, v in enumerate(x)], "cloud_id long, pos array<double>")
    out = {r.cloud_id: np.reshape(r.pos, (-1, 3)) for r in compose.symmetrise(rows(flat, bump), rows(marks, marks), sheet_faces(spark)).collect()}
    assert np.allclose(out[0], flat, atol=1e-9)
    assert 0.05 < out[1][26, 2] < 0.4 and out[1][29, 2] > 0.05


def test_correspondence_of_moved_copies(spark):
    """Copies of one sheet, turned, scaled and shifted, get the same shape back, and their sizes stand in proportion."""
    rng = np.random.default_rng(4)
    base = np.stack([np.arange(64) % 8, np.arange(64) // 8, 0.5 * np.sin(np.arange(64))], axis=1)
    shapes = []
    for k in range(3):
        q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
        shapes.append((base @ (q * np.sign(np.linalg.det(q)))) * (k + 1) + k)
    pack = lambda xs: spark.createDataFrame([(i, x.ravel().tolist()) for i, x in enumerate(xs)], "cloud_id long, pos array<double>")
    marks = [x[[0, 7, 56, 63, 27]] for x in shapes]
    rows = compose.correspond(pack(shapes), sheet_faces(spark), pack(marks)).orderBy("cloud_id").collect()
    found = [np.reshape(r.pos, (-1, 3)) for r in rows]
    assert len(rows) == 3 and all(r.status == "ok" and r.n_rejected == 0 and len(r.rejected) == 64 and r.iterations > 0 for r in rows)
    assert np.allclose(found[1], found[0], atol=0.02) and np.allclose(found[2], found[0], atol=0.02)
    assert rows[1].cs / rows[0].cs == pytest.approx(2, rel=0.02) and rows[2].cs / rows[0].cs == pytest.approx(3, rel=0.02)


def test_lost_clouds_are_rows(spark):
    """One mesh without numbers, one without extent and one without landmarks among good ones; a fence and a whitelist join in."""
    rng = np.random.default_rng(41)
    base = np.stack([np.arange(64) % 8, np.arange(64) // 8, 0.5 * np.sin(np.arange(64))], axis=1)
    shapes = [base + k + 0.01 * rng.normal(size=base.shape) for k in range(6)]
    marks = [x[[0, 7, 56, 63, 27]] for x in shapes]
    shapes[2] = shapes[2] * np.nan
    shapes[3] = shapes[3] * 0 + 1.0
    rows = lambda xs: spark.createDataFrame([(i, x.ravel().tolist()) for i, x in enumerate(xs)], "cloud_id long, pos array<double>")
    options = compose.CorrespondenceOptions(fence=1.5, most=0)
    found = compose.correspond(rows(shapes), sheet_faces(spark), rows(marks).where("cloud_id <> 4"), options)
    by_id = {r.cloud_id: r for r in found.collect()}
    assert {i: r.status for i, r in by_id.items()} == {0: "ok", 1: "ok", 2: "broken mesh", 3: "broken mesh", 4: "no landmarks", 5: "ok"}
    assert all((r.pos is None) == (r.status != "ok") for r in by_id.values())
    # With a whitelist of vertices that no cloud rejects, all clouds reject the same ones.
    assert len({tuple(r.rejected) for r in by_id.values() if r.status == "ok"}) == 1
    table = compose.result_table(found, rows(shapes).select("cloud_id", F.lit("x").alias("name")), rows(marks), restore=True, strict=1.0)
    assert sorted(r.cloud_id for r in table.collect()) == [0, 1, 5]
    sizes = {r.cloud_id: fits.centre_and_size(np.reshape(r.points, (-1, 3)))[1] / fits.centre_and_size(shapes[r.cloud_id])[1] for r in table.collect()}
    assert all(v == pytest.approx(1, rel=0.05) for v in sizes.values())


def test_unknown_columns_and_bad_literals_raise(spark):
    df = spark.createDataFrame([(1, True)], "row_index long, ok boolean")
    with pytest.raises(ValueError):
        t.predicate(df, "nothing", "eq", "x")
    with pytest.raises(ValueError):
        t.predicate(df, "row_index", "lt", "x")
    assert t.select_rows(df, ("ok", "eq", "True")).count() == 1 and t.select_rows(df, ("ok", "ne", "no")).count() == 1
    assert t.parse_column_ranges("1-3,5") == [0, 1, 2, 4] and t.parse_index_list("0, 2,x") == [0, 2]


def test_groups_of_equal_clouds_do_not_differ(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(6, 64, 3))
    df = spark.createDataFrame([(i, c.ravel().tolist(), 1.0 + i % 3) for i, c in enumerate(np.concatenate([x[:3], x[:3]]))], "cloud_id long, pos array<double>, cs double")
    a, b = df.where("cloud_id < 3"), df.where("cloud_id >= 3")
    for field in compose.FIELDS:
        rows = compose.compare_groups(a, b, sheet_faces(spark), field, form=field == "vertex_distance", register=field == "surface_distance").collect()
        assert len(rows) == 64 and all(abs(r.value - (field == "face_scaling")) < 1e-7 and r.rms < 1e-7 for r in rows)


def test_distance_matrix_gives_both_distances_in_one_pass_and_travels_in_few_blocks(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(fits, "BLOCK", 16)  # several comparisons a block
    clouds = landmark_clouds(spark, sf_dir).where("cloud_id % 5 = 0").withColumn("cloud_id", F.col("cloud_id") * F.col("cloud_id") - 999)
    both = fits.distance_matrix(clouds, align=True, shifted=True)
    found = {(r.a_id, r.b_id): (r.distance, r.shifted) for r in both.collect()}
    assert len(found) == 100 * 101 // 2 and all(a <= b for a, b in found)
    for k, turn in enumerate((True, False)):
        assert all(abs(found[r.a_id, r.b_id][k] - r.distance) < 1e-6 for r in fits.distance_matrix(clouds, align=True, turn=turn).collect())
    monkeypatch.setattr(fits, "SPREAD", 3)
    packed, n = fits._blocked(clouds)
    assert n == 3 and packed.count() == 3


@pytest.mark.parametrize("name", ["procrustes_matrix_bounds", "masked_aligned_matrix"])
def test_matrices_of_pairs_are_not_joined(spark, sf_dir, name):
    plan = queries.QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1


@pytest.mark.parametrize("name", ["procrustes_matrix", "procrustes_raw_matrix", "masked_raw_matrix"])
def test_clouds_travel_once_for_all_pairs(spark, sf_dir, name):
    """Pairs of blocks read what one exchange by blocks left; no copy of a block is shuffled to a pair."""
    plan = queries.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "hashpartitioning" not in plan


def test_few_shared_faces_meet_their_points_directly_with_the_same_results(spark, monkeypatch):
    """Against the grid; a mesh lacks a coordinate, another a vertex, points lie in several blocks, some have no normal."""
    rng = np.random.default_rng(21)
    shapes = [rng.normal(size=(12, 3)).ravel().tolist() for _ in range(4)]
    shapes[1][7], shapes[2] = None, shapes[2][:33]
    meshes = spark.createDataFrame([(m, p) for m, p in enumerate(shapes)], "mesh_id long, pos array<double>")
    faces = spark.createDataFrame([(7 - f, *map(int, rng.choice(12, 3, replace=False))) for f in range(8)], "face_id int, i0 int, i1 int, i2 int")
    fields = ("x", "y", "z", "nx", "ny", "nz")
    rows = [(m, 5 * i, *map(float, rng.normal(size=3)), *([None] * 3 if i % 9 == 0 else [0.0] * 3 if i % 9 == 1 else map(float, rng.normal(size=3)))) for m in range(5) for i in range(120)]
    points = spark.createDataFrame(rows, "mesh_id long, point_id long, " + ", ".join(f"{c} double" for c in fields))
    rays = points.select("mesh_id", "point_id", "x", "y", "z", *[F.col(f"n{c}").alias(f"d{c}") for c in "xyz"])
    cases = [lambda: spatial.nearest_triangle(points, meshes, faces), lambda: spatial.nearest_triangle(points, meshes, faces, 0.4), lambda: spatial.raycast(rays, meshes, faces), lambda: spatial.project(points, meshes, faces)]
    for case in cases:
        direct = {(r.mesh_id, r.point_id): r for r in case().collect()}
        with monkeypatch.context() as patch:
            patch.setattr(spatial, "FEW", 2)
            grid = {(r.mesh_id, r.point_id): r for r in case().collect()}
        assert direct.keys() == grid.keys() and len(grid) > 50
        for key, r in grid.items():
            assert all(direct[key][n] == pytest.approx(r[n], abs=1e-12) for n in r.asDict())


def test_pairs_settle_together_as_they_do_alone():
    rng = np.random.default_rng(4)
    a, b = rng.normal(size=(2, 9, 6, 3))
    together = compose._align_pairs(a, b)
    for i in range(9):
        for many, one, x in zip(together, compose._align_pairs(a[i : i + 1], b[i : i + 1]), (a, b), strict=True):
            assert all(np.allclose(m[i], o[0], atol=1e-9) for m, o in zip(many, one, strict=True))
    fitted = [fits._applied(x, *f) for x, f in zip((a, b), together, strict=True)]
    assert np.allclose(fitted[0].mean(axis=1), 0) and np.allclose(fitted[1].mean(axis=1), 0)


def test_rejected_vertices_are_flagged_in_packed_clouds(spark):
    """A vertex without a place closes up; what one cloud lost is flagged there, what all lose everywhere."""
    clouds = spark.createDataFrame([(1, [float(v) for v in range(12)]), (2, [1.0, 2.0, 3.0, None, None, None, 7.0, 8.0, 9.0]), (3, [0.0] * 6)], "cloud_id long, pos array<double>")
    bad = spark.createDataFrame([(1, 0), (1, 2), (2, 2)], "cloud_id long, vertex_id int")
    found = {r.cloud_id: (len(r.pos), r.rejected, r.n_rejected) for r in compose._flagged(clouds, bad, [3]).collect()}
    assert found == {1: (12, [True, False, True, True], 3), 2: (6, [False, True], 1), 3: (6, [False, False], 0)}


def test_correspondence_joins_no_vertices_to_their_flags(spark, sf_dir, monkeypatch):
    """Projected clouds are packed before they are judged, so only rejected vertices are shuffled by number."""
    plans, written = [], compose.written

    def kept(df, *by):
        plans.append((df.columns, df._jdf.queryExecution().optimizedPlan().toString()))
        return written(df, *by)

    monkeypatch.setattr(compose, "written", kept)
    queries.QUERIES["dense_correspondence"](spark, sf_dir)
    (judged,) = [plan for columns, plan in plans if "rejection_rate" in columns]
    assert not [line for line in judged.splitlines() if "Join" in line and "vertex_id" in line]
