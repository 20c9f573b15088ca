"""Readers and writers on files that the tests write."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from allometra import cli
from allometra.operators import clouds, table, topology
from allometra.plans import queries
from allometra.sources import catalog, meshes, text


def test_delimited_text(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,name;size\n1,"a,b";2.5\n\n,,x\n"q"\n')
    rows = text.read_delimited(spark, str(tmp_path), ",;", skip_first=True)
    assert [r.cells for r in rows.orderBy("row_index").collect()] == [["1", "a,b", "2.5"], ["", "", "x"], ["q"]]
    fields = [text.Field("id", "integer", 0), text.Field("name", "string", 1), text.Field("size", "real", 2), text.Field("f", "factor", 2, ("x",)), text.Field("ok", "boolean", 1)]
    assert [tuple(r) for r in text.typed(rows.orderBy("row_index"), fields).collect()] == [(1, "a,b", 2.5, None, False), (0, "", 0.0, "x", False), (0, "", 0.0, None, False)]
    links = spark.createDataFrame([([r"a\b.OBJ"],), (["c.doc"],)], "cells array<string>")
    assert [r.link for r in text.typed(links, [text.Field("link", "reference", 0)]).collect()] == [("a/b.OBJ", "obj"), None]


def test_lines_of_split_files(spark, tmp_path):
    for name, n in (("a.txt", 1000), ("b.txt", 10)):
        (tmp_path / name).write_text("\n".join(f"{name}{i}" for i in range(n)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        found = text.lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(found) == 1010 and all(r.value == f"{r.path[-5:]}{r.line_index}" for r in found)


def test_floats(spark):
    rows = spark.createDataFrame([("",), ("3.14",), ("1.0;2.8;3.4",), ("1;x",)], "t string")
    assert [r.v for r in rows.select(text.floats(F.col("t"), ";").alias("v")).collect()] == [[], [3.14], [1.0, 2.8, 3.4], [1.0, None]]


def test_landmark_files(spark, tmp_path):
    (tmp_path / "good.txt").write_text("a\t1\t2\t3\nno tab\nb\t4\t5\t6.5\n")
    (tmp_path / "plane.txt").write_text("a\t1\t2\n")
    (tmp_path / "jagged.txt").write_text("a\t1\t2\nb\t1\t2\t3\n")
    vertices, errors = text.read_landmarks(spark, str(tmp_path))
    found = sorted((r.path.rsplit("/", 1)[1], r.vertex_id, r.x, r.y, r.z) for r in vertices.collect())
    assert found == [("good.txt", 0, 1.0, 2.0, 3.0), ("good.txt", 1, 4.0, 5.0, 6.5), ("plane.txt", 0, 1.0, 2.0, None)]
    assert [(r.path.rsplit("/", 1)[1], r.message) for r in errors.collect()] == [("jagged.txt", "lines of different length")]


def test_obj_files(spark, tmp_path):
    (tmp_path / "a.obj").write_text("# c\nv 0 0 0\nv 1 0 0\r\nv 0 1 0\nv 0 0 1\nvn 0 0 1\nvt 0 0\nf 1//1 2//1 3//1 4//1\nf 1/1 3 4\n")
    (tmp_path / "b.obj").write_text("v 0 0 0\nvp 1\n")
    (tmp_path / "c.obj").write_text("v 0 0 0\nf 1 2 3\n")
    vertices, faces, errors = meshes.read_obj(spark, str(tmp_path))
    assert [(r.vertex_id, r.x, r.y, r.z) for r in vertices.orderBy("vertex_id").collect()] == [(0, 0, 0, 0), (1, 1, 0, 0), (2, 0, 1, 0), (3, 0, 0, 1)]
    assert [(r.i0, r.i1, r.i2) for r in faces.orderBy("face_id").collect()] == [(0, 1, 2), (0, 2, 3)]
    assert {r.path[-5:]: r.message for r in errors.collect()} == {"b.obj": "unknown line: vp 1", "c.obj": "a corner names no vertex"}
    vertices, faces, _ = meshes.read_obj(spark, str(tmp_path), unshared=True)
    rows = vertices.orderBy("vertex_id").collect()
    assert [(r.x, r.nz) for r in rows] == [(0, 1), (1, 1), (0, 1), (0, None), (0, None), (0, None)]
    assert [(r.i0, r.i1, r.i2) for r in faces.orderBy("face_id").collect()] == [(0, 1, 2), (3, 4, 5)]


def ply(points, faces, form="binary_little_endian", extra=b""):
    head = f"ply\nformat {form} 1.0\nelement vertex {len(points)}\nproperty float x\nproperty float y\nproperty float z\nproperty uchar q\n"
    head += f"element face {len(faces)}\nproperty list uchar int vertex_indices\nend_header\n"
    body = b"".join(struct.pack("<fffB", *p, 7) for p in points) + b"".join(struct.pack("<Biii", 3, *f) for f in faces)
    return head.encode() + body + extra


def test_ply_files(spark, tmp_path):
    points, faces = [(0, 0, 0), (1, 0, 0), (0, 1.5, 0)], [(0, 1, 2), (2, 1, 0)]
    (tmp_path / "a.ply").write_bytes(ply(points, faces))
    (tmp_path / "b.ply").write_bytes(ply(points, faces, "ascii"))
    (tmp_path / "c.ply").write_bytes(ply(points, faces)[:-3])
    vertices, found, errors = meshes.read_ply(spark, str(tmp_path))
    assert [(r.x, r.y, r.z, r.nx) for r in vertices.orderBy("vertex_id").collect()] == [(*p, None) for p in points]
    assert [(r.i0, r.i1, r.i2) for r in found.orderBy("face_id").collect()] == faces
    assert {r.path[-5:] for r in errors.collect()} == {"b.ply", "c.ply"}


@pytest.mark.parametrize("encoding", [meshes.FLOAT, meshes.FIXED])
def test_chunked_files(spark, tmp_path, encoding):
    rng = np.random.default_rng(2)
    x, faces = rng.normal(size=(50, 3)).astype("f4"), rng.integers(0, 50, (20, 3))
    df = spark.createDataFrame([(5, x.astype(float).ravel().tolist())], "cloud_id long, pos array<double>")
    (row,) = meshes.to_chunked(df, faces, encoding).collect()
    (tmp_path / "a.bin").write_bytes(row.content)
    (tmp_path / "b.bin").write_bytes(b"12345678")
    vertices, found, errors = meshes.read_chunked(spark, str(tmp_path))
    got = np.array([(r.x, r.y, r.z) for r in vertices.orderBy("vertex_id").collect()])
    assert np.abs(got - x).max() <= (0 if encoding == meshes.FLOAT else np.ptp(x, axis=0).max() / 65535 * 1.01)
    assert np.array_equal([(r.i0, r.i1, r.i2) for r in found.orderBy("face_id").collect()], faces)
    assert errors.count() == 1
    matrix = rng.normal(size=(4, 3)).astype("f4")
    content = meshes.compose_chunked([(2, meshes.FLOAT, matrix.T.reshape(4, 3))])
    assert np.array_equal(meshes.parse_matrices(content)[2], matrix)


def test_projects(spark, tmp_path):
    base = spark.createDataFrame([(0, "a", 1.0), (1, "b", 2.0)], "row_index long, name string, size double")
    result = spark.createDataFrame([(1, 5.0), (0, 4.0)], "row_index long, cs double")
    path = str(tmp_path / "p")
    entries = [{"id": 1, "name": "specimens", "kind": "specimens", "table": "base"}, {"id": 2, "name": "fit", "kind": "correspondence", "deps": [1], "table": "result"}]
    catalog.save_project(spark, path, {"base": base, "result": result}, entries)
    assert [r.name for r in catalog.entries(spark, path, "correspondence").collect()] == ["fit"]
    assert [(r.row_index, r.cs, r.name) for r in catalog.full_table(spark, path, 2).orderBy("row_index").collect()] == [(0, 4.0, "a"), (1, 5.0, "b")]
    assert catalog.columns_of(spark, path).where("type = 'double'").count() == 2
    refs = spark.createDataFrame([(7, "x.obj", True), (8, "y.obj", False)], "ref_id long, file string, internal boolean")
    links = spark.createDataFrame([(0, 7), (1, None), (2, 9)], "row_index long, mesh long")
    assert [r.file for r in catalog.dereference(links, "mesh", refs, "file").orderBy("row_index").collect()] == ["x.obj", None, None]
    assert tuple(catalog.reference_statistics(refs).first()) == (2, 1)


@pytest.mark.parametrize(("make", "counts", "area"), [(catalog.cube, (8, 12), 24.0), (catalog.icosahedron, (12, 20), 20 * 3**0.5)])
def test_generated_meshes(spark, make, counts, area):
    vertices, faces = make(spark)
    assert (vertices.count(), faces.count()) == counts
    assert topology.boundary(faces).isEmpty()
    areas = clouds.face_areas(vertices, faces)
    assert areas.agg(F.sum("area")).first()[0] == pytest.approx(area)
    # Faces look outward, so normals do.
    normals = topology.normals(areas).join(vertices, ["cloud_id", "vertex_id"])
    assert normals.where("nx * x + ny * y + nz * z <= 0").isEmpty()


def test_cells_with_line_ends(spark, tmp_path):
    rows = [(1, "a\nb", "z"), (2, "plain", 'q"x'), (3, "\n\n;x", "y"), (4, "ends\n", ""), (5, 'it""s', "w")]
    df = spark.createDataFrame(rows, "i int, t string, u string")
    text.write_delimited(df.coalesce(1), str(tmp_path / "t"), ";")
    found = [r.cells for r in text.read_delimited(spark, str(tmp_path / "t"), ";", skip_first=True, skip_empty=False).orderBy("row_index").collect()]
    assert found == [["1", "a\nb", "z"], ["2", "plain", "q'x"], ["3", "\n\n;x", "y"], ["4", "ends\n", ""], ["5", "it''s", "w"]]
    (tmp_path / "odd.csv").write_text('5" pipe,x\n"open,\nstill" rest,y\n"a","b"\n"never closed,z\n')
    found = [r.cells for r in text.read_delimited(spark, str(tmp_path / "odd.csv")).orderBy("row_index").collect()]
    assert found == [['5" pipe', "x"], ["open,\nstill rest", "y"], ["a", "b"], ["never closed,z"]]


def test_areas_where_numbers_are_missing(spark, monkeypatch):
    points = [(1, 0, 0.0, 0.0, 0.0), (1, 2, 1.0, 0.0, 0.0), (1, 3, 0.0, 1.0, 0.0), (1, 4, 5.0, 5.0, 5.0), (2, 4, 1.0, 1.0, 1.0)]
    vertices = spark.createDataFrame(points, "cloud_id long, vertex_id int, x double, y double, z double")
    faces = spark.createDataFrame([(0, 0, 2, 3), (1, 1, 2, 3)], "face_id int, i0 int, i1 int, i2 int")
    for most in (clouds.MAX_FACES, 0):
        monkeypatch.setattr(clouds, "MAX_FACES", most)
        assert [(r.cloud_id, r.face_id, r.area) for r in clouds.face_areas(vertices, faces).collect()] == [(1, 0, 0.5)]
        assert sorted(tuple(r) for r in topology.normals(clouds.face_areas(vertices, faces)).select("vertex_id", "nz").collect()) == [(0, 1.0), (2, 1.0), (3, 1.0)]


def test_empty_cloud_in_fixed_point():
    content = meshes.compose_chunked([(meshes.POSITION, meshes.FIXED, np.zeros((0, 3)))])
    vertices, faces = meshes.parse_chunked(content)
    assert len(vertices) == 0 and len(faces) == 0


def test_a_failed_save_leaves_the_project(spark, tmp_path):
    path, entry = str(tmp_path / "p"), {"id": 1, "name": "specimens", "kind": "specimens", "table": "base"}
    old = table.declare(spark.createDataFrame([(0, "a"), (1, "b")], "row_index long, sex string"), "sex", "factor", ["b", "a", "c"])
    catalog.save_project(spark, path, {"base": old}, [entry])
    broken = spark.createDataFrame([(0, "x")], "row_index long, sex string").withColumn("sex", F.raise_error(F.lit("stop")).cast("string"))
    with pytest.raises(Exception, match="stop"):
        catalog.save_project(spark, path, {"base": old.where("row_index = 0"), "other": broken}, [entry])
    found = catalog.entry_table(spark, path, 1)
    assert found.count() == 2 and table.declared_levels(found, "sex") == ["b", "a", "c"] and table.columns_of_role(found, "factor", "mesh") == ["sex"]
    catalog.save_project(spark, path, {"base": old.where("row_index = 0")}, [entry])
    assert catalog.entry_table(spark, path, 1).count() == 1
    with pytest.raises(ValueError):
        catalog.entries(spark, str(tmp_path / "nothing"))


def test_formats_by_name(spark, tmp_path):
    (tmp_path / "a.chunked").write_bytes(meshes.compose_chunked([(meshes.POSITION, meshes.FLOAT, np.eye(3)), (meshes.INDICES, meshes.TRIPLES, np.array([[0, 1, 2]]))]))
    (tmp_path / "b.chunked").write_bytes(b"broken")
    vertices, faces, errors = meshes.read_meshes(spark, str(tmp_path), "chunked")
    assert [tuple(r)[2:5] for r in vertices.orderBy("vertex_id").collect()] == [(1, 0, 0), (0, 1, 0), (0, 0, 1)]
    assert [tuple(r)[2:] for r in faces.collect()] == [(0, 1, 2)] and errors.count() == 1
    (tmp_path / "marks").mkdir()
    (tmp_path / "marks" / "m.txt").write_text("a\t1\t2\t3\nb\t4\t5\t6\n")
    vertices, faces, _ = meshes.read_meshes(spark, str(tmp_path / "marks"), "landmarks")
    assert vertices.count() == 2 and faces.isEmpty()
    with pytest.raises(ValueError):
        meshes.read_meshes(spark, str(tmp_path), "stl")


def test_command_line(spark, tmp_path):
    path, said = str(tmp_path / "p"), []
    base = spark.createDataFrame([(0, "a"), (1, "b")], "row_index long, name string")
    found = spark.createDataFrame([(0, "ok"), (1, "broken mesh")], "row_index long, status string")
    entries = [{"id": 1, "name": "people", "kind": "specimens", "table": "base"}, {"id": 2, "name": "fit", "kind": "correspondence", "deps": [1], "table": "found", "options": {"low": 0.25, "fence": None}}]
    catalog.save_project(spark, path, {"base": base, "found": found}, entries)
    cli.run(spark, ["-o", path, "-i", "--list", "kind=correspondence", "-r", "2", "-e", "2", str(tmp_path / "out"), "separator=;"], said.append)
    assert said[0].endswith("version 1") and said[1:4] == ["correspondence\t1", "specimens\t1", "2\tcorrespondence\tfit\t1"]
    assert {"settings\toptions.fence\tnone", "settings\toptions.low\t0.25", "table\trows\t2", "status\tbroken mesh\t1", "entry\tdepends on\t#1"} <= set(said)
    rows = text.read_delimited(spark, str(tmp_path / "out"), ";").collect()
    assert ["0", "ok", "a"] in [r.cells for r in rows]
    for wrong in (["-x"], ["lost"], ["-l"], ["-o", str(tmp_path / "none")], ["-o", path, "-r"], ["-o", path, "-r", "9"]):
        with pytest.raises(ValueError):
            cli.run(spark, wrong, said.append)


def test_landmark_files_are_read_once(spark, tmp_path):
    """A file is a row: no shuffle by path, whatever ends its lines; the files are opened once for both tables."""
    (tmp_path / "a.txt").write_bytes(b"point 0\t1\t2\t3\r\nno tab\npoint 1\t4\t5\t6\rpoint 2\t7\t8\t9")
    (tmp_path / "b.txt").write_text("p\t1\t2\np\t3\n")
    vertices, errors = text.read_landmarks(spark, str(tmp_path))
    assert sorted((r.vertex_id, r.x, r.y, r.z) for r in vertices.collect()) == [(0, 1.0, 2.0, 3.0), (1, 4.0, 5.0, 6.0), (2, 7.0, 8.0, 9.0)]
    assert [r.message for r in errors.collect()] == ["lines of different length"]
    assert "Exchange" not in vertices._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name, form", [("obj_round_trip", "obj"), ("landmark_files_round_trip", "landmarks")])
def test_many_small_texts_lie_in_few_files(spark, sf_dir, tmp_path, monkeypatch, name, form):
    """No folder a cloud: files are as many as tasks, whatever the clouds; every split begins with a page of its own."""
    monkeypatch.setattr(queries, "scratch_folder", lambda _: str(tmp_path / "pages"))
    first = sorted(map(tuple, queries.QUERIES[name](spark, sf_dir).collect()))
    assert 0 < len(list((tmp_path / "pages").glob("**/part-*"))) <= 8
    monkeypatch.setattr(queries, "scratch_folder", lambda _: str(tmp_path / "again"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7001b")
    try:
        assert sorted(map(tuple, queries.QUERIES[name](spark, sf_dir).collect())) == first
        assert spark.read.text(str(tmp_path / "pages"), lineSep=text.PAGE).rdd.getNumPartitions() > 8
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_pages_are_meshes_of_their_own(spark, tmp_path):
    rows = [("a", "v 0 0 0\nv 1 0 0\r\nv 0 1 0\nf 1 2 3"), ("b", "v 0 0 0\nf 1 2 3\n"), ("c", "v 5 0 0"), ("d", "")]
    text.write_pages(spark.createDataFrame(rows, "name string, value string").coalesce(1), str(tmp_path / "p"))
    vertices, faces, errors = meshes.read_obj(spark, str(tmp_path / "p"), paged=True)
    assert sorted((r.path.rsplit("#", 1)[1], r.vertex_id, r.x) for r in vertices.collect()) == [("a", 0, 0.0), ("a", 1, 1.0), ("a", 2, 0.0), ("c", 0, 5.0)]
    assert [(r.path[-2:], r.i2) for r in faces.collect()] == [("#a", 2)]
    assert [(r.path[-2:], r.message) for r in errors.collect()] == [("#b", "a corner names no vertex")]
    for odd in (("e", "v 0\f0 0"), ("e\n", "v 0 0 0"), (None, "")):
        with pytest.raises(Exception, match="form feed"):
            text.write_pages(spark.createDataFrame([odd], "name string, value string"), str(tmp_path / f"odd{odd[0]}{odd[1][:3]}"))
    with pytest.raises(ValueError):
        meshes.read_meshes(spark, str(tmp_path), "ply", paged=True)
