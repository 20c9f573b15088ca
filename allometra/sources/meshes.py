"""Mesh files in and out: Wavefront OBJ, binary PLY and the chunked binary format.

A file is a row; what is in it leaves as rows of vertices and faces. Readers return errors as a table of their own, so that one
broken file does not stop the others.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from allometra.sources import text
from allometra.sources.scratch import written

XYZ = ("x", "y", "z")
NORMAL = ("nx", "ny", "nz")
_VERTEX = "path string, vertex_id int, x double, y double, z double, nx double, ny double, nz double"
_FACE = "path string, face_id int, i0 int, i1 int, i2 int"


# OBJ, in DataFrame operations


def _numbers(line: Column) -> Column:
    return F.transform(F.slice(F.split(F.trim(line), r"\s+"), 2, 3), lambda t: t.try_cast("double"))


def read_obj(spark: SparkSession, path: str, unshared: bool = False, paged: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """vertices (path, vertex_id, x, y, z, nx, ny, nz), faces (path, face_id, i0, i1, i2) and errors (path, message) of OBJ files.

    Numbers begin at 0. A face is its first three corners. ``unshared`` gives each corner a vertex of its own, with the normal that the
    face names; otherwise vertices are as listed, without normals. A line of ``v`` that is no vertex, normal or texture place, a number that
    does not parse and a corner that names no vertex are errors, and such a file gives no rows. ``paged`` files hold many meshes (``text.texts``),
    each with numbers of its own, and a page counts as a file.
    """
    files = text.texts(spark, path, paged).select("path", F.split("value", r"\r?\n").alias("lines"))
    pick = lambda pattern: F.filter("lines", lambda line: line.rlike(pattern))
    corner = lambda t: F.transform(F.split(t, "/"), lambda p: p.try_cast("int"))
    tokens = lambda line: F.transform(F.slice(F.split(F.trim(line), r"\s+"), 2, 3), corner)
    parsed = files.select(
        "path",
        F.transform(pick(r"^\s*v\s"), _numbers).alias("v"),
        F.transform(pick(r"^\s*vn\s"), _numbers).alias("n"),
        F.transform(pick(r"^\s*f\s"), tokens).alias("f"),
        pick(r"^\s*v(?!(n|t)?\s)").alias("odd"),
    )
    broken = lambda rows: F.exists(rows, lambda r: (F.size(r) != 3) | F.exists(r, lambda x: x.isNull()))
    outside = F.exists("f", lambda f: (F.size(f) != 3) | F.exists(f, lambda c: F.coalesce((c[0] < 1) | (c[0] > F.size("v")), F.lit(True))))
    message = F.when(F.size("odd") > 0, F.concat(F.lit("unknown line: "), F.get("odd", F.lit(0)))).when(broken("v") | broken("n"), "not three numbers").when(outside, "a corner names no vertex")
    judged = written(parsed.withColumn("message", message))  # read and parsed once for all three tables
    good = judged.where("message IS NULL")
    errors = judged.where("message IS NOT NULL").select("path", "message")
    if not unshared:
        rows = good.select("path", F.posexplode("v").alias("vertex_id", "p"))
        vertices = rows.select("path", "vertex_id", *[F.get("p", F.lit(k)).alias(c) for k, c in enumerate(XYZ)], *[F.lit(None).cast("double").alias(c) for c in NORMAL])
        faces = good.select("path", F.posexplode("f").alias("face_id", "c")).select("path", "face_id", *[(F.get("c", F.lit(k))[0] - 1).alias(f"i{k}") for k in range(3)])
        return vertices, faces, errors
    at = lambda c: F.struct(F.get("v", c[0] - 1).alias("p"), F.get("n", F.get(c, F.lit(2)) - 1).alias("n"))
    rows = good.select("path", F.posexplode(F.transform(F.flatten("f"), at)).alias("vertex_id", "c"))
    vertices = rows.select("path", "vertex_id", *[F.get("c.p", F.lit(k)).alias(c) for k, c in enumerate(XYZ)], *[F.get("c.n", F.lit(k)).alias(c) for k, c in enumerate(NORMAL)])
    faces = good.select("path", F.explode(F.sequence(F.lit(0), F.size("f") - 1)).alias("face_id")).select("path", "face_id", *[(F.col("face_id") * 3 + k).alias(f"i{k}") for k in range(3)])
    return vertices, faces, errors


# Binary files: parse(bytes) gives vertices (n, 6; normals may be NaN) and faces (m, 3), or raises ValueError


_PARTS = f"kind string, {_VERTEX}, face_id int, i0 int, i1 int, i2 int, message string"
_PARTS_ARROW = pa.schema(
    [("kind", pa.string()), ("path", pa.string()), ("vertex_id", pa.int32()), *((n, pa.float64()) for n in (*XYZ, *NORMAL)), *((n, pa.int32()) for n in ("face_id", "i0", "i1", "i2")), ("message", pa.string())]
)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Batches in parts of some rows, so that what a task makes of them at once does not grow with its input."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _rows(kind: str, path: str, n: int, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    columns |= {"kind": pa.array([kind] * n, pa.string()), "path": pa.array([path] * n, pa.string())}
    return pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.nulls(n, f.type) for f in _PARTS_ARROW], schema=_PARTS_ARROW)


def _parsed(files: DataFrame, parse: Callable[[bytes], tuple[np.ndarray, np.ndarray]]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """vertices, faces and errors of files, each read and parsed once: the parts are written by kind, and a table reads its own kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                try:
                    vertices, faces = parse(content.as_py() or b"")
                except (ValueError, struct.error) as error:
                    yield _rows("error", path, 1, {"message": pa.array([str(error)])})
                    continue
                places = {c: pa.array(np.ascontiguousarray(v), pa.float64(), mask=np.isnan(v)) for c, v in zip((*XYZ, *NORMAL), vertices.T)}
                yield _rows("vertex", path, len(vertices), {"vertex_id": pa.array(np.arange(len(vertices), dtype=np.int32)), **places})
                ends = {f"i{k}": pa.array(np.ascontiguousarray(f), pa.int32()) for k, f in enumerate(faces.T)}
                yield _rows("face", path, len(faces), {"face_id": pa.array(np.arange(len(faces), dtype=np.int32)), **ends})

    parts = written(files.select("path", "content").mapInArrow(run, _PARTS), "kind")
    of = lambda kind, *names: parts.where(F.col("kind") == kind).select("path", *names)
    return of("vertex", "vertex_id", *XYZ, *NORMAL), of("face", "face_id", "i0", "i1", "i2"), of("error", "message")


# Sizes of PLY's number types.
PLY_TYPES = {"char": "i1", "uchar": "u1", "short": "<i2", "ushort": "<u2", "int": "<i4", "uint": "<u4", "float": "<f4", "double": "<f8", "int8": "i1", "uint8": "u1", "int16": "<i2", "uint16": "<u2", "int32": "<i4", "uint32": "<u4", "float32": "<f4", "float64": "<f8"}


def parse_ply(content: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Vertices and triangles of a binary little-endian PLY file; other elements are passed over, other faces than triangles are errors."""
    head, mark, body = content.partition(b"end_header\n")
    if not mark or not head.startswith(b"ply"):
        raise ValueError("no PLY header")
    elements: list[tuple[str, int, list[list[str]]]] = []
    for words in (line.split() for line in head.decode("ascii", "replace").splitlines()):
        if words[:1] == ["format"] and words[1:2] != ["binary_little_endian"]:
            raise ValueError("not binary little-endian")
        if words[:1] == ["element"]:
            elements.append((words[1], int(words[2]), []))
        elif words[:1] == ["property"]:
            elements[-1][2].append(words[1:])
    vertices, faces, at = np.zeros((0, 6)), np.zeros((0, 3), dtype=np.int32), 0
    for name, n, properties in elements:
        fields = []
        for p in properties:
            if p[0] == "list":
                fields += [(f"#{p[3]}", PLY_TYPES[p[1]]), (p[3], PLY_TYPES[p[2]], (3,))]
            else:
                fields.append((p[1], PLY_TYPES[p[0]]))
        kind = np.dtype(fields)
        if len(body) < at + n * kind.itemsize:
            raise ValueError(f"too few bytes for {name}, or lists that are no triangles")
        rows = np.frombuffer(body, kind, n, at)
        if any((rows[c] != 3).any() for c in kind.names or () if c.startswith("#")):
            raise ValueError(f"{name}: lists that are no triangles")
        at += n * kind.itemsize
        if name == "vertex":
            vertices = np.stack([rows[c].astype(float) if c in kind.names else np.full(n, np.nan) for c in (*XYZ, *NORMAL)], axis=1)
        elif name == "face":
            faces = rows[next(c for c in kind.names if c in ("vertex_indices", "vertex_index"))].astype(np.int32)
    return vertices, faces


def read_ply(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """vertices, faces and errors of binary PLY files, as ``read_obj`` gives them."""
    return _parsed(spark.read.format("binaryFile").load(path), parse_ply)


# The chunked format: a header, one record for each chunk, then the chunks' bytes one after the other.
# Magic number, what a chunk holds and how it is written.
MAGIC = 0xBADCACA0
POSITION, NORMALS, TEXTURE, INDICES, SCALAR = 1, 2, 3, 4, 5
RAW, TRIPLES, FLOAT, FIXED, NORMALISED, INTEGER = 0, 1, 2, 3, 4, 5
_HEADER, _CHUNK = struct.Struct("<IHH"), struct.Struct("<qiiihh")


def _decode(body: bytes, at: int, rows: int, columns: int, encoding: int) -> tuple[np.ndarray, int]:
    n = rows * columns
    if encoding in (FLOAT, INTEGER):
        return np.frombuffer(body, "<f4" if encoding == FLOAT else "<i4", n, at).reshape(rows, columns), at + 4 * n
    if encoding == TRIPLES:
        return np.frombuffer(body, "<i4", 3 * n, at).reshape(-1, 3), at + 12 * n
    if encoding == NORMALISED:
        return np.frombuffer(body, "<u2", n, at).reshape(rows, columns) / 65535.0, at + 2 * n
    if encoding == FIXED:
        low, high = np.frombuffer(body, "<f4", 2 * columns, at).reshape(columns, 2).astype(float).T
        codes = np.frombuffer(body, "<u2", n, at + 8 * columns).reshape(rows, columns)
        return codes * ((high - low) / 65535.0) + low, at + 8 * columns + 2 * n
    raise ValueError(f"no encoding {encoding}")


def _chunks(content: bytes) -> Iterator[tuple[int, int, np.ndarray]]:
    magic, _, n = _HEADER.unpack_from(content)
    if magic != MAGIC:
        raise ValueError("not a chunked file")
    at = _HEADER.size + n * _CHUNK.size
    for k in range(n):
        _, _, columns, rows, semantic, encoding = _CHUNK.unpack_from(content, _HEADER.size + k * _CHUNK.size)
        values, at = _decode(content, at, rows, columns, encoding)
        yield semantic, encoding, values


def parse_chunked(content: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Vertices and triangles of a chunked file; normals are optional, texture places and scalars are passed over."""
    found = {semantic: values for semantic, _, values in _chunks(content)}
    position = found.get(POSITION, np.zeros((0, 3)))
    normals = found.get(NORMALS, np.full((len(position), 3), np.nan))
    if position.shape[1] != 3 or len(normals) != len(position):
        raise ValueError("segments of different length")
    return np.hstack([position, normals]).astype(float), found.get(INDICES, np.zeros((0, 3))).astype(np.int32)


def parse_matrices(content: bytes) -> dict[int, np.ndarray]:
    """Matrices of a chunked file by their key; they are written column by column."""
    return {semantic & 0xFFF: values.reshape(-1).reshape(values.shape[1], values.shape[0]).T for semantic, _, values in _chunks(content)}


def _encode(values: np.ndarray, encoding: int) -> bytes:
    if encoding == FLOAT:
        return values.astype("<f4").tobytes()
    if encoding == FIXED:
        values = values.astype("<f4").astype(float)
        low, high = (values.min(axis=0), values.max(axis=0)) if len(values) else (np.zeros(values.shape[1]),) * 2
        scale = 65535.0 / np.where(high > low, high - low, np.inf)
        return np.stack([low, high], axis=1).astype("<f4").tobytes() + np.floor((values - low) * scale).astype("<u2").tobytes()
    if encoding == NORMALISED:
        return np.floor(np.clip(values, 0, 1) * 65535.0).astype("<u2").tobytes()
    if encoding == TRIPLES:
        return values.astype("<i4").tobytes()
    raise ValueError(f"no encoding {encoding}")


def compose_chunked(chunks: list[tuple[int, int, np.ndarray]]) -> bytes:
    """A chunked file of chunks (semantic, encoding, values); ``FIXED`` scales each column to its range and truncates."""
    head, body = _HEADER.pack(MAGIC, 1, len(chunks)), b""
    start = _HEADER.size + len(chunks) * _CHUNK.size
    for semantic, encoding, values in chunks:
        columns = 1 if encoding == TRIPLES else values.shape[1]
        head += _CHUNK.pack(start, values.size * 4, columns, len(values), semantic, encoding)
        body += _encode(values, encoding)
    return head + body


def read_chunked(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """vertices, faces and errors of chunked binary files, as ``read_obj`` gives them."""
    return _parsed(spark.read.format("binaryFile").load(path), parse_chunked)


#: Parsers of binary formats by name; a further format is one more entry.
PARSERS: dict[str, Callable[[bytes], tuple[np.ndarray, np.ndarray]]] = {"ply": parse_ply, "chunked": parse_chunked}


def from_bytes(files: DataFrame, form: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """vertices, faces and errors of files that are rows already (path, content), of a format in ``PARSERS``."""
    return _parsed(files, PARSERS[form])


def read_meshes(spark: SparkSession, path: str, form: str, paged: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """vertices (path, vertex_id, x, y, z, nx, ny, nz), faces (path, face_id, i0, i1, i2) and errors (path, message) of the files of one format.

    ``form``: obj, landmarks, or one of ``PARSERS``. Spark's own readers open the files, wherever they lie, so paths may be
    in any store that Spark reaches. An unknown format is an error, and so are pages (``text.texts``) of binary files.
    """
    if form == "obj":
        return read_obj(spark, path, paged=paged)
    if form == "landmarks":
        vertices, errors = text.read_landmarks(spark, path, paged)
        nothing = [F.lit(None).cast("double").alias(c) for c in NORMAL]
        return vertices.select("path", "vertex_id", *XYZ, *nothing), spark.createDataFrame([], _FACE), errors
    if form not in PARSERS or paged:
        raise ValueError(f"no {'paged ' * paged}format {form}")
    return _parsed(spark.read.format("binaryFile").load(path), PARSERS[form])


def to_chunked(meshes: DataFrame, faces: np.ndarray | None = None, encoding: int = FLOAT) -> DataFrame:
    """cloud_id and content: each packed cloud (cloud_id, pos) as a chunked file, with the faces that all of them share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out = []
            for pos in batch.column("pos"):
                chunks = [(POSITION, encoding, pos.values.to_numpy(zero_copy_only=False).reshape(-1, 3))]
                out.append(compose_chunked(chunks + ([(INDICES, TRIPLES, faces)] if faces is not None else [])))
            yield pa.RecordBatch.from_arrays([batch.column("cloud_id"), pa.array(out, pa.binary())], ["cloud_id", "content"])

    return meshes.select("cloud_id", "pos").mapInArrow(run, "cloud_id long, content binary")
