"""Procrustes fits, distance matrices, principal components, clustering and grid selection.

Clouds come packed: cloud_id, pos (x0 y0 z0 x1 ...). Kernels are numpy over Arrow batches; what goes to the driver
is of the size of one cloud (a mean) or of a matrix whose side is checked.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from allometra.sources.scratch import written

MAX_SIDE = 4096
#: Most bytes of packed rows in one block, how many blocks there are at least if they are not small, rows that are compared at once, and blocks that
#: a task compares with one.
BLOCK_BYTES = 16 << 20
SPREAD = 32
BLOCK = 256
TASK_BLOCKS = 4
#: Pairs are fitted by Newton's steps on a quartic, unless its slope at the root (1 in size) is under ``APART``, or so small a share of the squares
#: is left; masked pairs are compared by products, unless so small a share is left.
NEWTON = 10
APART = 0.02
ALIKE = 1e-4
CANCEL = 1e-2
#: Bytes of packed clouds that are fitted at once.
SLICE_BYTES = 1 << 20
RIGID = "cloud_id long, offs array<double>, cs double, rot array<double>, pos array<double>"


def centre_and_size(x: np.ndarray) -> tuple[np.ndarray, float]:
    """Centroid and root mean square distance from it of points (n, 3)."""
    centre = x.mean(axis=0)
    return centre, float(np.sqrt(((x - centre) ** 2).sum(axis=1).mean()))


def opa(target: np.ndarray, moving: np.ndarray, allow: np.ndarray | None = None) -> tuple[np.ndarray, float, np.ndarray]:
    """Similarity (offs, cs, R) that brings ``moving`` nearest to ``target``: y = R^T (x - offs) / cs.

    Rotations only, no reflections. R's rows multiply the components of x - offs. ``allow`` picks the points that count.
    """
    a, b = (target, moving) if allow is None else (target[allow], moving[allow])
    if len(b) < 3:
        raise ValueError("three points at least")
    target_centre, target_size = centre_and_size(a)
    centre, size = centre_and_size(b)
    u, _, vt = np.linalg.svd(((b - centre) / size).T @ ((a - target_centre) / target_size))
    u[:, -1] *= np.sign(np.linalg.det(u @ vt))
    rot = u @ vt
    scale = size / target_size
    return centre - rot @ target_centre * scale, scale, rot


def apply(x: np.ndarray, offs: np.ndarray, cs: float, rot: np.ndarray) -> np.ndarray:
    return (x - offs) @ rot / cs


def _points(batch: pa.RecordBatch) -> np.ndarray:
    """Points of a batch's packed clouds, (clouds, points, 3)."""
    x = _matrix(batch)
    return x.reshape(len(x), -1, 3)


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    """The packed rows of a batch as a matrix; it is an error if they differ in length, or one is missing."""
    pos = batch.column("pos")
    lengths = np.diff(pos.offsets.to_numpy())
    if pos.null_count or (lengths != lengths[:1]).any():
        raise ValueError("packed rows of different length")
    return pos.flatten().to_numpy(zero_copy_only=False).reshape(len(pos), lengths[0] if len(lengths) else 0)


def _opas(target: np.ndarray, x: np.ndarray, masks: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``opa`` of many clouds (clouds, points, 3) at once, each with its own mask or all with every point, to one target or each to its own."""
    if x.shape[1:] != target.shape[-2:]:
        raise ValueError("clouds and target of different length")
    if masks is None:
        n, w, a, b = np.full(len(x), x.shape[1]), 1.0, target.reshape(-1, *x.shape[1:]), x
    else:
        n, w = masks.sum(axis=1), masks[..., None]
        a, b = np.where(w, target, 0), np.where(w, x, 0)
    if (n < 3).any():
        raise ValueError("three points at least")
    per = n[:, None]
    target_centre, centre = a.sum(axis=1) / (per if masks is not None else x.shape[1]), b.sum(axis=1) / per
    a, b = (a - target_centre[:, None]) * w, (b - centre[:, None]) * w
    target_size, size = (np.sqrt((v**2).sum(axis=(1, 2)) / (n if len(v) == len(n) else x.shape[1])) for v in (a, b))
    rot, scale = _rotations(b.transpose(0, 2, 1) @ a / (size * target_size)[:, None, None]), size / target_size
    return centre - (rot @ np.broadcast_to(target_centre, centre.shape)[..., None])[..., 0] * scale[:, None], scale, rot


def _rotations(cross: np.ndarray) -> np.ndarray:
    """The best rotations, no reflections, of cross-covariances (clouds, 3, 3)."""
    u, _, vt = np.linalg.svd(cross)
    u[:, :, -1] *= np.sign(np.linalg.det(u @ vt))[:, None]
    return u @ vt


def _parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in slices whose packed clouds have some megabytes."""
    rows = max(1, SLICE_BYTES // (8 * max(1, len(batch.column("pos").flatten()) // max(1, batch.num_rows))))
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def _packed(x: np.ndarray) -> pa.Array:
    """Rows of a matrix as an array of lists."""
    flat = x.reshape(len(x), -1)
    return pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1, dtype=np.int32) * flat.shape[1], pa.int32()), pa.array(flat.ravel(), pa.float64()))


def _applied(x: np.ndarray, offs: np.ndarray, cs: np.ndarray, rot: np.ndarray) -> np.ndarray:
    return (x - offs[:, None]) @ rot / cs[:, None, None]


def fit_to(clouds: DataFrame, target: np.ndarray, allow: np.ndarray | None = None) -> DataFrame:
    """Each cloud's similarity to the target and its transformed points: cloud_id, offs, cs, rot (row by row), pos.

    ``allow`` picks the points that count for all clouds, a column ``allow`` (an array of booleans) those of each cloud;
    null allows no point. With both, what both allow counts. All points are transformed.
    """
    masked = "allow" in clouds.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in _parts(whole)):
            x = _points(batch)
            masks = None if allow is None else np.broadcast_to(allow, x.shape[:2])
            if masked:
                own = np.stack([_mask(cell, x.shape[1]) for cell in batch.column("allow")])
                masks = own if masks is None else own & masks
            offs, cs, rot = _opas(target, x, masks)
            yield pa.RecordBatch.from_arrays([batch.column("cloud_id"), _packed(offs), pa.array(cs), _packed(rot), _packed(_applied(x, offs, cs, rot))], ["cloud_id", "offs", "cs", "rot", "pos"])

    return clouds.select("cloud_id", "pos", *["allow"] * masked).mapInArrow(run, RIGID)


def _mask(cell: pa.Scalar, n: int) -> np.ndarray:
    """A cell's booleans, null as false; nothing is allowed where there is no array."""
    out = np.zeros(n, dtype=bool)
    if cell.is_valid:
        given = cell.values.fill_null(False).to_numpy(zero_copy_only=False)
        out[: len(given)] = given[:n]
    return out


def _summed(clouds: DataFrame, rows_of: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray:
    """Mean of what ``rows_of`` makes of slices of packed clouds, one row a cloud; a partition sends one sum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = None, 0
        for batch in (part for whole in batches for part in _parts(whole)):
            total, n = rows_of(batch).sum(axis=0) + (0 if total is None else total), n + batch.num_rows
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([total.ravel()], pa.list_(pa.float64())), pa.array([n], pa.int64())], ["i", "row", "n"])

    parts = clouds.select("pos").mapInArrow(run, "i int, row array<double>, n long")
    sums = sum_rows(parts.repartition("i"))
    if not sums:
        raise ValueError("no clouds")
    ((_, total, n),) = sums
    return total / n


def mean_row(clouds: DataFrame) -> np.ndarray:
    """Mean of the arrays of packed rows."""
    return _summed(clouds, _matrix)


def shapes(clouds: DataFrame) -> RDD:
    """Packed clouds moved to the origin and brought to size 1, in slices: how many clouds, and their doubles as bytes, x, y and z of each cloud one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in _parts(whole)):
            x = _points(batch).transpose(0, 2, 1)
            x = x - x.mean(axis=2, keepdims=True)
            x /= np.sqrt((x**2).sum(axis=(1, 2)) / x.shape[2])[:, None, None]
            yield pa.RecordBatch.from_arrays([pa.array([len(x)], pa.int64()), pa.array([x.tobytes()], pa.binary())], ["n", "pos"])

    return clouds.select("pos").mapInArrow(run, "n long, pos binary").rdd.map(tuple)


def shapes_mean(slices: RDD, target: np.ndarray) -> np.ndarray:
    """Mean points of ``shapes``, each fitted to the target.

    As shapes have no centre and no size left, a fit is a rotation: a slice takes one product for all cross-covariances and one for the sum.
    A partition makes one sum; sums of more than ``BLOCK_BYTES`` in all are added up on the executors before the driver gets them.
    """
    if len(target) < 3:
        raise ValueError("three points at least")
    centre, size = centre_and_size(target)

    def run(rows: Iterator[tuple[int, bytes]]) -> Iterator[tuple[np.ndarray, int]]:
        total, n = 0.0, 0
        for k, held in rows:
            flat = np.frombuffer(held)
            if len(flat) != k * target.size:
                raise ValueError("clouds and target of different length")
            x = flat.reshape(-1, len(target))
            total, n = x.T @ _rotations((x @ (target - centre)).reshape(-1, 3, 3)).reshape(-1, 3) + total, n + k
        if n:
            yield total, n

    depth = 1 if slices.getNumPartitions() * target.nbytes <= BLOCK_BYTES else 2
    total, n = slices.mapPartitions(run).treeReduce(lambda a, b: (a[0] + b[0], a[1] + b[1]), depth)
    return total / n * size + centre


def fitted_mean(clouds: DataFrame, target: np.ndarray) -> np.ndarray:
    """Mean points of packed clouds, each fitted to the target; no fitted cloud leaves its task."""
    return shapes_mean(shapes(clouds), target)


def mean_of(clouds: DataFrame) -> np.ndarray:
    """Mean points of packed clouds."""
    return mean_row(clouds).reshape(-1, 3)


def _normalised(x: np.ndarray) -> np.ndarray:
    centre, size = centre_and_size(x)
    return (x - centre) / size


@dataclass(frozen=True)
class GpaResult:
    mean: np.ndarray
    fitted: DataFrame
    errors: list[float]


def gpa(clouds: DataFrame, max_iterations: int = 150, tolerance: float = 1e-5) -> GpaResult:
    """Generalised Procrustes: clouds fitted to their mean and the mean taken again until it settles.

    Starts with the cloud of least id, centred and of size 1; fitted clouds have size 1. The clouds are written once, dealt out evenly
    however the input lies; their shapes stay on the executors' disks, and are made again from the written clouds if these are lost. Each round
    reads the shapes and sends one mean back, and no lineage grows. At least 4 points a cloud.
    """
    clouds = written(clouds.select("cloud_id", "pos").repartition(clouds.sparkSession.sparkContext.defaultParallelism))
    first = clouds.orderBy("cloud_id").select("pos").first()
    if first is None or len(first.pos) < 12:
        raise ValueError("clouds of 4 points at least")
    mean, error, errors = _normalised(np.array(first.pos).reshape(-1, 3)), 1.0, []
    slices = shapes(clouds).persist(StorageLevel.DISK_ONLY)
    for _ in range(max_iterations):
        new = shapes_mean(slices, _normalised(mean))
        moved = float(np.sqrt(((new - mean) ** 2).sum(axis=1).mean()))
        errors.append(moved)
        if moved == 0 or (error - moved) / moved < tolerance:
            break
        mean, error = new, moved
    slices.unpersist()
    return GpaResult(mean, fit_to(clouds, _normalised(mean)), errors)


def _blocked(rows: DataFrame) -> tuple[DataFrame, int]:
    """Packed rows in blocks of at most about ``BLOCK_BYTES`` (block, rows: ids and pos), and their number.

    There are ``SPREAD`` blocks where that leaves them ``BLOCK`` rows or more, so that what pairs of blocks read grows as
    the input does. Blocks are ranges of ids between quantiles, so they hold about as many rows each whatever the ids are.
    """
    facts = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.size("pos")), F.lit(1)).alias("width")).first()
    whole = max(1, BLOCK_BYTES // (8 * max(1, facts.width)))
    n_blocks = max(1, -(-facts.n // whole), min(SPREAD, -(-facts.n // BLOCK)))
    block = F.lit(0).cast("long")
    if n_blocks > 1:
        ends = rows.agg(F.percentile_approx("cloud_id", [k / n_blocks for k in range(1, n_blocks)], max(10_000, 100 * n_blocks)).alias("ends")).first().ends
        held = F.array(*[F.lit(e).cast("long") for e in ends])
        block = F.size(F.filter(held, lambda e: e < F.col("cloud_id"))).cast("long")
    fields = [c for c in ("cloud_id", "pos", "allow") if c in rows.columns]
    # Dealt out by ranges, each block has a partition of its own, in which its rows are collected.
    apart = rows.select(block.alias("block"), *fields).repartitionByRange(n_blocks, "block")
    return apart.groupBy("block").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("rows")), n_blocks


def _block_pairs(rows: DataFrame) -> DataFrame:
    """Each pair of blocks once, those of a block with itself included: a, b, _a, _b; ids of a lower block are lower.

    A task reads its two blocks where the one exchange by blocks left them, so rows travel once however many pairs there are.
    """
    packed, n_blocks = _blocked(rows)
    left, right = (packed.select(F.col("block").alias(n), F.col("rows").alias(f"_{n}")) for n in ("a", "b"))
    return left.hint("shuffle_replicate_nl").join(right, F.col("a") <= F.col("b")).coalesce(n_blocks * -(-n_blocks // TASK_BLOCKS))


def _block(cell: pa.Scalar) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """ids, coordinates and, where the rows have them, masks of a block."""
    rows = cell.values
    ids = rows.field("cloud_id").to_numpy()
    x = rows.field("pos").flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
    if rows.type.get_field_index("allow") < 0:
        return ids, x, None
    return ids, x, np.stack([_mask(m, x.shape[1] // 3) for m in rows.field("allow")])


def distance_matrix(clouds: DataFrame, align: bool = False, turn: bool = True, shifted: bool = False, digits: int | None = None) -> DataFrame:
    """a_id, b_id and distance of all pairs with a_id <= b_id: root mean square over vertices.

    ``align`` fits b to a by a rigid motion first (sizes stay), without ``turn`` by a shift alone. ``shifted`` gives the distance by a shift
    alone beside the fitted one, from the same products. The result is the matrix, so it has n (n + 1) / 2 rows;
    clouds travel once, a block is read by its pairs with all blocks, and ``BLOCK`` rows against as many are a handful of matrix products.
    With ``digits`` a last column ``rounded`` has the last distance as Spark rounds it.

    Where the clouds have masks (a column ``allow``, an array of booleans; null allows nothing), a pair counts the vertices
    that both allow. A pair that shares none, or fewer than three with ``align``, has a null distance.
    """
    masks = "allow" in clouds.columns
    turns = (turn, False) if shifted else (turn,)
    names = ["a_id", "b_id", "distance", "shifted"][: 2 + len(turns)] + ["rounded"] * (digits is not None)
    both = _block_pairs(clouds.select("cloud_id", "pos", *["allow"] * masks))

    def distances(x, mx, y, my) -> list[np.ndarray]:
        if align:
            return _masked_rigid_rms(x, mx, y, my, *turns) if masks else _rigid_rms(x, y, *turns)
        return [_masked_raw_rms(x, mx, y, my) if masks else _raw_rms(x, y)] * len(turns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                (ids, x, mx), (jds, y, my) = _block(batch.column("_a")[k]), _block(batch.column("_b")[k])
                alone = batch.column("a")[k].as_py() == batch.column("b")[k].as_py()
                for at in range(0, len(ids), BLOCK):
                    for to in range(at if alone else 0, len(jds), BLOCK):
                        p, q = slice(at, at + BLOCK), slice(to, to + BLOCK)
                        d = distances(x[p], mx[p] if masks else None, y[q], my[q] if masks else None)
                        if alone and at == to:
                            i, j = np.triu_indices(len(ids[p]))
                            left, right, d = ids[p][i], jds[q][j], [v[i, j] for v in d]
                        else:
                            left, right, d = np.repeat(ids[p], len(jds[q])), np.tile(jds[q], len(ids[p])), [v.ravel() for v in d]
                        if digits is not None:
                            d = [*d, _rounded(d[-1], digits)]
                        yield pa.RecordBatch.from_arrays([pa.array(left), pa.array(right), *(pa.array(v, mask=np.isnan(v)) for v in d)], names)

    return both.mapInArrow(run, ", ".join(f"{n} {'long' if n.endswith('_id') else 'double'}" for n in names))


def _rounded(values: np.ndarray, digits: int) -> np.ndarray:
    """Distances as Spark's ``round`` has them, halves of their decimals up; what is near a half, or large, goes through decimals one by one."""
    scaled = values * 10.0**digits
    floor = np.floor(scaled)
    with np.errstate(invalid="ignore"):  # infinite less infinite
        over = scaled - floor
    out = (floor + (over >= 0.5)) / 10.0**digits
    for k in np.flatnonzero((np.abs(over - 0.5) < 1e-4) | (scaled > 1e11) & (scaled < 1e21)):
        out[k] = float(Decimal(repr(float(values[k]))).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))
    return np.where(scaled < 1e21, out, values)


def _raw_rms(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Root mean square distances of all rows of x and y; sums of squared differences, as products would cancel."""
    out = np.empty((len(x), len(y)))
    for i, row in enumerate(x):
        out[i] = ((y - row) ** 2).sum(axis=1)
    return np.sqrt(out / (x.shape[1] // 3))


def _rigid_rms(x: np.ndarray, y: np.ndarray, *turns: bool) -> list[np.ndarray]:
    """Least root mean square distances of all rows of x and y over rotations and translations, or over translations alone, for each of ``turns``.

    The least sum of squares follows from the cross-covariances, one product for each pair of axes.
    """
    m = x.shape[1] // 3
    p, q = (v.reshape(len(v), m, 3) for v in (x, y))
    p, q = p - p.mean(axis=1, keepdims=True), q - q.mean(axis=1, keepdims=True)
    cross = [[p[..., c] @ q[..., d].T for d in range(3)] for c in range(3)]
    squares = (p**2).sum(axis=(1, 2))[:, None] + (q**2).sum(axis=(1, 2))[None]
    return [np.sqrt(_least(cross, squares, turn) / m) for turn in turns]


def _masked_raw_rms(x: np.ndarray, mx: np.ndarray, y: np.ndarray, my: np.ndarray) -> np.ndarray:
    """Root mean square distances over the vertices that both rows allow, NaN where there are none.

    Sums of squares come from products, around the mean of x; pairs so near each other that products would cancel are subtracted.
    """
    v, w = mx.astype(float), my.astype(float)
    known = np.repeat(mx, 3, axis=1) & np.isfinite(x)
    middle = np.where(known, x, 0).sum(axis=0) / np.maximum(known.sum(axis=0), 1)
    p, q = (np.where(np.repeat(m, 3, axis=1), c - middle, 0) for c, m in ((x, mx), (y, my)))
    n, sizes = v @ w.T, [(c**2).reshape(len(c), -1, 3).sum(axis=2) for c in (p, q)]
    squares = sizes[0] @ w.T + v @ sizes[1].T
    sums = squares - 2 * (p @ q.T)
    i, j = np.nonzero((n > 0) & ~(sums > CANCEL * squares))  # also where a coordinate is no number
    for at in range(0, len(i), BLOCK * BLOCK // 8):
        a, b = i[at : at + BLOCK * BLOCK // 8], j[at : at + BLOCK * BLOCK // 8]
        steps = ((x[a] - y[b]) ** 2).reshape(len(a), -1, 3).sum(axis=2)
        sums[a, b] = np.where(mx[a] & my[b], steps, 0).sum(axis=1)
    return np.sqrt(np.where(n > 0, sums / np.maximum(n, 1), np.nan))


def _masked_rigid_rms(x: np.ndarray, mx: np.ndarray, y: np.ndarray, my: np.ndarray, *turns: bool) -> list[np.ndarray]:
    """As ``_rigid_rms`` over the vertices that both rows allow, NaN where these are fewer than three.

    Products of masks and masked coordinates give every pair its count, sums and cross-covariance, from which its own
    centroids are taken away. Each row is moved to the middle of what it allows first, so that little cancels.
    """
    v, w = mx.astype(float), my.astype(float)
    p, q = (c.reshape(len(c), -1, 3) for c in (x, y))
    middle = lambda c, m: (c * m[..., None]).sum(axis=1, keepdims=True) / np.maximum(m.sum(axis=1), 1)[:, None, None]
    p, q = (np.where(m[..., None] > 0, c - middle(np.where(m[..., None] > 0, c, 0), m), 0) for c, m in ((p, v), (q, w)))
    n = v @ w.T
    safe = np.maximum(n, 1)
    p, q = ([np.ascontiguousarray(c[..., k]) for k in range(3)] for c in (p, q))
    sum_p, sum_q = [c @ w.T for c in p], [v @ c.T for c in q]
    mean_q = [c / safe for c in sum_q]
    cross = [[a @ b.T - s * r for b, r in zip(q, mean_q)] for a, s in zip(p, sum_p)]
    squares = sum(c**2 for c in p) @ w.T + v @ sum(c**2 for c in q).T - (sum(c**2 for c in sum_p) + sum(c**2 for c in sum_q)) / safe
    return [np.sqrt(np.where(n > 2, _least(cross, squares, turn, n > 2) / safe, np.nan)) for turn in turns]


def _least(cross: list[list[np.ndarray]], squares: np.ndarray, turn: bool, wanted: np.ndarray | None = None) -> np.ndarray:
    """Least sums of squares over rotations, or as they are, from cross-covariances (an array of pairs for each two axes) and sums of both sizes.

    Pairs whose root is not sure, or that lie so near each other that its last digits count, get their singular values one by one.
    """
    if not turn:
        return np.maximum(squares - 2 * (cross[0][0] + cross[1][1] + cross[2][2]), 0)
    best, sure = _greatest_trace(cross)
    out = squares - 2 * best
    again = ~(sure & (out > ALIKE * squares))
    if wanted is not None:
        again &= wanted
    if again.any():
        c = np.stack([np.stack([v[again] for v in row], axis=-1) for row in cross], axis=-2)
        s = np.linalg.svd(c, compute_uv=False)
        out[again] = squares[again] - 2 * (s[:, 0] + s[:, 1] + np.sign(np.linalg.det(c)) * s[:, 2])
    return np.maximum(out, 0)


def _greatest_trace(cross: list[list[np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Greatest traces of 3 x 3 matrices over rotations, and whether they are sure.

    That is the greatest root of z^4 - 2 p z^2 - 8 d z + p^2 - 4 q with p and q the sums of squares of the elements and of the
    cofactors and d the determinant. Newton's steps come down to it from above; the root is sure where it is well apart from the others.
    """
    (a, b, c), (d, e, f), (g, h, k) = cross
    first = (e * k - f * h, f * g - d * k, d * h - e * g)
    det = a * first[0] + b * first[1] + c * first[2]
    cofactors = (*first, b * k - c * h, a * k - c * g, a * h - b * g, b * f - c * e, a * f - c * d, a * e - b * d)
    p, q = (sum(v * v for v in rows[1:]) + rows[0] * rows[0] for rows in ((a, b, c, d, e, f, g, h, k), cofactors))
    known = (p > 1e-90) & (p < 1e90)
    p = np.where(known, p, 1.0)
    size = np.sqrt(p)
    det, q = det / (p * size), q / (p * p)
    z = np.sqrt(1 + 2 * np.sqrt(np.maximum(q + 2 * det * np.where(det > 0, 3**0.5, 3**-0.5), 0)))
    last, det, q = 1 - 4 * q, 8 * det, None
    for _ in range(NEWTON):
        square = z * z
        slope = 4 * z * (square - 1) - det
        step = ((square - 2) * square - det * z + last) / np.maximum(slope, APART)
        z -= step
    return z * size, known & (slope > APART) & (np.abs(step) < 1e-14)


@dataclass(frozen=True)
class PcaModel:
    mean: np.ndarray
    components: np.ndarray
    variances: np.ndarray

    def shares(self) -> np.ndarray:
        """Share of each component in the sum of standard deviations (not of variances)."""
        deviations = np.sqrt(np.maximum(self.variances, 0))
        return deviations / deviations.sum() if deviations.sum() > 0 else deviations

    def predict(self, scores: np.ndarray) -> np.ndarray:
        """mean plus scores times components; fewer scores use the first components."""
        return self.mean + scores @ self.components[: scores.shape[-1]]


def _sums(rows: DataFrame, width: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Number, sum and sum of outer products of the rows; a partition sends one upper triangle, and they add up by row of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, outer, n = np.zeros(width), np.zeros((width, width)), 0
        for batch in batches:
            if batch.num_rows:
                x = np.stack([r.values.to_numpy(zero_copy_only=False) for r in batch.column("pos")])
                total, outer, n = total + x.sum(axis=0), outer + x.T @ x, n + len(x)
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(width + 1), pa.int32()), pa.array([total, *outer], pa.list_(pa.float64())), pa.array([n] * (width + 1), pa.int64())], ["i", "row", "n"]
            )

    parts = rows.select("pos").mapInArrow(run, "i int, row array<double>, n long")
    sums = sum_rows(parts.repartition("i"))
    if not sums:
        raise ValueError("no rows")
    out = np.zeros((width + 1, width))
    for i, row, _ in sums:
        out[i] = row
    return int(sums[0][2]), out[0], out[1:]


def sum_rows(parts: DataFrame) -> list[tuple[int, np.ndarray, int]]:
    """Sums of the arrays ``row`` and of ``n`` by ``i``, which lie together: one array a row of the matrix comes back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list] = {}
        for batch in batches:
            for i, row, n in zip(batch.column("i").to_pylist(), batch.column("row"), batch.column("n").to_pylist(), strict=True):
                own = total.setdefault(i, [0.0, 0])
                own[0], own[1] = own[0] + row.values.to_numpy(zero_copy_only=False), own[1] + n
        if total:
            yield pa.RecordBatch.from_arrays(
                [pa.array(total, pa.int32()), pa.array([r for r, _ in total.values()], pa.list_(pa.float64())), pa.array([n for _, n in total.values()], pa.int64())], ["i", "row", "n"]
            )

    found = parts.mapInArrow(run, parts.schema).toArrow()
    return [(i, r.values.to_numpy(zero_copy_only=False), n) for i, r, n in zip(found.column("i").to_pylist(), found.column("row"), found.column("n").to_pylist(), strict=True)]


def centred_gram(rows: DataFrame, mean: np.ndarray, scale: np.ndarray) -> tuple[list[int], np.ndarray]:
    """Ids in order and the matrix of products of all rows, less ``mean`` and times ``scale``; blocks of it come back, never the rows."""
    ids = [r.cloud_id for r in rows.select("cloud_id").orderBy("cloud_id").collect()]
    held = rows.sparkSession.sparkContext.broadcast((mean, scale))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, scale = held.value
        for batch in batches:
            for k in range(batch.num_rows):
                (own, x, _), (other, y, _) = _block(batch.column("_a")[k]), _block(batch.column("_b")[k])
                products = ((x - mean) * scale) @ ((y - mean) * scale).T
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array([other] * len(own), pa.list_(pa.int64())), pa.array(list(products), pa.list_(pa.float64()))], ["i", "j", "v"])

    found = _block_pairs(rows).mapInArrow(run, "i long, j array<long>, v array<double>").toArrow()
    at = np.array(ids)
    out = np.zeros((len(ids), len(ids)))
    for i, j, v in zip(found.column("i").to_pylist(), found.column("j"), found.column("v"), strict=True):
        i, j, v = np.searchsorted(at, i), np.searchsorted(at, j.values.to_numpy()), v.values.to_numpy(zero_copy_only=False)
        out[i, j] = v
        out[j, i] = v
    return ids, out


def weighted_sums(rows: DataFrame, ids: list[int], weights: np.ndarray) -> np.ndarray:
    """One sum of the rows for each row of ``weights`` (a column for each id); a partition sends its partial sums."""
    held = rows.sparkSession.sparkContext.broadcast((np.array(ids), weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, weights = held.value
        total = None
        for batch in batches:
            if batch.num_rows:
                own = weights[:, np.searchsorted(ids, batch.column("cloud_id").to_numpy())]
                part = own @ np.stack([r.values.to_numpy(zero_copy_only=False) for r in batch.column("pos")])
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(list(total), pa.list_(pa.float64())), pa.array([0] * len(total), pa.int64())], ["i", "row", "n"])

    parts = rows.select("cloud_id", "pos").mapInArrow(run, "i int, row array<double>, n long")
    return np.stack([row for _, row, _ in sorted(sum_rows(parts.repartition("i")), key=lambda x: x[0])])


def _variances(rows: DataFrame, mean: np.ndarray) -> np.ndarray:
    """Sample variance of each coordinate; a partition sends one sum."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(len(mean)), 0
        for batch in batches:
            for r in batch.column("pos"):
                total, n = total + (r.values.to_numpy(zero_copy_only=False) - mean) ** 2, n + 1
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([total], pa.list_(pa.float64())), pa.array([n], pa.int64())], ["i", "row", "n"])

    ((_, total, n),) = sum_rows(rows.select("pos").mapInArrow(run, "i int, row array<double>, n long").repartition("i"))
    return total / (n - 1)


def pca(rows: DataFrame, n_components: int | None = None, correlation: bool = False, allow: np.ndarray | None = None) -> PcaModel:
    """Principal components of packed rows (cloud_id, pos), largest first, each of unit length with its largest loading positive.

    Wide rows (more coordinates than rows) go through the Gram matrix of the rows, taken in blocks, long tables through the
    covariance of the coordinates; whichever side is shorter has to be at most ``MAX_SIDE``. The driver gets that matrix, the
    mean and the components, no rows; cloud_id is unique. ``allow`` picks the coordinates that
    count; components cover all of them. ``correlation`` scales the coordinates to unit variance first.
    """
    count = rows.count()
    first = rows.select(F.size("pos").alias("m")).first()
    if first is None or count < 2:
        raise ValueError("two rows at least")
    width = first.m
    keep = n_components or min(50, count - 1, width)
    if min(count, width) > MAX_SIDE:
        raise ValueError(f"neither rows nor coordinates are at most {MAX_SIDE}")
    used = np.ones(width, dtype=bool) if allow is None else allow
    if width <= max(count, 256):
        n, total, outer = _sums(rows, width)
        mean = total / n
        covariance = (outer - n * np.outer(mean, mean)) / (n - 1)
        inner = covariance[np.ix_(used, used)]
        if correlation:
            scale = np.sqrt(np.maximum(np.diag(inner), 1e-300))
            inner = inner / np.outer(scale, scale)
        variances, vectors = np.linalg.eigh(inner)
        order = np.argsort(variances)[::-1][:keep]
        weights = vectors[:, order] / (scale[:, None] if correlation else 1)
        components = (covariance[:, used] @ weights).T
        variances = variances[order]
    else:
        mean, scale = mean_row(rows), used.astype(float)
        if correlation:
            scale = scale / np.sqrt(np.maximum(_variances(rows, mean), 1e-300))
        ids, products = centred_gram(rows, mean, scale)
        variances, vectors = np.linalg.eigh(products / (count - 1))
        order = np.argsort(variances)[::-1][:keep]
        variances = variances[order]
        weights = vectors[:, order].T
        # Weights of a component sum up to 0 but for rounding: taking the mean off makes it exact.
        components = weighted_sums(rows, ids, weights) - weights.sum(axis=1, keepdims=True) * mean
    length = np.sqrt((components**2).sum(axis=1, keepdims=True))
    components = np.divide(components, length, out=np.zeros_like(components), where=length > 1e-12)
    sign = np.sign(components[np.arange(len(components)), np.abs(components).argmax(axis=1)])
    return PcaModel(mean, components * np.where(sign == 0, 1, sign)[:, None], variances)


def pca_scores(rows: DataFrame, model: PcaModel, allow: np.ndarray | None = None) -> DataFrame:
    """cloud_id and scores: sums over the allowed coordinates of (x - mean) times the component."""
    weights = model.components.copy()
    if allow is not None:
        weights[:, ~allow] = 0
    held = rows.sparkSession.sparkContext.broadcast((model.mean, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.stack([r.values.to_numpy(zero_copy_only=False) for r in batch.column("pos")])
                mean, weights = held.value
                yield pa.RecordBatch.from_arrays([batch.column("cloud_id"), pa.array(list((x - mean) @ weights.T), pa.list_(pa.float64()))], ["cloud_id", "scores"])

    return rows.select("cloud_id", "pos").mapInArrow(run, "cloud_id long, scores array<double>")


# Keys of the matrices of a stored model.
MEAN_AND_COMPONENTS, VARIANCES, ALLOWED, SCORES = 0, 1, 2, 3
MATRIX = "key int, row long, id long, values array<double>"


def model_matrices(spark: SparkSession, model: PcaModel, allow: np.ndarray | None = None, scores: DataFrame | None = None) -> DataFrame:
    """A model as keyed matrices (key, row, id, values): mean and components, variances, the allowed coordinates, and scores with the cloud's id.

    Scores stay a DataFrame; the rest has the model's own size.
    """
    rows = [(MEAN_AND_COMPONENTS, k, None, v.tolist()) for k, v in enumerate([model.mean, *model.components])] + [(VARIANCES, 0, None, model.variances.tolist())]
    if allow is not None:
        rows.append((ALLOWED, 0, None, allow.astype(float).tolist()))
    out = spark.createDataFrame(rows, MATRIX)
    if scores is not None:
        out = out.unionByName(scores.select(F.lit(SCORES).alias("key"), F.col("cloud_id").alias("row"), F.col("cloud_id").alias("id"), F.col("scores").alias("values")))
    return out


def matrix(matrices: DataFrame, key: int) -> DataFrame:
    """row, id and values of one matrix, by its key; nothing is read before it is asked for."""
    return matrices.where(F.col("key") == key).drop("key")


def load_model(matrices: DataFrame) -> tuple[PcaModel, np.ndarray | None]:
    """The model and its allowed coordinates (None: all) from keyed matrices; scores are not read."""
    held = matrices.where(F.col("key") != SCORES).orderBy("key", "row").collect()
    by_key: dict[int, list[np.ndarray]] = {}
    for r in held:
        by_key.setdefault(r.key, []).append(np.array(r["values"]))
    if MEAN_AND_COMPONENTS not in by_key or VARIANCES not in by_key:
        raise ValueError("no stored model")
    mean, *components = by_key[MEAN_AND_COMPONENTS]
    model = PcaModel(mean, np.array(components).reshape(len(components), len(mean)), by_key[VARIANCES][0])
    return model, by_key[ALLOWED][0] > 0 if ALLOWED in by_key else None


def pca_stage(found: DataFrame, restore: bool = False, strict: float | None = None, most: float = 1.0) -> DataFrame:
    """Keyed matrices of the components of corresponding clouds (cloud_id, pos and, where needed, cs, rejected, rejection_rate, status).

    Lost clouds are left out, and with ``strict`` those that lost more than this share of their vertices. ``restore`` gives
    clouds their size back. Vertices that more than the share ``most`` of the clouds reject do not count. At most 50 components.
    """
    rows = found.where("pos IS NOT NULL")
    if "status" in found.columns:
        rows = rows.where("status = 'ok'")
    if strict is not None:
        rows = rows.where(F.col("rejection_rate") <= strict)
    if restore:
        rows = rows.withColumn("pos", F.transform("pos", lambda v: v * F.col("cs")))
    rows, allow = written(rows), None
    if most < 1.0:
        rates = rows.select(F.posexplode("rejected").alias("i", "bad")).groupBy("i").agg(F.avg(F.col("bad").cast("double")).alias("rate")).orderBy("i").collect()
        allow = np.repeat([r.rate <= most for r in rates], 3)
    model = pca(rows.select("cloud_id", "pos"), allow=allow)
    return model_matrices(found.sparkSession, model, allow, pca_scores(rows, model, allow))


def gram_matrix(rows: DataFrame) -> DataFrame:
    """i, j (i <= j), covariance and n of the coordinates of packed rows; each partition sums its own products."""
    width = rows.select(F.size("pos").alias("m")).first()
    if width is None:
        return rows.sparkSession.createDataFrame([], "i int, j int, covariance double, n long")
    n, total, outer = _sums(rows, width.m)
    covariance = (outer - np.outer(total, total) / n) / max(1, n - 1)
    i, j = np.triu_indices(width.m)
    table = pa.table({"i": pa.array(i, pa.int32()), "j": pa.array(j, pa.int32()), "covariance": covariance[i, j], "n": np.full(len(i), n)})
    return rows.sparkSession.createDataFrame(table)


def kmeans(rows: DataFrame, k: int, seed: int = 1) -> DataFrame:
    """cloud_id, cluster of packed rows, by the library's k-means with at most 100 rounds."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    data = rows.select("cloud_id", array_to_vector("pos").alias("features"))
    model = KMeans(k=k, maxIter=100, seed=seed, featuresCol="features", predictionCol="cluster").fit(data)
    return model.transform(data).select("cloud_id", "cluster")


def grid_select(vertices: DataFrame, cells: int, central: bool = False) -> DataFrame:
    """cloud_id, vertex_id of one vertex for each occupied cell of a grid over each cloud's box.

    The vertex of least number, or with ``central`` the one nearest to the cell's centre (then of least number). Points
    on the upper side of the box belong to the last cell.
    """
    axes = ("x", "y", "z")
    box = vertices.groupBy("cloud_id").agg(*[f(c).alias(f"_{n}{c}") for n, f in (("lo", F.min), ("hi", F.max)) for c in axes])
    at = vertices.join(box, "cloud_id")
    unit = {c: F.coalesce(F.try_divide((F.col(c) - F.col(f"_lo{c}")) * cells, F.col(f"_hi{c}") - F.col(f"_lo{c}")), F.lit(0.0)) for c in axes}
    at = at.withColumns({f"_u{c}": u for c, u in unit.items()})
    at = at.withColumns({f"_c{c}": F.least(F.floor(f"_u{c}"), F.lit(cells - 1)) for c in axes})
    off = sum(((F.col(f"_u{c}") - F.col(f"_c{c}") - 0.5) ** 2 * (F.col(f"_hi{c}") - F.col(f"_lo{c}")) ** 2 for c in axes), F.lit(0.0))
    chosen = F.min(F.struct(F.round(off, 12).alias("d"), "vertex_id"))["vertex_id"] if central else F.min("vertex_id")
    return at.groupBy("cloud_id", *[f"_c{c}" for c in axes]).agg(chosen.alias("vertex_id")).select("cloud_id", "vertex_id")
