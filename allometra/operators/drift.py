"""Coherent point drift: non-rigid registration of one template to many clouds.

The template's Gaussian kernel is replaced by a factor of low rank, sent to the tasks with the template; both have the
template's size, which is checked. A moved template is then a few coefficients, and what a round needs to know of a
target is a sum of rank-sized terms over its points. So targets lie in blocks of points: a round is a map over blocks,
one sum by cloud and new coefficients, and no cloud is bound to one task. A cloud of a single block goes through all its
rounds where it lies, by the same two steps.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from allometra.operators.fits import sum_rows
from allometra.sources.meshes import slices
from allometra.sources.scratch import written

MAX_VERTICES = 100_000
AFFINITY_CUT = 1e-6
CHUNK = 1 << 20
#: Points of a target in one block, and rows of the kernel in one task.
BLOCK = 4096
_DOUBLES = pa.list_(pa.float64())
_STATE = "cloud_id long, n long, moves array<double>, sigma2 double, likelihood double, iterations int, reason string"
_PLACED = "cloud_id long, pos array<double>, iterations int, sigma2 double, reason string"
_STATE_ARROW = pa.schema([("cloud_id", pa.int64()), ("n", pa.int64()), ("moves", _DOUBLES), ("sigma2", pa.float64()), ("likelihood", pa.float64()), ("iterations", pa.int32()), ("reason", pa.string())])


@dataclass(frozen=True)
class DriftOptions:
    beta: float = 2.0
    lam: float = 2.0
    outliers: float = 0.1
    max_iterations: int = 200
    tolerance: float = 5e-3


@dataclass(frozen=True)
class Kernel:
    """Low-rank factor of the kernel: vectors (m, k) and values (k)."""

    template: np.ndarray
    vectors: np.ndarray
    values: np.ndarray


def _gaussian(x: np.ndarray, y: np.ndarray, beta: float) -> np.ndarray:
    return np.exp(-((x[:, None, :] - y[None]) ** 2).sum(axis=2) / (2 * beta**2))


def far_points(x: np.ndarray, k: int) -> np.ndarray:
    """Numbers of k points, each the farthest from those before; the first is farthest from the centre."""
    chosen = [int(((x - x.mean(axis=0)) ** 2).sum(axis=1).argmax())]
    off = ((x - x[chosen[0]]) ** 2).sum(axis=1)
    while len(chosen) < k:
        chosen.append(int(off.argmax()))
        off = np.minimum(off, ((x - x[chosen[-1]]) ** 2).sum(axis=1))
    return np.array(chosen)


def centres(x: np.ndarray, k: int, rounds: int = 10) -> np.ndarray:
    """Centres of k clusters of points, from far points on."""
    middle = x[far_points(x, k)]
    for _ in range(rounds):
        near = np.concatenate([((part[:, None] - middle[None]) ** 2).sum(axis=2).argmin(axis=1) for part in np.array_split(x, max(1, len(x) * k // CHUNK))])
        n = np.bincount(near, minlength=k)[:, None]
        sums = np.stack([np.bincount(near, weights=x[:, c], minlength=k) for c in range(3)], axis=1)
        middle = np.where(n > 0, sums / np.maximum(n, 1), middle)
    return middle


def _stripe(template: np.ndarray, q: np.ndarray, begin: int, end: int, beta: float) -> np.ndarray:
    """What some of the kernel's rows add to q' K q."""
    out, step = np.zeros((q.shape[1], q.shape[1])), max(1, CHUNK // len(template))
    for at in range(begin, min(end, len(template)), step):
        rows = slice(at, min(at + step, end))
        out += q[rows].T @ (_gaussian(template[rows], template, beta) @ q)
    return out


def kernel(spark: SparkSession, template: np.ndarray, options: DriftOptions) -> Kernel:
    """Factor of rank min(100, cube root of the number of vertices, rounded up), from a quarter more columns at cluster centres.

    The kernel itself has the square of the template's size; it is multiplied in stripes of rows, one a task.
    """
    m = len(template)
    if not 4 <= m <= MAX_VERTICES:
        raise ValueError(f"a template of 4 to {MAX_VERTICES} vertices")
    rank = min(100, int(np.ceil(np.cbrt(m))), m)
    q, _ = np.linalg.qr(_gaussian(template, centres(template, min(m, rank + rank // 4)), options.beta))
    if m <= BLOCK:
        inner = _stripe(template, q, 0, m, options.beta)
    else:
        held, size = spark.sparkContext.broadcast((template, q)), BLOCK

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [_stripe(*held.value, k * size, (k + 1) * size, options.beta).ravel() for k in batch.column("id").to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([0] * len(rows), pa.int32()), pa.array(rows, _DOUBLES), pa.array([1] * len(rows), pa.int64())], ["i", "row", "n"])

        stripes = -(-m // BLOCK)
        parts = spark.range(0, stripes, 1, stripes).mapInArrow(run, "i int, row array<double>, n long")
        inner = sum_rows(parts.repartition("i"))[0][1].reshape(q.shape[1], -1)
    values, turn = np.linalg.eigh((inner + inner.T) / 2)
    order = np.argsort(values)[::-1][:rank]
    order = order[values[order] > 1e-12]
    return Kernel(template, q @ turn[:, order], values[order])


@dataclass
class State:
    """Of one cloud: its number of points, the template's moves as coefficients of the kernel's vectors, and how far the rounds are."""

    n: int
    moves: np.ndarray
    sigma2: float
    likelihood: float | None = None
    iterations: int = 0
    reason: str | None = None


def moved(k: Kernel, moves: np.ndarray) -> np.ndarray:
    """The template after its moves."""
    return k.template + k.vectors @ moves.reshape(-1, 3)


def first_sums(x: np.ndarray) -> np.ndarray:
    """What ``first_state`` needs of some points: their number, sum and sum of squares."""
    return np.array([len(x), *x.sum(axis=0), (x**2).sum()])


def first_state(k: Kernel, sums: np.ndarray) -> State:
    y, n = k.template, int(sums[0])
    spread = len(y) * sums[4] + n * (y**2).sum() - 2 * (sums[1:4] @ y.sum(axis=0))
    sigma2 = float(spread / (3.0 * len(y) * n)) if n else 0.0
    return State(n, np.zeros(3 * len(k.values)), sigma2, reason=None if np.isfinite(sigma2) and sigma2 > 0 else "numeric")


def expectation(k: Kernel, state: State, x: np.ndarray, options: DriftOptions) -> np.ndarray:
    """Rank-sized sums over some points of a target, which add up to those over all.

    With p = affinities summed by vertex: q' p q, q' p y, q' p x, then sum of p, entropy, p |x|^2, p |y|^2 and p x y.
    """
    y, q, w = k.template, k.vectors, options.outliers
    m, t, sigma2 = len(y), moved(k, state.moves), state.sigma2
    c = w / (1 - w) * (2 * np.pi * sigma2) ** 1.5 * m / state.n
    p1, px, entropy, squares, step = np.zeros(m), np.zeros((m, 3)), 0.0, 0.0, max(1, CHUNK // m)
    for at in range(0, len(x), step):
        part = x[at : at + step]
        affinity = np.exp(-((part[:, None, :] - t[None]) ** 2).sum(axis=2) / (2 * sigma2))
        affinity[affinity < AFFINITY_CUT] = 0
        total = affinity.sum(axis=1) + c
        affinity /= total[:, None]
        p1 += affinity.sum(axis=0)
        px += affinity.T @ part
        entropy -= np.log(total).sum()
        squares += (part**2).sum(axis=1) @ (1 - c / total)
    terms = [(q.T * p1) @ q, q.T @ (p1[:, None] * y), q.T @ px, [p1.sum(), entropy, squares, p1 @ (y**2).sum(axis=1), (px * y).sum()]]
    return np.concatenate([np.ravel(v) for v in terms])


def maximisation(k: Kernel, state: State, sums: np.ndarray, options: DriftOptions) -> State:
    """The next state; it has a reason if it is the last."""
    rank = len(k.values)
    inner, py, px = sums[: rank**2].reshape(rank, rank), *sums[rank**2 : -5].reshape(2, rank, 3)
    mass, entropy, x2, y2, xy = sums[-5:]
    state = State(state.n, state.moves, state.sigma2, state.likelihood, state.iterations + 1)
    if not np.isfinite(sums).all() or mass < 1e-12:
        state.reason = "numeric"
        return state
    residual, scale = px - py, options.lam * state.sigma2
    solved = np.linalg.solve(np.diag(1 / k.values) + inner / scale, residual)
    weights = residual / scale - inner @ solved / scale**2
    moves = k.values[:, None] * weights
    likelihood = entropy + 1.5 * state.n * np.log(state.sigma2) + options.lam / 2 * float((weights * moves).sum())
    inside = y2 + 2 * (py * moves).sum() + (moves * (inner @ moves)).sum()
    sigma2 = float((x2 + inside - 2 * (xy + (px * moves).sum())) / (3 * mass))
    if not np.isfinite(sigma2) or not np.isfinite(likelihood):
        state.reason = "numeric"
        return state
    before, last = state.sigma2, state.likelihood
    state.moves, state.sigma2, state.likelihood = moves.ravel(), max(sigma2, 1e-12), float(likelihood)
    if state.sigma2 < 1e-8:
        state.reason = "sigma"
    elif abs(state.sigma2 - before) < 1e-6 or abs(state.sigma2 - before) < 1e-5 * before:
        state.reason = "sigma settled"
    elif last is not None and abs(likelihood - last) < options.tolerance * abs(last):
        state.reason = "likelihood"
    elif state.iterations >= options.max_iterations:
        state.reason = "iterations"
    return state


def register(k: Kernel, target: np.ndarray, options: DriftOptions) -> State:
    """All rounds over one target at hand."""
    state = first_state(k, first_sums(target))
    while state.reason is None:
        state = maximisation(k, state, expectation(k, state, target, options), options)
    return state


def _pack(states: dict[int, State]) -> pa.RecordBatch:
    rows = [(i, s.n, s.moves, s.sigma2, s.likelihood, s.iterations, s.reason) for i, s in states.items()]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 7, _STATE_ARROW)], schema=_STATE_ARROW)


def _states(batch: pa.RecordBatch) -> dict[int, State]:
    moves = [v.values.to_numpy(zero_copy_only=False) if v.is_valid else None for v in batch.column("moves")]
    rest = zip(*(batch.column(n).to_pylist() for n in ("cloud_id", "n", "sigma2", "likelihood", "iterations", "reason")))
    return {i: State(n, v, sigma2, last, done, reason) for v, (i, n, sigma2, last, done, reason) in zip(moves, rest)}


def _array(cell: pa.Scalar) -> np.ndarray:
    return cell.values.to_numpy(zero_copy_only=False).astype(float) if cell.is_valid else np.zeros(0)


def _in_place(clouds: DataFrame, held, options: DriftOptions) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            states = {i: register(held.value, _array(x).reshape(-1, 3), options) for i, x in zip(batch.column("cloud_id").to_pylist(), batch.column("pos"))}
            yield _placed(held.value, _pack(states))

    return clouds.mapInArrow(run, _PLACED)


def _placed(k: Kernel, batch: pa.RecordBatch) -> pa.RecordBatch:
    """The template of each state after its moves."""
    pos = [moved(k, s.moves).ravel() for s in _states(batch).values()]
    return pa.RecordBatch.from_arrays([batch.column("cloud_id"), pa.array(pos, _DOUBLES), *(batch.column(n) for n in ("iterations", "sigma2", "reason"))], ["cloud_id", "pos", "iterations", "sigma2", "reason"])


def _round(blocks: DataFrame, states: DataFrame | None, held, options: DriftOptions) -> DataFrame:
    """New states: sums over the blocks of each running cloud, added up by task and by cloud. The first round only takes the clouds' measures."""
    first = states is None

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, np.ndarray] = {}
        for batch in batches:
            known = None if first else _states(batch)
            for i, cell in zip(batch.column("cloud_id").to_pylist(), batch.column("points")):
                x = _array(cell).reshape(-1, 3)
                found[i] = found.get(i, 0) + (first_sums(x) if first else expectation(held.value, known[i], x, options))
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), _DOUBLES)], ["cloud_id", "sums"])

    def advance(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        before: dict[int, State] = {}
        for batch in batches:
            for i, cell in zip(batch.column("cloud_id").to_pylist(), batch.column("sums")):
                if cell.is_valid:
                    sums[i] = sums.get(i, 0) + _array(cell)
            if not first:
                before |= {i: s for i, s in _states(batch).items() if s.moves is not None}
        k = held.value
        yield _pack({i: first_state(k, v) if first else maximisation(k, before[i], v, options) for i, v in sums.items()})

    met = blocks if first else blocks.join(states, "cloud_id")
    parts = met.mapInArrow(measure, "cloud_id long, sums array<double>")
    if not first:
        parts = parts.unionByName(states, allowMissingColumns=True)
    return parts.repartition("cloud_id").mapInArrow(advance, _STATE)


def register_all(clouds: DataFrame, template: np.ndarray, options: DriftOptions | None = None) -> DataFrame:
    """The template moved onto each packed cloud: cloud_id, pos, iterations, sigma2, reason.

    ``reason`` says why the rounds ended; after ``numeric`` the template is where it was before that round. Clouds of more
    than ``BLOCK`` points are spread over tasks; each round writes their states, so no lineage grows. Empty clouds, and
    those with missing coordinates, end as ``numeric``.
    """
    options = options or DriftOptions()
    spark = clouds.sparkSession
    held = spark.sparkContext.broadcast(kernel(spark, template, options))
    clouds = clouds.select("cloud_id", "pos")
    large = F.coalesce(F.size("pos") > 3 * BLOCK, F.lit(False))
    out, ended = _in_place(clouds.where(~large), held, options), None
    spread = clouds.where(large)
    if not spread.isEmpty():
        begin = F.explode(F.sequence(F.lit(1), F.size("pos"), F.lit(3 * BLOCK)))
        blocks = written(spread.select("cloud_id", "pos", begin.alias("_at")).select("cloud_id", F.slice("pos", F.col("_at"), 3 * BLOCK).alias("points")))
        states = written(_round(blocks, None, held, options))
        while True:
            last = states.where("reason IS NOT NULL")
            ended = last if ended is None else ended.union(last)
            running = states.where("reason IS NULL")
            if running.isEmpty():
                break
            states = written(_round(blocks, running, held, options))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 16):
            yield _placed(held.value, batch)

    return out if ended is None else out.union(ended.mapInArrow(run, _PLACED))
