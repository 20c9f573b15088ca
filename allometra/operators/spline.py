"""Thin-plate splines in space (kernel r cubed) and imputation of rejected vertices, one cloud at a time."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Spline:
    """f(p) = affine part + sum of weights times distance to the controls cubed."""

    controls: np.ndarray
    affine: np.ndarray
    weights: np.ndarray

    def __call__(self, p: np.ndarray) -> np.ndarray:
        r = np.sqrt(((p[:, None, :] - self.controls[None]) ** 2).sum(axis=2))
        return np.hstack([np.ones((len(p), 1)), p]) @ self.affine + r**3 @ self.weights


def _system(rows: np.ndarray, controls: np.ndarray) -> np.ndarray:
    """Equations of ``rows`` and the four side conditions on the weights."""
    kernel = np.sqrt(((rows[:, None, :] - controls[None]) ** 2).sum(axis=2)) ** 3
    basis = lambda x: np.hstack([np.ones((len(x), 1)), x])
    return np.vstack([np.hstack([basis(rows), kernel]), np.hstack([np.zeros((4, 4)), basis(controls).T])])


def fit_spline(source: np.ndarray, target: np.ndarray, controls: np.ndarray | None = None) -> Spline:
    """The spline that takes ``source`` to ``target``: exactly, or with ``controls`` (numbers of points) by least squares over all points."""
    chosen = source if controls is None else source[controls]
    if len(chosen) < 4:
        raise ValueError("four controls at least")
    solution, *_ = np.linalg.lstsq(_system(source, chosen), np.vstack([target, np.zeros((4, 3))]), rcond=None)
    return Spline(chosen, solution[:4], solution[4:])


def grid_controls(x: np.ndarray, allowed: np.ndarray, cells: int) -> np.ndarray:
    """Of each occupied cell of a grid over the allowed points the one nearest to the cell's centre."""
    numbers = np.flatnonzero(allowed)
    p = x[numbers]
    low, span = p.min(axis=0), np.ptp(p, axis=0)
    place = (p - low) * cells / np.where(span > 0, span, 1)
    cell = np.minimum(np.floor(place), cells - 1).astype(int)
    off = (((place - cell - 0.5) * span) ** 2).sum(axis=1)
    order = np.lexsort((numbers, off, *cell.T))
    new = np.append(True, (np.diff(cell[order], axis=0) != 0).any(axis=1))
    return np.sort(numbers[order[new]])


def impute(template: np.ndarray, data: np.ndarray, allowed: np.ndarray, cells: int = 8, least_squares: bool = False, replace_all: bool = False) -> np.ndarray:
    """``data`` with the vertices that are not allowed (or all) put where a spline from the template takes them.

    Where fewer than four controls are left there is no spline, and ``data`` stays as it is.
    """
    if (allowed.all() and not replace_all) or allowed.sum() < 4:
        return data
    controls = grid_controls(data, allowed, cells)
    if len(controls) < 4:
        controls = np.flatnonzero(allowed)
    if least_squares:
        numbers = np.flatnonzero(allowed)
        spline = fit_spline(template[numbers], data[numbers], np.searchsorted(numbers, controls))
    else:
        spline = fit_spline(template[controls], data[controls])
    out = data.copy()
    rows = np.ones(len(data), dtype=bool) if replace_all else ~allowed
    out[rows] = spline(template[rows])
    return out


def impute_clouds(clouds: DataFrame, template: np.ndarray, cells: int = 8, least_squares: bool = False) -> DataFrame:
    """Packed clouds (cloud_id, pos, rejected: array of boolean a vertex) with rejected vertices imputed from the template."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for pos, rejected in zip(batch.column("pos"), batch.column("rejected"), strict=True):
                x = pos.values.to_numpy(zero_copy_only=False).reshape(-1, 3)
                out.append(impute(template, x, ~np.array(rejected.as_py(), dtype=bool), cells, least_squares).ravel())
            yield pa.RecordBatch.from_arrays([batch.column("cloud_id"), pa.array(out, pa.list_(pa.float64()))], ["cloud_id", "pos"])

    return clouds.select("cloud_id", "pos", "rejected").mapInArrow(run, "cloud_id long, pos array<double>")


def warp(points: DataFrame, spline: Spline) -> DataFrame:
    """Packed clouds (cloud_id, pos) through one spline."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [spline(p.values.to_numpy(zero_copy_only=False).reshape(-1, 3)).ravel() for p in batch.column("pos")]
            yield pa.RecordBatch.from_arrays([batch.column("cloud_id"), pa.array(out, pa.list_(pa.float64()))], ["cloud_id", "pos"])

    return points.select("cloud_id", "pos").mapInArrow(run, "cloud_id long, pos array<double>")
