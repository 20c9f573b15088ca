"""Point drift: clouds in one block and in many, failures as rows, moved copies found again."""

import numpy as np
import pytest

from allometra.operators import drift


def bent(rng, x, size):
    """The points under a smooth bend, a little noise and a shift."""
    return x + size * np.sin(x[:, [1, 2, 0]] * 1.5) + rng.normal(size=x.shape) * 0.002 + [0.05, -0.03, 0.02]


@pytest.fixture(scope="module")
def shapes():
    rng = np.random.default_rng(21)
    template = rng.normal(size=(260, 3))
    return template, [bent(rng, template, size) for size in (0.02, 0.06, 0.1)]


def rows(spark, clouds):
    return spark.createDataFrame([(i, None if x is None else x.ravel().tolist()) for i, x in enumerate(clouds)], "cloud_id long, pos array<double>")


def test_spread_clouds_end_as_those_of_one_block(spark, shapes, monkeypatch):
    template, clouds = shapes
    df = rows(spark, clouds)
    whole = {r.cloud_id: r for r in drift.register_all(df, template).collect()}
    monkeypatch.setattr(drift, "BLOCK", 70)  # kernel rows and targets in several tasks
    spread = {r.cloud_id: r for r in drift.register_all(df, template).collect()}
    assert set(whole) == set(spread) == {0, 1, 2}
    for i, r in whole.items():
        assert (r.iterations, r.reason) == (spread[i].iterations, spread[i].reason) and r.iterations > 2
        assert np.allclose(r.pos, spread[i].pos, atol=1e-6) and r.sigma2 == pytest.approx(spread[i].sigma2, rel=1e-4)


def test_moved_copies_are_found(spark, shapes):
    template, clouds = shapes
    for r in drift.register_all(rows(spark, clouds), template, drift.DriftOptions(tolerance=0.0)).collect():
        before = np.sqrt(((template - clouds[r.cloud_id]) ** 2).sum(axis=1).mean())
        after = np.sqrt(((np.reshape(r.pos, (-1, 3)) - clouds[r.cloud_id]) ** 2).sum(axis=1).mean())
        assert after < 0.6 * before and r.reason == "sigma settled"


def test_variance_falls_round_by_round(spark, shapes):
    template, (cloud, *_) = shapes
    options = drift.DriftOptions(tolerance=0.0)
    k = drift.kernel(spark, template, options)
    state, seen = drift.first_state(k, drift.first_sums(cloud)), []
    while state.reason is None:
        seen.append(state.sigma2)
        state = drift.maximisation(k, state, drift.expectation(k, state, cloud, options), options)
    assert all(a >= b for a, b in zip(seen, seen[1:])) and seen[-1] < 0.01 * seen[0]


def test_steps_against_matrices(spark, shapes):
    """One round with all affinities and the kernel's factor written out."""
    template, (_, cloud, _) = shapes
    options = drift.DriftOptions()
    k = drift.kernel(spark, template, options)
    start = drift.first_state(k, drift.first_sums(cloud))
    d2 = ((cloud[:, None] - template[None]) ** 2).sum(axis=2)
    assert start.sigma2 == pytest.approx(d2.mean() / 3)
    p = np.exp(-d2 / (2 * start.sigma2))
    p /= p.sum(axis=1, keepdims=True) + options.outliers / (1 - options.outliers) * (2 * np.pi * start.sigma2) ** 1.5 * len(template) / len(cloud)
    g = k.vectors @ np.diag(k.values) @ k.vectors.T
    d = np.diag(p.sum(axis=0))
    w = np.linalg.solve(d @ g + options.lam * start.sigma2 * np.eye(len(template)), p.T @ cloud - d @ template)
    t = template + g @ w
    after = drift.maximisation(k, start, drift.expectation(k, start, cloud, options), options)
    assert np.allclose(drift.moved(k, after.moves), t, atol=1e-6)
    assert after.sigma2 == pytest.approx((p * ((cloud[:, None] - t[None]) ** 2).sum(axis=2)).sum() / (3 * p.sum()), rel=1e-6)


def test_failed_clouds_are_rows(spark, shapes, monkeypatch):
    template, clouds = shapes
    odd = [clouds[0], np.full((300, 3), np.nan), np.zeros((0, 3)), None]
    for block in (drift.BLOCK, 70):
        monkeypatch.setattr(drift, "BLOCK", block)
        found = {r.cloud_id: r for r in drift.register_all(rows(spark, odd), template).collect()}
        assert len(found) == 4 and found[0].reason != "numeric"
        assert all(found[i].reason == "numeric" and np.allclose(found[i].pos, template.ravel()) for i in (1, 2, 3))
    assert drift.register_all(rows(spark, odd).limit(0), template).isEmpty()
    with pytest.raises(ValueError):
        drift.register_all(rows(spark, odd), template[:3])


def test_small_clouds_take_one_python_stage_and_go_in_slices(spark):
    """The moved template comes from the task that registers it."""
    rows = [(i, (np.random.default_rng(i).normal(size=(9, 3))).ravel().tolist()) for i in range(300)]
    clouds = spark.createDataFrame(rows, "cloud_id long, pos array<double>").coalesce(1)
    out = drift.register_all(clouds, np.random.default_rng(0).normal(size=(9, 3)))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert sorted(r.cloud_id for r in out.select("cloud_id").collect()) == list(range(300))
