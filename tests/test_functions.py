"""Column expressions against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from allometra.functions import geometry as g

RIGID = "struct<offs: array<double>, cs: double, rot: array<double>>"


def rigid(rng):
    q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    q *= np.sign(np.linalg.det(q))
    return rng.normal(size=3), float(rng.uniform(0.5, 2)), q


def test_rigid_algebra(spark):
    rng = np.random.default_rng(3)
    a, b, p = rigid(rng), rigid(rng), rng.normal(size=3)
    move = lambda x, t: (x - t[0]) @ t[2] / t[1]
    plain = lambda t: (t[0].tolist(), t[1], t[2].ravel().tolist())
    df = spark.createDataFrame([(plain(a), plain(b), *map(float, p))], f"a {RIGID}, b {RIGID}, x double, y double, z double")
    df = df.withColumns({"ab": g.compose_rigid("a", "b"), "back": g.invert_rigid("a"), "turn": g.turn_z(F.lit(np.pi / 2)), "m": g.rigid_matrix("a")})
    at = [F.col(c) for c in "xyz"]
    row = df.select(*[F.array(*g.apply_rigid(at, r)).alias(r) for r in ("a", "ab", "turn")], "m", F.array(*[F.lit(float(v)) for v in move(p, a)]).alias("pa"), "back").first()
    assert np.allclose(row.a, move(p, a)) and np.allclose(row.ab, move(move(p, a), b))
    assert np.allclose(row.turn, [-p[1], p[0], p[2]])
    assert np.allclose((np.reshape(row.m, (4, 4)) @ [*p, 1])[:3], move(p, a))
    back = (np.array(row.back.offs), row.back.cs, np.reshape(row.back.rot, (3, 3)))
    assert np.allclose(move(np.array(row.pa), back), p)


@pytest.mark.parametrize(("origin", "direction", "expected"), [((-3, 0, 0), (1, 0, 0), 2.0), ((0, 0, 0), (0, 1, 0), 0.0), ((-3, 2, 0), (1, 0, 0), None), ((3, 0, 0), (1, 0, 0), None)])
def test_ray_and_box(spark, origin, direction, expected):
    lit = lambda v: [F.lit(float(x)) for x in v]
    assert spark.range(1).select(g.ray_box(lit(origin), lit(direction), lit((-1, -1, -1)), lit((1, 1, 1))).alias("t")).first().t == expected


def test_small_expressions(spark):
    df = spark.range(4).select("id", g.index_field(F.col("id"), 4).alias("f"), g.zigzag(F.col("id")).alias("z"), g.next_power_of_two(F.col("id") + 4).alias("p"), g.below(F.col("id"), F.lit(2)).alias("b"))
    rows = df.orderBy("id").collect()
    assert [r.f for r in rows] == pytest.approx([0, 1 / 3, 2 / 3, 1]) and [r.z for r in rows] == [0, -1, 1, -2]
    assert [r.p for r in rows] == [4, 8, 8, 8] and [r.b for r in rows] == [True, True, False, False]
