"""Geometry on columns. Points are structs (x, y, z) or triples of columns; everything stays in generated code."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Point = Sequence[Column]


def point(prefix: str) -> Point:
    """The columns of a struct column or, with a trailing underscore, of plain columns with that prefix."""
    join = "" if prefix.endswith("_") or not prefix else "."
    return [F.col(f"{prefix}{join}{c}") for c in "xyz"]


def minus(a: Point, b: Point) -> Point:
    return [x - y for x, y in zip(a, b, strict=True)]


def plus(a: Point, b: Point) -> Point:
    return [x + y for x, y in zip(a, b, strict=True)]


def times(a: Point, s) -> Point:
    return [x * s for x in a]


def dot(a: Point, b: Point) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Point, b: Point) -> Point:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def norm(a: Point) -> Column:
    return F.sqrt(dot(a, a))


def distance(a: Point, b: Point) -> Column:
    return norm(minus(a, b))


def unit(a: Point) -> Point:
    """``a`` over its length; null where that is 0."""
    n = norm(a)
    return [F.when(n > 0, x / n) for x in a]


def triangle_area(a: Point, b: Point, c: Point) -> Column:
    return 0.5 * norm(cross(minus(b, a), minus(c, a)))


def triangle_area_heron(a: Point, b: Point, c: Point) -> Column:
    """Area from the sides; 0 where rounding makes the product negative."""
    p, q, r = distance(a, b), distance(b, c), distance(c, a)
    s = (p + q + r) / 2
    product = s * (s - p) * (s - q) * (s - r)
    return F.when(product > 0, F.sqrt(product)).otherwise(0.0)


def barycentric(a: Point, b: Point, c: Point, u: Column, v: Column) -> Point:
    return plus(a, plus(times(minus(b, a), u), times(minus(c, a), v)))


def is_degenerate(i0: Column, i1: Column, i2: Column) -> Column:
    return (i0 == i1) | (i1 == i2) | (i0 == i2)


def edge_key(a: Column, b: Column) -> Column:
    """One long for an undirected edge of int vertex ids."""
    return F.shiftleft(F.least(a, b).cast("long"), 32).bitwiseOR(F.greatest(a, b).cast("long"))


def edge_ends(key: Column) -> tuple[Column, Column]:
    return F.shiftright(key, 32).cast("int"), key.bitwiseAND(0xFFFFFFFF).cast("int")


def mask_words(bits: Column, repeat: int = 1) -> Column:
    """An array of booleans, each repeated, as an array of 32-bit words; the first bit is the lowest of the first word."""
    wide = F.flatten(F.transform(bits, lambda b: F.array_repeat(b, repeat)))
    word = lambda k: F.aggregate(F.slice(wide, k * 32 + 1, F.lit(32)), F.struct(F.lit(0).cast("long").alias("w"), F.lit(1).cast("long").alias("p")), lambda a, b: F.struct((a["w"] + F.when(b, a["p"]).otherwise(0)).alias("w"), (a["p"] * 2).alias("p")), lambda a: a["w"])
    return F.when(F.size(wide) == 0, F.array().cast("array<long>")).otherwise(F.transform(F.sequence(F.lit(0), F.floor((F.size(wide) - 1) / 32).cast("int")), word))


def mask_bit(words: Column, i: Column) -> Column:
    return F.get(words, (i / 32).cast("int")).bitwiseAND(F.element_at(F.array(*[F.lit(1 << k).cast("long") for k in range(32)]), (i % 32 + 1).cast("int"))) != 0


def box_overlap(low_a: Point, high_a: Point, low_b: Point, high_b: Point) -> Column:
    """Whether two boxes meet."""
    out = F.lit(True)
    for la, ha, lb, hb in zip(low_a, high_a, low_b, high_b, strict=True):
        out = out & (la <= hb) & (lb <= ha)
    return out


def clamp_to_box(p: Point, low: Point, high: Point) -> Point:
    return [F.greatest(lo, F.least(x, hi)) for x, lo, hi in zip(p, low, high, strict=True)]


def ray_box(origin: Point, direction: Point, low: Point, high: Point) -> Column:
    """Least t >= 0 at which the ray enters the box, null if it misses it. A direction of 0 along an axis is parallel to it."""
    near, far, outside = F.lit(0.0), F.lit(float("inf")), F.lit(False)
    for o, d, lo, hi in zip(origin, direction, low, high, strict=True):
        t0, t1 = F.try_divide(lo - o, d), F.try_divide(hi - o, d)
        near = F.greatest(near, F.coalesce(F.least(t0, t1), F.lit(0.0)))
        far = F.least(far, F.coalesce(F.greatest(t0, t1), F.lit(float("inf"))))
        outside = outside | ((d == 0) & ((o < lo) | (o > hi)))
    return F.when(~outside & (near <= far), near)


def least_eigen(xx: Column, yy: Column, zz: Column, xy: Column, xz: Column, yz: Column) -> Column:
    """Struct (value, x, y, z): least eigenvalue of a symmetric 3 by 3 matrix and its unit eigenvector, the greatest part positive.

    Closed form: the eigenvalue by the angle of the cubic, the vector as the longest cross product of two rows less the
    eigenvalue. Where that is not unique (two least eigenvalues alike) it is one of those at right angles to the greatest, or an axis.
    """
    middle = (xx + yy + zz) / 3
    spread = F.sqrt(((xx - middle) * (xx - middle) + (yy - middle) * (yy - middle) + (zz - middle) * (zz - middle) + 2 * (xy * xy + xz * xz + yz * yz)) / 6)
    scaled = lambda v, diagonal=False: F.coalesce(F.try_divide(v - middle if diagonal else v, spread), F.lit(0.0))
    a, b, c, d, e, f = scaled(xx, True), scaled(yy, True), scaled(zz, True), scaled(xy), scaled(xz), scaled(yz)
    half = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (a * (b * c - f * f) - d * (d * c - f * e) + e * (d * f - b * e)) / 2))
    root = 2 * F.cos(F.acos(half) / 3 + 2 * math.pi / 3)

    def vector(m: Column) -> Column:
        r0, r1, r2 = [m["a"] - m["l"], m["d"], m["e"]], [m["d"], m["b"] - m["l"], m["f"]], [m["e"], m["f"], m["c"] - m["l"]]
        made = [F.struct(dot(n, n).alias("n"), *[v.alias(k) for v, k in zip(n, "xyz")]) for n in (cross(r0, r1), cross(r0, r2), cross(r1, r2))]
        # With two least eigenvalues alike all rows are along one line; any vector across it will do.
        longest = F.array_max(F.array(*[F.struct(dot(r, r).alias("n"), *[v.alias(k) for v, k in zip(r, "xyz")]) for r in (r0, r1, r2)]))
        across = F.when(longest["n"] > 1e-20, F.struct((longest["y"] * longest["y"] + longest["z"] * longest["z"]).alias("n"), F.lit(0.0).alias("x"), (-longest["z"]).alias("y"), longest["y"].alias("z")))
        across = F.when(across["n"] > 1e-20, across).otherwise(F.struct(F.lit(1.0).alias("n"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(1.0).alias("z")))
        best = F.array_max(F.array(*made))
        return F.when(best["n"] > 1e-20, best).otherwise(across)

    once = lambda value, body: F.transform(F.array(value), body)[0]
    facts = F.struct(*[v.alias(k) for k, v in zip("abcdefl", (a, b, c, d, e, f, root))])
    found = once(once(facts, vector), lambda v: F.struct(*[(v[k] / F.sqrt(v["n"])).alias(k) for k in "xyz"]))

    def turned(v: Column) -> Column:
        largest = F.greatest(*[F.abs(v[k]) for k in "xyz"])
        sign = F.coalesce(*[F.when(F.abs(v[k]) >= largest * (1 - 1e-9), F.signum(v[k])) for k in "xyz"])
        return F.struct((middle + spread * root).alias("value"), *[(v[k] * sign).alias(k) for k in "xyz"])

    return once(found, turned)


def reflect(p: Point, centre: Point, normal: Point) -> Point:
    """Mirror image in the plane through ``centre`` with the unit normal."""
    return minus(p, times(normal, 2 * dot(minus(p, centre), normal)))


def quaternion_axis(x: Column, y: Column, z: Column, w: Column) -> Column:
    """Struct (x, y, z, degrees) of a unit quaternion; the x axis where it does not turn."""
    s = F.sqrt(F.greatest(F.lit(0.0), 1 - w * w))
    part = lambda v, d: F.when(s > 1e-9, v / s).otherwise(F.lit(d))
    return F.struct(part(x, 1.0).alias("x"), part(y, 0.0).alias("y"), part(z, 0.0).alias("z"), F.degrees(2 * F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), w)))).alias("degrees"))


def apply_rigid(p: Point, rigid: str) -> Point:
    """``rot0 x' + rot1 y' + rot2 z'`` over ``cs`` with (x', y', z') = p - offs; the transform is a struct (offs, cs, rot of 9)."""
    q = [x - F.col(f"{rigid}.offs")[k] for k, x in enumerate(p)]
    rot = F.col(f"{rigid}.rot")
    return [sum((rot[3 * k + i] * q[k] for k in range(3)), F.lit(0.0)) / F.col(f"{rigid}.cs") for i in range(3)]


def nan_to(value: Column, other: Column) -> Column:
    """``other`` where the value is not a finite number."""
    return F.when(F.isnan(value) | (F.abs(value) == float("inf")), other).otherwise(value)


def zigzag(value: Column) -> Column:
    """Signed value of an unsigned zigzag code: 0, -1, 1, -2 for 0, 1, 2, 3."""
    return F.shiftright(value, 1).bitwiseXOR(-value.bitwiseAND(1))


def next_power_of_two(value: Column) -> Column:
    return F.pow(F.lit(2), F.ceil(F.log2(F.greatest(value, F.lit(1))))).cast("long")


def sum_of_squares(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x * x)


def quantise(value: Column, low: Column, high: Column, bits: int = 16) -> Column:
    """Code of ``value`` between ``low`` and ``high``, truncated; 0 where both are equal."""
    return F.coalesce(F.floor(F.try_divide((value - low) * ((1 << bits) - 1), high - low)), F.lit(0)).cast("int")


def invert_rigid(rigid: str) -> Column:
    """The transform (offs, cs, rot of 9) that takes back what ``apply_rigid`` does."""
    offs, cs, rot = (F.col(f"{rigid}.{n}") for n in ("offs", "cs", "rot"))
    back = F.array(*[-sum((rot[3 * k + i] * offs[k] for k in range(3)), F.lit(0.0)) / cs for i in range(3)])
    return F.struct(back.alias("offs"), (1 / cs).alias("cs"), F.array(*[rot[3 * j + i] for i in range(3) for j in range(3)]).alias("rot"))


def compose_rigid(first: str, second: str) -> Column:
    """The transform that does ``first`` and then ``second``."""
    a, b = ({n: F.col(f"{r}.{n}") for n in ("offs", "cs", "rot")} for r in (first, second))
    rot = F.array(*[sum((a["rot"][3 * i + k] * b["rot"][3 * k + j] for k in range(3)), F.lit(0.0)) for i in range(3) for j in range(3)])
    moved = [a["offs"][i] + a["cs"] * sum((a["rot"][3 * i + k] * b["offs"][k] for k in range(3)), F.lit(0.0)) for i in range(3)]
    return F.struct(F.array(*moved).alias("offs"), (a["cs"] * b["cs"]).alias("cs"), rot.alias("rot"))


def turn_z(angle: Column) -> Column:
    """A turn by ``angle`` (radians) around the z axis, from x to y."""
    c, s, one, none = F.cos(angle), F.sin(angle), F.lit(1.0), F.lit(0.0)
    return F.struct(F.array(none, none, none).alias("offs"), one.alias("cs"), F.array(c, s, none, -s, c, none, none, none, one).alias("rot"))


def rigid_matrix(rigid: str) -> Column:
    """The 4 by 4 matrix of a transform, row by row, for points as columns."""
    offs, cs, rot = (F.col(f"{rigid}.{n}") for n in ("offs", "cs", "rot"))
    rows = [[*[rot[3 * k + i] / cs for k in range(3)], -sum((rot[3 * k + i] * offs[k] for k in range(3)), F.lit(0.0)) / cs] for i in range(3)]
    return F.array(*[v for row in rows for v in row], F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))


def index_field(vertex_id: Column, n_vertices: int) -> Column:
    """The number of a vertex between 0 and 1; 0 for a single one."""
    return vertex_id / F.lit(max(1, n_vertices - 1))


def below(value: Column, threshold: Column) -> Column:
    """Whether a value lies strictly below a threshold."""
    return value < threshold
