"""Column expressions on coordinates: snapping, vectors, angles, superposition scores."""

from __future__ import annotations

import math
from functools import reduce
from operator import add
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

GRID = 1000.0


def snap(c: Column, grid: float = GRID) -> Column:
    """`c` on its grid, halves upward, never minus zero. Limits are only ever tested on snapped values."""
    return F.floor(c * F.lit(grid) + F.lit(0.5)) / F.lit(grid) + F.lit(0.0)


def grid_mean(c: Column) -> Column:
    """Mean of values on the 0.001 grid by whole thousandths: the same whatever the row order."""
    return F.sum(F.round(c * 1000.0).cast("bigint")).cast("double") / F.count(c) / 1000.0


class Vec(NamedTuple):
    """Three columns as one vector."""

    x: Column
    y: Column
    z: Column

    def plus(self, o: "Vec") -> "Vec":
        return Vec(self.x + o.x, self.y + o.y, self.z + o.z)

    def minus(self, o: "Vec") -> "Vec":
        return Vec(self.x - o.x, self.y - o.y, self.z - o.z)

    def times(self, k) -> "Vec":
        return Vec(self.x * k, self.y * k, self.z * k)

    def dot(self, o: "Vec") -> Column:
        return self.x * o.x + self.y * o.y + self.z * o.z

    def cross(self, o: "Vec") -> "Vec":
        return Vec(self.y * o.z - self.z * o.y, self.z * o.x - self.x * o.z, self.x * o.y - self.y * o.x)

    def norm(self) -> Column:
        return F.sqrt(self.dot(self))

    def unit(self) -> "Vec":
        n = F.nullif(self.norm(), F.lit(0.0))
        return Vec(self.x / n, self.y / n, self.z / n)

    def struct(self) -> Column:
        return F.struct(self.x.alias("x"), self.y.alias("y"), self.z.alias("z"))


def vec(name: str | Column) -> Vec:
    """The vector in a struct column with fields x, y, z."""
    c = F.col(name) if isinstance(name, str) else name
    return Vec(c["x"], c["y"], c["z"])


def vec_cols(x: str = "x", y: str = "y", z: str = "z") -> Vec:
    return Vec(F.col(x), F.col(y), F.col(z))


def lit_vec(x: float, y: float, z: float) -> Vec:
    return Vec(F.lit(float(x)), F.lit(float(y)), F.lit(float(z)))


def dist(a: Vec, b: Vec) -> Column:
    d = a.minus(b)
    return F.sqrt(d.x * d.x + d.y * d.y + d.z * d.z)


def clip(c: Column, lo: float, hi: float) -> Column:
    return F.least(F.lit(hi), F.greatest(F.lit(lo), c))


def vec_angle(a: Vec, b: Vec) -> Column:
    """Degrees between two vectors; null when one has no length."""
    n = F.nullif(a.norm() * b.norm(), F.lit(0.0))
    return F.degrees(F.acos(clip(a.dot(b) / n, -1.0, 1.0)))


def angle_deg(c: Column) -> Column:
    """Degrees in (-180, 180] on the 0.001 grid."""
    turn = c - F.lit(360.0) * F.ceil((c - F.lit(180.0)) / F.lit(360.0))
    s = snap(turn)
    return F.when(s == -180.0, F.lit(180.0)).otherwise(s)


def d0(length: Column) -> Column:
    """Length scale of the TM score."""
    raw = F.lit(1.24) * F.cbrt(F.greatest(length.cast("double") - 15.0, F.lit(0.0))) - 1.8
    return F.greatest(F.lit(0.5), raw)


def tm_term(distance: Column, scale: Column) -> Column:
    q = snap(distance, 1024.0) / scale
    return F.lit(1.0) / (F.lit(1.0) + q * q)


def hbond_energy(on: Column, ch: Column, oh: Column, cn: Column) -> Column:
    """Electrostatic backbone hydrogen-bond energy, kcal/mol, to 0.001; -9.9 at the least or on a clash."""
    e = F.lit(27.888) * (F.lit(1.0) / on + F.lit(1.0) / ch - F.lit(1.0) / oh - F.lit(1.0) / cn)
    near = F.least(on, ch, oh, cn) < 0.5
    return F.when(near, F.lit(-9.9)).otherwise(F.greatest(F.lit(-9.9), snap(e)))


def matrix_apply(m: Column, v: Vec) -> Vec:
    """A row-major 3x3 array column times a vector."""
    rows = [m[3 * i] * v.x + m[3 * i + 1] * v.y + m[3 * i + 2] * v.z for i in range(3)]
    return Vec(*rows)


def rotation_angle(m: Column) -> Column:
    """Degrees turned by a row-major rotation matrix."""
    return F.degrees(F.acos(clip((m[0] + m[4] + m[8] - 1.0) / 2.0, -1.0, 1.0)))


def rotation_axis(m: Column) -> Vec:
    """Unit axis of a rotation (turn by the right hand). At a half turn the axis comes from the symmetric part."""
    skew = Vec(m[7] - m[5], m[2] - m[6], m[3] - m[1])
    n = skew.norm()
    # column of (R + I) with the largest diagonal is parallel to the axis of a half turn
    cols = [Vec(m[0] + 1.0, m[3], m[6]), Vec(m[1], m[4] + 1.0, m[7]), Vec(m[2], m[5], m[8] + 1.0)]
    top = F.greatest(m[0], m[4], m[8])
    half = [F.when(m[0] == top, cols[0][i]).when(m[4] == top, cols[1][i]).otherwise(cols[2][i]) for i in range(3)]
    h = Vec(*half)
    hn = F.nullif(h.norm(), F.lit(0.0))
    n0 = F.nullif(n, F.lit(0.0))
    flat = n < 1e-6
    return Vec(*[F.when(flat, h[i] / hn).otherwise(skew[i] / n0) for i in range(3)])


def screw(rot: Column, shift: Vec) -> dict[str, Column]:
    """Angle, axis, rise along it and a point on it, of the motion x -> R x + t."""
    axis = rotation_axis(rot)
    rise = shift.dot(axis)
    across = shift.minus(axis.times(rise))
    half = F.radians(rotation_angle(rot)) / 2.0
    cot = F.cos(half) / F.nullif(F.sin(half), F.lit(0.0))
    point = across.plus(axis.cross(across).times(cot)).times(0.5)
    return {"angle": rotation_angle(rot), "axis": axis.struct(), "rise": rise, "point": point.struct()}


def pseudo_cb(n: Vec, ca: Vec, c: Vec) -> Vec:
    """Ideal C-beta place from the three backbone atoms (fixed published weights)."""
    b = ca.minus(n)
    e = c.minus(ca)
    a = b.cross(e)
    return a.times(-0.58273431).plus(b.times(0.56802827)).minus(e.times(0.54067466)).plus(ca)


def total(cols: list[Column]) -> Column:
    return reduce(add, cols)


def radians(deg: float) -> float:
    return math.radians(deg)
