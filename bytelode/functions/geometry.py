"""Fixed-point matrices and quaternions as column expressions.

Fixed-point numbers have twelve fraction bits. A matrix is a struct ``(m, t)``: nine 16-bit
numbers by row, and three 32-bit ones. Products are shifted right, which rounds down.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

ONE = 4096


def saturated(v: Column, bits: int = 16) -> Column:
    """The nearest number that fits a signed word of 16 or 32 bits."""
    return F.greatest(F.least(v, F.lit((1 << bits - 1) - 1).cast("long")), F.lit(-(1 << bits - 1)).cast("long"))


def q12_value(v: Column) -> Column:
    return (v.cast("double") / ONE).cast("float")


def turn_sin_cos(angle: Column) -> tuple[Column, Column]:
    """Sine and cosine of a turn of 4096 units, rounded half away from zero."""
    rad = angle.cast("double") / ONE * math.tau
    return F.round(F.sin(rad) * ONE).cast("long"), F.round(F.cos(rad) * ONE).cast("long")


def matrix(m: list[Column], t: list[Column]) -> Column:
    return F.struct(F.array(*(x.cast("long") for x in m)).alias("m"), F.array(*(x.cast("long") for x in t)).alias("t"))


def translation(t: list[Column]) -> Column:
    return matrix([F.lit(ONE if i % 4 == 0 else 0) for i in range(9)], t)


def _m(a: Column, i: int, j: int) -> Column:
    return F.get(a["m"], F.lit(3 * i + j))


def _shifted(terms: list[Column]) -> Column:
    total = terms[0]
    for x in terms[1:]:
        total = total + x
    return F.shiftright(total, 12)


def compose(parent: Column, local: Column) -> Column:
    m = [saturated(_shifted([_m(parent, i, k) * _m(local, k, j) for k in range(3)])) for i in range(3) for j in range(3)]
    t = [saturated(_shifted([_m(parent, i, k) * F.get(local["t"], F.lit(k)) for k in range(3)]) + F.get(parent["t"], F.lit(i)), 32) for i in range(3)]
    return matrix(m, t)


def apply(a: Column, v: Column, bits: int = 32) -> Column:
    """A vector of three 16-bit numbers moved, saturated to 32 or 16 bits."""
    out = [saturated(_shifted([_m(a, i, k) * F.get(v, F.lit(k)) for k in range(3)]) + F.get(a["t"], F.lit(i)), 32) for i in range(3)]
    return F.array(*(saturated(x, bits) for x in out))


def from_turns(turn: list[Column], scale: list[Column], t: list[Column]) -> Column:
    """Turns about x, then y, then z, with each column scaled by its axis."""
    (sx, cx), (sy, cy), (sz, cz) = map(turn_sin_cos, turn)
    zero = F.lit(0).cast("long")

    def times(a: Column, b: Column) -> Column:
        return F.shiftright(a * b, 12)

    yx = [[cy, times(sy, sx), times(sy, cx)], [zero, cx, -sx], [-sy, times(cy, sx), times(cy, cx)]]
    z = [[cz, -sz, zero], [sz, cz, zero], [zero, zero, F.lit(ONE).cast("long")]]
    r = [[_shifted([z[i][k] * yx[k][j] for k in range(3)]) for j in range(3)] for i in range(3)]
    return matrix([saturated(F.shiftright(r[i][j] * scale[j], 12)) for i in range(3) for j in range(3)], t)


def quaternion_product(a: list[Column], b: list[Column]) -> Column:
    """The product of quaternions ``[x, y, z, w]`` in single precision, not normalised."""
    x, y, z, w = (v.cast("float") for v in a)
    p, q, r, s = (v.cast("float") for v in b)
    return F.array(w * p + x * s + y * r - z * q, w * q - x * r + y * s + z * p, w * r + x * q - y * p + z * s, w * s - x * p - y * q - z * r)


def normalised(q: Column, least: float, fallback: Column) -> Column:
    """A quaternion of length 1; the fallback where its length is not above ``least`` (or no number)."""
    parts = [F.get(q, F.lit(k)) for k in range(4)]
    length = F.sqrt(parts[0] * parts[0] + parts[1] * parts[1] + parts[2] * parts[2] + parts[3] * parts[3]).cast("float")
    one = F.array(*((x.cast("double") / length.cast("double")).cast("float") for x in parts))
    return F.when((length > F.lit(least).cast("float")) & ~F.isnan(length), one).otherwise(fallback)
