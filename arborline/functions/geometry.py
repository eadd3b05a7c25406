"""Column expressions on points and vectors given as three columns each; everything stays in generated code."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Vector = Sequence[Column]

#: Vectors shorter than this have no direction.
TINY = 1e-12


def xyz(prefix: str = "", suffix: str = "") -> list[Column]:
    """The three columns ``{prefix}x{suffix}`` and so on."""
    return [F.col(f"{prefix}{a}{suffix}") for a in "xyz"]


def minus(a: Vector, b: Vector) -> list[Column]:
    return [p - q for p, q in zip(a, b)]


def plus(a: Vector, b: Vector) -> list[Column]:
    return [p + q for p, q in zip(a, b)]


def times(a: Vector, k: Column) -> list[Column]:
    return [p * k for p in a]


def dot(a: Vector, b: Vector) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vector, b: Vector) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def norm(a: Vector) -> Column:
    return F.sqrt(dot(a, a))


def clamp(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def ratio(above: Column, below: Column) -> Column:
    """A quotient that is missing where the denominator is not positive and finite."""
    good = (below > 0) & (below != float("inf")) & ~F.isnan(below)
    return F.when(good, above / F.when(good, below))


def directed_angle(a: Vector, b: Vector) -> Column:
    """Degrees from 0 to 180; missing if either vector has no direction."""
    n = norm(a) * norm(b)
    good = (norm(a) > TINY) & (norm(b) > TINY)
    return F.when(good, F.degrees(F.acos(clamp(dot(a, b) / F.when(good, n), -1.0, 1.0))))


def axial_angle(a: Vector, b: Vector) -> Column:
    """Degrees from 0 to 90, whichever way the vectors point."""
    angle = directed_angle(a, b)
    return F.least(angle, F.lit(180.0) - angle)


def triangle_area(a: Vector, b: Vector, c: Vector) -> Column:
    return F.lit(0.5) * norm(cross(minus(b, a), minus(c, a)))


def signed_volume(a: Vector, b: Vector, c: Vector) -> Column:
    """Of the tetrahedron of a triangle and the origin."""
    return dot(a, cross(b, c)) / F.lit(6.0)


def frustum_area(r0: Column, r1: Column, height: Column) -> Column:
    """Lateral area of a cone section."""
    return F.lit(math.pi) * (r0 + r1) * F.sqrt(height * height + (r1 - r0) * (r1 - r0))


def frustum_volume(r0: Column, r1: Column, height: Column) -> Column:
    return F.lit(math.pi) * height * (r0 * r0 + r0 * r1 + r1 * r1) / F.lit(3.0)


def minmax(value: Column, low: Column, high: Column) -> Column:
    """Scaled to 0..1; a constant gives one half."""
    return F.when(high > low, (value - low) / F.when(high > low, high - low)).otherwise(F.when(value.isNotNull(), F.lit(0.5)))


def exceeds_parent(child: Column, parent: Column) -> Column:
    """Whether a child is longer than its parent, beyond rounding."""
    return child > parent + F.greatest(F.lit(1e-12), F.lit(1e-9) * F.greatest(child, parent))


def excess_penalty(child: Column, parent: Column) -> Column:
    """Up to 0.05, in proportion to a child's excess over its parent."""
    excess = clamp(ratio(child - parent, child), 0.0, 1.0)
    return F.when(exceeds_parent(child, parent), F.lit(0.05) * excess).otherwise(F.lit(0.0))


def order_color(order: Column) -> Column:
    """A colour ``r,g,b`` by order (our own palette, the orders beyond it repeat it)."""
    palette = ["60,60,60", "31,119,180", "214,39,40", "44,160,44", "148,103,189", "255,127,14"]
    return F.when(order == 0, palette[0]).when(order > 0, F.element_at(F.array(*map(F.lit, palette[1:])), F.pmod(order - 1, F.lit(len(palette) - 1)).cast("int") + 1))
