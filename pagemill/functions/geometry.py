"""Column expressions over boxes and angles, in points from the top left."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Length that two intervals share, 0 if none."""
    return F.greatest(F.lit(0.0), F.least(a1, b1) - F.greatest(a0, b0))


def box_overlap(ax: Column, ay: Column, aw: Column, ah: Column, bx: Column, by: Column, bw: Column, bh: Column) -> Column:
    """Area that two boxes share."""
    return overlap(ax, ax + aw, bx, bx + bw) * overlap(ay, ay + ah, by, by + bh)


def off_axis(rotation: Column) -> Column:
    """Degrees to the nearest right angle."""
    return F.abs(rotation - F.round(rotation / 90) * 90)


def canonical_rotation(rotation: Column) -> Column:
    """Rotation in [0, 360), snapped to a right angle within 2 degrees."""
    r = F.pmod(rotation, F.lit(360.0))
    near = F.round(r / 90) * 90
    return F.when(F.abs(r - near) <= 2, F.pmod(near, F.lit(360.0))).otherwise(r)


def matrix_scale(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Larger scale factor of a 2 x 2 matrix: the root of the greater eigenvalue of its product with its transpose."""
    a, b, c, d = (x.cast("double") for x in (a, b, c, d))
    half = (a * a + b * b + c * c + d * d) / 2
    det = a * d - b * c
    return F.sqrt(half + F.sqrt(F.greatest(F.lit(0.0), half * half - det * det)))


def upper_median(values: Column) -> Column:
    """Of an array, the upper of the two middles for an even count; null for an empty one."""
    return F.try_element_at(F.array_sort(values), (F.size(values) / 2).cast("int") + 1)
