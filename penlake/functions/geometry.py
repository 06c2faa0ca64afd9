"""Element-wise transforms of pen points: columns in, columns out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BASELINE = 0.65


def polar(dx: Column, dy: Column) -> tuple[Column, Column]:
    """(r, theta) of an offset; r as a square root of squares, so that other engines get the same bits."""
    return F.sqrt(dx * dx + dy * dy), F.atan2(dy, dx)


def cartesian(r: Column, theta: Column) -> tuple[Column, Column]:
    return r * F.cos(theta), r * F.sin(theta)


def shear(x: Column, y: Column, k: Column) -> Column:
    return x + k * y


def rotate(x: Column, y: Column, degrees: Column) -> tuple[Column, Column]:
    a = F.radians(degrees)
    return x * F.cos(a) - y * F.sin(a), x * F.sin(a) + y * F.cos(a)


def scale_box(v: Column, size: int, whole: bool = False) -> Column:
    """A coordinate of 0 to 1000 on a page of that many pixels, cut to whole pixels if wanted."""
    return (v * (F.lit(size) / F.lit(1000.0))).cast("int") if whole else v / 1000.0 * size


def clamp(v: Column, lo: float | Column, hi: float | Column) -> Column:
    lo, hi = (x if isinstance(x, Column) else F.lit(x) for x in (lo, hi))
    return F.least(F.greatest(v, lo), hi)


def uniform(*key: Column | str | int) -> Column:
    """A number in [0, 1) that depends on nothing but the key, whatever the partitioning."""
    parts = [k.cast("string") if isinstance(k, Column) else F.lit(str(k)) for k in key]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def gelu(x: Column) -> Column:
    """The tanh approximation."""
    return 0.5 * x * (1 + F.tanh(F.sqrt(F.lit(2 / 3.141592653589793)) * (x + 0.044715 * x * x * x)))


def step_lr(step: Column, base: float, gamma: float, every: int) -> Column:
    return F.lit(base) * F.pow(F.lit(gamma), F.floor(step / every))
