"""Array expressions of feature search: masks, positions, moves and curves."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)


def selected(values: Column, mask: Column) -> Column:
    """Values whose mask bit is 1."""
    return F.filter(values, lambda _, i: F.get(mask, i) == 1)


def n_selected(mask: Column) -> Column:
    return F.aggregate(mask, F.lit(0), lambda s, b: s + b.cast("int"))


def mask_key(mask: Column) -> Column:
    """The mask as a string of 0 and 1, for joins and duplicate removal."""
    return F.array_join(F.transform(mask, lambda b: b.cast("string")), "")


def mask_indices(mask: Column) -> Column:
    return F.filter(F.transform(mask, lambda b, i: F.when(b == 1, i)), lambda i: i.isNotNull())


def binarised(position: Column, threshold: float | Column = 0.5, strict: bool = True) -> Column:
    """Bits of a position above a threshold, or above a threshold of each feature."""
    if isinstance(threshold, Column):
        return F.zip_with(position, threshold, lambda v, t: ((v > t) if strict else (v >= t)).cast("int"))
    return F.transform(position, lambda v: ((v > threshold) if strict else (v >= threshold)).cast("int"))


def clipped(position: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.transform(position, lambda v: F.greatest(F.lit(low), F.least(F.lit(high), v)))


def opposite(position: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.transform(position, lambda v: F.lit(low + high) - v)


def transfer(v: Column, kind: str = "sigmoid") -> Column:
    """Bit probability of a velocity: ``tanh``, ``sigmoid`` or the steeper ``sigmoid2``."""
    if kind == "tanh":
        return F.abs(F.tanh(v))
    return 1 / (1 + F.exp((-2 if kind == "sigmoid2" else -1) * v))


def velocity(v: Column, x: Column, best: Column, lead: Column, w: float, c1: Column, c2: Column, limit: float) -> Column:
    """w v + c1 (best - x) + c2 (lead - x) of each feature, clipped to the limit."""
    own = F.zip_with(best, x, lambda b, a: c1 * (b - a))
    shared = F.zip_with(lead, x, lambda b, a: c2 * (b - a))
    moved = F.zip_with(F.zip_with(F.transform(v, lambda a: w * a), own, lambda a, b: a + b), shared, lambda a, b: a + b)
    return clipped(moved, -limit, limit)


def hamming(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x != y).cast("double"))).cast("int")


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def resampled(curve: Column, n: int) -> Column:
    """A curve read at ``n`` evenly spaced places, rounded half to even."""
    last = F.size(curve) - 1
    step = F.sequence(F.lit(0), F.lit(n - 1))
    return F.transform(step, lambda i: F.get(curve, F.bround(i * last / F.lit(max(n - 1, 1))).cast("int")))
