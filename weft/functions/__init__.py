"""Column functions that the operators share. All are built-in expressions; NULL stands for what cannot be computed."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a, b, least: float = 1e-6) -> Column:
    """a / b, NULL where b is not above ``least`` in size."""
    a, b = F.col(a) if isinstance(a, str) else a, F.col(b) if isinstance(b, str) else b
    return F.when(F.abs(b) > least, a / b)


def angle_difference(a: Column, b: Column) -> Column:
    """Degrees between two undirected lines, 0 to 90."""
    d = F.abs(a - b) % 180
    return F.least(d, 180 - d)


def heading_change(before: Column, after: Column) -> Column:
    """after - before, wrapped to at most half a turn either way."""
    return F.pmod(after - before + math.pi, F.lit(2 * math.pi)) - math.pi


def eigenvalues(a: Column, b: Column, c: Column) -> tuple[Column, Column]:
    """The smaller and the larger eigenvalue of [[a, b], [b, c]]."""
    root = F.sqrt((a - c) * (a - c) + 4 * b * b)
    return (a + c - root) / 2, (a + c + root) / 2


def clipped(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def cycle_rank(edges: Column, nodes: Column, components: Column) -> Column:
    """Independent cycles of a graph."""
    return edges - nodes + components


def hann(i: Column, size: int) -> Column:
    """Weight of cell i of a tile of ``size``, never under 0.001."""
    return F.greatest(0.5 - 0.5 * F.cos(2 * math.pi * i / (size - 1)), F.lit(1e-3))


def poly_rate(step: Column, steps: int, base: float, low: float, power: float = 0.9) -> Column:
    """A learning rate that falls from base to low along a power curve."""
    return (base - low) * F.pow(F.greatest(F.lit(0.0), 1 - step / steps), F.lit(power)) + low


def grey(b: Column, g: Column, r: Column) -> Column:
    """The grey level of a colour, rounded."""
    return F.rint(0.114 * b + 0.587 * g + 0.299 * r)


def saturation(b: Column, g: Column, r: Column) -> Column:
    """0 for greys, 255 for pure colours."""
    top = F.greatest(b, g, r)
    return F.coalesce(F.rint(F.try_divide(255.0 * (top - F.least(b, g, r)), top)), F.lit(0.0))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def as_fixed(x: Column, places: int = 4) -> Column:
    """A number in fixed notation, ``n/a`` where there is none."""
    return F.when(x.isNull() | F.isnan(x), "n/a").otherwise(F.format_string(f"%.{places}f", x.cast("double")))


def reflected(i: Column, n: Column) -> Column:
    """An index outside 0 .. n - 1 mirrored back inside, without repeating the ends."""
    period = F.greatest(2 * (n - 1), F.lit(1))
    at = F.pmod(i, period)
    return F.when(n == 1, F.lit(0)).otherwise(F.least(at, period - at))


def class_of_colour(b: Column, g: Column, r: Column, colours: dict[int, tuple[int, int, int]], none: int = 0) -> Column:
    """The class value of a colour (b, g, r)."""
    out = F.lit(none)
    for value, (x, y, z) in colours.items():
        out = F.when((b == x) & (g == y) & (r == z), value).otherwise(out)
    return out
