"""Column expressions: guards, spectral units, small array folds, selection grammar."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: speed of light in km/s.
LIGHT_SPEED = 299792.458


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def is_finite(x: Column | str) -> Column:
    x = col(x)
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def finite_or(x: Column | str, other: float = 0.0) -> Column:
    """Non-finite and null values become ``other``."""
    return F.when(is_finite(x), col(x)).otherwise(F.lit(other))


def clip(x: Column | str, low: float, high: float) -> Column:
    return F.least(F.greatest(col(x), F.lit(low)), F.lit(high))


def non_negative(x: Column | str) -> Column:
    return F.greatest(col(x), F.lit(0.0))


def safe_divide(a: Column, b: Column, eps: float = 1e-30, otherwise: float = 0.0) -> Column:
    return F.when(F.abs(b) > eps, a / b).otherwise(F.lit(otherwise))


def velocity_to_pixels(v: Column | str, dlog: Column | float) -> Column:
    """Shift in pixels of a grid in natural log wavelength."""
    return F.log1p(col(v) / LIGHT_SPEED) / (dlog if isinstance(dlog, Column) else F.lit(dlog))


def pixels_to_velocity(k: Column | str, dlog: Column | float) -> Column:
    return F.expm1(col(k) * (dlog if isinstance(dlog, Column) else F.lit(dlog))) * LIGHT_SPEED


def ceil_div(a: Column, b: int) -> Column:
    return F.floor((a + F.lit(b - 1)) / F.lit(b)).cast("long")


def round_down(a: Column, multiple: int) -> Column:
    return (a - a % multiple).cast("long")


def next_power_of_two(a: Column) -> Column:
    return F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(a, F.lit(1)).cast("double")))).cast("long")


def dot(a: Column, b: Column) -> Column:
    """Sum of products of two arrays, in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return safe_divide(dot(a, b), norm(a) * norm(b))


def fold_ewma(values: Column, alpha: float) -> Column:
    """Last value of e <- (1 - alpha) e + alpha v over an ordered array, begun with its first value."""
    return F.aggregate(F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0))), F.get(values, F.lit(0)), lambda e, v: (1 - alpha) * e + alpha * v)


def digest(values: Column, decimals: int = 6) -> Column:
    """SHA-1 of an ordered array of numbers, written with a fixed number of decimals."""
    return F.sha1(F.array_join(F.transform(values, lambda v: F.format_string(f"%.{decimals}f", v)), ","))


def parse_selection(text: str | None, size: int, default: int = 8) -> list[int]:
    """``start:count``, ``i,j,k`` or nothing (an even spread of ``default``), within range and distinct, in order."""
    if text and ":" in text:
        start, count = (int(p) for p in text.split(":", 1))
        picked = range(start, start + count)
    elif text and text.strip():
        picked = [int(p) for p in text.split(",") if p.strip()]
    else:
        picked = even_spread(size, default)
    return sorted({i for i in picked if 0 <= i < size})


def even_spread(size: int, n: int) -> list[int]:
    """At most n places from first to last at like distances."""
    if size <= 0 or n <= 0:
        return []
    return sorted({i * (size - 1) // max(n - 1, 1) for i in range(n)}) if n < size else list(range(size))


def parse_ranges(text: str) -> list[int]:
    """Numbers of a list like ``0-3,5``."""
    out: set[int] = set()
    for part in filter(None, re.split(r"\s*,\s*", text.strip())):
        low, _, high = part.partition("-")
        out.update(range(int(low), int(high or low) + 1))
    return sorted(out)


def matches_any(x: Column | str, picked: Sequence[int]) -> Column:
    """A selection as a predicate; a run of neighbours becomes a range, which a scan can prune by."""
    if picked and picked[-1] - picked[0] + 1 == len(picked):
        return col(x).between(picked[0], picked[-1])
    return col(x).isin(list(picked))
