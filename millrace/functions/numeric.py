"""Numeric column helpers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def safe_divide(num, den, default=0.0) -> Column:
    """``num / den``; ``default`` when the denominator is zero or null."""
    n, d = _c(num).cast("double"), _c(den).cast("double")
    return F.when(d.isNull() | (d == 0), F.lit(default)).otherwise(n / d)


def ratio_or_null(num, den) -> Column:
    """``num / den``; null on a zero or null base."""
    n, d = _c(num).cast("double"), _c(den).cast("double")
    return F.when(d != 0, n / d)


def clamp(x, low=0.0, high=100.0) -> Column:
    """Bound a score; null stays null."""
    c = _c(x).cast("double")
    return F.when(c.isNotNull(), F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), c)))


def threshold_label(x, steps: Sequence[tuple[float, str]], other: str, *, descending=True) -> Column:
    """First label whose bound holds: ``x >= bound`` (descending) or ``x < bound`` (ascending)."""
    c = _c(x)
    out = None
    for bound, label in steps:
        test = (c >= bound) if descending else (c < bound)
        out = F.when(test, label) if out is None else out.when(test, label)
    return out.otherwise(F.lit(other)) if out is not None else F.lit(other)


def upto_label(x, steps: Sequence[tuple[float, str]], other: str) -> Column:
    """First label with ``x <= bound``."""
    c = _c(x)
    out = None
    for bound, label in steps:
        out = F.when(c <= bound, label) if out is None else out.when(c <= bound, label)
    return out.otherwise(F.lit(other))


def weighted_score(parts: Mapping[str, float] | Sequence[tuple[Column, float]], *, bound=True) -> Column:
    """Sum of weight x (clamped) part."""
    items = [(F.col(k), w) for k, w in parts.items()] if isinstance(parts, Mapping) else list(parts)
    total = None
    for col, weight in items:
        term = (clamp(col) if bound else _c(col)) * F.lit(float(weight))
        total = term if total is None else total + term
    return total


def min_max_normalize(x, low, high) -> Column:
    """Rescale to 0-100 from fixed bounds, clamped; 0 when the bounds are equal."""
    if high == low:
        return F.lit(0.0)
    return clamp((_c(x).cast("double") - F.lit(float(low))) / F.lit(float(high) - float(low)) * 100)


def level_value(x, table: Mapping[str, float], default: float) -> Column:
    """Weight of a named level, ``default`` for other names; case is ignored."""
    pairs = [F.lit(v) for kv in table.items() for v in (kv[0].lower(), float(kv[1]))]
    return F.coalesce(F.create_map(*pairs)[F.lower(_c(x))], F.lit(float(default)))


def python_round(x, digits: int = 0) -> Column:
    """Half-to-even rounding; noise far below the last digit is removed first."""
    return F.bround(F.round(_c(x), digits + 7), digits)


def magnitude_block(x, digits: int = 3) -> Column:
    """Monotone integer block of a number: sign, power of ten, leading digits.

    Equal numbers share a block and a larger number never has a smaller block, so
    order statistics can be found block by block instead of in one sorted group.
    """
    c = _c(x).cast("double")
    size = F.abs(c)
    power = F.floor(F.log10(size))
    scale = 10 ** (digits - 1)
    lead = F.least(
        F.lit(scale * 10 - 1).cast("double"),
        F.greatest(F.lit(scale).cast("double"), F.floor(size / F.pow(F.lit(10.0), power) * scale).cast("double")),
    )
    code = (power + 400) * (scale * 10) + lead.cast("long")
    return F.when(c == 0, F.lit(0).cast("long")).otherwise(F.signum(c).cast("long") * code)
