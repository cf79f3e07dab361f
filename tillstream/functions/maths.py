"""Numeric column helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F


def clip(x: Column, low: float | None = None, high: float | None = None) -> Column:
    """Bound `x`; a null stays null."""
    out = x
    if low is not None:
        out = F.when(x < low, F.lit(low)).otherwise(out)
    if high is not None:
        out = F.when(x > high, F.lit(high)).otherwise(out)
    return out


def round_half_up(x: Column, digits: int = 0, half: float = 0.5) -> Column:
    """floor(x * 10^d + half) / 10^d: the same bits in every engine.

    A `half` a little above 1/2 also rounds up what a sum in another order leaves one bit short.
    """
    if digits == 0:
        return F.floor(x + half).cast("double")
    scale = float(10 ** digits)
    return F.floor(x * scale + half).cast("double") / scale


def ratio(num: Column, den: Column) -> Column:
    """num / den, null where the denominator is zero or negative."""
    return F.when(den > 0, num / den)


def pct_change(new: Column, old: Column, eps: float = 1e-8) -> Column:
    return (new - old) / (old + eps) * 100


def mean_ignoring_nulls(cols: Sequence[Column]) -> Column:
    total = sum((F.coalesce(c, F.lit(0.0)) for c in cols[1:]), F.coalesce(cols[0], F.lit(0.0)))
    n = sum((c.isNotNull().cast("int") for c in cols[1:]), cols[0].isNotNull().cast("int"))
    return F.when(n > 0, total / n)


def first_not_null(cols: Sequence[Column]) -> Column:
    return F.coalesce(*cols)


def arg_max(values: dict[str, Column]) -> Column:
    """Name of the largest non-null value; the first name wins a tie; null if all are null."""
    best = F.greatest(*values.values()) if len(values) > 1 else next(iter(values.values()))
    out = F
    for name, value in values.items():
        out = out.when(value == best, F.lit(name))
    return out


def pick_by_name(values: dict[str, Column], name: Column) -> Column:
    """Value of the column whose name is held in another column."""
    entries = F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v)])
    return F.try_element_at(entries, name)


def bucket(x: Column, bounds: Sequence[tuple[float, str]], last: str, none: str | None = None,
           closed_right: bool = False) -> Column:
    """Half-open bucket label; `bounds` are (upper bound, label) in ascending order."""
    out = F.when(x.isNull(), F.lit(none))
    for upper, label in bounds:
        out = out.when(x <= upper if closed_right else x < upper, label)
    return out.otherwise(last)


def safe_corr(x: Column, y: Column) -> Column:
    """Pearson correlation over rows where both are present; null if either is constant.

    `corr` itself raises on zero variance under ANSI mode.
    """
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x.cast("double")), F.when(both, y.cast("double"))
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    return F.when(spread > 1e-12, F.covar_pop(x, y) / spread)
