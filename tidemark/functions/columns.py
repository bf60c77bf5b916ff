"""Column builders for windows with missing values.

Missing is NULL; NaN is turned into NULL where data enter (clean()). A comparison with a missing value is
false, a strict rolling window needs all its values, ratios over zero are missing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T


def clean(df: DataFrame) -> DataFrame:
    """NaN and infinities in floating columns become NULL."""
    out = {}
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.col(f.name)
            out[f.name] = F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)
    return df.withColumns(out) if out else df


def flag(condition: Column) -> Column:
    """1 where true, else 0, also where it can't be told."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def over_zero(a: Column, b: Column) -> Column:
    """a / b, NULL where b is zero."""
    return F.try_divide(a.cast("double"), F.nullif(b.cast("double"), F.lit(0.0)))


def annualised_sharpe(mean: Column, sd: Column, days: float = 252.0) -> Column:
    """Mean over deviation, scaled to a year of so many days; NULL without deviation."""
    return F.when(sd > 0, mean / sd * F.sqrt(F.lit(days)))


def corr(a: str | Column, b: str | Column) -> Column:
    """Pearson correlation over rows that have both values; NULL where one of them doesn't vary."""
    a, b = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    x, y = F.when(b.isNotNull(), a), F.when(a.isNotNull(), b)
    return over_zero(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def series(by: str | list[str] = "symbol", order: str | list[str] = "date") -> WindowSpec:
    by, order = ([x] if isinstance(x, str) else x for x in (by, order))
    return Window.partitionBy(*by).orderBy(*order)


def trailing(w: WindowSpec, n: int, shift: int = 0) -> WindowSpec:
    """The n rows that end `shift` rows before the current one."""
    return w.rowsBetween(-(n - 1 + shift), -shift)


def strict(aggregate, x: Column, w: WindowSpec, n: int, shift: int = 0, least: int | None = None) -> Column:
    """An aggregate over a trailing window, NULL unless it holds n (or `least`) values."""
    frame = trailing(w, n, shift)
    return F.when(F.count(x).over(frame) >= (least or n), aggregate(x).over(frame))


def rolling_mean(x: Column, w: WindowSpec, n: int, shift: int = 0, least: int | None = None) -> Column:
    return strict(F.avg, x, w, n, shift, least)


def rolling_std(x: Column, w: WindowSpec, n: int, shift: int = 0, least: int | None = None) -> Column:
    return strict(F.stddev_samp, x, w, n, shift, least)


def rolling_sum(x: Column, w: WindowSpec, n: int, shift: int = 0) -> Column:
    return strict(F.sum, x, w, n, shift)


def rolling_max(x: Column, w: WindowSpec, n: int, shift: int = 0) -> Column:
    return strict(F.max, x, w, n, shift)


def rolling_min(x: Column, w: WindowSpec, n: int, shift: int = 0) -> Column:
    return strict(F.min, x, w, n, shift)


def carried(x: Column, w: WindowSpec) -> Column:
    """The last value that isn't missing, up to the current row."""
    return F.last(x, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))


def pct_change_of(filled: Column, w: WindowSpec, k: int = 1) -> Column:
    """Relative change over k rows of a column that is carried() already."""
    return over_zero(filled, F.lag(filled, k).over(w)) - 1


def rolling_pct_rank(x: Column, w: WindowSpec, n: int, shift: int = 0) -> Column:
    """Rank of the window's last value among its n values, ties averaged, over n."""
    frame = trailing(w, n, shift)
    values, last = F.collect_list(x).over(frame), F.lag(x, shift).over(w) if shift else x
    below = F.size(F.filter(values, lambda y: y < last))
    equal = F.size(F.filter(values, lambda y: y == last))
    return F.when((F.count(x).over(frame) == n) & last.isNotNull(), (below + (equal + 1) / 2) / n)


def pct_rank(x: Column, by: list[str | Column]) -> Column:
    """Percentile rank within a group: ties averaged, over the number of values; NULL stays NULL."""
    known = x.isNotNull()
    inside = Window.partitionBy(*by, known)
    place = F.rank().over(inside.orderBy(x)) + (F.count(F.lit(1)).over(inside.partitionBy(*by, known, x)) - 1) / 2
    return F.when(known, place / F.count(F.lit(1)).over(inside))


def streak(up: Column, w: WindowSpec, by: list[str]) -> tuple[Column, callable]:
    """Run numbers of equal flags, and the running sum of a flag within runs: use in two steps."""
    new_run = F.coalesce((up != F.lag(up).over(w)).cast("int"), F.lit(1))
    return F.sum(new_run).over(w.rowsBetween(Window.unboundedPreceding, 0)), lambda run, order: F.sum(up).over(
        Window.partitionBy(*by, run).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    )


def business_day(d: Column, step: int) -> Column:
    """The next (1) or previous (-1) day from Monday to Friday."""
    at = F.weekday(d)
    if step > 0:
        return F.date_add(d, F.when(at == 4, 3).when(at == 5, 2).otherwise(1))
    return F.date_add(d, F.when(at == 0, -3).when(at == 6, -2).otherwise(-1))


# Abramowitz and Stegun 26.2.17, for the normal distribution without erf.
_P = 0.2316419
_B = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)


def normal_cdf(x: Column) -> Column:
    """The normal distribution function to 7.5e-8, as plain arithmetic that any engine evaluates alike."""
    t = 1 / (1 + F.lit(_P) * F.abs(x))
    poly = F.lit(0.0)
    for b in reversed(_B):
        poly = (poly + F.lit(b)) * t
    upper = F.lit(0.3989422804014327) * F.exp(-x * x / 2) * poly
    return F.when(x >= 0, 1 - upper).otherwise(upper)
