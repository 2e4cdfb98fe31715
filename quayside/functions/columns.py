"""Calendar, rounding and series expressions."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

#: Weight of the k-th last week is DECAY_ALPHA ** (k - 1).
DECAY_ALPHA = 0.6
DECAY_WEEKS = 8


def year_week(ts: Column | str) -> Column:
    """Calendar year and ISO week, as in 2017-52 for 2017-01-01: the two disagree about the days around New Year."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.concat(F.year(ts).cast("string"), F.lit("-"), F.lpad(F.weekofyear(ts).cast("string"), 2, "0"))


def week_start(ts: Column | str) -> Column:
    """The Monday of a week: orders and groups rightly across years, where year_week does not."""
    return F.to_date(F.date_trunc("week", F.col(ts) if isinstance(ts, str) else ts))


def delay_days(delivered: Column | str, estimated: Column | str) -> Column:
    """Whole days between the dates; late is positive."""
    return F.datediff(delivered, estimated)


def rounded(x: Column, digits: int = 4) -> Column:
    """Half up on the binary value, so that other engines agree."""
    scale = float(10**digits)
    return F.floor(x * scale + 0.5) / F.lit(scale)


def safe_corr(x: Column, y: Column) -> Column:
    """Pearson correlation of the pairs without nulls; null, not an error, where a side does not vary."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x.cast("double")), F.when(both, y.cast("double"))
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def decay_weights(weeks: int = DECAY_WEEKS, alpha: float = DECAY_ALPHA) -> list[float]:
    return [alpha**k for k in range(weeks)]


def decay_weighted_recent_mean(value: str, window: WindowSpec, weeks: int = DECAY_WEEKS, alpha: float = DECAY_ALPHA) -> Column:
    """Weighted mean of the last `weeks` observed rows; null until so many exist."""
    weights = decay_weights(weeks, alpha)
    total = F.lit(0.0)
    for k, w in enumerate(weights, 1):
        total = total + F.lag(value, k).over(window) * F.lit(w)
    return total / F.lit(sum(weights))


def ordered(*entity: str, by: str) -> WindowSpec:
    return Window.partitionBy(*entity).orderBy(by)
