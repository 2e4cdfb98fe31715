"""Exact running totals over a global order without a single task that sorts it all."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Ranges of values that tasks sort on their own.
RANGES = 64


def running_total(counts: DataFrame, value: str, n: str, out: str, ranges: int = RANGES) -> DataFrame:
    """`counts`, of distinct non-null values, with the sum of `n` over all values up to and with a row's.

    Values are cut into ranges at sketched quantiles, each range is sorted by itself,
    and a range starts at the sum of those before it; an uneven sketch costs balance,
    never exactness.
    """
    cuts = sorted(set(counts.approxQuantile(value, [i / ranges for i in range(1, ranges)], 0.005)))
    at = F.lit(0) if not cuts else F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col(value)))
    ranged = counts.withColumn("\x00range", at)
    sums = ranged.groupBy("\x00range").agg(F.sum(n).alias("\x00sum"))
    ahead = F.sum("\x00sum").over(Window.orderBy("\x00range").rowsBetween(Window.unboundedPreceding, -1))
    starts = sums.select("\x00range", F.coalesce(ahead, F.lit(0)).alias("\x00before"))
    within = F.sum(n).over(Window.partitionBy("\x00range").orderBy(value))
    return ranged.withColumn("\x00within", within).join(F.broadcast(starts), "\x00range").withColumn(out, F.col("\x00within") + F.col("\x00before")).drop("\x00range", "\x00within", "\x00before")  # `ranges` rows
