"""Mergeable state: quantile and distinct-count sketches that are kept by group and merged later.

A state is a table of binary sketches, one a group.  It is small, it can be written,
and states of parts (weeks, states, tables) merge into the state of the whole without
another look at the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Size of a quantile sketch, and the rank error that 99 of 100 of its answers keep.
KLL_K = 1000
#: Log2 of the registers of a distinct sketch.
HLL_LG = 14


def rank_error(k: int = KLL_K) -> float:
    """The bound of a quantile's error in rank, as a share of the rows."""
    return 2.296 / k**0.9021


def distinct_error(lg: int = HLL_LG, spreads: float = 3.0) -> float:
    """The bound of a distinct count's relative error, in so many standard errors."""
    return spreads * 1.04 / 2 ** (lg / 2)


def quantile_state(df: DataFrame, by: list[str], col: str, k: int = KLL_K) -> DataFrame:
    """(by, n, sketch): a quantile sketch of each group's values that are not null; groups without any are left out."""
    return df.filter(F.col(col).isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), F.kll_sketch_agg_double(F.col(col).cast("double"), F.lit(k)).alias("sketch"))


def merged_quantiles(state: DataFrame, by: list[str]) -> DataFrame:
    """The state of larger groups; without `by` that of all."""
    return state.groupBy(*by).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("sketch"))


def quantile(sketch: str, p: float) -> Column:
    return F.kll_sketch_get_quantile_double(F.col(sketch), F.lit(p))


def distinct_state(df: DataFrame, by: list[str], key: str, lg: int = HLL_LG) -> DataFrame:
    """(by, sketch): a distinct-count sketch of each group's keys that are not null."""
    return df.filter(F.col(key).isNotNull()).groupBy(*by).agg(F.hll_sketch_agg(F.col(key).cast("string"), F.lit(lg)).alias("sketch"))


def merged_distinct(state: DataFrame, by: list[str]) -> DataFrame:
    return state.groupBy(*by).agg(F.hll_union_agg("sketch").alias("sketch"))


def overlaps(state: DataFrame, group: str, name: str, lg: int = HLL_LG) -> DataFrame:
    """(group, a, b, distinct_a, distinct_b, overlap, error): keys that two members of a group share, a < b by `name`.

    By inclusion and exclusion over the union of their sketches; `error` bounds it in
    keys.  Members are tables or the like, so their pairs are few.
    """
    side = lambda x: state.select(group, F.col(name).alias(x), F.col("sketch").alias(f"s{x}"))
    both = side("a").join(side("b"), group).filter("a < b")
    one, two, union = F.hll_sketch_estimate("sa"), F.hll_sketch_estimate("sb"), F.hll_sketch_estimate(F.hll_union("sa", "sb"))
    counted = both.select(group, "a", "b", one.alias("distinct_a"), two.alias("distinct_b"), union.alias("union"))
    shared = F.greatest(F.lit(0), F.col("distinct_a") + F.col("distinct_b") - F.col("union"))
    error = F.lit(distinct_error(lg)) * (F.col("distinct_a") + F.col("distinct_b") + F.col("union"))
    return counted.select(group, "a", "b", "distinct_a", "distinct_b", shared.alias("overlap"), error.alias("error"))
