"""Profiling, cleaning audits, clipping and reconciliation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quayside.operators.ranks import running_total
from quayside.plans.lineage import cut
from quayside.sources.tables import Table


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def table_overview(tables: dict[str, DataFrame], registry: dict[str, Table]) -> DataFrame:
    """(table_name, role, n_rows, n_cols, pk): counts come from file footers where the source has them."""
    parts = [
        df.agg(F.count("*").alias("n_rows")).select(
            F.lit(name).alias("table_name"), F.lit(registry[name].role).alias("role"), "n_rows",
            F.lit(len(df.columns)).alias("n_cols"), F.lit(" + ".join(registry[name].pk or ()) or None).cast("string").alias("pk"),
        )
        for name, df in tables.items()
    ]
    return _union(parts)


def shared_key_cardinality(tables: dict[str, DataFrame], registry: dict[str, Table], keys: tuple[str, ...], rsd: float = 0.05) -> DataFrame:
    """(shared_key, table_name, approx_distinct) for each table that holds a key, under its own name or an alias; one scan a table."""
    parts = []
    for name, df in tables.items():
        held = {k: registry[name].alias.get(k, k) for k in keys if registry[name].alias.get(k, k) in df.columns}
        if held:
            one = df.agg(*[F.approx_count_distinct(c, rsd).alias(k) for k, c in held.items()])
            pairs = ", ".join(f"'{k}', `{k}`" for k in held)
            parts.append(one.selectExpr(f"stack({len(held)}, {pairs}) AS (shared_key, approx_distinct)").withColumn("table_name", F.lit(name)))
    return _union(parts).select("shared_key", "table_name", "approx_distinct")


def temporal_coverage(tables: dict[str, DataFrame], registry: dict[str, Table]) -> DataFrame:
    """(table_name, column_name, first_ts, last_ts, n_non_null) for each time column; one scan a table."""
    parts = []
    for name, df in tables.items():
        for c in registry[name].temporal:
            one = df.agg(F.min(c).alias("first_ts"), F.max(c).alias("last_ts"), F.count(c).alias("n_non_null"))
            parts.append(one.select(F.lit(name).alias("table_name"), F.lit(c).alias("column_name"), "first_ts", "last_ts", "n_non_null"))
    return _union(parts)


def cleaning_stage(df: DataFrame, stage: str, keep: Column, reason: str) -> DataFrame:
    """(stage, n_input, n_kept, n_dropped, reason) of one filter, in one pass."""
    counted = df.agg(F.count("*").alias("n_input"), F.count(F.when(keep, 1)).alias("n_kept"))
    return counted.select(F.lit(stage).alias("stage"), "n_input", "n_kept", (F.col("n_input") - F.col("n_kept")).alias("n_dropped"), F.lit(reason).alias("reason"))


def distinct_stage(df: DataFrame, stage: str, key: str, reason: str) -> DataFrame:
    counted = df.agg(F.count("*").alias("n_input"), F.count_distinct(key).alias("n_kept"))
    return counted.select(F.lit(stage).alias("stage"), "n_input", "n_kept", (F.col("n_input") - F.col("n_kept")).alias("n_dropped"), F.lit(reason).alias("reason"))


def cleaning_audit(orders: DataFrame, reviews: DataFrame, geolocation: DataFrame, delivered: Column | None = None, text: str = "review_comment_message", zip_col: str = "geolocation_zip_code_prefix", score: str = "review_score") -> DataFrame:
    """What the delivered filter, the labelled and worded reviews and the centroids keep."""
    delivered = F.col("order_delivered_customer_date").isNotNull() if delivered is None else delivered
    return _union([
        cleaning_stage(orders, "delivered orders", delivered, "no delivery date"),
        cleaning_stage(reviews, "labelled reviews", F.col(score).isin(1, 2, 4, 5), "neutral or missing score"),
        cleaning_stage(reviews, "reviews with text", F.col(text).isNotNull(), "no message"),
        distinct_stage(geolocation, "zip centroids", zip_col, "one row per zip"),
    ])


def geolocation_centroids(geo: DataFrame, key: str = "geolocation_zip_code_prefix", lat: str = "geolocation_lat", lng: str = "geolocation_lng", state: str = "geolocation_state") -> DataFrame:
    """(zip, lat, lng, state): means and the smallest state, so that reruns agree."""
    return geo.groupBy(F.col(key).alias("zip")).agg(F.avg(lat).alias("lat"), F.avg(lng).alias("lng"), F.min(state).alias("state"))


def quantiles(df: DataFrame, col: str, probabilities: list[float], relative_error: float = 0.01, n: str | None = None) -> list[float]:
    """Quantiles on the driver; 0 is exact, from running totals of the counts of distinct values, which ranges of values sort apart; there a row may stand for `n` equal ones."""
    if relative_error > 0:
        return df.approxQuantile(col, probabilities, relative_error)
    counts = cut(df.filter(F.col(col).isNotNull()).groupBy(F.col(col).alias("v")).agg((F.count("*") if n is None else F.sum(n)).alias("n")))
    total = counts.agg(F.sum("n")).first()[0]
    if not total:
        return [None] * len(probabilities)
    reached = running_total(counts, "v", "n", "upto")
    return list(reached.agg(*[F.min(F.when(F.col("upto") >= F.lit(p * total), F.col("v"))).alias(str(i)) for i, p in enumerate(probabilities)]).first())


def winsorize(df: DataFrame, col: str, low: float = 0.01, high: float = 0.99, relative_error: float = 0.01) -> tuple[DataFrame, float, float, int]:
    """(df with `col` clipped to its quantiles as double, lower bound, upper bound, how many were outside); nulls stay."""
    lo, hi = map(float, quantiles(df.select(col), col, [low, high], relative_error))
    n = df.filter((F.col(col) < lo) | (F.col(col) > hi)).count()
    return df.withColumn(col, clipped(F.col(col), F.lit(lo), F.lit(hi))), lo, hi, n


def clipped(x: Column, lo: Column, hi: Column) -> Column:
    return F.when(x < lo, lo).when(x > hi, hi).otherwise(x).cast("double")


def eda_stats(df: DataFrame, measures: list[str], entities: list[str], probabilities: tuple[float, ...] = (0.25, 0.5, 0.75, 0.95), accuracy: int = 10_000) -> DataFrame:
    """(metric, value): quantiles of the measures and approximate distinct counts of the entities, one scan."""
    aggs, names = [], []
    for m in measures:
        for p in probabilities:
            aggs.append(F.percentile_approx(m, F.lit(p), accuracy).cast("double"))
            names.append(f"{m}_p{round(100 * p)}")
    for e in entities:
        aggs.append(F.approx_count_distinct(e).cast("double"))
        names.append(f"approx_distinct_{e}")
    one = df.agg(*[a.alias(n) for a, n in zip(aggs, names, strict=True)])
    pairs = ", ".join(f"'{n}', `{n}`" for n in names)
    return one.selectExpr(f"stack({len(names)}, {pairs}) AS (metric, value)")


def daily_counts_from_text(spark: SparkSession, path: str, column: int = 3) -> DataFrame:
    """(purchase_date, order_count) from raw lines: the column-th field's first ten characters as a date, malformed ones left out."""
    lines = spark.read.text(path)
    header = F.lit(lines.limit(1).first()[0] if lines.take(1) else "")
    day = F.expr(f"try_to_date(substring(try_element_at(split(value, ','), {column + 1}), 1, 10))")
    return lines.filter(F.col("value") != header).select(day.alias("purchase_date")).filter("purchase_date IS NOT NULL").groupBy("purchase_date").agg(F.count("*").alias("order_count"))


def reconcile_daily_counts(raw_lines: DataFrame, parsed: DataFrame, typed: DataFrame, ts: str) -> DataFrame:
    """One row: raw body rows, counted and typed orders, their difference, malformed rows, days on which the two disagree.

    Rows of `typed` without a time count in its total and are a day of their own that never meets one of `parsed`.
    """
    by_day = typed.groupBy(F.to_date(ts).alias("purchase_date")).agg(F.count("*").alias("typed_count"))
    both = parsed.join(by_day, "purchase_date", "full_outer").select(
        F.coalesce("order_count", F.lit(0)).alias("a"), F.coalesce("typed_count", F.lit(0)).alias("b")
    )
    sums = both.agg(F.sum("a").alias("counted_orders"), F.sum("b").alias("typed_orders"), F.count(F.when(F.col("a") != F.col("b"), 1)).alias("days_disagreeing"))
    raw = raw_lines.agg(F.count("*").alias("raw_body_rows"))
    return raw.join(sums, F.lit(True)).select(
        "raw_body_rows", "counted_orders", "typed_orders", (F.col("counted_orders") - F.col("typed_orders")).alias("counted_minus_typed"),
        (F.col("raw_body_rows") - F.col("counted_orders")).alias("malformed_rows"), "days_disagreeing",
    )
