"""The small frames behind charts: aggregated or limited before anything leaves the cluster."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quayside.functions.columns import safe_corr
from quayside.sources.tables import Table


def top_n(df: DataFrame, by: str, n: int = 10, ascending: bool = False) -> DataFrame:
    return df.orderBy(F.asc(by) if ascending else F.desc(by), *[c for c in df.columns if c != by]).limit(n)


def class_balance(labelled: DataFrame, label: str = "label") -> DataFrame:
    """(label, n, share)."""
    counts = labelled.groupBy(label).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(total), F.lit(True)).select(label, "n", (F.col("n") / F.col("total")).alias("share"))  # one row


def state_bar(df: DataFrame, state: str, value: str, n: int = 30) -> DataFrame:
    return df.groupBy(state).agg(F.avg(value).alias(f"mean_{value}"), F.count("*").alias("n")).orderBy(F.desc(f"mean_{value}"), state).limit(n)


def feature_importances(importances: DataFrame, n: int = 15) -> DataFrame:
    return top_n(importances, "importance", n)


def heatmap(long: DataFrame, row: str, column: str, value: str, columns: list | None = None) -> DataFrame:
    """A row for each `row` value and a column for each `column` value."""
    return long.groupBy(row).pivot(column, columns).agg(F.first(value)).orderBy(row)


def band_shares(counts: DataFrame) -> DataFrame:
    total = counts.agg(F.sum("n_sellers").alias("total"))
    return counts.join(F.broadcast(total), F.lit(True)).select("risk_class", "n_sellers", (F.col("n_sellers") / F.col("total")).alias("share"))  # one row


def quadrant(index: DataFrame, x: str, y: str, n: int = 50) -> DataFrame:
    """The n riskiest sellers with the medians that the crosshairs mark."""
    medians = index.agg(F.percentile_approx(x, 0.5).alias("x_median"), F.percentile_approx(y, 0.5).alias("y_median"))
    top = index.orderBy(F.desc("risk_score"), "seller_id").limit(n).select("seller_id", x, y, "risk_class")
    return top.join(F.broadcast(medians), F.lit(True))  # one row


def confusion_shares(confusion: DataFrame) -> DataFrame:
    """Each count as a share of its label's row."""
    rows = confusion.groupBy("label").agg(F.sum("n").alias("total"))
    return confusion.join(rows, "label").select("label", "prediction", "n", (F.col("n") / F.col("total")).alias("share"))


def correlation_matrix(df: DataFrame, cols: list[str]) -> DataFrame:
    """(a, b, corr) of all pairs of columns, in one pass."""
    pairs = [(a, b) for a in cols for b in cols]
    one = df.agg(*[safe_corr(F.col(a), F.col(b)).alias(f"p{i}") for i, (a, b) in enumerate(pairs)])
    listed = ", ".join(f"'{a}', '{b}', p{i}" for i, (a, b) in enumerate(pairs))
    return one.selectExpr(f"stack({len(pairs)}, {listed}) AS (a, b, corr)")


def archetype_points(labelled: DataFrame, x: str = "demand_norm", y: str = "sentiment_norm", n: int = 500) -> DataFrame:
    return labelled.orderBy(F.desc("risk_score"), "seller_id").limit(n).select("seller_id", x, y, "archetype")


def schema_links(registry: dict[str, Table]) -> list[tuple[str, str, str]]:
    """(table, key, table that it names): who holds a key that is another's primary key."""
    keys = {t.pk[0]: name for name, t in registry.items() if t.pk and len(t.pk) == 1}
    return [(name, fk, keys[fk]) for name, t in registry.items() for fk in t.fks if fk in keys and keys[fk] != name]


def schema_edges(spark: SparkSession, registry: dict[str, Table]) -> DataFrame:
    return spark.createDataFrame(schema_links(registry), "table_name string, foreign_key string, references string")


def weekly_trend(weekly: DataFrame, series: list[str], entity: str, period: str) -> DataFrame:
    """(period, entity, series, value) of a few entities."""
    parts = [weekly.select(period, entity, F.lit(s).alias("series"), F.col(s).cast("double").alias("value")) for s in series]
    return reduce(DataFrame.unionByName, parts).orderBy(entity, "series", period)


def residuals(forecast: DataFrame, actual: str = "actual", predicted: str = "predicted", bins: int = 20) -> DataFrame:
    """Counts of residuals in equal bins between their extremes."""
    rows = forecast.select((F.col(actual) - F.col(predicted)).alias("r"))
    span = rows.agg(F.min("r").alias("lo"), F.max("r").alias("hi"))
    at = F.least(F.floor(F.try_divide((F.col("r") - F.col("lo")) * bins, F.col("hi") - F.col("lo"))), F.lit(bins - 1))
    return rows.join(F.broadcast(span), F.lit(True)).groupBy(F.coalesce(at, F.lit(0)).cast("int").alias("bin")).agg(F.count("*").alias("n"), F.avg("r").alias("mean_residual"))  # one row


def quantile_table(quantiles: DataFrame, names: tuple[str, ...] = ("p25", "p50", "p75", "p95")) -> DataFrame:
    """A row for each measure and a column for each quantile, from (metric, value) with metrics as in price_p25."""
    parts = quantiles.select(F.regexp_extract("metric", "^(.*)_(p[0-9]+)$", 1).alias("measure"), F.regexp_extract("metric", "_(p[0-9]+)$", 1).alias("at"), "value")
    return parts.groupBy("measure").pivot("at", list(names)).agg(F.first("value"))


def lag_bars(correlations: DataFrame) -> DataFrame:
    """(lag, corr, n_pairs, is_peak): the peak is the largest absolute correlation, the smallest lag of equals."""
    peak = correlations.filter("corr IS NOT NULL").agg(F.min_by("lag", F.struct(-F.abs("corr"), F.col("lag"))).alias("peak"))
    return correlations.join(F.broadcast(peak), F.lit(True)).select("lag", "corr", "n_pairs", F.coalesce(F.col("lag") == F.col("peak"), F.lit(False)).alias("is_peak"))  # one row


def elbow_points(elbow: DataFrame, chosen: int = 4) -> DataFrame:
    """(k, wssse, share_of_first, is_chosen) in order of k."""
    first = elbow.agg(F.min_by("wssse", "k").alias("first"))
    return elbow.join(F.broadcast(first), F.lit(True)).select("k", "wssse", F.try_divide("wssse", "first").alias("share_of_first"), (F.col("k") == chosen).alias("is_chosen")).orderBy("k")  # one row


def temporal_bars(coverage: DataFrame) -> DataFrame:
    """(label, first_ts, last_ts, n_non_null): a bar for each time column, the earliest first."""
    label = F.concat_ws(" · ", "table_name", "column_name")
    return coverage.select(label.alias("label"), "first_ts", "last_ts", "n_non_null").orderBy("first_ts", "label")


def key_bars(cardinality: DataFrame, value: str = "approx_distinct", tables: list[str] | None = None) -> DataFrame:
    """A row for each shared key and a column of distinct values for each table, 0 where the table has no such key."""
    return cardinality.groupBy("shared_key").pivot("table_name", tables).agg(F.first(value)).fillna(0)
