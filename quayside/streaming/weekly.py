"""The weekly volume as a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quayside.functions.columns import year_week
from quayside.plans.lineage import shared_path

SCHEMA = "order_id string, order_purchase_timestamp timestamp"


def prepare_stream_source(orders: DataFrame, path: str, n_files: int = 6, rows: int | None = 6000) -> str:
    """Orders with a time, in `n_files` Parquet files that a stream reads one by one; the source is a demonstration's, hence `rows`."""
    known = orders.filter("order_purchase_timestamp IS NOT NULL").select(F.col("order_id").cast("string").alias("order_id"), F.col("order_purchase_timestamp").cast("timestamp").alias("order_purchase_timestamp"))
    known = known.orderBy("order_id").limit(rows) if rows else known
    known.repartition(n_files).write.mode("overwrite").parquet(path)
    return path


def weekly_counts(orders: DataFrame, period: Column | None = None) -> DataFrame:
    """(year_week, order_count), of a batch or of a stream."""
    return orders.groupBy((year_week("order_purchase_timestamp") if period is None else period).alias("year_week")).agg(F.count("*").alias("order_count"))


def run_weekly_volume_stream(spark: SparkSession, path: str, table: str = "weekly_volume_stream", schema: str = SCHEMA) -> DataFrame:
    """Runs over all files there are, one a batch; weeks are few, so complete mode's state and the memory table stay small."""
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    query = (
        weekly_counts(source).writeStream.outputMode("complete").format("memory").queryName(table)
        .option("checkpointLocation", shared_path(spark, "stream")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.sql(f"SELECT year_week, order_count FROM {table} ORDER BY year_week")


# Extensions beyond complete mode, for streams whose keys do not stay few.


def windowed_counts(events: DataFrame, ts: str, key: str, watermark: str = "1 day", size: str = "1 day", slide: str | None = None) -> DataFrame:
    """Counts by key and tumbling or sliding window; state of windows behind the watermark goes, and later rows with it."""
    window = F.window(ts, size, slide) if slide else F.window(ts, size)
    return events.withWatermark(ts, watermark).groupBy(window.alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


def session_counts(events: DataFrame, ts: str, key: str, gap: str = "30 minutes", watermark: str = "1 day") -> DataFrame:
    window = F.session_window(ts, gap)
    return events.withWatermark(ts, watermark).groupBy(window.alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


def first_of_each(events: DataFrame, ts: str, keys: list[str], watermark: str = "1 day") -> DataFrame:
    """Repeats of a key within the watermark go."""
    return events.withWatermark(ts, watermark).dropDuplicatesWithinWatermark(keys)
