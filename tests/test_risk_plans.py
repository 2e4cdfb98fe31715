"""What the risk index reads for its norms."""

from pyspark.sql import functions as F

from quayside.operators import risk
from quayside.plans import lineage


def test_norms_do_not_nest(spark, monkeypatch):
    """Each plan of the index reads some rows a few times; nested norms read 67 tables in one plan."""
    n = 40
    demand = spark.createDataFrame([(f"s{i}", "st", float(i % 7)) for i in range(n)], "seller_id string, seller_state string, avg_delay_days double")
    mood = spark.createDataFrame([(f"s{i}", float(i % 5), 0) for i in range(n)], "seller_id string, avg_sentiment_score double, sentiment_declining int")
    columns = "network_risk_score double, supply_concentration_risk double, pagerank_score double, substitutability_deficit double, n_category_substitutes long, catregion_backup_seller_id string, backup_seller_id string, backup_strength long, two_hop_reach_count long, community_id string"
    network = spark.createDataFrame([(f"s{i}", i / 3, 1 / (1 + i), 0.5, 0.1, 0, "a", "b", 0, 0, "c") for i in range(n)], f"seller_id string, {columns}")
    plans = []
    monkeypatch.setattr(lineage, "WATCHERS", [lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString())])
    index = risk.risk_index(demand, mood, network, exact=True)
    assert index.count() == n
    assert max(p.count("LogicalRDD") for p in plans) < 10


def test_sketched_buckets_do_not_merge(spark):
    """6,000 values that differ have all 1,000 buckets, and each value's is near its exact share."""
    df = spark.range(6000).select((F.col("id") * 7919 % 6007).cast("double").alias("x")).repartition(48)
    both = risk.exact_percentile(risk.percentile_norm(df, "x", "sketch"), "x", "exact")
    far, n = both.agg(F.max(F.abs(F.col("sketch") - F.col("exact"))), F.count_distinct("sketch")).first()
    assert far <= 0.005 and n > 990
