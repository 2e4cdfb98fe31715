"""The plan lint catches seeded bad plans and passes the registered queries that only relate tables."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from quayside import queries
from quayside.plans import lineage, planlint

DATA = "/root/testdata/sf0.001"
RELATIONAL = [
    "table_overview", "shared_key_cardinality", "cleaning_audit", "centroids", "text_ingest_reconciliation", "top_sellers_by_revenue", "late_rate_by_state", "order_lines", "weekly_volume",
    "weekly_features", "calendar_split", "naive_baselines", "regional_features", "reviews_with_seller", "sentiment_rollup", "lead_lag_correlations", "graph_edges", "degree_stats",
    "shared_customer_motifs", "backup_map", "category_cells", "catregion_edges", "motif_triangles", "motif_open_wedges", "batch_inference", "exact_percentile",
]


def orders(spark):
    return spark.read.parquet(f"{DATA}/orders.parquet")


def test_bad_plans_are_caught(spark):
    o = orders(spark)
    small = spark.read.parquet(f"{DATA}/nation.parquet")
    bad = {
        "join without keys": o.join(small, F.col("o_custkey") > F.col("n_nationkey")),
        "single partition": o.withColumn("rn", F.row_number().over(Window.orderBy("o_orderkey"))),
        "row function": o.select(F.udf(lambda x: x + 1, "long")("o_orderkey")),
        "filter above a scan": o.withColumn("r", F.col("o_orderkey")).repartition(3).filter("o_custkey = 3"),
    }
    plain = "Filter (isnotnull(k#1) AND (k#1 = 3))\n+- *(1) ColumnarToRow\n   +- FileScan parquet [k#1] Batched: true, PushedFilters: [], ReadSchema: struct<k:int>"
    assert planlint.findings_of(plain) == {"filter above a scan"} and planlint.findings_of(plain.replace("[]", "[EqualTo(k,3)]")) == set()
    for kind, df in bad.items():
        assert planlint.findings(df) == ({kind} if kind != "filter above a scan" else set())  # Spark pushes that one down by itself
    assert planlint.findings(o.groupBy("o_custkey").count().agg(F.sum("count"))) == set()


def test_plans_before_a_cut_count(spark):
    def query(spark, sf_dir):
        return lineage.cut(orders(spark).withColumn("rn", F.row_number().over(Window.orderBy("o_orderkey")))).select("rn")

    assert planlint.scan(spark, DATA, {"seeded": query}) == [("seeded", "single partition", False)] and lineage.WATCHERS == []


@pytest.mark.parametrize("name", RELATIONAL)
def test_registered_plans_are_clean(spark, name):
    assert [f for f in planlint.scan(spark, DATA, {name: queries.QUERIES[name]}) if not f[2]] == []
