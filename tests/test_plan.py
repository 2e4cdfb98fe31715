"""The whole plan over the smallest tables."""

from pyspark.sql import functions as F

from quayside.operators.risk import INDEX_COLUMNS
from quayside.plans.marketplace import Marketplace
from quayside.plans.stepcache import StepCache
from quayside.sources.tables import roles


def test_plan_from_tables_to_watchlist(spark, tmp_path):
    tables = roles(spark, "/root/testdata/sf0.001")
    options = dict(
        delivered=F.col("order_status") != "P", delivered_on="delivered_date", expected_on="order_purchase_timestamp",
        period=F.date_format("review_creation_date", "yyyy-MM-dd"), light=True,
    )
    plan = Marketplace(tables, StepCache(spark, str(tmp_path)), ("/root/testdata/sf0.001",), **options)
    assert plan.risk_index.columns == INDEX_COLUMNS and plan.risk_index.count() > 0
    assert plan.watchlist(5).count() <= 5 and plan.forecast["metrics"].count() == 1
    again = Marketplace(tables, StepCache(spark, str(tmp_path)), ("/root/testdata/sf0.001",), **options)
    names = [s[0] for s in plan.cache.summary()]
    assert again.risk_index.count() == plan.risk_index.count() and [s[0] for s in again.cache.summary()] == names and "risk_index" in names
    assert plan.lead_lags().count() == 9
