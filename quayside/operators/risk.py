"""The risk index: percentile norms, weights, bands and the watch-list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quayside.functions.columns import safe_corr
from quayside.operators.profile import quantiles
from quayside.operators.ranks import running_total
from quayside.plans.lineage import cut

WEIGHTS = {"demand_norm": 0.35, "sentiment_norm": 0.35, "network_norm": 0.30}
# --- fixed values: the action for each archetype --------------------------------
ARCHETYPE_ACTIONS = {
    "delay-driven": "Logistics audit",
    "sentiment-driven": "Account-manager call",
    "centrality-driven": "Dual-source + watchlist",
    "low-risk": "Routine monitoring",
}
# --- fixed values: the index's columns --------------------------------------------
INDEX_COLUMNS = [
    "seller_id", "seller_state", "risk_score", "risk_class", "demand_norm", "sentiment_norm", "network_norm", "contagion_norm", "supply_norm",
    "avg_delay_days", "avg_sentiment_score", "pagerank_score", "substitutability_deficit", "supply_concentration_risk",
    "n_category_substitutes", "catregion_backup_seller_id", "backup_seller_id", "backup_strength", "two_hop_reach_count", "community_id",
    "escalate_no_backup", "sentiment_declining",
]


def percentile_norm(df: DataFrame, col: str, out: str, buckets: int = 1000, relative_error: float = 0.001, invert: bool = False) -> DataFrame:
    """Quantile bucket of a value over the largest bucket; ties share one, and null stays null.

    The ends of buckets are sketched to a small part of a bucket at most: to a whole one,
    neighbours fall on each other where no values tie, and the buckets behind them move up.
    """
    from pyspark.ml.feature import QuantileDiscretizer

    value = -F.col(col) if invert else F.col(col)
    rows = df.withColumn("\x00x", value.cast("double"))
    model = QuantileDiscretizer(numBuckets=buckets, inputCol="\x00x", outputCol="\x00b", relativeError=min(relative_error, 0.02 / buckets), handleInvalid="keep").fit(rows.filter("`\x00x` IS NOT NULL"))
    known = F.when(F.col("\x00x").isNotNull(), F.col("\x00b"))
    top = model.transform(rows).agg(F.max(known)).first()[0] or 1.0
    return model.transform(rows).withColumn(out, known / F.lit(max(top, 1.0))).drop("\x00x", "\x00b")


def exact_percentile(df: DataFrame, col: str, out: str, invert: bool = False) -> DataFrame:
    """Share of the known values that are smaller than or equal to a value, from counts of distinct values sorted in ranges."""
    value = (-F.col(col) if invert else F.col(col)).cast("double")
    rows = df.withColumn("\x00x", value)
    counts = rows.filter("`\x00x` IS NOT NULL").groupBy("\x00x").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    shares = running_total(counts, "\x00x", "n", "upto").join(F.broadcast(total), F.lit(True)).select(F.col("\x00x").alias("\x00v"), (F.col("upto") / F.col("total")).alias(out))
    return rows.join(shares, F.col("\x00x") == F.col("\x00v"), "left").drop("\x00x", "\x00v")


def risk_index(demand: DataFrame, sentiment: DataFrame, network: DataFrame, exact: bool = False) -> DataFrame:
    """Sellers in all three legs with norms, the weighted score, bands and the escalation flag.

    Bands are cut at the 95th and 99th percentile of the score, strictly above.
    """
    norm = (lambda d, c, o, i=False: exact_percentile(d, c, o, i)) if exact else (lambda d, c, o, i=False: percentile_norm(d, c, o, invert=i))
    rows = cut(demand.join(sentiment, "seller_id").join(network, "seller_id"))
    # a norm reads its rows several times, so each is cut: left to nest, four of them are one plan over 67 tables
    rows = cut(norm(rows, "avg_delay_days", "demand_norm"))
    rows = cut(norm(rows, "avg_sentiment_score", "sentiment_norm", True))
    rows = cut(norm(rows, "network_risk_score", "contagion_norm"))
    rows = cut(norm(rows, "supply_concentration_risk", "supply_norm"))
    rows = rows.withColumn("network_norm", 0.5 * F.col("contagion_norm") + 0.5 * F.col("supply_norm"))
    d, s, n = (F.lit(WEIGHTS[k]) * F.col(k) for k in WEIGHTS)
    return banded(cut(rows.withColumn("risk_score", d + s + n)), exact).select(*INDEX_COLUMNS)


def banded(rows: DataFrame, exact: bool = False, cuts: tuple[float, float] = (0.95, 0.99)) -> DataFrame:
    warning, critical = quantiles(rows.select("risk_score"), "risk_score", list(cuts), 0.0 if exact else 0.001) or (1.0, 1.0)
    score = F.col("risk_score")
    band = F.when(score > critical, "CRITICAL").when(score > warning, "WARNING").otherwise("SAFE")
    rows = rows.withColumn("risk_class", band)
    alone = (F.col("n_category_substitutes") == 0) & (F.col("backup_strength") == 0) & (F.col("two_hop_reach_count") == 0)
    return rows.withColumn("escalate_no_backup", F.when((F.col("risk_class") != "SAFE") & alone, 1).otherwise(0))


def risk_band_counts(index: DataFrame) -> DataFrame:
    """Sellers by band, from SAFE to CRITICAL."""
    order = F.when(F.col("risk_class") == "SAFE", 0).when(F.col("risk_class") == "WARNING", 1).otherwise(2)
    return index.groupBy("risk_class").agg(F.count("*").alias("n_sellers")).orderBy(order)


def state_mean_risk(index: DataFrame) -> DataFrame:
    by = index.filter("seller_state IS NOT NULL").groupBy("seller_state").agg(F.avg("risk_score").alias("mean_risk"), F.count("*").alias("n_sellers"))
    return by.orderBy(F.desc("mean_risk"), "seller_state")


def component_correlations(index: DataFrame) -> DataFrame:
    return index.agg(*[safe_corr(F.col("risk_score"), F.col(c)).alias(f"corr_{c}") for c in WEIGHTS])


def coverage(index: DataFrame, sellers: DataFrame) -> DataFrame:
    """(n_sellers, n_scored, n_missing): sellers that the index's inner joins lose."""
    both = sellers.select("seller_id").distinct().join(index.select("seller_id", F.lit(1).alias("scored")), "seller_id", "left")
    counted = both.agg(F.count("*").alias("n_sellers"), F.count("scored").alias("n_scored"))
    return counted.withColumn("n_missing", F.col("n_sellers") - F.col("n_scored"))


def top_for_quadrant(index: DataFrame, n: int = 50) -> DataFrame:
    return index.orderBy(F.desc("risk_score"), "seller_id").limit(n)


def recommend_action(archetype: Column, escalate: Column) -> Column:
    actions = F.create_map(*[F.lit(x) for pair in ARCHETYPE_ACTIONS.items() for x in pair])
    return F.when(escalate == 1, F.lit("Escalate — no backup")).otherwise(F.coalesce(F.try_element_at(actions, archetype), F.lit("Routine monitoring")))


def watchlist(index: DataFrame, archetypes: DataFrame, n: int = 20) -> DataFrame:
    """The n riskiest sellers with archetype and action."""
    top = index.orderBy(F.desc("risk_score"), "seller_id").limit(n)
    joined = top.join(archetypes.select("seller_id", "archetype"), "seller_id", "left")
    return joined.withColumn("recommended_action", recommend_action(F.col("archetype"), F.col("escalate_no_backup")))


def _vectors(index: DataFrame, cols: list[str]) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    return VectorAssembler(inputCols=cols, outputCol="features", handleInvalid="skip").transform(index)


def kmeans_elbow(index: DataFrame, cols: tuple[str, ...] = tuple(WEIGHTS), ks: range = range(2, 7), seed: int = 8825) -> DataFrame:
    """(k, wssse, silhouette)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.evaluation import ClusteringEvaluator

    rows = _vectors(index, list(cols)).select("features").cache()
    out = []
    for k in ks:
        model = KMeans(k=k, seed=seed).fit(rows)
        out.append((k, float(model.summary.trainingCost), float(ClusteringEvaluator().evaluate(model.transform(rows)))))
    rows.unpersist()
    return index.sparkSession.createDataFrame(out, "k int, wssse double, silhouette double")


def archetype_of(centroid: list[float], low: float = 0.30) -> str:
    if max(centroid) < low:
        return "low-risk"
    return ["delay-driven", "sentiment-driven", "centrality-driven"][max(range(3), key=lambda i: (centroid[i], -i))]


def risk_archetypes(index: DataFrame, k: int = 4, seed: int = 8825) -> tuple[DataFrame, DataFrame]:
    """(index with cluster and archetype, summary by cluster): clusters named by their centroid's largest part."""
    from pyspark.ml.clustering import KMeans

    rows = _vectors(index, list(WEIGHTS))
    model = KMeans(k=k, seed=seed, predictionCol="cluster").fit(rows)
    names = F.create_map(*[F.lit(x) for i, c in enumerate(model.clusterCenters()) for x in (i, archetype_of(list(c)))])
    labelled = model.transform(rows).withColumn("archetype", names[F.col("cluster")]).drop("features")
    summary = labelled.groupBy("cluster", "archetype").agg(F.count("*").alias("n_sellers"), *[F.avg(c).alias(f"mean_{c}") for c in WEIGHTS])
    return labelled, summary
