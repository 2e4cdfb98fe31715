"""The whole plan, from the nine tables to the watch-list, each step kept as Parquet if a cache is given."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quayside.functions.columns import year_week
from quayside.operators import boosting, demand, forecast, graph, profile, recurrent, risk, sentiment, text
from quayside.plans.lineage import cut
from quayside.plans.stepcache import StepCache
from quayside.sources import tables as source


class Marketplace:
    """Steps over tables of the source schemas.

    `delivered`, `delivered_on` and `expected_on` say what a delivered order is and
    from which columns its delay comes; `period` is the sentiment series' step.
    """

    def __init__(
        self, tables: dict[str, DataFrame], cache: StepCache | None = None, inputs: tuple[str, ...] = (), delivered: Column | None = None,
        delivered_on: str = "order_delivered_customer_date", expected_on: str = "order_estimated_delivery_date",
        period: Column | None = None, light: bool = False, cell_cap: int = graph.CELL_CAP,
    ):
        self.tables, self.cache, self.inputs = tables, cache, inputs
        self.delivered, self.delivered_on, self.expected_on = delivered, delivered_on, expected_on
        self.period = year_week("review_creation_date") if period is None else period
        self.light, self.cell_cap = light, cell_cap

    @classmethod
    def from_csv(cls, spark: SparkSession, folder: str, root: str | None = None, **options) -> Marketplace:
        return cls(source.load_all(spark, folder), StepCache(spark, root) if root else None, (folder,), **options)

    def _step(self, name: str, make: Callable[[], DataFrame | dict[str, DataFrame]], outputs: tuple[str, ...] = ()):
        """Kept by the cache, or checkpointed; several outputs are a dict."""
        if self.cache is None:
            made = make()
            return {k: cut(v) for k, v in made.items()} if isinstance(made, dict) else cut(made)
        paths = {o: f"{name}.{o}" for o in outputs} or {"": name}
        renamed = (lambda: {paths[k]: v for k, v in make().items()}) if outputs else make
        read = self.cache.step(name, self.inputs, list(paths.values()), [boosting, demand, forecast, graph, profile, recurrent, risk, sentiment, text])(lambda: renamed())()
        return {k: read[p] for k, p in paths.items()} if outputs else read

    # demand

    def _lines(self) -> DataFrame:
        t = self.tables
        return demand.order_lines(t["orders"], t["order_items"], t["sellers"], t["products"], self.delivered, self.delivered_on, self.expected_on)

    @cached_property
    def order_lines(self) -> DataFrame:
        return self._step("order_lines", lambda: profile.winsorize(self._lines(), "delay_days")[0])

    @cached_property
    def weekly_volume(self) -> DataFrame:
        return self._step("weekly_volume", lambda: demand.weekly_volume(self.order_lines))

    @cached_property
    def forecast(self) -> dict[str, DataFrame]:
        make = lambda: forecast.fit_and_score(self.weekly_volume, self.order_lines, self.tables["sellers"], self.light)
        return self._step("forecast", make, ("predictions", "metrics", "importances", "seller_scores"))

    @cached_property
    def regional_forecast(self) -> dict[str, DataFrame]:
        make = lambda: forecast.fit_regional_forecast(demand.weekly_volume(self.order_lines, "seller_state"), self.light)
        return self._step("regional_forecast", make, ("forecast", "metrics"))

    # sentiment

    @cached_property
    def reviews(self) -> DataFrame:
        t = self.tables
        return self._step("reviews", lambda: sentiment.reviews_with_seller(t["order_reviews"], t["orders"], t["order_items"], t["sellers"]))

    @cached_property
    def sentiment_rollup(self) -> DataFrame:
        return self._step("sentiment_rollup", lambda: sentiment.sentiment_rollup(self.reviews, self.period))

    @cached_property
    def sentiment_scores(self) -> DataFrame:
        return self._step("sentiment_scores", lambda: sentiment.seller_sentiment_scores(self.reviews, self.sentiment_rollup))

    def lead_lags(self) -> DataFrame:
        volume = self.weekly_volume.select("seller_id", F.col("year_week").alias("period"), F.col("weekly_order_count").alias("volume"))
        return sentiment.lead_lag_correlations(self.sentiment_rollup, volume)

    def negative_topics(self, **options) -> tuple[DataFrame, DataFrame]:
        negative = sentiment.label_reviews(self.reviews).filter("label = 0")
        stop = options.pop("stop", None) or text.stopwords("portuguese", text.DOMAIN_STOPWORDS_PT)
        return text.negative_topics(negative, "review_comment_message", "seller_id", stop, **options)

    def text_classifier(self, **options) -> dict:
        return text.fit_nlp(sentiment.label_reviews(self.reviews), "review_comment_message", "review_id", light=self.light, **options)

    def neural_scores(self, stop: list[str] | None = None, vocabulary: int = text.VOCAB) -> tuple[DataFrame, list[float]]:
        """(review_id, label, score of the held-out reviews) by the recurrent network, and its loss of each epoch."""
        labelled = sentiment.label_reviews(self.reviews).filter("review_comment_message IS NOT NULL")
        losses: list[float] = []

        def make() -> DataFrame:
            coded = cut(text.encode_sequences(labelled, "review_comment_message", stop or text.stopwords("portuguese"), vocabulary).select("review_id", "label", "seq"))
            train, test = text.hash_split(coded, "review_id")
            weights, found = recurrent.fit_recurrent(train, vocabulary)
            losses.extend(found)
            return text.batch_predict(test, "seq", "score", recurrent.scorer(weights), text.MAX_LEN).select("review_id", "label", "score")

        return self._step("neural_scores", make), losses

    # network

    @cached_property
    def geo_centroids(self) -> DataFrame:
        return self._step("geo_centroids", lambda: profile.geolocation_centroids(self.tables["geolocation"]))

    @cached_property
    def network_lines(self) -> DataFrame:
        people = self.tables["customers"].select("customer_id", "customer_unique_id")
        return self._step("network_lines", lambda: self._lines().join(people, "customer_id").select("customer_unique_id", "seller_id", "delay_days"))

    @cached_property
    def edges(self) -> DataFrame:
        return self._step("edges", lambda: graph.edges(self.network_lines))

    @cached_property
    def vertices(self) -> DataFrame:
        return self._step("vertices", lambda: graph.vertices(self.network_lines))

    @cached_property
    def catregion_edges(self) -> DataFrame:
        t, key = self.tables, F.col("seller_id").cast("string")
        cells = graph.category_cells(t["order_items"].withColumn("seller_id", key), t["products"], t["sellers"].withColumn("seller_id", key))
        return self._step("catregion_edges", lambda: graph.catregion_edges(cells, self.cell_cap))

    @cached_property
    def network_scores(self) -> DataFrame:
        motifs = self._step("motifs", lambda: graph.shared_customer_motifs(self.edges))
        return self._step("network_scores", lambda: graph.network_scores(self.vertices, self.edges, motifs, self.catregion_edges))

    def bfs_backups(self, n: int = 10) -> DataFrame:
        seeds = self.network_scores.orderBy(F.desc("pagerank_score"), "seller_id").limit(n).select(F.col("seller_id").alias("id"))
        return graph.bfs_backups(self.edges, seeds, self.vertices)

    # convergence

    @cached_property
    def risk_index(self) -> DataFrame:
        text_id = lambda df: df.withColumn("seller_id", F.col("seller_id").cast("string"))
        make = lambda: risk.risk_index(text_id(self.forecast["seller_scores"]), text_id(self.sentiment_scores), self.network_scores)
        return self._step("risk_index", make)

    def watchlist(self, n: int = 20) -> DataFrame:
        return risk.watchlist(self.risk_index, risk.risk_archetypes(self.risk_index)[0], n)
