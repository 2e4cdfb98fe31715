"""Hand fixtures with results worked out by hand."""

import datetime as dt

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quayside.functions.columns import decay_weights, safe_corr, year_week
from quayside.operators import charts, demand, graph, profile, risk, sentiment, text
from quayside.plans import lint
from quayside.plans.stepcache import StepCache
from quayside.sources import tables


def rows(df, *cols):
    return sorted(tuple(r[c] for c in (cols or df.columns)) for r in df.collect())


def test_year_week_at_year_edges(spark):
    days = [dt.datetime(2017, 1, 1), dt.datetime(2016, 12, 31), dt.datetime(2018, 12, 31)]
    df = spark.createDataFrame([(d,) for d in days], "t timestamp").select(year_week("t").alias("w"))
    assert [r.w for r in df.collect()] == ["2017-52", "2016-52", "2018-01"]


def test_winsorize_keeps_nulls(spark):
    df = spark.range(100).select(F.col("id").cast("int").alias("x")).union(spark.createDataFrame([(None,)], "x int"))
    out, lo, hi, n = profile.winsorize(df, "x", relative_error=0.0)
    assert (lo, hi, n) == (0.0, 98.0, 1)
    assert out.filter("x IS NULL").count() == 1 and out.agg(F.max("x")).first()[0] == 98.0


def weekly(spark, values, seller="a"):
    return spark.createDataFrame([(seller, f"2017-{i + 9:02d}", v) for i, v in enumerate(values)], "seller_id string, year_week string, weekly_order_count long")


def test_decay_of_a_constant_series(spark):
    out = demand.add_weekly_features(weekly(spark, [7] * 9)).orderBy("year_week").collect()
    assert [r.decay_wtd_8w for r in out[:8]] == [None] * 8 and out[8].decay_wtd_8w == pytest.approx(7)
    assert sum(decay_weights()) == pytest.approx(2.4580096)


def test_lags_and_rolling_mean(spark):
    out = demand.add_weekly_features(weekly(spark, [1, 2, 3, 4, 5, 6])).orderBy("year_week").collect()
    assert [r.rolling_4w_mean for r in out] == [None, 1, 1.5, 2, 2.5, 3.5]
    assert [r.lag_4 for r in out] == [None] * 4 + [1, 2]
    assert [r.is_q4 for r in out[:2]] == [0, 1]
    fixed = demand.add_weekly_features(weekly(spark, [1, 2]), corrected=True)
    assert fixed.agg(F.sum("is_q4")).first()[0] == 0


def test_splits():
    assert demand.calendar_split_threshold(0, 100) == 80
    assert demand.rolling_origin_folds(0, 100, 3) == [(1, 25, 50), (2, 50, 75), (3, 75, 100)]


@settings(max_examples=50, deadline=None)
@given(st.integers(0, 50), st.integers(1, 500), st.integers(1, 6))
def test_rolling_origin_never_trains_on_later_weeks(lo, span, n):
    folds = demand.rolling_origin_folds(lo, lo + span, n)
    assert all(a <= b for _, a, b in folds) and folds[-1][2] == lo + span


def test_labels(spark):
    df = spark.createDataFrame([(i, s) for i, s in enumerate([1, 2, 3, 4, 5, None])], "review_id int, review_score int")
    assert rows(sentiment.label_reviews(df), "review_score", "label") == [(1, 0), (2, 0), (4, 1), (5, 1)]


def reviews(spark, means, seller="a"):
    return spark.createDataFrame([(seller, f"{i:02d}", m) for i, m in enumerate(means)], "seller_id string, p string, review_score int")


def test_trend_and_slope(spark):
    for means, trend, declining in (([5] * 6 + [4] * 6, -1.0, 1), ([5] * 6, 0.0, 0)):
        r = reviews(spark, means)
        roll = sentiment.sentiment_rollup(r, F.col("p"))
        got = sentiment.seller_sentiment_scores(r, roll).first()
        assert got.sentiment_trend_6wk == pytest.approx(trend) and got.sentiment_declining == declining
    roll = sentiment.sentiment_rollup(reviews(spark, [1, 2, 3, 4, 5, 6]), F.col("p"))
    for f in (sentiment.sentiment_slopes, sentiment.sentiment_slopes_pandas):
        assert rows(f(roll)) == [("a", 1.0, 6, 3.5)]
    assert sentiment.sentiment_slopes(sentiment.sentiment_rollup(reviews(spark, [1, 2, 3, 4, 5]), F.col("p"))).count() == 0


def test_lead_lag_without_variance_is_null(spark):
    roll = sentiment.sentiment_rollup(reviews(spark, [3] * 8), F.col("p"))
    out = sentiment.lead_lag_correlations(roll, roll.select("seller_id", "period", F.col("n_reviews").alias("volume")))
    assert [r["corr"] for r in out.collect()] == [None] * 9 and sentiment.peak_lag(out).count() == 0
    assert roll.agg(safe_corr(F.col("avg_score"), F.col("n_reviews"))).first()[0] is None


@pytest.fixture(scope="module")
def small_graph(spark):
    bought = [("1", "A"), ("1", "B"), ("2", "A"), ("2", "B"), ("3", "B"), ("3", "C"), ("4", "B"), ("4", "C"), ("5", "C"), ("5", "D")]
    lines = spark.createDataFrame([(c, s, 1) for c, s in bought], "customer_unique_id string, seller_id string, delay_days int")
    return graph.vertices(lines), graph.edges(lines)


def test_graph_fixture(spark, small_graph):
    vertex, edge = small_graph
    motifs = graph.shared_customer_motifs(edge)
    assert rows(motifs) == [("A", "B", 2), ("B", "C", 2), ("C", "D", 1)]
    shared = graph.cocustomer_edges(motifs)
    assert rows(shared, "src", "dst") == [("A", "B"), ("B", "A"), ("B", "C"), ("C", "B")]
    assert rows(graph.backup_map(motifs)) == [("A", "B", 2, 1), ("B", "A", 2, 2), ("C", "B", 2, 2), ("D", "C", 1, 1)]
    assert rows(graph.two_hop_backups(shared)) == [("A", 1, "C"), ("C", 1, "A")]
    assert rows(graph.degree_stats(vertex, edge), "id", "in_degree_purchase_only") == [("A", 2), ("B", 4), ("C", 3), ("D", 1)]
    parts = graph.connected_components(edge, vertex)
    assert parts.count() == 9 and {r.component_size for r in parts.collect()} == {9}
    seeds = spark.createDataFrame([("A",), ("B",)], "id string")
    assert rows(graph.bfs_backups(edge, seeds, vertex)) == [("A", "B", 2), ("B", "A", 2)]
    assert graph.pagerank(edge).agg(F.sum("pagerank")).first()[0] == pytest.approx(9)


def test_two_hops_go_by_the_second_weight(spark):
    """A reaches C and D behind B; the bridge to D is the stronger one, whatever A's own link weighs."""
    edge = graph.mirrored(spark.createDataFrame([("A", "B", 9), ("B", "C", 2), ("B", "D", 5)], "a string, b string, w long"), "a", "b", "w")
    assert rows(graph.two_hop_backups(edge)) == [("A", 2, "D"), ("C", 2, "A"), ("D", 2, "A")]


def test_people_with_many_sellers_are_tiled(spark):
    bought = [(c, s) for c in range(3) for s in range(40) if (s + c) % (c + 2)]
    lines = spark.createDataFrame([(str(c), f"s{s:02}", 1) for c, s in bought], "customer_unique_id string, seller_id string, delay_days int")
    edge = graph.edges(lines)
    assert rows(graph.shared_customer_motifs(edge, tile=7)) == rows(graph.shared_customer_motifs(edge))


def test_catregion_cells_are_capped(spark):
    cells = spark.createDataFrame([(f"s{k}", "x", "c", 9 - k) for k in range(6)], "seller_id string, seller_state string, product_category_name string, n_items long")
    assert graph.catregion_edges(cells, cap=3).count() == 6 and graph.catregion_edges(cells).count() == 30


def test_sellers_without_a_master_row_are_scored(spark):
    scored = spark.createDataFrame([("a", "2020-01", 1.0, 2.0), ("b", "2020-01", 0.0, 2.0)], "seller_id string, year_week string, label double, prediction double")
    lines = spark.createDataFrame([("a", 5), ("b", 1)], "seller_id string, delay_days int")
    out = rows(demand.seller_demand_scores(scored, lines, spark.createDataFrame([("a", "X")], "seller_id string, seller_state string")))
    assert out == [("a", "X", 100.0, 5.0, 1), ("b", None, 0.0, 1.0, 0)]


def test_lags_skip_periods_without_scores(spark):
    score = spark.createDataFrame([("a", f"p{k}", None if k == 2 else float(k * k)) for k in range(6)], "seller_id string, period string, avg_score double")
    volume = spark.createDataFrame([("a", f"p{k}", k % 3) for k in range(6)], "seller_id string, period string, volume long")
    got = sentiment.lead_lag_correlations(score, volume).filter("lag = 0").first()
    assert got.n_pairs == 4


def test_network_scorer_matches_the_model(spark):
    rows_ = spark.createDataFrame([(k, float(k % 2), f"alpha beta w{k % 2} {'gamma ' * (k % 4)}") for k in range(40)], "doc_id long, label double, text string")
    coded = text.encode_sequences(rows_, "text", [], 12, 8)
    vectors = text.term_vectors(coded, "seq", 12)
    model = text.fit_mlp(vectors, 12, 4, 20)
    own = {r.doc_id: r.probability[1] for r in model.transform(vectors).collect()}
    made = text.batch_predict(coded, "seq", "score", text.mlp_batch_scorer(model, 12), 8).collect()
    assert all(r.score == pytest.approx(own[r.doc_id]) for r in made)


def test_network_scores_fixture(spark, small_graph):
    vertex, edge = small_graph
    cat = spark.createDataFrame([("A", "B", 1), ("B", "A", 1)], "src string, dst string, weight long")
    out = {r.seller_id: r for r in graph.network_scores(vertex, edge, graph.shared_customer_motifs(edge), cat, rounds=2).collect()}
    assert [round(out[s].substitutability_deficit, 4) for s in "ABCD"] == [1.0, 1.3333, 1.0, 0.5]
    assert out["A"].supply_concentration_risk == 0.5 and out["D"].supply_concentration_risk == 1.0 and out["D"].community_id == "-1"


def test_size_bins(spark):
    sizes = [1, 2, 4, 5, 9, 10, 99, 100]
    df = spark.createDataFrame([(str(i), n) for i, n in enumerate(sizes)], "component string, component_size long")
    assert dict(rows(graph.component_histogram(df))) == {"1 (isolated)": 1, "2–4": 2, "5–9": 2, "10–99": 2, "100+": 1}


def test_percentile_norm_ties(spark):
    df = spark.createDataFrame([(v,) for v in [0.0] * 34 + [1.0] * 33 + [2.0] * 33 + [None]], "x double")
    out = {r.x: r.n for r in risk.percentile_norm(df, "x", "n").collect()}
    assert out == {0.0: pytest.approx(1 / 3), 1.0: pytest.approx(2 / 3), 2.0: 1.0, None: None}
    exact = {r.x: r.n for r in risk.exact_percentile(df, "x", "n").collect()}
    assert exact == {0.0: pytest.approx(0.34), 1.0: pytest.approx(0.67), 2.0: 1.0, None: None}


def test_bands(spark):
    df = spark.range(1, 101).select(F.col("id").cast("double").alias("risk_score"), F.lit(0).alias("n_category_substitutes"), F.lit(0).alias("backup_strength"), F.lit(0).alias("two_hop_reach_count"))
    out = risk.banded(df, exact=True)
    assert {r.risk_class: r.n_sellers for r in risk.risk_band_counts(out).collect()} == {"SAFE": 95, "WARNING": 4, "CRITICAL": 1}
    assert out.agg(F.sum("escalate_no_backup")).first()[0] == 5


def test_archetypes_and_actions(spark):
    named = [risk.archetype_of(c) for c in ([0.9, 0.2, 0.1], [0.1, 0.9, 0.2], [0.1, 0.2, 0.9], [0.25, 0.2, 0.1])]
    assert named == ["delay-driven", "sentiment-driven", "centrality-driven", "low-risk"]
    df = spark.createDataFrame([("low-risk", 1), ("low-risk", 0), ("?", 0)], "a string, e int")
    got = [r[0] for r in df.select(risk.recommend_action(F.col("a"), F.col("e"))).collect()]
    assert got == ["Escalate — no backup", "Routine monitoring", "Routine monitoring"]


def test_topics(spark):
    assert text.label_topics({0: ["entrega", "qualidade"], 1: ["nada"], 2: ["errado", "troca", "prazo"]}) == {0: "late_or_not_delivered", 1: "other", 2: "wrong_or_incomplete"}
    df = spark.createDataFrame([([0.4, 0.4, 0.2], 0.5, 0.5)], "p array<double>, late double, other double")
    shares = dict.fromkeys(text.MODE_ORDER, F.lit(0.0)) | {"late_or_not_delivered": F.col("late"), "other": F.col("other")}
    assert tuple(df.select(text.first_argmax(F.col("p")), text.dominant_mode(shares)).first()) == (0, "other")


def test_sequences(spark):
    df = spark.createDataFrame([("o bom bom péssimo",), ("",)], "t string")
    seqs = [r.seq for r in text.encode_sequences(df, "t", ["o"], length=4).collect()]
    assert seqs == [[2, 2, 3, 0], [0, 0, 0, 0]]


def test_mlp_learns(spark):
    from pyspark.ml.linalg import Vectors

    data = spark.createDataFrame([(Vectors.dense([float(i % 2), 1.0]), float(i % 2)) for i in range(40)], ["features", "label"])
    out = text.fit_mlp(data, 2, hidden=4).transform(data)
    assert out.filter("prediction = label").count() == 40


def test_reconciliation(spark, tmp_path):
    (tmp_path / "orders.csv").write_text("order_id,customer_id,status,ts\n1,a,x,2017-01-01 10:00:00\n2,a,x,2017-01-01 11:00:00\n3,a,x,2017-01-02 09:00:00\n4,a,x,\n")
    path = str(tmp_path / "orders.csv")
    raw = spark.read.text(path).filter("value NOT LIKE 'order_id,%'")
    typed = spark.read.option("header", True).schema("order_id string, c string, s string, ts timestamp").csv(path)
    out = profile.reconcile_daily_counts(raw, profile.daily_counts_from_text(spark, path), typed, "ts").first()
    assert (out.raw_body_rows, out.counted_orders, out.malformed_rows, out.days_disagreeing) == (4, 3, 1, 1)  # the row without a time is a day of its own


def test_csv_sources(spark, tmp_path):
    (tmp_path / "x_order_reviews_dataset.csv").write_text('review_id,order_id,review_score,review_comment_title,review_comment_message,review_creation_date,review_answer_timestamp\nr1,o1,5,,"two\nlines, ""quoted""",2018-01-01 00:00:00,\nr2,o2,bad,,,,\n')
    out = tables.load(spark, str(tmp_path), "order_reviews").orderBy("review_id").collect()
    assert [r.review_score for r in out] == [5, None] and out[0].review_comment_message == 'two\nlines, "quoted"'
    assert set(tables.TABLES) == set(tables.SCHEMAS) and len(tables.TABLES) == 9


def test_step_cache(spark, tmp_path, monkeypatch):
    steps, ran = StepCache(spark, str(tmp_path)), []
    (tmp_path / "in.txt").write_text("1")

    def make(version=1, code=()):
        @steps.step("s", inputs=["in.txt"], outputs=["out"], code=code, version=version)
        def f():
            ran.append(1)
            return spark.range(3)

        return f

    assert make()().count() == 3 and make()().count() == 3 and len(ran) == 1
    make()(force=True)
    make(version=2)()
    (tmp_path / "in.txt").write_text("22")
    make(version=2)()
    make(version=2, code=[year_week])()
    assert len(ran) == 5
    monkeypatch.setenv("FORCE_STEPS", "1")
    make(version=2, code=[year_week])()
    assert len(ran) == 6 and [s[0] for s in steps.summary()] == ["s"]
    with pytest.raises(TypeError):
        steps.step("t", outputs=["o"])(lambda: 1)()


def test_compliance(spark):
    failed = [(r.check, r.detail) for r in lint.run_all(spark).filter("NOT passed").collect()]
    assert failed == []


def test_chart_frames(spark):
    labelled = spark.createDataFrame([(0,), (1,), (1,), (1,)], "label int")
    assert rows(charts.class_balance(labelled)) == [(0, 1, 0.25), (1, 3, 0.75)]
    conf = spark.createDataFrame([(0, 0, 3), (0, 1, 1)], "label int, prediction int, n long")
    assert [r.share for r in charts.confusion_shares(conf).orderBy("prediction").collect()] == [0.75, 0.25]
    res = spark.createDataFrame([(1.0, 1.0), (3.0, 1.0)], "actual double, predicted double")
    assert charts.residuals(res).agg(F.sum("n")).first()[0] == 2
    assert charts.schema_edges(spark, tables.TABLES).count() >= 5
    assert charts.correlation_matrix(res, ["actual", "predicted"]).count() == 4
    index = spark.createDataFrame([("a", 0.1, 0.2, 0.9, "SAFE"), ("b", 0.3, 0.4, 0.1, "SAFE")], "seller_id string, x double, y double, risk_score double, risk_class string")
    assert charts.quadrant(index, "x", "y", 1).first().seller_id == "a"
    assert charts.heatmap(conf, "label", "prediction", "n").columns == ["label", "0", "1"]


def test_stream_extensions_are_streams(spark):
    from quayside.streaming import weekly as w

    events = spark.createDataFrame([(dt.datetime(2024, 1, 1, h), "k") for h in (1, 2, 5)], "ts timestamp, k string")
    assert rows(w.windowed_counts(events, "ts", "k", size="4 hours"), "n") == [(1,), (2,)]
    assert w.windowed_counts(events, "ts", "k", size="2 hours", slide="1 hour").agg(F.sum("n")).first()[0] == 6
    assert rows(w.session_counts(events, "ts", "k", "90 minutes"), "n") == [(1,), (2,)]


def test_sql_queries_and_reports(spark):
    lines = spark.createDataFrame([("a", "SP", 1.0, 2, "2017-01"), ("b", "RJ", 3.0, -1, "2017-02")], "seller_id string, seller_state string, price double, delay_days int, year_week string")
    found = demand.sql_queries(lines)
    assert set(found) == {"top_sellers", "weekly_preview", "late_rate"} and all("SELECT" in sql and df.count() == 2 for sql, df in found.values())
    bfs = spark.createDataFrame([("a", "b", 2), ("c", None, None)], "seller_id string, backup_seller_id string, hop_count int")
    assert rows(graph.hop_distribution(bfs), "hops", "n") == [("2", 1), ("none", 1)]
    members = spark.createDataFrame([("a", "x", 2), ("b", "x", 2), ("c", "y", 1)], "id string, community string, community_size long")
    assert rows(graph.largest_communities(members, 1)) == [("x", 2)]
    scored, every = spark.createDataFrame([("a",)], "seller_id string"), spark.createDataFrame([("a",), ("b",)], "seller_id string")
    assert rows(risk.coverage(scored, every)) == [(2, 1, 1)]


def test_entry_needs_no_session_and_no_text_operators(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root / "quayside", tmp_path / "quayside", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert 'risk_index' in e.queries() and set(e.oracle_sql()) <= set(e.queries()); assert not any(n.startswith('op') and n[2].isdigit() for n in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": ""}, check=True, timeout=120)


def test_running_total_over_ranges(spark):
    from quayside.operators.ranks import running_total

    df = spark.range(500).select((F.col("id") * 7 % 500).cast("double").alias("v"), F.lit(2).alias("n"))
    out = running_total(df, "v", "n", "upto").collect()
    assert sorted((r.v, r.upto) for r in out) == [(float(i), 2 * i + 2) for i in range(500)]
    assert running_total(df.limit(0), "v", "n", "upto").count() == 0


def test_registered_models_are_whole(spark, monkeypatch):
    """Registered forecasts search the full grids and topics take the operator's own sizes; light is for tests."""
    from quayside import queries
    from quayside.operators import forecast

    data, seen = "/root/testdata/sf0.001", []

    def search(train, features, keys, light=False, n_splits=3):
        seen.append((light, n_splits))
        raise RuntimeError("seen")

    queries.forget()
    monkeypatch.setattr(forecast, "search", search)
    monkeypatch.setattr(text, "negative_topics", lambda rows, of, entity, stop, **sizes: seen.append(sizes) or [rows.limit(0)] * 2)
    try:
        for name in ("demand_forecast_scores", "regional_forecast"):
            with pytest.raises(RuntimeError, match="seen"):
                queries.QUERIES[name](spark, data)
        queries.QUERIES["negative_topics"](spark, data)
    finally:
        queries.forget()  # what the stubs made is no other test's
    assert seen == [(False, 3), (False, 0), {}]
