"""The staged booster against the library's, and the recurrent network against its own loss."""

import math
import random
import time

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from quayside.operators import boosting, forecast, profile, recurrent, text


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(1)
    made = []
    for i in range(700):
        a, b, c = rng.randint(0, 9), rng.randint(0, 6), rng.randint(0, 3)
        made.append((i, float(a), float(b), float(c), 3.0 * (a > 4) + a * b / 5 + math.sin(c) * (b > 2) + rng.gauss(0, 0.3), i % 40))
    df = spark.createDataFrame(made, "seller_id long, a double, b double, c double, label double, global_week_idx int").withColumn("year_week", F.col("global_week_idx").cast("string"))
    return VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(df).cache()


GRID = {"maxDepth": [2, 4], "stepSize": [0.05, 0.1], "maxIter": [3, 12]}


@pytest.mark.parametrize("shared", [boosting.SHARED_ROWS, 0])
def test_staged_search_is_the_plain_grid(spark, rows, monkeypatch, shared):
    """From broadcast rows and from blocks, every setting's held-out error on every fold is that of a fit of its own, so the choice is the same."""
    monkeypatch.setattr(boosting, "SHARED_ROWS", shared)
    folds = forecast.folds_of(rows, ["seller_id", "year_week"], 2, 2)
    got = boosting.staged_search(rows, ["a", "b", "c"], "label", folds.fit, folds.held, folds.n, *GRID.values())
    assert len(got) == folds.n * 8
    for r in got:
        if (r["maxDepth"], r["stepSize"]) not in ((2, 0.05), (4, 0.1)) or r["fold"] % 2:
            continue
        bit = F.lit(1 << r["fold"])
        fit, held = rows.filter(folds.fit.bitwiseAND(bit) != 0), rows.filter(folds.held.bitwiseAND(bit) != 0)
        model = GBTRegressor(labelCol="label", maxDepth=r["maxDepth"], stepSize=r["stepSize"], maxIter=r["maxIter"], seed=1).fit(fit)
        assert r["rmse"] == pytest.approx(forecast.rmse().evaluate(model.transform(held)), rel=1e-6)


def test_staged_search_by_blocks_and_cuts(spark, rows, monkeypatch):
    """The same errors from other blocks, tasks and cuts of the lineage, and again in a second run."""
    fit, held = F.when(F.col("seller_id") % 3 == 0, 0).otherwise(1), F.when(F.col("seller_id") % 3 == 0, 1).otherwise(0)
    run = lambda: boosting.staged_search(rows, ["a", "b", "c"], "label", fit, held, 1, [3], [0.1], [2, 5])
    whole = run()
    assert run() == whole and [(r["maxIter"], r["fold"]) for r in whole] == [(2, 0), (5, 0)] and whole[1]["rmse"] < whole[0]["rmse"]
    for name, value in (("SHARED_ROWS", 0), ("BLOCK", 64), ("LEAST", 100), ("MEET", 2), ("CUT_EVERY", 2)):
        monkeypatch.setattr(boosting, name, value)
    assert [r["rmse"] for r in run()] == pytest.approx([r["rmse"] for r in whole], rel=1e-9)


def test_a_search_over_many_rows_has_few_jobs(spark):
    """600,000 rows meet their models once, read in parts; by blocks each level of 8 trees has jobs of its own, and the errors are the same."""
    df = spark.range(600_000).select((F.col("id") % 97).alias("a"), (F.col("id") * 31 % 1009).alias("b"), (F.col("id") % 5).alias("k")).withColumn("label", F.sin("a") + F.col("b") / 500.0)
    fit, held = F.when(F.col("k") == 0, 0).otherwise(3), F.when(F.col("k") == 0, 3).otherwise(0)
    sc, found = spark.sparkContext, {}
    for shared in (boosting.SHARED_ROWS, 0):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(boosting, "SHARED_ROWS", shared)
            sc.setJobGroup(f"search{shared}", "")
            found[shared] = boosting.staged_search(df, ["a", "b"], "label", fit, held, 2, [2], [0.1], [4, 8])
    sc.setJobGroup("", "")
    assert [r["rmse"] for r in found[0]] == pytest.approx([r["rmse"] for r in found[boosting.SHARED_ROWS]], rel=1e-9)
    jobs = {shared: len(sc.statusTracker().getJobIdsForGroup(f"search{shared}")) for shared in found}
    assert jobs[boosting.SHARED_ROWS] <= 10 < jobs[0]


def test_staged_search_of_little(spark, rows):
    one, none = F.lit(1), F.lit(0)
    assert boosting.staged_search(rows.limit(0), ["a"], "label", one, one, 1, [2], [0.1], [2]) == []
    assert boosting.staged_search(rows, ["a"], "label", one, none, 1, [2], [0.1], [2]) == []
    flat = rows.withColumn("label", F.lit(2.0)).withColumn("a", F.lit(1.0))
    assert boosting.staged_search(flat, ["a"], "label", one, one, 1, [2], [0.1], [2])[0]["rmse"] == pytest.approx(0, abs=1e-9)


def test_search_chooses_over_origins_and_folds(spark, rows):
    found = forecast.search(rows, ["a", "b", "c"], ["seller_id", "year_week"], light=True, n_splits=2)
    assert set(found) == {"gbt", "rf"}
    for name, (one, cv_rmse, by_cv) in found.items():
        assert one in forecast.settings(forecast.LIGHT_GRIDS[name]) and by_cv in forecast.settings(forecast.LIGHT_GRIDS[name]) and 0 < cv_rmse < 3
    assert len(forecast.settings(forecast.GRIDS["gbt"])) == 12 and len(forecast.settings(forecast.GRIDS["rf"])) == 8


def test_forests_in_part_are_forests(spark, rows):
    """All trees at full depth are the library's forest; the first trees and cut-off ones err much like fits of their own."""
    folds, grid = forecast.folds_of(rows, ["seller_id", "year_week"], 2, 0), {"maxDepth": [2, 6], "numTrees": [8, 16], "subsamplingRate": [1.0]}
    got = {(r["fold"], r["maxDepth"], r["numTrees"]): r["rmse"] for r in forecast.forest_errors(rows, folds, grid)}
    assert len(got) == 8
    fit, held = (rows.filter(side.bitwiseAND(F.lit(1)) != 0) for side in (folds.fit, folds.held))
    for depth, trees in ((6, 16), (2, 8)):
        estimator = forecast.estimators()["rf"]
        model = estimator.copy({estimator.maxDepth: depth, estimator.numTrees: trees, estimator.subsamplingRate: 1.0}).fit(fit)
        assert got[0, depth, trees] == pytest.approx(forecast.rmse().evaluate(model.transform(held)), rel=1e-9 if depth == 6 else 0.15)


def test_folds_are_apart(spark, rows):
    folds = forecast.folds_of(rows, ["seller_id", "year_week"], 3, 3)
    masks = rows.select("global_week_idx", folds.fit.alias("fit"), folds.held.alias("held")).collect()
    assert folds.n == 6 and all(r.fit & r.held == 0 for r in masks)
    assert all(bin(r.held & 7).count("1") == 1 and bin(r.fit & 7).count("1") == 2 for r in masks)
    for i in range(3, 6):
        fit, held = ([r.global_week_idx for r in masks if getattr(r, side) >> i & 1] for side in ("fit", "held"))
        assert max(fit) < min(held)


# --- the recurrent network ------------------------------------------------------------


def some_sequences(rng, n, vocabulary, width):
    seq = np.zeros((n, width), np.int32)
    for row in seq:
        row[: rng.integers(0, width + 1)] = 1
    return np.where(seq > 0, rng.integers(1, vocabulary, seq.shape), 0).astype(np.int32)


def test_gradient_against_finite_differences():
    rng = np.random.default_rng(2)
    w = recurrent.initial(9, 4, 3, dtype=np.float64)
    seq, label = some_sequences(rng, 7, 9, 6), rng.integers(0, 2, 7).astype(float)
    seq[0], seq[1, -1] = 0, 5  # a text without words, and one without a gap
    _, gradient = recurrent.loss_and_gradient(w, seq, label)
    whole = {k: gradient[k] for k in recurrent.DENSE} | {"embedding": np.zeros_like(w["embedding"])}
    whole["embedding"][gradient["words"]] = gradient["rows"]
    for name, value in w.items():
        for at in np.ndindex(value.shape):
            if name == "embedding" and at[0] == recurrent.PAD:
                continue
            kept, sides = value[at], []
            for step in (1e-5, -1e-5):
                value[at] = kept + step
                z = recurrent.logits(w, seq)
                sides.append((np.logaddexp(0, z) - label * z).sum())
            value[at] = kept
            assert whole[name][at] == pytest.approx((sides[0] - sides[1]) / 2e-5, abs=1e-6)


def test_messages_add_up():
    rng = np.random.default_rng(3)
    w = recurrent.initial(30, 4, 3)
    seq, label = some_sequences(rng, 12, 30, 5), rng.integers(0, 2, 12).astype(np.float32)
    parts = [recurrent.packed(4, *recurrent.loss_and_gradient(w, seq[i : i + 4], label[i : i + 4])) for i in range(0, 12, 4)]
    n, loss, total = recurrent.summed(parts, w)
    one_loss, one = recurrent.loss_and_gradient(w, seq, label)
    assert n == 12 and loss == pytest.approx(one_loss, rel=1e-5)
    assert np.allclose(total["state"], one["state"], atol=1e-5) and np.allclose(total["embedding"][one["words"]], one["rows"], atol=1e-5)


def test_workers_learn_together(spark):
    """Losses fall from epoch to epoch, the classes are told apart, and reruns agree."""
    rng = random.Random(4)
    made = []
    for i in range(400):
        words = [rng.choice(["red", "blue"]) for _ in range(6)]
        made.append((i, " ".join(words), float(words.count("red") > 3)))
    df = spark.createDataFrame([*made, (400, None, 1.0), (401, "", 0.0), (402, "unseen", None)], "id long, t string, label double")
    coded = text.encode_sequences(df, "t", [], 20, 8).cache()
    seqs = {r.id: r.seq for r in coded.collect()}
    assert seqs[400] == seqs[401] == [0] * 8 and len(seqs[0]) == 8 and set(seqs[0][:6]) <= {2, 3} and seqs[0][6:] == [0, 0]
    fit = lambda workers: recurrent.fit_recurrent(coded, 20, 16, 16, epochs=6, batch=140, rate=0.1, workers=workers)  # a gathering takes up to a second
    weights, losses = fit(3)
    assert losses[-1] < 0.4 < losses[0] and sum(b < a for a, b in zip(losses, losses[1:], strict=False)) >= 4
    again, same = fit(3)
    assert same == losses and all(np.array_equal(weights[k], again[k]) for k in weights)
    scored = text.batch_predict(coded, "seq", "score", recurrent.scorer(weights), 8)
    area = text.area_under_curve(scored.filter("label IS NOT NULL"), "label", "score").first()
    assert area.auc_roc > 0.9 and area.n == 402
    few, _ = recurrent.fit_recurrent(coded, 20, 16, 16, epochs=1, workers=2, most_rows=50)
    assert not np.array_equal(few["out"], weights["out"])


def test_steps_do_not_wait_for_the_barrier(spark):
    """60 steps of 4 workers: a gathering of the barrier would take a second each."""
    df = spark.createDataFrame([([2 + i % 7, 3, 0, 0], float(i % 2)) for i in range(400)], "seq array<int>, label double").cache()
    df.count()
    began = time.time()
    _, losses = recurrent.fit_recurrent(df, 20, 4, 4, epochs=3, batch=20, workers=4)
    assert len(losses) == 3 and time.time() - began < 30


def test_fit_without_rows(spark):
    none = spark.createDataFrame([], "seq array<int>, label double")
    weights, losses = recurrent.fit_recurrent(none, 10, 4, 3, workers=2)
    assert losses == [0.0] * recurrent.EPOCHS and np.array_equal(weights["out"], recurrent.initial(10, 4, 3)["out"])


def test_a_fit_takes_all_rows(spark):
    """Of 520,000 rows none is left out: at a rate of 0 the loss is the mean over all of them.  One worker needs no connection."""
    n, word = 520_000, lambda i: 2 + i % 17
    df = spark.range(n).select(F.array((F.lit(2) + F.col("id") % 17).cast("int"), (F.lit(2) + F.col("id") % 13).cast("int")).alias("seq"), ((F.col("id") % 11) < 3).cast("double").alias("label"))
    w, (loss,) = recurrent.fit_recurrent(df, 20, 2, 2, epochs=1, batch=50_000, rate=0.0, workers=1)
    i = np.arange(n)
    z = recurrent.logits(recurrent.initial(20, 2, 2), np.stack([word(i), 2 + i % 13], axis=1)).astype(float)
    assert loss == pytest.approx(float((np.logaddexp(0, z) - (i % 11 < 3) * z).mean()), rel=1e-6)
    assert np.array_equal(w["out"], recurrent.initial(20, 2, 2)["out"])


def test_rows_lie_in_a_file():
    rows = [{"seq": [i, i + 1, 0], "label": float(i % 2)} for i in range(10_000)]
    seq, label = recurrent._laid(iter(rows))
    assert isinstance(seq, np.memmap) and seq[9_999].tolist() == [9_999, 10_000, 0] and label.sum() == 5_000 and seq.shape == (10_000, 3)
    assert [x.shape for x in recurrent._laid(iter([]))] == [(0, 0), (0,)]


def test_area_counts_ties_half(spark):
    pairs = [(1.0, 0.9), (0.0, 0.9), (1.0, 0.4), (0.0, 0.1), (0.0, 0.4)]
    wins = sum((p > q) + 0.5 * (p == q) for y, p in pairs if y for z, q in pairs if not z)
    df = spark.createDataFrame(pairs, "label double, score double")
    assert text.area_under_curve(df, "label", "score").first() == (wins / 6, 5)
    assert text.area_under_curve(df.filter("label = 1"), "label", "score").first() == (None, 2)
    assert text.area_under_curve(df.limit(0), "label", "score").first() == (None, 0)


def test_exact_quantiles_by_ranges(spark):
    rng = random.Random(5)
    values = [rng.randint(-50, 50) for _ in range(997)]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v int")
    at = [0.0, 0.01, 0.25, 0.5, 0.95, 1.0]
    assert profile.quantiles(df, "v", at, 0.0) == [sorted(values)[max(0, math.ceil(p * len(values)) - 1)] for p in at]
    assert profile.quantiles(df.limit(0), "v", [0.5], 0.0) == [None]


def test_histograms_meet_once_and_leaves_are_those_of_a_walk():
    """However many rows there are below MOST a task, each model's histograms meet in one round; rows stop at leaves, also those of the last bin."""
    assert boosting.TASKS <= boosting.MEET
    rng = np.random.default_rng(3)
    x = rng.integers(0, 256, (300, 4)).astype(np.uint8)
    x[:20] = 255
    tree = boosting.Tree.empty(4)
    for node in (0, 1, 2, 4, 5, 9, 11):
        tree.feature[node], tree.bin[node] = rng.integers(0, 4), rng.integers(0, 255)

    def walk(row, levels):
        node = 0
        for _ in range(levels):
            if tree.feature[node] >= 0:
                node = 2 * node + 1 + int(row[tree.feature[node]] > tree.bin[node])
        return node

    for levels in range(5):
        assert tree.leaves(x, levels).tolist() == [walk(row, levels) for row in x]
