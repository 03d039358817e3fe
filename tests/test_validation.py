"""Cross-validated models against separate fits, semantic options against loops."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from clipsift.operators import models, semantic, validation


@pytest.fixture(scope="module")
def rated(spark):
    r = random.Random(3)
    rows = []
    for i in range(260):
        x = [r.gauss(0, 1), r.gauss(2, 3), r.choice([0.0, 1.0])]
        rows.append((f"g{i % 13}", i, x, [r.gauss(0, 1), 5.0], float(min(5, max(1, round(3 + x[0] - 0.3 * x[1] + r.gauss(0, 1))))), float(r.random() < 1 / (1 + math.exp(-x[0])))))
    return spark.createDataFrame(rows, "grp string, id long, x array<double>, other array<double>, y double, label double").repartition(5).cache()


def folds_of(df):
    return {r.id: r.fold for r in validation.dealt_folds(df, "grp", 4, 42).select("id", "fold").collect()}


def test_folds_keep_groups_and_are_even(spark, rated):
    dealt = validation.dealt_folds(rated, "grp", 4, 42).select("grp", "fold").distinct().collect()
    sizes = [sum(r.fold == k for r in dealt) for k in range(4)]
    assert len(dealt) == 13 and sorted(sizes) == [3, 3, 3, 4]
    assert folds_of(rated) == folds_of(rated.repartition(3)) != {r.id: r.fold for r in validation.dealt_folds(rated, "grp", 4, 7).select("id", "fold").collect()}


def test_gate_folds_equal_separate_fits(rated):
    fold = folds_of(rated)
    got = {r.id: r for r in validation.gate_folds(rated, "grp", "id", "x", "label", 4, 0.1, 42).collect()}
    assert len(got) == 260 and {i: r.fold for i, r in got.items()} == fold
    rows = rated.collect()
    for k in range(4):
        train = validation.dealt_folds(rated, "grp", 4, 42).where(F.col("fold") != k)
        w = [r.coefficient for r in sorted(models.logistic_gate(train, "x", "label", 0.1).collect(), key=lambda r: r.feature)]
        for r in rows:
            if fold[r.id] == k:
                assert abs(got[r.id].predicted - 1 / (1 + math.exp(-(w[0] + np.dot(w[1:], r.x))))) < 1e-5 and got[r.id].actual == r.label


def _standardised(train):
    x = np.stack(train)
    s = x.std(axis=0)
    return x.mean(axis=0), np.where(s < 1e-12, 1.0, s)


def test_preference_folds_equal_separate_fits(rated):
    fold, rows = folds_of(rated), rated.collect()
    got = {r.id: r.predicted for r in validation.preference_folds(rated, "grp", "id", "x", "y", 4, 0.1, 42).collect()}
    for k in range(4):
        train = validation.dealt_folds(rated, "grp", 4, 42).where(F.col("fold") != k)
        w = np.array([r.coefficient for r in sorted(models.pairwise_logistic(train, "grp", "x", "y", 0.1).collect(), key=lambda r: r.feature)])
        mean, scale = _standardised([r.x for r in rows if fold[r.id] != k])
        for r in rows:
            if fold[r.id] == k:
                assert abs(got[r.id] - w @ ((np.array(r.x) - mean) / scale)) < 1e-4


def test_choice_folds_equal_separate_fits(spark, rated):
    o = rated.select("grp", F.concat("grp", F.lit("-"), (F.col("id") % 3).cast("string")).alias("query"), F.col("id").alias("option"), "x", F.abs(F.col("y") - 3.5 + F.get("x", F.lit(0))).alias("distance"))
    got = {r.option: r for r in validation.choice_folds(o, "grp", "query", "option", "x", "distance", 4, 0.1, 42).collect()}
    rows, dealt = o.collect(), validation.dealt_folds(o, "grp", 4, 42)
    assert len(got) == 260
    for k in range(4):
        w = np.array([r.coefficient for r in sorted(models.choice_ranker(dealt.where(F.col("fold") != k), "query", "option", "x", "distance", 0.1).collect(), key=lambda r: r.feature)])
        mean, scale = _standardised([r.x for r in rows if got[r.option].fold != k])
        for r in rows:
            if got[r.option].fold == k:
                assert abs(got[r.option].predicted - w @ ((np.array(r.x) - mean) / scale)) < 1e-4


def test_steps_are_halved_for_each_model_alone():
    """Losses of which one needs halved steps: each model ends where a lone one does."""

    def loss(a):
        return lambda w: (np.logaddexp(a * (w[0] - 2), -a * (w[0] - 2)), np.array([a * np.tanh(a * (w[0] - 2))]), np.array([[a * a * (1 - np.tanh(a * (w[0] - 2)) ** 2) + 1e-9]]))

    each = [loss(0.1), loss(1.0), loss(3.0)]
    together = validation.newton_folds(lambda w: [f(v) for f, v in zip(each, w)], 3, 1, np.array([0.01]))
    alone = [models._newton(f, 1, 0.01)[0] for f in each]
    assert np.allclose(together[:, 0], alone, atol=1e-6) and max(alone) > 1


def test_ablation_equals_separate_fits(rated):
    variants = {"one": ("x",), "two": ("other",), "both": ("x", "other")}
    df = rated.withColumn("second", F.col("y") * 2 - F.col("label"))
    got = {(r.variant, r.id): r for r in validation.ablation(df, "grp", "id", ["x", "other"], variants, ["y", "second"], 4, 10.0, 42).collect()}
    rows, fold = df.collect(), folds_of(rated)
    assert len(got) == 4 * 260
    for k in range(4):
        train, test = [r for r in rows if fold[r.id] != k], [r for r in rows if fold[r.id] == k]
        y = np.array([[r.y, r.second] for r in train])
        for name, used in variants.items():
            x = np.array([sum((list(r[c]) for c in used), []) for r in train])
            mean, scale = _standardised(x)
            z = (x - mean) / scale
            w = np.linalg.solve(z.T @ z + 10.0 * np.eye(z.shape[1]), z.T @ (y - y.mean(axis=0)))
            for r in test:
                expected = (y.mean(axis=0) + ((np.array(sum((list(r[c]) for c in used), [])) - mean) / scale) @ w).mean()
                assert abs(got[name, r.id].predicted - expected) < 1e-8
        assert {round(got["fold_train_mean", r.id].predicted, 8) for r in test} == {round(float(y.mean()), 8)}


def test_selection_rule(spark):
    """Hits first, then regret, then pairs."""

    def report(rows):
        df = spark.createDataFrame(rows, "variant string, grp string, id long, actual double, predicted double")
        return {r.variant: r for r in validation.ablation_report(df, "grp", "id", ["a", "b"]).collect()}

    truth = [("g", 1, 5.0), ("g", 2, 3.0), ("g", 3, 1.0), ("h", 1, 4.0), ("h", 2, 2.0)]
    score = lambda name, by: [(name, g, i, y, by[g, i]) for g, i, y in truth]
    good = {("g", 1): 3.0, ("g", 2): 2.0, ("g", 3): 1.0, ("h", 1): 1.0, ("h", 2): 2.0}
    swapped = good | {("g", 2): 1.0, ("g", 3): 2.0}
    found = report(score("a", swapped) + score("b", good) + score("c", {k: -v for k, v in good.items()}))
    assert found["b"].selected and not found["a"].selected and not found["c"].selected
    assert (found["a"].hit_rate, found["b"].hit_rate, found["a"].regret, found["b"].regret) == (0.5, 0.5, 1.0, 1.0)
    assert (found["a"].pairwise, found["b"].pairwise, found["b"].n, found["b"].mae) == (0.5, 0.75, 5, 1.2)
    assert report(score("a", good) + score("b", good))["a"].selected


def test_window_sums_against_a_loop(spark):
    """Touching, empty and reversed intervals, equal times, a video over many blocks, one without parts."""
    r = random.Random(5)
    parts = [(v, s, s + r.choice([0.0, 1.0, 2.5, 40.0]), [1.0, float(r.randrange(9))]) for v in (1, 2) for s in (float(r.randrange(120)) for _ in range(80))]
    asks = sorted({(v, float(r.randrange(-5, 130)), float(r.randrange(-5, 170))) for v in (1, 2, 3) for _ in range(60)})
    asks = [a for a in asks if a[2] > a[1]]
    got = semantic.window_sums(spark.createDataFrame(parts, "video long, start double, end double, v array<double>").repartition(3), spark.createDataFrame(asks, "video long, s double, e double"), "video", "v", 2, block=10.0)
    expected = {(v, s, e): [sum(x[k] for w, a, b, x in parts if w == v and b > s and a < e) for k in (0, 1)] for v, s, e in asks}
    assert {(r.video, r.s, r.e): list(r.sums) for r in got.collect()} == expected


def test_options_against_the_original(spark):
    parts = [(1, 0.0, 5.0, 3, [1.0, 0.0]), (1, 5.0, 9.0, 4, [0.0, 2.0]), (1, 20.0, 25.0, 2, [1.0, 1.0])]
    options = [(1, "start", k, s, 10.0, abs(s - 4.0)) for k, s in enumerate([0.0, 4.0, 4.0, 9.5, 12.0])] + [(2, "start", 0, 0.0, 9.0, 0.0)]
    found = semantic.semantic_options(
        spark.createDataFrame(options, "video long, kind string, option int, s double, e double, away double"),
        spark.createDataFrame(parts, "video long, start double, end double, words int, v array<double>"),
        "video", ["kind"], "option", "v", 2, [0.0, 0.0, 0.0, 0.0], [1.0, 1.0, 1.0, 1.0], {"hook": (1.0, [0.0, 1.0, 0.0, 0.0]), "payoff": (0.0, [0.0, 0.0, 10.0, 0.0])},
    )
    got = {(r.video, r.option): r for r in found.collect()}
    unit = np.array([1.0, 2.0]) / math.sqrt(5)
    assert [got[1, k].valid for k in range(5)] == [True, True, True, False, False] and not got[2, 0].valid
    assert [got[1, k].words for k in range(5)] == [7, 7, 7, 0, 0]
    assert got[1, 0].hook_score == 8.0 and abs(got[1, 0].payoff_score - 10 * unit[0]) < 1e-9 and abs(got[1, 0].similarity - 1) < 1e-9
    assert got[1, 3].quality_score == 1.0 and abs(got[1, 3].quality_delta - (1.0 - (8 + 10 * unit[0]) / 2)) < 1e-9 and got[1, 1].hook_delta == 0
    assert got[2, 0].hook_score == 1.0 and got[2, 0].hook_delta is None
