"""Learned rankers, posts and calibrations against plain loops."""

import random
import re

import numpy as np
from pyspark.sql import functions as F

from clipsift.operators import learning, models, publishing, sampling


def _minimum(d, l2):
    w = np.zeros(d.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(d @ w))
        w -= np.linalg.solve((d.T * (p * (1 - p))) @ d / len(d) + l2 * np.eye(len(w)), -(d.T @ p) / len(d) + l2 * w)
    return w


def test_pairs_of_blocks_give_the_weights_of_all_pairs(spark, monkeypatch):
    r = np.random.default_rng(3)
    rows = [("ab"[k % 2], [float(v) for v in r.normal(size=2)], float(r.integers(1, 4))) for k in range(90)]
    rows += rows[:20]
    x = np.array([v for _, v, _ in rows])
    z = (x - x.mean(0)) / x.std(0)
    d = np.array([z[i] - z[j] for i in range(len(rows)) for j in range(len(rows)) if rows[i][0] == rows[j][0] and rows[i][2] > rows[j][2]])
    df = spark.createDataFrame(rows, "g string, x array<double>, t double")
    monkeypatch.setattr(models, "block_products", lambda *a, f=models.block_products: f(*a, block=16))
    got = {q.feature: q.coefficient for q in models.pairwise_logistic(df, "g", "x", "t", 0.1).collect()}
    assert np.allclose([got[0], got[1]], _minimum(d, 0.1), atol=2e-6)


def test_choices(spark):
    r = np.random.default_rng(4)
    rows = [(q, o, [float(v) for v in r.normal(size=2)], float(abs(r.normal()))) for q in range(12) for o in range(7)]
    x = np.array([v for *_, v, _ in rows])
    z = (x - x.mean(0)) / x.std(0)
    d = []
    for q in range(12):
        own = [k for k, row in enumerate(rows) if row[0] == q]
        best = min(own, key=lambda k: (rows[k][3], rows[k][1]))
        d += [z[best] - z[k] for k in own if rows[k][3] > rows[best][3] + 0.1]
    df = spark.createDataFrame(rows, "q int, o int, x array<double>, d double")
    got = {f.feature: f.coefficient for f in models.choice_ranker(df, "q", "o", "x", "d", 0.1).collect()}
    assert np.allclose([got[0], got[1]], _minimum(np.array(d), 0.1), atol=2e-6)
    few = models.choice_ranker(df, "q", "o", "x", "d", 0.1, most=2)
    assert few.collect() == models.choice_ranker(df.repartition(5), "q", "o", "x", "d", 0.1, most=2).collect()


def test_posts(spark):
    text = "Kernel panics are rare. We fixed the boot loader of every machine in the lab before lunch, and  nobody noticed it at all!  So it goes"
    clips = spark.createDataFrame([(1, text), (2, " \n "), (3, "word " * 200)], "k int, t string")
    topics = spark.createDataFrame([(1, "boot loader", 1), (1, "2024", 2), (1, "Boot Loader", 3), (1, "lab", 4)], "k int, term string, rank int")
    got = {(r.k, r.platform): r for r in publishing.platform_packs(clips, topics, "k", "t").collect()}
    assert {k for k, _ in got} == {1, 3} and len(got) == 8
    said = "We fixed the boot loader of every machine in the lab before lunch, and nobody noticed it at all!"
    assert got[1, "tiktok"].post == f"{said}\n\n#BootLoader #Lab"
    assert got[1, "youtube"].title == said[:69].rsplit(" ", 1)[0].rstrip(" ,;:-") + "…"
    assert got[1, "youtube"].post.startswith(got[1, "youtube"].title + "\n\nKernel panics") and got[1, "linkedin"].title is None
    long = got[3, "instagram"].post
    assert long.endswith("word…\n\n#CreatorClip") and len(long.split("\n\n")[0]) <= 520
    cut = spark.createDataFrame([("abcdefghij",), ("abc, defghij",), ("short",)], "t string").select(publishing.shortened(F.col("t"), 8).alias("s")).collect()
    assert [r.s for r in cut] == ["abcdefg…", "abc…", "short"]


def test_calibration_needs_examples(spark):
    rows = [(1, 4, 3, True, 1.0, 0.1), (2, 8, 1, True, 1.0, 0.1), (3, 8, 2, False, 1.0, 0.1), (4, 8, 2, True, 1.0, 0.1), (5, 8, 2, True, -9.0, None)]
    df = spark.createDataFrame(rows, "k int, examples int, sources int, varied boolean, o double, s double")
    got = {r.k: (r.adjustment, r.estimate) for r in learning.calibrated(df, "o", "s").collect()}
    assert got[1] == got[2] == got[3] == (0.0, None)
    assert abs(got[4][0] - 0.175) < 1e-12 and got[4][1] == 100.0 and got[5] == (-0.15, 0.0)


def test_queue_leaves_done_videos_out(spark):
    r = random.Random(5)
    rows = [(v, f"{v}-{k}", 30.0 * k, 30.0 * k + 25, r.random()) for v in range(4) for k in range(9)]
    df = spark.createDataFrame(rows, "video int, clip string, start double, end double, score double")
    queue = sampling.annotation_queue(df, spark.createDataFrame([(2,), (2,)], "video int"), "video", "clip", slots=3).collect()
    assert {q.video for q in queue} == {0, 1, 3} and len(queue) == 9
    for v in (0, 1, 3):
        own = sorted((q for q in queue if q.video == v), key=lambda q: q.round)
        assert [q.annotation_id for q in own] == [f"{v}_sample_{k:02d}" for k in (1, 2, 3)]
        starts = [int(re.sub(".*-", "", q.clip)) for q in own]
        assert starts == sorted(starts)
