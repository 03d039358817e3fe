"""Costs of single queries: what a plan holds, and that cheaper forms give the same rows."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from clipsift.functions.scalars import iou, six, six_plain
from clipsift.operators import boundaries, joins, reveal, sequence
from clipsift.plans import bridges
from clipsift.plans.registry import QUERIES


def _line(plan: str, *parts: str) -> str:
    """The nodes of a plan that name all parts."""
    return "\n".join(x for x in plan.split("\n") if all(p in x for p in parts))


def test_features_of_words_are_plain_columns(spark, sf):
    """They were found by one interpreted expression over arrays, which copied each text's words several times."""
    plan = QUERIES["mth15_boundary_features"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert not _line(plan, "Generate", "regexp_extract") and _line(plan, "Project", "regexp_extract")


def test_features_of_odd_texts_are_those_of_rows(spark):
    said = ["", "Sponsor", "So,", "don't", "forget", "to", "subscribe.", None, "PROMO", "code!\"", "été", "if", "42"]
    draw = random.Random(5)
    texts = [(k // 2, [(i, i * 0.4, i * 0.4 + draw.choice([0.1, 0.35, 2.0]), draw.choice(said if k % 3 else said[9:])) for i in range(n)]) for k, n in enumerate([0, 1, 2, 5, 40, 60, 7, 3])]
    texts += [(8, None), (None, [(0, 0.0, 0.3, "so"), (1, None, None, "if.")])]
    df = spark.createDataFrame([(k, v, 0.5 * k) for k, (v, _) in enumerate(texts)], "text int, video int, t double").join(
        spark.createDataFrame([(k, w) for k, (_, w) in enumerate(texts)], "text int, w array<struct<pos:int,start:double,end:double,word:string>>"), "text")
    own = ["pos", "start", "end", "word", "gap_before", "gap_after", "previous_ends", "ends", "opener", "dangling", "intro_or_ad"]
    rows = lambda d: sorted(map(str, d.collect()))
    # rows of a text are told apart by its place in the list, as ids come twice
    wanted = boundaries.word_features(df.select(F.col("text").alias("video"), F.inline("w"))).select(F.col("video").alias("text"), *own)
    got = boundaries.featured_words(df)
    assert got.columns == ["text", "video", "t", *own] and got.count() == sum(len(w or []) for _, w in texts)
    assert rows(got.select("text", *own)) == rows(wanted) and got.where("intro_or_ad = 1").count() > 10
    near = lambda x: (x["start"] - F.col("t")).between(-3.5, 3.5)
    assert rows(boundaries.featured_words(df, near)) == rows(got.where(F.abs(F.col("start") - F.col("t")) <= 3.5))


def test_plain_rounding_is_rounding(spark):
    draw = random.Random(7)
    x = [None, 0.0, -0.0, math.nan, math.inf, -math.inf, 0.0000005, 2.5e-6, 1.0000015, -1.0000005, 999999.9999995, 1e6, 123456789.1234565, 1e300, 5e-324]
    x += [draw.uniform(-5, 5) for _ in range(3000)] + [draw.randrange(-(10**9), 10**9) / 2e6 + d for d in (0.0, 1e-12, -1e-12, 5e-10) for _ in range(1500)]
    df = spark.createDataFrame([(v,) for v in x], "x double").select(six(F.col("x")).alias("a"), six_plain(F.col("x")).alias("b"))
    assert [r for r in df.collect() if repr(r.a) != repr(r.b)] == []


def test_nearest_ends_of_many_texts_are_those_of_each():
    """The helper took a text at a time, with some sixty calls for each, however short it was."""
    draw = random.Random(11)
    for _ in range(60):
        rows, expected = [], []
        for k in range(draw.randrange(5)):
            at, units = 0.0, []
            for _ in range(draw.choice([0, 1, 2, 9, 40])):
                at += draw.choice([0.0, 0.0, 0.1, 2.5, 5.0, 20.0])
                units.append((at - draw.choice([0.0, 1.0, 10.0, 30.0]), at))
            first = len(rows)
            rows += [(s, e, k) for s, e in units]
            found = {}
            for i, (s, _) in enumerate(units):
                fits = [(e - s, j) for j, (_, e) in enumerate(units) if j >= i and 20.0 <= e - s <= 60.0]
                for t in (20.0, 30.0, 60.0):
                    if fits:
                        j = min(fits, key=lambda f: (abs(f[0] - t), f[1]))[1]  # noqa: B023
                        found[s, units[j][1]] = min(found.get((s, units[j][1]), (i, j)), (i, j))
            expected += [(first + i, first + j) for _, (i, j) in sorted(found.items())]
        columns = [np.array([r[c] for r in rows], dtype=t) for c, t in enumerate((float, float, int))]
        assert [*zip(*(x.tolist() for x in sequence.nearest_ends(*columns, (20.0, 30.0, 60.0), 20.0, 60.0)))] == expected
    with pytest.raises(ValueError):
        sequence.nearest_ends(np.zeros(2), np.array([2.0, 1.0]), np.zeros(2, dtype=int), (20.0,), 20.0, 60.0)


def test_candidates_are_the_same_however_many_units_are_taken_at_once(spark, monkeypatch):
    word = lambda i, gap: (i, i * gap, i * gap + 0.35, f"w{i}." if i % 3 == 2 else f"w{i}")
    texts = [(1, [word(i, 0.4) for i in range(400)]), (1, [word(i, 5.0) for i in range(7)]), (2, []), (3, None), (None, [word(i, 2.5) for i in range(90)])]
    df = spark.createDataFrame(texts, "video int, w array<struct<pos:int,start:double,end:double,word:string>>").coalesce(1)
    rows = lambda: sorted(map(str, sequence.with_candidates(sequence.with_units(df)).select("video", "units", "candidates").collect()))
    whole = rows()
    monkeypatch.setattr(sequence, "UNITS_AT_ONCE", 3)
    assert rows() == whole and len(whole) == 5 and sum("text_md5" in r for r in whole) == 3


def test_candidates_are_numbered_as_before(spark, sf, monkeypatch):
    """A formatter and three decimal numbers were made for each row."""
    plan = QUERIES["seq02_candidates"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "format_string" not in plan
    texts = [(k, [(i, i * 7.0, i * 7.0 + 0.35, "so.") for i in range(n)]) for k, n in ((-7, 3400), (None, 9), (12, 0))]
    df = spark.createDataFrame(texts, "video long, w array<struct<pos:int,start:double,end:double,word:string>>")
    monkeypatch.setattr(bridges, "timed_texts", lambda *_: df)
    got = QUERIES["seq02_candidates"](spark, sf).select("candidate_id").collect()
    numbers = {v: [int(r[0].rpartition("_")[2]) for r in got if r[0].startswith(f"{v}_")] for v in ("-7", "null")}
    assert len(numbers["-7"]) > 10000 and numbers["null"] and sum(map(len, numbers.values())) == len(got)
    assert {r[0] for r in got} == {f"{v}_candidate_{k:04d}" for v, n in numbers.items() for k in range(1, len(n) + 1)}


def test_units_copy_no_words(spark, sf):
    """A fold held its sentence's words and pieces in arrays that were copied at each word."""
    plan = QUERIES["seq01_sentence_units"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    fold = _line(plan, "Project", "aggregate(")
    assert fold and "slice(" not in fold and "array(lambda" not in fold


P = "experiment long, rank int, clip string, start double, end double, estimate double"
A = "experiment long, actual int, segments array<struct<start:double,end:double>>, performance long"


def _experiments(spark):
    """Predictions and clips with null and repeated ids, and clips without places."""
    draw = random.Random(3)
    p = [(v, r, f"c{v}-{r}", s := draw.uniform(0, 60), s + draw.choice([0.0, 20.0, 30.0]), draw.random()) for v in [*range(30), None] for r in (1, 2, 3)]
    p += p[10:30] + [(4, None, "none", 0.0, 30.0, 0.5), (99, 1, "alone", 0.0, 30.0, None), (5, 7, None, None, None, 0.1)]
    place = lambda: [(s := draw.uniform(0, 60), s + 30.0) for _ in range(draw.choice([1, 1, 2]))]
    a = [(v, k, draw.choice([place(), place(), place(), [], None]), draw.choice([1, 2, None])) for v in [*range(28), None, 77] for k in (0, 1)]
    a += a[5:25] + [(v, k, [], 9) for v, k, *_ in a[8:14]] + [(6, None, place(), 3)]
    return spark.createDataFrame(p, P), spark.createDataFrame(a, A)


def test_evaluation_is_that_of_joins(spark):
    p, a = _experiments(spark)
    places = a.select("experiment", "actual", F.explode("segments").alias("g"))
    met = p.join(places, "experiment").withColumn("iou", iou(F.col("start"), F.col("end"), F.col("g.start"), F.col("g.end")))
    taken = joins.greedy_matches(met.groupBy("experiment", "rank", "actual").agg(F.max("iou").alias("iou")).where("iou >= 0.1"), "experiment", "rank", "actual", "iou")
    known = a.select("experiment", "actual", F.array_min("segments.start").alias("s"), F.array_max("segments.end").alias("e"), "performance")
    found = p.join(taken, ["experiment", "rank"], "left").join(known, ["experiment", "actual"], "left")
    error = lambda x, y: F.round(F.col(x) - F.col(y), 3)
    wanted = found.select("experiment", "rank", "clip", "estimate", "actual", F.round(F.coalesce("iou", F.lit(0.0)), 4), F.coalesce(F.col("iou") >= 0.5, F.lit(False)), error("start", "s"), error("end", "e"), "performance")
    rows = lambda d: sorted(str(tuple(r)) for r in d.collect())
    got = reveal.evaluate(p, a)
    assert rows(got) == rows(wanted) and got.count() > p.count() and got.where("actual is not null").count() > 40


def test_evaluated_predictions_are_dealt_by_their_experiment(spark):
    """All predictions were dealt by their rank, by the clip they met and again by their experiment."""
    held = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        p, a = _experiments(spark)
        first = reveal.evaluate(p, a)
        left = first.join(a.select("experiment").distinct(), "experiment", "left_anti")
        dealt = [d._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") for d in (first, left)]
        assert dealt[1] == dealt[0] + 1  # those of the other side alone
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)


def test_corrections_that_name_no_clip_change_nothing(spark):
    _, a = _experiments(spark)
    fixes = [(5, 0, 1, 1.0, 31.0, 60.0), (5, 0, 2, 2.0, 32.0, 60.0), (5, 9, 1, 1.0, 31.0, 60.0), (None, 0, 1, 1.0, 31.0, 60.0), (7, 1, 1, 1.0, 99.0, 60.0), (500, 0, 1, 1.0, 31.0, 60.0)]
    after, changed, refused = reveal.corrected(a, spark.createDataFrame(fixes, "experiment long, actual int, seq int, start double, end double, duration double"))
    new = {(r.experiment, r.actual): r.segments for r in after.collect()}
    assert after.count() == a.count() and [tuple(x) for x in new[5, 0]] == [(2.0, 32.0)] and [r[0] for r in changed.collect()] == [5]
    assert {tuple(r) for r in refused.collect()} == {(5, 9, 1, "no such clip"), (500, 0, 1, "no such clip"), (7, 1, 1, "outside the source"), (None, 0, 1, "no such clip")}
