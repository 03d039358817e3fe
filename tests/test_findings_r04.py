"""What the findings of the fourth round named."""

import numpy as np
import pytest
from pyspark.sql import functions as F


def _exchanges_above(plan: list[str], table: str) -> int:
    """How many exchanges the first scan of a table's rows passes on its way up."""
    at = next(i for i, x in enumerate(plan) if "Scan parquet" in x and table in x)
    depth, found = plan[at].index("FileScan"), 0
    for line in reversed(plan[:at]):
        here = len(line) - len(line.lstrip(" :+-"))
        if here < depth:
            depth, found = here, found + (" Exchange " in line)
    return found


@pytest.mark.parametrize("name", ["seq12_holdout_chain", "seq12_score_chain"])
def test_clips_of_the_chain_are_shuffled_once(spark, sf, name):
    """Lines were dealt by the video, and all clips' columns again by the vector."""
    from clipsift.plans.registry import QUERIES

    plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString().split("\n== Initial")[0].split("\n")
    assert _exchanges_above(plan, "l_orderkey") == 1


def test_clips_with_reports_are_those_of_a_join(spark, sf):
    from pyspark.sql import Window

    from clipsift.plans import bridges as b

    reports = b.performance(spark, sf).where("clip % 5 <> 0").select(F.col("clip").alias("video"), F.when(F.col("clip") % 7 != 0, F.col("creator")).alias("creator"), F.col("views").alias("exposure"))
    joined = b.clips(spark, sf).withColumn("length", F.max("end").over(Window.partitionBy("video")) + 30.0).join(reports, "video").withColumn("k", F.col("video") % 11)
    got = b.reported_clips(spark, sf, reports, "k", lambda v: v % 11)
    assert set(got.columns) == set(joined.columns) and got.count() > 1000
    assert got.select(joined.columns).exceptAll(joined).count() == joined.exceptAll(got.select(joined.columns)).count() == 0


@pytest.mark.parametrize("groups", [3, 60])
def test_sums_of_near_groups_against_a_loop(spark, groups):
    """Sums of a cohort came of a join with a row for each contributor; few groups meet as one table, many by their own examples."""
    from clipsift.operators.vectors import kernel_sums

    rng = np.random.default_rng(2)
    units = rng.normal(size=(70, 4))
    units /= np.linalg.norm(units, axis=1)[:, None]
    examples = [(f"g{rng.integers(groups)}", int(rng.integers(50)), float(rng.normal())) for _ in range(90)]
    asked = sorted({(f"g{rng.integers(groups + 2)}", int(rng.integers(70))) for _ in range(120)})
    near = [(f"g{i}", f"g{(i * 7 + j) % (groups + 4)}") for i in range(1, groups + 1) for j in range(1 + i % 3)]
    frames = [spark.createDataFrame(rows, schema) for rows, schema in ((asked, "g string, k long"), (examples, "g string, k long, o double"), ([(i, [float(x) for x in u]) for i, u in enumerate(units)], "k long, v array<double>"))]
    each = lambda g, k: [(np.exp((units[k] @ units[j] - 1) / 0.12), o) for h, j, o in examples if h == g]
    total = lambda found: (sum(x for x, _ in found), sum(x * o for x, o in found))
    expected = {(g, k): (*total(each(g, k)), *total([x for h, c in near if h == g for x in each(c, k)])) for g, k in asked}
    for sizes in ({}, {"block": 16, "examples_block": 8}):
        got = {(r.g, r.k): (r.w, r.wo, r.near_w, r.near_wo) for r in kernel_sums(*frames, "k", "g", "o", near=spark.createDataFrame(near, "g string, contributor string"), **sizes).collect()}
        assert all(np.allclose(got.get(x, (0, 0, 0, 0)), v, atol=1e-9) for x, v in expected.items()) and set(got) <= set(expected)


def test_retention_by_halving_against_a_loop(spark):
    """Every clip filtered all points of its curve; curves of all lengths, points at one place or none, bounds on points."""
    from clipsift.operators.scoring import with_retention

    rng = np.random.default_rng(5)
    curves = {}
    for c, n in enumerate((9, 10, 15, 16, 17, 31, 32, 63, 64, 65, 130)):
        at = np.sort(rng.integers(0, 40, n) / 40.0) if c % 2 else np.arange(n) / n
        curves[c] = [(None if c % 3 == 0 and i == 1 else float(x), float(rng.normal())) for i, x in enumerate(at)]
    points = spark.createDataFrame([(c, at, None, y) for c, p in curves.items() for at, y in p], "c long, at double, relative double, watch double")
    clips = [(i, int(rng.integers(12)), float(s := rng.integers(0, 40)), float(s + rng.integers(0, 12)), 40.0, 100) for i in range(400)] + [(400, 4, None, 9.0, 40.0, 100), (401, 4, 9.0, None, 40.0, 100), (402, 4, 3.0, 9.0, 40.0, 99)]
    got = {r.clip: r.retained for r in with_retention(spark.createDataFrame(clips, "clip long, c long, start double, end double, length double, exposure long"), points, "c").collect()}
    for clip, c, start, end, length, exposure in clips:
        p, expected = curves.get(c, []), None
        here = [y for at, y in p if at is not None and start is not None and end is not None and start / length <= at <= end / length]
        if len(p) >= 10 and exposure >= 100 and here:
            centre = np.median([y for _, y in p])
            spread = max(0.05, np.sqrt(np.mean([(y - centre) ** 2 for _, y in p])))
            expected = 0.2 * np.tanh((np.mean(here) - centre) / spread / 2)
        assert (got[clip] is None) == (expected is None) and (expected is None or abs(got[clip] - expected) < 1e-9), clip


def _texts(spark, n: int):
    rng = np.random.default_rng(3)
    vocabulary = [f"w{i:04d}" + "x" * (i % 5) for i in range(4000)]
    rows = [("ab"[d % 2], d, " ".join(vocabulary[int(4000 * rng.random() ** 2)] for _ in range(int(rng.choice([0, 1, 6, 300]))))) for d in range(n)]
    return rows, spark.createDataFrame([*rows, (None, n, "w0001 w0002"), ("a", n + 1, None)], "g string, k long, text string")


def test_words_of_tasks_are_those_of_columns(spark):
    from clipsift.functions.text import topic_words
    from clipsift.operators import topics

    texts = ["It's Kelvin and İstanbul, the DON'T Don't ABC a1 😀x99 cafés ſtop", "", "'' ''' o'clock\x00nul line", "the and you"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(topic_words(F.col("t"))).collect()
    assert [r[0] for r in got] == [topics._words(t) for t in texts]


def test_frequencies_of_packed_terms_against_a_loop(spark):
    """Each term of each text was a row; now tasks send what they counted whenever that is much."""
    from collections import Counter

    from clipsift.operators import topics

    rows, docs = _texts(spark, 120)
    terms = lambda w: {*w, *(f"{a} {b}" for a, b in zip(w, w[1:]))}
    df = Counter((g, x) for g, _, t in rows for x in terms(t.split()))
    for counted in (1, 5000, 1 << 20):
        got = topics.document_frequencies(docs, "g", "text", counted=counted).collect()
        assert {(r.g, r.term): r.df for r in got if r.g} == {x: n for x, n in df.items() if n > 1} and len(got) == len({(r.g, r.term) for r in got})


def test_terms_of_one_text_are_told_apart(spark):
    """Terms that might be in other texts all left their text; nearly all are in this one alone, where ties go by length and name."""
    import math
    from collections import Counter

    from clipsift.operators import topics

    rows, docs = _texts(spark, 120)
    tf = {(g, k): Counter([*(w := t.split()), *(f"{a} {b}" for a, b in zip(w, w[1:]))]) for g, k, t in rows}
    df, n = Counter((g, t) for (g, _), c in tf.items() for t in c), Counter(g for g, _, t in rows)
    n["a"] += 1  # the one without a text
    weigh = lambda t: {0: True, 1: False}.get(int(t[1:5]) % 3)
    for trends in (None, [(g, t, weigh(t)) for g, t in df if weigh(t) is not None]):
        expected = set()
        for (g, k), c in tf.items():
            factor = lambda t: 1.0 if trends is None else {True: 1.35, False: 0.75, None: 1.0}[weigh(t)]  # noqa: B023, E731
            score = {t: round(x * (math.log((n[g] + 1) / (df[g, t] + 1)) + 1) * factor(t) * (1.15 if " " in t else 1), 6) for t, x in c.items()}  # noqa: B023
            used, taken = set(), []
            for t in sorted(score, key=lambda t: (-score[t], -len(t), t)):  # noqa: B023
                if len(taken) < 6 and not used.issuperset(t.split()):
                    used.update(t.split())
                    taken.append(t)
            expected |= {(k, i + 1, t) for i, t in enumerate(taken)}
        given = None if trends is None else spark.createDataFrame(trends, "g string, term string, favoured boolean")
        for common in (0, 1 << 17):
            assert {(r.k, r.rank, r.term) for r in topics.topics(docs, "g", "k", "text", 6, given, common=common).collect()} == expected
    counts, sizes = topics.document_frequencies(docs, "g", "text"), docs.groupBy("g").count().withColumnRenamed("count", "n")
    kept = [topics._contenders(docs, "g", "k", "text", counts, sizes, None, 10, 0, *most)[0] for most in ((), (1 << 13,))]
    assert kept[0].count() * 4 < sum(map(len, tf.values())) and kept[0].count() <= kept[1].count()  # few bits leave more terms open


def test_counts_of_terms_make_no_row_of_each(spark, sf):
    """All terms of all texts were exploded and shuffled as rows."""
    from clipsift.operators import topics

    plans = []
    keep = topics.written
    topics.written = lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or keep(df)
    try:
        topics.document_frequencies(_texts(spark, 10)[1], "g", "text")
    finally:
        topics.written = keep
    assert len(plans) == 1 and "Generate" not in plans[0] and "MapInPandas" in plans[0]
