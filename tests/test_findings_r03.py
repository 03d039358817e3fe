"""What the findings of the third round named."""

import time

from pyspark.sql import functions as F

from clipsift.operators import alignment, topics


def test_truncation_of_a_cut_that_ends_in_a_line_break(spark):
    text = "a" * 70 + " " + "b" * 7 + "\n" + "c" * 9  # the 79th character is the line break
    assert spark.createDataFrame([(text,)], "text string").select(topics.truncated(F.col("text"), 80)).collect()[0][0] == "a" * 70 + " " + "b" * 7 + "…"


def test_segments_of_many_shorts(spark):
    """A frame for each short took several milliseconds of it."""
    n = 20_000
    w = F.struct((F.col("i") * 6.0).alias("short_start"), (F.col("i") * 6.0 + 10.0).alias("short_end"), F.when(F.col("i") == 2, 30.0).otherwise(F.col("i") * 1.0).alias("offset"), F.lit(0.6).alias("score"))
    df = spark.range(n).withColumnRenamed("id", "short").withColumn("i", F.explode(F.array(*map(F.lit, range(3))))).select("short", w.alias("w")).select("short", "w.*", F.lit(60.0).alias("source_length"))
    began = time.time()
    got = alignment.aligned_segments(df, "short").groupBy("segment", "short_start", "short_end", "source_start", "source_end", "windows", "compound").count().collect()
    assert [tuple(r) for r in got] == [(1, 0.0, 16.0, 0.5, 16.5, 2, False, n)]
    assert time.time() - began < 40


def test_words_asked_for_are_found_in_their_texts(spark, sf):
    """Texts and asks are joined; no exchange holds single words."""
    from clipsift.plans.registry import QUERIES

    for name in ("jon01_interval_text", "flt01_overlap_count", "jon15_band_average", "seq16_boundary_queries"):
        plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        lines = [x for x in plan.split("\n") if "Exchange" in x or "Generate" in x]
        assert ["Generate" in x for x in lines].index(True) == 0 and sum("Generate" in x for x in lines) == 1, name  # after all exchanges


def test_plan_of_corrections_is_short(spark, sf):
    """It held every earlier step many times (52,334 characters) before tables were written between."""
    from clipsift.plans.registry import QUERIES

    assert len(QUERIES["oth18_corrected_matches"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()) < 20_000


def test_clips_of_the_chain_meet_vectors_and_curves_once(spark, sf):
    """Each clip was sent with its vector to every block of examples, and became a row for each point of its curve."""
    from clipsift.plans.registry import QUERIES

    plan = QUERIES["seq12_score_chain"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "CoGroup" not in plan and "Generate" not in plan


def test_kernel_sums_against_a_loop(spark):
    import numpy as np

    from clipsift.operators.vectors import kernel_sums

    rng = np.random.default_rng(1)
    units = rng.normal(size=(50, 4))
    units /= np.linalg.norm(units, axis=1)[:, None]
    examples = [("abc"[int(rng.integers(3))], int(rng.integers(40)), float(rng.normal())) for _ in range(300)]
    asked = sorted({("abcd"[int(rng.integers(4))], int(rng.integers(50))) for _ in range(60)})
    frames = [spark.createDataFrame(rows, schema) for rows, schema in ((asked, "g string, k long"), (examples, "g string, k long, o double"), ([(i, [float(x) for x in u]) for i, u in enumerate(units)], "k long, v array<double>"))]
    got = {(r.g, r.k): (r.w, r.wo) for r in kernel_sums(*frames, "k", "g", "o", block=16, examples_block=8).collect()}
    assert set(got) == {x for x in asked if x[0] != "d"}
    for (g, k), (w, wo) in got.items():
        each = [(np.exp((units[k] @ units[j] - 1) / 0.12), o) for h, j, o in examples if h == g]
        assert abs(w - sum(x for x, _ in each)) < 1e-9 and abs(wo - sum(x * o for x, o in each)) < 1e-9


def test_topics_leave_their_text_only_where_they_can_be_taken(spark):
    """Every term of every text was shuffled three times; the choice is that of a loop over all terms, however few are known as common."""
    import math
    import random
    from collections import Counter

    rng = random.Random(4)
    vocabulary = [f"w{i:03d}x" for i in range(400)]
    rows = [("ab"[d % 2], d, " ".join(vocabulary[int(400 * rng.random() ** 3)] for _ in range(rng.choice([0, 1, 5, 60, 400])))) for d in range(40)]
    docs = spark.createDataFrame(rows, "g string, k long, text string")
    tf = {(g, k): Counter((w := t.split()) + [f"{a} {b}" for a, b in zip(w, w[1:])]) for g, k, t in rows}
    df, n = Counter((g, t) for (g, _), c in tf.items() for t in c), Counter(g for g, _, _ in rows)
    for weigh in (None, lambda t: {0: True, 1: False}.get(int(t[1:4]) % 3)):
        expected = set()
        for (g, k), c in tf.items():
            factor = lambda t: 1.0 if weigh is None else {True: 1.35, False: 0.75, None: 1.0}[weigh(t)]  # noqa: B023, E731
            score = {t: round(x * (math.log((n[g] + 1) / (df[g, t] + 1)) + 1) * factor(t) * (1.15 if " " in t else 1), 6) for t, x in c.items()}  # noqa: B023
            used, taken = set(), []
            for t in sorted(score, key=lambda t: (-score[t], -len(t), t)):  # noqa: B023
                if len(taken) < 6 and not used.issuperset(t.split()):
                    used.update(t.split())
                    taken.append(t)
            expected |= {(k, i + 1, t) for i, t in enumerate(taken)}
        trends = None if weigh is None else spark.createDataFrame([(g, t, weigh(t)) for g, t in df if weigh(t) is not None], "g string, term string, favoured boolean")
        for common in (0, 50, 1 << 17):
            assert {(r.k, r.rank, r.term) for r in topics.topics(docs, "g", "k", "text", 6, trends, common=common).collect()} == expected
    counts, sizes = topics.document_frequencies(docs, "g", "text"), docs.groupBy("g").count().withColumnRenamed("count", "n")
    assert topics._contenders(docs, "g", "k", "text", counts, sizes, None, 10, 1 << 17)[0].count() * 3 < sum(map(len, tf.values()))


def _plan(spark, sf, name: str) -> list[str]:
    from clipsift.plans.registry import QUERIES

    return QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString().split("\n== Initial")[0].split("\n")


def test_delivery_norms_take_one_shuffle_and_a_sort_for_each_metric(spark, sf):
    plan = _plan(spark, sf, "win13_delivery_norm")
    assert sum(" Exchange " in x for x in plan) == 1 and sum(" Sort " in x for x in plan) <= 6  # 2 and 11


def test_annotation_queue_reads_its_clips_once(spark, sf):
    plan = _plan(spark, sf, "top11_annotation_queue")
    assert sum("Scan parquet" in x and "lineitem" in x for x in plan) <= 1 and sum(" Exchange " in x for x in plan) <= 4


def test_repeats_are_counted_inside_their_text(spark, sf):
    from clipsift.functions.scalars import let

    assert not any("Exchange" in x for x in _plan(spark, sf, "str23_ngram_repeats"))
    got = spark.createDataFrame([(["b", "a", "b", "c", "b"],), (["a"],)], "t array<string>").select(let(F.array_sort("t"), topics.run_lengths)).collect()
    assert [r[0] for r in got] == [[1, 3, 1], [1]]


def test_boundary_features_stay_in_their_text(spark, sf):
    """Windows over all words of all texts, of which a heuristic then took those within 3.5 s."""
    for name in ("mth15_boundary_features", "mth16_boundary_heuristic"):
        assert not any("Window" in x for x in _plan(spark, sf, name))


def test_appended_events_are_dealt_by_their_number(spark, sf, monkeypatch):
    """Orders and lines were read twice, and met in as few tasks as their compressed keys fill, however many there are."""
    from clipsift.operators.learning import append_events
    from clipsift.plans import bridges
    from clipsift.plans.registry import QUERIES

    monkeypatch.setattr(bridges, "PART_ORDERS", 100, raising=False)
    got = QUERIES["oth14_event_append"](spark, sf)
    plan = _plan(spark, sf, "oth14_event_append")
    assert got.rdd.getNumPartitions() == -(-bridges.table(spark, sf, "orders").count() // 100)
    assert sum("Scan parquet" in x and "l_orderkey" in x for x in plan) == 1 and sum(" Exchange " in x for x in plan) == 3
    schema = "clip long, event_type string"
    log, refused = append_events(spark.createDataFrame([(1, "reject")], schema), spark.createDataFrame([(1, "reject"), (2, "reject"), (None, "reject"), (1, "shrug"), (3, "shrug")], schema), spark.createDataFrame([(1,), (1,)], "clip long"))
    assert sorted(map(tuple, log.collect())) == [(1, "reject")] * 2
    assert sorted(map(str, map(tuple, refused.collect()))) == ["(1, 'shrug', 'event type')", "(2, 'reject', 'unknown clip')", "(3, 'shrug', 'event type')", "(None, 'reject', 'unknown clip')"]


def test_gate_counts_find_their_texts_once(spark, sf):
    """A filter on whether there are reasons held the text eleven times and its tokens seven times."""
    from clipsift.plans.registry import QUERIES

    plan = QUERIES["agg31_gate_counts"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(") <= 2 and plan.count("regexp_extract_all(") <= 3  # 13 and 10


def test_sessions_of_a_batch_read_and_write_their_state_once(monkeypatch):
    """Each event asked the state store three times or more, and each login left a timer; each call takes longer than an event."""
    from collections import Counter
    from types import SimpleNamespace

    from clipsift.streaming import leases

    calls, held, timers = Counter(), {}, set()

    def call(name, f):
        def run(*a):
            calls[name] += 1
            return f(*a)

        return run

    store = {"exists": lambda: bool(held), "iterator": lambda: iter(list(held.items())), "containsKey": lambda k: k in held, "updateValue": held.__setitem__, "removeKey": held.pop}
    handle = {"getMapState": lambda *_: SimpleNamespace(**{n: call(n, f) for n, f in store.items()}), "registerTimer": call("timer", timers.add), "deleteTimer": call("timer", timers.discard)}
    sessions = leases.Sessions(10)
    sessions.init(SimpleNamespace(**handle))
    second = leases.MICRO
    rows = [{"at": i * second, "token": i % 7, "event": "logout" if i % 7 == 3 and i % 2 else "login"} for i in range(1000)]
    late = SimpleNamespace(getCurrentWatermarkInMs=lambda: 1_005_500)
    out = [tuple(r[c] for c in ("token", "at", "change")) for part in (rows[:600], rows[600:]) for r in sessions.handleInputRows((5,), iter(part), late)]
    assert sum(calls.values()) <= 60 and len(timers) == 1  # thousands, and a timer for each login
    ends, expected = {}, []
    for r in rows:
        for token in sorted((t for t in ends if ends[t] <= r["at"]), key=lambda t: (ends[t], t)):
            expected.append((token, ends.pop(token), "expired"))
        if r["event"] == "login":
            ends[r["token"]] = r["at"] + 10 * second
            expected.append((r["token"], r["at"], "opened"))
        elif ends.pop(r["token"], None):
            expected.append((r["token"], r["at"], "closed"))
    assert out == expected and {k[0]: v[0] for k, v in held.items()} == ends
    first = SimpleNamespace(getExpiryTimeInMs=lambda: min(timers))
    gone = {(r["token"], r["at"]) for r in sessions.handleExpiredTimer((5,), late, first)}
    assert gone == {(t, u) for t, u in ends.items() if u <= 1005.5 * second} and {k[0] for k in held} == {t for t, u in ends.items() if u > 1005.5 * second}
    assert min(v[0] for v in held.values()) // 1000 in timers


def test_ablation_finds_its_features_once(spark):
    """Widths, sums, and each measure of the report found all rows' features anew."""
    from clipsift.operators import validation

    seen = spark.sparkContext.accumulator(0)

    @F.udf("array<double>")
    def features(i):
        seen.add(1)
        return [float(i % 7), float(i % 3)]

    df = spark.range(200).select((F.col("id") % 20).cast("string").alias("grp"), "id", features("id").alias("x"), (F.col("id") % 5).cast("double").alias("y"))
    found = validation.ablation(df, "grp", "id", ["x"], {"all": ("x",)}, ["y"], folds=4, alpha=1.0, seed=42)
    assert [r.n for r in validation.ablation_report(found, "grp", "id", ["all"]).collect()] == [200, 200] and seen.value == 200


def test_preference_sums_against_a_loop():
    """Rows of few ratings are merged by their features, others aren't; slices of both, ratings that are missing, a model left out."""
    import numpy as np
    import pandas as pd

    from clipsift.operators import models

    rng = np.random.default_rng(6)
    for ratings in (3, 10_000):
        side = lambda n: pd.DataFrame({"x": [[float(v) for v in rng.integers(0, 4, 2)] for _ in range(n)], "y": np.where(rng.random(n) < 0.1, np.nan, rng.integers(0, ratings, n).astype(float)), "n": rng.integers(1, 4, n)})  # noqa: B023, E731
        rows, near, w, scale = side(700), side(900), np.array([0.7, -1.3]), np.array([2.0, 0.5])
        got = models.preference_sums(rows, near, "x", "y", [None, (scale, w)], 2)
        a, b = np.stack(rows["x"]) / scale, np.stack(near["x"]) / scale
        c = np.outer(rows["n"], near["n"]) * (rows["y"].to_numpy()[:, None] > near["y"].to_numpy()[None, :])
        z = (a @ w)[:, None] - (b @ w)[None, :]
        p = 1 / (1 + np.exp(z))
        d = a[:, None, :] - b[None, :, :]
        expected = [c.sum(), (c * np.log1p(np.exp(-z))).sum(), *-(d * (c * p)[:, :, None]).sum((0, 1)), *np.einsum("ij,ijk,ijl->kl", c * p * (1 - p), d, d).ravel()]
        assert not got[0].any() and np.allclose(got[1], expected, rtol=1e-9)
    assert not models.preference_sums(rows[:0], near, "x", "y", [(scale, w)], 2).any()


def test_blocks_keep_their_tasks(spark):
    """Blocks of few bytes were merged into one task, whatever their work."""
    import pandas as pd

    from clipsift.operators.vectors import block_products

    df = spark.range(400).select("id", (F.col("id") % 40).alias("g"))
    parts = block_products(df, df, "id", None, "g", lambda _, rows, near: pd.DataFrame({"n": [len(rows) * len(near)]}), "n long", 4)
    got = parts.withColumn("task", F.spark_partition_id()).groupBy("task").agg(F.sum("n").alias("n")).collect()
    assert len(got) == int(spark.conf.get("spark.sql.shuffle.partitions")) and sum(r.n for r in got) == 40 * 100
