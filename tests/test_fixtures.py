"""Small literal cases with known results, and invariants."""

import io
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from clipsift.functions import scalars, text
from clipsift.operators import alignment, joins, learning, models, ranking, sequence, sets, topics
from clipsift.sources import analytics


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_iou(spark):
    lit = F.lit
    r = one(spark, scalars.iou(lit(0.0), lit(10.0), lit(5.0), lit(15.0)).alias("a"), scalars.iou(lit(0.0), lit(5.0), lit(5.0), lit(9.0)).alias("b"), scalars.iou(lit(1.0), lit(1.0), lit(1.0), lit(1.0)).alias("c"))
    assert (r.a, r.b, r.c) == (pytest.approx(1 / 3), 0.0, 0.0)


def test_average_rank_of_ties(spark):
    df = spark.createDataFrame([("g", 10.0), ("g", 20.0), ("g", 20.0), ("g", 40.0)], "g string, x double")
    assert sorted(r.r for r in df.select(ranking.average_rank("x", ["g"]).alias("r")).collect()) == [1.0, 2.5, 2.5, 4.0]


def test_percentiles_of_flat_and_single_groups(spark):
    df = spark.createDataFrame([("flat", 1.0), ("flat", 1.0), ("one", 3.0)], "g string, x double")
    r = df.select(ranking.mid_percentile("x", ["g"]).alias("m"), ranking.centred_percentile("x", ["g"]).alias("c"), ranking.strict_percentile("x", ["g"]).alias("s")).collect()
    assert {(x.m, x.c, x.s) for x in r} == {(0.5, 0.0, 0.0)}


def test_greedy_diverse(spark):
    rows = [("v", "first", 0.0, 40.0, 100.0), ("v", "same", 2.0, 42.0, 99.0), ("v", "different", 50.0, 90.0, 80.0)]
    df = spark.createDataFrame(rows, "video string, clip string, start double, end double, score double")
    for n in (1, 16):
        got = ranking.greedy_diverse(df.repartition(n), ["video"], [("score", True), ("clip", False)], 2, 0.5).orderBy("rank")
        assert [r.clip for r in got.collect()] == ["first", "different"]


def test_no_two_selected_clips_overlap(spark, sf):
    from clipsift.plans import bridges

    kept = ranking.greedy_diverse(bridges.clips(spark, sf), ["video"], [("score", True), ("clip", False)], 5, 0.1).select("video", "clip", "start", "end")
    other = kept.select("video", F.col("clip").alias("c2"), F.col("start").alias("s2"), F.col("end").alias("e2"))
    worst = kept.join(other, "video").where("clip < c2").agg(F.max(scalars.iou(F.col("start"), F.col("end"), F.col("s2"), F.col("e2")))).first()[0]
    assert worst is None or worst <= 0.1


def test_sentence_units(spark):
    words = [(0, 0.0, 0.4, "Hello"), (1, 0.5, 0.9, "world."), (2, 1.0, 1.4, "Then"), (3, 1.5, 3.4, "pause"), (4, 5.0, 5.3, "last"), (5, 5.4, 5.8, "one")]
    df = spark.createDataFrame([("v", *w) for w in words], "video string, pos int, start double, end double, word string")
    got = [(r.start, r.end, r.words) for r in sequence.sentence_units(df).orderBy("unit").collect()]
    assert got == [(0.0, 0.9, 2), (1.0, 3.4, 2), (5.0, 5.8, 2)]


def test_candidates_take_the_nearest_end_and_the_earlier_of_two(spark):
    units = spark.createDataFrame([(1, k, 10.0 * k, 10.0 * k + 10) for k in range(7)], "video long, unit int, start double, end double")
    got = [r.end - r.start for r in sequence.candidates(units, targets=(20.0, 45.0, 60.0)).where("start_unit = 0").orderBy("end").collect()]
    assert got == [20.0, 40.0, 60.0]


def test_text_features(spark):
    df = spark.createDataFrame([("Why does this secret matter? It is the truth.", 4.0, 10, 2)], "text string, d double, w int, s int").withColumn("tok", text.tokens(F.col("text")))
    r = df.select(*[c.alias(k) for k, c in text.transcript_features(F.col("text"), F.col("tok"), F.col("d"), F.col("w"), F.col("s")).items()]).first()
    assert (r.clean_start, r.complete_end, r.words_per_second) == (1.0, 1.0, 2.5)
    assert r.hook_signal == pytest.approx(0.8)


@pytest.mark.parametrize(
    ("said", "seconds", "eligible", "codes"),
    [
        ("This video is sponsored by a brand we like very much indeed.", 20.0, False, {"advertisement_language", "context_dependent_start", "sparse_speech"}),
        ("[Music] ♪", 20.0, False, {"music_only", "incomplete_ending", "sparse_speech"}),
        ("And that is how they finish", 3.0, True, {"context_dependent_start", "incomplete_ending"}),
        ("Every careful builder tests the plan before the real work begins.", 5.0, True, set()),
    ],
)
def test_gate(spark, said, seconds, eligible, codes):
    df = spark.createDataFrame([(said, seconds, len(said.split()))], "text string, d double, w int").withColumn("tok", text.tokens(F.col("text")))
    f = text.transcript_features(F.col("text"), F.col("tok"), F.col("d"), F.col("w"), F.lit(1))
    r = df.select(text.gate_reasons(F.col("text"), f, F.col("d")).alias("r")).select("r", text.gate_eligible(F.col("r")).alias("ok"), text.gate_score(F.col("r")).alias("s")).first()
    assert r.ok == eligible and {x.code for x in r.r} == codes
    assert r.s == (pytest.approx(1 - sum(x.penalty for x in r.r)) if eligible else 0.0)


def test_adjustments_stay_within_their_caps(spark):
    grid = spark.range(0, 500).select(*[(F.rand(k) * 4 + 1).alias(c) for k, c in enumerate("abcd")], (F.rand(9) * 80).alias("dur"), F.rand(10).alias("u"), F.rand(11).alias("e"), F.element_at(F.array(*map(F.lit, scalars.PLATFORMS)), (F.col("id") % 3 + 1).cast("int")).alias("p"))
    a = scalars.platform_adjustment(F.col("p"), [F.col(c) for c in "abcd"], F.col("dur"), F.col("u"), F.col("e"))
    assert grid.select(F.max(F.abs(a))).first()[0] <= scalars.PLATFORM_CAP
    x, y = scalars.cap_jointly(F.col("a") - 3, F.col("b") - 3, 0.25)
    assert grid.select(F.max(F.abs(x + y))).first()[0] <= 0.25 + 1e-12


def test_interval_joins_match_brute_force(spark):
    rng = np.random.default_rng(5)
    l = [(int(k % 3), int(k), float(s), float(s + rng.uniform(0.1, 40))) for k, s in enumerate(rng.uniform(-50, 200, 60))]
    r = [(int(k % 3), int(k), float(s), float(s + rng.uniform(0.1, 5))) for k, s in enumerate(rng.uniform(-50, 200, 80))]
    left, right = spark.createDataFrame(l, "g int, i int, s double, e double"), spark.createDataFrame(r, "g int, j int, a double, b double")
    got = [(x.i, x.j) for x in joins.overlap_join(left, right, ["g"], ("s", "e"), ("a", "b"), 10.0).select("i", "j").collect()]
    assert sorted(got) == sorted((x[1], y[1]) for x in l for y in r if x[0] == y[0] and x[3] > y[2] and x[2] < y[3])
    got = [(x.i, x.j) for x in joins.distance_join(left, right, ["g"], "s", "a", -3.0, 7.0).select("i", "j").collect()]
    assert sorted(got) == sorted((x[1], y[1]) for x in l for y in r if x[0] == y[0] and -3 <= y[2] - x[2] <= 7)
    found = joins.latest_before(left, right, ["g"], "s", "a", "a", "v", 0.05).collect()
    for x in found:
        assert x.v == max((y[2] for y in r if y[0] == x.g and y[2] <= x.s + 0.05), default=None)


def test_greedy_matching_prefers_larger_ids_on_ties(spark):
    df = spark.createDataFrame([("g", 1, 1, 0.5), ("g", 2, 1, 0.5), ("g", 2, 2, 0.4), ("g", 1, 2, 0.3)], "g string, p int, a int, iou double")
    got = {(r.p, r.a) for r in joins.greedy_matches(df, "g", "p", "a", "iou").collect()}
    assert got == {(2, 1), (1, 2)}


def test_job_replay(spark):
    log = [("a", k, e) for k, e in enumerate(["enqueue", "claim", "expire", "claim", "complete"])] + [("b", k, e) for k, e in enumerate(["enqueue"] + ["claim", "fail"] * 3 + ["claim"])]
    got = {r.job: (r.status, r.attempts) for r in sequence.replay_jobs(spark.createDataFrame(log, "job string, seq int, event string")).collect()}
    assert got == {"a": ("complete", 2), "b": ("failed", 3)}


def test_closing_a_review_twice_adds_nothing(spark):
    events = spark.createDataFrame([(1, 10, "presented"), (2, 11, "presented"), (3, 11, "reject")], "event_id long, clip long, event_type string")
    first = learning.close_review(events)
    assert [r.clip for r in first.collect()] == [10]
    assert learning.close_review(events.unionByName(first.select(F.lit(9).cast("long").alias("event_id"), "clip", "event_type"))).isEmpty()


def test_upsert_keeps_what_a_new_null_would_erase(spark):
    old, new = spark.createDataFrame([(1, 5), (2, 6)], "k int, v int"), spark.createDataFrame([(2, None), (3, 7)], "k int, v int")
    assert {(r.k, r.v) for r in sets.upsert(old, new, ["k"]).collect()} == {(1, 5), (2, 6), (3, 7)}


def test_numbers_and_durations(spark):
    raw = spark.createDataFrame([("1,234",), ("25%",), ("—",), ("n/a",), ("inf",), ("x",)], "r string")
    assert [r.n for r in raw.select(analytics.parsed_number(F.col("r")).alias("n")).collect()] == [1234.0, 25.0, None, None, None, None]
    raw = spark.createDataFrame([("00:00:18",), ("1h 5m 30s",), ("90",), ("2:05",)], "r string")
    assert [r.n for r in raw.select(analytics.parsed_seconds(F.col("r")).alias("n")).collect()] == [18.0, 3930.0, 90.0, 125.0]
    raw = spark.createDataFrame([("1.2M",), ("17k",), ("350",), ("zz",)], "r string")
    assert [r.n for r in raw.select(analytics.compact_count(F.col("r")).alias("n")).collect()] == [1_200_000, 17_000, 350, None]


def test_exports_of_every_kind(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("Views,Likes\n900,23\n".encode("utf-16"))
    (tmp_path / "b.tsv").write_text("Views\tLikes\n1\t2\n")
    with zipfile.ZipFile(tmp_path / "c.zip", "w") as z:
        z.writestr("inner.csv", "Views\n7\n")
    sheet = '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>Saves</t></is></c></row><row r="2"><c r="A2"><v>900</v></c><c r="C2"><v>23</v></c></row></sheetData></worksheet>'
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("xl/sharedStrings.xml", "<sst><si><t>Views</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", sheet)
    (tmp_path / "d.xlsx").write_bytes(data.getvalue())
    (tmp_path / "e.zip").write_bytes(b"no archive")
    rows = analytics.read_exports(spark, str(tmp_path)).collect()
    got = {(r.file[-5:], r.header, r.value) for r in rows if r.header}
    assert got == {("a.csv", "Views", "900"), ("a.csv", "Likes", "23"), ("b.tsv", "Views", "1"), ("b.tsv", "Likes", "2"), ("c.zip", "Views", "7"), ("d.xlsx"[-5:], "Views", "900"), ("d.xlsx"[-5:], "Saves", "23")}
    assert [r.file[-5:] for r in rows if r.header is None] == ["e.zip"]


def test_ridge_recovers_a_line(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 2))
    df = spark.createDataFrame([([float(a), float(b)], float(3 + 2 * a - b)) for a, b in x], "x array<double>, y double")
    got = {r.feature: r.coefficient for r in models.ridge_coefficients(df, "x", ["y"], alpha=0).collect()}
    assert got[0] / x[:, 0].std() == pytest.approx(2) and got[1] / x[:, 1].std() == pytest.approx(-1)


def test_folds_never_split_a_group(spark, sf):
    from clipsift.plans.registry import QUERIES

    per = QUERIES["ml07_grouped_cv"](spark, sf).groupBy("grp").agg(F.count_distinct("fold").alias("n"))
    assert per.agg(F.max("n")).first()[0] == 1


def test_alignment_finds_a_planted_offset():
    rng = np.random.default_rng(2)
    signal = rng.normal(size=5000)
    template = signal[1250:1650] * 3 + 1 + rng.normal(size=400) * 0.01
    c = alignment.correlate(signal, template)
    assert c.argmax() == 1250 and c.max() > 0.99


def test_alignment_of_every_creator(spark, sf):
    """Each creator's whole series, blocks or not, as one correlation over all of it finds."""
    from clipsift.plans.registry import QUERIES

    sf = sf.replace("sf0.001", "sf0.01")  # the smaller tables have no creator from 40 on
    events = spark.read.parquet(f"{sf}/events.parquet").toPandas().sort_values(["event_id", "value"])
    series = {k: g.value.to_numpy(dtype=float) for k, g in events.groupby("user_id")}
    got = {r.creator: r for r in QUERIES["ml14_alignment"](spark, sf).collect()}
    assert set(got) == set(series) and max(series) >= 40
    rng = np.random.default_rng(3)
    signal = {1: rng.normal(size=1000), 2: rng.normal(size=30), 3: rng.normal(size=12)}
    points = spark.createDataFrame([(k, p, float(v)) for k, s in signal.items() for p, v in enumerate(s)], "creator long, pos long, value double")
    templates = spark.createDataFrame([(1, [float(v) for v in signal[1][250:266]]), (2, [float(v) for v in signal[2][10:26]]), (3, [float(v) for v in rng.normal(size=16)])], "creator long, template array<double>")
    blocks = {r.creator: r for r in alignment.align(points, templates, "creator", 16, block=64).collect()}
    template = {1: signal[1][250:266], 2: signal[2][10:26], 3: np.zeros(16)}
    for found, of, parts in ((got, series, {k: s[10:26] for k, s in series.items()}), (blocks, signal, template)):
        assert set(found) == set(of)
        for k, s in of.items():
            c = alignment.correlate(s, parts[k])
            if not len(c):
                assert found[k].offset is None and found[k].score is None
                continue
            rest = c[np.abs(np.arange(len(c)) - c.argmax()) >= 8]
            assert found[k].score == pytest.approx(c.max(), abs=2e-6) and c[found[k].offset] == pytest.approx(c.max(), abs=1e-9)
            assert found[k].runner_up == (pytest.approx(rest.max(), abs=2e-6) if len(rest) else None)
    assert blocks[1].offset == 250


def test_short_texts_have_no_ngrams(spark):
    df = spark.createDataFrame([(["a", "b"],), (["a", "b", "c", "d", "e"],)], "t array<string>")
    assert [len(r.g) for r in df.select(topics.ngrams(F.col("t"), 4).alias("g")).collect()] == [0, 2]


def test_streams_give_the_batch_result(spark, sf, tmp_path):
    from clipsift.plans import bridges
    from clipsift.streaming import events

    batch = bridges.feedback(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    batch.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = events.latest_by_clip(stream).writeStream.outputMode("complete").format("memory").queryName("latest").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {tuple(r) for r in spark.table("latest").collect()}
    assert got == {tuple(r) for r in events.latest_by_clip(batch).collect()}
