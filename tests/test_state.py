"""Guarded updates, leases, snapshots and corrections against loops, restarts, races and full recomputation."""

import datetime as dt
import math
import random
import time
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from clipsift.operators import reveal, transitions
from clipsift.sources import snapshots
from clipsift.streaming import leases


# --- guarded updates


@pytest.mark.parametrize("machine", [transitions.ACTUAL_CLIP, transitions.SOURCE])
def test_replay_equals_a_loop(spark, machine):
    """One key has most events, over many blocks; unknown kinds, negative orders, null keys."""
    r, kinds = random.Random(7), sorted({k for k, _ in machine.moves}) + ["other", None]
    rows = [(r.choice([1, 1, 1, 2, 3, None]), i * 3 - 500, r.choice(kinds)) for i in range(1500)]
    expected, state = [], {}
    for k, at, kind in rows:
        if k is not None:
            now = state.get(k, machine.states[0])
            fits = (kind, now) in machine.moves
            state[k] = machine.moves[kind, now] if fits else now
            expected.append((k, at, kind, fits, state[k]))
    log = transitions.replay(spark.createDataFrame(rows, "clip int, seq long, kind string").repartition(6), "clip", "seq", "kind", machine, width=64)
    assert sorted(map(tuple, log.collect())) == sorted(expected, key=lambda x: x[:2])
    final = {r.clip: (r.state, r.refused) for r in transitions.final_states(log, "clip", "seq").collect()}
    assert final == {k: (state[k], sum(e[0] == k and not e[3] for e in expected)) for k in state}
    assert transitions.replay(spark.createDataFrame([], "clip int, seq long, kind string"), "clip", "seq", "kind", machine).count() == 0


def test_preconditions(spark):
    """A second upload, an alignment before the upload and one after the clip is aligned are refused; corrections aren't once it is there."""
    moves = ["align", "upload", "upload", "doubt", "align", "align", "correct", "correct", "doubt"]
    df = spark.createDataFrame([("a", i, m) for i, m in enumerate(moves)], "clip string, seq int, kind string")
    got = transitions.replay(df, "clip", "seq", "kind", transitions.ACTUAL_CLIP).orderBy("seq").collect()
    assert [r.accepted for r in got] == [False, True, False, True, True, False, True, True, False]
    assert [r.state for r in got] == ["awaiting_upload", "uploaded", "uploaded", "needs_review", "aligned", "aligned", *["manually_aligned"] * 3]


# --- leases and sessions

EVENTS = "job long, seq long, ts timestamp, event string"
START = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def rocks(spark):
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    own.conf.set("spark.sql.shuffle.partitions", "3")
    return own


def streamed(session, at, schema, changes):
    """Reads what files are there, one a batch, and stops; called again it goes on from its checkpoint."""
    rows = changes(session.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/in"))
    rows.writeStream.format("parquet").option("checkpointLocation", f"{at}/checkpoint").option("path", f"{at}/out").trigger(availableNow=True).start().awaitTermination()
    return session.read.schema(rows.schema).parquet(f"{at}/out")


def test_streamed_leases_equal_the_replay(rocks, tmp_path):
    """Late heartbeats, lapses by timers and by later events, and a restart from the checkpoint half-way."""
    r = random.Random(2)
    rows = [(r.randrange(12), i, START + dt.timedelta(seconds=i * 6), r.choice(["enqueue", "claim", "claim", "heartbeat", "heartbeat", "complete", "fail"])) for i in range(900)]
    for part in range(2):
        for k in range(2):
            rocks.createDataFrame(rows[part * 450 + k * 225 :][:225], EVENTS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            time.sleep(0.05)
        done = rows[: 450 * (part + 1)]
        changes = streamed(rocks, tmp_path, EVENTS, leases.lease_changes)
        expected = sorted(map(tuple, leases.replay_leases(rocks.createDataFrame(done, EVENTS), done[-1][2]).where("status <> 'new'").collect()))
        assert sorted(map(tuple, leases.lease_states(changes).collect())) == expected
    assert {s for _, s, _ in expected} >= {"running", "queued"} and changes.select("job", "n").distinct().count() == changes.count()


def test_lapses_are_exact():
    lease, at = 120 * leases.MICRO, lambda s: s * leases.MICRO
    state = ("new", 0, None)
    for seconds, event, expected in [
        (0, "heartbeat", ("new", 0, None)), (1, "enqueue", ("queued", 0, None)), (10, "claim", ("running", 1, at(130))), (50, "claim", ("running", 1, at(130))), (100, "heartbeat", ("running", 1, at(220))),
        (220, "heartbeat", ("queued", 1, None)), (230, "complete", ("queued", 1, None)), (231, "claim", ("running", 2, at(351))), (300, "fail", ("queued", 2, None)), (301, "claim", ("running", 3, at(421))), (500, "complete", ("failed", 3, None)),
        (501, "claim", ("failed", 3, None)), (502, "enqueue", ("queued", 0, None)), (503, "claim", ("running", 1, at(623))), (600, "complete", ("complete", 1, None)), (700, "heartbeat", ("complete", 1, None)),
    ]:
        for _, state in leases.passed(state, event, at(seconds), lease, 3):
            pass
        assert state == expected, (seconds, event)


def test_streamed_sessions_equal_the_replay(rocks, tmp_path):
    r, schema = random.Random(3), "account long, token long, ts timestamp, event string"
    rows = []
    for i in range(300):
        account = r.randrange(5)
        rows.append((account, account * 100 + r.randrange(6), START + dt.timedelta(seconds=i * 40), r.choice(["login", "login", "logout", "other"])))
    for k in range(3):
        rocks.createDataFrame(rows[k * 100 : (k + 1) * 100], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        time.sleep(0.05)
    changes = streamed(rocks, tmp_path, schema, lambda e: leases.session_changes(e, 3600)).collect()
    live = {(c.account, c.token): 0 for c in changes}
    for c in sorted(changes, key=lambda c: (c.at, {"expired": 0, "opened": 1, "closed": 2}[c.change])):
        live[c.account, c.token] = c.at + 3600 * leases.MICRO if c.change == "opened" else 0
    expected = {(r.account, r.token): r.until for r in leases.replay_sessions(rocks.createDataFrame(rows, schema), rows[-1][2], 3600).collect()}
    assert {k: v for k, v in live.items() if v} == expected and 0 < len(expected) < len(live)


# --- snapshots


def scores(spark, n=50):
    return spark.range(n).select("id", (F.col("id") / 7.0).alias("score"), F.concat(F.lit("c"), "id").alias("clip")).repartition(3)


def test_a_snapshot_is_frozen_once(spark, tmp_path):
    root = str(tmp_path)
    held = snapshots.freeze(scores(spark), root, "s", ["score"], {"release": 7})
    assert held["count"] == 50 and snapshots.read_manifest(spark, root, "s") == held and held["about"] == {"release": 7}
    assert sorted(map(tuple, snapshots.read_frozen(spark, root, "s").collect())) == sorted(map(tuple, scores(spark).collect()))
    with pytest.raises(snapshots.FrozenError):
        snapshots.freeze(scores(spark, 9), root, "s")
    assert [p.name for p in (tmp_path / "s").glob("rows-*")] == [held["rows"]]
    assert snapshots.freeze(scores(spark).repartition(7), root, "t")["sha256"] == held["sha256"] != snapshots.freeze(scores(spark, 49), root, "u")["sha256"]


def test_changed_snapshots_are_found(spark, tmp_path):
    root = str(tmp_path)
    held = snapshots.freeze(scores(spark), root, "s")
    scores(spark, 1).write.mode("append").parquet(f"{root}/s/{held['rows']}")
    with pytest.raises(snapshots.ContractError, match="51 rows, 50 frozen"):
        snapshots.read_frozen(spark, root, "s")
    held = snapshots.freeze(scores(spark), root, "t")
    scores(spark).withColumn("score", F.col("score") + 1e-9).write.mode("overwrite").parquet(f"{root}/t/{held['rows']}")
    with pytest.raises(snapshots.ContractError):
        snapshots.read_frozen(spark, root, "t")


def test_racing_writers_give_one_winner(spark, tmp_path):
    def attempt(k):
        try:
            return snapshots.freeze(scores(spark, 10 + k), str(tmp_path), "s")
        except snapshots.FrozenError:
            return None

    with ThreadPoolExecutor(4) as pool:
        won = [h for h in pool.map(attempt, range(4)) if h]
    assert len(won) == 1 and snapshots.read_frozen(spark, str(tmp_path), "s").count() == won[0]["count"]
    assert len(list((tmp_path / "s").iterdir())) <= 3  # rows of the winner, manifest, its checksum


def test_scores_that_are_not_finite_are_refused(spark, tmp_path):
    bad = scores(spark).withColumn("score", F.when(F.col("id") == 3, float("nan")).when(F.col("id") == 4, float("inf")).when(F.col("id") != 5, F.col("score")))
    with pytest.raises(snapshots.ContractError, match="'score': 3"):
        snapshots.freeze(bad, str(tmp_path), "s", ["score"])
    assert not list((tmp_path / "s").glob("rows-*")) and snapshots.freeze(bad, str(tmp_path), "s")["count"] == 50
    seen = snapshots.observed_write(bad, str(tmp_path / "w"), ["score"], {"score": (1.0, 5.0)})
    assert (seen["written"], seen["not_finite_score"], seen["outside_score"]) == (50, 3, sum(not 1 <= i / 7 <= 5 for i in range(50) if i not in (3, 4, 5)))


def test_contracts_name_every_difference():
    expected = {"schema": "v1", "policy": {"fit": False}, "model": {"fields": ("a", "b"), "targets": ["q"]}, "dimension": int}
    good = {"schema": "v1", "policy": {"fit": False, "more": 1}, "model": {"fields": ["a", "b"], "targets": ["q"]}, "dimension": 3}
    snapshots.check_contract(good, expected)
    for bad, words in [
        (good | {"schema": "v2", "dimension": True}, ["schema is 'v2'", "dimension is True"]),
        (good | {"policy": {"fit": 0}}, ["policy.fit is 0"]),
        (good | {"model": {"fields": ["b", "a"]}}, ["model.fields differs", "model.targets differs"]),
        ({}, ["schema is None", "policy.fit is None", "model.fields differs", "dimension is None"]),
    ]:
        with pytest.raises(snapshots.ContractError) as error:
            snapshots.check_contract(bad, expected)
        assert all(w in str(error.value) for w in words)


# --- reveal and corrections


def slow_matches(predictions, actuals):
    """(experiment, rank) -> (actual, overlap) by taking the best pairs first."""
    out = {}
    for x in {p[0] for p in predictions}:
        pairs = []
        for _, rank, _, s, e, _ in (p for p in predictions if p[0] == x):
            for _, a, segments, _ in (a for a in actuals if a[0] == x and a[2]):
                pairs.append((max(max(0.0, min(e, h) - max(s, g)) / (max(e, h) - min(s, g)) for g, h in segments), rank, a))
        used = set()
        for v, rank, a in sorted(pairs, reverse=True):
            if v >= 0.1 and (x, rank) not in out and a not in used:
                out[x, rank] = (a, round(v, 4))
                used.add(a)
    return out


PREDICTIONS = "experiment long, rank int, clip string, start double, end double, estimate double"
ACTUALS = "experiment long, actual int, segments array<struct<start:double,end:double>>, performance double"


def test_refreshed_corrections_equal_a_full_evaluation(spark):
    r = random.Random(11)
    predictions = [(x, k, f"{x}-{k}", s := float(r.randrange(200)), s + 20.0 + k, float(r.randrange(100))) for x in range(20) for k in range(1, 6)]
    place = lambda: (lambda s: (s, s + r.choice([10.0, 25.0, 40.0])))(float(r.randrange(200)))
    actuals = [(x, a, r.choice([None, [], [place()], [place()], [place(), place()]]), float(r.randrange(50))) for x in range(20) for a in range(4)]
    corrections = [(r.randrange(22), r.randrange(4), seq, s := float(r.randrange(-20, 230)), s + r.choice([-5.0, 0.0, 15.0, 30.0]), 230.0) for seq in range(25)]
    p, a = spark.createDataFrame(predictions, PREDICTIONS), spark.createDataFrame(actuals, ACTUALS)
    first = reveal.evaluate(p, a)
    assert {(m.experiment, m.rank): (m.actual, m.iou) for m in first.collect() if m.actual is not None} == slow_matches(predictions, actuals)
    after, changed, refused = reveal.corrected(a, spark.createDataFrame(corrections, "experiment long, actual int, seq int, start double, end double, duration double"))
    held, moved, bad = {(x, k): s for x, k, s, _ in actuals}, set(), 0
    for x, k, _, s, e, d in corrections:
        if (x, k) in held and 0 <= s < e <= d:
            held[x, k] = [(s, e)]
            moved.add(x)
        else:
            bad += 1
    assert refused.count() == bad > 0 and {r.experiment for r in changed.collect()} == moved and 0 < len(moved) < 20
    got = reveal.refreshed(first, p, after, changed)
    assert sorted(map(str, got.collect())) == sorted(map(str, reveal.evaluate(p, after).collect()))
    now = [(x, k, held[x, k], y) for x, k, _, y in actuals]
    assert {(m.experiment, m.rank): (m.actual, m.iou) for m in got.collect() if m.actual is not None} == slow_matches(predictions, now)
    again, none, _ = reveal.corrected(after, spark.createDataFrame([(x, k, 1, *held[x, k][0], 230.0) for x, k, *_ in corrections if held.get((x, k)) and len(held[x, k]) == 1], "experiment long, actual int, seq int, start double, end double, duration double"))
    assert none.count() == 0 and sorted(map(str, again.collect())) == sorted(map(str, after.collect()))
    for s in reveal.summary(got, after).collect():
        mine = [m for m in got.collect() if m.experiment == s.experiment] if s.experiment < 3 else None
        if mine:
            known = sum(bool(held[s.experiment, k]) for k in range(4))
            assert (s.predictions, s.clips, s.aligned) == (5, 4, known) and math.isclose(s.mean_iou, sum(m.iou for m in mine) / 5, abs_tol=1e-6)
            assert s.recall == (round(len({m.actual for m in mine if m.recovered}) / known, 4) if known else None)
