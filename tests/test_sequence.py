"""Order-dependent operators against plain loops."""

import random

from clipsift.functions.text import SENTENCE_END
from clipsift.operators import sequence
from clipsift.operators.ranking import positions


def _words(seed):
    """Texts with pauses of every size, long runs without a sentence end, and one of a single word."""
    import re

    r, rows = random.Random(seed), []
    for video in range(6):
        t = 0.0
        for pos in range([1, 40, 200, 3, 90, 60][video]):
            long = r.choice([0.2, 0.4, 0.9, 3.0])
            word = "w" + ("." if r.random() < (0.02 if video == 2 else 0.15) else "")
            rows.append((video, pos, round(t, 3), round(t + long, 3), word))
            t += long + r.choice([0.0, 0.1, 0.6, 1.5, 4.0])
    return rows, lambda w: re.search(SENTENCE_END, w) is not None


def _loop(rows, stops):
    out, video = {}, None
    for k, (v, _, s, e, w) in enumerate(rows):
        if v != video:
            video, start, n = v, None, 0
        start, n = s if start is None else start, n + 1
        following = rows[k + 1] if k + 1 < len(rows) and rows[k + 1][0] == v else None
        if stops(w, e - start, n, following[2] - e if following else None):
            out.setdefault(v, []).append((start, e, n))
            start, n = None, 0
    return out


def _found(df, number):
    out = {}
    for r in df.orderBy("video", number).collect():
        assert r[number] == len(out.setdefault(r.video, []))
        out[r.video].append((r.start, r.end, r.words))
    return out


def test_units_and_captions_of_loose_speech(spark):
    rows, ends = _words(7)
    df = spark.createDataFrame(rows, "video int, pos int, start double, end double, word string").repartition(5)
    assert _found(sequence.sentence_units(df), "unit") == _loop(rows, lambda w, long, n, gap: ends(w) or gap is None or (gap >= 1.0 and long >= 2.0) or long >= 15.0)
    assert _found(sequence.captions(df), "cue") == _loop(rows, lambda w, long, n, gap: ends(w) or gap is None or n >= 7 or long >= 2.4)
    assert sequence.sentence_units(df.where("false")).count() == sequence.captions(df.where("false")).count() == 0


def test_job_states_are_those_of_a_loop(spark):
    r = random.Random(11)
    names = ["enqueue", "claim", "claim", "expire", "fail", "complete", "heartbeat"]
    logs = {j: [r.choice(names if j % 3 else [n for n in names if n != "complete"]) for _ in range(r.randrange(1, 25))] for j in range(200)}
    logs |= {j: ["enqueue", *logs[j - 200][1:]] for j in range(200, 400)}
    expected = {}
    for j, events in logs.items():
        status, n = "new", 0
        for e in events:
            if e == "enqueue":
                status, n = "queued", 0
            elif e == "claim" and status == "queued":
                status, n = "running", n + 1
            elif status == "running" and e in ("expire", "fail"):
                status = "queued" if n < 3 else "failed"
            elif status == "running" and e == "complete":
                status = "complete"
        expected[j] = (status, n)
    df = spark.createDataFrame([(j, k, e) for j, events in logs.items() for k, e in enumerate(events)], "job int, seq int, event string").repartition(7)
    assert {x.job: (x.status, x.attempts) for x in sequence.replay_jobs(df).collect()} == expected
    assert {s for s, _ in expected.values()} == {"new", "queued", "running", "failed", "complete"}


def test_positions_count_over_blocks(spark):
    rows = [("a" if k % 3 else None, k * 5) for k in range(300)] + [("b", None), ("b", -7), ("b", 2)]
    got = {(x.g, x.k): x.position for x in positions(spark.createDataFrame(rows, "g string, k int").repartition(6), ["g"], "k", width=64).collect()}
    for g in ("a", None, "b"):
        own = sorted((k for s, k in rows if s == g), key=lambda k: (k is not None, k))
        assert [got[g, k] for k in own] == list(range(1, len(own) + 1))
