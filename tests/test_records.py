"""JSON sources and sinks."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from clipsift.sources import records, tracker


def test_jsonl(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": "x", "n": 1}\n\n[1, 2]\n{"id": "y", "n": "no"}\n{"id": "z"}\n')
    good, bad = records.read_jsonl(spark, str(tmp_path), "id string, n int")
    assert sorted((r.id, r.n) for r in good.collect()) == [("x", 1), ("z", None)]
    assert sorted(r.line for r in bad.collect()) == ["[1, 2]", '{"id": "y", "n": "no"}']


def test_documents_and_artifacts(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"v{k}.json").write_text(json.dumps({"video_id": f"v{k}", "words": [1] * k}, indent=1))
    assert {(r.video_id, len(r.words)) for r in records.read_documents(spark, str(tmp_path), "video_id string, words array<int>").collect()} == {("v0", 0), ("v1", 1), ("v2", 2)}
    at = tmp_path / "artifact"
    at.mkdir()
    (at / "a.json").write_text(json.dumps({"feature_schema": "s1", "records": [{"id": "a", "v": [1.0]}, {"id": "b", "v": [2.0]}]}))
    assert records.read_artifact(spark, str(at), "id:string,v:array<double>", "s1").count() == 2
    with pytest.raises(Exception, match="unexpected schema"):
        records.read_artifact(spark, str(at), "id:string,v:array<double>", "s2").collect()


def test_a_rewrite_replaces_and_leaves_nothing_beside(spark, tmp_path):
    path = str(tmp_path / "out")
    for n in (5, 2):
        records.write_whole(spark.range(n), path)
        assert spark.read.json(path).count() == n
    assert [p.name for p in tmp_path.iterdir()] == ["out"]


def test_the_manifest_ignores_how_rows_are_dealt(spark):
    df = spark.range(100).withColumn("v", F.col("id") * 2)
    one = records.export_manifest(df.repartition(1), "id").first()
    assert one == records.export_manifest(df.repartition(7), "id").first() and one.rows == 100
    assert one.sha256 != records.export_manifest(df.withColumn("v", F.when(F.col("id") == 5, 0).otherwise(F.col("v"))), "id").first().sha256


def test_tracker(spark):
    rows = spark.createDataFrame([("aa", "9"), ("aa_clip1", "1.2M"), ("bb_clip_2", "17k"), ("cc_clip3", "350"), ("zz_clip4", "1")], "video_id string, views string")
    got = {(r.video_id, r.source_key, r.role, r.views) for r in tracker.tracker_clips(rows, ["aa", "bb"], "cc").collect()}
    assert got == {("aa_clip1", "aa", "reference", 1_200_000), ("bb_clip_2", "bb", "reference", 17_000), ("cc_clip3", "cc", "holdout", 350)}


def test_rates_of_a_full_report(spark):
    from clipsift.operators.learning import outcome_components

    row = dict(creator=1, clip=1, views=200, engaged_views=100, average_view_percentage=80.0, chose_to_view_percentage=60.0, completion_rate_percentage=50.0, average_view_duration_seconds=90.0, duration_seconds=30.0, likes=10, comments=5)
    row |= dict(shares=4, saves=2, profile_visits=1, replays=20, reach=50, subscribers_gained=7, subscribers_lost=2, follows=3)
    df = spark.createDataFrame([row]).selectExpr("*", "CAST(NULL AS INT) AS subscribers_net")
    found = {r.component: round(r.value, 6) for r in outcome_components(df).collect()}
    assert found == {
        "average_view_percentage": 0.8, "chose_to_view_percentage": 0.6, "completion_rate_percentage": 0.5, "duration_fraction": 2.0, "likes_per_view": 0.1, "comments_per_view": 0.05, "shares_per_view": 0.04,
        "saves_per_view": 0.02, "profile_visits_per_view": 0.01, "replays_per_view": 0.2, "plays_per_reached_account": 2.0, "net_subscribers_per_view": 0.05, "follows_per_view": 0.03,
    }
    assert outcome_components(df.withColumn("views", F.lit(10)).withColumn("engaged_views", F.lit(0))).count() == 0


def test_candidate_texts_and_speech_gaps(spark):
    from clipsift.operators import boundaries, sequence

    said = [(1, i, i * 1.0, i * 1.0 + 0.5, w) for i, w in enumerate("One two three. Four five. Six seven eight nine.".split())]
    words = spark.createDataFrame(said, "video int, pos int, start double, end double, word string")
    units = sequence.unit_texts(sequence.sentence_units(words, pause=9.0), words)
    assert [r.text for r in units.orderBy("unit").collect()] == ["One two three.", "Four five.", "Six seven eight nine."]
    asked = spark.createDataFrame([("a", 1, 0, 1), ("b", 1, 1, 2)], "candidate_id string, video int, start_unit int, end_unit int")
    got = {r.candidate_id: (r.sentence_count, r.word_count, r.text) for r in sequence.candidate_texts(asked, units).collect()}
    assert got == {"a": (2, 5, "One two three. Four five."), "b": (2, 6, "Four five. Six seven eight nine.")}

    speech = spark.createDataFrame([(1, 0.0, 1.5), (1, 6.5, 7.0)], "video int, start double, end double")
    plain = {r.unit: r for r in boundaries.unit_options(units).collect()}
    heard = {r.unit: r for r in boundaries.unit_options(units, speech).collect()}
    # the second unit starts at 3.0, 1.5 s after speech was last heard; its end at 4.5 lies 2.0 s before the next
    assert round(heard[1].start_score - plain[1].start_score, 6) == round(0.7 * (1.0 - 0.5 / 1.5), 6)
    assert round(heard[1].end_score - plain[1].end_score, 6) == round(0.8 * (1.0 - 0.5 / 1.5), 6)
    assert heard[0].start_score == plain[0].start_score


def test_trends_weigh_topics(spark):
    from clipsift.operators.topics import topics

    docs = spark.createDataFrame([("c", 1, "kernel boot kernel boot"), ("c", 2, "garden garden soil")], "source string, doc_id int, text string")
    trends = spark.createDataFrame([("c", "garden", True), ("c", "soil", False)], "source string, term string, favoured boolean")
    bare = {r.term: r.score for r in topics(docs, "source", "doc_id", "text", 6).where("doc_id = 2").collect()}
    rated = {r.term: (r.score, r.favoured) for r in topics(docs, "source", "doc_id", "text", 6, trends).where("doc_id = 2").collect()}
    assert abs(rated["garden"][0] - 1.35 * bare["garden"]) < 2e-6 and rated["garden"][1] is True
    assert all(abs(s / bare[t] - {True: 1.35, False: 0.75, None: 1.0}[f]) < 1e-5 for t, (s, f) in rated.items() if t in bare)


def test_aligned_segments(spark):
    from clipsift.operators.alignment import aligned_segments, offset_clusters

    # the median follows the cluster: 4.5 is within 3 s of the median 1.5 of 0, 1.5 and 3, though not of its first offset
    assert offset_clusters(np.array([0.0, 1.5, 3.0, 4.5, 9.0])).tolist() == [0, 0, 0, 0, 1]
    rows = [("a", 0.0, 10.0, 100.0, 0.9, 500.0), ("a", 5.0, 15.0, 101.0, 0.7, 500.0), ("a", 20.0, 30.0, 300.0, 0.8, 500.0), ("a", 25.0, 35.0, 300.0, 0.6, 500.0), ("a", 40.0, 50.0, 7.0, 0.95, 500.0), ("a", 45.0, 55.0, 90.0, 0.2, 500.0)]
    rows += [("b", 0.0, 10.0, 5.0, 0.3, 50.0), ("c", 0.0, 10.0, 45.0, 0.5, 50.0)]
    df = spark.createDataFrame(rows, "short string, short_start double, short_end double, offset double, score double, source_length double")
    got = {(r.short, r.segment): r for r in aligned_segments(df, "short").collect()}
    assert set(got) == {("a", 1), ("a", 2), ("c", 1)}
    one, two, c = got["a", 1], got["a", 2], got["c", 1]
    assert (one.source_start, one.source_end, one.windows, one.compound) == (100.5, 115.5, 2, True)
    assert (two.source_start, two.source_end) == (320.0, 335.0)
    assert round(one.confidence, 6) == round(0.8 * (0.65 + 0.35 * 2 / 6), 6) and (c.source_end, c.compound) == (50.0, False)
    assert aligned_segments(df.where("score < 0"), "short").count() == 0
