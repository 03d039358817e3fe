"""Queries with order-dependent state, and windows over words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clipsift.functions.scalars import six, six_plain
from clipsift.operators import sequence
from clipsift.plans import bridges as b
from clipsift.plans.registry import query

#: Words lie 0.4 s apart inside a sentence, so a unit passes 15 s with its 38th word: the units in closed form, without a fold.
UNITS = """SELECT video, (row_number() OVER (PARTITION BY video ORDER BY s) - 1)::INT AS unit, s AS "start", e AS "end", n::INT AS words FROM (
  SELECT video, min("start") AS s, max("end") AS e, count(*) AS n FROM (SELECT *, (row_number() OVER (PARTITION BY video, sent ORDER BY pos) - 1) // 38 AS part FROM (
    SELECT *, coalesce(sum(regexp_matches(word, '{sentence_end!}')::INT) OVER (PARTITION BY video ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sent FROM {word_rows})) GROUP BY video, sent, part)"""


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = sequence.with_candidates(sequence.with_units(b.timed_texts(spark, sf_dir))).select("video", F.posexplode_outer("candidates").alias("n", "c")).where("c IS NOT NULL")
    number = (F.col("n") + 1).cast("string")
    four = F.when(F.length(number) < 4, F.lpad(number, 4, "0")).otherwise(number)
    return c.select(F.concat(F.coalesce(F.col("video").cast("string"), F.lit("null")), F.lit("_candidate_"), four).alias("candidate_id"), "c.*")


@query("seq01_sentence_units", 'SELECT video, unit, round("start", 6) AS "start", round("end", 6) AS "end", words FROM (' + UNITS + ")")
def seq01(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = sequence.with_units(b.timed_texts(spark, sf_dir)).select("video", F.posexplode_outer("units").alias("unit", "u")).where("u IS NOT NULL").select("video", "unit", "u.*")
    return u.select("video", "unit", six(F.col("start")).alias("start"), six(F.col("end")).alias("end"), "words")


@query("seq02_candidates", "WITH u AS (" + UNITS + """), p AS (SELECT s.video, s.unit AS su, e.unit AS eu, s."start" AS st, e."end" AS en FROM u s JOIN u e ON s.video = e.video AND e.unit >= s.unit AND e."end" - s."start" BETWEEN 20e0 AND 60e0),
  c AS (SELECT video, su, st, t, arg_min(en, (abs((en - st) - t), eu)) AS en FROM p, (SELECT unnest([20e0, 30e0, 45e0, 60e0]) AS t) GROUP BY ALL), d AS (SELECT DISTINCT video, st, en FROM c)
  SELECT printf('%d_candidate_%04d', video, row_number() OVER (PARTITION BY video ORDER BY st, en)) AS candidate_id, round(st, 6) AS "start", round(en, 6) AS "end", round(en - st, 6) AS duration FROM d""")
def seq02(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _candidates(spark, sf_dir)
    return c.select("candidate_id", six_plain(F.col("start")).alias("start"), six_plain(F.col("end")).alias("end"), six_plain(F.col("end") - F.col("start")).alias("duration"))


@query("seq03_candidate_text", "WITH u AS (SELECT *, coalesce(sum(words) OVER (PARTITION BY video ORDER BY unit ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM (" + UNITS + """)), ws AS (SELECT video, list(word ORDER BY pos) AS w FROM {word_rows} GROUP BY 1),
  p AS (SELECT s.video, s.unit AS su, e.unit AS eu, s."start" AS st, e."end" AS en, s.before AS a, e.before + e.words AS z FROM u s JOIN u e ON s.video = e.video AND e.unit >= s.unit AND e."end" - s."start" BETWEEN 20e0 AND 60e0),
  c AS (SELECT video, su, st, a, t, arg_min({'en': en, 'eu': eu, 'z': z}, (abs((en - st) - t), eu)) AS x FROM p, (SELECT unnest([20e0, 30e0, 45e0, 60e0]) AS t) GROUP BY ALL), d AS (SELECT DISTINCT video, st, su, a, x FROM c)
  SELECT printf('%d_candidate_%04d', video, row_number() OVER (PARTITION BY video ORDER BY st, x.en)) AS candidate_id, (x.eu - su + 1)::BIGINT AS sentence_count, (x.z - a)::BIGINT AS word_count, md5(array_to_string(w[a + 1:x.z], ' ')) AS text_md5 FROM d JOIN ws USING (video)""")
def seq03(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text and counts of each candidate, from the units between its boundaries; the digest stands for the text."""
    c = _candidates(spark, sf_dir)
    return c.select("candidate_id", (F.col("end_unit") - F.col("start_unit") + 1).cast("long").alias("sentence_count"), F.col("words").alias("word_count"), "text_md5")


@query("str19_caption_cues", """SELECT video, (row_number() OVER (PARTITION BY video ORDER BY s) - 1)::INT AS cue, round(s, 6) AS "start", round(e, 6) AS "end", n::INT AS words FROM (
  SELECT video, min("start") AS s, max("end") AS e, count(*) AS n FROM (SELECT *, (row_number() OVER (PARTITION BY video, sent ORDER BY pos) - 1) // 7 AS part FROM (
    SELECT *, coalesce(sum(regexp_matches(word, '{sentence_end!}')::INT) OVER (PARTITION BY video ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sent FROM {word_rows})) GROUP BY video, sent, part)""")
def str19(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven words take 2.75 s: a bound of 2.8 s leaves the count to decide here."""
    c = sequence.with_captions(b.timed_texts(spark, sf_dir), 7, 2.8).select("video", F.posexplode_outer("cues").alias("cue", "c")).where("c IS NOT NULL").select("video", "cue", "c.*")
    return c.select("video", "cue", six(F.col("start")).alias("start"), six(F.col("end")).alias("end"), "words")


@query("str19_timed_captions", """SELECT video, (row_number() OVER (PARTITION BY video ORDER BY s) - 1)::INT AS cue, round(s, 6) AS "start", round(e, 6) AS "end", n::INT AS words FROM (
  SELECT video, min("start") AS s, max("end") AS e, count(*) AS n FROM (SELECT *, (row_number() OVER (PARTITION BY video, sent ORDER BY pos) - 1) // CASE WHEN video % 2 = 0 THEN 6 ELSE 7 END AS part FROM (
    SELECT *, coalesce(sum(regexp_matches(word, '{sentence_end!}')::INT) OVER (PARTITION BY video ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sent FROM {word_rows})) GROUP BY video, sent, part)""")
def str19_timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Even videos are spoken slower, so that the sixth word passes the bound of 2.4 s; others twice as fast, so that the count of seven decides."""
    even = F.col("video") % 2 == 0
    pace = F.when(even, 1.2).otherwise(0.5)
    paced = F.transform("w", lambda x: F.struct((x["start"] * F.col("pace")).alias("start"), (x["end"] * F.col("pace")).alias("end"), x["word"].alias("word")))
    spoken = b.timed_texts(spark, sf_dir).withColumn("pace", pace).withColumn("w", paced)
    c = sequence.with_captions(spoken, 7, 2.4).select("video", "pace", F.posexplode_outer("cues").alias("cue", "c")).where("c IS NOT NULL").select("video", "pace", "cue", "c.*")
    return c.select("video", "cue", *[six(F.col(x) / F.col("pace")).alias(x) for x in ("start", "end")], "words")


@query("win08_word_gaps", """SELECT video, pos, round(greatest(0e0, coalesce("start" - lag("end") OVER w, 0e0)), 6) AS gap_before, round(greatest(0e0, coalesce(lead("start") OVER w - "end", 0e0)), 6) AS gap_after FROM {word_rows} WINDOW w AS (PARTITION BY video ORDER BY pos)""")
def win08(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("video").orderBy("pos")
    gap = lambda x: six(F.greatest(F.lit(0.0), F.coalesce(x, F.lit(0.0))))
    return b.word_rows(spark, sf_dir).select("video", "pos", gap(F.col("start") - F.lag("end").over(w)).alias("gap_before"), gap(F.lead("start").over(w) - F.col("end")).alias("gap_after"))


@query("win09_context_window", "SELECT video, pos, string_agg(word, ' ') OVER (PARTITION BY video ORDER BY pos ROWS BETWEEN 5 PRECEDING AND 6 FOLLOWING) AS context FROM {word_rows}")
def win09(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("video").orderBy("pos").rowsBetween(-5, 6)
    return b.word_rows(spark, sf_dir).select("video", "pos", F.array_join(F.collect_list("word").over(w), " ").alias("context"))


@query("win12_silence_runs", """SELECT creator, count(*) AS runs, max(n) AS longest FROM (SELECT creator, k, count(*) AS n FROM (SELECT creator, quiet, event_id, row_number() OVER (PARTITION BY creator ORDER BY event_id) - row_number() OVER (PARTITION BY creator, quiet ORDER BY event_id) AS k FROM (SELECT *, value < 20 AS quiet FROM {feedback})) WHERE quiet GROUP BY 1, 2) GROUP BY 1""")
def win12(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("creator").orderBy("event_id")
    e = b.feedback(spark, sf_dir).select("creator", "event_id", (F.col("value") < 20).alias("quiet"))
    e = e.withColumn("new", (F.coalesce(F.lag("quiet").over(w) != F.col("quiet"), F.lit(True))).cast("int")).withColumn("run", F.sum("new").over(w))
    runs = e.where("quiet").groupBy("creator", "run").agg(F.count(F.lit(1)).alias("n"))
    return runs.groupBy("creator").agg(F.count(F.lit(1)).alias("runs"), F.max("n").alias("longest"))


EVENTS = "CASE event_type WHEN 'presented' THEN 'enqueue' WHEN 'download_original' THEN 'claim' WHEN 'download_edited' THEN 'complete' WHEN 'reject' THEN 'fail' ELSE 'expire' END"


@query("seq09_job_replay", f"""WITH RECURSIVE o AS (SELECT creator AS job, {EVENTS} AS e, row_number() OVER (PARTITION BY creator ORDER BY event_id) AS i FROM {{feedback}}),
  w AS (SELECT job, 0::BIGINT AS i, 'new' AS status, 0 AS attempts FROM o GROUP BY 1 UNION ALL SELECT w.job, o.i,
    CASE WHEN e = 'enqueue' THEN 'queued' WHEN e = 'claim' AND status = 'queued' THEN 'running' WHEN status = 'running' AND e IN ('expire', 'fail') THEN CASE WHEN attempts >= 3 THEN 'failed' ELSE 'queued' END WHEN status = 'running' AND e = 'complete' THEN 'complete' ELSE status END,
    CASE WHEN e = 'enqueue' THEN 0 WHEN e = 'claim' AND status = 'queued' THEN attempts + 1 ELSE attempts END FROM w JOIN o ON o.job = w.job AND o.i = w.i + 1)
  SELECT job, arg_max(status, i) AS status, arg_max(attempts, i) AS attempts FROM w GROUP BY 1""")
def seq09(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_type")
    event = F.when(e == "presented", "enqueue").when(e == "download_original", "claim").when(e == "download_edited", "complete").when(e == "reject", "fail").otherwise("expire")
    return sequence.replay_jobs(b.feedback(spark, sf_dir).select(F.col("creator").alias("job"), F.col("event_id").alias("seq"), event.alias("event")))


@query("seq19_status_rollup", "SELECT creator, bool_and(event_type <> 'reject') AS ready, count(*) FILTER (event_type = 'reject') AS pending FROM (SELECT creator, clip, arg_max(event_type, event_id) AS event_type FROM {feedback} GROUP BY 1, 2) GROUP BY 1")
def seq19(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = b.feedback(spark, sf_dir).groupBy("creator", "clip").agg(F.max_by("event_type", "event_id").alias("e"))
    return last.groupBy("creator").agg(F.bool_and(F.col("e") != "reject").alias("ready"), F.count_if(F.col("e") == "reject").alias("pending"))


@query("dat02_backoff", "SELECT event_id, round(least(60e0, pow(2e0, display_rank - 1)), 6) AS seconds FROM {feedback} WHERE event_type = 'reject'")
def dat02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.feedback(spark, sf_dir).where("event_type = 'reject'").select("event_id", six(sequence.backoff_seconds(F.col("display_rank"))).alias("seconds"))


@query("dat01_not_expired", "SELECT creator, count(*) AS live FROM {feedback} WHERE ts + INTERVAL 120 SECOND > TIMESTAMP '2024-01-05 00:00:00' AND ts <= TIMESTAMP '2024-01-06 00:00:00' GROUP BY 1")
def dat01(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.col("ts").cast("timestamp_ntz")
    live = (at + F.expr("INTERVAL 120 SECONDS") > F.lit("2024-01-05 00:00:00").cast("timestamp_ntz")) & (at <= F.lit("2024-01-06 00:00:00").cast("timestamp_ntz"))
    return b.feedback(spark, sf_dir).where(live).groupBy("creator").agg(F.count(F.lit(1)).alias("live"))


@query("prj01_flatten", "SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn, p) - 1)::INT AS pos, word FROM (SELECT conv_id, turn, unnest(w) AS word, unnest(range(len(w))) AS p FROM (SELECT conv_id, turn, list_filter(string_split(text, ' '), lambda x: x <> '') AS w FROM {segments}))")
def prj01(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments to words, numbered through a conversation."""
    s = b.segments(spark, sf_dir).select("conv_id", "turn", F.posexplode(F.filter(F.split("text", " "), lambda w: w != "")).alias("p", "word"))
    return s.select("conv_id", (F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "p")) - 1).alias("pos"), "word")


@query("top10_slot_sampling")
def top10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from clipsift.operators.sampling import slot_samples

    c = b.clips(spark, sf_dir).select("video", "clip", "start", "end", "score")
    return slot_samples(c, "video", "clip", slots=3, seed=42)


@query("ml14_alignment")
def ml14(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Templates start at a hashed place. Even creators look for their own, scaled and shifted; odd ones for that of the odd creator
    after them, which their signal doesn't hold, so the place is open and the score low."""
    from clipsift.operators.alignment import align

    order = Window.partitionBy("creator").orderBy("event_id", "value")
    points = b.feedback(spark, sf_dir).select("creator", (F.row_number().over(order) - 1).cast("long").alias("pos"), "value")
    part = F.array_sort(F.collect_list(F.struct("pos", "value")))
    start = F.pmod(F.xxhash64("creator"), F.lit(24))
    cut = points.where((F.col("pos") >= start) & (F.col("pos") < start + 16)).groupBy("creator").agg(F.transform(part, lambda x: x["value"]).alias("template"))
    odd = F.col("creator") % 2 == 1
    templates = cut.select(F.when(odd, F.col("creator") - 2).otherwise(F.col("creator")).alias("creator"), F.when(odd, F.col("template")).otherwise(F.transform("template", lambda x: 3.0 * x + 7.0)).alias("template"))
    return align(points, templates, "creator", longest=16)


@query("ml15_aligned_segments")
def ml15(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offsets of the windows of an order's lines, clustered into the segments of its source; medians run, so SQL has no short form."""
    from clipsift.operators.alignment import aligned_segments

    l = b.table(spark, sf_dir, "lineitem")
    at = (F.col("l_linenumber") - 1) * 6.0
    matches = l.select(F.col("l_orderkey").alias("short"), at.alias("short_start"), (at + 10.0).alias("short_end"), (F.col("l_suppkey") % 9 * 1.5).alias("offset"), (0.3 + F.col("l_discount") * 6.0).alias("score"), F.lit(60.0).alias("source_length"))
    r = aligned_segments(matches, "short")
    return r.select("short", "segment", "short_start", "short_end", six(F.col("source_start")).alias("source_start"), six(F.col("source_end")).alias("source_end"), six(F.col("score")).alias("score"), "windows", six(F.col("confidence")).alias("confidence"), "compound")
