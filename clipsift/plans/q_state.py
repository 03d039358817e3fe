"""Queries of guarded updates, leases, frozen snapshots and corrections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clipsift.operators import ranking, reveal, transitions
from clipsift.plans import bridges as b
from clipsift.plans.registry import query
from clipsift.sources import snapshots
from clipsift.streaming import leases

_UPDATES = "CASE event_type WHEN 'presented' THEN 'upload' WHEN 'download_original' THEN 'align' WHEN 'download_edited' THEN 'doubt' WHEN 'reject' THEN 'correct' ELSE 'comment' END"
_GUARDED = f"""WITH RECURSIVE o AS (SELECT clip, event_id, {_UPDATES} AS kind, row_number() OVER (PARTITION BY clip ORDER BY event_id) AS i FROM {{feedback}}),
  w AS (SELECT clip, 0::BIGINT AS i, NULL::BIGINT AS event_id, NULL::VARCHAR AS kind, NULL::BOOLEAN AS accepted, 'awaiting_upload' AS state FROM o GROUP BY 1
    UNION ALL SELECT o.clip, o.i, o.event_id, o.kind, (o.kind = 'upload' AND state = 'awaiting_upload') OR (o.kind IN ('align', 'doubt') AND state IN ('uploaded', 'needs_review')) OR (o.kind = 'correct' AND state <> 'awaiting_upload'),
      CASE WHEN o.kind = 'upload' AND state = 'awaiting_upload' THEN 'uploaded' WHEN o.kind = 'align' AND state IN ('uploaded', 'needs_review') THEN 'aligned' WHEN o.kind = 'doubt' AND state IN ('uploaded', 'needs_review') THEN 'needs_review'
        WHEN o.kind = 'correct' AND state <> 'awaiting_upload' THEN 'manually_aligned' ELSE state END FROM w JOIN o ON o.clip = w.clip AND o.i = w.i + 1)"""


def _updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_type")
    kind = F.when(e == "presented", "upload").when(e == "download_original", "align").when(e == "download_edited", "doubt").when(e == "reject", "correct").otherwise("comment")
    return transitions.replay(b.feedback(spark, sf_dir).select("clip", "event_id", kind.alias("kind")), "clip", "event_id", "kind", transitions.ACTUAL_CLIP, width=1 << 12)


@query("oth11_guarded_updates", f"{_GUARDED} SELECT clip, event_id, kind, accepted, state FROM w WHERE i > 0")
def oth11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _updates(spark, sf_dir)


@query("oth12_pending", f"{_GUARDED} SELECT clip, state, refused FROM (SELECT clip, arg_max(state, i) AS state, count(*) FILTER (i > 0 AND NOT accepted) AS refused FROM w GROUP BY 1) WHERE state IN ('uploaded', 'needs_review')")
def oth12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revealed clips that wait for alignment after their log, with the updates that were refused on the way."""
    last = transitions.final_states(_updates(spark, sf_dir), "clip", "event_id")
    return last.where(transitions.pending(F.col("state")))


def _streamed(spark: SparkSession, source: str, changes) -> DataFrame:
    """Rows that a stream over the files of ``source`` has given when all of them are read."""
    own = spark.newSession()  # the state store is this stream's choice alone
    own.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    own.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    at = snapshots.scratch(spark)
    rows = changes(own.readStream.schema(spark.read.parquet(source).schema).parquet(f"{source}*"))
    rows.writeStream.format("parquet").option("checkpointLocation", f"{at}/checkpoint").option("path", f"{at}/rows").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{at}/rows")


def _kinds(**names: str) -> Column:
    return F.coalesce(*[F.when(F.col("event_type") == old, new) for old, new in names.items()], F.lit("other"))


_LEASE = 6 * 3600


@query("stm02_leases", f"""WITH RECURSIVE o AS (SELECT user_id AS job, CASE event_type WHEN 'view' THEN 'enqueue' WHEN 'click' THEN 'claim' WHEN 'purchase' THEN 'complete' WHEN 'signup' THEN 'heartbeat' ELSE 'fail' END AS e, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
  w AS (SELECT job, 0::BIGINT AS i, 'new' AS status, 0 AS n, NULL::BIGINT AS until FROM o GROUP BY 1 UNION ALL SELECT job, i,
    CASE WHEN e = 'enqueue' THEN 'queued' WHEN e = 'claim' AND now = 'queued' THEN 'running' WHEN e = 'complete' AND now = 'running' THEN 'complete' WHEN e = 'fail' AND now = 'running' THEN CASE WHEN n >= 3 THEN 'failed' ELSE 'queued' END ELSE now END,
    CASE WHEN e = 'enqueue' THEN 0 WHEN e = 'claim' AND now = 'queued' THEN n + 1 ELSE n END,
    CASE WHEN (e = 'claim' AND now = 'queued') OR (e = 'heartbeat' AND now = 'running') THEN t + {_LEASE}000000 WHEN now = 'running' AND e NOT IN ('enqueue', 'complete', 'fail') THEN until END
    FROM (SELECT o.job, o.i, o.e, o.t, w.n, w.until, CASE WHEN w.until <= o.t THEN CASE WHEN w.n >= 3 THEN 'failed' ELSE 'queued' END ELSE w.status END AS now FROM w JOIN o ON o.job = w.job AND o.i = w.i + 1))
  SELECT job, CASE WHEN until <= (SELECT max(t) FROM o) THEN CASE WHEN n >= 3 THEN 'failed' ELSE 'queued' END ELSE status END AS status, n AS attempts FROM (SELECT job, arg_max(status, i) AS status, arg_max(n, i) AS n, arg_max(struct_pack(u := until), i).u AS until FROM w GROUP BY 1)
  WHERE status <> 'new'""")
def stm02(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs after a stream of their events: leases that no heartbeat renewed end by timers."""
    event = _kinds(view="enqueue", click="claim", purchase="complete", signup="heartbeat")
    event = F.when(event == "other", "fail").otherwise(event)
    rows = _streamed(spark, f"{sf_dir}/events.parquet", lambda e: leases.lease_changes(e.select(F.col("user_id").cast("long").alias("job"), F.col("event_id").cast("long").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), event.alias("event")), _LEASE))
    return leases.lease_states(rows)


@query("stm06_sessions", """SELECT account, token, epoch_us(ts) + 86400000000 AS until FROM (SELECT user_id AS account, user_id * 10 + event_id % 10 AS token, ts, event_type, row_number() OVER (PARTITION BY user_id, user_id * 10 + event_id % 10 ORDER BY ts DESC, event_type = 'error' DESC) AS r, max(ts) OVER () AS now FROM events WHERE event_type IN ('view', 'error'))
  WHERE r = 1 AND event_type = 'view' AND epoch_us(ts) + 86400000000 > (SELECT epoch_us(max(ts)) FROM events)""")
def stm06(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions that are live after a stream of logins and logouts; those whose day is over are purged by later writes and timers."""
    token = (F.col("user_id") * 10 + F.col("event_id") % 10).cast("long")
    event = F.when(F.col("event_type") == "view", "login").when(F.col("event_type") == "error", "logout").otherwise("other")
    rows = _streamed(spark, f"{sf_dir}/events.parquet", lambda e: leases.session_changes(e.select(F.col("user_id").cast("long").alias("account"), token.alias("token"), F.col("ts").cast("timestamp").alias("ts"), event.alias("event")), 86400))
    last = rows.groupBy("account", "token").agg(F.max_by(F.struct("at", "change"), F.struct("at", F.when(F.col("change") == "expired", 0).when(F.col("change") == "opened", 1).otherwise(2))).alias("l"))
    return last.where("l.change = 'opened'").select("account", "token", (F.col("l.at") + 86400 * leases.MICRO).alias("until"))


_RECOMMENDED = """SELECT video, rank::INT AS rank, clip, "start", "end", round(100e0 / (1e0 + exp(-((score - avg(score) OVER v) / greatest(stddev_pop(score) OVER v, 1e-6)))), 2) AS estimate
  FROM (SELECT *, row_number() OVER (PARTITION BY video ORDER BY score DESC, clip) AS rank FROM {clips}) WHERE rank <= 3 WINDOW v AS (PARTITION BY video)"""


def _recommended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best clips of each video with their relative estimates."""
    top = ranking.top_k(b.clips(spark, sf_dir).select("video", "clip", "start", "end", "score"), ["video"], [F.desc("score"), F.col("clip")], 3)
    v = Window.partitionBy("video")
    z = (F.col("score") - F.avg("score").over(v)) / F.greatest(F.stddev_pop("score").over(v), F.lit(1e-6))
    return top.select("video", F.col("rank").cast("int").alias("rank"), "clip", "start", "end", F.round(100.0 / (1.0 + F.exp(-z)), 2).alias("estimate"))


@query("seq14_prediction_freeze", _RECOMMENDED)
def seq14(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recommendations as they were frozen: written once, read back against the digest of their content."""
    root = snapshots.scratch(spark)
    snapshots.freeze(_recommended(spark, sf_dir), root, "recommendations", ["start", "end", "estimate"], {"source": "clips"})
    return snapshots.read_frozen(spark, root, "recommendations")


@query("oth05_observed_write", """SELECT count(*) AS written, count(*) FILTER (challenger = 0) AS not_finite, count(*) FILTER (challenger <> 0 AND predicted / challenger NOT BETWEEN 0.2e0 AND 5e0) AS outside FROM {judged}""")
def oth05(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the pass that writes scored rows saw of them: scores that aren't finite, and such outside their range."""
    scored = b.judged(spark, sf_dir).withColumn("ratio", F.try_divide("predicted", "challenger"))
    seen = snapshots.observed_write(scored, snapshots.scratch(spark), ["ratio"], {"ratio": (0.2, 5.0)})
    return spark.createDataFrame([(seen["written"], seen["not_finite_ratio"], seen["outside_ratio"])], "written long, not_finite long, outside long")


_ACTUALS = """SELECT video, act, CASE WHEN video % 4 = 0 AND act = 1 AND s + 75e0 <= 400e0 THEN s + 45e0 WHEN video % 4 = 1 AND act = 0 THEN s + 2.5e0 ELSE s END AS s, s AS s0, act + video % 7 AS performance
  FROM (SELECT video, act, "start" + 40e0 * act AS s FROM {labels_iv}, (SELECT unnest([0, 1]) AS act))"""
_REVEALED = f"""WITH RECURSIVE r AS ({_RECOMMENDED}), a AS ({_ACTUALS}),
  p AS (SELECT r.video, r.rank, a.act, greatest(0e0, least(r."end", a.s + 30e0) - greatest(r."start", a.s)) / (greatest(r."end", a.s + 30e0) - least(r."start", a.s)) AS iou FROM r JOIN a USING (video)),
  o AS (SELECT *, row_number() OVER (PARTITION BY video ORDER BY iou DESC, rank DESC, act DESC) AS i FROM p WHERE iou >= 0.1e0),
  w AS (SELECT video, 0::BIGINT AS i, []::STRUCT(p INT, a INT, iou DOUBLE)[] AS m FROM o GROUP BY 1 UNION ALL SELECT w.video, o.i, CASE WHEN len(list_filter(m, lambda x: x.p = o.rank OR x.a = o.act)) = 0 THEN list_append(m, {{'p': o.rank, 'a': o.act, 'iou': o.iou}}) ELSE m END FROM w JOIN o ON o.video = w.video AND o.i = w.i + 1),
  t AS (SELECT video, x.p AS rank, x.a AS act, x.iou AS iou FROM (SELECT video, unnest(arg_max(m, i)) AS x FROM w GROUP BY 1)),
  f AS (SELECT r.video AS experiment, r.rank, r.clip, r.estimate, t.act AS actual, round(coalesce(t.iou, 0e0), 4) AS iou, coalesce(t.iou >= 0.5e0, false) AS recovered, round(r."start" - a.s, 3) AS start_error, round(r."end" - (a.s + 30e0), 3) AS end_error, a.performance
    FROM r LEFT JOIN t USING (video, rank) LEFT JOIN a ON a.video = t.video AND a.act = t.act)"""


def _revealed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Evaluated matches and clips of all videos, once corrections of some were taken in."""
    # tables that several later steps read are written once, so that no plan repeats those before it
    predictions = snapshots.written(_recommended(spark, sf_dir).withColumnRenamed("video", "experiment"))
    l = b.labels_iv(spark, sf_dir).select(F.col("video").alias("experiment"), F.explode(F.array(F.lit(0), F.lit(1))).alias("actual"), "start").withColumn("s", F.col("start") + 40.0 * F.col("actual"))
    place = F.array(F.struct(F.col("s").alias("start"), (F.col("s") + 30.0).alias("end")))
    actuals = l.select("experiment", "actual", place.alias("segments"), (F.col("actual") + F.col("experiment") % 7).alias("performance"))
    actuals = snapshots.written(actuals)
    first = reveal.evaluate(predictions, actuals)
    # of some videos a clip is moved: beyond its source (400 s) for some, twice for others
    late = l.where("experiment % 4 = 0 AND actual = 1").select("experiment", "actual", F.lit(1).alias("seq"), (F.col("s") + 45.0).alias("start"), (F.col("s") + 75.0).alias("end"))
    twice = l.where("experiment % 4 = 1 AND actual = 0").select("experiment", "actual", F.explode(F.array(F.lit(1), F.lit(2))).alias("seq"), "s")
    twice = twice.select("experiment", "actual", "seq", (F.col("s") + 5.0 - 2.5 * (F.col("seq") - 1)).alias("start"), (F.col("s") + 35.0 - 2.5 * (F.col("seq") - 1)).alias("end"))
    after, changed, _ = reveal.corrected(actuals, late.unionByName(twice).withColumn("duration", F.lit(400.0)))
    after, changed = snapshots.written(after), snapshots.written(changed)
    return reveal.refreshed(first, predictions, after, changed), after


@query("oth18_corrected_matches", f"{_REVEALED} SELECT * FROM f")
def oth18(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recommendations against revealed clips after corrections; only videos with a changed clip were matched again."""
    return _revealed(spark, sf_dir)[0]


@query("oth18_corrected_summary", f"""{_REVEALED}, k AS (SELECT *, rank() OVER (PARTITION BY experiment ORDER BY estimate) + (count(*) OVER (PARTITION BY experiment, estimate) - 1) / 2e0 AS rp, rank() OVER (PARTITION BY experiment ORDER BY performance) + (count(*) OVER (PARTITION BY experiment, performance) - 1) / 2e0 AS ra FROM f WHERE actual IS NOT NULL)
  SELECT experiment, count(*) AS predictions, 2::BIGINT AS clips, 2::BIGINT AS aligned, round(count(DISTINCT CASE WHEN recovered THEN actual END) / 2e0, 4) AS recall, round(avg(iou), 6) AS mean_iou, any_value(c) AS rank_correlation
  FROM f LEFT JOIN (SELECT experiment, CASE WHEN count(*) > 1 AND stddev_pop(rp) > 0 AND stddev_pop(ra) > 0 THEN round(corr(rp, ra), 4) END AS c FROM k GROUP BY 1) USING (experiment) GROUP BY 1""")
def oth18_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    matches, after = _revealed(spark, sf_dir)
    return reveal.summary(snapshots.written(matches), after)
