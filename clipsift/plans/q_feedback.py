"""Queries over feedback logs and audience reports: counts, rates, outcomes, learned profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clipsift.functions.scalars import shrink, six
from clipsift.operators import learning, order, ranking
from clipsift.plans import bridges as b
from clipsift.plans.registry import query

DECISIVE = ("download_original", "download_edited", "review_closed_unselected", "reject")


@query("win01_latest_event", "SELECT clip, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM {feedback} GROUP BY clip")
def win01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.latest(b.feedback(spark, sf_dir).select("clip", "event_id", "event_type"), ["clip"], "event_id")


@query("agg01_status_counts", "SELECT event_type, count(*) AS n FROM {feedback} GROUP BY 1")
def agg01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.feedback(spark, sf_dir).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("agg02_event_counts", "SELECT creator, event_type, count(*) AS events, count(DISTINCT clip) AS clips FROM {feedback} GROUP BY 1, 2")
def agg02(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.feedback(spark, sf_dir).groupBy("creator", "event_type").agg(F.count(F.lit(1)).alias("events"), F.count_distinct("clip").alias("clips"))


@query("agg03_conditional_sums", """SELECT creator, sum(CASE WHEN event_type LIKE 'download%' THEN 1 ELSE 0 END)::BIGINT AS downloads, count(*) FILTER (event_type = 'reject') AS rejects,
    round(sum(CASE WHEN event_type = 'presented' THEN value ELSE 0 END), 6) AS presented_value FROM {feedback} GROUP BY 1""")
def agg03(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_type")
    return b.feedback(spark, sf_dir).groupBy("creator").agg(F.count_if(e.startswith("download")).alias("downloads"), F.count_if(e == "reject").alias("rejects"), six(F.sum(F.when(e == "presented", F.col("value")).otherwise(0.0))).alias("presented_value"))


@query("agg04_first_last_seen", """SELECT coalesce(nullif(event_type, 'reject'), 'other') AS kind, count(*) AS n, min(event_id) AS first_id, max(event_id) AS last_id FROM {feedback} GROUP BY 1 ORDER BY n DESC""")
def agg04(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.coalesce(F.nullif("event_type", F.lit("reject")), F.lit("other")).alias("kind")
    return b.feedback(spark, sf_dir).groupBy(kind).agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id")).orderBy(F.desc("n"))


@query("agg05_adjustment_stats", "SELECT platform, round(avg(abs(adjustment)), 6) AS mean_abs, round(max(abs(adjustment)), 6) AS max_abs FROM {platformed} GROUP BY 1")
def agg05(spark: SparkSession, sf_dir: str) -> DataFrame:
    from clipsift.plans.q_clips import platformed

    a = F.abs("adjustment")
    return platformed(spark, sf_dir).groupBy("platform").agg(six(F.avg(a)).alias("mean_abs"), six(F.max(a)).alias("max_abs"))


@query("agg06_clips_with_decision", "SELECT creator, count(DISTINCT clip) AS clips FROM {feedback} WHERE event_type <> 'presented' GROUP BY 1")
def agg06(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.feedback(spark, sf_dir).where("event_type <> 'presented'").groupBy("creator").agg(F.count_distinct("clip").alias("clips"))


@query("agg07_queue_bounds", "SELECT min(event_id) AS oldest, coalesce(max(display_rank), 0) + 1 AS next_rank FROM {feedback} WHERE event_type = 'presented'")
def agg07(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.feedback(spark, sf_dir).where("event_type = 'presented'").agg(F.min("event_id").alias("oldest"), (F.coalesce(F.max("display_rank"), F.lit(0)) + 1).alias("next_rank"))


@query("agg08_jobs_by_creator", "SELECT c_nationkey AS nation, event_type, count(*) AS n FROM {feedback} JOIN customer ON creator = c_custkey GROUP BY 1, 2")
def agg08(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = b.table(spark, sf_dir, "customer")
    return b.feedback(spark, sf_dir).join(c, F.col("creator") == F.col("c_custkey")).groupBy(F.col("c_nationkey").alias("nation"), "event_type").agg(F.count(F.lit(1)).alias("n"))


def selection_rate(keys: list[str], events: DataFrame) -> DataFrame:
    """Share of presented clips that were taken; null where none was presented."""
    taken = F.count_distinct(F.when(F.col("event_type").startswith("download"), F.col("clip")))
    shown = F.count_distinct(F.when(F.col("event_type") == "presented", F.col("clip")))
    return events.groupBy(*keys).agg(shown.alias("presented"), taken.alias("selected")).withColumn("rate", six(F.try_divide(F.col("selected").cast("double"), F.col("presented"))))


RATE = "count(DISTINCT CASE WHEN event_type = 'presented' THEN clip END) AS presented, count(DISTINCT CASE WHEN event_type LIKE 'download%' THEN clip END) AS selected"


@query("agg09_selection_rate", "SELECT creator, presented, selected, round(selected::DOUBLE / nullif(presented, 0), 6) AS rate FROM (SELECT creator, " + RATE + " FROM {feedback} GROUP BY 1)")
def agg09(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection_rate(["creator"], b.feedback(spark, sf_dir))


@query("agg10_selection_by_rank", "SELECT display_rank, presented, selected, round(selected::DOUBLE / nullif(presented, 0), 6) AS rate FROM (SELECT display_rank, " + RATE + " FROM {feedback} GROUP BY 1)")
def agg10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection_rate(["display_rank"], b.feedback(spark, sf_dir))


METRICS = ("views", "likes", "comments", "shares", "average_view_percentage", "completion_rate_percentage")


@query("agg11_numeric_summary", "SELECT metric, count(v) AS n, round(min(v), 6) AS minimum, round(quantile_cont(v, 0.25), 6) AS p25, round(quantile_cont(v, 0.5), 6) AS median, round(avg(v), 6) AS mean, round(quantile_cont(v, 0.75), 6) AS p75, round(max(v), 6) AS maximum FROM (" + " UNION ALL ".join(f"SELECT '{m}' AS metric, {m}::DOUBLE AS v FROM {{performance}}" for m in METRICS) + ") GROUP BY 1")
def agg11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learning.numeric_summaries(b.performance(spark, sf_dir), METRICS)


@query("agg12_account_rollup", """SELECT creator, events, clips, presented, selected, round(selected::DOUBLE / nullif(presented, 0), 6) AS rate, round(median_span, 6) AS median_span, reports, round(mean_views, 6) AS mean_views FROM
    (SELECT creator, count(*) AS events, count(DISTINCT clip) AS clips, """ + RATE + """, quantile_cont(CASE WHEN event_type = 'download_edited' THEN "end" - "start" END, 0.5) AS median_span FROM {feedback} GROUP BY 1)
    LEFT JOIN (SELECT creator, count(*) AS reports, avg(views) AS mean_views FROM {performance} GROUP BY 1) USING (creator)""")
def agg12(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = b.feedback(spark, sf_dir)
    rates = selection_rate(["creator"], e)
    spans = e.groupBy("creator").agg(F.count(F.lit(1)).alias("events"), F.count_distinct("clip").alias("clips"))
    edited = e.where("event_type = 'download_edited'").select("creator", (F.col("end") - F.col("start")).alias("span"))
    middle = order.quantiles(edited, ["creator"], "span", [0.5]).select("creator", six(F.col("q")[0]).alias("median_span"))
    reports = b.performance(spark, sf_dir).groupBy("creator").agg(F.count(F.lit(1)).alias("reports"), six(F.avg("views")).alias("mean_views"))
    return spans.join(rates, "creator").join(middle, "creator", "left").join(reports, "creator", "left").select("creator", "events", "clips", "presented", "selected", "rate", "median_span", "reports", "mean_views")


@query("agg13_coverage_counters", "SELECT " + "'views' AS metric, count(views) AS present, count(*) - count(views) AS missing FROM {performance}" + "".join(f" UNION ALL SELECT '{m}', count({m}), count(*) - count({m}) FROM {{performance}}" for m in METRICS[1:]))
def agg13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learning.metric_coverage(b.performance(spark, sf_dir), METRICS)


@query("agg14_boundary_change", """SELECT event_type, count(*) AS n, round(quantile_cont(abs("start" - event_id % 290) + abs("end" - "start" - 25e0), 0.5), 6) AS median_change FROM {feedback} WHERE event_type LIKE 'download%' GROUP BY 1""")
def agg14(spark: SparkSession, sf_dir: str) -> DataFrame:
    change = F.abs(F.col("start") - F.col("event_id") % 290) + F.abs(F.col("end") - F.col("start") - 25.0)
    e = b.feedback(spark, sf_dir).where(F.col("event_type").startswith("download")).select("event_type", change.alias("change"))
    middle = order.quantiles(e, ["event_type"], "change", [0.5]).select("event_type", six(F.col("q")[0]).alias("median_change"))
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).join(middle, "event_type")


@query("agg15_weighted_rate", """SELECT creator, round(sum(average_view_percentage * w) / nullif(sum(w), 0), 6) AS rate FROM (SELECT *, coalesce(nullif(engaged_views, 0), views)::DOUBLE AS w FROM {performance}) GROUP BY 1""")
def agg15(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.coalesce(F.nullif("engaged_views", F.lit(0)), F.col("views")).cast("double")
    return b.performance(spark, sf_dir).groupBy("creator").agg(six(F.try_divide(F.sum(F.col("average_view_percentage") * w), F.sum(w))).alias("rate"))


@query("agg16_totals_without_total_row", """SELECT creator, CASE WHEN bool_or(clip % 17 = 0) THEN sum(views) FILTER (clip % 17 = 0) ELSE sum(views) END::BIGINT AS views FROM {performance} GROUP BY 1""")
def agg16(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = F.col("clip") % 17 == 0
    return b.performance(spark, sf_dir).groupBy("creator").agg(F.when(F.bool_or(total), F.sum(F.when(total, F.col("views")))).otherwise(F.sum("views")).alias("views"))


#: Report fields that the bridge lacks, made of those it has; Spark and DuckDB read the same expressions.
MORE_FIELDS = {
    "chose_to_view_percentage": "CASE WHEN clip % 6 <> 0 THEN views % 101 END",
    "average_view_duration_seconds": "CASE WHEN clip % 7 <> 0 THEN duration * (likes % 30) / 10 END",
    "duration_seconds": "CASE WHEN clip % 8 = 0 THEN 0 WHEN clip % 8 <> 1 THEN duration END",
    "saves": "CASE WHEN clip % 5 <> 0 THEN likes % 7 END",
    "profile_visits": "CASE WHEN clip % 9 <> 0 THEN likes % 5 END",
    "replays": "CASE WHEN clip % 2 = 0 THEN views % 9 END",
    "reach": "CASE WHEN clip % 3 <> 0 THEN views % 50 END",
    "subscribers_gained": "CASE WHEN clip % 4 <> 1 THEN comments END",
    "subscribers_lost": "CASE WHEN clip % 3 <> 1 THEN likes % 3 END",
    "subscribers_net": "CASE WHEN clip % 7 = 3 THEN comments - 4 END",
    "follows": "CASE WHEN clip % 10 <> 4 THEN likes % 4 END",
}
RATES = {f"{c}_per_view": f"{c}::DOUBLE / x" for c in learning.COUNTS} | {c: f"{c} / 100e0" for c in learning.PERCENTAGES}
RATES |= {
    "duration_fraction": "CASE WHEN duration_seconds <> 0 AND average_view_duration_seconds IS NOT NULL THEN least(2e0, average_view_duration_seconds::DOUBLE / duration_seconds) END",
    "plays_per_reached_account": "CASE WHEN reach > 0 THEN x::DOUBLE / reach END",
    "net_subscribers_per_view": "(CASE WHEN subscribers_net IS NOT NULL THEN subscribers_net WHEN subscribers_gained IS NOT NULL OR subscribers_lost IS NOT NULL THEN coalesce(subscribers_gained, 0) - coalesce(subscribers_lost, 0) END)::DOUBLE / x",
}
FULL_REPORTS = "(SELECT *, " + ", ".join(f"{e} AS {n}" for n, e in MORE_FIELDS.items()) + ", coalesce(nullif(engaged_views, 0), views) AS x FROM {performance})"


@query("mth08_components", "SELECT clip, component, round(v, 6) AS value FROM (" + " UNION ALL ".join(f"SELECT clip, '{n}' AS component, {e} AS v FROM {FULL_REPORTS} WHERE x >= 50" for n, e in RATES.items()) + ") WHERE v IS NOT NULL")
def mth08(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All thirteen rates of reports that hold every field."""
    reports = b.performance(spark, sf_dir).selectExpr("*", *[f"{e} AS {n}" for n, e in MORE_FIELDS.items()])
    return learning.outcome_components(reports).select("clip", "component", six(F.col("value")).alias("value"))


TARGETS = """, comp AS (SELECT creator, clip, component, v FROM (""" + " UNION ALL ".join(f"SELECT creator, clip, '{n}' AS component, {e} AS v FROM {{performance}} WHERE coalesce(nullif(engaged_views, 0), views) >= 50" for n, e in (("average_view_percentage", "average_view_percentage / 100e0"), ("completion_rate_percentage", "completion_rate_percentage / 100e0"), ("likes_per_view", "likes::DOUBLE / coalesce(nullif(engaged_views, 0), views)"), ("comments_per_view", "comments::DOUBLE / coalesce(nullif(engaged_views, 0), views)"), ("shares_per_view", "shares::DOUBLE / coalesce(nullif(engaged_views, 0), views)"))) + """) WHERE v IS NOT NULL),
  pct AS (SELECT *, count(*) OVER g AS n, CASE WHEN max(v) OVER g = min(v) OVER g THEN 0e0 ELSE 2 * ((rank() OVER (PARTITION BY creator, component ORDER BY v) - 1 + (count(*) OVER (PARTITION BY creator, component, v) - 1) / 2e0) / (count(*) OVER g - 1)) - 1 END AS p FROM comp WINDOW g AS (PARTITION BY creator, component)),
  targets AS (SELECT creator, clip, avg(p) AS target FROM pct WHERE n >= 2 GROUP BY 1, 2)"""
TARGETS = "WITH one AS (SELECT 1)" + TARGETS


@query("win14_outcome_target", TARGETS + " SELECT creator, clip, round(target, 6) AS target FROM targets")
def win14(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = learning.outcome_targets(learning.outcome_components(b.performance(spark, sf_dir)))
    return t.select("creator", "clip", six(F.col("target")).alias("target"))


@query("win15_outcome_index", "SELECT creator, clip, round(100e0 * (0.5e0 * pv + 0.3e0 * pl + 0.2e0 * pc), 6) AS index100 FROM (SELECT creator, clip, " + ", ".join(f"CASE WHEN count(*) OVER g < 2 OR max({c}) OVER g = min({c}) OVER g THEN 0.5e0 ELSE (rank() OVER (PARTITION BY creator ORDER BY {c}) - 1 + (count(*) OVER (PARTITION BY creator, {c}) - 1) / 2e0) / (count(*) OVER g - 1) END AS {a}" for a, c in (("pv", "views"), ("pl", "lr"), ("pc", "cr"))) + " FROM (SELECT *, likes::DOUBLE / greatest(views, 1) AS lr, comments::DOUBLE / greatest(views, 1) AS cr FROM {performance}) WINDOW g AS (PARTITION BY creator))")
def win15(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.greatest("views", F.lit(1))
    p = b.performance(spark, sf_dir).select("creator", "clip", "views", (F.col("likes").cast("double") / v).alias("lr"), (F.col("comments").cast("double") / v).alias("cr"))
    p = order.with_ranks(p, ["creator"], {f"at_{c}": c for c in ("views", "lr", "cr")})
    share = {c: order.mid_percentile(f"at_{c}") for c in ("views", "lr", "cr")}
    return p.select("creator", "clip", six(100.0 * (0.5 * share["views"] + 0.3 * share["lr"] + 0.2 * share["cr"])).alias("index100"))


PROFILE_FEATURES = ("average_view_percentage", "duration", "comments")


@query("agg42_feature_profile", TARGETS + ", f AS (SELECT t.creator, target, unnest([{'feature': 'comments', 'x': comments / 10e0}, {'feature': 'duration', 'x': (duration - 40e0) / 20e0}, {'feature': 'percentage', 'x': average_view_percentage / 50e0 - 1e0}]) AS s FROM targets t JOIN {performance} p USING (clip)) SELECT creator, s.feature AS feature, count(*) AS n, round(CASE WHEN count(*) >= 5 THEN avg(target * s.x) * (count(*) / (count(*) + 12e0)) ELSE 0e0 END, 6) AS weight FROM f GROUP BY 1, 2")
def agg42(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = b.performance(spark, sf_dir)
    t = learning.outcome_targets(learning.outcome_components(p)).select("clip", "target")
    features = {"comments": F.col("comments") / 10.0, "duration": (F.col("duration") - 40.0) / 20.0, "percentage": F.col("average_view_percentage") / 50.0 - 1.0}
    return learning.feature_profile(p.join(t, "clip"), ["creator"], "target", features, prior=12.0, least=5).withColumn("weight", six(F.col("weight")))


WEIGHTS = "CASE event_type WHEN 'download_original' THEN 1e0 WHEN 'download_edited' THEN 1e0 WHEN 'review_closed_unselected' THEN -0.35e0 WHEN 'reject' THEN -1e0 END"


@query("agg43_balanced_profile", "WITH last AS (SELECT creator, clip, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM {feedback} WHERE event_type <> 'presented' GROUP BY 1, 2), x AS (SELECT creator, " + WEIGHTS + " AS w, unnest([{'feature': 'span', 'v': (value - 20e0) / 20e0}, {'feature': 'slot', 'v': clip % 10 / 5e0 - 1e0}]) AS s FROM last), per AS (SELECT creator, s.feature AS feature, avg(w * s.v) AS m, count(*) AS n FROM x GROUP BY 1, 2) SELECT feature, count(*) AS creators, round(avg(m) * (sum(n) / (sum(n) + 30e0)), 6) AS weight FROM per GROUP BY 1")
def agg43(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every creator counts once, however many decisions they made."""
    e = b.feedback(spark, sf_dir).where("event_type <> 'presented'").select("creator", "clip", "event_id", "event_type", "value")
    last = ranking.latest(e, ["creator", "clip"], "event_id").withColumn("w", learning.editorial_weight(F.col("event_type")))
    features = {"span": (F.col("value") - 20.0) / 20.0, "slot": F.col("clip") % 10 / 5.0 - 1.0}
    return learning.balanced_profile(last, ["creator"], "w", features, prior=30.0).withColumn("weight", six(F.col("weight")))


@query("jon25_unresolved", "SELECT DISTINCT clip FROM {feedback} f WHERE event_type = 'presented' AND NOT EXISTS (SELECT 1 FROM {feedback} g WHERE g.clip = f.clip AND g.event_type <> 'presented')")
def jon25(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = b.feedback(spark, sf_dir)
    return e.where("event_type = 'presented'").select("clip").distinct().join(e.where("event_type <> 'presented'").select("clip"), "clip", "left_anti")


@query("seq10_close_review", "SELECT clip, 'review_closed_unselected' AS event_type, max(event_id) AS after_event FROM {feedback} f WHERE event_type = 'presented' AND clip NOT IN (SELECT clip FROM {feedback} WHERE event_type <> 'presented') GROUP BY 1")
def seq10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One weak negative for each undecided clip; with these in the log a second run adds none."""
    return learning.close_review(b.feedback(spark, sf_dir))


@query("jon26_last_download_duration", """SELECT c.clip, round(coalesce(d.span, c.proposed), 6) AS duration FROM (SELECT clip, min("end" - "start") AS proposed FROM {feedback} GROUP BY 1) c
    LEFT JOIN (SELECT clip, arg_max("end" - "start", event_id) AS span FROM {feedback} WHERE event_type LIKE 'download%' GROUP BY 1) d USING (clip)""")
def jon26(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both sides are maxima or minima by clip, so one aggregate serves and no join is needed."""
    span, taken = F.col("end") - F.col("start"), F.col("event_type").startswith("download")
    last = F.max_by(F.when(taken, span), F.when(taken, F.col("event_id")))
    return b.feedback(spark, sf_dir).groupBy("clip").agg(six(F.coalesce(last, F.min(span))).alias("duration"))


@query("jon28_feedback_snapshot", """SELECT clip, count(*) AS n_events, arg_max(event_type, event_id) AS last_label, round(coalesce(sum(""" + WEIGHTS + """), 0), 6) AS weight,
    round(arg_max("start", event_id) - arg_min("start", event_id), 6) AS start_delta, round(arg_max("end", event_id) - arg_min("end", event_id), 6) AS end_delta FROM {feedback} GROUP BY 1""")
def jon28(spark: SparkSession, sf_dir: str) -> DataFrame:
    delta = lambda c: six(F.max_by(c, "event_id") - F.min_by(c, "event_id"))
    return b.feedback(spark, sf_dir).groupBy("clip").agg(F.count(F.lit(1)).alias("n_events"), F.max_by("event_type", "event_id").alias("last_label"), six(F.coalesce(F.sum(learning.editorial_weight(F.col("event_type"))), F.lit(0.0))).alias("weight"), delta("start").alias("start_delta"), delta("end").alias("end_delta"))


@query("mth11_retention_adj", """SELECT creator, clip, round(CASE WHEN n >= 10 THEN 0.2e0 * (exp(z) - 1e0) / (exp(z) + 1e0) ELSE 0e0 END, 6) AS adjustment FROM (SELECT creator, clip, count(*) OVER g AS n, (m - quantile_cont(m, 0.5) OVER g) / greatest(0.05e0, stddev_pop(m) OVER g) AS z
    FROM (SELECT creator, clip, avg(value) / 50e0 AS m FROM {feedback} GROUP BY 1, 2) WINDOW g AS (PARTITION BY creator))""")
def mth11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """0.20 * tanh(z / 2) of a clip's mean against its creator's median, where at least ten points are known."""
    points = b.feedback(spark, sf_dir).groupBy("creator", "clip").agg((F.avg("value") / 50.0).alias("m"))
    shape = points.groupBy("creator").agg(F.count(F.lit(1)).alias("n"), F.stddev_pop("m").alias("spread"))
    shape = shape.join(order.quantiles(points, ["creator"], "m", [0.5]).select("creator", F.col("q")[0].alias("centre")), "creator")
    z = (F.col("m") - F.col("centre")) / F.greatest(F.lit(0.05), F.col("spread"))
    return points.join(shape, "creator").select("creator", "clip", six(F.when(F.col("n") >= 10, 0.2 * (F.exp(z) - 1.0) / (F.exp(z) + 1.0)).otherwise(0.0)).alias("adjustment"))


@query("mth13_shrinkage", "SELECT creator, count(*) AS n, round(count(*) / (count(*) + 8e0), 6) AS s8, round(count(*) / (count(*) + 12e0), 6) AS s12, round(count(*) / (count(*) + 30e0), 6) AS s30 FROM {feedback} GROUP BY 1")
def mth13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.feedback(spark, sf_dir).groupBy("creator").agg(F.count(F.lit(1)).alias("n")).select("creator", "n", *[six(shrink(F.col("n"), k)).alias(f"s{k:.0f}") for k in (8.0, 12.0, 30.0)])


@query("mth14_logistic_estimate", "SELECT clip, round(100e0 / (1e0 + exp(-CASE WHEN s > 0 THEN (score - m) / s ELSE 0e0 END)), 6) AS estimate FROM (SELECT clip, score, avg(score) OVER w AS m, stddev_pop(score) OVER w AS s FROM {clips} WINDOW w AS (PARTITION BY video))")
def mth14(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("video")
    c = b.clips(spark, sf_dir).select("clip", "score", F.avg("score").over(w).alias("m"), F.stddev_pop("score").over(w).alias("s"))
    z = F.when(F.col("s") > 0, (F.col("score") - F.col("m")) / F.when(F.col("s") > 0, F.col("s")).otherwise(1.0)).otherwise(0.0)
    return c.select("clip", six(100.0 / (1.0 + F.exp(-z))).alias("estimate"))


@query("snk03_upsert", "SELECT coalesce(n.clip, o.clip) AS clip, coalesce(n.views, o.views) AS views FROM (SELECT clip, views FROM {performance} WHERE clip % 2 = 0) o FULL JOIN (SELECT clip, views * 2 AS views FROM {performance} WHERE clip % 3 = 0) n USING (clip)")
def snk03(spark: SparkSession, sf_dir: str) -> DataFrame:
    from clipsift.operators.sets import upsert

    p = b.performance(spark, sf_dir).select("clip", "views")
    return upsert(p.where("clip % 2 = 0"), p.where("clip % 3 = 0").withColumn("views", F.col("views") * 2), ["clip"])


@query("snk04_backfill", "SELECT clip, views FROM {performance} WHERE clip % 2 = 0 UNION ALL SELECT clip, 0 FROM {performance} WHERE clip % 3 = 0 AND clip % 2 <> 0")
def snk04(spark: SparkSession, sf_dir: str) -> DataFrame:
    from clipsift.operators.sets import insert_missing

    p = b.performance(spark, sf_dir).select("clip", "views")
    return insert_missing(p.where("clip % 2 = 0"), p.where("clip % 3 = 0").withColumn("views", F.lit(0).cast("long")), ["clip"])


@query("snk07_cascade_delete", "SELECT event_id, clip FROM {feedback} WHERE creator NOT IN (SELECT DISTINCT creator FROM {feedback} WHERE creator % 10 = 0)")
def snk07(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = b.feedback(spark, sf_dir).select("event_id", "clip", "creator")
    gone = e.where("creator % 10 = 0").select("creator").distinct()
    return e.join(gone, "creator", "left_anti").select("event_id", "clip")


@query("stm03_failure_windows", "SELECT creator, time_bucket(INTERVAL 15 MINUTE, ts)::TIMESTAMP AS window_start, count(*) AS failures FROM {feedback} WHERE event_type = 'reject' GROUP BY 1, 2")
def stm03(spark: SparkSession, sf_dir: str) -> DataFrame:
    from clipsift.streaming.events import failure_windows

    return failure_windows(b.feedback(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp")), "15 minutes").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("stm03_sliding_failures", "SELECT creator, time_bucket(INTERVAL 1 MINUTE, ts)::TIMESTAMP - to_minutes(k) AS window_start, count(*) AS failures FROM {feedback}, (SELECT unnest(range(15)) AS k) WHERE event_type = 'reject' GROUP BY 1, 2")
def stm03_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failures within 15 minutes, counted anew every minute."""
    from clipsift.streaming.events import failure_windows

    return failure_windows(b.feedback(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp")), "15 minutes", slide="1 minute").withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("snk06_update_if_null", "SELECT clip, coalesce(shares, comments) AS shares, shares IS NULL AND comments IS NOT NULL AS updated FROM {performance} LEFT JOIN (SELECT clip, comments FROM {performance} WHERE comments > 2) u USING (clip)".replace("coalesce(shares, comments)", "coalesce(shares, u.comments)").replace("AND comments IS", "AND u.comments IS"))
def snk06(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares that are missing are set once, from the comments where there are more than two; what is set stays."""
    p = b.performance(spark, sf_dir)
    return learning.update_if_null(p.select("clip", "shares"), p.where("comments > 2").select("clip", F.col("comments").alias("shares")), "clip", "shares")


@query("stm_sessions", """WITH g AS (SELECT creator, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY creator ORDER BY ts) < INTERVAL 10 MINUTE THEN 0 ELSE 1 END AS new FROM {feedback}),
    s AS (SELECT creator, ts, sum(new) OVER (PARTITION BY creator ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT creator, min(ts) AS session_start, count(*) AS events FROM s GROUP BY creator, k""")
def stm_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    from clipsift.streaming.events import sessions

    return sessions(b.feedback(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp")), "10 minutes").withColumn("session_start", F.col("session_start").cast("timestamp_ntz"))
