"""Queries over clips: platform scores, diverse selection, top-k, coverage, ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clipsift.functions.scalars import platform_adjustment, preference_vector, six
from clipsift.operators import ranking
from clipsift.plans import bridges as b
from clipsift.plans.registry import query

RATINGS = ("hook", "completeness", "payoff", "clarity")
BEST_FIRST = [("platform_score", True), ("score", True), ("clip", False)]


def platformed(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = b.clips(spark, sf_dir)
    adjustment = platform_adjustment(F.col("platform"), [F.col(r) for r in RATINGS], F.col("duration"), F.col("urgency"), F.col("excitement"))
    return c.withColumn("adjustment", adjustment).withColumn("platform_score", F.col("score") + F.col("adjustment"))


def _nms_sql(source: str, order: str, k: int, limit: str, keys: str = "video") -> str:
    return f"""WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY {order}) AS i FROM ({source})),
      walk AS (SELECT {keys}, 0::BIGINT AS i, []::STRUCT(clip VARCHAR, s DOUBLE, e DOUBLE)[] AS taken FROM o GROUP BY {keys}
        UNION ALL SELECT {keys}, o.i, CASE WHEN len(taken) < {k} AND len(list_filter(taken, lambda x:
            greatest(0e0, least(x.e, o."end") - greatest(x.s, o."start")) / (greatest(x.e, o."end") - least(x.s, o."start")) > {limit})) = 0
          THEN list_append(taken, {{'clip': o.clip, 's': o."start", 'e': o."end"}}) ELSE taken END
        FROM walk JOIN o USING ({keys}) WHERE o.i = walk.i + 1),
      fin AS (SELECT {keys}, arg_max(taken, i) AS taken FROM walk GROUP BY {keys}),
      picked AS (SELECT {keys}, unnest(taken) AS t, unnest(range(1, len(taken) + 1))::INT AS rank FROM fin)"""


SCORED = "SELECT *, score + adjustment AS platform_score FROM {platformed}"
ORDER = "platform_score DESC, score DESC, clip"


@query("mth01_iou", """SELECT c.video, clip, round(CASE WHEN greatest(c."end", l."end") - least(c."start", l."start") > 0 THEN
    greatest(0e0, least(c."end", l."end") - greatest(c."start", l."start")) / (greatest(c."end", l."end") - least(c."start", l."start")) ELSE 0 END, 6) AS iou
    FROM {clips} c JOIN {labels_iv} l USING (video)""")
def mth01(spark: SparkSession, sf_dir: str) -> DataFrame:
    from clipsift.functions.scalars import iou

    c, l = b.clips(spark, sf_dir), b.labels_iv(spark, sf_dir).select("video", F.col("start").alias("ls"), F.col("end").alias("le"))
    return c.join(l, "video").select("video", "clip", six(iou(F.col("start"), F.col("end"), F.col("ls"), F.col("le"))).alias("iou"))


@query("mth06_preference_vector", """SELECT clip, round((hook - 3e0) / 2e0, 6) AS f_hook, round((completeness - 3e0) / 2e0, 6) AS f_completeness, round((payoff - 3e0) / 2e0, 6) AS f_payoff,
    round((clarity - 3e0) / 2e0, 6) AS f_clarity, round((duration - 40e0) / 20e0, 6) AS f_duration, round(2e0 * urgency - 1e0, 6) AS f_urgency, round(2e0 * excitement - 1e0, 6) AS f_excitement FROM {clips}""")
def mth06(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = (*RATINGS, "duration", "urgency", "excitement")
    v = preference_vector(*[F.col(n) for n in names])
    return b.clips(spark, sf_dir).select("clip", *[six(x).alias(f"f_{n}") for x, n in zip(v, names)])


@query("mth07_platform_adj", "SELECT clip, platform, round(adjustment, 6) AS adjustment FROM {platformed}")
def mth07(spark: SparkSession, sf_dir: str) -> DataFrame:
    return platformed(spark, sf_dir).select("clip", "platform", six(F.col("adjustment")).alias("adjustment"))


@query("top06_strict_nms", _nms_sql(SCORED, ORDER, 3, "0.1e0") + """ SELECT video, rank, round(t.s, 6) AS "start", round(t.e, 6) AS "end", round(o.platform_score, 6) AS platform_score
    FROM picked JOIN o USING (video) WHERE o.clip = t.clip""")
def top06(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = ranking.greedy_diverse(platformed(spark, sf_dir).select("video", "clip", "start", "end", "score", "platform_score"), ["video"], BEST_FIRST, 3, 0.10)
    return kept.select("video", "rank", six(F.col("start")).alias("start"), six(F.col("end")).alias("end"), six(F.col("platform_score")).alias("platform_score"))


@query("top04_nms_iou50", _nms_sql("SELECT * FROM {clips}", 'score DESC, "start", clip', 5, "0.5e0") + """ SELECT video, rank, round(t.s, 6) AS "start", round(t.e, 6) AS "end" FROM picked""")
def top04(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = ranking.greedy_diverse(b.clips(spark, sf_dir).select("video", "clip", "start", "end", "score"), ["video"], [("score", True), ("start", False), ("clip", False)], 5, 0.50)
    return kept.select("video", "rank", six(F.col("start")).alias("start"), six(F.col("end")).alias("end"))


@query("top05_nms_backfill", _nms_sql(SCORED, ORDER, 3, "0.25e0") + """, filled AS (SELECT o.*, p.rank AS picked_rank, coalesce(p.rank, 1000 + o.i) AS place FROM o LEFT JOIN picked p ON o.video = p.video AND o.clip = p.t.clip)
    SELECT video, rank::INT AS rank, clip, is_backfill FROM (SELECT video, clip, picked_rank IS NULL AS is_backfill, row_number() OVER (PARTITION BY video ORDER BY place) AS rank FROM filled) WHERE rank <= 3""")
def top05(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = platformed(spark, sf_dir).select("video", "clip", "start", "end", "score", "platform_score")
    kept = ranking.greedy_diverse(c, ["video"], BEST_FIRST, 3, 0.25).select("video", "clip", F.col("rank").alias("picked"))
    group = Window.partitionBy("video")
    order = [F.desc(x) if down else F.asc(x) for x, down in BEST_FIRST]
    placed = c.join(kept, ["video", "clip"], "left").withColumn("rank", F.row_number().over(group.orderBy(F.asc_nulls_last("picked"), *order)))
    return placed.where("rank <= 3").select("video", "rank", "clip", F.col("picked").isNull().alias("is_backfill"))


@query("top07_clip_plan", _nms_sql("SELECT * FROM (SELECT *, max(platform_score) OVER (PARTITION BY video) AS best FROM (" + SCORED + ")) WHERE platform_score >= best - 0.65e0", ORDER, 8, "0.1e0").replace("WITH RECURSIVE o AS", "WITH RECURSIVE oa AS (SELECT *, row_number() OVER (PARTITION BY video ORDER BY " + ORDER + ") AS i FROM (" + SCORED + """)),
      walka AS (SELECT video, 0::BIGINT AS i, []::STRUCT(s DOUBLE, e DOUBLE)[] AS taken FROM oa GROUP BY video
        UNION ALL SELECT video, oa.i, CASE WHEN len(taken) < 8 AND len(list_filter(taken, lambda x: greatest(0e0, least(x.e, oa."end") - greatest(x.s, oa."start")) / (greatest(x.e, oa."end") - least(x.s, oa."start")) > 0.1e0)) = 0
          THEN list_append(taken, {'s': oa."start", 'e': oa."end"}) ELSE taken END FROM walka JOIN oa USING (video) WHERE oa.i = walka.i + 1),
      media AS (SELECT video, max("end") * 3e0 AS len_s FROM {clips} GROUP BY 1), o AS""", 1) + """
    SELECT video, recommended::BIGINT AS recommended, CASE WHEN recommended > 0 THEN greatest(1, recommended - 1) ELSE 0 END::BIGINT AS range_low, least(available, 8, recommended + 1)::BIGINT AS range_high,
      available::BIGINT AS available, least(recommended, available)::BIGINT AS delivered FROM (
      SELECT video, available, CASE WHEN least(q, budget) = 0 AND available > 0 THEN 1 ELSE least(q, budget) END AS recommended FROM (
        SELECT f.video, len(f.taken) AS q, a.available, greatest(1, least(6, ceil(len_s / 300e0)::INT)) AS budget FROM fin f JOIN (SELECT video, len(arg_max(taken, i)) AS available FROM walka GROUP BY 1) a USING (video) JOIN media USING (video)))""")
def top07(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = platformed(spark, sf_dir).select("video", "clip", "start", "end", "score", "platform_score")
    group = Window.partitionBy("video")
    c = c.withColumns({"best": F.max("platform_score").over(group), "media": F.max("end").over(group) * 3.0})
    every = ranking.greedy_diverse(c, ["video"], BEST_FIRST, 8, 0.10).groupBy("video").agg(F.count(F.lit(1)).alias("available"), F.max("media").alias("media"))
    pool = ranking.greedy_diverse(c.where(F.col("platform_score") >= F.col("best") - 0.65), ["video"], BEST_FIRST, 8, 0.10).groupBy("video").agg(F.count(F.lit(1)).alias("good"))
    budget = F.greatest(F.lit(1), F.least(F.lit(6), F.ceil(F.col("media") / 300.0)))
    plan = every.join(pool, "video", "left").withColumn("r", F.least(F.coalesce("good", F.lit(0)), budget))
    plan = plan.withColumn("recommended", F.when((F.col("r") == 0) & (F.col("available") > 0), 1).otherwise(F.col("r")).cast("long"))
    return plan.select("video", "recommended", F.when(F.col("recommended") > 0, F.greatest(F.lit(1), F.col("recommended") - 1)).otherwise(0).cast("long").alias("range_low"), F.least("available", F.lit(8), F.col("recommended") + 1).cast("long").alias("range_high"), "available", F.least("recommended", "available").alias("delivered"))


@query("top03_topk_per_group", """SELECT video, rank::INT AS rank, clip, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY video ORDER BY score DESC, clip) AS rank FROM {clips}) WHERE rank <= 3""")
def top03(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.top_k(b.clips(spark, sf_dir), ["video"], [F.desc("score"), F.col("clip")], 3).select("video", "rank", "clip", six(F.col("score")).alias("score"))


@query("top01_recent", """SELECT event_id, creator, event_type FROM {feedback} ORDER BY event_id DESC LIMIT 50""")
def top01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.feedback(spark, sf_dir).select("event_id", "creator", "event_type").orderBy(F.desc("event_id")).limit(50)


@query("top02_role_order", """SELECT event_type, n::BIGINT AS n, role_rank::INT AS role_rank FROM (SELECT event_type, count(*) n, CASE event_type WHEN 'presented' THEN 0 WHEN 'download_edited' THEN 1 WHEN 'download_original' THEN 2 ELSE 3 END AS role_rank FROM {feedback} GROUP BY 1) ORDER BY role_rank, event_type""")
def top02(spark: SparkSession, sf_dir: str) -> DataFrame:
    role = F.when(F.col("event_type") == "presented", 0).when(F.col("event_type") == "download_edited", 1).when(F.col("event_type") == "download_original", 2).otherwise(3)
    return b.feedback(spark, sf_dir).groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).withColumn("role_rank", role).orderBy("role_rank", "event_type")


COVERAGE = """WITH g AS (SELECT *, o_custkey % 20 AS src FROM (SELECT o_orderkey AS doc, o_custkey, o_totalprice AS pri, (o_custkey % 300)::DOUBLE AS st FROM orders)),
  o AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY pri DESC, doc) AS i, count(*) OVER (PARTITION BY src) AS n, max(st) OVER (PARTITION BY src) AS mx FROM g),
  k AS (SELECT *, least(19, floor(st / (CASE WHEN mx = 0 THEN 1e0 ELSE mx END) * 20)::INT) AS bucket FROM o)"""


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = b.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc"), (F.col("o_custkey") % 20).alias("src"), F.col("o_totalprice").alias("pri"), (F.col("o_custkey") % 300).cast("double").alias("st"))
    group = Window.partitionBy("src")
    o = o.withColumns({"n": F.count(F.lit(1)).over(group), "mx": F.max("st").over(group)})
    return o.withColumn("bucket", F.least(F.lit(19), F.floor(F.col("st") / F.when(F.col("mx") == 0, 1.0).otherwise(F.col("mx")) * 20).cast("int")))


@query("top08_prefilter_buckets", COVERAGE + """, p AS (SELECT *, row_number() OVER (PARTITION BY src, bucket ORDER BY pri DESC, doc) AS br FROM k),
    f AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY br > 10, CASE WHEN br <= 10 THEN bucket END, pri DESC, doc) AS kept_rank FROM p)
    SELECT src, doc, bucket, kept_rank::INT AS kept_rank FROM f WHERE kept_rank <= 200""")
def top08(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each source 200 rows: ten of each of twenty time buckets, then the best of the rest."""
    s = _sources(spark, sf_dir).withColumn("br", F.row_number().over(Window.partitionBy("src", "bucket").orderBy(F.desc("pri"), "doc")))
    own = F.col("br") <= 10
    kept = ranking.top_k(s, ["src"], [(~own).asc(), F.when(own, F.col("bucket")).asc(), F.desc("pri"), F.col("doc")], 200, "kept_rank")
    return kept.select("src", "doc", "bucket", "kept_rank")


@query("top09_multimodal_budget", COVERAGE + """, t AS (SELECT *, i <= 75 AS top, least(20, 25) AS bc FROM k), r AS (SELECT *, row_number() OVER (PARTITION BY src, top, bucket ORDER BY pri DESC, doc) AS br FROM t),
    f AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY CASE WHEN top THEN 0 WHEN br = 1 THEN 1 ELSE 2 END, CASE WHEN NOT top AND br = 1 THEN bucket END, i) AS kr FROM r)
    SELECT src, doc, CASE WHEN top THEN 'top' WHEN br = 1 THEN 'coverage' ELSE 'fill' END AS tier FROM f WHERE kr <= 100""")
def top09(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each source 100 rows: the 75 best, the best other row of each of twenty time buckets, then the best of the rest."""
    s = _sources(spark, sf_dir).withColumn("i", F.row_number().over(Window.partitionBy("src").orderBy(F.desc("pri"), "doc"))).withColumn("top", F.col("i") <= 75)
    s = s.withColumn("br", F.row_number().over(Window.partitionBy("src", "top", "bucket").orderBy(F.desc("pri"), "doc")))
    tier = F.when(F.col("top"), "top").when(F.col("br") == 1, "coverage").otherwise("fill")
    place = F.when(F.col("top"), 0).when(F.col("br") == 1, 1).otherwise(2)
    kept = ranking.top_k(s, ["src"], [place.asc(), F.when(~F.col("top") & (F.col("br") == 1), F.col("bucket")).asc(), F.col("i")], 100, "kr")
    return kept.select("src", "doc", tier.alias("tier"))


@query("top13_argmax_ties", """SELECT video, arg_max(clip, (score, -"start", clip)) AS best, arg_min(clip, (abs(duration - 40e0), clip)) AS closest FROM {clips} GROUP BY video""")
def top13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.clips(spark, sf_dir).groupBy("video").agg(F.max_by("clip", F.struct(F.col("score"), -F.col("start"), F.col("clip"))).alias("best"), F.min_by("clip", F.struct(F.abs(F.col("duration") - 40.0), F.col("clip"))).alias("closest"))


@query("top14_strengths", """SELECT clip, 'Strongest: ' || array_to_string(list_transform(list_sort(list_value({'v': -hook, 'n': 'hook'}, {'v': -completeness, 'n': 'completeness'}, {'v': -payoff, 'n': 'payoff'}, {'v': -clarity, 'n': 'clarity'}))[1:2], lambda x: x.n), ' and ') AS reason FROM {clips}""")
def top14(spark: SparkSession, sf_dir: str) -> DataFrame:
    ordered = F.array_sort(F.array(*[F.struct((-F.col(r)).alias("v"), F.lit(r).alias("n")) for r in RATINGS]))
    return b.clips(spark, sf_dir).select("clip", F.concat(F.lit("Strongest: "), F.array_join(F.transform(F.slice(ordered, 1, 2), lambda x: x["n"]), " and ")).alias("reason"))


@query("win02_rank_select", """SELECT video, clip, row_number() OVER (PARTITION BY video ORDER BY score DESC, clip)::INT AS rank, row_number() OVER (PARTITION BY video ORDER BY score DESC, clip) = 1 AS selected FROM {clips}""")
def win02(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("video").orderBy(F.desc("score"), "clip"))
    return b.clips(spark, sf_dir).withColumn("rank", rank).select("video", "clip", "rank", (F.col("rank") == 1).alias("selected"))


@query("win04_numbered_ids", """SELECT video, clip, printf('%d_candidate_%04d', video, row_number() OVER (PARTITION BY video ORDER BY "start", "end", clip)) AS candidate_id FROM {clips}""")
def win04(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("video").orderBy("start", "end", "clip"))
    return b.clips(spark, sf_dir).select("video", "clip", F.format_string("%d_candidate_%04d", "video", n).alias("candidate_id"))


@query("win05_platform_ranks", """SELECT video, clip, platform, row_number() OVER (PARTITION BY video, platform ORDER BY platform_score DESC, clip)::INT AS platform_rank,
    row_number() OVER (PARTITION BY video ORDER BY CASE platform WHEN 'youtube' THEN 0 WHEN 'instagram' THEN 1 ELSE 2 END, platform_score DESC, clip)::INT AS storage_rank FROM (""" + SCORED + ")")
def win05(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = F.when(F.col("platform") == "youtube", 0).when(F.col("platform") == "instagram", 1).otherwise(2)
    best = [F.desc("platform_score"), F.col("clip")]
    return platformed(spark, sf_dir).select("video", "clip", "platform", F.row_number().over(Window.partitionBy("video", "platform").orderBy(*best)).alias("platform_rank"), F.row_number().over(Window.partitionBy("video").orderBy(plan, *best)).alias("storage_rank"))


@query("win11_first_boundary", """SELECT video, "start", "end", clip FROM (SELECT *, row_number() OVER (PARTITION BY video, "start", "end" ORDER BY score DESC, clip) AS n FROM {clips}) WHERE n = 1""")
def win11(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.min_by("clip", F.struct(-F.col("score"), F.col("clip")))
    return b.clips(spark, sf_dir).groupBy("video", "start", "end").agg(first.alias("clip"))


@query("win13_delivery_norm", """SELECT video, clip, round((u1 + u2 + (1e0 - u3)) / 3e0, 6) AS urgency, round((e1 + e2) / 2e0, 6) AS excitement FROM (SELECT video, clip, """ + ", ".join(f"""CASE WHEN count(*) OVER w < 2 OR max({c}) OVER w = min({c}) OVER w THEN 0.5e0 ELSE (rank() OVER (PARTITION BY video ORDER BY {c}) - 1 + (count(*) OVER (PARTITION BY video, {c}) - 1) / 2e0) / (count(*) OVER w - 1) END AS {a}""" for a, c in (("u1", "urgency"), ("u2", "hook"), ("u3", "payoff"), ("e1", "excitement"), ("e2", "clarity"))) + " FROM {clips} WINDOW w AS (PARTITION BY video))")
def win13(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = lambda c: ranking.mid_percentile(c, ["video"])
    c = b.clips(spark, sf_dir, by_video=True).select("video", "clip", *[p(x).alias(f"p_{x}") for x in ("urgency", "hook", "payoff", "excitement", "clarity")])
    return c.select("video", "clip", six((F.col("p_urgency") + F.col("p_hook") + (1.0 - F.col("p_payoff"))) / 3.0).alias("urgency"), six((F.col("p_excitement") + F.col("p_clarity")) / 2.0).alias("excitement"))


@query("seq12_layered_scores", """SELECT clip, round(score + adjustment + greatest(-0.35e0, least(0.35e0, 0.1e0 * (hook - 3e0) / 2e0)) * sc + 0.05e0 * (clarity - 3e0) / 2e0 * sc, 6) AS final_score, round(sc, 6) AS scale
    FROM (SELECT *, CASE WHEN abs(a + bb) > 0.1e0 THEN 0.1e0 / abs(a + bb) ELSE 1e0 END AS sc FROM (SELECT *, greatest(-0.35e0, least(0.35e0, 0.1e0 * (hook - 3e0) / 2e0)) AS a, 0.05e0 * (clarity - 3e0) / 2e0 AS bb FROM {platformed}))""")
def seq12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layered scores: platform prior, editorial and performance adjustments scaled together to their joint cap."""
    from clipsift.functions.scalars import cap_jointly, clamp

    c = platformed(spark, sf_dir)
    editorial, audience = clamp(0.1 * (F.col("hook") - 3.0) / 2.0, -0.35, 0.35), 0.05 * (F.col("clarity") - 3.0) / 2.0
    a, p = cap_jointly(editorial, audience, 0.1)
    total = editorial + audience
    return c.select("clip", six(F.col("score") + F.col("adjustment") + a + p).alias("final_score"), six(F.when(F.abs(total) > 0.1, 0.1 / F.abs(total)).otherwise(1.0)).alias("scale"))
