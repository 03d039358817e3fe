"""Queries of boundaries, validation, cohorts, trackers and small read models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clipsift.functions import text as T
from clipsift.functions.scalars import iou, six, six_plain
from clipsift.operators import boundaries, learning, ranking, topics
from clipsift.plans import bridges as b
from clipsift.plans.q_clips import _nms_sql
from clipsift.plans.q_joins import IOU
from clipsift.plans.q_sequence import UNITS
from clipsift.plans.registry import query

OPENERS = ", ".join(f"'{w}'" for w in T.REFINEMENT_OPENERS)
DANGLING = ", ".join(f"'{w}'" for w in T.DANGLING)
PHRASES = "|".join(T.REFINEMENT_PHRASES).replace("'", "''")
WORD_FEATURES = f"""SELECT video, pos, "start", "end", least(5e0, greatest(0e0, "start" - coalesce(lag("end") OVER w, "start"))) AS gap_before, least(5e0, greatest(0e0, coalesce(lead("start") OVER w, "end") - "end")) AS gap_after,
  coalesce(regexp_matches(lag(word) OVER w, '{{sentence_end!}}'), false)::INT AS previous_ends, regexp_matches(word, '{{sentence_end!}}')::INT AS ends,
  (lower(regexp_extract(word, '([A-Za-z'']+)', 1)) IN ({OPENERS}))::INT AS opener, (lower(regexp_extract(word, '([A-Za-z'']+)', 1)) IN ({DANGLING}, 'if'))::INT AS dangling,
  regexp_matches(lower(string_agg(word, ' ') OVER (PARTITION BY video ORDER BY pos ROWS BETWEEN 5 PRECEDING AND 6 FOLLOWING)), '{PHRASES}')::INT AS intro_or_ad FROM {{word_rows}} WINDOW w AS (PARTITION BY video ORDER BY pos)"""


@query("mth15_boundary_features", f"SELECT video, pos, round(gap_before, 6) AS gap_before, round(gap_after, 6) AS gap_after, previous_ends::DOUBLE AS previous_ends, ends::DOUBLE AS ends, opener::DOUBLE AS opener, dangling::DOUBLE AS dangling, intro_or_ad::DOUBLE AS intro_or_ad FROM ({WORD_FEATURES})")
def mth15(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = boundaries.featured_words(b.timed_texts(spark, sf_dir))
    return f.select("video", "pos", six_plain(F.col("gap_before")).alias("gap_before"), six_plain(F.col("gap_after")).alias("gap_after"), "previous_ends", "ends", "opener", "dangling", "intro_or_ad")


@query("mth16_boundary_heuristic", f"""SELECT video, pos, round(0.9e0 * least(gap_before / 1.5e0, 1e0) + 1.2e0 * previous_ends - 0.8e0 * opener - 0.035e0 * abs("start" - t) - 1.2e0 * intro_or_ad, 6) AS score FROM ({WORD_FEATURES}) JOIN {{asked}} USING (video) WHERE "start" - t BETWEEN -3.5e0 AND 3.5e0""")
def mth16(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = b.timed(b.texts(spark, sf_dir).join(b.asked(spark, sf_dir).select("video", "t"), "video"))
    met = boundaries.featured_words(texts, lambda x: (x["start"] - F.col("t")).between(-3.5, 3.5))
    return met.select("video", "pos", six(boundaries.heuristic_score("start", F.col("start") - F.col("t"), F.lit(0.0))).alias("score"))


@query("seq16_boundary_queries", f"""SELECT video, count(*) AS options, arg_min(pos, (abs("start" - t), pos)) AS label_pos, count(*) FILTER (abs("start" - t) < 0.5e0) AS near FROM ({WORD_FEATURES}) JOIN {{asked}} USING (video) WHERE "start" - t BETWEEN -35e0 AND 35e0 GROUP BY 1""")
def seq16(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Choice sets of a boundary: the words within 35 s, the nearest as its label."""
    gap = lambda x: F.abs(x["start"] - F.col("t"))
    nearest = lambda w: F.array_min(F.transform(w, lambda x: F.struct(gap(x).alias("gap"), x["pos"].alias("pos"))))["pos"]
    near = lambda w: F.size(F.filter(w, lambda x: gap(x) < 0.5))
    return b.asked_words(spark, sf_dir, lambda x: (x["start"] - F.col("t")).between(-35.0, 35.0), lambda w: [F.size(w).cast("long").alias("options"), nearest(w).alias("label_pos"), near(w).cast("long").alias("near")])


SPOKEN = """SELECT conv_id AS video, turn::INT AS unit, "start", "end", text FROM {segments}"""
UNIT_OPTIONS = f"""SELECT video, unit, "start", "end", 1.2e0 * (tok <> '' AND tok NOT IN ({OPENERS}))::INT + 0.7e0 * greatest(0e0, least(1e0, greatest(0e0, coalesce("start" - lag("end") OVER w, 0e0)) / 1.5e0)) + 0.6e0 * coalesce(lag(done) OVER w, true)::INT - 1.5e0 * regexp_matches(lower(text), '{PHRASES}')::INT AS start_score,
  1.4e0 * done::INT + 0.8e0 * greatest(0e0, least(1e0, greatest(0e0, coalesce(lead("start") OVER w - "end", 0e0)) / 1.5e0)) - 0.7e0 * (coalesce(lower(list_last(regexp_extract_all(text, '[A-Za-z'']+'))), '') IN ({DANGLING}))::INT AS end_score
  FROM (SELECT *, lower(regexp_extract(text, '([A-Za-z'']+)', 1)) AS tok, regexp_matches(text, '{{sentence_end!}}') AS done FROM ({SPOKEN})) WINDOW w AS (PARTITION BY video ORDER BY unit)"""
CASES = "SELECT DISTINCT conv_id AS video, 6e0 AS s, 18e0 AS e FROM conversations"


def _spoken(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.segments(spark, sf_dir).select(F.col("conv_id").alias("video"), F.col("turn").cast("int").alias("unit"), "start", "end", "text")


@query("mth17_option_scores", f"SELECT video, unit, round(start_score, 6) AS start_score, round(end_score, 6) AS end_score FROM ({UNIT_OPTIONS})")
def mth17(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = boundaries.unit_options(_spoken(spark, sf_dir))
    return o.select("video", "unit", six(F.col("start_score")).alias("start_score"), six(F.col("end_score")).alias("end_score"))


#: Detected speech: each turn of a user, a second shorter, and none in every seventh conversation.
SPEECH = """SELECT conv_id AS video, "start" + 0.5e0 AS ss, "end" - 0.5e0 AS se FROM {segments} WHERE role = 'user' AND conv_id % 7 <> 0"""
SPEECH_OPTIONS = f"""WITH sp AS ({SPEECH}), o AS ({SPOKEN}), g AS (SELECT o.*, greatest(0e0, coalesce(o."start" - (SELECT max(se) FROM sp WHERE sp.video = o.video AND se <= o."start" + 0.05e0), 0e0)) AS sb,
  greatest(0e0, coalesce((SELECT min(ss) FROM sp WHERE sp.video = o.video AND ss >= o."end" - 0.05e0) - o."end", 0e0)) AS sa FROM o) """ + UNIT_OPTIONS.replace(f"({SPOKEN})", "g").replace('greatest(0e0, coalesce("start"', 'greatest(sb, coalesce("start"').replace("greatest(0e0, coalesce(lead", "greatest(sa, coalesce(lead")


@query("mth17_speech_options", f"SELECT video, unit, round(start_score, 6) AS start_score, round(end_score, 6) AS end_score FROM ({SPEECH_OPTIONS})")
def mth17_speech(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Option scores whose pauses also count silence between detected intervals of speech."""
    speech = b.segments(spark, sf_dir).where("role = 'user' AND conv_id % 7 <> 0").select(F.col("conv_id").alias("video"), (F.col("start") + 0.5).alias("start"), (F.col("end") - 0.5).alias("end"))
    o = boundaries.unit_options(_spoken(spark, sf_dir), speech)
    return o.select("video", "unit", six(F.col("start_score")).alias("start_score"), six(F.col("end_score")).alias("end_score"))


@query("ml17_refined_boundaries", f"""WITH o AS ({UNIT_OPTIONS}), c AS ({CASES}), st AS (SELECT video, s, e, "start" AS rs, start_score - 0.55e0 * least(abs("start" - s) / 12e0, 1e0) AS ss FROM o JOIN c USING (video) WHERE abs("start" - s) <= 12e0),
  en AS (SELECT video, "end" AS re, end_score - 0.55e0 * least(abs("end" - e) / 12e0, 1e0) AS es FROM o JOIN c USING (video) WHERE abs("end" - e) <= 12e0),
  p AS (SELECT *, round(ss + es - 0.35e0 * abs((re - rs) - (e - s)) / greatest(e - s, 1e0), 9) AS score, round(abs(rs - s) + abs(re - e), 9) AS moved FROM st JOIN en USING (video) WHERE re - rs BETWEEN 5e0 AND 40e0 AND greatest(0e0, least(re, e) - greatest(rs, s)) >= least(5e0, (e - s) * 0.25e0))
  SELECT video, round(arg_max(rs, (score, -moved, -rs, -re)), 6) AS refined_start, round(arg_max(re, (score, -moved, -rs, -re)), 6) AS refined_end, round(max(score), 6) AS score FROM p GROUP BY 1""")
def ml17(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _spoken(spark, sf_dir)
    cases = s.select("video").distinct().select("video", F.lit(6.0).alias("s"), F.lit(18.0).alias("e"))
    r = boundaries.refine(boundaries.unit_options(s), cases, 12.0, 5.0, 40.0)
    return r.select("video", six(F.col("refined_start")).alias("refined_start"), six(F.col("refined_end")).alias("refined_end"), six(F.col("score")).alias("score"))


@query("agg18_recall_at_k", _nms_sql("SELECT * FROM {clips}", 'score DESC, "start", clip', 5, "0.5e0") + f""" SELECT k::INT AS k, round(avg(hit), 6) AS recall FROM (SELECT l.label_id, k, max(CASE WHEN c.rank <= k AND {IOU} >= 0.5e0 THEN 1 ELSE 0 END) AS hit FROM {{labels_iv}} l JOIN (SELECT video, rank, t.s AS "start", t.e AS "end" FROM picked) c USING (video), (SELECT unnest([1, 3, 5]) AS k) WHERE l.priority <= 2 GROUP BY 1, 2) GROUP BY 1""")
def agg18(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = ranking.greedy_diverse(b.clips(spark, sf_dir).select("video", "clip", "start", "end", "score"), ["video"], [("score", True), ("start", False), ("clip", False)], 5, 0.5)
    l = b.labels_iv(spark, sf_dir).where("priority <= 2").select("video", "label_id", F.col("start").alias("ls"), F.col("end").alias("le"))
    first = kept.join(l, "video").groupBy("label_id").agg(F.min(F.when(iou(F.col("start"), F.col("end"), F.col("ls"), F.col("le")) >= 0.5, F.col("rank"))).alias("r"))
    hits = first.agg(F.array(*[F.struct(F.lit(k).alias("k"), F.avg(F.coalesce(F.col("r") <= k, F.lit(False)).cast("int")).alias("recall")) for k in (1, 3, 5)]).alias("h"))
    return hits.select(F.explode("h").alias("h")).select("h.k", six(F.col("h.recall")).alias("recall"))


@query("agg41_community_terms", f"""WITH t AS (SELECT doc_id, source, lang, list_filter(regexp_extract_all(lower(text), '[a-z0-9][a-z0-9''-]{{2,}}'), lambda x: NOT list_contains([{", ".join(f"'{w}'" for w in T.TREND_STOPWORDS)}], x)) AS w FROM {{candidates}}),
  e AS (SELECT DISTINCT doc_id, source, lang, unnest(list_concat(w, CASE WHEN len(w) > 1 THEN list_transform(list_zip(w[1:len(w)-1], w[2:]), lambda x: x[1] || ' ' || x[2]) ELSE [] END)) AS term FROM t),
  a AS (SELECT lang, term, sum(quality * 2 - 1 - doc_id % 3)::BIGINT AS association, count(DISTINCT source) AS creator_support, count(*) AS clip_support FROM e JOIN labels USING (doc_id) GROUP BY 1, 2)
  SELECT lang, term, creator_support, clip_support, association, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY association DESC, creator_support DESC, term) AS rank FROM a WHERE creator_support >= 2 AND association > 0) WHERE rank <= 6""")
def agg41(spark: SparkSession, sf_dir: str) -> DataFrame:
    examples = b.candidates(spark, sf_dir).join(b.table(spark, sf_dir, "labels"), "doc_id").withColumn("outcome", F.col("quality") * 2 - 1 - F.col("doc_id") % 3)
    return topics.community_trends(examples, "lang", "source", "text", "outcome", 6)


@query("jon04_review_join", "SELECT l.doc_id, d.source, l.quality, abs(d.n_chars - length(d.text)) > 1e-6 AS disagrees FROM labels l JOIN documents d USING (doc_id) JOIN (SELECT item_id AS doc_id FROM benchmark UNION SELECT doc_id FROM documents WHERE doc_id % 2 = 0) q USING (doc_id)")
def jon04(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, l = b.table(spark, sf_dir, "documents"), b.table(spark, sf_dir, "labels")
    queue = b.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id")).union(d.where("doc_id % 2 = 0").select("doc_id")).distinct()
    return l.join(d, "doc_id").join(queue, "doc_id", "left_semi").select("doc_id", "source", "quality", (F.abs(F.col("n_chars") - F.length("text")) > 1e-6).alias("disagrees"))


@query("jon06_coverage_report", "SELECT 'matched' AS side, count(*) AS n FROM documents JOIN labels USING (doc_id) UNION ALL SELECT 'missing', count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT 'extra', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)")
def jon06(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One full outer join answers all three."""
    d = b.table(spark, sf_dir, "documents").select("doc_id", F.lit(1).alias("d"))
    l = b.table(spark, sf_dir, "labels").select("doc_id", F.lit(1).alias("l"))
    both = d.join(l, "doc_id", "full").agg(*[F.count_if(c).alias(n) for n, c in (("matched", F.col("d").isNotNull() & F.col("l").isNotNull()), ("missing", F.col("l").isNull()), ("extra", F.col("d").isNull()))])
    return both.unpivot([], ["matched", "missing", "extra"], "side", "n")


@query("jon08_cohort_overlap", "SELECT count(*) AS shared FROM (SELECT source FROM documents WHERE doc_id % 2 = 0 INTERSECT SELECT source FROM documents WHERE doc_id % 2 = 1 AND lang = 'de')")
def jon08(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = b.table(spark, sf_dir, "documents")
    return d.where("doc_id % 2 = 0").select("source").intersect(d.where("doc_id % 2 = 1 and lang = 'de'").select("source")).agg(F.count(F.lit(1)).alias("shared"))


@query("jon24_nocase", "SELECT count(*) AS n FROM customer a JOIN (SELECT DISTINCT upper(c_mktsegment) AS seg FROM customer) s ON lower(a.c_mktsegment) = lower(s.seg)")
def jon24(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = b.table(spark, sf_dir, "customer")
    s = c.select(F.upper("c_mktsegment").alias("seg")).distinct().select(F.lower("seg").alias("k"))
    return c.withColumn("k", F.lower("c_mktsegment")).join(s, "k").agg(F.count(F.lit(1)).alias("n"))


@query("win07_round_robin", "SELECT video, clip, slot::INT AS slot, row_number() OVER (PARTITION BY video % 50 ORDER BY slot, video, clip)::INT AS place FROM (SELECT video, clip, row_number() OVER (PARTITION BY video ORDER BY score DESC, clip) AS slot FROM {clips})")
def win07(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clips of a batch of videos in turn: everybody's first, then everybody's second."""
    c = b.clips(spark, sf_dir).withColumn("slot", F.row_number().over(Window.partitionBy("video").orderBy(F.desc("score"), "clip")))
    return c.select("video", "clip", "slot", F.row_number().over(Window.partitionBy(F.col("video") % 50).orderBy("slot", "video", "clip")).alias("place"))


@query("win10_running_valid", "SELECT creator, count(*) FILTER (value < prev) AS violations FROM (SELECT creator, value, last_value(CASE WHEN value < 60 THEN value END IGNORE NULLS) OVER (PARTITION BY creator ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM {feedback}) GROUP BY 1")
def win10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order against the last value that was valid."""
    before = Window.partitionBy("creator").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1)
    e = b.feedback(spark, sf_dir).withColumn("prev", F.last(F.when(F.col("value") < 60, F.col("value")), ignorenulls=True).over(before))
    return e.groupBy("creator").agg(F.count_if(F.col("value") < F.col("prev")).alias("violations"))


@query("top12_next_pending", "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) ORDER BY doc_id LIMIT 50")
def top12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.table(spark, sf_dir, "documents").select("doc_id", "source").join(b.table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti").orderBy("doc_id").limit(50)


@query("top15_oldest_claimable", "SELECT event_id, creator FROM {feedback} WHERE event_type = 'presented' ORDER BY display_rank, ts, event_id LIMIT 1")
def top15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.feedback(spark, sf_dir).where("event_type = 'presented'").orderBy("display_rank", "ts", "event_id").select("event_id", "creator").limit(1)


@query("set04_cohort_split", "SELECT CASE WHEN l.doc_id IS NULL THEN 'promoted' ELSE 'original' END AS cohort, count(*) AS n FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id) GROUP BY 1")
def set04(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, l = b.table(spark, sf_dir, "documents").select("doc_id"), b.table(spark, sf_dir, "labels").select("doc_id").distinct().withColumn("in", F.lit(True))
    return d.join(l, "doc_id", "left").groupBy(F.when(F.col("in"), "original").otherwise("promoted").alias("cohort")).agg(F.count(F.lit(1)).alias("n"))


@query("set06_word_overlap", "SELECT a.conv_id, a.turn, len(list_intersect(list_distinct(string_split(lower(a.text), ' ')), list_distinct(string_split(lower(o.text), ' ')))) AS shared FROM {segments} a JOIN {segments} o ON a.conv_id = o.conv_id AND o.turn = a.turn + 1")
def set06(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = b.segments(spark, sf_dir).select("conv_id", "turn", F.split(F.lower("text"), " ").alias("w"))
    other = s.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("w").alias("v"))
    return s.join(other, ["conv_id", "turn"]).select("conv_id", "turn", F.size(F.array_intersect("w", "v")).cast("long").alias("shared"))


@query("str05_edge_tokens", "SELECT doc_id, lower(regexp_extract(text, '([A-Za-z'']+)', 1)) AS first_token, coalesce(lower(list_last(regexp_extract_all(text, '[A-Za-z'']+'))), '') AS last_token FROM {candidates}")
def str05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.candidates(spark, sf_dir).select("doc_id", boundaries.plain(F.col("text")).alias("first_token"), boundaries.last_plain(F.col("text")).alias("last_token"))


@query("str14_topic_terms", "SELECT doc_id, len(w) AS words, len(list_distinct(w)) AS distinct_words FROM (SELECT doc_id, list_filter(list_transform(regexp_extract_all(text, '[a-zA-Z0-9'']+'), lambda x: lower(x)), lambda x: length(x) >= 3 AND NOT list_contains([" + ", ".join(f"'{w}'" for w in T.TOPIC_STOPWORDS) + "], x)) AS w FROM {candidates})")
def str14(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = b.candidates(spark, sf_dir).select("doc_id", T.topic_words(F.col("text")).alias("w"))
    return c.select("doc_id", F.size("w").cast("long").alias("words"), F.size(F.array_distinct("w")).cast("long").alias("distinct_words"))


@query("str20_active_caption", "WITH u AS (" + UNITS + """) SELECT a.video, min(unit) AS cue FROM {asked} a JOIN u ON u.video = a.video AND u."start" <= a.t AND a.t <= u."end" GROUP BY 1""")
def str20(spark: SparkSession, sf_dir: str) -> DataFrame:
    from clipsift.operators.sequence import sentence_units

    u = sentence_units(b.word_rows(spark, sf_dir))
    met = u.join(b.asked(spark, sf_dir).select("video", "t"), "video").where("start <= t and t <= end")
    return met.groupBy("video").agg(F.min("unit").alias("cue"))


@query("str22_insight", "SELECT creator, 'Learned from ' || count(*) || ' clips; ' || CASE WHEN avg(views) >= 250 THEN 'reach is high' ELSE 'reach is low' END || '. These are associations, not causes.' AS insight FROM {performance} GROUP BY 1")
def str22(spark: SparkSession, sf_dir: str) -> DataFrame:
    reach = F.when(F.avg("views") >= 250, "reach is high").otherwise("reach is low")
    return b.performance(spark, sf_dir).groupBy("creator").agg(F.concat(F.lit("Learned from "), F.count(F.lit(1)), F.lit(" clips; "), reach, F.lit(". These are associations, not causes.")).alias("insight"))


@query("mth09_watch_hours", "SELECT clip, round(coalesce(hours, minutes / 60e0, seconds / 3600e0), 6) AS watch_hours FROM (SELECT clip, CASE WHEN clip % 3 = 0 THEN views * 0.01e0 END AS hours, CASE WHEN clip % 3 = 1 THEN views * 0.6e0 END AS minutes, CASE WHEN clip % 2 = 0 THEN views * 36e0 END AS seconds FROM {performance})")
def mth09(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, c = F.col("views"), F.col("clip")
    hours = F.coalesce(F.when(c % 3 == 0, v * 0.01), F.when(c % 3 == 1, v * 0.6) / 60.0, F.when(c % 2 == 0, v * 36.0) / 3600.0)
    return b.performance(spark, sf_dir).select("clip", six(hours).alias("watch_hours"))


@query("mth10_retention_ratio", "SELECT clip, round(CASE WHEN average_view_percentage > 1e0 THEN average_view_percentage / 100e0 ELSE average_view_percentage END, 6) AS ratio FROM {performance}")
def mth10(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("average_view_percentage")
    return b.performance(spark, sf_dir).select("clip", six(F.when(p > 1, p / 100.0).otherwise(p)).alias("ratio"))


@query("mth12_joint_cap", "SELECT clip, round(a * s, 6) AS structured, round(x * s, 6) AS semantic FROM (SELECT *, CASE WHEN abs(a + x) > 0.25e0 THEN 0.25e0 / abs(a + x) ELSE 1e0 END AS s FROM (SELECT clip, (hook - 3e0) / 10e0 AS a, (clarity - 3e0) / 10e0 AS x FROM {clips}))")
def mth12(spark: SparkSession, sf_dir: str) -> DataFrame:
    from clipsift.functions.scalars import cap_jointly

    a, x = cap_jointly((F.col("hook") - 3.0) / 10.0, (F.col("clarity") - 3.0) / 10.0, 0.25)
    return b.clips(spark, sf_dir).select("clip", six(a).alias("structured"), six(x).alias("semantic"))


@query("mth18_export_dimensions", "SELECT p_partkey, greatest(2, round_even(w * s, 0)::INT // 2 * 2)::INT AS width, greatest(2, round_even(h * s, 0)::INT // 2 * 2)::INT AS height FROM (SELECT *, least(1e0, 1920e0 / greatest(w, h)) AS s FROM (SELECT p_partkey, (p_size * 97 + 100)::INT AS w, (p_partkey % 3000 + 50)::INT AS h FROM part))")
def mth18(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = b.table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 97 + 100).alias("w"), (F.col("p_partkey") % 3000 + 50).alias("h"))
    scale = F.least(F.lit(1.0), 1920.0 / F.greatest("w", "h"))
    even = lambda c: F.greatest(F.lit(2), F.floor(F.bround(F.col(c) * scale, 0) / 2) * 2).cast("int")
    return p.select("p_partkey", even("w").alias("width"), even("h").alias("height"))


@query("flt10_plan_rules", "SELECT o_orderkey, o_orderpriority IN ('1-URGENT', '2-HIGH', '5-LOW') AND (n IS NULL OR n BETWEEN 1 AND 8) AS valid FROM (SELECT o_orderkey, o_orderpriority, nullif(o_custkey % 12, 0) AS n FROM orders)")
def flt10(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.nullif(F.col("o_custkey") % 12, F.lit(0))
    return b.table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderpriority").isin("1-URGENT", "2-HIGH", "5-LOW") & (n.isNull() | n.between(1, 8))).alias("valid"))


@query("flt12_single_video", "SELECT creator, count(DISTINCT clip) <= 10 AS few FROM {feedback} GROUP BY 1")
def flt12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.feedback(spark, sf_dir).groupBy("creator").agg((F.count_distinct("clip") <= 10).alias("few"))


@query("flt15_evidence_gate", "SELECT creator, CASE WHEN count(*) >= 300 AND max(views) > min(views) THEN round(avg(views), 6) ELSE 0e0 END AS active FROM {performance} GROUP BY 1")
def flt15(spark: SparkSession, sf_dir: str) -> DataFrame:
    gate = (F.count(F.lit(1)) >= 300) & (F.max("views") > F.min("views"))
    return b.performance(spark, sf_dir).groupBy("creator").agg(F.when(gate, six(F.avg("views"))).otherwise(0.0).alias("active"))


@query("oth07_video_read_model", """SELECT l.video, l.priority, coalesce(n, 0) AS clips, clip_list FROM {labels_iv} l LEFT JOIN (SELECT video, count(*) AS n, string_agg(clip, ',' ORDER BY score DESC, clip) AS clip_list FROM {clips} GROUP BY 1) c USING (video)""")
def oth07(spark: SparkSession, sf_dir: str) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("k"), F.col("clip"))))
    c = b.clips(spark, sf_dir).groupBy("video").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(ordered, lambda x: x["clip"]), ",").alias("clip_list"))
    return b.labels_iv(spark, sf_dir).select("video", "priority").join(c, "video", "left").select("video", "priority", F.coalesce("n", F.lit(0)).alias("clips"), "clip_list")


@query("oth13_text_corpus", "SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS position, doc_id FROM documents WHERE trim(text) <> ''")
def oth13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source's texts that aren't blank, in order: a row each, as a source may hold most of a corpus."""
    from clipsift.operators.ranking import positions

    return positions(b.table(spark, sf_dir, "documents").where(F.trim("text") != "").select("source", "doc_id"), ["source"], "doc_id")


@query("ml02_balanced_ridge")
def ml02(spark: SparkSession, sf_dir: str) -> DataFrame:
    from clipsift.operators.models import balanced_ridge

    p = b.judged(spark, sf_dir).select("grp", F.array("predicted", "challenger").alias("x"), "actual")
    return balanced_ridge(p, "grp", "x", "actual", prior=8.0)


@query("ml05_logistic_gate")
def ml05(spark: SparkSession, sf_dir: str) -> DataFrame:
    from clipsift.operators.models import logistic_gate

    p = b.judged(spark, sf_dir).select(F.array(F.col("predicted") / 10.0, F.col("challenger") / 13.0).alias("x"), (F.col("actual") >= 4).cast("double").alias("y"))
    return logistic_gate(p, "x", "y", l2=0.1)


@query("src10_tracker_rows", "SELECT s.key, sum(views)::BIGINT AS views, count(*) AS clips, CASE WHEN s.key = 'S3' THEN 'holdout' ELSE 'reference' END AS role FROM (SELECT 'S' || n_nationkey AS key FROM nation WHERE n_nationkey < 5) s JOIN (SELECT 'S' || c_nationkey AS key, c_custkey % 90 * 100 AS views FROM customer) c USING (key) GROUP BY 1")
def src10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tracker of shorts (ids, compact counts) matched to its sources and parted into reference and holdout."""
    from clipsift.sources.tracker import tracker_clips

    rows = b.table(spark, sf_dir, "customer").select(F.concat(F.lit("S"), "c_nationkey", F.lit("_clip"), "c_custkey").alias("video_id"), F.concat((F.col("c_custkey") % 90) / 10.0, F.lit("K")).alias("views"))
    found = tracker_clips(rows, ["S0", "S1", "S2", "S4"], "S3")
    return found.groupBy(F.col("source_key").alias("key")).agg(F.sum("views").alias("views"), F.count(F.lit(1)).alias("clips"), F.max("role").alias("role"))
