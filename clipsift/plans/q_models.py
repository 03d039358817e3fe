"""Queries of feature vectors, semantic boundary options and cross-validated models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clipsift.functions import text as T
from clipsift.functions.scalars import six
from clipsift.operators import semantic, validation
from clipsift.plans import bridges as b
from clipsift.plans.registry import query

_TOK_SQL = "len(list_transform(regexp_extract_all(text, '[a-zA-Z0-9'']+'), lambda x: lower(x)))"
#: Of the queue's text words are tokens and sentences are stops, and what is built on them follows.
_QUEUE_SQL = f"""queue AS (SELECT doc_id, duration, tokens, stops, CASE WHEN duration > 0 THEN tokens / duration ELSE 0e0 END AS rate
  FROM (SELECT doc_id, duration, {_TOK_SQL} AS tokens, greatest(1, len(regexp_extract_all(text, '[.!?]["''”’)]*(\\s|$)'))) AS stops FROM {{candidates}} WHERE length(trim(text)) > 0))"""


@query("oth02_feature_vector", f"""WITH {_QUEUE_SQL} SELECT f.doc_id, round(f.duration, 6) AS duration_seconds, f.word_count::DOUBLE AS word_count, f.sentence_count::DOUBLE AS sentence_count, {", ".join(f"round({c}, 6) AS {c}" for c in T.FEATURES)},
  q.tokens::DOUBLE AS queue_word_count, q.stops::DOUBLE AS queue_sentence_count, round(q.rate, 6) AS queue_words_per_second, round(greatest(0e0, least(1e0, 1e0 - abs(q.rate - 2.5e0) / 1.5e0)), 6) AS queue_density_fit,
  round(greatest(0e0, least(1e0, 1e0 - abs(q.stops - 5) / 7e0)), 6) AS queue_structure_fit FROM {{features}} f LEFT JOIN queue q USING (doc_id)""")
def oth02(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 15 features from a candidate, and those that differ where only the queue's text is left."""
    c = b.candidates(spark, sf_dir).withColumn("tok", T.tokens(F.col("text")))
    own = T.model_vector(F.col("text"), F.col("tok"), F.col("duration"), F.col("word_count"), F.col("sentence_count"))
    both = c.select("doc_id", own.alias("x"), T.queue_vector(F.col("text"), F.col("tok"), F.col("duration")).alias("q"))
    at = {name: i for i, name in enumerate(T.MODEL_FEATURES)}
    again = ("word_count", "sentence_count", "words_per_second", "density_fit", "structure_fit")
    return both.select("doc_id", *[six(F.get("x", F.lit(i))).alias(n) for n, i in at.items()], *[six(F.get("q", F.lit(at[n]))).alias(f"queue_{n}") for n in again])


_TARGETS = ("hook", "completeness", "payoff", "clarity")
_DIMENSION = 64


def _weight(target: int, i: int) -> float:
    return (0.1, -0.05)[i] if i < 2 else (((i - 2) * 7 + target * 3) % 11 - 5) / 10.0


_SCORE_SQL = ", ".join(
    f"""CASE WHEN valid THEN {3 + 0.1 * k}e0 + {_weight(k, 0)}e0 * ((e - s - 15e0) / 8e0) + {_weight(k, 1)}e0 * ((words - 40e0) / 25e0)
    + list_sum(list_transform(range(1, {_DIMENSION + 1}), lambda i: unit[i] * ((((i - 1) * 7 + {3 * k}) % 11 - 5) / 10e0))) ELSE 1e0 END AS {t}_score"""
    for k, t in enumerate(_TARGETS)
)


@query("seq17_semantic_options", f"""WITH n AS (SELECT max(vec_id) + 1 AS n FROM embeddings),
  parts AS (SELECT g.conv_id AS video, g.turn, g."start", g."end", len(list_filter(string_split(g.text, ' '), lambda w: w <> '')) AS words, v.v FROM {{segments}} g, n JOIN {{vectors}} v ON v.vec_id = (g.conv_id * 8 + g.turn) % n.n),
  o AS (SELECT video, 'start' AS kind, turn AS option, "start" AS s, 20e0 + video % 3 AS e, abs("start" - (5e0 + video % 3)) AS away FROM parts WHERE abs("start" - (5e0 + video % 3)) <= 12e0
    UNION ALL SELECT video, 'end', turn, 5e0 + video % 3, "end", abs("end" - (20e0 + video % 3)) FROM parts WHERE abs("end" - (20e0 + video % 3)) <= 12e0),
  c AS (SELECT o.video, kind, option, s, e, away, i, sum(v[i]) AS x, sum(words) AS words, count(v) AS n FROM o CROSS JOIN (SELECT unnest(range(1, {_DIMENSION + 1})) AS i) LEFT JOIN parts p ON p.video = o.video AND p."end" > s AND p."start" < e GROUP BY ALL),
  u AS (SELECT video, kind, option, s, e, away, e > s AND min(n) > 0 AS valid, CASE WHEN e > s THEN coalesce(min(words), 0)::DOUBLE ELSE 0e0 END AS words, sqrt(sum(x * x)) AS size, list(x ORDER BY i) AS total FROM c GROUP BY video, kind, option, s, e, away),
  r AS (SELECT *, {_SCORE_SQL} FROM (SELECT *, list_transform(total, lambda x: x / size) AS unit FROM u)),
  z AS (SELECT *, (0e0 + {" + ".join(f"{t}_score" for t in _TARGETS)}) / {len(_TARGETS)} AS quality_score FROM r),
  f AS (SELECT video, kind, arg_min(struct_pack(ok := valid, unit := unit, {", ".join(f"{t} := {t}_score" for t in (*_TARGETS, "quality"))}), (away, option)) AS f FROM z GROUP BY 1, 2)
  SELECT video, kind, option, valid, words, round(CASE WHEN valid AND f.ok THEN list_inner_product(z.unit, f.unit) ELSE 0e0 END, 6) AS similarity,
  {", ".join(f"round({t}_score, 6) AS {t}_score, round(CASE WHEN f.ok THEN {t}_score - f.{t} END, 6) AS {t}_delta" for t in (*_TARGETS, "quality"))} FROM z JOIN f USING (video, kind)""")
def seq17(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole clip that each option of a boundary would give, scored by a frozen model, against the clip as it is."""
    vectors = b.vectors(spark, sf_dir).select("vec_id", "v")
    n = vectors.agg(F.max("vec_id")).head()[0] + 1
    g = b.segments(spark, sf_dir).withColumn("vec_id", (F.col("conv_id") * 8 + F.col("turn")) % n).join(vectors, "vec_id")
    parts = g.select(F.col("conv_id").alias("video"), "turn", "start", "end", F.size(F.filter(F.split("text", " "), lambda w: w != "")).alias("words"), "v")
    s0, e0 = 5.0 + F.col("video") % 3, 20.0 + F.col("video") % 3
    starts = parts.select("video", F.lit("start").alias("kind"), F.col("turn").alias("option"), F.col("start").alias("s"), e0.alias("e"), F.abs(F.col("start") - s0).alias("away"))
    ends = parts.select("video", F.lit("end").alias("kind"), F.col("turn").alias("option"), s0.alias("s"), F.col("end").alias("e"), F.abs(F.col("end") - e0).alias("away"))
    options = starts.unionByName(ends).where("away <= 12")
    weights = {t: (3 + 0.1 * k, [_weight(k, i) for i in range(_DIMENSION + 2)]) for k, t in enumerate(_TARGETS)}
    found = semantic.semantic_options(options, parts, "video", ["kind"], "option", "v", _DIMENSION, [15.0, 40.0] + [0.0] * _DIMENSION, [8.0, 25.0] + [1.0] * _DIMENSION, weights)
    scored = [f"{t}_{c}" for t in (*_TARGETS, "quality") for c in ("score", "delta")]
    return found.select("video", "kind", "option", "valid", "words", *[six(F.col(c)).alias(c) for c in ("similarity", *scored)])


def _represented(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents in groups of one source and language, with handcrafted, semantic and delivery features and two targets."""
    # texts meet their labels before their features are found, as most have none
    j = b.judged(spark, sf_dir).select("doc_id", "actual", "predicted", "challenger")
    c = b.candidates(spark, sf_dir).join(j, "doc_id").withColumn("tok", T.tokens(F.col("text")))
    c = c.withColumn("handcrafted", T.model_vector(F.col("text"), F.col("tok"), F.col("duration"), F.col("word_count"), F.col("sentence_count"))).drop("text", "tok")
    vectors = b.vectors(spark, sf_dir).select("vec_id", F.col("v").alias("semantic"))
    n = vectors.agg(F.max("vec_id")).head()[0] + 1
    group = F.concat_ws("/", "source", "lang", (F.col("doc_id") % 16).cast("string"))
    met = c.withColumn("vec_id", F.col("doc_id") % n).join(vectors, "vec_id")
    return met.select("doc_id", group.alias("grp"), "handcrafted", "semantic", F.array("predicted", "challenger", F.col("predicted") * F.col("challenger")).alias("delivery"), "actual", (6.0 - F.col("actual") + F.col("doc_id") % 2).alias("second"))


ABLATED = {
    "delivery_ridge": ("delivery",),
    "handcrafted_ridge": ("handcrafted",),
    "semantic_ridge": ("semantic",),
    "text_semantic_ridge": ("handcrafted", "semantic"),
    "semantic_delivery_ridge": ("semantic", "delivery"),
    "full_ridge": ("handcrafted", "semantic", "delivery"),
}


@query("ml08_ablation")
def ml08(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six representations on the same folds, from one sum of products; the rule picks between the two contestants."""
    found = validation.ablation(_represented(spark, sf_dir), "grp", "doc_id", ["handcrafted", "semantic", "delivery"], ABLATED, ["actual", "second"], folds=4, alpha=10.0, seed=42)
    return validation.ablation_report(found, "grp", "doc_id", ["text_semantic_ridge", "full_ridge"])


@query("ml07_gate_folds")
def ml07_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-of-fold probabilities that a document is rated 4 or more."""
    j = b.judged(spark, sf_dir).select(F.concat_ws("/", "grp", F.col("doc_id") % 16).alias("grp"), "doc_id", F.array(F.col("predicted") / 10.0, F.col("challenger") / 13.0).alias("x"), (F.col("actual") >= 4).cast("double").alias("y"))
    return validation.gate_folds(j, "grp", "doc_id", "x", "y", folds=4, l2=0.1, seed=42)


@query("ml07_preference_folds")
def ml07_preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-of-fold scores of pairwise preference models."""
    j = b.judged(spark, sf_dir).select(F.concat_ws("/", "grp", F.col("doc_id") % 16).alias("grp"), "doc_id", F.array(F.col("predicted") / 10.0, F.col("challenger") / 13.0).alias("x"), "actual")
    return validation.preference_folds(j, "grp", "doc_id", "x", "actual", folds=4, l2=0.1, seed=42)


@query("ml07_choice_folds")
def ml07_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-of-fold scores of which of a video's clips starts nearest to its label."""
    o = b.clips(spark, sf_dir).join(b.labels_iv(spark, sf_dir).select("video", F.col("start").alias("truth")), "video")
    o = o.select("video", F.col("video").alias("query"), "clip", F.array("hook", "completeness", "clarity", F.col("start") / 100.0).alias("x"), F.abs(F.col("start") - F.col("truth")).alias("distance"))
    return validation.choice_folds(o, "video", "query", "clip", "x", "distance", folds=4, l2=0.1, seed=42)
