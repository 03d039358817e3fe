"""Queries over embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clipsift.functions.scalars import six
from clipsift.operators import learning, vectors
from clipsift.plans import bridges as b
from clipsift.plans.registry import query


@query("vec01_normalize", "SELECT vec_id, round(sqrt(list_sum(list_transform(v, lambda x: x * x))), 5) AS size, round(v[1] / sqrt(list_sum(list_transform(v, lambda x: x * x))), 5) AS first_component FROM {vectors}")
def vec01(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.vectors(spark, sf_dir).select("vec_id", F.round(vectors.norm(F.col("v")), 5).alias("size"), F.round(F.get(vectors.normalized(F.col("v")), F.lit(0)), 5).alias("first_component"))


@query("vec02_cosine_to_next", "SELECT a.vec_id, round(list_dot_product(a.v, b.v), 5) AS similarity FROM {vectors} a JOIN {vectors} b ON b.vec_id = a.vec_id + 1")
def vec02(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = b.vectors(spark, sf_dir)
    other = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w"))
    return v.join(other, "vec_id").select("vec_id", F.round(vectors.dot(F.col("v"), F.col("w")), 5).alias("similarity"))


@query("vec05_dimensions", "SELECT grp, count(DISTINCT len(v)) = 1 AS consistent, max(len(v)) AS dimension FROM {vectors} GROUP BY 1")
def vec05(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.vectors(spark, sf_dir).groupBy("grp").agg((F.count_distinct(F.size("v")) == 1).alias("consistent"), F.max(F.size("v")).cast("long").alias("dimension"))


@query("vec03_kernel_outcome", "SELECT a.vec_id, round(greatest(-0.15e0, least(0.15e0, 0.15e0 * count(*) / (count(*) + 12e0) * sum(exp((list_dot_product(a.v, e.v) - 1e0) / 0.12e0) * e.outcome) / sum(exp((list_dot_product(a.v, e.v) - 1e0) / 0.12e0)))), 5) AS adjustment FROM {vectors} a JOIN {vectors} e ON a.grp = e.grp GROUP BY 1")
def vec03(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = b.vectors(spark, sf_dir)
    found = vectors.kernel_outcome(v, v, "vec_id", "v", "outcome", "grp")
    return found.select("vec_id", F.round("adjustment", 5).alias("adjustment"))


WEIGHTS = {t: (3.0 + k / 10.0, [((i * (k + 3)) % 7 - 3) / 10.0 for i in range(64)]) for k, t in enumerate(("t1", "t2", "t3", "t4"))}
MEANS, SCALES = [(i % 5) / 100.0 for i in range(64)], [1.0 + (i % 3) / 10.0 for i in range(64)]
_list = lambda xs: "[" + ", ".join(f"{x!r}e0" for x in xs) + "]"
_score = lambda t: f"list_dot_product(z, {_list(WEIGHTS[t][1])}) + {WEIGHTS[t][0]!r}e0"


@query("vec06_linear_score", f"SELECT vec_id, {', '.join(f'round({_score(t)}, 5) AS {t}' for t in WEIGHTS)}, round(({' + '.join(f'({_score(t)})' for t in WEIGHTS)}) / 4e0, 5) AS quality FROM (SELECT vec_id, list_transform(list_zip(v, {_list(MEANS)}, {_list(SCALES)}), lambda x: (x[1] - x[2]) / x[3]) AS z FROM {{vectors}})")
def vec06(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = vectors.linear_scores(F.col("v"), MEANS, SCALES, WEIGHTS)
    quality = sum(s.values(), F.lit(0.0)) / 4.0
    return b.vectors(spark, sf_dir).select("vec_id", *[F.round(c, 5).alias(t) for t, c in s.items()], F.round(quality, 5).alias("quality"))


@query("vec07_fusion", "SELECT vec_id, len(list_concat(v, [outcome])) AS width, round(list_sum(list_concat(v, [outcome])), 5) AS total FROM {vectors}")
def vec07(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = F.concat("v", F.array("outcome"))
    return b.vectors(spark, sf_dir).select("vec_id", F.size(both).cast("long").alias("width"), F.round(F.aggregate(both, F.lit(0.0), lambda a, x: a + x), 5).alias("total"))


@query("agg37_centroid", "WITH p AS (SELECT grp, unnest(v) AS x, unnest(range(len(v)))::INT AS pos FROM {vectors}), m AS (SELECT grp, pos, avg(x) AS m FROM p GROUP BY 1, 2), s AS (SELECT grp, sqrt(sum(m * m)) AS size FROM m GROUP BY 1) SELECT grp, pos, round(m / size, 5) AS value FROM m JOIN s USING (grp)")
def agg37(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.centroids(b.vectors(spark, sf_dir), "grp", "v").select("grp", "pos", F.round("value", 5).alias("value"))


SIGNATURE = """SELECT creator, field, avg(x) AS x FROM (SELECT creator, 'average_view_percentage' AS field, average_view_percentage / 100e0 AS x FROM {performance} UNION ALL SELECT creator, 'completion', completion_rate_percentage / 100e0 FROM {performance}
  UNION ALL SELECT creator, 'length', ln(1e0 + duration / 60e0) FROM {performance}) WHERE x IS NOT NULL GROUP BY 1, 2"""


def signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of each rate that a creator has, and of the log of minutes."""
    values = {"average_view_percentage": F.col("average_view_percentage") / 100.0, "completion": F.col("completion_rate_percentage") / 100.0, "length": F.log1p(F.col("duration") / 60.0)}
    return learning.long_form(b.performance(spark, sf_dir), ["creator"], values, "field", "x").groupBy("creator", "field").agg(F.avg("x").alias("x"))


@query("agg38_signature", "SELECT creator, field, round(x, 6) AS value FROM (" + SIGNATURE + ")")
def agg38(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signature(spark, sf_dir).select("creator", "field", six(F.col("x")).alias("value"))


@query("agg39_field_ranges", "SELECT field, round(max(x) - min(x), 6) AS range FROM (" + SIGNATURE + ") GROUP BY 1")
def agg39(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signature(spark, sf_dir).groupBy("field").agg(six(F.max("x") - F.min("x")).alias("range"))


@query("jon30_cohort_knn", "WITH s AS (" + SIGNATURE + "), r AS (SELECT field, max(x) - min(x) AS r FROM s GROUP BY 1 HAVING max(x) > min(x)), d AS (SELECT a.creator, o.creator AS neighbor, round(avg(abs(a.x / r - o.x / r)), 6) AS distance FROM s a JOIN s o USING (field) JOIN r USING (field) WHERE a.creator <> o.creator GROUP BY 1, 2) SELECT creator, neighbor, rank::INT AS rank, distance FROM (SELECT *, row_number() OVER (PARTITION BY creator ORDER BY distance, neighbor) AS rank FROM d) WHERE rank <= 5")
def jon30(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.nearest_by_fields(signature(spark, sf_dir), "creator", "field", "x", 5).select("creator", "neighbor", "rank", "distance")


@query("jon05_id_parity_join", "SELECT v.vec_id, d.source, round(v.v[1], 6) AS x FROM {vectors} v JOIN documents d ON d.doc_id = v.vec_id")
def jon05(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = b.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), "source")
    return b.vectors(spark, sf_dir).join(d, "vec_id").select("vec_id", "source", six(F.get("v", F.lit(0))).alias("x"))


@query("jon31_similar_examples", "SELECT a.vec_id, max(round(list_dot_product(a.v, e.v), 5)) AS best, count(*) AS n FROM {vectors} a JOIN {vectors} e ON a.grp = e.grp AND a.vec_id <> e.vec_id GROUP BY 1")
def jon31(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = b.vectors(spark, sf_dir)
    found = vectors.similar_examples(v, v, "vec_id", "v", "grp")
    return found.select("vec_id", F.round("best", 5).alias("best"), "n")
