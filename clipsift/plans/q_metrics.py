"""Queries that hold predictions against ratings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clipsift.functions.scalars import six
from clipsift.operators import metrics, order, ranking
from clipsift.plans import bridges as b
from clipsift.plans.registry import query


@query("fpct1_avg_rank", "SELECT grp, doc_id, round(ra, 6) AS avg_rank FROM {avgrank}")
def fpct1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order.with_ranks(b.judged(spark, sf_dir), ["grp"], {"at": "actual"}).withColumn("avg_rank", six(order.average_rank("at"))).select("grp", "doc_id", "avg_rank")


MID = "CASE WHEN n < 2 OR hi = lo THEN {flat} ELSE {scale} * ((ra - 1) / (n - 1)) + {shift} END"
MID_SQL = "SELECT grp, doc_id, round(CASE WHEN n < 2 OR hi = lo THEN %s ELSE %s END, 6) AS percentile FROM (SELECT *, count(*) OVER g AS n, max(actual) OVER g AS hi, min(actual) OVER g AS lo FROM {avgrank} WINDOW g AS (PARTITION BY grp))"


@query("fpct2_mid_percentile", MID_SQL % ("0.5e0", "(ra - 1) / (n - 1)"))
def fpct2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order.with_ranks(b.judged(spark, sf_dir), ["grp"], {"at": "actual"}).withColumn("percentile", six(order.mid_percentile("at"))).select("grp", "doc_id", "percentile")


@query("fpct3_centred_percentile", MID_SQL % ("0e0", "2 * ((ra - 1) / (n - 1)) - 1"))
def fpct3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order.with_ranks(b.judged(spark, sf_dir), ["grp"], {"at": "actual"}).withColumn("percentile", six(order.centred_percentile("at"))).select("grp", "doc_id", "percentile")


@query("fpct4_strict_percentile", "SELECT grp, doc_id, round(percent_rank() OVER (PARTITION BY grp ORDER BY predicted), 6) AS percentile FROM {judged}")
def fpct4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order.with_ranks(b.judged(spark, sf_dir), ["grp"], {"at": "predicted"}).withColumn("percentile", six(order.strict_percentile("at"))).select("grp", "doc_id", "percentile")


@query("win16_equal_rank_ensemble", "SELECT grp, doc_id, round((percent_rank() OVER (PARTITION BY grp ORDER BY predicted) + percent_rank() OVER (PARTITION BY grp ORDER BY challenger)) / 2e0, 6) AS ensemble FROM {judged}")
def win16(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = order.strict_percentile("p") + order.strict_percentile("c")
    return order.with_ranks(b.judged(spark, sf_dir), ["grp"], {"p": "predicted", "c": "challenger"}).withColumn("ensemble", six(both / 2.0)).select("grp", "doc_id", "ensemble")


@query("agg19_regression_metrics", "SELECT grp, count(*) AS n, round(avg(abs(actual - predicted)), 6) AS mae, round(sqrt(avg((actual - predicted) * (actual - predicted))), 6) AS rmse, CASE WHEN stddev_pop(ra) > 0 AND stddev_pop(rp) > 0 THEN round(corr(ra, rp), 6) END AS spearman FROM {avgrank} GROUP BY 1")
def agg19(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.regression_metrics(b.judged(spark, sf_dir), ["grp"], "actual", "predicted")


@query("agg20_pearson", "SELECT grp, CASE WHEN stddev_pop(actual) > 0 AND stddev_pop(predicted) > 0 THEN round(corr(actual, predicted), 6) END AS pearson FROM {judged} GROUP BY 1")
def agg20(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.judged(spark, sf_dir).groupBy("grp").agg(six(metrics.safe_corr("actual", "predicted")).alias("pearson"))


@query("jon09_pair_expansion", "SELECT a.grp, count(*) AS pairs, count(*) FILTER (a.predicted = b.predicted) AS ties FROM {judged} a JOIN {judged} b ON a.grp = b.grp AND a.actual > b.actual GROUP BY 1")
def jon09(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = b.judged(spark, sf_dir)
    tied = j.groupBy("grp", "predicted", "actual").agg(F.count(F.lit(1)).alias("n"))
    same = tied.groupBy("grp", "predicted").agg(F.sum("n").alias("t"), F.sum(F.col("n") * F.col("n")).alias("s")).groupBy("grp").agg(F.sum((F.col("t") * F.col("t") - F.col("s")) / 2).cast("long").alias("ties"))
    return metrics.pair_counts(j, ["grp"], "actual", "predicted").join(same, "grp").select("grp", "pairs", "ties")


@query("agg22_pairwise_accuracy", "SELECT a.grp, count(*) AS pairs, round(avg(CASE WHEN a.predicted > b.predicted THEN 1e0 WHEN a.predicted = b.predicted THEN 0.5e0 ELSE 0e0 END), 6) AS accuracy FROM {judged} a JOIN {judged} b ON a.grp = b.grp AND a.actual > b.actual GROUP BY 1")
def agg22(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = metrics.pair_counts(b.judged(spark, sf_dir), ["grp"], "actual", "predicted")
    return found.select("grp", "pairs", six(F.col("right") / F.col("pairs")).alias("accuracy"))


@query("agg23_top1", "SELECT grp, count(*) AS n, (abs(max(actual) - arg_max(actual, (predicted, -doc_id))) <= 1e-9)::INT AS hit, round(max(actual) - arg_max(actual, (predicted, -doc_id)), 6) AS regret FROM {judged} GROUP BY 1")
def agg23(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.top_choice(b.judged(spark, sf_dir), ["grp"], "doc_id", "actual", "predicted")


@query("agg24_top3", "SELECT grp, max((actual >= best - 1e-9)::INT) AS hit3, round(min(best - actual), 6) AS regret3 FROM (SELECT *, max(actual) OVER (PARTITION BY grp) AS best, row_number() OVER (PARTITION BY grp ORDER BY predicted DESC, doc_id) AS r FROM {judged}) WHERE r <= 3 GROUP BY 1")
def agg24(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = b.judged(spark, sf_dir).withColumn("best", F.max("actual").over(Window.partitionBy("grp")))
    top = ranking.top_k(j, ["grp"], [F.desc("predicted"), F.col("doc_id")], 3)
    return top.groupBy("grp").agg(F.max((F.col("actual") >= F.col("best") - 1e-9).cast("int")).alias("hit3"), six(F.min(F.col("best") - F.col("actual"))).alias("regret3"))


@query("agg25_random_expectation", "SELECT grp, round(b / n::DOUBLE, 6) AS hit1, round(best - m, 6) AS regret1, round(1e0 - greatest(0, n - b) / n::DOUBLE * (CASE WHEN n > 1 THEN greatest(0, n - b - 1) / (n - 1)::DOUBLE ELSE 0 END) * (CASE WHEN n > 2 THEN greatest(0, n - b - 2) / (n - 2)::DOUBLE ELSE 0 END), 6) AS hit3 FROM (SELECT grp, count(*) n, count(*) FILTER (actual = mx) b, avg(actual) m, max(actual) best FROM (SELECT *, max(actual) OVER (PARTITION BY grp) mx FROM {judged}) GROUP BY 1)")
def agg25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.random_expectation(b.judged(spark, sf_dir), ["grp"], "actual", 3)


@query("agg26_confusion", "SELECT grp, round(avg(((predicted >= 5) = (actual >= 4))::INT), 6) AS accuracy, round(count(*) FILTER (predicted >= 5 AND actual >= 4)::DOUBLE / nullif(count(*) FILTER (predicted >= 5), 0), 6) AS precision, round(count(*) FILTER (predicted >= 5 AND actual >= 4)::DOUBLE / nullif(count(*) FILTER (actual >= 4), 0), 6) AS recall FROM {judged} GROUP BY 1")
def agg26(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, a = F.col("predicted") >= 5, F.col("actual") >= 4
    both = F.count_if(p & a).cast("double")
    return b.judged(spark, sf_dir).groupBy("grp").agg(six(F.avg((p == a).cast("int"))).alias("accuracy"), six(F.try_divide(both, F.count_if(p))).alias("precision"), six(F.try_divide(both, F.count_if(a))).alias("recall"))


@query("agg27_roc_auc", "SELECT grp, round((s - p * (p + 1) / 2e0) / nullif(p * q, 0), 6) AS auc FROM (SELECT grp, count(*) FILTER (actual >= 4)::DOUBLE p, count(*) FILTER (actual < 4)::DOUBLE q, coalesce(sum(rp) FILTER (actual >= 4), 0) s FROM {avgrank} GROUP BY 1)")
def agg27(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.roc_auc(b.judged(spark, sf_dir), ["grp"], F.col("actual") >= 4, "predicted")


@query("agg28_error_summary", "SELECT grp, round(avg(e), 6) AS mae, round(quantile_cont(e, 0.5), 6) AS median_ae, round(avg((e <= 1)::INT), 6) AS within_1, round(avg((e <= 2)::INT), 6) AS within_2, round(avg(e) FILTER (actual <> 4), 6) AS adjusted_mae FROM (SELECT *, abs(actual - predicted) AS e FROM {judged}) GROUP BY 1")
def agg28(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = b.judged(spark, sf_dir).withColumn("e", F.abs(F.col("actual") - F.col("predicted")))
    within = lambda k: six(F.avg((F.col("e") <= k).cast("int")))
    middle = order.quantiles(j, ["grp"], "e", [0.5]).select("grp", six(F.col("q")[0]).alias("median_ae"))
    found = j.groupBy("grp").agg(six(F.avg("e")).alias("mae"), within(1).alias("within_1"), within(2).alias("within_2"), six(F.avg(F.when(F.col("actual") != 4, F.col("e")))).alias("adjusted_mae"))
    return found.join(middle, "grp")


@query("agg29_proposal_gain", "SELECT edge, round(avg(abs(actual - p)), 6) AS mae, round(avg(abs(actual - o)), 6) AS no_change_mae, round(avg(abs(actual - o)) - avg(abs(actual - p)), 6) AS improvement, round(avg((abs(actual - p) <= 2)::INT), 6) AS within_2 FROM (SELECT 'start' AS edge, actual, predicted AS p, 3e0 AS o FROM {judged} UNION ALL SELECT 'end', actual, challenger, 3e0 FROM {judged}) GROUP BY 1")
def agg29(spark: SparkSession, sf_dir: str) -> DataFrame:
    from clipsift.operators.learning import long_form

    rows = long_form(b.judged(spark, sf_dir), ["actual"], {"start": F.col("predicted"), "end": F.col("challenger")}, "edge", "p")
    got, kept = F.avg(F.abs(F.col("actual") - F.col("p"))), F.avg(F.abs(F.col("actual") - 3.0))
    return rows.groupBy("edge").agg(six(got).alias("mae"), six(kept).alias("no_change_mae"), six(kept - got).alias("improvement"), six(F.avg((F.abs(F.col("actual") - F.col("p")) <= 2).cast("int"))).alias("within_2"))


FAILED = "SELECT grp, arg_max(doc_id, (predicted, -doc_id)) AS selected, arg_max(doc_id, (actual, -doc_id)) AS best_doc, arg_max(actual, (predicted, -doc_id)) AS got, max(actual) AS best FROM {judged} GROUP BY 1"


def _failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    by_model, by_human = F.struct(F.col("predicted"), -F.col("doc_id")), F.struct(F.col("actual"), -F.col("doc_id"))
    return b.judged(spark, sf_dir).groupBy("grp").agg(F.max_by("doc_id", by_model).alias("selected"), F.max_by("doc_id", by_human).alias("best_doc"), F.max_by("actual", by_model).alias("got"), F.max("actual").alias("best"))


@query("seq15_failure_cases", "SELECT grp, selected, best_doc AS best, round(best - got, 6) AS regret FROM (" + FAILED + ") WHERE best - got > 1e-9")
def seq15(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _failures(spark, sf_dir).where("best - got > 1e-9").select("grp", "selected", F.col("best_doc").alias("best"), six(F.col("best") - F.col("got")).alias("regret"))


@query("agg30_failure_summary", "SELECT round(best - got, 6) AS regret, count(*) AS groups FROM (" + FAILED + ") GROUP BY 1")
def agg30(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _failures(spark, sf_dir).groupBy(six(F.col("best") - F.col("got")).alias("regret")).agg(F.count(F.lit(1)).alias("groups"))


@query("agg35_calibration", "SELECT grp, round(avg(actual), 6) AS mean_actual, round(avg(predicted), 6) AS mean_predicted, count(*) FILTER (predicted < 1 OR predicted > 5) AS out_of_range, round(min(predicted), 6) AS lowest, round(max(predicted), 6) AS highest FROM {judged} GROUP BY 1")
def agg35(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("predicted")
    return b.judged(spark, sf_dir).groupBy("grp").agg(six(F.avg("actual")).alias("mean_actual"), six(F.avg(p)).alias("mean_predicted"), F.count_if((p < 1) | (p > 5)).alias("out_of_range"), six(F.min(p)).alias("lowest"), six(F.max(p)).alias("highest"))


@query("agg36_edit_direction", "SELECT grp, count(*) FILTER (challenger > predicted) AS higher, count(*) FILTER (challenger = predicted) AS equal, count(*) FILTER (challenger < predicted) AS lower, round(avg(challenger - predicted), 6) AS mean_delta FROM {judged} WHERE actual >= 4 GROUP BY 1")
def agg36(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("challenger") - F.col("predicted")
    return b.judged(spark, sf_dir).where("actual >= 4").groupBy("grp").agg(F.count_if(d > 0).alias("higher"), F.count_if(d == 0).alias("equal"), F.count_if(d < 0).alias("lower"), six(F.avg(d)).alias("mean_delta"))


@query("ml01_gram_matrix", "SELECT i, j, round(sum(x[i] * x[j]), 4) AS s FROM (SELECT [1e0, actual, predicted / 10e0, challenger / 13e0] AS x FROM {judged}), (SELECT unnest(range(1, 5))::INT AS i), (SELECT unnest(range(1, 5))::INT AS j) GROUP BY 1, 2")
def ml01_gram(spark: SparkSession, sf_dir: str) -> DataFrame:
    from clipsift.operators.models import gram

    j = b.judged(spark, sf_dir).select(F.array(F.lit(1.0), F.col("actual"), F.col("predicted") / 10.0, F.col("challenger") / 13.0).alias("x"))
    return gram(j, "x", 4).select((F.col("i") + 1).alias("i"), (F.col("j") + 1).alias("j"), F.round("s", 4).alias("s"))


@query("ml01_ridge")
def ml01_ridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    from clipsift.operators.models import ridge_coefficients

    j = b.judged(spark, sf_dir).select(F.array("predicted", "challenger").alias("x"), "actual")
    return ridge_coefficients(j, "x", ["actual"], alpha=10.0)


@query("ml03_pairwise_logistic")
def ml03(spark: SparkSession, sf_dir: str) -> DataFrame:
    from clipsift.operators.models import pairwise_logistic

    j = b.judged(spark, sf_dir).select("grp", F.array(F.col("predicted") / 10.0, F.col("challenger") / 13.0).alias("x"), "actual")
    return pairwise_logistic(j, "grp", "x", "actual", l2=0.1)


@query("ml04_choice_ranker")
def ml04(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of a video's clips starts nearest to its label."""
    from clipsift.operators.models import choice_ranker

    o = b.clips(spark, sf_dir).join(b.labels_iv(spark, sf_dir).select("video", F.col("start").alias("truth")), "video")
    o = o.select("video", "clip", F.array("hook", "completeness", "clarity", F.col("start") / 100.0).alias("x"), F.abs(F.col("start") - F.col("truth")).alias("distance"))
    return choice_ranker(o, "video", "clip", "x", "distance", l2=0.1)


@query("ml07_grouped_cv")
def ml07(spark: SparkSession, sf_dir: str) -> DataFrame:
    from clipsift.operators.models import cross_validated

    j = b.judged(spark, sf_dir).select("grp", "doc_id", F.array("predicted", "challenger").alias("x"), "actual")
    return cross_validated(j, "grp", "doc_id", "x", "actual", folds=4, alpha=10.0, seed=42)


@query("ml09_cluster_bootstrap")
def ml09(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two models' differences in error, pairs, best choice and regret, with intervals from drawn groups of documents."""
    from clipsift.operators.models import cluster_bootstrap

    j = b.judged(spark, sf_dir).withColumn("grp", F.concat_ws("/", "grp", F.col("doc_id") % 64))
    stats = j.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.lit(1).alias("one"), *[F.sum(F.abs(F.col("actual") - F.col(c))).alias(f"error_{c}") for c in ("predicted", "challenger")])
    for c in ("predicted", "challenger"):
        pairs = metrics.pair_counts(j, ["grp"], "actual", c).select("grp", F.col("pairs").alias(f"pairs_{c}"), F.col("right").alias(f"right_{c}"))
        tops = metrics.top_choice(j, ["grp"], "doc_id", "actual", c).select("grp", F.col("hit").alias(f"hit_{c}"), F.col("regret").alias(f"regret_{c}"))
        stats = stats.join(pairs, "grp", "left").join(tops, "grp")
    both = lambda m: (f"{m}_predicted", f"{m}_challenger")
    wanted = {"quality_mae": (*both("error"), "n", True), "pairwise_accuracy": (*both("right"), "pairs_predicted", False), "top_1_hit_rate": (*both("hit"), "one", False), "mean_top_1_regret": (*both("regret"), "one", True)}
    return cluster_bootstrap(stats.na.fill(0), "grp", wanted, iterations=10_000, seed=42)
