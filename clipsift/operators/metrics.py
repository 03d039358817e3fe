"""Agreement of predictions with human ratings, tie-aware."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clipsift.functions.scalars import six
from clipsift.operators.order import average_rank, pair_counts, with_ranks  # noqa: F401


def safe_corr(x: str, y: str) -> Column:
    """Pearson's correlation as an aggregate; null where a side is constant."""
    varies = (F.stddev_pop(x) > 0) & (F.stddev_pop(y) > 0)
    n = F.count(F.lit(1))
    covariance = F.covar_pop(x, y)
    return F.when(varies & (n > 1), covariance / F.when(varies, F.stddev_pop(x) * F.stddev_pop(y)).otherwise(1.0))


def regression_metrics(df: DataFrame, keys: list[str], actual: str, predicted: str) -> DataFrame:
    """n, mean absolute and root mean squared error, Spearman's correlation of each group."""
    ranked = with_ranks(df, keys, {"_pa": actual, "_pp": predicted}).withColumns({"_ra": average_rank("_pa"), "_rp": average_rank("_pp")})
    gap = F.col(actual) - F.col(predicted)
    return ranked.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), six(F.avg(F.abs(gap))).alias("mae"), six(F.sqrt(F.avg(gap * gap))).alias("rmse"), six(safe_corr("_ra", "_rp")).alias("spearman"))


def top_choice(df: DataFrame, keys: list[str], key: str, actual: str, predicted: str, tolerance: float = 1e-9) -> DataFrame:
    """Whether the best predicted row of each group is one of the best rated, and how much it lies below; ties go to the smaller id."""
    found = df.groupBy(*keys).agg(F.max_by(actual, F.struct(F.col(predicted), -F.col(key))).alias("got"), F.max(actual).alias("best"), F.count(F.lit(1)).alias("n"))
    return found.select(*keys, "n", (F.abs(F.col("best") - F.col("got")) <= tolerance).cast("int").alias("hit"), six(F.col("best") - F.col("got")).alias("regret"))


def random_expectation(df: DataFrame, keys: list[str], actual: str, k: int = 3) -> DataFrame:
    """What k rows drawn at random would hit: 1 - C(n - b, k) / C(n, k) for b best of n rows; n below k takes all."""
    best = F.max(actual).over(Window.partitionBy(*keys))
    g = df.withColumn("_best", F.col(actual) == best).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if("_best").alias("b"), F.avg(actual).alias("m"), F.max(actual).alias("best"))
    miss = F.lit(1.0)
    for i in range(k):
        miss = miss * F.when(F.col("n") - i > 0, F.greatest(F.lit(0), F.col("n") - F.col("b") - i) / F.greatest(F.lit(1), F.col("n") - i)).otherwise(0.0)
    return g.select(*keys, six(F.col("b") / F.col("n")).alias("hit1"), six(F.col("best") - F.col("m")).alias("regret1"), six(1.0 - miss).alias(f"hit{k}"))


def roc_auc(df: DataFrame, keys: list[str], positive: Column, score: str) -> DataFrame:
    """Area under the curve from rank sums, ties counting half; null without both classes."""
    ranked = with_ranks(df, keys, {"_ps": score}).withColumns({"_r": average_rank("_ps"), "_y": positive.cast("int")})
    g = ranked.groupBy(*keys).agg(F.sum("_y").alias("p"), F.sum(1 - F.col("_y")).alias("q"), F.sum(F.col("_r") * F.col("_y")).alias("s"))
    area = F.try_divide(F.col("s") - F.col("p") * (F.col("p") + 1) / 2.0, F.col("p") * F.col("q"))
    return g.select(*keys, six(area).alias("auc"))
