"""Frozen recommendations against clips that are revealed later, and what a correction of these changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clipsift.functions.scalars import iou, six
from clipsift.operators.joins import greedy_matches
from clipsift.operators.metrics import safe_corr
from clipsift.operators.order import average_rank, with_ranks

#: Overlap from which a prediction can be matched, and from which it counts as recovered.
MATCHED, RECOVERED = 0.1, 0.5


def evaluate(predictions: DataFrame, actuals: DataFrame) -> DataFrame:
    """(experiment, rank, clip, estimate, actual, iou, recovered, start_error, end_error, performance) of every prediction.

    ``predictions``: (experiment, rank, clip, start, end, estimate). ``actuals``: (experiment, actual, segments, performance), where
    segments are the places (start, end) of a revealed clip in its source, null or empty while they aren't known. Predictions and
    clips are matched one to one, best overlap first (of several segments the best counts), from ``MATCHED`` on.

    The few rows that were matched get the facts of their clips first, so predictions meet them once, in place where they are dealt
    by their experiment.
    """
    places = actuals.select("experiment", "actual", F.explode("segments").alias("g"))
    met = predictions.select("experiment", "rank", "start", "end").join(places, "experiment")
    met = met.withColumn("iou", iou(F.col("start"), F.col("end"), F.col("g.start"), F.col("g.end")))
    pairs = met.groupBy("experiment", "rank", "actual").agg(F.max("iou").alias("iou")).where(F.col("iou") >= MATCHED)
    taken = greedy_matches(pairs, "experiment", "rank", "actual", "iou")
    known = actuals.select("experiment", "actual", F.array_min(F.transform("segments", lambda g: g["start"])).alias("s"), F.array_max(F.transform("segments", lambda g: g["end"])).alias("e"), "performance")
    facts = taken.join(known, ["experiment", "actual"], "left").groupBy("experiment", "rank").agg(F.collect_list(F.struct("actual", "iou", "s", "e", "performance")).alias("_facts"))
    # a left join by experiment and rank as a window: a join by both would deal all predictions anew, and so would what follows by experiment
    rows = predictions.repartition("experiment").withColumns({"_facts": F.lit(None).cast(facts.schema["_facts"].dataType), "_given": F.lit(False)})
    both = rows.unionByName(facts.repartition("experiment").withColumn("_given", F.lit(True)), allowMissingColumns=True)
    given = F.max_by("_facts", F.when(F.col("_given"), True)).over(Window.partitionBy("experiment", "rank"))
    met = both.withColumn("_facts", F.when(F.col("experiment").isNotNull() & F.col("rank").isNotNull(), given)).where(~F.col("_given"))
    found = met.select(*predictions.columns, F.explode_outer("_facts").alias("_f")).select(*predictions.columns, "_f.*")
    return found.select(
        "experiment", "rank", "clip", "estimate", "actual", F.round(F.coalesce("iou", F.lit(0.0)), 4).alias("iou"), F.coalesce(F.col("iou") >= RECOVERED, F.lit(False)).alias("recovered"),
        F.round(F.col("start") - F.col("s"), 3).alias("start_error"), F.round(F.col("end") - F.col("e"), 3).alias("end_error"), "performance",
    )


def summary(matches: DataFrame, actuals: DataFrame) -> DataFrame:
    """(experiment, predictions, clips, aligned, recall, mean_iou, rank_correlation) of evaluated experiments."""
    known = F.coalesce(F.size("segments") > 0, F.lit(False))
    clips = actuals.groupBy("experiment").agg(F.count(F.lit(1)).alias("clips"), F.count_if(known).alias("aligned"))
    found = matches.groupBy("experiment").agg(F.count(F.lit(1)).alias("predictions"), F.countDistinct(F.when(F.col("recovered"), F.col("actual"))).alias("hit"), F.avg("iou").alias("mean_iou"))
    pairs = matches.where(F.col("performance").isNotNull() & F.col("actual").isNotNull() & F.col("estimate").isNotNull())
    ranked = with_ranks(pairs, ["experiment"], {"_pe": "estimate", "_pp": "performance"}).withColumns({"_p": average_rank("_pe"), "_a": average_rank("_pp")})
    correlation = ranked.groupBy("experiment").agg(F.round(safe_corr("_p", "_a"), 4).alias("rank_correlation"))
    met = found.join(clips, "experiment", "left").join(correlation, "experiment", "left")
    recall = F.when(F.col("aligned") > 0, F.round(F.col("hit") / F.col("aligned"), 4))
    return met.select("experiment", "predictions", F.coalesce("clips", F.lit(0)).alias("clips"), F.coalesce("aligned", F.lit(0)).alias("aligned"), recall.alias("recall"), six(F.col("mean_iou")).alias("mean_iou"), "rank_correlation")


def corrected(actuals: DataFrame, corrections: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Clips after their corrections, experiments (experiment) whose clips so changed, and refused corrections with the reason.

    ``corrections``: (experiment, actual, seq, start, end, duration); of several valid ones of a clip the one with the largest seq
    counts. One is refused if it begins before 0, doesn't end after its start, ends after the source's duration, or names no clip.
    A correction to what is there changes nothing.
    """
    ok = (F.col("start") >= 0) & (F.col("end") > F.col("start")) & (F.col("end") <= F.col("duration"))
    judged = corrections.withColumn("ok", F.coalesce(ok, F.lit(False)))
    named = actuals.select("experiment", "actual", F.lit(True).alias("named"))
    judged = judged.join(named, ["experiment", "actual"], "left")
    reason = F.when(F.col("named").isNull(), "no such clip").when(~F.col("ok"), "outside the source")
    refused = judged.where(F.col("named").isNull() | ~F.col("ok")).select("experiment", "actual", "seq", reason.alias("reason"))
    place = F.array(F.struct(F.round("start", 3).alias("start"), F.round("end", 3).alias("end")))
    # one that names no clip meets none below
    last = corrections.where(ok).groupBy("experiment", "actual").agg(F.max_by(place, "seq").alias("_new"))
    met = actuals.join(last, ["experiment", "actual"], "left").withColumn("_moved", F.col("_new").isNotNull() & ~F.col("segments").eqNullSafe(F.col("_new")))
    changed = met.where("_moved").select("experiment").distinct()
    after = met.withColumn("segments", F.coalesce("_new", "segments")).select(actuals.columns)
    return after, changed, refused


def refreshed(matches: DataFrame, predictions: DataFrame, actuals: DataFrame, changed: DataFrame) -> DataFrame:
    """The evaluation after a change: experiments in ``changed`` are matched again, all others keep their rows.

    As experiments don't share clips, this is what evaluating everything would give; its work grows with what changed.
    """
    again = evaluate(predictions.join(changed, "experiment", "left_semi"), actuals.join(changed, "experiment", "left_semi"))
    return matches.join(changed, "experiment", "left_anti").unionByName(again)
