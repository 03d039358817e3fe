"""Stratified samples of clips for annotation."""

from __future__ import annotations

import random

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from clipsift.functions.scalars import iou


def slot_schedule(slots: int, seed: int, video: str) -> list[tuple[float, float]]:
    """(middle as a share of the video, target seconds) of each slot: lengths shuffled by the seed and the video's name."""
    lengths = [20.0 + 40.0 * k / max(1, slots - 1) for k in range(slots)]
    random.Random(f"{seed}:{video}").shuffle(lengths)
    return [((k + 0.5) / slots, lengths[k]) for k in range(slots)]


def slot_samples(clips: DataFrame, video: str, clip: str, slots: int, seed: int, bands: int = 3, more: tuple[str, ...] = ()) -> DataFrame:
    """(video, slot, clip, band, *more): for each slot in turn the clip nearest to its place and length that doesn't overlap earlier picks.

    Distance is |middle - slot's| over the video's end plus a quarter of |length - target| over 55. Each slot is one window on the
    partitioning that all slots share; only the schedule, a function of the video's name, comes from Python.
    """
    @pandas_udf("array<double>")
    def targets(names: pd.Series) -> pd.Series:
        return names.map(lambda v: [t for _, t in slot_schedule(slots, seed, v)])

    group = Window.partitionBy(video)
    out = clips.withColumns({"_n": F.count(F.lit(1)).over(group), "_end": F.max("end").over(group), "_i": F.row_number().over(group.orderBy("score", clip))})
    out = out.withColumn("band", F.least(F.lit(bands - 1), F.floor((F.col("_i") - 1) * bands / F.col("_n"))).cast("int")).withColumn("_t", targets(F.col(video).cast("string"))).withColumn("slot", F.lit(None).cast("int"))
    for k in range(slots):
        middle = (F.col("start") + F.col("end")) / 2.0
        away = F.abs(middle - F.col("_end") * ((k + 0.5) / slots)) / F.col("_end") + 0.25 * F.abs(F.col("end") - F.col("start") - F.get("_t", F.lit(k))) / 55.0
        live = F.when(F.col("slot").isNull(), F.struct(away.alias("d"), F.col(clip).alias("c"), F.col("start").alias("s"), F.col("end").alias("e")))
        out = out.withColumn("_best", F.min(live).over(group))
        own = F.col(clip) == F.col("_best.c")
        apart = iou(F.col("start"), F.col("end"), F.col("_best.s"), F.col("_best.e")) <= 0
        out = out.where(F.col("slot").isNotNull() | own | apart).withColumn("slot", F.when(F.col("slot").isNull() & own, F.lit(k)).otherwise(F.col("slot")))
    return out.where("slot is not null").select(video, "slot", clip, "band", *more)


def annotation_queue(clips: DataFrame, done: DataFrame, video: str, clip: str, slots: int = 6, seed: int = 42) -> DataFrame:
    """(annotation_id, video, clip, round, band) of videos that ``done`` doesn't name: samples numbered by their start.

    A queue takes the first of every video, then the second, and so on: its order is (round, video), left to whoever reads it.
    """
    open_ = clips.join(done.select(video).distinct(), video, "left_anti")
    taken = slot_samples(open_, video, clip, slots, seed, more=("start",))
    n = F.row_number().over(Window.partitionBy(video).orderBy("start", clip))
    return taken.withColumn("round", n).select(F.format_string("%s_sample_%02d", F.col(video).cast("string"), "round").alias("annotation_id"), video, clip, "round", "band")
