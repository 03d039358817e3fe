"""Semantic features of boundary options: what a clip would say if it began or ended elsewhere."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clipsift.operators.vectors import dot, linear_scores, normalized

#: What an option without words scores.
LEAST_SCORE = 1.0


def window_sums(parts: DataFrame, asks: DataFrame, video: str, v: str, width: int, block: float = 600.0) -> DataFrame:
    """Distinct ``asks`` (video, s, e, ...) with ``sums``: ``v`` added up over the video's parts (start, end, v) with end > s and start < e.

    What overlaps an interval is what starts before its end less what ends by its start, so each ask needs two running sums and no
    part is ever joined with an interval: asks lie between the parts in order of time. A video is dealt to blocks of ``block``
    seconds; only the blocks' totals meet in order.
    """
    line = lambda n, at, side: F.struct(F.lit(n).alias("line"), at.cast("double").alias("at"), F.lit(side).alias("side"))
    # what starts: an ask comes before parts of the same time; what ends: after them
    events = parts.select(video, F.explode(F.array(line(0, F.col("start"), 1), line(1, F.col("end"), 0))).alias("m"), F.col(v).alias("v"), F.lit(None).cast(asks.select(F.struct(*asks.columns)).schema[0].dataType).alias("ask"))
    looks = asks.select(video, F.explode(F.array(line(0, F.col("e"), 0), line(1, F.col("s"), 1))).alias("m"), F.lit(None).cast(parts.schema[v].dataType).alias("v"), F.struct(*asks.columns).alias("ask"))
    marks = events.unionByName(looks).select(video, "m.*", "v", "ask", F.floor(F.col("m.at") / block).alias("block"))
    places = [F.lit(i) for i in range(width)]
    totals = marks.groupBy(video, "line", "block").agg(F.array(*[F.coalesce(F.sum(F.get("v", i)), F.lit(0.0)) for i in places]).alias("t"))
    earlier = Window.partitionBy(video, "line").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ahead = totals.select(video, "line", "block", F.array(*[F.coalesce(F.sum(F.get("t", i)).over(earlier), F.lit(0.0)) for i in places]).alias("ahead"))
    so_far = Window.partitionBy(video, "line", "block").orderBy("at", "side").rowsBetween(Window.unboundedPreceding, 0)
    inside = marks.withColumn("inside", F.array(*[F.coalesce(F.sum(F.get("v", i)).over(so_far), F.lit(0.0)) for i in places])).where(F.col("ask").isNotNull())
    found = inside.join(ahead, [video, "line", "block"]).withColumn("sum", F.zip_with("inside", "ahead", lambda a, b: a + b))
    both = found.groupBy("ask").agg(F.max(F.when(F.col("line") == 0, F.col("sum"))).alias("began"), F.max(F.when(F.col("line") == 1, F.col("sum"))).alias("ended"))
    return both.select("ask.*", F.zip_with("began", "ended", lambda a, b: a - b).alias("sums"))


def semantic_options(options: DataFrame, parts: DataFrame, video: str, query: Sequence[str], option: str, v: str, width: int, means: list[float], scales: list[float], weights: dict[str, tuple[float, list[float]]]) -> DataFrame:
    """Options with the features of the whole clip that each would give, and how these differ from the original clip's.

    ``options`` has (video, *query, option, s, e, away): the clip that the option gives, and how far it moves the boundary; the
    original is the option that moves it least, the first of equals. ``parts`` (video, start, end, words, v) are timed sentences.
    A clip's vector is the unit mean of its sentences'; the frozen model takes (duration, words, vector) and gives a score for each
    of its targets, their mean is the quality. A clip that ends before it starts or has no words is not valid: its similarity is 0
    and each score ``LEAST_SCORE``. A query whose original isn't valid has null differences.
    """
    filled = parts.select(video, "start", "end", F.concat(F.array(F.lit(1.0), F.col("words").cast("double")), F.col(v)).alias("_v"))
    found = window_sums(filled, options, video, "_v", width + 2)
    valid = (F.col("e") > F.col("s")) & (F.round(F.get("sums", F.lit(0))) > 0)
    found = found.withColumns({"valid": valid, "words": F.when(valid, F.round(F.get("sums", F.lit(1)))).otherwise(0.0), "_unit": normalized(F.slice("sums", 3, width))})
    found = found.withColumn("_x", F.concat(F.array(F.col("e") - F.col("s"), F.col("words")), F.col("_unit")))
    targets = list(weights)
    scores = linear_scores(F.col("_x"), means, scales, weights)
    found = found.withColumns({f"{t}_score": F.when(F.col("valid"), scores[t]).otherwise(LEAST_SCORE) for t in targets})
    found = found.withColumn("quality_score", sum((F.col(f"{t}_score") for t in targets), F.lit(0.0)) / len(targets))
    every = [*targets, "quality"]
    known = F.struct("valid", "_unit", *[f"{t}_score" for t in every])
    first = found.groupBy(video, *query).agg(F.min_by(known, F.struct("away", option)).alias("_first"))
    met = found.join(first, [video, *query])
    alike = F.when(F.col("valid") & F.col("_first.valid"), dot(F.col("_unit"), F.col("_first._unit"))).otherwise(0.0)
    change = lambda t: F.when(F.col("_first.valid"), F.col(f"{t}_score") - F.col(f"_first.{t}_score")).alias(f"{t}_delta")
    return met.select(video, *query, option, "s", "e", "valid", "words", alike.alias("similarity"), *[f"{t}_score" for t in every], *[change(t) for t in every])
