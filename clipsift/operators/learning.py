"""Outcomes of audience reports and profiles learned from them and from editorial feedback."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clipsift.functions.scalars import clamp, shrink, six
from clipsift.operators.order import centred_percentile, quantiles, with_ranks

#: What an editorial decision says about a clip.
EDITORIAL_WEIGHTS = {"download_original": 1.0, "download_edited": 1.0, "custom_created": 1.0, "historical_selected": 1.0, "review_closed_unselected": -0.35, "reject": -1.0}
#: Views below which rates say nothing.
LEAST_VIEWS = 50
#: Report fields that count as rates by themselves, and those that count a view.
PERCENTAGES = ("average_view_percentage", "chose_to_view_percentage", "completion_rate_percentage")
COUNTS = ("likes", "comments", "shares", "saves", "profile_visits", "replays", "follows")


def editorial_weight(event_type: Column) -> Column:
    """The weight of a decision; null for other events."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in EDITORIAL_WEIGHTS.items() for x in pair]), event_type)


def judged_events(new: DataFrame, clips: DataFrame) -> DataFrame:
    """New decisions with ``reason``: why one is refused, or null. Clips that were dealt by ``clip`` aren't dealt again."""
    seen = clips.select(F.col("clip").alias("_clip")).distinct()
    reason = F.when(editorial_weight(F.col("event_type")).isNull(), "event type").when(F.col("_clip").isNull(), "unknown clip")
    return new.join(seen, F.col("clip") == F.col("_clip"), "left").withColumn("reason", reason).drop("_clip")


def append_events(log: DataFrame, new: DataFrame, clips: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The log with the new decisions about known clips, and the new rows that are refused, with ``reason``."""
    judged = judged_events(new, clips)
    return log.unionByName(judged.where("reason is null").select(*log.columns)), judged.where("reason is not null")


#: What a calibration needs, and how far it goes.
LEAST_EXAMPLES, LEAST_SOURCES, CALIBRATION_PRIOR, PART_CAP, CALIBRATION_CAP = 5, 2, 8.0, 0.15, 0.30


def calibrated(df: DataFrame, outcome: str, semantic: str, examples: str = "examples", sources: str = "sources", varied: str = "varied") -> DataFrame:
    """``df`` with ``adjustment`` and ``estimate`` (0 to 100) from a channel's reference clips.

    ``outcome`` is the model's standardised prediction, ``semantic`` the bounded adjustment by similar examples; ``examples``,
    ``sources`` and ``varied`` say what was learned from. With too little the adjustment is 0 and the estimate null.
    """
    active = F.coalesce((F.col(examples) >= LEAST_EXAMPLES) & (F.col(sources) >= LEAST_SOURCES) & F.col(varied), F.lit(False))
    trusted, near = shrink(F.col(examples), CALIBRATION_PRIOR) * F.col(outcome), F.coalesce(F.col(semantic), F.lit(0.0))
    total = clamp(clamp(trusted * PART_CAP, -PART_CAP, PART_CAP) + near, -CALIBRATION_CAP, CALIBRATION_CAP)
    return df.withColumns({"adjustment": F.when(active, total).otherwise(0.0), "estimate": F.when(active, F.round(50.0 + 50.0 * clamp(trusted + near / PART_CAP, -1.0, 1.0), 2))})


def long_form(df: DataFrame, keys: Sequence[str], values: dict[str, Column], name: str = "feature", value: str = "value") -> DataFrame:
    """A row for each key and value that is not null."""
    pairs = F.array(*[F.struct(F.lit(n).alias("n"), v.cast("double").alias("v")) for n, v in values.items()])
    return df.select(*keys, F.explode(pairs).alias("p")).select(*keys, F.col("p.n").alias(name), F.col("p.v").alias(value)).where(F.col(value).isNotNull())


def numeric_summaries(df: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Count, extremes, exact quartiles (interpolated) and mean of each metric; missing and non-finite values are left out."""
    rows = long_form(df, [], {m: F.col(m) for m in metrics}, "metric", "v").where(~F.isnan("v") & (F.abs("v") != float("inf")))
    found = rows.groupBy("metric").agg(F.count("v").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.avg("v").alias("m"))
    found = found.join(quantiles(rows, ["metric"], "v", [0.25, 0.5, 0.75]), "metric")
    return found.select("metric", "n", six(F.col("lo")).alias("minimum"), *[six(F.col("q")[k]).alias(a) for k, a in enumerate(("p25", "median", "p75"))], six(F.col("m")).alias("mean"), six(F.col("hi")).alias("maximum"))


def metric_coverage(df: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """How often each metric is present and missing: one pass, then one row for each metric."""
    n = F.count(F.lit(1))
    one = df.agg(F.array(*[F.struct(F.lit(m).alias("metric"), F.count(m).alias("present"), (n - F.count(m)).alias("missing")) for m in metrics]).alias("r"))
    return one.select(F.explode("r").alias("r")).select("r.*")


def outcome_components(reports: DataFrame) -> DataFrame:
    """(creator, clip, component, value) of the rates that a report supports; engaged views count before views, 0 as missing.

    Columns that ``reports`` lacks count as missing in every row. A net of subscribers goes before gains less losses.
    """
    have = set(reports.columns)
    field = lambda c: F.col(c).cast("double") if c in have else F.lit(None).cast("double")
    exposure = F.coalesce(F.nullif("engaged_views", F.lit(0)), F.col("views"))
    seen = reports.withColumn("exposure", exposure).where(F.col("exposure") >= LEAST_VIEWS)
    values = {c: field(c) / 100.0 for c in PERCENTAGES}
    watched = field("average_view_duration_seconds") / F.nullif(field("duration_seconds"), F.lit(0.0))
    values["duration_fraction"] = F.when(watched.isNotNull(), F.least(F.lit(2.0), watched))  # least() would pass over a null
    values |= {f"{c}_per_view": field(c) / F.col("exposure") for c in COUNTS}
    reach, zero = field("reach"), F.lit(0.0)
    values["plays_per_reached_account"] = F.when(reach > 0, F.col("exposure") / reach)
    gained, lost = field("subscribers_gained"), field("subscribers_lost")
    change = F.when(gained.isNotNull() | lost.isNotNull(), F.coalesce(gained, zero) - F.coalesce(lost, zero))
    values["net_subscribers_per_view"] = F.coalesce(field("subscribers_net"), change) / F.col("exposure")
    return long_form(seen, ["creator", "clip"], values, "component", "value")


def outcome_targets(components: DataFrame) -> DataFrame:
    """(creator, clip, target): the mean of a clip's centred percentiles among the creator's clips, over components that two clips have."""
    keys = ["creator", "component"]
    ranked = with_ranks(components, keys, {"at": "value"}).withColumns({"n": F.col("at.rows"), "p": centred_percentile("at")})
    return ranked.where("n >= 2").groupBy("creator", "clip").agg(F.avg("p").alias("target"))


def feature_profile(examples: DataFrame, keys: Sequence[str], outcome: str, features: dict[str, Column], prior: float, least: int = 1) -> DataFrame:
    """(keys, feature, n, weight): mean of outcome times feature, shrunk towards 0; 0 below ``least`` examples."""
    scaled = {n: F.col(outcome) * f for n, f in features.items()}
    found = long_form(examples, keys, scaled).groupBy(*keys, "feature").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("m"))
    return found.select(*keys, "feature", "n", F.when(F.col("n") >= least, F.col("m") * shrink(F.col("n"), prior)).otherwise(0.0).alias("weight"))


def balanced_profile(examples: DataFrame, owner: Sequence[str], outcome: str, features: dict[str, Column], prior: float) -> DataFrame:
    """(feature, creators, weight): the mean over owners of their own means, shrunk by the number of examples."""
    scaled = {n: F.col(outcome) * f for n, f in features.items()}
    per = long_form(examples, owner, scaled).groupBy(*owner, "feature").agg(F.avg("value").alias("m"), F.count(F.lit(1)).alias("n"))
    found = per.groupBy("feature").agg(F.count(F.lit(1)).alias("creators"), F.avg("m").alias("m"), F.sum("n").alias("n"))
    return found.select("feature", "creators", (F.col("m") * shrink(F.col("n"), prior)).alias("weight"))


def close_review(events: DataFrame) -> DataFrame:
    """The events that close a review: a weak negative for each clip that was presented and never decided on."""
    decided = events.where("event_type <> 'presented'").select("clip")
    shown = events.where("event_type = 'presented'").groupBy("clip").agg(F.max("event_id").alias("after_event"))
    return shown.join(decided, "clip", "left_anti").select("clip", F.lit("review_closed_unselected").alias("event_type"), "after_event")


def update_if_null(rows: DataFrame, updates: DataFrame, key: str, column: str) -> DataFrame:
    """``rows`` with ``column`` set from ``updates`` (key, column; a key once) where it was null, and ``updated``, whether it was set.

    A write that must happen once: a value that is already there stays, and the sum of ``updated`` is the number of rows changed.
    """
    new = updates.select(key, F.col(column).alias("_new"))
    met = rows.join(new, key, "left").withColumn("updated", F.col(column).isNull() & F.col("_new").isNotNull())
    return met.withColumn(column, F.coalesce(column, "_new")).drop("_new")
