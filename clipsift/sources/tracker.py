"""Trackers of long videos and the shorts cut from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipsift.sources.analytics import compact_count


def tracker_clips(rows: DataFrame, references: Sequence[str], holdout: str, id_col: str = "video_id", views_col: str = "views") -> DataFrame:
    """(video_id, source_key, role, views) of the shorts of known sources: an id is its source's key, ``_clip`` and the rest.

    Counts may be written compactly (1.2M). Rows of other sources, and the sources' own rows, are left out.
    """
    key = F.regexp_extract(id_col, "^(.+?)_clip", 1)
    known = [*references, holdout]
    found = rows.withColumn("source_key", key).where(F.col("source_key").isin(known))
    return found.select(F.col(id_col).alias("video_id"), "source_key", F.when(F.col("source_key") == holdout, "holdout").otherwise("reference").alias("role"), compact_count(F.col(views_col)).alias("views"))
