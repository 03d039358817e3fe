"""Set operations and keyed writes on snapshots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """New rows replace old ones of the same key; a new null does not."""
    rest = [c for c in old.columns if c not in keys]
    n = new.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in rest])
    return old.join(n, list(keys), "full").select(*keys, *[F.coalesce(f"_new_{c}", c).alias(c) for c in rest])


def insert_missing(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Old rows and those new ones whose key is not there yet."""
    return old.unionByName(new.join(old.select(*keys), list(keys), "left_anti"))


def id_differences(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(side, key) of the keys that only one side has."""
    l, r = left.select(key).distinct(), right.select(key).distinct()
    return l.join(r, key, "left_anti").select(F.lit("missing").alias("side"), key).unionByName(r.join(l, key, "left_anti").select(F.lit("extra").alias("side"), key))
