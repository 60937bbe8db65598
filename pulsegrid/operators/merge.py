"""Keyed merges as pure functions; the result is written as a new version of the target."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merge_by_key(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``source``, and those of ``target`` that it has no row for."""
    return target.join(source.select(*keys), list(keys), "left_anti").unionByName(source, allowMissingColumns=True)


def merge_columns(target: DataFrame, source: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """``target`` with some columns taken from matching rows of ``source``; other rows and columns stay."""
    new = source.select(*keys, F.lit(True).alias("__matched"), *(F.col(c).alias(f"__{c}") for c in columns))
    out = target.join(new, list(keys), "left")
    return out.select(*(F.when(F.col("__matched"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in target.columns))
