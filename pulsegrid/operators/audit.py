"""Data-quality audits, freshness and volumes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEVELS = ("CRITICA", "ALTA", "ADVERTENCIA", "OK")


def missing_summary(master: DataFrame, summary: DataFrame) -> DataFrame:
    return master.where(F.col("active") == 1).select("amid").join(summary.select("amid"), "amid", "left_anti").orderBy("amid")


def inactive_with_summary(master: DataFrame, summary: DataFrame) -> DataFrame:
    return master.where(F.col("active") == 0).select("amid").join(summary.select("amid", "level", "window_end"), "amid").orderBy("amid")


def drop_reconcile(summary: DataFrame, drops: DataFrame, today) -> DataFrame:
    """Number of devices whose counts differ from the detail; 0 is right."""
    detail = drops.groupBy("amid").agg(F.count("*").alias("w"), F.count_if(F.to_date("drop_ts") == F.to_date(today)).alias("t"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return summary.join(detail, "amid", "left").agg(F.count_if((zero("drops_window") != zero("w")) | (zero("drops_today") != zero("t"))).alias("differences"))


def duplicates(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def level_distribution(summary: DataFrame) -> DataFrame:
    severity = F.array_position(F.array(*map(F.lit, LEVELS)), F.col("level"))
    return summary.groupBy("level").agg(F.count("*").alias("n"), F.min("window_end").alias("oldest"), F.max("window_end").alias("newest")).orderBy(severity)


def level_combinations(summary: DataFrame) -> DataFrame:
    return summary.groupBy("level", "gps_level", "battery_level", "has_alert").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "level", "gps_level", "battery_level")


def blocks_per_device(blocks: DataFrame) -> DataFrame:
    each = blocks.groupBy("amid").agg(F.count("*").alias("n"))
    return each.agg(F.min("n").alias("least"), F.round(F.avg("n"), 2).alias("mean"), F.max("n").alias("most"), F.count("*").alias("devices"))


def blocks_range_stats(blocks: DataFrame) -> DataFrame:
    return blocks.agg(F.min("slot").alias("first_slot"), F.max("slot").alias("last_slot"), F.max("original").alias("last_reading"), F.countDistinct("amid").alias("devices"))


def drop_event_stats(drops: DataFrame) -> DataFrame:
    return drops.agg(F.count("*").alias("n"), F.countDistinct("amid").alias("devices"), F.min("drop_ts").alias("first_ts"), F.max("drop_ts").alias("last_ts"))


def recent_drops(drops: DataFrame, n: int = 20) -> DataFrame:
    return drops.orderBy(F.desc("drop_ts"), "amid").limit(n)


def coverage_counts(master: DataFrame, summary: DataFrame, active: DataFrame) -> DataFrame:
    """Three counts that should agree, in one row."""
    one = lambda df, name: df.agg(F.count("*").alias(name))
    return one(master.where("active = 1"), "active_devices").crossJoin(one(summary, "summaries")).crossJoin(one(active, "active_summaries"))  # one row each


def freshness_blocks(blocks: DataFrame) -> DataFrame:
    has = F.col("has_data") == 1
    return blocks.agg(F.count("*").alias("blocks"), F.count_if(has).alias("with_data"), F.max("slot").alias("last_slot"), F.max(F.when(has, F.col("slot"))).alias("last_with_data"), F.max("original").alias("last_reading"))


def freshness_locations(current: DataFrame) -> DataFrame:
    return current.agg(F.count("*").alias("locations"), F.max("fecha_carga").alias("last_load"))


def freshness_history(history: DataFrame) -> DataFrame:
    return history.agg(F.count_if(F.col("fin").isNull()).alias("open_versions"))


def table_volumes(**tables: tuple[DataFrame, str]) -> DataFrame:
    """Rows and newest time of several tables, one row for each."""
    out = None
    for name, (df, ts) in tables.items():
        part = df.agg(F.count("*").alias("n"), F.max(ts).cast("timestamp_ntz").alias("newest")).select(F.lit(name).alias("table_name"), "n", "newest")
        out = part if out is None else out.unionByName(part)
    return out
