"""Per-device summary over the window of today and 13 days before, from one aggregate of each input."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.functions import scalars as s
from pulsegrid.operators.telemetry import gps_flags

WINDOW_DAYS = 13


def _window(as_of: Column) -> tuple[Column, Column]:
    today = s.midnight(as_of)
    return today, s.plus(today, days=-WINDOW_DAYS)


def _in_window(ts: str, as_of: Column) -> Column:
    return (F.col(ts) >= _window(as_of)[1]) & (F.col(ts) <= as_of)


def _is_today(ts: str, as_of: Column) -> Column:
    today = _window(as_of)[0]
    return (F.col(ts) >= today) & (F.col(ts) < s.plus(today, days=1))


def gps_summary(tel: DataFrame, as_of: Column) -> DataFrame:
    """Counts of fixes and zero fixes, last status, last fix and last zero fix, in one pass."""
    return _gps_aggregate(gps_flags(tel.where(_in_window("fecha_hora", as_of))), as_of)


def _gps_aggregate(rows: DataFrame, as_of: Column, *more: Column) -> DataFrame:
    today = _is_today("fecha_hora", as_of)
    fix, zero = F.col("reported"), F.col("zero")
    last = F.max_by(F.struct("fecha_hora", F.col("zero").cast("int").alias("zero")), F.when(fix, F.struct("fecha_hora", "id")))
    return (
        rows.groupBy("amid")
        .agg(
            F.max("fecha_hora").alias("last_status"),
            F.count_if(fix & today).alias("gps_total_today"),
            F.count_if(zero & today).alias("gps_zero_today"),
            F.count_if(fix).alias("gps_total_window"),
            F.count_if(zero).alias("gps_zero_window"),
            F.countDistinct(F.when(zero, F.to_date("fecha_hora"))).alias("gps_zero_days"),
            last.alias("last"),
            F.max(F.when(zero, F.col("fecha_hora"))).alias("last_zero_fix_ts"),
            *more,
        )
        .select("*", F.col("last.fecha_hora").alias("last_fix_ts"), F.col("last.zero").alias("last_fix_is_zero"))
        .drop("last")
    )


def gps_streaks(tel: DataFrame, as_of: Column) -> DataFrame:
    """Runs of consecutive zero fixes: a run's number is the count of other fixes before it."""
    w = Window.partitionBy("amid").orderBy("fecha_hora", "id").rowsBetween(Window.unboundedPreceding, 0)
    fixes = gps_flags(tel.where(_in_window("fecha_hora", as_of))).where("reported")
    runs = fixes.withColumn("streak", F.sum(F.when(F.col("zero"), 0).otherwise(1)).over(w)).where("zero")
    return runs.groupBy("amid", "streak").agg(F.count("*").alias("length"), F.min("fecha_hora").alias("first_ts"), F.max("fecha_hora").alias("last_ts"))


def gps_max_streak(tel: DataFrame, as_of: Column) -> DataFrame:
    return gps_streaks(tel, as_of).groupBy("amid").agg(F.max("length").alias("max_zero_streak"))


def gps_measures(tel: DataFrame, as_of: Column) -> DataFrame:
    """:func:`gps_summary` and the longest streak together: one scan, and one shuffle by device that serves the order and the aggregate."""
    fixes = gps_flags(tel.where(_in_window("fecha_hora", as_of))).select("amid", "id", "fecha_hora", "latitud", "longitud", "reported", "zero", "valid")
    so_far = Window.partitionBy("amid").orderBy("fecha_hora", "id").rowsBetween(Window.unboundedPreceding, 0)
    runs = fixes.withColumn("streak", F.count_if(F.col("reported") & ~F.col("zero")).over(so_far))
    within = Window.partitionBy("amid", "streak").orderBy("fecha_hora", "id").rowsBetween(Window.unboundedPreceding, 0)
    return _gps_aggregate(runs.withColumn("length", F.count_if("zero").over(within)), as_of, F.max("length").alias("max_zero_streak"))


def battery_summary(blocks: DataFrame, as_of: Column) -> DataFrame:
    """Blocks at 0 today and in the window, the last of them, and the latest block with data."""
    rows = blocks.where((F.col("has_data") == 1) & F.col("pct").isNotNull() & _in_window("slot", as_of))
    zero = F.col("pct") == 0
    return rows.groupBy("amid").agg(
        F.count_if(zero & _is_today("slot", as_of)).alias("battery_zero_today"),
        F.count_if(zero).alias("battery_zero_window"),
        F.max(F.when(zero, F.col("slot"))).alias("last_battery_zero_ts"),
        F.max_by("pct", "slot").alias("battery_now"),
        F.max("slot").alias("last_block_ts"),
    )


def drop_summary(drops: DataFrame, as_of: Column) -> DataFrame:
    """Drops today and in the window (which holds today), the largest, and the latest."""
    today = _is_today("drop_ts", as_of)
    return (
        drops.groupBy("amid")
        .agg(
            F.count_if(today).alias("drops_today"),
            F.count("*").alias("drops_window"),
            F.coalesce(F.max(F.when(today, F.col("drop_points"))), F.lit(0)).cast("decimal(5,2)").alias("max_drop_today"),
            F.max("drop_points").alias("max_drop_window"),
            F.max_by(F.struct("drop_ts", "pct_from", "pct_to", "drop_points"), "drop_ts").alias("last"),
        )
        .select("*", F.col("last.drop_ts").alias("last_drop_ts"), F.col("last.pct_from").alias("last_drop_from"), F.col("last.pct_to").alias("last_drop_to"), F.col("last.drop_points").alias("last_drop_points"))
        .drop("last")
    )


def device_summary(master: DataFrame, tel: DataFrame, blocks: DataFrame, drops: DataFrame, as_of: Column) -> DataFrame:
    """Every active device with all its measures: counts default to 0, times and levels stay null. Blocks without data are not needed."""
    return assembled(master, (gps_measures(tel, as_of), battery_summary(blocks, as_of), drop_summary(drops, as_of)), as_of)


def assembled(master: DataFrame, parts: Sequence[DataFrame], as_of: Column) -> DataFrame:
    """The summary of every active device from parts that hold its measures."""
    today, start = _window(as_of)
    rows = master.where(F.col("active") == 1).select("amid")
    for part in parts:
        rows = rows.join(part, "amid", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    points = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("decimal(5,2)").alias(c)
    counted = rows.select(
        "amid",
        today.alias("day_start"),
        start.alias("window_start"),
        as_of.alias("window_end"),
        "last_status",
        *(zero(c) for c in ("gps_total_today", "gps_zero_today", "gps_total_window", "gps_zero_window", "gps_zero_days")),
        "last_fix_ts",
        zero("last_fix_is_zero"),
        "last_zero_fix_ts",
        zero("max_zero_streak"),
        "battery_now",
        "last_block_ts",
        F.coalesce((F.col("battery_now") == 0).cast("int"), F.lit(0)).alias("last_block_is_zero"),
        zero("drops_today"),
        zero("drops_window"),
        "last_drop_ts",
        "last_drop_from",
        "last_drop_to",
        "last_drop_points",
        points("max_drop_today"),
        points("max_drop_window"),
        zero("battery_zero_today"),
        zero("battery_zero_window"),
        "last_battery_zero_ts",
    )
    return counted.withColumns(
        {
            "gps_zero_pct_today": s.percent_2dp(F.col("gps_zero_today"), F.col("gps_total_today")),
            "gps_zero_pct_window": s.percent_2dp(F.col("gps_zero_window"), F.col("gps_total_window")),
        }
    )
