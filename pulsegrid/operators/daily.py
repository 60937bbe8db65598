"""The summary from measures of single days, which are stored and merged: a run computes the days that a delivery touched and reads the others as they are.

The state of a day holds for each device what days can be merged from: counts, the last of everything, and for runs of zero fixes how many of them begin the day,
end it, and stand in a row anywhere in it. Days are whole: ``as_of`` must not lie before the newest reading of its day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.functions import scalars as s
from pulsegrid.operators import battery
from pulsegrid.operators.summary import WINDOW_DAYS, assembled
from pulsegrid.operators.telemetry import gps_flags


def gps_days(tel: DataFrame) -> DataFrame:
    """One row for each device and day with a reading."""
    by = Window.partitionBy("amid", "day").orderBy("fecha_hora", "id")
    so_far = by.rowsBetween(Window.unboundedPreceding, 0)
    other = F.col("reported") & ~F.col("zero")
    fixes = gps_flags(tel).select("amid", F.to_date("fecha_hora").alias("day"), "id", "fecha_hora", "reported", "zero").withColumns({"streak": F.count_if(other).over(so_far), "fix": F.when(F.col("reported"), F.struct("fecha_hora", "id"))})
    within = Window.partitionBy("amid", "day", "streak").orderBy("fecha_hora", "id").rowsBetween(Window.unboundedPreceding, 0)
    runs = fixes.withColumn("length", F.count_if("zero").over(within))
    last = F.max_by(F.struct("fecha_hora", F.col("zero").cast("int").alias("zero")), "fix")
    return (
        runs.groupBy("amid", "day")
        .agg(
            F.max("fecha_hora").alias("last_status"),
            F.count_if("reported").alias("n_fixes"),
            F.count_if("zero").alias("n_zero"),
            last.alias("last_fix"),
            F.max(F.when(F.col("zero"), F.col("fecha_hora"))).alias("last_zero_ts"),
            F.coalesce(F.max(F.when(F.col("streak") == 0, F.col("length"))), F.lit(0)).alias("leading"),
            F.max("length").alias("longest"),
            F.max_by("length", F.when(F.col("reported"), F.struct("fecha_hora", "id"))).alias("at_end"),
        )
        .withColumn("trailing", F.coalesce(F.when(F.col("last_fix.zero") == 1, F.col("at_end")), F.lit(0)))
        .drop("at_end")
    )


def battery_days(blocks: DataFrame, drops: DataFrame) -> DataFrame:
    """One row for each device and day with a block that has data. ``drops`` are those of the same days, whether the block before lies in them or not."""
    levels = _with_data(blocks).groupBy("amid", F.to_date("slot").alias("day")).agg(*_levels())
    return levels.join(drops.groupBy("amid", F.to_date("drop_ts").alias("day")).agg(F.array_sort(F.collect_list(F.struct(*_DROP))).alias("drops")), ["amid", "day"], "left")


def battery_states(blocks: DataFrame, rules: DataFrame) -> DataFrame:
    """The same with the drops of :func:`drops_of_days`, from one scan of the blocks and one shuffle by device."""
    found = F.when(F.col("fall").isNotNull(), F.struct(*(F.col(f"fall.{c}") for c in _DROP)))
    days = battery.with_falls(_with_data(blocks), rules).groupBy("amid", F.to_date("slot").alias("day")).agg(*_levels(), F.array_sort(F.collect_list(found)).alias("drops"))
    return days.withColumn("drops", F.when(F.size("drops") > 0, F.col("drops")))


_DROP = ("drop_ts", "drop_from_ts", "pct_from", "pct_to", "drop_points")


def _with_data(blocks: DataFrame) -> DataFrame:
    return blocks.where((F.col("has_data") == 1) & F.col("pct").isNotNull()).select("amid", "slot", "pct")


def _levels() -> tuple[Column, ...]:
    zero = F.col("pct") == 0
    return F.count_if(zero).alias("n_zero"), F.max(F.when(zero, F.col("slot"))).alias("last_zero_ts"), F.max(F.struct("slot", "pct")).alias("last_block")


def gps_merged(days: DataFrame, as_of: Column) -> DataFrame:
    """What :func:`pulsegrid.operators.summary.gps_measures` gives, from the states of the window."""
    today = F.col("day") == F.to_date(as_of)
    state = F.struct("day", F.col("n_fixes").alias("n"), "leading", "trailing", "longest")
    start = F.struct(F.lit(0).cast("long").alias("longest"), F.lit(0).cast("long").alias("trailing"))

    def add(acc: Column, d: Column) -> Column:
        longest = F.greatest(acc["longest"], acc["trailing"] + d["leading"], d["longest"])
        return F.struct(longest.alias("longest"), F.when(d["leading"] == d["n"], acc["trailing"] + d["n"]).otherwise(d["trailing"]).alias("trailing"))

    return (
        _of_window(days, as_of)
        .groupBy("amid")
        .agg(
            F.max("last_status").alias("last_status"),
            F.sum(F.when(today, F.col("n_fixes")).otherwise(0)).alias("gps_total_today"),
            F.sum(F.when(today, F.col("n_zero")).otherwise(0)).alias("gps_zero_today"),
            F.sum("n_fixes").alias("gps_total_window"),
            F.sum("n_zero").alias("gps_zero_window"),
            F.count_if(F.col("n_zero") > 0).alias("gps_zero_days"),
            F.max_by("last_fix", "last_fix.fecha_hora").alias("last"),
            F.max("last_zero_ts").alias("last_zero_fix_ts"),
            F.array_sort(F.collect_list(state)).alias("states"),
        )
        .select("*", F.col("last.fecha_hora").alias("last_fix_ts"), F.col("last.zero").alias("last_fix_is_zero"), F.aggregate("states", start, add, lambda acc: acc["longest"]).alias("max_zero_streak"))
        .drop("last", "states")
    )


def battery_merged(days: DataFrame, as_of: Column) -> DataFrame:
    """What the summaries of blocks and drops give, from the states of the window. A drop counts if it began in the window."""
    today, start = F.col("day") == F.to_date(as_of), s.plus(s.midnight(as_of), days=-WINDOW_DAYS)
    fell = F.filter(F.coalesce("drops", F.array().cast("array<struct<drop_ts:timestamp_ntz,drop_from_ts:timestamp_ntz,pct_from:decimal(5,2),pct_to:decimal(5,2),drop_points:decimal(5,2)>>")), lambda d: (d["drop_from_ts"] >= start) & (d["drop_ts"] <= as_of))
    most = lambda c: F.array_max(F.transform(c, lambda d: d["drop_points"]))
    return (
        _of_window(days, as_of)
        .withColumn("fell", fell)
        .groupBy("amid")
        .agg(
            F.sum(F.when(today, F.col("n_zero")).otherwise(0)).alias("battery_zero_today"),
            F.sum("n_zero").alias("battery_zero_window"),
            F.max("last_zero_ts").alias("last_battery_zero_ts"),
            F.max("last_block").alias("block"),
            F.sum(F.when(today, F.size("fell")).otherwise(0)).alias("drops_today"),
            F.sum(F.size("fell")).alias("drops_window"),
            F.max(F.when(today, most("fell"))).alias("max_drop_today"),
            F.max(most("fell")).alias("max_drop_window"),
            F.max(F.try_element_at("fell", F.lit(-1))).alias("last"),
        )
        .select("*", F.col("block.pct").alias("battery_now"), F.col("block.slot").alias("last_block_ts"), *(F.col(f"last.{c}").alias(name) for c, name in (("drop_ts", "last_drop_ts"), ("pct_from", "last_drop_from"), ("pct_to", "last_drop_to"), ("drop_points", "last_drop_points"))))
        .drop("block", "last")
    )


def _of_window(days: DataFrame, as_of: Column) -> DataFrame:
    day = F.to_date(as_of)
    return days.where((F.col("day") >= F.date_sub(day, WINDOW_DAYS)) & (F.col("day") <= day))


def device_summary(master: DataFrame, gps: DataFrame, battery_levels: DataFrame, as_of: Column) -> DataFrame:
    """The summary of every active device from stored states of days; no telemetry is read."""
    return assembled(master, (gps_merged(gps, as_of), battery_merged(battery_levels, as_of)), as_of)


def drops_of_days(blocks: DataFrame, rules: DataFrame) -> DataFrame:
    """All drops between the blocks given, without a window: for stored days, from blocks that reach far enough on both sides."""
    return battery.drops_between(blocks.where((F.col("has_data") == 1) & F.col("pct").isNotNull()), rules)
