"""Stored blocks and states of days, kept up to date by the days that a delivery touches."""

from __future__ import annotations

import datetime as dt
import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.functions import scalars as s
from pulsegrid.operators import battery, daily, telemetry
from pulsegrid.sources import files, store

DAY = dt.timedelta(days=1)
#: Days that the block job builds anew where none are named: today and the day before.
REBUILT = 2
#: Devices whose blocks of a day, 48 each, are spread and written by one task.
DEVICES_A_FILE = 20_000


def _around(days: Iterable[dt.date], before: int, after: int) -> set[dt.date]:
    return {d + k * DAY for d in days for k in range(-before, after + 1)}


def _telemetry(spark: SparkSession, path: str, days: Iterable[dt.date]) -> DataFrame:
    return spark.read.parquet(path).where(F.col("day").isin(sorted(days))).drop("day")


def rebuild_blocks(spark: SparkSession, telemetry: str, blocks: str, master: DataFrame, days: Iterable[dt.date]) -> None:
    """Build the stored blocks of some days anew from the stored readings of these days and those before them; other days stay as they are."""
    wanted = sorted(days)
    readings = _telemetry(spark, telemetry, _around(wanted, 1, 0))
    parts = math.ceil(master.count() / DEVICES_A_FILE)
    store.write_days(battery.blocks_of_days(readings, master, wanted, parts=max(1, parts)), blocks)


def last_days(as_of: dt.datetime, days: int = REBUILT) -> list[dt.date]:
    if days < 1:
        raise ValueError("at least one day is built")
    return [as_of.date() - k * DAY for k in reversed(range(days))]


class Days:
    """A folder with ``telemetry``, ``blocks``, ``gps_days`` and ``battery_days``, each by day, and ``latest``, the last usable fix of each device."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def at(self, table: str) -> str:
        return f"{self.path}/{table}"

    def deliver(self, incoming: DataFrame, master: DataFrame, rules: DataFrame, as_of: dt.datetime) -> dict[str, int]:
        """Append a delivery and bring the days up to date that it touches; repeating it after a failure gives the same."""
        touched = store.days_of(incoming, "fecha_hora")
        counts = files.append_telemetry(self.spark, incoming, self.at("telemetry"))
        self.refresh(touched, master, rules, as_of)
        fixes = store.Snapshots(self.spark, self.at("latest"))
        known = telemetry.merged_fixes(fixes.read("fixes")[0], incoming) if fixes.version() else telemetry.latest_fixes(incoming)
        fixes.commit({"fixes": known})
        fixes.vacuum()
        return counts

    def latest_fixes(self) -> DataFrame:
        return store.Snapshots(self.spark, self.at("latest")).read("fixes")[0]

    def refresh(self, touched: Iterable[dt.date], master: DataFrame, rules: DataFrame, as_of: dt.datetime) -> None:
        """Compute anew the states of the days that new readings touch, and of those around them that they can change; no others are read or written.

        Readings of a day's last minutes fill the next day's first slot. A drop lies within some hours, so it can change as many days away.
        """
        touched = {d for d in touched if d <= as_of.date()}
        if not touched:
            return
        store.replace_days(daily.gps_days(_telemetry(self.spark, self.at("telemetry"), touched)), self.at("gps_days"))
        built = {d for d in _around(touched, 0, 1) if d <= as_of.date()}
        rebuild_blocks(self.spark, self.at("telemetry"), self.at("blocks"), master, built)
        reach = math.ceil(float(rules.select("BAT_CAIDA_MAX_HORAS").first()[0]) / 24)  # one row
        changed = {d for d in _around(built, reach, reach) if d <= as_of.date()}
        near = self.spark.read.parquet(self.at("blocks")).where(F.col("day").isin(sorted(_around(changed, reach, reach))) & (F.col("slot") <= F.lit(as_of).cast("timestamp_ntz")))
        store.replace_days(daily.battery_states(near, rules).where(F.col("day").isin(sorted(changed))), self.at("battery_days"))

    def summary(self, master: DataFrame, as_of: Column) -> DataFrame:
        """The summary of the window, from the states of its days alone."""
        gps, levels = (self.spark.read.parquet(self.at(t)) for t in ("gps_days", "battery_days"))
        return daily.device_summary(master, gps, levels, as_of)

    def retain(self, as_of: Column, days: int = 16) -> int:
        """Drop the blocks of days that ended more than some days ago; kept files are not rewritten. Gives the number of rows that went."""
        if days < 1:
            raise ValueError("at least one day is kept")
        return store.drop_days(self.spark, self.at("blocks"), s.plus(s.midnight(as_of), days=-days))
