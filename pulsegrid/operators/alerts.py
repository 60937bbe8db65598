"""Serving of alerts: filters, priority order, pages, indicators, searches."""

from __future__ import annotations

import math
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.functions import scalars as s
from pulsegrid.operators import numbering

# Fixed value: the name shown for devices without a location.
UNASSIGNED = "Ubicación sin asignar"
PAGE_SIZE, MOST_SUGGESTIONS, MOST_DEVICES = 10, 20, 500


def active_summary(summary: DataFrame, master: DataFrame) -> DataFrame:
    return summary.join(master.where(F.col("active") == 1).select("amid"), "amid", "left_semi")


def with_location(summary: DataFrame, locations: DataFrame) -> DataFrame:
    """The current location's name, or :data:`UNASSIGNED` where there is none or it is blank; location ids are text, and any text."""
    names = locations.select(F.col("amid").alias("__site"), F.nullif(F.trim("nombre"), F.lit("")).alias("location"))
    joined = summary.join(names, F.col("amid").cast("string") == F.col("__site"), "left").drop("__site")
    return joined.withColumn("location", F.coalesce("location", F.lit(UNASSIGNED)))


PROBLEMS = {
    "gps_zero_today": lambda: F.col("gps_zero_today") > 0,
    "gps_zero_window": lambda: F.col("gps_zero_window") > 0,
    "gps_streak": lambda: F.col("max_zero_streak") > 0,
    "drops": lambda: F.col("drops_window") > 0,
    "battery_zero": lambda: F.col("battery_zero_window") > 0,
    "both": lambda: (F.col("gps_level") != "OK") & (F.col("battery_level") != "OK"),
}


def problem_predicate(name: str | None) -> Column:
    """An unknown name filters nothing."""
    return PROBLEMS[name]() if name in PROBLEMS else F.lit(True)


def effective_only_alerts(only_alerts: bool, level: str | None) -> bool:
    """Asking for level OK shows devices without an alert."""
    return only_alerts and (level or "").upper() != "OK"


def filter_alerts(summary: DataFrame, as_of: Column, *, amid: int | None = None, level: str | None = None, kind: str | None = None, problem: str | None = None, status: str | None = None, only_alerts: bool = True) -> DataFrame:
    """All given conditions together."""
    rows = summary.where(F.col("has_alert") == 1) if effective_only_alerts(only_alerts, level) else summary
    if amid is not None:
        rows = rows.where(F.col("amid") == amid)
    if level:
        rows = rows.where(F.col("level") == level.upper())
    if kind in ("GPS", "BATERIA"):
        rows = rows.where(F.col("gps_level" if kind == "GPS" else "battery_level") != "OK")
    if status:
        rows = rows.where(s.status_band(F.col("last_status"), as_of) == status)
    return rows.where(problem_predicate(problem))


def apply_exclusions(rows: DataFrame, devices: DataFrame, places: DataFrame) -> DataFrame:
    """Without the devices and the (defaulted) location names that a user leaves out."""
    return rows.join(devices.select("amid").distinct(), "amid", "left_anti").join(places.select("location").distinct(), "location", "left_anti")


def parse_devices(text: str) -> list[int]:
    """Positive ids from a text, sorted and distinct; raises on anything else or on too many."""
    parts = [p for p in re.split(r"[\s,;]+", text.strip()) if p]
    if bad := [p for p in parts if not p.isascii() or not p.isdigit() or int(p) <= 0]:
        raise ValueError(f"not a device: {bad[0]}")
    found = sorted({int(p) for p in parts})
    if len(found) > MOST_DEVICES:
        raise ValueError(f"more than {MOST_DEVICES} devices")
    return found


def parsed_devices(text: Column) -> Column:
    """The same over a column of lists: an array, or null where the list is not accepted."""
    parts = F.filter(F.split(F.trim(text), r"[\s,;]+"), lambda p: p != "")
    ids = F.transform(parts, lambda p: F.when(p.rlike("^[0-9]+$"), p.try_cast("bigint")))
    found = F.array_sort(F.array_distinct(ids))
    good = F.forall(ids, lambda i: F.coalesce(i > 0, F.lit(False))) & (F.size(found) <= MOST_DEVICES)
    return F.when(good, found)


def devices_frame(spark: SparkSession, text: str) -> DataFrame:
    return spark.createDataFrame([(d,) for d in parse_devices(text)], "amid long")


def priority_tier() -> Column:
    """1 to 11: the overall level, and which of GPS and battery shares it."""
    g, b, level = F.col("gps_level"), F.col("battery_level"), F.col("level")
    tier = None
    for base, name in ((1, "CRITICA"), (5, "ALTA")):
        for step, holds in enumerate(((g == name) & (b == name), g == name, b == name, F.lit(True))):
            tier = F.when((level == name) & holds, base + step) if tier is None else tier.when((level == name) & holds, base + step)
    warned = level == "ADVERTENCIA"
    return tier.when(warned & (g == "ADVERTENCIA") & (b == "ADVERTENCIA"), 9).when(warned, 10).otherwise(11)


def with_rank(rows: DataFrame, as_of: Column) -> DataFrame:
    """What alerts are ordered by: the tier, and whether there is no status, an old or a recent one."""
    band = F.when(F.col("last_status").isNull() | (F.col("last_status") < s.midnight(as_of)), 1).when(F.col("last_status") < s.plus(as_of, hours=-1), 2).otherwise(3)
    return rows.withColumns({"tier": priority_tier(), "status_rank": band, "drops_before": F.greatest(F.col("drops_window") - F.col("drops_today"), F.lit(0))})


def rank_alerts(rows: DataFrame, as_of: Column) -> DataFrame:
    """Most urgent first: tier, then no status, old, recent, then the oldest status, then the device."""
    return with_rank(rows, as_of).orderBy("tier", "status_rank", F.asc_nulls_first("last_status"), "amid")


def page_of(total: int, page: int, size: int = PAGE_SIZE) -> tuple[int, int]:
    """The page inside the range, and the number of pages, at least 1."""
    pages = max(1, math.ceil(total / size))
    return min(max(page, 1), pages), pages


def numbered_alerts(rows: DataFrame, as_of: Column) -> DataFrame:
    """All alerts with ``n``, their place in the order from 1: sorted by ranges, numbered within each task, and counted on from the tasks before.

    The sorted rows are written once (to the folder of checkpoints), so that counts and numbers come from the same ranges.
    """
    order = ("tier", "status_rank", F.asc_nulls_first("last_status"), "amid")
    ranged = with_rank(rows, as_of).repartitionByRange(*order).sortWithinPartitions(*order)
    return numbering.numbered(ranged, "n")


def alerts_page(numbered: DataFrame, page: int = 1, size: int = PAGE_SIZE) -> DataFrame:
    """One page of numbered alerts, the last one if there are fewer: a range of numbers, which costs the same wherever it lies."""
    total = numbered.agg(F.count("*").alias("n")).first()["n"]  # one row
    at, _ = page_of(total, page, size)
    return numbered.where((F.col("n") > (at - 1) * size) & (F.col("n") <= at * size)).orderBy("n").drop("n")


def fleet_kpis(active: DataFrame) -> DataFrame:
    level = lambda name: F.count_if(F.col("level") == name)
    return active.agg(
        F.count("*").alias("devices"),
        F.count_if(F.col("has_alert") == 1).alias("alerts"),
        level("CRITICA").alias("critical"),
        level("ALTA").alias("high"),
        level("ADVERTENCIA").alias("warnings"),
        level("OK").alias("ok"),
        F.count_if(F.col("gps_level") != "OK").alias("gps"),
        F.count_if(F.col("battery_level") != "OK").alias("battery"),
        F.coalesce(F.sum("drops_window"), F.lit(0)).alias("drops"),
        F.max("window_end").alias("last_update"),
    )


def alerts_count(rows: DataFrame, size: int = PAGE_SIZE) -> DataFrame:
    return rows.agg(F.count("*").alias("n")).select("n", F.greatest(F.ceil(F.col("n") / size), F.lit(1)).cast("long").alias("pages"))


def location_names(active: DataFrame) -> DataFrame:
    return active.select("location").distinct().orderBy("location")


def _clamp(limit: int) -> int:
    return max(1, min(limit, MOST_SUGGESTIONS))


def starts_with(number: Column, term: str) -> Column:
    """Whether the digits of a number from 0 begin with a term of digits: it lies in one of the ranges 12, 120-129, 1200-1299, ..., which reach a scan."""
    first, last, ranges = int(term), int(term) + 1, F.lit(False)
    if term.startswith("0"):
        return number == 0 if term == "0" else F.lit(False)
    while first < 1 << 63:
        inside = (number >= first) & (number < last) if last < 1 << 63 else number >= first
        ranges = inside if first == int(term) else ranges | inside
        first, last = first * 10, last * 10
    return ranges


def search_devices(active: DataFrame, term: str, limit: int = 15) -> DataFrame:
    """Active devices whose number starts with a term of two digits or more."""
    term = term.strip()
    rows = active.select("amid")
    if len(term) < 2 or not re.fullmatch("[0-9]+", term):
        return rows.limit(0)
    return rows.where(starts_with(F.col("amid"), term)).orderBy("amid").limit(_clamp(limit))


def search_locations(active: DataFrame, term: str, limit: int = 15) -> DataFrame:
    """Location names that hold a term of two characters or more, whatever accents and case."""
    names = active.select("location").distinct()
    if len(term.strip()) < 2:
        return names.limit(0)
    return names.where(s.holds_folded(F.col("location"), term.strip())).orderBy("location").limit(_clamp(limit))
