"""Telemetry: range scans, latest rows, the messages it comes from, and idempotent appends."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions.scalars import midnight, plus

# The keys of the messages.
KEYS = (
    "isContieneBateria",
    "isContieneGps",
    "isContieneTiempoVida",
    "isErrorObtenerBateria",
    "isErrorObtenerGps",
    "isErrorObtenerTiempoVida",
    "latitud",
    "longitud",
    "porcentajeBateria",
    "tiempoVida",
)
FIRST_DEVICE, DIFFUSION_TABLE = 7_500_000, 16


def telemetry_range(tel: DataFrame, start: Column, end: Column, amids: Sequence[int] | None = None) -> DataFrame:
    """Readings of ``[start, end)``, of all devices or some, in order; the bounds reach the scan."""
    rows = tel.where((F.col("fecha_hora") >= start) & (F.col("fecha_hora") < end))
    if amids is not None:
        rows = rows.where(F.col("amid").isin(*amids))
    return rows.orderBy("amid", "fecha_hora", "id")


def resolve_range(day_from: str | None, day_to: str | None, slot_from: str | None, slot_to: str | None, as_of: dt.datetime) -> tuple[dt.datetime, dt.datetime]:
    """``[start, end)`` of two days and half-hour slots; what cannot be read is today, 00:00 or 23:30; an inverted range is today."""
    slots = {f"{h:02d}:{m:02d}" for h in range(24) for m in (0, 30)}

    def day(text: str | None) -> dt.date:
        try:
            return dt.datetime.strptime(text or "", "%Y-%m-%d").date()
        except ValueError:
            return as_of.date()

    def at(d: dt.date, slot: str) -> dt.datetime:
        return dt.datetime.combine(d, dt.time.fromisoformat(slot))

    start, last = at(day(day_from), slot_from if slot_from in slots else "00:00"), at(day(day_to), slot_to if slot_to in slots else "23:30")
    if start > last:
        start, last = at(as_of.date(), "00:00"), at(as_of.date(), "23:30")
    return start, last + dt.timedelta(minutes=30)


def resolved_range(day_from: Column, day_to: Column, slot_from: Column, slot_to: Column, as_of: Column) -> Column:
    """The same over columns: a struct of ``start`` and ``end``."""
    today = midnight(as_of)

    def at(day: Column, slot: Column, other: str) -> Column:
        d = F.when(day.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), day.try_cast("date")).cast("timestamp_ntz")
        t = F.when(slot.rlike("^([01][0-9]|2[0-3]):[03]0$"), slot).otherwise(other)
        clock = F.make_dt_interval(F.lit(0), F.substring(t, 1, 2).cast("int"), F.substring(t, 4, 2).cast("int"))
        return F.coalesce(d, today) + clock

    start, last = at(day_from, slot_from, "00:00"), at(day_to, slot_to, "23:30")
    good = start <= last
    return F.struct(F.when(good, start).otherwise(today).alias("start"), plus(F.when(good, last).otherwise(plus(today, hours=23, minutes=30)), minutes=30).alias("end"))


def last_days(n: int, as_of: dt.datetime) -> tuple[dt.datetime, dt.datetime]:
    """The last ``n`` whole days, today included."""
    today = dt.datetime.combine(as_of.date(), dt.time.min)
    return today - dt.timedelta(days=n - 1), today + dt.timedelta(days=1)


def latest_by(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key; the last column of ``order`` settles ties."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in df.columns if c not in keys]), F.struct(*order)).alias("last")).select(*keys, "last.*")


def split_component(component: Column) -> tuple[Column, Column]:
    """Key and value of ``{"key":value}``: in the value quotes and braces go, every T is a space and every Z goes."""
    key = F.substr(component, F.lit(3), F.instr(component, '":') - 3)
    value = F.translate(F.substr(component, F.instr(component, ":") + 1), 'T"}Z', " ")
    return key, value


def eav_split(components: DataFrame) -> DataFrame:
    key, value = split_component(F.col("component"))
    return components.select("amid", "fecha_hora", "tabla", key.alias("key"), value.alias("value"))


def eav_filter(split: DataFrame, first_device: int = FIRST_DEVICE, diffusion_table: int = DIFFUSION_TABLE) -> DataFrame:
    return split.where((F.col("amid") > first_device) & (F.col("tabla") == diffusion_table) & F.col("key").isin(*KEYS))


def eav_recent(master: DataFrame, components: DataFrame, as_of: Column, hours: int = 2, days: int | None = None) -> DataFrame:
    """Messages of known devices from the last hours, or from whole days back."""
    since = plus(midnight(as_of), days=-days) if days is not None else plus(as_of, hours=-hours)
    return components.where((F.col("fecha_hora") >= since) & F.col("component").isNotNull()).join(master, "amid")


def eav_pivot(filtered: DataFrame, carried: Sequence[str] = ()) -> DataFrame:
    """One row for each device and time with a column for each key, the largest value of each."""
    columns = [F.max(F.when(F.col("key") == k, F.col("value"))).alias(k) for k in KEYS]
    return filtered.groupBy("amid", "fecha_hora").agg(*columns, *(F.max(c).alias(c) for c in carried))


def append_new(existing: DataFrame, incoming: DataFrame, keys: Sequence[str] = ("amid", "fecha_hora")) -> DataFrame:
    """Rows of ``incoming`` whose key is not there yet, one for each key: that of least id, then of least values."""
    values = [c for c in incoming.columns if c not in keys]
    order = sorted(values, key=lambda c: c != "id")
    first = incoming.groupBy(*keys).agg(F.min_by(F.struct(*values), F.struct(*order)).alias("v")).select(*keys, "v.*").select(*incoming.columns) if values else incoming.distinct()
    return first.join(existing.select(*keys), list(keys), "left_anti").select(*incoming.columns)


def append_counts(existing: DataFrame, incoming: DataFrame, keys: Sequence[str] = ("amid", "fecha_hora")) -> DataFrame:
    """Rows obtained, created and skipped as duplicates by an append."""
    created = append_new(existing, incoming, keys).agg(F.count("*").alias("created"))
    return incoming.agg(F.count("*").alias("obtained")).crossJoin(created).select("obtained", "created", (F.col("obtained") - F.col("created")).alias("duplicates"))


def gps_flags(tel: DataFrame) -> DataFrame:
    """Whether a reading reports a position, a usable one, or ``0,0``."""
    reported = F.col("latitud").isNotNull() & F.col("longitud").isNotNull()
    zero = F.coalesce((F.col("latitud") == 0) & (F.col("longitud") == 0), F.lit(False))
    return tel.withColumns({"reported": reported, "zero": reported & zero, "valid": reported & ~zero})


def export_summary(tel: DataFrame) -> DataFrame:
    """Indicators of a device's readings: counts, first and last time, battery range and what the last row holds."""
    flags = gps_flags(tel)
    last = F.max_by(F.struct("porcentaje_bateria", "latitud", "longitud"), F.struct("fecha_hora", "id"))
    return (
        flags.groupBy("amid")
        .agg(
            F.count("*").alias("n_rows"),
            F.count("porcentaje_bateria").alias("n_battery"),
            F.count_if("reported").alias("n_gps"),
            F.count_if("zero").alias("n_zero"),
            F.min("fecha_hora").alias("first_ts"),
            F.max("fecha_hora").alias("last_ts"),
            F.min("porcentaje_bateria").alias("battery_min"),
            F.max("porcentaje_bateria").alias("battery_max"),
            last.alias("last"),
        )
        .select("*", F.col("last.porcentaje_bateria").alias("last_battery"), F.col("last.latitud").alias("last_lat"), F.col("last.longitud").alias("last_lon"))
        .drop("last")
    )


def latest_fixes(tel: DataFrame) -> DataFrame:
    """The time of each device's last usable fix, null if it has none; a table to keep, see :func:`merged_fixes`."""
    return gps_flags(tel).groupBy("amid").agg(F.max(F.when(F.col("valid"), F.col("fecha_hora"))).alias("last_valid_ts"))


def merged_fixes(stored: DataFrame, delivered: DataFrame) -> DataFrame:
    """The kept table after a delivery, of which alone the readings are read."""
    return stored.unionByName(latest_fixes(delivered)).groupBy("amid").agg(F.max("last_valid_ts").alias("last_valid_ts"))


def fallback_day(tel: DataFrame, start: Column, end: Column, latest: DataFrame | None = None) -> DataFrame:
    """For each device the day to show: that of the range, or, without a reported fix in it, the day of its last usable fix.

    With the kept table of latest fixes only the readings of the range are read.
    """
    inside = tel.where((F.col("fecha_hora") >= start) & (F.col("fecha_hora") < end))
    reported = gps_flags(inside).groupBy("amid").agg(F.count_if("reported").alias("n"))
    facts = (latest_fixes(tel) if latest is None else latest).join(reported, "amid", "left").withColumn("n_reported", F.coalesce("n", F.lit(0)))
    back = (F.col("n_reported") == 0) & F.col("last_valid_ts").isNotNull()
    return facts.select("amid", "n_reported", "last_valid_ts", F.when(back, F.to_date("last_valid_ts")).otherwise(F.to_date(start)).alias("day"), back.alias("fell_back"))
