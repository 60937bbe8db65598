"""Positions against the expected location that was valid at the time of each fix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.functions import scalars as s
from pulsegrid.operators.telemetry import gps_flags

SITE = ("nombre", "lat", "lon", "radio", "operativa", "source")


def _complete(df: DataFrame) -> DataFrame:
    return df.where(F.col("lat").isNotNull() & F.col("lon").isNotNull() & F.col("radio").isNotNull())


def expected_location_asof(fixes: DataFrame, history: DataFrame, current: DataFrame, lab: dict) -> DataFrame:
    """Each fix with its expected site: the newest complete version valid at its time, else the complete current one (of several the last loaded), else the lab.

    Location ids are text, and any text; those that are no device's meet no fix.

    A device has few versions, so they are gathered in one array for each device and the equi-join adds a row's candidates without
    multiplying the fixes; the array is scanned in place.
    """
    site = lambda source: F.struct(F.coalesce(F.nullif(F.trim("nombre"), F.lit("")), F.lit(lab["nombre"])).alias("nombre"), "lat", "lon", "radio", "operativa", F.lit(source).alias("source"))
    versions = _complete(history).groupBy(F.col("amid").alias("__site")).agg(F.array_sort(F.collect_list(F.struct("inicio", "fin", site("history").alias("site")))).alias("versions"))
    newest = F.struct(*(c for c in ("fecha_carga", "nombre", "lat", "lon", "radio") if c in current.columns))
    now = _complete(current).groupBy(F.col("amid").alias("__site")).agg(F.max_by(site("current"), newest).alias("now"))
    default = F.struct(F.lit(lab["nombre"]).alias("nombre"), F.lit(lab["lat"]).alias("lat"), F.lit(lab["lon"]).alias("lon"), F.lit(lab["radio"]).alias("radio"), F.lit(0).alias("operativa"), F.lit("lab").alias("source"))
    t = F.col("fecha_hora")
    valid = F.filter("versions", lambda v: (v["inicio"] <= t) & (v["fin"].isNull() | (t < v["fin"])))
    joined = fixes.withColumn("__site", F.col("amid").cast("string")).join(versions, "__site", "left").join(now, "__site", "left")
    chosen = joined.withColumn("site", F.coalesce(F.try_element_at(valid, F.lit(-1))["site"], F.col("now"), default))
    return chosen.select(*fixes.columns, *(F.col(f"site.{c}").alias(f"site_{c}") for c in SITE))


def evaluate(fixes: DataFrame, history: DataFrame, current: DataFrame, lab: dict) -> DataFrame:
    """Reported fixes with expected site, distance and whether they lie inside; ``0,0`` is outside and has no distance."""
    placed = expected_location_asof(gps_flags(fixes).where("reported"), history, current, lab)
    distance = F.when(~F.col("zero"), s.haversine_m(F.col("latitud"), F.col("longitud"), F.col("site_lat"), F.col("site_lon")))
    return placed.withColumn("distance", distance).withColumn("inside", F.when(F.col("zero"), False).otherwise(F.col("distance") <= F.col("site_radio")))


def gps_compliance(tel: DataFrame, evaluated: DataFrame) -> DataFrame:
    """Counts of a period for each device and the share inside, to one place, half to even."""
    errors = tel.groupBy("amid").agg(F.count_if("is_error_obtener_gps").alias("errors"))
    counts = evaluated.groupBy("amid").agg(F.count("*").alias("reported"), F.count_if("valid").alias("valid"), F.count_if("zero").alias("zero"), F.count_if("inside").alias("inside"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    rows = errors.join(counts, "amid", "left").select("amid", "errors", *(zero(c).alias(c) for c in ("reported", "valid", "zero", "inside")))
    pct = F.bround(F.col("inside") * 100.0 / F.nullif("reported", F.lit(0)), 1)
    rows = rows.withColumns({"outside": F.col("reported") - F.col("inside"), "inside_pct": pct})
    return rows.withColumns({"error_band": s.error_band(F.col("errors")), "compliance_band": s.compliance_band(F.col("inside_pct"))})


def gps_track(evaluated: DataFrame) -> DataFrame:
    """Every evaluated fix as drawn on a map."""
    return evaluated.select("amid", "id", "fecha_hora", "latitud", "longitud", "porcentaje_bateria", F.bround("distance", 2).alias("distance"), "inside", "zero", "site_nombre", "site_lat", "site_lon", "site_radio", "site_source").orderBy("amid", "fecha_hora", "id")


def location_changes(evaluated: DataFrame) -> DataFrame:
    """Whether the expected site differs from that of the fix before, and its name; newest first."""
    w = Window.partitionBy("amid").orderBy("fecha_hora", "id")
    site = F.struct(*(f"site_{c}" for c in ("nombre", "lat", "lon", "radio")))
    rows = evaluated.withColumn("before", F.lag(site).over(w))
    changed = F.col("before").isNotNull() & ~F.col("before").eqNullSafe(site)
    return rows.select("amid", "id", "fecha_hora", "inside", "zero", "site_nombre", F.col("before.site_nombre").alias("previous_nombre"), changed.alias("changed")).orderBy("amid", F.desc("fecha_hora"), F.desc("id"))


def gps_history_filter(changes: DataFrame, name: str) -> DataFrame:
    """``inside``, ``outside`` (not 0,0), ``zero`` or ``changes``; any other name shows all."""
    by = {"inside": F.col("inside"), "outside": ~F.col("inside") & ~F.col("zero"), "zero": F.col("zero"), "changes": F.col("changed")}
    return changes.where(by.get(name, F.lit(True)))


def last_fix_status(evaluated: DataFrame, as_of: Column) -> DataFrame:
    """Last reported and last usable fix of each device, with the distance of the former from its site."""
    order = F.struct("fecha_hora", "id")
    last = F.max_by(F.struct("fecha_hora", "latitud", "longitud", "zero", "inside", "distance", "site_nombre"), order)
    usable = F.max_by(F.struct("fecha_hora", "latitud", "longitud"), F.when(F.col("valid"), order))
    rows = evaluated.groupBy("amid").agg(last.alias("l"), usable.alias("u"))
    return rows.select(
        "amid",
        F.col("l.fecha_hora").alias("last_ts"),
        F.col("l.zero").alias("last_is_zero"),
        F.col("l.inside").alias("inside"),
        F.bround("l.distance", 2).alias("distance"),
        F.col("l.site_nombre").alias("site_nombre"),
        F.col("u.fecha_hora").alias("usable_ts"),
        F.col("u.latitud").alias("usable_lat"),
        F.col("u.longitud").alias("usable_lon"),
        s.age_band(F.col("l.fecha_hora"), as_of).alias("age_band"),
    )
