"""Fleet tables as projections of the generic tables, for queries and tests that have no telemetry of their own."""

from __future__ import annotations

import datetime as dt
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "2024-01-30 23:59:59"
AS_OF_TIME = dt.datetime.fromisoformat(AS_OF)
# The default site.
LAB = {"nombre": "Laboratorio", "lat": -33.437191, "lon": -70.656102, "radio": 150.0}
FIRST_EAV_DEVICE = 7_499_990
#: Fleets whose rules are made by one task, however few files hold their keys.
FLEETS_A_TASK = 20_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry_of(table(spark, sf_dir, "events"))


def telemetry_of(events: DataFrame) -> DataFrame:
    kind, n = F.col("event_type"), F.col("event_id")

    def coordinate(base: float, offset) -> Column:
        return F.when(kind == "signup", None).when(kind == "error", 0.0).otherwise(F.lit(base) + offset * F.lit(0.0005)).cast("double")

    return events.select(
        n.alias("id"),
        F.col("user_id").alias("amid"),
        F.col("ts").alias("fecha_hora"),
        F.when(kind == "view", None).otherwise(F.greatest(F.lit(0), F.floor("value").cast("int") % 101 - 10)).alias("porcentaje_bateria"),
        coordinate(-33.437191, n % 7 - 3).alias("latitud"),
        coordinate(-70.656102, n % 5 - 2).alias("longitud"),
        kind.isin("error", "signup").alias("is_error_obtener_gps"),
        F.date_trunc("day", "ts").cast("timestamp_ntz").alias("fec_descarga"),
        F.col("ts").alias("fec_estado"),
    )


def components(tel: DataFrame) -> DataFrame:
    """One text message for each known key of a reading, as ``{"key":value}``."""

    def message(key: str, value) -> Column:
        return F.when(value.isNotNull(), F.concat(F.lit('{"' + key + '":'), value, F.lit("}")))

    fixed = lambda c: F.col(c).cast("decimal(20,6)").cast("string")
    parts = F.array(
        message("porcentajeBateria", F.col("porcentaje_bateria").cast("string")),
        message("latitud", fixed("latitud")),
        message("longitud", fixed("longitud")),
        message("isErrorObtenerGps", F.col("is_error_obtener_gps").cast("string")),
        message("tiempoVida", F.concat(F.lit('"'), F.date_format("fecha_hora", "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit('"'))),
        message("otraClave", F.lit("1")),
    )
    rows = tel.select((F.col("amid") + FIRST_EAV_DEVICE).alias("amid"), "fecha_hora", F.when(F.col("id") % 10 == 3, 15).otherwise(16).alias("tabla"), F.explode(parts).alias("component"))
    return rows.where(F.col("component").isNotNull())


def master(spark: SparkSession, sf_dir: str) -> DataFrame:
    amid = F.col("user_id")
    rows = table(spark, sf_dir, "events").select(amid.alias("amid")).distinct()
    return rows.select("amid", F.when(F.col("amid") % 10 == 9, 0).otherwise(1).alias("active"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("last_update"))


def _located(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    customers = table(spark, sf_dir, "customer").where(key % 7 != 6)
    return customers.join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(
        key.alias("key"),
        F.when(key % 97 == 96, F.concat(F.lit("LAB-"), key)).otherwise(key.cast("string")).alias("amid"),
        F.when(key % 11 == 10, "  ").otherwise(F.concat(F.lit("Estación "), F.col("n_name"))).alias("nombre"),
        F.concat(F.lit("S"), key.cast("string")).alias("serie"),
        (F.lit(-33.437191) + (F.col("c_nationkey") - 12) * F.lit(0.0002)).cast("double").alias("lat"),
        F.lit(-70.656102).cast("double").alias("lon"),
        (50 + key % 4 * 50).cast("double").alias("radio"),
        F.when(key % 5 == 4, 0).otherwise(1).alias("operativa"),
    )


def locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _located(spark, sf_dir).drop("key").withColumns({"version": F.lit("V1"), "archivo": F.lit("base.csv"), "origen": F.lit("excel"), "fecha_carga": F.lit("2024-01-21 00:00:00").cast("timestamp_ntz")})


def location_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three versions for each located device, with gaps that make an as-of search fall through."""
    starts = ("2024-01-01 00:00:00", "2024-01-11 00:00:00", "2024-01-21 00:00:00", None)
    versions = F.array(*(F.struct(F.lit(v).alias("v"), F.lit(starts[v]).cast("timestamp_ntz").alias("inicio"), F.lit(starts[v + 1]).cast("timestamp_ntz").alias("fin")) for v in range(3)))
    rows = _located(spark, sf_dir).select("*", F.explode(versions).alias("x"))
    rows = rows.where((F.col("key") % 17 != 16) | (F.col("x.v") == 0))
    shift = F.lit(0.0004) * F.col("x.v")
    return rows.select(
        "amid",
        "nombre",
        "serie",
        (F.col("lat") + shift).alias("lat"),
        "lon",
        F.when((F.col("key") % 13 == 12) & (F.col("x.v") == 1), None).otherwise(F.col("radio")).alias("radio"),
        "operativa",
        F.lit("V1").alias("version"),
        F.lit("excel").alias("origen"),
        F.col("x.inicio").alias("inicio"),
        F.col("x.fin").alias("fin"),
    )


def snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A delivery of expected locations as text, under spreadsheet headers; some rows are faulty or repeated, some devices missing."""
    key = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").where(key % 5 != 3).join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    copies = F.explode(F.when(key % 19 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    micro = F.lit(-33437191) + (F.col("c_nationkey") - 12) * 200
    decimal_text = lambda n: F.concat(F.lit("-"), F.floor(-n / 1_000_000).cast("string"), F.when(key % 2 == 0, ".").otherwise(","), F.lpad((-n % 1_000_000).cast("string"), 6, "0"))
    return rows.select("*", copies.alias("copy")).select(
        (key * 2 + F.col("copy")).alias("orden"),
        F.when(key % 23 == 22, "").when(key % 3 == 0, F.concat(key.cast("string"), F.lit(".0"))).otherwise(key.cast("string")).alias("IDDS"),
        F.when(key % 11 == 10, " nan ").otherwise(F.concat(F.lit("Estación "), F.col("n_name"), F.when(F.col("copy") == 1, " bis").otherwise(""))).alias("Nombre"),
        F.concat(F.lit(" S"), key.cast("string"), F.lit(" ")).alias("SERIE VAL."),
        decimal_text(micro).alias("Latitud"),
        F.lit("-70.656102").alias("LONGITUD"),
        F.when(key % 7 == 2, "quizás").when(key % 7 == 5, "no").when(key % 2 == 0, "SI").otherwise(" sí ").alias("OPERATIVA"),
        F.when(key % 29 == 28, "").otherwise((50 + key % 4 * 50).cast("string")).alias("Radio"),
    )


def rule_sets(spark: SparkSession, sf_dir: str, values: dict[str, float], detection: tuple[str, ...]) -> DataFrame:
    """Rules of many fleets, one for each customer: a standard set with faults and changes that follow the key."""
    key = F.col("c_custkey")
    rows = F.explode(F.array(*(F.struct(F.lit(k).alias("key"), F.lit(float(v)).alias("value"), F.lit("DETECCION" if k in detection else "CLASIFICACION").alias("type")) for k, v in values.items())))
    customers = table(spark, sf_dir, "customer").select(key.alias("fleet"))
    spread = customers.repartition(max(spark.sparkContext.defaultParallelism, math.ceil(customers.count() / FLEETS_A_TASK)), "fleet")  # counted from the footers of the files
    fleets = spread.select("fleet", rows.alias("r")).select("fleet", "r.*")
    changed = (
        F.when((F.col("fleet") % 13 == 1) & (F.col("key") == "GPS_CERO_HOY_ALTA_MAX"), 99.0)
        .when((F.col("fleet") % 13 == 2) & (F.col("key") == "GPS_PORC_HOY_CRITICA"), 101.0)
        .when((F.col("fleet") % 13 == 3) & (F.col("key") == "BAT_CAIDA_MAX_HORAS"), 0.0)
        .when((F.col("fleet") % 13 == 4) & (F.col("key") == "BAT_CERO_HIST_ADV"), -1.0)
        .when((F.col("fleet") % 13 == 5) & (F.col("key") == "GPS_RACHA_ALTA"), 9999.0)
        .when((F.col("fleet") % 13 == 6) & (F.col("key") == "BAT_CERO_HOY_ADV_MAX"), 50.0)
        .when((F.col("fleet") % 13 == 7) & (F.col("key") == "BAT_CAIDA_HOY_ALTA"), 60.0)
        .when((F.col("fleet") % 13 == 9) & (F.col("key") == "GPS_CERO_HIST_ADV"), None)
        .otherwise(F.col("value"))
    )
    active = F.when((F.col("fleet") % 13 == 8) & (F.col("key") == "GPS_RACHA_CRITICA"), 0).otherwise(1)
    return fleets.select("fleet", "key", changed.cast("decimal(12,4)").alias("value"), active.alias("active"), "type")
