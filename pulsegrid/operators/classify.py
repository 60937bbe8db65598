"""Classification of device summaries by ordered rule cascades.

Each cascade yields a reason code; level and text follow from the code, so the full and the fast path cannot differ.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Levels and texts of the reasons.
GPS_REASONS = {
    "G1": ("CRITICA", "GPS 0,0 crítico hoy"),
    "G2": ("CRITICA", "Porcentaje crítico de GPS 0,0 hoy"),
    "G3": ("CRITICA", "Racha crítica de GPS 0,0 hoy"),
    "G4": ("ALTA", "GPS 0,0 alto hoy"),
    "G5": ("ALTA", "Porcentaje alto de GPS 0,0 hoy"),
    "G6": ("ALTA", "Racha alta de GPS 0,0 hoy"),
    "G7": ("ADVERTENCIA", "Último GPS reportado es 0,0"),
    "G8": ("ADVERTENCIA", "GPS 0,0 aislado hoy"),
    "G9": ("ADVERTENCIA", "GPS 0,0 histórico alto"),
    "G10": ("ADVERTENCIA", "Porcentaje histórico GPS 0,0 alto"),
    "G0": ("OK", "Sin alerta GPS"),
}
BATTERY_REASONS = {
    "B1": ("CRITICA", "Caída crítica de batería hoy"),
    "B2": ("CRITICA", "Caída confirmada hacia 0% hoy"),
    "B3": ("CRITICA", "Caídas recurrentes hoy"),
    "B4": ("CRITICA", "Caída severa hoy con historial"),
    "B5": ("CRITICA", "Batería 0 persistente hoy"),
    "B6": ("ALTA", "Caída brusca de batería hoy"),
    "B7": ("ALTA", "Caída hoy con historial"),
    "B8": ("ALTA", "Caídas recurrentes históricas"),
    "B9": ("ALTA", "Caída histórica severa"),
    "B10": ("ALTA", "Batería 0 activa hoy"),
    "B11": ("ADVERTENCIA", "Batería 0 aislada hoy"),
    "B12": ("ADVERTENCIA", "Batería 0 reportada hoy, actual normal"),
    "B13": ("ADVERTENCIA", "Batería 0 histórica alta"),
    "B14": ("ADVERTENCIA", "Caída histórica aislada"),
    "B0": ("OK", "Sin alerta batería"),
}
BOTH_HIGH, BOTH_WARN, NO_REASON = "GPS y batería con alertas altas", "GPS y batería con advertencias", "Sin alertas"
ACTIONS = {"both": "Revisar GPS y batería", "gps": "Revisar GPS", "battery": "Revisar batería", "none": "Sin acción"}


def _first(branches: dict[str, Column], otherwise: str) -> Column:
    out = None
    for code, holds in branches.items():
        out = F.when(holds, code) if out is None else out.when(holds, code)
    return out.otherwise(otherwise)


def _look_up(code: str, table: dict[str, tuple[str, str]], part: int) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for k, v in table.items() for x in (k, v[part]))), F.col(code))


def gps_code() -> Column:
    c = F.col
    zero_today, streak = c("gps_zero_today"), c("max_zero_streak")
    zero_last_today = c("last_zero_fix_ts") >= c("day_start")
    return _first(
        {
            "G1": zero_today >= c("GPS_CERO_HOY_CRITICA"),
            "G2": (c("gps_zero_pct_today") >= c("GPS_PORC_HOY_CRITICA")) & (c("gps_total_today") >= c("GPS_TOTAL_HOY_CRITICA")),
            "G3": (streak >= c("GPS_RACHA_CRITICA")) & zero_last_today,
            "G4": zero_today.between(c("GPS_CERO_HOY_ALTA"), c("GPS_CERO_HOY_ALTA_MAX")),
            "G5": (c("gps_zero_pct_today") >= c("GPS_PORC_HOY_ALTA")) & (c("gps_total_today") >= c("GPS_TOTAL_HOY_ALTA")),
            "G6": (streak >= c("GPS_RACHA_ALTA")) & zero_last_today,
            "G7": c("last_fix_is_zero") == 1,
            "G8": zero_today.between(c("GPS_CERO_HOY_ADV"), c("GPS_CERO_HOY_ADV_MAX")),
            "G9": c("gps_zero_window") >= c("GPS_CERO_HIST_ADV"),
            "G10": c("gps_zero_pct_window") >= c("GPS_PORC_HIST_ADV"),
        },
        "G0",
    )


def battery_code() -> Column:
    c = F.col
    now = F.coalesce(c("battery_now"), F.lit(-1))
    largest, zero_today = c("max_drop_today").cast("double"), c("battery_zero_today")
    return _first(
        {
            "B1": largest >= c("BAT_CAIDA_HOY_CRITICA"),
            "B2": (c("last_drop_to") == 0) & (c("last_drop_ts") >= c("day_start")),
            "B3": c("drops_today") >= c("BAT_CAIDAS_HOY_CRITICA"),
            "B4": (largest >= c("BAT_CAIDA_HOY_CRITICA_CON_HIST")) & (c("drops_window") >= 1),
            "B5": (now == 0) & (zero_today >= c("BAT_CERO_HOY_CRITICA")),
            "B6": (largest >= c("BAT_CAIDA_HOY_ALTA")) & (largest < c("BAT_CAIDA_HOY_CRITICA")),
            "B7": c("drops_today").between(1, 2) & (c("drops_window") >= 1),
            "B8": c("drops_window") >= c("BAT_CAIDAS_HIST_ALTA"),
            "B9": c("max_drop_window").cast("double") >= c("BAT_CAIDA_MAX_HIST_ALTA"),
            "B10": zero_today.between(c("BAT_CERO_HOY_ALTA_MIN"), c("BAT_CERO_HOY_ALTA_MAX")) & (now == 0),
            "B11": zero_today.between(c("BAT_CERO_HOY_ADV_MIN"), c("BAT_CERO_HOY_ADV_MAX")),
            "B12": (zero_today >= c("BAT_CERO_HOY_ALTA_MIN")) & (now > 0),
            "B13": c("battery_zero_window") >= c("BAT_CERO_HIST_ADV"),
            "B14": c("drops_window").between(1, 2) & (c("drops_today") == 0),
        },
        "B0",
    )


def classify(summary: DataFrame, rules: DataFrame) -> DataFrame:
    """The summary with codes, levels, texts, the overall level, main reason, action and alert flag; ``rules`` is one row."""
    coded = summary.crossJoin(F.broadcast(rules)).withColumns({"gps_code": gps_code(), "battery_code": battery_code()}).drop(*rules.columns)  # one row
    texts = coded.withColumns(
        {
            "gps_level": _look_up("gps_code", GPS_REASONS, 0),
            "gps_reason": _look_up("gps_code", GPS_REASONS, 1),
            "battery_level": _look_up("battery_code", BATTERY_REASONS, 0),
            "battery_reason": _look_up("battery_code", BATTERY_REASONS, 1),
        }
    )
    g, b = F.col("gps_level"), F.col("battery_level")
    either = lambda level: (g == level) | (b == level)
    both = lambda level: (g == level) & (b == level)
    level = F.when(either("CRITICA"), "CRITICA").when(either("ALTA"), "ALTA").when(both("ADVERTENCIA"), "ALTA").when(either("ADVERTENCIA"), "ADVERTENCIA").otherwise("OK")
    reason = F.when(g == "CRITICA", F.col("gps_reason")).when(b == "CRITICA", F.col("battery_reason"))
    for name, combined in (("ALTA", BOTH_HIGH), ("ADVERTENCIA", BOTH_WARN)):
        reason = reason.when(both(name), combined).when(g == name, F.col("gps_reason")).when(b == name, F.col("battery_reason"))
    action = F.when((g != "OK") & (b != "OK"), ACTIONS["both"]).when(g != "OK", ACTIONS["gps"]).when(b != "OK", ACTIONS["battery"]).otherwise(ACTIONS["none"])
    explained = texts.withColumns({"level": level, "main_reason": reason.otherwise(NO_REASON), "action": action})
    return explained.withColumn("has_alert", (F.col("level") != "OK").cast("int"))


CLASSIFICATION = ("gps_code", "battery_code", "gps_level", "gps_reason", "battery_level", "battery_reason", "level", "main_reason", "action", "has_alert")


def reclassify(summary: DataFrame, master: DataFrame, rules: DataFrame, as_of: Column) -> DataFrame:
    """Classify stored measures of active devices anew, without reading telemetry; ``rules_applied_at`` says when."""
    active = summary.join(master.where(F.col("active") == 1).select("amid"), "amid", "left_semi")
    return classify(active.drop(*CLASSIFICATION, "rules_applied_at"), rules).withColumn("rules_applied_at", as_of)
