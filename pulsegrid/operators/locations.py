"""Expected locations: deliveries, their history with validity in time, and devices that a delivery leaves out."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.functions import scalars as s
from pulsegrid.operators.merge import merge_by_key

# Normalised headers of a delivery and the columns they name.
HEADERS = {
    "codigo zp ts": "codigo_zp_ts",
    "cod parada1": "cod_parada1",
    "cod parada2": "cod_parada2",
    "nombre": "nombre",
    "comuna": "comuna",
    "unidad": "unidad",
    "operador": "operador",
    "un": "un",
    "u n secundaria 1": "un_secundaria_1",
    "u n secundaria 2": "un_secundaria_2",
    "u n secundaria 3": "un_secundaria_3",
    "pst": "pst",
    "servicios": "servicios",
    "total val vigentes por zp": "total_val_vigentes_zp",
    "horario": "horario",
    "horario laboral pm": "horario_laboral_pm",
    "horario sabado": "horario_sabado",
    "horario domingo": "horario_domingo",
    "inicio operacion": "inicio_operacion",
    "fin operacion": "fin_operacion",
    "patente": "patente",
    "op id": "op_id",
    "bus id": "bus_id",
    "serie val": "serie",
    "idds": "idds",
    "n val": "num_val",
    "latitud": "lat",
    "longitud": "lon",
    "x": "x",
    "y": "y",
    "operativa": "operativa",
    "contingencia": "contingencia",
    "mixta": "mixta",
    "radio": "radio",
    "tipo": "tipo",
    "renovada": "renovada",
}
REQUIRED = ("idds", "operativa", "nombre", "lat", "lon", "radio")
NUMBERS = ("total_val_vigentes_zp", "op_id", "bus_id", "x", "y")
DATES = ("inicio_operacion", "fin_operacion")
ATTRIBUTES = ("nombre", "serie", "lat", "lon", "radio", "operativa", "version", "origen")


def header_key(name: str) -> str:
    plain = "".join(c for c in unicodedata.normalize("NFKD", name.strip().lower()) if not unicodedata.combining(c))
    return re.sub(r"[^a-z0-9]+", " ", plain).strip()


def normalize_snapshot_columns(df: DataFrame) -> DataFrame:
    """Known headers under their own names and all other known columns as null; raises if a required one is missing."""
    names = {c: HEADERS[header_key(c)] for c in df.columns if header_key(c) in HEADERS}
    if missing := sorted(set(REQUIRED) - set(names.values())):
        raise ValueError(f"missing columns: {', '.join(missing)}")
    absent = {c: F.lit(None).cast("string") for c in HEADERS.values() if c not in names.values()}
    return df.withColumnsRenamed(names).withColumns(absent)


def normalize_snapshot(df: DataFrame, version: str | None, file: str, as_of: Column, lab: dict) -> DataFrame:
    """Usable rows of a delivery with typed columns; inoperative devices are at the lab site.

    Rows without an id, with an unknown ``operativa``, or operative without position and radius are left out.
    """
    flag = F.upper(F.trim("operativa"))
    yes, no = flag.isin("SI", "SÍ"), flag == "NO"
    typed = df.select(
        *(c for c in df.columns if c not in HEADERS.values()),
        s.device_text(F.col("idds")).alias("amid"),
        yes.alias("yes"),
        no.alias("no"),
        s.text_or_null(F.col("nombre")).alias("nombre"),
        s.text_or_null(F.col("serie")).alias("serie"),
        *(s.number_or_null(F.col(c)).alias(c) for c in ("lat", "lon", "radio", *NUMBERS)),
        *(s.timestamp_or_null(F.col(c)).alias(c) for c in DATES),
        *(s.text_or_null(F.col(c)).alias(c) for c in HEADERS.values() if c not in {"idds", "operativa", "nombre", "serie", "lat", "lon", "radio", *NUMBERS, *DATES}),
    )
    complete = F.col("lat").isNotNull() & F.col("lon").isNotNull() & F.col("radio").isNotNull()
    kept = typed.where(F.col("amid").isNotNull() & (F.col("no") | (F.col("yes") & complete)))
    at_lab = {k: F.when(F.col("yes"), F.col(k)).otherwise(F.lit(lab[k])) for k in ("nombre", "lat", "lon", "radio")}
    return (
        kept.withColumns(at_lab)
        .withColumns(
            {
                "operativa": F.col("yes").cast("int"),
                "origen": F.when(F.col("yes"), "excel").otherwise("laboratorio"),
                "version": F.lit(version).cast("string"),
                "archivo": F.lit(file),
                "fecha_carga": as_of,
            }
        )
        .drop("yes", "no")
    )


def last_of_each(snapshot: DataFrame, order: str) -> DataFrame:
    """One row for each device: the last delivered."""
    w = Window.partitionBy("amid").orderBy(F.desc(order))
    return snapshot.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n", order)


def upsert_current(current: DataFrame, snapshot: DataFrame) -> DataFrame:
    """The current locations with those delivered in place of the old ones."""
    return merge_by_key(current, snapshot.select(*(c for c in snapshot.columns if c in current.columns)), ["amid"])


def open_history(history: DataFrame) -> DataFrame:
    """The latest open version of each device."""
    w = Window.partitionBy("amid").orderBy(F.desc("inicio"))
    return history.where(F.col("fin").isNull()).withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def _same(a: str, b: str) -> Column:
    """Equal on all attributes; texts as blank when null, numbers at 7 decimals."""
    text = lambda c: F.coalesce(F.trim(c), F.lit(""))
    ok = F.col(f"{a}.operativa").eqNullSafe(F.col(f"{b}.operativa"))
    for c in ("nombre", "serie", "origen", "version"):
        ok &= text(f"{a}.{c}") == text(f"{b}.{c}")
    for c in ("lat", "lon", "radio"):
        ok &= s.same_7dp(F.col(f"{a}.{c}"), F.col(f"{b}.{c}"))
    return ok


def snapshot_actions(history: DataFrame, snapshot: DataFrame) -> DataFrame:
    """What a delivery does to the history of each device: ``opened``, ``reopened`` or ``unchanged``."""
    now = open_history(history).select("amid", F.struct(*ATTRIBUTES, "inicio").alias("old"))
    new = snapshot.select("amid", F.struct(*ATTRIBUTES).alias("new"))
    action = F.when(F.col("old").isNull(), "opened").when(_same("old", "new"), "unchanged").otherwise("reopened")
    return new.join(now, "amid", "left").withColumn("action", action)


def apply_history(history: DataFrame, snapshot: DataFrame, as_of: Column) -> DataFrame:
    """History after a delivery: changed versions end at its time and new ones begin; the rest is as before."""
    acts = snapshot_actions(history, snapshot)
    ended = acts.where("action = 'reopened'").select("amid", F.col("old.inicio").alias("inicio"), F.lit(True).alias("__ends"))
    closed = history.join(ended, ["amid", "inicio"], "left").withColumn("fin", F.when(F.col("__ends") & F.col("fin").isNull(), as_of).otherwise(F.col("fin"))).drop("__ends")
    opened = acts.where("action <> 'unchanged'").select("amid", "new.*", as_of.alias("inicio"), F.lit(None).cast("timestamp_ntz").alias("fin"))
    return closed.unionByName(opened)


def absent_devices(current: DataFrame, snapshot: DataFrame) -> DataFrame:
    return current.join(snapshot.select("amid"), "amid", "left_anti")


def moved_to_lab(current: DataFrame, history: DataFrame, snapshot: DataFrame, version: str | None, file: str, as_of: Column, lab: dict) -> DataFrame:
    """New current rows of the absent devices that are not at the lab yet; of their old row only the serial stays."""
    now = open_history(history).select("amid", F.struct(*ATTRIBUTES).alias("old"))
    at_lab = (
        (F.coalesce(F.trim("old.nombre"), F.lit("")) == lab["nombre"])
        & s.same_7dp(F.col("old.lat"), F.lit(lab["lat"]))
        & s.same_7dp(F.col("old.lon"), F.lit(lab["lon"]))
        & s.same_7dp(F.col("old.radio"), F.lit(lab["radio"]))
        & (F.col("old.operativa") == 0)
    )
    moving = absent_devices(current, snapshot).select("amid", "serie").join(now, "amid", "left").where(~F.coalesce(at_lab, F.lit(False)))
    return moving.select(
        "amid",
        F.lit(lab["nombre"]).alias("nombre"),
        "serie",
        F.lit(lab["lat"]).alias("lat"),
        F.lit(lab["lon"]).alias("lon"),
        F.lit(lab["radio"]).alias("radio"),
        F.lit(0).alias("operativa"),
        F.lit(version).cast("string").alias("version"),
        F.lit(file).alias("archivo"),
        F.lit("laboratorio_default").alias("origen"),
        as_of.alias("fecha_carga"),
    )


def move_absent(current: DataFrame, history: DataFrame, snapshot: DataFrame, version: str | None, file: str, as_of: Column, lab: dict) -> tuple[DataFrame, DataFrame]:
    """Current locations and history after the absent devices went to the lab."""
    moved = moved_to_lab(current, history, snapshot, version, file, as_of, lab)
    ending = open_history(history).join(moved.select("amid"), "amid", "left_semi").select("amid", "inicio", F.lit(True).alias("__ends"))
    closed = history.join(ending, ["amid", "inicio"], "left").withColumn("fin", F.when(F.col("__ends") & F.col("fin").isNull(), as_of).otherwise(F.col("fin"))).drop("__ends")
    opened = moved.select("amid", *ATTRIBUTES, as_of.alias("inicio"), F.lit(None).cast("timestamp_ntz").alias("fin"))
    return merge_by_key(current, moved.select(*(c for c in moved.columns if c in current.columns)), ["amid"]), closed.unionByName(opened)


def import_counts(raw: DataFrame, usable: DataFrame, current: DataFrame, history: DataFrame, snapshot: DataFrame, moved: DataFrame) -> DataFrame:
    """Eight counters of an import, one row for each: rows delivered, skipped, current created and updated, history opened, closed and unchanged, moved to the lab."""
    one = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("counter"), "n")
    acts = snapshot_actions(history, snapshot)
    known = current.select("amid")
    had_open = open_history(history).select("amid")
    parts = [
        one(raw, "rows"),
        raw.agg(F.count("*").alias("a")).crossJoin(usable.agg(F.count("*").alias("b"))).select(F.lit("skipped").alias("counter"), (F.col("a") - F.col("b")).alias("n")),
        one(snapshot.join(known, "amid", "left_anti"), "created"),
        one(snapshot.join(known, "amid", "left_semi"), "updated"),
        one(acts.where("action <> 'unchanged'").select("amid").unionByName(moved.select("amid")), "history_opened"),
        one(acts.where("action = 'reopened'").select("amid").unionByName(moved.join(had_open, "amid", "left_semi").select("amid")), "history_closed"),
        one(acts.where("action = 'unchanged'"), "history_unchanged"),
        one(moved, "moved"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def purge_history(history: DataFrame, as_of: Column, days: int = 16) -> DataFrame:
    """Without versions that ended more than some days ago; open ones stay."""
    if days < 1:
        raise ValueError("at least one day is kept")
    return history.where(F.col("fin").isNull() | (F.col("fin") >= s.plus(as_of, days=-days)))


def purge_blocks(blocks: DataFrame, as_of: Column, days: int = 16) -> DataFrame:
    return blocks.where(F.col("slot") >= s.plus(s.midnight(as_of), days=-days))


def sync_master(master: DataFrame, tel: DataFrame, as_of: Column) -> DataFrame:
    """New devices are active; known ones that report get a new time and keep their flag."""
    seen = tel.select("amid").distinct().withColumn("__seen", F.lit(True))
    return master.join(seen, "amid", "full_outer").select("amid", F.coalesce("active", F.lit(1)).alias("active"), F.when(F.col("__seen"), as_of).otherwise(F.col("last_update")).alias("last_update"))
