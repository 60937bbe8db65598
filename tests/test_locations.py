import pytest
from pyspark.sql import functions as F

from pulsegrid.functions import scalars as s
from pulsegrid.operators import alerts, compliance, locations
from pulsegrid.sources import files, fixtures
from pulsegrid.sources.fixtures import LAB

def moment():
    return s.ntz("2024-01-30 12:00:00")
SITE = "amid string, nombre string, serie string, lat double, lon double, radio double, operativa int, version string, origen string"
HISTORY = f"{SITE}, inicio timestamp_ntz, fin timestamp_ntz"


def site(amid="1", name="A", lat=-33.4, radio=100.0, version="V1"):
    return (amid, name, "S1", lat, -70.6, radio, 1, version, "excel")


@pytest.fixture
def resolved(spark, at):
    def run(times, history, current=()):
        fixes = spark.createDataFrame([(i, 1, t) for i, t in enumerate(times)], "id long, amid long, fecha_hora timestamp_ntz")
        out = compliance.expected_location_asof(fixes, spark.createDataFrame(list(history), HISTORY), spark.createDataFrame(list(current), SITE), LAB)
        return [(r["site_nombre"], r["site_source"]) for r in out.orderBy("id").collect()]

    return run


def test_validity_is_half_open(resolved, at):
    history = [(*site(name="A"), at(5), at(10))]
    assert resolved([at(4), at(5), at(9, 23), at(10)], history) == [("Laboratorio", "lab"), ("A", "history"), ("A", "history"), ("Laboratorio", "lab")]


def test_newest_complete_version_wins_then_current_then_lab(resolved, at):
    history = [(*site(name="old"), at(1), None), (*site(name="new"), at(5), None), (*site(name="broken", radio=None), at(6), None)]
    assert resolved([at(7)], history) == [("new", "history")]
    assert resolved([at(7)], [(*site(name="x", radio=None), at(1), None)], [site(name="now")]) == [("now", "current")]
    assert resolved([at(7)], [], [site(name="  ")]) == [("Laboratorio", "current")]


def test_haversine_and_nulls(spark):
    one = spark.range(1).select(s.haversine_m(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)).alias("d"), s.haversine_m(F.lit(None).cast("double"), F.lit(0.0), F.lit(0.0), F.lit(1.0)).alias("n")).first()
    assert abs(one["d"] - 111194.93) < 0.01 and one["n"] is None


RAW = [
    ("75.0", "Uno", "-33,5", "-70.6", "SI", "100"),
    ("75", "Dos", "-33.5", "-70.6", " sí ", "100"),
    ("76", "Tres", "-33.5", "-70.6", "SI", ""),
    ("77", "Cuatro", "", "", "No", ""),
    ("78", "Cinco", "-33.5", "-70.6", "quizás", "100"),
    ("", "Seis", "-33.5", "-70.6", "SI", "100"),
]


def delivered(spark, version="V2"):
    raw = spark.createDataFrame([(i, *r) for i, r in enumerate(RAW)], "orden int, IDDS string, Nombre string, Latitud string, `LONGITUD.` string, OPERATIVA string, radio string")
    return locations.normalize_snapshot(locations.normalize_snapshot_columns(raw), version, "f.csv", moment(), LAB)


def test_snapshot_rows_are_typed_checked_and_the_last_wins(spark):
    got = {r["amid"]: r for r in locations.last_of_each(delivered(spark), "orden").collect()}
    assert set(got) == {"75", "77"}
    assert got["75"]["nombre"] == "Dos" and got["75"]["lat"] == -33.5 and got["75"]["operativa"] == 1
    assert got["77"]["nombre"] == LAB["nombre"] and got["77"]["operativa"] == 0 and got["77"]["origen"] == "laboratorio"


def test_missing_headers_are_an_error(spark):
    with pytest.raises(ValueError, match="operativa"):
        locations.normalize_snapshot_columns(spark.createDataFrame([("1",)], "IDDS string"))


def test_history_opens_closes_and_leaves_alone(spark, at):
    snap = locations.last_of_each(delivered(spark), "orden")
    same = (*("75", "Dos", None, -33.5, -70.6, 100.0, 1, "V2", "excel"), at(1), None)
    unchanged = locations.apply_history(spark.createDataFrame([same], HISTORY), snap, moment()).where("amid = '75'").collect()
    assert len(unchanged) == 1 and unchanged[0]["fin"] is None
    other = (*("75", "Dos", None, -33.5, -70.6, 100.0, 1, "V1", "excel"), at(1), None)
    rows = locations.apply_history(spark.createDataFrame([other], HISTORY), snap, moment()).where("amid = '75'").orderBy("inicio").collect()
    assert [r["fin"] for r in rows] == [at(30, 12), None]


def test_absent_devices_move_once(spark, at):
    snap = locations.last_of_each(delivered(spark), "orden")
    current = spark.createDataFrame([site("1"), site("2")], SITE).withColumns({"archivo": F.lit("f"), "fecha_carga": moment()})
    lab = ("2", LAB["nombre"], "S", LAB["lat"], LAB["lon"], LAB["radio"], 0, "V1", "x", at(1), None)
    history = spark.createDataFrame([(*site("1"), at(1), None), lab], HISTORY)
    now, after = locations.move_absent(current, history, snap, "V2", "f.csv", moment(), LAB)
    moved = {r["amid"]: r for r in now.collect()}
    assert moved["1"]["nombre"] == LAB["nombre"] and moved["1"]["serie"] == "S1" and moved["2"]["nombre"] == "A"
    assert after.where("amid = '1'").count() == 2 and after.where("amid = '2'").count() == 1


def test_retention_keeps_the_boundary_and_open_rows(spark, at):
    history = spark.createDataFrame([(*site("1"), at(1), at(14, 12)), (*site("2"), at(1), at(14, 11)), (*site("3"), at(1), None)], HISTORY)
    assert {r["amid"] for r in locations.purge_history(history, moment()).collect()} == {"1", "3"}
    with pytest.raises(ValueError):
        locations.purge_history(history, moment(), 0)


def test_master_sync_keeps_flags(spark, at):
    master = spark.createDataFrame([(1, 0, at(1)), (2, 1, at(1))], "amid long, active int, last_update timestamp_ntz")
    tel = spark.createDataFrame([(1,), (1,), (3,)], "amid long")
    got = {r["amid"]: (r["active"], r["last_update"]) for r in locations.sync_master(master, tel, moment()).collect()}
    assert got == {1: (0, at(30, 12)), 2: (1, at(1)), 3: (1, at(30, 12))}


def test_fixtures_cover_every_customer(spark, tmp_path):
    spark.range(1490, 3010).select(F.col("id").alias("c_custkey"), (F.col("id") % 2).alias("c_nationkey")).write.parquet(str(tmp_path / "customer.parquet"))
    spark.createDataFrame([(0, "CHILE"), (1, "PERU")], "n_nationkey long, n_name string").write.parquet(str(tmp_path / "nation.parquet"))
    folder, keys = str(tmp_path), range(1490, 3010)
    located = {f"LAB-{k}" if k % 97 == 96 else str(k) for k in keys if k % 7 != 6}  # a few ids are texts
    assert {r["amid"] for r in fixtures.locations(spark, folder).collect()} == located
    assert {r["amid"] for r in fixtures.location_history(spark, folder).collect()} == located
    assert {r["orden"] // 2 for r in fixtures.snapshot(spark, folder).select("orden").collect()} == {k for k in keys if k % 5 != 3}


def test_snapshot_file_is_read_as_text_and_normalised(spark, tmp_path):
    (tmp_path / "zonas V3.csv").write_text("IDDS;Nombre;SERIE VAL.;Latitud;LONGITUD;OPERATIVA;Radio\n75.0;Estación Sur;S1;-33,5;-70.6;Sí;100\nLAB-7;;S2;;;NO;\n;x;S3;1;1;SI;1\n")
    raw = files.read_snapshot_csv(spark, str(tmp_path / "zonas V3.csv"))
    rows = locations.normalize_snapshot(locations.normalize_snapshot_columns(raw), "V3", "zonas V3.csv", s.ntz(fixtures.AS_OF), fixtures.LAB).collect()
    assert {(r["amid"], r["nombre"], r["lat"], r["operativa"]) for r in rows} == {("75", "Estación Sur", -33.5, 1), ("LAB-7", "Laboratorio", fixtures.LAB["lat"], 0)}


def test_text_ids_meet_no_device_and_break_nothing(spark):
    """A location of an id that is no number; of several current rows of a device the last loaded counts."""
    site = "amid string, nombre string, lat double, lon double, radio double, operativa int, fecha_carga string"
    current = spark.createDataFrame([("LAB-7", "Lab", 1.0, 1.0, 9.0, 1, "2024-01-01"), ("5", "old", 1.0, 1.0, 9.0, 1, "2024-01-01"), ("5", "new", 2.0, 2.0, 9.0, 1, "2024-01-02")], site)
    history = current.where("false").drop("fecha_carga").selectExpr("*", "cast(null as timestamp_ntz) inicio", "cast(null as timestamp_ntz) fin")
    fixes = spark.createDataFrame([(1, 5), (2, 7)], "id long, amid long").selectExpr("*", "timestamp_ntz'2024-01-05' fecha_hora")
    found = {r["amid"]: (r["site_nombre"], r["site_source"]) for r in compliance.expected_location_asof(fixes, history, current, fixtures.LAB).collect()}
    assert found == {5: ("new", "current"), 7: ("Laboratorio", "lab")}
    named = alerts.with_location(fixes.select("amid"), current.where("nombre <> 'old'")).collect()
    assert {r["amid"]: r["location"] for r in named} == {5: "new", 7: alerts.UNASSIGNED}
