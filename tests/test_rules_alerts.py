import datetime as dt

import pytest
from pyspark.sql import functions as F

from pulsegrid.functions import scalars as s
from pulsegrid.operators import alerts, audit, merge, rules, telemetry

def moment():
    return s.ntz("2024-01-30 12:00:00")


@pytest.mark.parametrize(
    ("change", "code"),
    [
        ({"GPS_CERO_HIST_ADV": -1}, "NEGATIVE"),
        ({"GPS_PORC_HOY_CRITICA": 101}, "PERCENT"),
        ({"GPS_CERO_HOY_ALTA_MAX": 22}, "GPS_RANGES"),
        ({"GPS_RACHA_ALTA": 785}, "GPS_LEVELS"),
        ({"BAT_CERO_HOY_ADV_MAX": 3}, "BATTERY_RANGES"),
        ({"BAT_CAIDA_MAX_HORAS": 0}, "DETECTION"),
        ({"BAT_CAIDA_HOY_ALTA": 31}, "DROP_LEVELS"),
    ],
)
def test_each_check_fails_alone(spark, change, code):
    table = rules.rules_table(spark, rules.DEFAULTS | change)
    assert [r["code"] for r in rules.violations(table).collect()] == [code]
    with pytest.raises(ValueError, match=code):
        rules.require_valid(table)


def test_missing_and_inactive_rules(spark):
    table = rules.rules_table(spark, rules.DEFAULTS)
    assert rules.violations(table).count() == 0
    assert [r["code"] for r in rules.violations(table.withColumn("active", F.when(F.col("key") == "GPS_CERO_HIST_ADV", 0).otherwise(1))).collect()] == ["COUNT"]
    with pytest.raises(ValueError, match="GPS_CERO_HIST_ADV"):
        rules.load_rules(table.where("key <> 'GPS_CERO_HIST_ADV'"))


def test_changes_compare_as_decimals(spark):
    table = rules.rules_table(spark, rules.DEFAULTS)
    wanted = spark.createDataFrame([("BAT_CAIDA_MAX_HORAS", "2.00"), ("GPS_RACHA_ALTA", "300"), ("OTHER", "1"), ("GPS_RACHA_CRITICA", "inf")], "key string, value string")
    got = {r["key"]: r["rejected"] for r in rules.rule_changes(table, wanted).collect()}
    assert got == {"GPS_RACHA_ALTA": False, "OTHER": True, "GPS_RACHA_CRITICA": True}
    assert rules.recompute_mode(rules.rule_changes(table, wanted)).first()["mode"] == "fast"


ALERTS = "amid long, level string, gps_level string, battery_level string, last_status timestamp_ntz, has_alert int, drops_window long, drops_today long"


def test_priority_order(spark, at):
    rows = [
        (1, "OK", "OK", "OK", None, 0, 0, 0),
        (2, "ALTA", "ADVERTENCIA", "ADVERTENCIA", at(30, 11), 1, 3, 1),
        (3, "CRITICA", "OK", "CRITICA", at(30, 10), 1, 0, 0),
        (4, "CRITICA", "CRITICA", "OK", at(30, 11), 1, 0, 0),
        (5, "CRITICA", "CRITICA", "OK", None, 1, 0, 0),
        (6, "CRITICA", "CRITICA", "OK", at(29), 1, 0, 0),
        (7, "CRITICA", "CRITICA", "OK", None, 1, 0, 0),
        (8, "ADVERTENCIA", "ADVERTENCIA", "OK", at(30, 11), 1, 0, 0),
    ]
    got = alerts.rank_alerts(spark.createDataFrame(rows, ALERTS), moment()).collect()
    assert [r["amid"] for r in got] == [5, 7, 6, 4, 3, 2, 8, 1]
    assert {r["amid"]: r["tier"] for r in got}[2] == 8 and {r["amid"]: r["drops_before"] for r in got}[2] == 2


def test_pages_are_clamped():
    assert alerts.page_of(25, 9) == (3, 3)
    assert alerts.page_of(0, 0) == (1, 1)


def test_filters(spark, at):
    rows = spark.createDataFrame([(1, "OK", "OK", "OK", at(30, 11), 0, 0, 0), (2, "ALTA", "OK", "ALTA", at(30, 10, 59), 1, 2, 0)], ALERTS)
    ids = lambda df: [r["amid"] for r in df.collect()]
    assert ids(alerts.filter_alerts(rows, moment())) == [2]
    assert ids(alerts.filter_alerts(rows, moment(), level="ok")) == [1]
    assert ids(alerts.filter_alerts(rows, moment(), status="recent", only_alerts=False)) == [1]
    assert ids(alerts.filter_alerts(rows, moment(), status="old")) == [2]
    assert ids(alerts.filter_alerts(rows, moment(), problem="nonsense")) == [2]
    assert ids(alerts.filter_alerts(rows, moment(), kind="GPS")) == []


def test_device_lists():
    assert alerts.parse_devices("3, 1;2\n3") == [1, 2, 3]
    for bad in ("1,x", "0", " ".join(str(i) for i in range(1, 502))):
        with pytest.raises(ValueError):
            alerts.parse_devices(bad)


def test_searches(spark):
    rows = spark.createDataFrame([(12, "Estación Ñuñoa"), (123, "Otra"), (21, "Otra")], "amid long, location string")
    assert [r["amid"] for r in alerts.search_devices(rows, "12").collect()] == [12, 123]
    assert alerts.search_devices(rows, "1").count() == 0 and alerts.search_devices(rows, "1x").count() == 0
    assert [r["amid"] for r in alerts.search_devices(rows, "12", limit=0).collect()] == [12]
    assert [r["location"] for r in alerts.search_locations(rows, "NUNOA").collect()] == ["Estación Ñuñoa"]


def test_merges(spark):
    target = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k long, x string, y long")
    source = spark.createDataFrame([(2, "c", 9), (3, "d", 3)], "k long, x string, y long")
    assert sorted(map(tuple, merge.merge_by_key(target, source, ["k"]).collect())) == [(1, "a", 1), (2, "c", 9), (3, "d", 3)]
    assert sorted(map(tuple, merge.merge_columns(target, source, ["k"], ["x"]).collect())) == [(1, "a", 1), (2, "c", 2)]


def test_append_counts_and_duplicates(spark, at):
    schema = "amid long, fecha_hora timestamp_ntz"
    have, new = spark.createDataFrame([(1, at(1))], schema), spark.createDataFrame([(1, at(1)), (1, at(2)), (1, at(2))], schema)
    assert tuple(telemetry.append_counts(have, new).first()) == (3, 1, 2)
    assert audit.duplicates(new, ["amid", "fecha_hora"]).count() == 1


def test_ranges():
    now = dt.datetime(2024, 1, 30, 12)
    assert telemetry.resolve_range("2024-01-02", "2024-01-03", "10:30", "11:00", now) == (dt.datetime(2024, 1, 2, 10, 30), dt.datetime(2024, 1, 3, 11, 30))
    assert telemetry.resolve_range("x", None, "10:31", "", now) == (dt.datetime(2024, 1, 30), dt.datetime(2024, 1, 31))
    assert telemetry.resolve_range("2024-02-02", "2024-01-03", None, None, now) == (dt.datetime(2024, 1, 30), dt.datetime(2024, 1, 31))
    assert telemetry.last_days(14, now) == (dt.datetime(2024, 1, 17), dt.datetime(2024, 1, 31))


def one(spark, text, f):
    return spark.createDataFrame([(text,)], "x string").select(f(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    ("f", "text", "expected"),
    [
        (s.integer_or_null, "12.9", 12),
        (s.integer_or_null, "-12.9", -12),
        (s.integer_or_null, "1,5", None),
        (s.integer_or_null, "", None),
        (s.number_or_null, "1,5", 1.5),
        (s.number_or_null, "nan", None),
        (s.number_or_null, None, None),
        (s.device_text, "75.0", "75"),
        (s.device_text, " AB ", "AB"),
        (s.gps_boolean, None, False),
        (s.gps_boolean, "sí", True),
        (s.battery_boolean, None, None),
        (s.battery_boolean, "S", True),
        (s.battery_boolean, "junk", None),
        (s.import_boolean, "yes", True),
        (s.import_boolean, "y", None),
        (s.import_boolean, "0", False),
        (s.text_or_null, " NaN ", None),
        (s.timestamp_or_null, "05/01/2024 10:00:00", dt.datetime(2024, 1, 5, 10)),
        (s.timestamp_or_null, "31/02/2024", None),
        (s.version_of_file, "zonas v 12.csv", "V12"),
        (s.version_of_file, "zonas.csv", None),
    ],
)
def test_coercion(spark, f, text, expected):
    assert one(spark, text, f) == expected


def test_component_values_lose_every_t_and_z(spark):
    key, value = telemetry.split_component(F.col("x"))
    row = spark.createDataFrame([('{"tiempoVida":"2024-01-01T10:00:00Z"}',)], "x string").select(key.alias("k"), value.alias("v")).first()
    assert tuple(row) == ("tiempoVida", "2024-01-01 10:00:00")
