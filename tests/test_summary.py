import pytest
from pyspark.sql import functions as F

from pulsegrid.functions import scalars as s
from pulsegrid.operators import battery, classify, rules, summary

def moment():
    return s.ntz("2024-01-30 23:59:59")
TEL = "id long, amid long, fecha_hora timestamp_ntz, porcentaje_bateria int, latitud double, longitud double, is_error_obtener_gps boolean"


def fixes(spark, rows, amid=1):
    return spark.createDataFrame([(i, amid, t, None, *p, False) for i, (t, p) in enumerate(rows)], TEL)


ZERO, HERE, NONE = (0.0, 0.0), (-33.4, -70.6), (None, None)


@pytest.mark.parametrize(
    ("kinds", "longest"),
    [([ZERO, ZERO, ZERO], 3), ([HERE, HERE], None), ([ZERO, HERE, ZERO], 1), ([ZERO, NONE, ZERO], 2)],
)
def test_streaks(spark, at, kinds, longest):
    out = summary.gps_max_streak(fixes(spark, [(at(30, h), k) for h, k in enumerate(kinds)]), moment()).collect()
    assert [r["max_zero_streak"] for r in out] == ([longest] if longest else [])


def test_equal_times_are_ordered_by_id(spark, at):
    rows = fixes(spark, [(at(30, 1), ZERO), (at(30, 1), HERE), (at(30, 1), ZERO)])
    assert summary.gps_max_streak(rows, moment()).first()["max_zero_streak"] == 1
    assert summary.gps_summary(rows, moment()).first()["last_fix_is_zero"] == 1


def test_percentages_round_half_up_exactly(spark):
    rows = spark.createDataFrame([(1, 800), (0, 0), (1, 3), (2, 3), (5, 5)], "z long, t long")
    got = [r["p"] for r in rows.select(s.percent_2dp(F.col("z"), F.col("t")).alias("p")).collect()]
    assert got == [0.13, 0.0, 33.33, 66.67, 100.0]


def whole(spark, tel, devices=((1, 1), (2, 1), (3, 0)), values=rules.SPARSE):
    master = spark.createDataFrame(list(devices), "amid long, active int")
    today = s.midnight(moment())
    blocks = battery.build_blocks(tel, master, s.plus(today, days=-13), s.plus(today, hours=23, minutes=30))
    row = rules.rules_row(rules.rules_table(spark, values))
    drops = battery.detect_drops(blocks, row, moment())
    return {r["amid"]: r for r in classify.classify(summary.device_summary(master, tel, blocks, drops, moment()), row).collect()}


def test_devices_without_telemetry_or_positions(spark, at):
    got = whole(spark, fixes(spark, [(at(30, 5), NONE)], amid=2))
    assert set(got) == {1, 2}
    assert got[1]["last_status"] is None and got[1]["gps_total_window"] == 0 and got[1]["level"] == "OK" and got[1]["last_block_is_zero"] == 0
    assert got[2]["last_status"] == at(30, 5) and got[2]["gps_total_window"] == 0


def readings(spark, rows):
    return spark.createDataFrame([(i, 1, t, p, *HERE, False) for i, (t, p) in enumerate(rows)], TEL)


def test_recurrent_drops_today(spark, at):
    rows = readings(spark, [(at(30, 8), 80), (at(30, 9), 60), (at(30, 10), 40)])
    assert whole(spark, rows, values=rules.SPARSE | {"BAT_CAIDAS_HOY_CRITICA": 1})[1]["battery_code"] == "B3"


def test_small_drop_today_with_history(spark, at):
    rows = readings(spark, [(at(30, 8), 80), (at(30, 9), 65)])
    assert whole(spark, rows, values=rules.SPARSE | {"BAT_CAIDA_MIN_DETECTAR": 10})[1]["battery_code"] == "B7"


SUMMARY_DEFAULTS = {
    "gps_zero_today": 0, "gps_total_today": 0, "gps_zero_pct_today": 0.0, "gps_zero_window": 0, "gps_zero_pct_window": 0.0, "max_zero_streak": 0, "last_fix_is_zero": 0,
    "drops_today": 0, "drops_window": 0, "max_drop_today": 0.0, "max_drop_window": 0.0, "battery_zero_today": 0, "battery_zero_window": 0, "battery_now": 50,
}


def code(spark, at, which, **values):
    row = SUMMARY_DEFAULTS | values
    frame = spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} {'double' if isinstance(v, float) else 'long'}" for k, v in row.items()))
    frame = frame.withColumns({"day_start": F.lit(at(30)), "last_zero_fix_ts": F.lit(at(30, 3)), "last_drop_to": F.lit(5.0), "last_drop_ts": F.lit(at(30, 4))})
    return classify.classify(frame, rules.rules_row(rules.rules_table(spark, rules.DEFAULTS))).first()[which]


@pytest.mark.parametrize(
    ("values", "expected"),
    [
        ({"gps_zero_today": 22}, "G1"),
        ({"gps_zero_pct_today": 90.0, "gps_total_today": 10}, "G2"),
        ({"max_zero_streak": 784}, "G3"),
        ({"gps_zero_today": 21}, "G4"),
        ({"gps_zero_pct_today": 66.67, "gps_total_today": 5}, "G5"),
        ({"max_zero_streak": 306}, "G6"),
        ({"last_fix_is_zero": 1}, "G7"),
        ({"gps_zero_today": 5}, "G8"),
        ({"gps_zero_window": 113}, "G9"),
        ({"gps_zero_pct_window": 16.43}, "G10"),
        ({}, "G0"),
    ],
)
def test_gps_branches_at_their_bounds(spark, at, values, expected):
    assert code(spark, at, "gps_code", **values) == expected


@pytest.mark.parametrize(
    ("values", "expected"),
    [
        ({"max_drop_today": 50.0}, "B1"),
        ({"drops_today": 3, "drops_window": 3}, "B3"),
        ({"max_drop_today": 30.0, "drops_window": 1}, "B4"),
        ({"battery_now": 0, "battery_zero_today": 10}, "B5"),
        ({"max_drop_today": 20.0}, "B6"),
        ({"drops_today": 1, "drops_window": 1}, "B7"),
        ({"drops_window": 3}, "B8"),
        ({"max_drop_window": 50.0}, "B9"),
        ({"battery_now": 0, "battery_zero_today": 3}, "B10"),
        ({"battery_zero_today": 2}, "B11"),
        ({"battery_zero_today": 3}, "B12"),
        ({"battery_zero_window": 12}, "B13"),
        ({"drops_window": 2}, "B14"),
        ({}, "B0"),
    ],
)
def test_battery_branches_at_their_bounds(spark, at, values, expected):
    assert code(spark, at, "battery_code", **values) == expected


def test_two_warnings_make_a_high_alert(spark, at):
    assert code(spark, at, "level", gps_zero_today=1, battery_zero_today=1) == "ALTA"
    assert code(spark, at, "main_reason", gps_zero_today=1, battery_zero_today=1) == classify.BOTH_WARN
    assert code(spark, at, "action", gps_zero_today=1) == "Revisar GPS"
