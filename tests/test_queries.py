"""Every registered query of the fleet operators against its SQL, and properties that hold between them."""

import os

import duckdb
import pytest

from pulsegrid.plans import catalog, jobs
from pulsegrid.functions import scalars as s
from pulsegrid.operators import rules, telemetry
from pulsegrid.sources import files, fixtures
from pulsegrid.streaming import ingest

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (int, float)) or hasattr(v, "as_tuple"):
        return round(float(v), 6) + 0.0
    return v.replace(tzinfo=None) if hasattr(v, "tzinfo") else v


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_matches_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(v) for v in r) for r in df.select(*columns).collect()), key=repr)
    rel = duck.sql(catalog.ORACLE_SQL[name])
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(c) for c in columns]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=repr)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_full_and_fast_jobs(spark, tmp_path):
    as_of = s.ntz(fixtures.AS_OF)
    tel, master = fixtures.telemetry(spark, FOLDER), fixtures.master(spark, FOLDER)
    old = jobs.run_full(tel, master, rules.rules_table(spark, rules.DEFAULTS), None, as_of).summary
    files.replace_table(old, str(tmp_path / "summary"))
    stored = spark.read.parquet(str(tmp_path / "summary"))
    changed = rules.rules_table(spark, rules.SPARSE | {k: rules.DEFAULTS[k] for k in rules.DETECTION})  # classification rules alone
    fast = jobs.run_fast(stored, master, changed, as_of)
    full = jobs.run_full(tel, master, changed, stored, as_of).summary
    columns = ["amid", "gps_code", "battery_code", "level", "main_reason", "has_alert"]
    assert sorted(map(tuple, fast.select(*columns).collect())) == sorted(map(tuple, full.select(*columns).collect()))


def test_files_round_trip(spark, tmp_path):
    (tmp_path / "t.csv").write_text("AMID;FECHA_HORA;LATITUD;PORCENTAJE_BATERIA;IS_CONTIENE_GPS\n7.0;05/01/2024 10:00:00;-33.5;80.9;sí\n;05/01/2024 10:00:00;1;1;no\n8;mal;1;1;no\n")
    rows = files.read_telemetry_csv(spark, str(tmp_path / "t.csv"))
    only = rows.first()
    assert rows.count() == 1 and (only["amid"], float(only["latitud"]), only["porcentaje_bateria"], only["is_contiene_gps"]) == (7, -33.5, 80, True)
    tel = fixtures.telemetry(spark, FOLDER).withColumn("day", s.F.to_date("fecha_hora"))
    tel.where("id % 2 = 0").write.partitionBy("day").parquet(str(tmp_path / "tel"))
    files.append_telemetry(spark, tel.drop("day"), str(tmp_path / "tel"))
    assert spark.read.parquet(str(tmp_path / "tel")).count() == tel.count()


def test_a_failed_replacement_leaves_the_old_version(spark, tmp_path):
    path, rows = str(tmp_path / "t"), spark.range(100, numPartitions=4)
    files.replace_table(rows, path)
    with pytest.raises(Exception, match="broken"):
        files.replace_table(rows.select(s.F.when(s.F.col("id") == 99, s.F.raise_error(s.F.lit("broken")).cast("long")).otherwise(-s.F.col("id")).alias("id")), path)
    assert sorted(r["id"] for r in spark.read.parquet(path).collect()) == list(range(100))
    files.replace_table(spark.read.parquet(path).where("id < 5"), path)  # also from itself
    assert spark.read.parquet(path).count() == 5


def test_an_append_reads_the_days_of_the_delivery_alone(spark, tmp_path):
    tel = fixtures.telemetry(spark, FOLDER)
    tel.withColumn("day", s.F.to_date("fecha_hora")).write.partitionBy("day").parquet(str(tmp_path / "tel"))
    some = tel.where("fecha_hora >= '2024-01-10' and fecha_hora < '2024-01-12'")
    rows = files.stored_days(spark, some, str(tmp_path / "tel"))
    assert rows.count() == some.count()
    assert len(rows.inputFiles()) > 2 and "PartitionFilters: [isnotnull(day" in rows._jdf.queryExecution().executedPlan().toString()


def test_an_append_keeps_the_least_of_equal_keys(spark):
    tel = fixtures.telemetry(spark, FOLDER).where("id < 50")
    twice = tel.withColumn("id", s.F.col("id") + 1000).unionByName(tel).repartition(7)
    assert {r["id"] for r in telemetry.append_new(tel.where("false"), twice).collect()} == {r["id"] for r in tel.collect()}


def test_the_fast_path_reads_no_telemetry(spark):
    read = catalog.QUERIES["reclassify"](spark, FOLDER).inputFiles()
    assert read and all("/summary/" in f or "/master/" in f for f in read)


def test_a_summary_scans_events_few_times(spark):
    fleet = catalog.Fleet(spark, FOLDER)
    assert fleet.summary._jdf.queryExecution().optimizedPlan().toString().count("event_type") > 0
    assert fleet.summary._jdf.queryExecution().executedPlan().toString().count("FileScan parquet") <= 5


def test_rule_changes_choose_the_mode_or_are_refused(spark):
    as_of, fleet = s.ntz(fixtures.AS_OF), catalog.Fleet(spark, FOLDER)
    current = rules.rules_table(spark, rules.SPARSE)
    args = (fleet.tel, fleet.master, fleet.classified, as_of)
    ask = lambda **values: spark.createDataFrame(list(values.items()), "key string, value string")
    assert jobs.change_rules(current, ask(GPS_CERO_HOY_CRITICA=str(rules.SPARSE["GPS_CERO_HOY_CRITICA"])), *args)[0] == "none"
    mode, after, out = jobs.change_rules(current, ask(GPS_CERO_HIST_ADV="11"), *args)
    assert mode == "fast" and after.where("key = 'GPS_CERO_HIST_ADV'").first()["value"] == 11 and out.count() == fleet.classified.count()
    assert jobs.change_rules(current, ask(BAT_CAIDA_MIN_DETECTAR="19"), *args)[0] == "full"
    for bad, why in ((ask(OTRA="1"), "KEY OTRA"), (ask(GPS_RACHA_ALTA="mucho"), "KEY GPS_RACHA_ALTA"), (ask(BAT_CAIDA_MAX_HORAS="0"), "DETECTION")):
        with pytest.raises(ValueError, match=why):
            jobs.change_rules(current, bad, *args)
    with pytest.raises(ValueError, match="unknown mode"):
        jobs.run_mode("rapido", *args[:2], current, *args[2:])


def test_retention_counts_what_it_deletes(spark, tmp_path):
    fleet, path = catalog.Fleet(spark, FOLDER), str(tmp_path / "history")
    files.replace_table(fleet.history, path)
    counts = jobs.purge_history(spark.read.parquet(path), path, fleet.as_of).first()
    assert counts["deleted"] > 0 and counts["kept"] == spark.read.parquet(path).count()


def test_streams_restart_and_leave_out_what_is_late(spark, tmp_path):
    """Two deliveries: the second repeats rows of the first, brings new ones and one that is older than the lateness."""
    F, T = s.F, fixtures.telemetry(spark, FOLDER)
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    tel = T.select("id", "amid", "fecha_hora", "porcentaje_bateria").where("porcentaje_bateria is not null")
    first, rest = tel.where("fecha_hora < '2024-01-20'"), tel.where("fecha_hora >= '2024-01-19'")
    first.where("amid <> 1 or fecha_hora >= '2024-01-05'").coalesce(1).write.parquet(source)
    stream = lambda: ingest.telemetry_stream(spark, source, tel.schema, "*.parquet")
    ingest.append_available(ingest.deduplicated(stream()), f"{out}/rows", f"{state}/rows")
    ingest.update_available(ingest.blocks(stream()), f"{out}/blocks", f"{state}/blocks")
    late = tel.where("amid = 1 and fecha_hora < '2024-01-05'")
    assert late.count() > 0
    rest.unionByName(late).coalesce(1).write.mode("append").parquet(source)
    ingest.append_available(ingest.deduplicated(stream()), f"{out}/rows", f"{state}/rows")  # goes on from the checkpoint
    ingest.update_available(ingest.blocks(stream()), f"{out}/blocks", f"{state}/blocks")
    want = tel.join(late.select("id"), "id", "left_anti")
    assert sorted(r["id"] for r in spark.read.parquet(f"{out}/rows").collect()) == sorted(r["id"] for r in want.collect())
    rows = lambda: sorted(map(tuple, ingest.latest_version(spark, f"{out}/blocks", ["amid", "slot"]).select("amid", "slot", "source_id").collect()))
    before = rows()
    from pulsegrid.operators import battery

    assert before == sorted(map(tuple, battery.nearest_readings(battery.slot_candidates(want)).select("amid", "slot", "source_id").collect()))
    ingest.compact(spark, f"{out}/blocks", f"{state}/blocks", ["amid", "slot"])
    assert rows() == before and len(list((tmp_path / "out" / "blocks").glob("batch=*"))) == 1


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("2024-01-05T10:00:00", "2024-01-05 10:00:00"),
        ("2024-01-05 10:00", "2024-01-05 10:00:00"),
        ("05/01/2024 10:00", "2024-01-05 10:00:00"),
        ("2024-01-05 10:00:00.123", "2024-01-05 10:00:00.123"),
        ("5/1/2024", "2024-01-05 00:00:00"),
        ("05/25/2024", "2024-05-25 00:00:00"),
        ("2024-01-05T10:00:00Z", "2024-01-05 10:00:00"),
        ("31/02/2024", None),
        ("10:00", None),
        ("2024", None),
        ("", None),
        (None, None),
    ],
)
def test_dates_of_any_spelling(spark, text, want):
    assert spark.range(1).select(s.timestamp_or_null(s.F.lit(text).cast("string")).cast("string")).first()[0] == want


def test_export_writes_three_sets(spark, tmp_path):
    as_of = s.ntz(fixtures.AS_OF)
    fleet = catalog.Fleet(spark, FOLDER)
    files.export_device(fleet.tel, fleet.blocks, as_of, str(tmp_path), [1, 2])
    assert spark.read.parquet(str(tmp_path / "summary")).count() == 2
    assert spark.read.parquet(str(tmp_path / "battery")).count() == 28
    assert spark.read.parquet(str(tmp_path / "records")).where("amid not in (1, 2)").count() == 0


def test_pushdown_reaches_the_scan(spark):
    plan = catalog.QUERIES["telemetry_range"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts" in plan
