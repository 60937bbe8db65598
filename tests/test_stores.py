"""Stored tables: commits of several tables, days that are replaced or dropped, appends and streams that stop in between, numbers over a whole order."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from pulsegrid.functions import scalars as s
from pulsegrid.operators import alerts, battery, daily, rules, summary, telemetry
from pulsegrid.plans import catalog, incremental, jobs
from pulsegrid.sources import files, fixtures, store
from pulsegrid.streaming import ingest

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
NARROW = ("id", "amid", "fecha_hora", "porcentaje_bateria")


def rows_of(df):
    return sorted(map(repr, map(tuple, df.collect())))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def files_in(path):
    return {str(f): f.stat().st_mtime_ns for f in path.rglob("*.parquet")}


def fails(column="id"):
    return F.when(F.col(column) >= 0, F.raise_error(F.lit("broken")).cast("long")).otherwise(F.col(column))


# Several tables behind one pointer


def test_a_commit_replaces_all_its_tables_or_none(spark, tmp_path):
    stored = store.Snapshots(spark, str(tmp_path / "s"))
    assert stored.version() == 0
    assert stored.commit({"a": spark.range(3), "b": spark.range(5), "c": spark.range(7)}) == 1
    old_a, old_b = stored.read("a", "b")
    for order in (("a", "b"), ("b", "a")):
        with pytest.raises(Exception, match="broken"):
            stored.commit({order[0]: spark.range(100), order[1]: spark.range(9).select(fails().alias("id"))})
        assert [df.count() for df in stored.read("a", "b", "c")] == [3, 5, 7] and stored.version() == 1
    assert len([n for n in os.listdir(tmp_path / "s") if n.startswith("data-")]) == 1  # what failed left nothing
    stored.commit({"a": stored.read("a")[0].select((F.col("id") + 10).alias("id")), "b": spark.range(2)})
    assert [df.count() for df in stored.read("a", "b", "c")] == [3, 2, 7]
    assert (old_a.agg(F.max("id")).first()[0], old_b.count()) == (2, 5)  # who began with a version goes on with it


def test_a_commit_on_an_older_version_is_refused(spark, tmp_path):
    stored, other = store.Snapshots(spark, str(tmp_path / "s")), store.Snapshots(spark, str(tmp_path / "s"))
    stored.commit({"a": spark.range(1)})
    seen = other.version()
    stored.commit({"a": spark.range(2)})
    with pytest.raises(store.Conflict):
        other.commit({"a": spark.range(3)}, based_on=seen)
    assert stored.read("a")[0].count() == 2
    with pytest.raises(Exception, match="(?i)exist"):
        store._write_new(spark, f"{tmp_path}/s/_versions/2.json", "{}")  # two writers of one version: the second fails
    assert stored.version() == 2 and stored.read("a")[0].count() == 2


def test_vacuum_removes_what_no_kept_version_names(spark, tmp_path):
    stored = store.Snapshots(spark, str(tmp_path / "s"))
    for n in (1, 2, 3, 4):
        stored.commit({"a": spark.range(n)} | ({"b": spark.range(9)} if n == 1 else {}))
    stored.vacuum(keep=2)
    assert [stored.read("a", version=v)[0].count() for v in (3, 4)] == [3, 4] and stored.read("b")[0].count() == 9
    assert len([n for n in os.listdir(tmp_path / "s") if n.startswith("data-")]) == 3  # of b, and both of a


def test_drops_and_summaries_are_replaced_together(spark, tmp_path):
    fleet, path = catalog.Fleet(spark, FOLDER), str(tmp_path / "run")
    rule_rows = rules.rules_table(spark, rules.SPARSE)
    jobs.commit_full(spark, path, fleet.tel, fleet.master, rule_rows, fleet.as_of)
    before = [rows_of(df) for df in store.Snapshots(spark, path).read("drops", "summary")]
    broken = fleet.tel.withColumn("latitud", F.when(F.col("id") % 5 == 0, F.raise_error(F.lit("broken")).cast("double")).otherwise(0.0))  # positions are read for summaries alone
    with pytest.raises(Exception, match="broken"):
        jobs.commit_full(spark, path, broken, fleet.master, rule_rows, fleet.as_of)
    assert [rows_of(df) for df in store.Snapshots(spark, path).read("drops", "summary")] == before
    assert jobs.commit_full(spark, path, fleet.tel, fleet.master.where("amid % 2 = 0"), rule_rows, fleet.as_of) == 2
    assert rows_of(store.Snapshots(spark, path).read("summary")[0]) == before[1]  # devices that are not active any more keep theirs


def test_a_replacement_that_stopped_between_its_renames_is_undone(spark, tmp_path):
    path = str(tmp_path / "t")
    files.replace_table(spark.range(3), path)
    os.rename(path, f"{path}__old")  # as a run leaves it that stops there
    with pytest.raises(Exception, match="broken"):
        files.replace_table(spark.range(2).select(fails().alias("id")), path)
    assert spark.read.parquet(path).count() == 3
    os.rename(path, f"{path}__old")
    files.restore(spark, path)
    files.replace_table(spark.read.parquet(path).where("id < 2"), path)
    assert spark.read.parquet(path).count() == 2


# States of days


def test_states_of_days_merge_into_the_summary(spark):
    """Also with another cut of the window, days without a fix, and devices without any reading."""
    fleet = catalog.Fleet(spark, FOLDER)
    tel = fleet.tel.where("NOT (amid % 5 = 2 AND CAST(fecha_hora AS DATE) = DATE '2024-01-25')")
    for day in ("2024-01-30", "2024-01-22"):
        as_of = s.ntz(f"{day} 23:59:59")
        seen = tel.where(F.col("fecha_hora") <= as_of)
        filled = battery.filled_blocks(seen, s.ntz("2024-01-01 00:00:00"), s.plus(s.midnight(as_of), hours=23, minutes=30))
        window = filled.where(F.col("slot") >= s.plus(s.midnight(as_of), days=-summary.WINDOW_DAYS))
        master = fleet.master.unionByName(spark.createDataFrame([(-1, 1)], "amid long, active int").withColumn("last_update", as_of))
        want = summary.device_summary(master, seen, window, battery.detect_drops(window, fleet.rule_row, as_of), as_of)
        states = daily.battery_days(filled, daily.drops_of_days(filled, fleet.rule_row))
        got = daily.device_summary(master, daily.gps_days(seen), states, as_of)
        assert got.columns == want.columns and rows_of(got) == rows_of(want)


def test_streaks_over_days(spark, at):
    """Runs that end a day go on in the next, also over days of zero fixes alone and days without a fix."""
    marks = {1: "vzz", 2: "zzz", 3: "nn", 4: "z", 5: "zvzzzzvz", 6: "n", 8: "zz"}  # v valid, z zero, n no fix
    rows = [(100 * d + k, 1, at(d, k), None if m == "n" else 0.0 if m == "z" else 1.0) for d, day in marks.items() for k, m in enumerate(day)]
    tel = spark.createDataFrame(rows, "id long, amid long, fecha_hora timestamp_ntz, latitud double").withColumn("longitud", F.col("latitud"))
    states = daily.gps_days(tel)
    as_of = s.ntz("2024-01-09 23:59:59")
    assert daily.gps_merged(states, as_of).first()["max_zero_streak"] == 7  # 2 + 3 + 1 + 1
    got = {r["day"].day: (r["leading"], r["trailing"], r["longest"], r["n_fixes"]) for r in states.collect()}
    assert got == {1: (0, 2, 2, 3), 2: (3, 3, 3, 3), 3: (0, 0, 0, 0), 4: (1, 1, 1, 1), 5: (1, 1, 4, 8), 6: (0, 0, 0, 0), 8: (2, 2, 2, 2)}
    assert rows_of(daily.gps_merged(states, as_of).select("max_zero_streak", "gps_zero_window")) == rows_of(summary.gps_measures(tel, as_of).select("max_zero_streak", "gps_zero_window"))


def test_a_delivery_touches_its_days_and_those_around_them_alone(spark, tmp_path):
    fleet, days = catalog.Fleet(spark, FOLDER), incremental.Days(spark, str(tmp_path / "d"))
    late = "CAST(fecha_hora AS DATE) = DATE '2024-01-21' AND id % 2 = 0"
    days.deliver(fleet.tel.where(f"NOT ({late})"), fleet.master, fleet.rule_row, fixtures.AS_OF_TIME)
    before = files_in(tmp_path / "d")
    counts = days.deliver(fleet.tel.where(late), fleet.master, fleet.rule_row, fixtures.AS_OF_TIME)
    after = files_in(tmp_path / "d")
    day = lambda f: f.split("day=")[1][:10] if "day=" in f else None
    kept = {f for f in before if after.get(f) == before[f]}
    gone = {t: {day(f) for f in before if f not in kept and f"/{t}/" in f} for t in ("telemetry", "gps_days", "blocks", "battery_days")}
    assert counts["created"] == fleet.tel.where(late).count() and gone["telemetry"] == set()
    assert gone["gps_days"] == {"2024-01-21"} and gone["blocks"] == {"2024-01-21", "2024-01-22"} and gone["battery_days"] == {f"2024-01-{d}" for d in (20, 21, 22, 23)}
    assert rows_of(days.summary(fleet.master, fleet.as_of)) == rows_of(fleet.summary)
    read = days.summary(fleet.master, fleet.as_of).inputFiles()
    assert any("/gps_days/" in f for f in read) and not any("/telemetry/" in f or "/blocks/" in f for f in read)
    assert plan(days.summary(fleet.master, fleet.as_of)).count("PartitionFilters: [isnotnull(day") == 2  # only days of the window
    again = days.deliver(fleet.tel.where(late), fleet.master, fleet.rule_row, fixtures.AS_OF_TIME)
    assert again["created"] == 0 and rows_of(days.summary(fleet.master, fleet.as_of)) == rows_of(fleet.summary)


def test_a_late_reading_can_undo_a_drop_of_the_day_before_or_after(spark, tmp_path, at):
    """A fall to 0 counts once the next block is 0 too, which can be next day; a reading in between can take it back."""
    master = spark.createDataFrame([(1, 1, at(1))], "amid long, active int, last_update timestamp_ntz")
    row = spark.createDataFrame([(20.0, 2.0)], "BAT_CAIDA_MIN_DETECTAR double, BAT_CAIDA_MAX_HORAS double")
    tel = lambda *r: spark.createDataFrame([(i, 1, t, p, None, None) for i, t, p in r], "id long, amid long, fecha_hora timestamp_ntz, porcentaje_bateria int, latitud double, longitud double")
    days, as_of = incremental.Days(spark, str(tmp_path / "d")), dt.datetime(2024, 1, 4, 23, 59, 59)
    deliver = lambda *r: days.deliver(tel(*r), master, row, as_of)
    found = lambda: days.summary(master, F.lit(as_of).cast("timestamp_ntz")).first()["drops_window"]
    deliver((1, at(2, 23, 0), 80), (2, at(2, 23, 30), 0))
    assert found() == 0
    deliver((3, at(3, 0, 30), 0))
    assert found() == 1  # confirmed by the next day
    deliver((4, at(2, 23, 50), 70))  # fills the first slot of the next day, so 80 to 0 is taken back, and 70 to 0 is the last block
    assert found() == 0
    deliver((5, at(3, 1, 0), 0))
    assert found() == 1


def test_retention_drops_days_and_rewrites_none(spark, tmp_path):
    fleet, days = catalog.Fleet(spark, FOLDER), incremental.Days(spark, str(tmp_path / "d"))
    days.deliver(fleet.tel, fleet.master, fleet.rule_row, fixtures.AS_OF_TIME)
    blocks = spark.read.parquet(days.at("blocks"))
    old, before = blocks.where("day < '2024-01-20'").count(), files_in(tmp_path / "d" / "blocks")
    assert days.retain(fleet.as_of, 10) == old > 0
    after = files_in(tmp_path / "d" / "blocks")
    assert after == {f: t for f, t in before.items() if f.split("day=")[1][:10] >= "2024-01-20"}
    assert days.retain(fleet.as_of, 10) == 0
    with pytest.raises(ValueError, match="one day"):
        days.retain(fleet.as_of, 0)


def test_the_block_job_leaves_older_days(spark, tmp_path):
    fleet, tel, blocks = catalog.Fleet(spark, FOLDER), str(tmp_path / "tel"), str(tmp_path / "blocks")
    files.append_telemetry(spark, fleet.tel.where("id % 3 <> 0"), tel)
    incremental.rebuild_blocks(spark, tel, blocks, fleet.master, incremental.last_days(fixtures.AS_OF_TIME, 5))
    before = files_in(tmp_path / "blocks")
    files.append_telemetry(spark, fleet.tel, tel)
    incremental.rebuild_blocks(spark, tel, blocks, fleet.master, incremental.last_days(fixtures.AS_OF_TIME))
    after = files_in(tmp_path / "blocks")
    assert {f.split("day=")[1][:10] for f in before if after.get(f) != before[f]} == {"2024-01-29", "2024-01-30"}
    new = spark.read.parquet(blocks).where("day >= '2024-01-29'").select("amid", "slot", "source_id")
    assert rows_of(new) == rows_of(fleet.blocks.where("day >= '2024-01-29'").select("amid", "slot", "source_id"))


# Appends and their log


def test_the_first_delivery_makes_the_store(spark, tmp_path):
    tel, path, log = fixtures.telemetry(spark, FOLDER), str(tmp_path / "tel"), str(tmp_path / "log")
    now = s.ntz(fixtures.AS_OF)
    assert jobs.ingest(spark, tel, path, log, now, now) == {"obtained": tel.count(), "created": tel.count(), "duplicates": 0}
    twice = tel.where("id < 10").unionByName(tel.where("id < 10"))
    assert jobs.ingest(spark, twice, path, log, now, now) == {"obtained": 20, "created": 0, "duplicates": 20}
    assert spark.read.parquet(path).count() == tel.count()


def test_deliveries_without_rows(spark, tmp_path):
    tel, path, days = fixtures.telemetry(spark, FOLDER), str(tmp_path / "tel"), incremental.Days(spark, str(tmp_path / "d"))
    none = {"obtained": 0, "created": 0, "duplicates": 0}
    for empty in (tel.where("false"), tel.where("id < -5"), spark.createDataFrame([], tel.schema)):
        assert files.append_telemetry(spark, empty, path) == none
    assert files.append_telemetry(spark, tel, path)["created"] == tel.count()
    for empty in (tel.where("false"), tel.where("id < -5"), spark.createDataFrame([], tel.schema)):
        assert files.append_telemetry(spark, empty, path) == none
    fleet = catalog.Fleet(spark, FOLDER)
    for delivery in (tel.where("false"), tel, tel.where("id < -5")):
        days.deliver(delivery, fleet.master, fleet.rule_row, fixtures.AS_OF_TIME)
    assert rows_of(days.summary(fleet.master, fleet.as_of)) == rows_of(fleet.summary)


def test_a_failed_append_is_logged_as_failed_and_can_be_repeated(spark, tmp_path):
    tel, path, log = fixtures.telemetry(spark, FOLDER), str(tmp_path / "tel"), str(tmp_path / "log")
    now = s.ntz(fixtures.AS_OF)
    broken = tel.withColumn("latitud", F.when(F.col("id") == 5, F.raise_error(F.lit("broken")).cast("double")).otherwise(F.col("latitud")))
    with pytest.raises(Exception, match="broken"):
        jobs.ingest(spark, broken, path, log, now, now)
    only = spark.read.parquet(log).collect()
    assert len(only) == 1 and (only[0]["status"], only[0]["created"], only[0]["obtained"]) == ("ERROR", 0, 0) and "broken" in only[0]["message"]
    jobs.ingest(spark, tel, path, log, now, now)
    assert spark.read.parquet(path).count() == tel.count()
    assert sorted(r["status"] for r in spark.read.parquet(log).collect()) == ["ERROR", "OK"]


def test_a_delivery_is_read_for_its_days_and_once_to_be_written(spark, tmp_path):
    """The counters come from the write itself."""
    source, path = str(tmp_path / "in"), str(tmp_path / "tel")
    fixtures.telemetry(spark, FOLDER).write.parquet(source)
    jobs_before = spark.sparkContext._jsc.sc().statusStore().jobsList(None).size()
    counts = files.append_telemetry(spark, spark.read.parquet(source), path)
    ran = spark.sparkContext._jsc.sc().statusStore().jobsList(None).size() - jobs_before
    assert counts["created"] == spark.read.parquet(path).count() and ran <= 6


# Streams


def test_a_stream_adds_nothing_that_is_stored(spark, tmp_path):
    """Readings of ten days before, and a batch that is run again."""
    tel = fixtures.telemetry(spark, FOLDER).select(*NARROW)
    source, path, state, log = (str(tmp_path / n) for n in ("in", "store", "state", "log"))
    stream = lambda: ingest.telemetry_stream(spark, source, tel.schema, "*.parquet")
    tel.where("fecha_hora < '2024-01-25'").coalesce(1).write.parquet(source)
    ingest.ingest_available(stream(), path, state, log)
    tel.where("fecha_hora >= '2024-01-25' or fecha_hora < '2024-01-11'").coalesce(1).write.mode("append").parquet(source)
    ingest.ingest_available(stream(), path, state, log)
    assert rows_of(spark.read.parquet(path).select(*NARROW)) == rows_of(tel)
    counts = {r["batch"]: r["created"] for r in spark.read.parquet(log).collect()}
    assert sum(counts.values()) == tel.count() and len(counts) == 2
    store.remove(spark, f"{state}/commits/{max(counts)}")  # as a run leaves it that stops after the write
    ingest.ingest_available(stream(), path, state, log)
    assert rows_of(spark.read.parquet(path).select(*NARROW)) == rows_of(tel)
    assert {r["batch"]: r["created"] for r in spark.read.parquet(log).collect()}[max(counts)] == 0


def blocks_stream(spark, tmp_path, n=3):
    """A stream of blocks in ``n`` batches, some of which change blocks of earlier ones; gives what the batch operators give."""
    tel = fixtures.telemetry(spark, FOLDER).select(*NARROW).where("porcentaje_bateria is not null and fecha_hora >= '2024-01-29'")
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))

    def run():
        ingest.update_available(ingest.blocks(ingest.telemetry_stream(spark, source, tel.schema, "*.parquet")), out, state)

    for k in range(n):
        tel.where(f"id % {n} = {k}").coalesce(1).write.mode("append").parquet(source)
        run()
    want = rows_of(battery.nearest_readings(battery.slot_candidates(tel)).select("amid", "slot", "pct", "source_id"))
    rows = lambda: rows_of(ingest.latest_version(spark, out, ["amid", "slot"]).select("amid", "slot", "pct", "source_id"))
    return out, state, run, want, rows


def test_compaction_before_a_batch_is_run_again_loses_nothing(spark, tmp_path):
    out, state, run, want, rows = blocks_stream(spark, tmp_path)
    newest = ingest.committed(spark, state)
    store.remove(spark, f"{state}/commits/{newest}")
    assert rows() == want
    ingest.compact(spark, out, state, ["amid", "slot"])
    assert rows() == want and f"batch={newest}" in os.listdir(out)
    run()
    assert rows() == want and ingest.committed(spark, state) == newest
    ingest.compact(spark, out, state, ["amid", "slot"])
    assert rows() == want and [n for n in os.listdir(out) if n.startswith("batch=")] == [f"batch={-newest - 2}"]
    ingest.compact(spark, out, state, ["amid", "slot"])
    assert rows() == want


@pytest.mark.parametrize("stops", ["rename", "remove"])
def test_compaction_that_stops_anywhere_loses_nothing(spark, tmp_path, monkeypatch, stops):
    out, state, _, want, rows = blocks_stream(spark, tmp_path)
    calls = []

    def fail(*args):
        calls.append(args)
        if stops == "rename" or len(calls) > 2:
            raise OSError("stopped")
        return real(*args)

    real = getattr(store, stops)
    monkeypatch.setattr(store, stops, fail)
    with pytest.raises(OSError, match="stopped"):
        ingest.compact(spark, out, state, ["amid", "slot"])
    assert rows() == want
    monkeypatch.undo()
    ingest.compact(spark, out, state, ["amid", "slot"])
    assert rows() == want and len([n for n in os.listdir(out) if n.startswith("batch=")]) == 1


# Orders and searches


def test_alerts_are_numbered_without_one_task_for_all(spark):
    levels = spark.range(5000).select(
        F.col("id").alias("amid"),
        *(F.element_at(F.array(*map(F.lit, ("CRITICA", "ALTA", "ADVERTENCIA", "OK"))), (F.col("id") % k % 4 + 1).cast("int")).alias(c) for k, c in ((7, "level"), (11, "gps_level"), (5, "battery_level"))),
        F.when(F.col("id") % 13 != 0, s.plus(s.ntz("2024-01-30 00:00:00"), minutes=-7)).alias("last_status"),
        F.lit(3).alias("drops_window"),
        F.lit(1).alias("drops_today"),
    )
    as_of = s.ntz(fixtures.AS_OF)
    numbered = alerts.numbered_alerts(levels, as_of)
    assert [r["amid"] for r in numbered.orderBy("n").collect()] == [r["amid"] for r in alerts.rank_alerts(levels, as_of).collect()]
    assert sorted(r["n"] for r in numbered.select("n").collect()) == list(range(1, 5001))
    assert "Window" not in plan(numbered) and "SinglePartition" not in plan(numbered)
    for page, want in ((1, 0), (100, 990), (1_000_000, 4990), (0, 0)):
        assert [r["amid"] for r in alerts.alerts_page(numbered, page).collect()] == [r["amid"] for r in alerts.rank_alerts(levels, as_of).collect()[want : want + 10]]
    assert alerts.alerts_page(alerts.numbered_alerts(levels.where("false"), as_of)).count() == 0


def test_prefixes_are_ranges_that_reach_the_scan(spark, tmp_path):
    ids = [0, 1, 7, 9, 10, 11, 12, 13, 99, 100, 119, 120, 129, 130, 1199, 1200, 1299, 1300, 10**18, 12 * 10**17, 13 * 10**17 - 1, 13 * 10**17, 2**63 - 1]
    path = str(tmp_path / "active")
    spark.createDataFrame([(i,) for i in ids], "amid long").write.parquet(path)
    active = spark.read.parquet(path)
    for term in ("12", "10", "99", "922", "9223372036854775807", "92233720368547758070", "00", "01", "1", "", " 12 ", "1x", "١٢"):
        want = sorted(i for i in ids if len(term.strip()) > 1 and str(i).startswith(term.strip()))
        assert [r["amid"] for r in alerts.search_devices(active, term, 20).collect()] == want, term
    assert "PushedFilters: [Or(" in plan(alerts.search_devices(active, "12"))


def test_the_fallback_day_reads_the_range_and_the_kept_table(spark, tmp_path):
    tel, path, fixes = fixtures.telemetry(spark, FOLDER), str(tmp_path / "tel"), str(tmp_path / "fixes")
    files.append_telemetry(spark, tel, path)
    half = tel.where("id % 2 = 0")
    files.replace_table(telemetry.merged_fixes(telemetry.latest_fixes(half), tel.where("id % 2 <> 0")), fixes)
    stored, start = spark.read.parquet(path).where("day = '2024-01-30'"), s.ntz("2024-01-30 00:00:00")
    got = telemetry.fallback_day(stored, start, s.plus(start, days=1), spark.read.parquet(fixes))
    assert rows_of(got) == rows_of(telemetry.fallback_day(tel, start, s.plus(start, days=1)))
    read = plan(telemetry.fallback_day(stored, start, s.plus(start, days=1), spark.read.parquet(fixes)))
    assert read.count("FileScan") == 2 and "PartitionFilters: [isnotnull(day" in read
    unpartitioned = telemetry.fallback_day(tel, start, s.plus(start, days=1), spark.read.parquet(fixes))
    assert "GreaterThanOrEqual(ts,2024-01-30" in plan(unpartitioned) and plan(unpartitioned).count("FileScan") == 2


def test_the_export_has_one_file_for_a_device_and_set(spark, tmp_path):
    fleet = catalog.Fleet(spark, FOLDER)
    files.export_device(fleet.tel, fleet.blocks, fleet.as_of, str(tmp_path))
    for name in ("summary", "battery", "records"):
        folders = [d for d in (tmp_path / name).iterdir() if d.name.startswith("amid=")]
        assert folders and all(len(list(d.glob("*.parquet"))) == 1 for d in folders)


def test_stored_summaries_follow_their_tables(spark, tmp_path):
    """A session does not go on with the summaries of tables that have changed since."""
    for name in ("events", "customer", "nation"):
        spark.read.parquet(f"{FOLDER}/{name}.parquet").where("true" if name != "events" else "event_id % 2 = 0").write.parquet(f"{tmp_path}/{name}.parquet")
    before = catalog.stored_run(spark, str(tmp_path))
    assert catalog.stored_run(spark, str(tmp_path)) == before
    spark.read.parquet(f"{FOLDER}/events.parquet").write.mode("overwrite").parquet(f"{tmp_path}/events.parquet")
    after = catalog.stored_run(spark, str(tmp_path))
    assert after != before and rows_of(spark.read.parquet(f"{after}/summary").select("amid", "gps_total_window")) == rows_of(catalog.Fleet(spark, FOLDER).summary.select("amid", "gps_total_window"))
