"""The two recompute jobs as lazy plans: full from telemetry, fast from stored measures."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.functions import scalars as s
from pulsegrid.operators import battery, classify, locations, rules, summary
from pulsegrid.operators.merge import merge_by_key, merge_columns
from pulsegrid.sources import files, store


@dataclass
class Recomputed:
    blocks: DataFrame
    drops: DataFrame
    summary: DataFrame


def full(tel: DataFrame, master: DataFrame, rule_rows: DataFrame, as_of: Column) -> Recomputed:
    """Blocks, drops and classified summaries of the window; all shuffles are on the device."""
    row = rules.rules_row(rule_rows)
    today = s.midnight(as_of)
    window = (s.plus(today, days=-summary.WINDOW_DAYS), s.plus(today, hours=23, minutes=30))
    filled = battery.filled_blocks(tel, *window)
    every = battery.detect_drops(filled, row, as_of)
    drops = every.join(master.where("active = 1").select("amid"), "amid", "left_semi")
    return Recomputed(battery.build_blocks(tel, master, *window), drops, classify.classify(summary.device_summary(master, tel, filled, every, as_of), row))


def run_full(tel: DataFrame, master: DataFrame, rule_rows: DataFrame, stored: DataFrame | None, as_of: Column) -> Recomputed:
    """Validate the rules, recompute all, and merge the summaries into the stored ones."""
    out = full(tel, master, rules.require_valid(rule_rows), as_of)
    if stored is not None:
        out.summary = merge_by_key(stored, out.summary, ["amid"])
    return out


def commit_full(spark: SparkSession, path: str, tel: DataFrame, master: DataFrame, rule_rows: DataFrame, as_of: Column) -> int:
    """A full run whose drops and merged summaries replace the stored ones as one unit; a run that fails leaves both as they were."""
    stored = store.Snapshots(spark, path)
    before = stored.version()
    out = run_full(tel, master, rule_rows, stored.read("summary", version=before)[0] if before else None, as_of)
    return stored.commit({"drops": out.drops, "summary": out.summary}, before)


def run_fast(stored: DataFrame, master: DataFrame, rule_rows: DataFrame, as_of: Column) -> DataFrame:
    """Validate the rules and classify stored summaries of active devices anew; other rows and columns stay."""
    row = rules.rules_row(rules.require_valid(rule_rows))
    return merge_columns(stored, classify.reclassify(stored, master, row, as_of), ["amid"], list(classify.CLASSIFICATION))


#: Characters of an error that the run log keeps.
MESSAGE = 2000
MODES = ("none", "fast", "full")


def run_mode(mode: str, tel: DataFrame, master: DataFrame, rule_rows: DataFrame, stored: DataFrame, as_of: Column) -> DataFrame:
    """The summaries after a recompute of the given mode; any other mode is refused."""
    if mode not in MODES:
        raise ValueError(f"unknown mode: {mode}")
    if mode == "none":
        return stored
    return run_fast(stored, master, rule_rows, as_of) if mode == "fast" else run_full(tel, master, rule_rows, stored, as_of).summary


def change_rules(current: DataFrame, requested: DataFrame, tel: DataFrame, master: DataFrame, stored: DataFrame, as_of: Column) -> tuple[str, DataFrame, DataFrame]:
    """One change of one set of rules: compare, refuse what is unknown or invalid, choose the mode and recompute.

    Gives the mode, the new rules and the summaries; raises without any effect if the change is refused.
    """
    rules.load_rules(current)
    verdict = rules.guarded_changes(current, requested).first()  # one row
    if verdict["outcome"] == "rejected":
        raise ValueError(f"rejected: {', '.join(verdict['reasons'])}")
    after = rules.changed_rules(current, requested)
    return verdict["outcome"], after, run_mode(verdict["outcome"], tel, master, after, stored, as_of)


def ingest(spark: SparkSession, incoming: DataFrame, path: str, log: str, started: Column, ended: Column) -> dict[str, int]:
    """Append a delivery to the stored telemetry, then write its counters to the run log; of a failure the log keeps the message, and it is raised."""
    try:
        counts = files.append_telemetry(spark, incoming, path)
    except Exception as error:
        files.log_run(spark, log, "ingest", "ERROR", started, ended, message=str(error)[:MESSAGE])
        raise
    files.log_run(spark, log, "ingest", "OK", started, ended, counts)
    return counts


def purge_history(history: DataFrame, path: str, as_of: Column, days: int = 16) -> DataFrame:
    """Replace the stored history by what retention keeps; gives the number of rows deleted and kept."""
    kept = locations.purge_history(history, as_of, days)
    counts = history.agg(F.count("*").alias("before")).crossJoin(kept.agg(F.count("*").alias("kept"))).select((F.col("before") - F.col("kept")).alias("deleted"), "kept")  # one row each
    counted = history.sparkSession.createDataFrame([tuple(counts.first())], counts.schema)
    files.replace_table(kept, path)
    return counted
