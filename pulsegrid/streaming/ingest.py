"""Incremental ingest and block alignment as streams; both give what the batch operators give."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.operators.battery import slot_candidates
from pulsegrid.sources import files, store

LATENESS = "2 days"


def telemetry_stream(spark: SparkSession, path: str, schema, files: str = "*") -> DataFrame:
    """The Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("pathGlobFilter", files).parquet(path)


def with_event_time(tel: DataFrame, column: str = "fecha_hora", lateness: str = LATENESS) -> DataFrame:
    """An event time that watermarks accept. Naive times are read as UTC; run the session in UTC."""
    return tel.withColumn("event_time", F.col(column).cast("timestamp")).withWatermark("event_time", lateness)


def deduplicated(tel: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """Each device and time once."""
    return with_event_time(tel, "fecha_hora", lateness).dropDuplicatesWithinWatermark(["amid", "fecha_hora"]).drop("event_time")


def blocks(tel: DataFrame, lateness: str = LATENESS) -> DataFrame:
    """Non-empty blocks; readings later than the watermark are left out and their state is dropped."""
    candidates = with_event_time(slot_candidates(tel), "slot", lateness)
    order = F.struct(F.col("diff_minutes"), -F.unix_micros(F.col("fecha_hora").cast("timestamp")), -F.col("id"))
    best = F.min_by(F.struct("porcentaje_bateria", "id", "diff_minutes"), order)
    grouped = candidates.groupBy("amid", F.window("event_time", "30 minutes")).agg(best.alias("b"))
    return grouped.select("amid", F.col("window.start").cast("timestamp_ntz").alias("slot"), F.col("b.porcentaje_bateria").alias("pct"), F.col("b.id").alias("source_id"), F.col("b.diff_minutes").alias("diff_minutes"))


def append_available(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Process what is there into Parquet and stop; a restart goes on from the checkpoint."""
    stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def ingest_available(stream: DataFrame, path: str, checkpoint: str, log: str | None = None) -> None:
    """Append the readings whose device and time are not stored yet, whenever these were stored; gives what the batch append gives.

    Every batch is held against the stored days that it touches, so a reading stored long ago and a batch that is repeated after a failure add nothing. The log, if
    one is named, keeps the counters of each batch under its number; a repeated batch replaces its own.
    """

    def write(df: DataFrame, batch: int) -> None:
        counts = files.append_telemetry(df.sparkSession, df, path)
        if log:
            row = df.sparkSession.range(1).select(*(F.lit(n).cast("long").alias(c) for c, n in counts.items()))
            row.coalesce(1).write.mode("overwrite").parquet(f"{log}/batch={batch}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def update_available(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Like :func:`append_available`, but blocks are written as soon as they change, one folder for each batch; a batch that is run again replaces its folder."""

    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def committed(spark: SparkSession, checkpoint: str) -> int:
    """The newest batch that the stream will not run again, -1 before the first."""
    return max((int(n) for n in store.names_in(spark, f"{checkpoint}/commits") if n.isdigit()), default=-1)


def compact(spark: SparkSession, path: str, checkpoint: str, keys: list[str]) -> None:
    """Keep of all committed batches the last row of each key; run it between runs of the stream.

    They are folded into a folder of a negative number, which no batch has, and removed once that is in its place. A batch that is not committed is left alone, as
    the stream may write it again. Wherever this stops, :func:`latest_version` gives the same rows, as a fold ranks after what it holds and before all else.
    """
    last = committed(spark, checkpoint)
    folded = [b for b in _batches(spark, path) if _rank(b) <= 2 * last + 1]
    if last < 0 or not any(b >= 0 for b in folded):
        return
    fold, draft = _fold(last), f"{path}/_fold-{uuid.uuid4().hex}"
    _latest(spark, path, folded, keys).write.parquet(draft)
    store.remove(spark, f"{path}/batch={fold}")
    if not store.rename(spark, draft, f"{path}/batch={fold}"):
        raise OSError(f"cannot move {draft}")
    for batch in folded:
        if batch != fold:
            store.remove(spark, f"{path}/batch={batch}")


def _fold(last: int) -> int:
    return -last - 2


def _rank(batch: int) -> int:
    """A fold of batches up to ``b`` ranks between ``b`` and ``b + 1``."""
    return 2 * batch if batch >= 0 else 2 * (-batch - 2) + 1


def _batches(spark: SparkSession, path: str) -> list[int]:
    return [int(n[6:]) for n in store.names_in(spark, path) if re.fullmatch(r"batch=-?[0-9]+", n)]


def _latest(spark: SparkSession, path: str, batches: list[int], keys: list[str]) -> DataFrame:
    rows = spark.read.option("basePath", path).parquet(*(f"{path}/batch={b}" for b in sorted(batches)))
    values = [c for c in rows.columns if c not in (*keys, "batch")]
    rank = F.when(F.col("batch") >= 0, 2 * F.col("batch")).otherwise(2 * (-F.col("batch") - 2) + 1)
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), rank).alias("v")).select(*keys, "v.*")


def latest_version(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The last written row of each key."""
    return _latest(spark, path, _batches(spark, path), keys)
