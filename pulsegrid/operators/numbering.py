"""Row numbers over a whole order without bringing all rows into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.sources.files import shared_folder


def numbered(ranged: DataFrame, name: str) -> DataFrame:
    """Rows that are dealt by ranges and sorted within them, with their number from 1.

    Each task numbers its own rows; only the number of rows of each task comes to the driver. A checkpoint keeps the ranges as they are between both.
    """
    placed = _checkpointed(ranged.withColumn("__at", F.monotonically_increasing_id())).withColumn("__part", F.shiftright("__at", 33).cast("int"))
    counts = {r["__part"]: r["n"] for r in placed.groupBy("__part").agg(F.count("*").alias("n")).collect()}  # one row a task
    starts, before = [], 0
    for part in range(max(counts, default=-1) + 1):
        starts.append(before - (part << 33) + 1)
        before += counts.get(part, 0)
    start = F.get(F.split(F.lit(",".join(map(str, starts or [0]))), ",").cast("array<long>"), F.col("__part"))
    return placed.withColumn(name, F.col("__at") + start).drop("__at", "__part")


def _checkpointed(rows: DataFrame) -> DataFrame:
    sc = rows.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(rows.sparkSession))
    return rows.checkpoint(eager=True)
