"""Helpers that several training-data operators share."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space that separates words: space and the ASCII controls from tab to carriage return.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_text(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` alone, so that extra columns of any name cannot clash; a null text is empty."""
    return docs.select(F.col("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder where it is unset, on one machine alone."""
    conf = spark.sparkContext.getConf()
    if folder := conf.get("spark.checkpoint.dir"):
        return folder.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", conf.get("spark.master", "")):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return tempfile.mkdtemp(prefix="checkpoint-")


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of ours, wherever Spark keeps it."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def cut_lineage(df: DataFrame) -> DataFrame:
    """A reliable checkpoint in the folder that the cluster shares (``spark.checkpoint.dir``); Spark removes it with the frame.

    A folder of our own is used only where the session names none and runs in one process, as in tests.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def whole_rows(docs: DataFrame, **keys: Column) -> DataFrame:
    """All columns as one struct ``row`` beside the given keys, so that no name of theirs can clash; ``row.*`` gives them back."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), *(key.alias(name) for name, key in keys.items()))


def plain_names(docs: DataFrame, *kept: str) -> DataFrame:
    """The rows with columns that Arrow functions can take, whatever their names: all but ``text`` and ``kept`` are numbered."""
    return docs.select(*(F.col(f"`{c}`").alias(c if c in ("text", *kept) else f"c{i}") for i, c in enumerate(docs.columns)))


def literal_array(values: Iterable, of: str) -> Column:
    """A constant array, written as one string so that building it takes one call."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast(f"array<{of}>")


def words_of(text: Column) -> Column:
    """Words of a text as an array; white space at the ends makes no empty word."""
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def slices(batch: pa.RecordBatch, n_bytes: int, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Runs of rows that hold about ``n_bytes`` of text each; a longer text stands alone."""
    ends = np.cumsum(pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + n_bytes, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def numbered(rows: DataFrame, group: str, *order: str) -> DataFrame:
    """The rows with ``pos``, their place from 0 within ``group`` (not null) by ``order``, nulls first; rows equal in ``order`` are placed as they are read.

    Rows are dealt by ranges of all of it, so that a large group spreads over many tasks; each task numbers its rows, and only counts of tasks are summed.
    """
    by = [group, *order]
    ranged = rows.withColumn("__tie", F.monotonically_increasing_id()).repartitionByRange(*by, "__tie").sortWithinPartitions(*by, "__tie")
    placed = cut_lineage(ranged.drop("__tie").withColumn("__at", F.monotonically_increasing_id()))
    placed = placed.withColumn("__part", F.shiftright("__at", 33))
    counts = placed.groupBy(group, "__part").agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy(group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select(group, "__part", (F.coalesce(before, F.lit(0)) - F.col("__first")).alias("__shift"))
    return placed.join(starts, [group, "__part"]).withColumn("pos", F.col("__at") + F.col("__shift")).drop("__part", "__at", "__shift")
