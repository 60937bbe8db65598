"""Stored tables: several of them replaced together behind one pointer, and tables by day of which single days are replaced or dropped.

A store has one writer at a time and any number of readers. A reader that has read the pointer sees one state of all tables, whatever a writer does meanwhile.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _path(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def _system(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    return _system(spark, path).exists(_path(spark, path))


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, none if it is not there."""
    return [f.getPath().getName() for f in _system(spark, path).listStatus(_path(spark, path))] if exists(spark, path) else []


def stamp(spark: SparkSession, path: str) -> tuple:
    """What tells two states of a table apart: name, size and time of its files."""
    listed = _system(spark, path).listStatus(_path(spark, path)) if exists(spark, path) else []
    return tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in listed))


def remove(spark: SparkSession, path: str) -> None:
    _system(spark, path).delete(_path(spark, path), True)


def rename(spark: SparkSession, path: str, to: str) -> bool:
    return _system(spark, path).rename(_path(spark, path), _path(spark, to))


def _write_new(spark: SparkSession, path: str, text: str) -> None:
    """A whole file or none: written under another name, then renamed; fails if there is one of that name."""
    jvm, draft = spark.sparkContext._jvm, f"{path}.{uuid.uuid4().hex}.draft"
    out = _system(spark, draft).create(_path(spark, draft), False)
    out.write(bytearray(text.encode()))
    out.close()
    overwriting = getattr(jvm, "org.apache.hadoop.fs.Options$Rename")
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(_path(spark, draft).toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    try:
        context.rename(_path(spark, draft), _path(spark, path), spark.sparkContext._gateway.new_array(overwriting, 0))
    finally:
        remove(spark, draft)


def _read(spark: SparkSession, path: str) -> str:
    """A small file, in the driver."""
    stream = _system(spark, path).open(_path(spark, path))
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


class Conflict(RuntimeError):
    """Another writer committed since the state that a commit is based on."""


class Snapshots:
    """Tables that change together. Each version is one small file that names the folder of every table; a version counts once its file is there.

    A commit writes the tables it replaces into new folders, and the file of the next version last, so a run that fails anywhere before leaves all tables as they
    were, and what reads an older version goes on reading it. Tables that a commit does not name stay. ``vacuum`` removes what no kept version names.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _versions(self) -> list[int]:
        return sorted(int(n[:-5]) for n in names_in(self.spark, f"{self.path}/_versions") if re.fullmatch(r"[0-9]+\.json", n))

    def version(self) -> int:
        """The number of the newest version, 0 before the first."""
        return max(self._versions(), default=0)

    def folders(self, version: int | None = None) -> dict[str, str]:
        """The folder of each table in a version, the newest if none is named."""
        number = self.version() if version is None else version
        return json.loads(_read(self.spark, f"{self.path}/_versions/{number}.json")) if number else {}

    def read(self, *tables: str, version: int | None = None) -> list[DataFrame]:
        """Some tables, all of one version."""
        at = self.folders(version)
        return [self.spark.read.parquet(f"{self.path}/{at[t]}") for t in tables]

    def commit(self, tables: dict[str, DataFrame], based_on: int | None = None) -> int:
        """Replace some tables as one unit; the frames may read from the store. Fails without effect if a frame does, or if the version it is based on is not the newest."""
        before = self.version() if based_on is None else based_on
        folders, new = dict(self.folders(before)), f"data-{uuid.uuid4().hex}"
        try:
            for name, df in tables.items():
                df.write.parquet(f"{self.path}/{new}/{name}")
                folders[name] = f"{new}/{name}"
            if self.version() != before:
                raise Conflict(f"version {before} is not the newest any more")
            _write_new(self.spark, f"{self.path}/_versions/{before + 1}.json", json.dumps(folders, sort_keys=True))
        except BaseException:
            remove(self.spark, f"{self.path}/{new}")
            raise
        return before + 1

    def vacuum(self, keep: int = 2) -> None:
        """Remove all but the newest versions, and folders that none of these names; run it when no commit is under way."""
        versions = self._versions()
        for number in versions[:-keep]:
            remove(self.spark, f"{self.path}/_versions/{number}.json")
        named = {folder.split("/")[0] for number in versions[-keep:] for folder in self.folders(number).values()}
        for name in names_in(self.spark, self.path):
            if name.startswith("data-") and name not in named:
                remove(self.spark, f"{self.path}/{name}")


# Tables by day


def with_day(rows: DataFrame, time: str) -> DataFrame:
    return rows.withColumn("day", F.to_date(time))


def days_of(rows: DataFrame, time: str) -> list:
    """The days that some rows touch, in order; as many as the calendar has."""
    return sorted(r["day"] for r in rows.select(F.to_date(time).alias("day")).where("day is not null").distinct().collect())


def read_days(spark: SparkSession, path: str, days: Iterable, like: DataFrame) -> DataFrame:
    """The stored rows of some days; other partitions are not read. Before the first delivery that has rows, none, of the columns of ``like``."""
    if not any(n.startswith("day=") for n in names_in(spark, path)):
        return like.where("false")
    return spark.read.parquet(path).where(F.col("day").isNotNull() & F.col("day").isin(list(days)))


def replace_days(rows: DataFrame, path: str) -> None:
    """Write the days that ``rows`` (with ``day``) hold in the place of those stored; other days are not touched, and a day is in few files."""
    by_day = rows.repartition("day", F.pmod(F.xxhash64("amid"), F.lit(FILES_A_DAY)))
    write_days(by_day.sortWithinPartitions("day", "amid"), path)


def write_days(rows: DataFrame, path: str) -> None:
    """The same for rows that are dealt by day and in order already."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


#: A day is dealt to so many tasks at most, each of which writes one file of it.
FILES_A_DAY = 8


def drop_days(spark: SparkSession, path: str, before: Column) -> int:
    """Remove whole days before a time, without rewriting any other; gives the number of rows that went."""
    limit = spark.range(1).select(F.to_date(before).alias("d")).first()["d"].isoformat()  # one row
    old = sorted(n for n in names_in(spark, path) if re.fullmatch(r"day=[0-9]{4}-[0-9]{2}-[0-9]{2}", n) and n[4:] < limit)
    if not old:
        return 0
    gone = spark.read.option("basePath", path).parquet(*(f"{path}/{n}" for n in old)).count()  # from the footers of the files
    for name in old:
        remove(spark, f"{path}/{name}")
    return gone
