"""Tables in one directory per day, of which a job reads and rewrites only the days it touches."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterwise.sources.snapshots import _file_system

DAY, BATCH = "day", "batch"
#: Rows without a time are filed here, so that the directory's name is a date like all others.
NO_DAY = dt.date(1000, 1, 1)


def day_of(time: Column | str) -> Column:
    return F.coalesce(F.to_date(time), F.lit(NO_DAY.isoformat()).cast("date"))


def write_days(rows: DataFrame, path: str, time: str, batch: int | None = None) -> None:
    """Replaces the days that ``rows`` have (with ``batch``, only what that batch wrote there); other days stay as they are.

    Dynamic partition overwrite: the new files are written aside and moved in when all are there. The rebalance hint merges
    and splits a day's rows by their real size, so that a day with very many is written by many tasks.
    """
    by = [DAY] if batch is None else [DAY, BATCH]
    filed = rows.withColumn(DAY, day_of(time))
    if batch is not None:
        filed = filed.withColumn(BATCH, F.lit(batch).cast("bigint"))
    writer = filed.hint("rebalance", F.col(DAY)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(*by).parquet(path)


def read_days(spark: SparkSession, path: str, schema: T.StructType, days: Iterable[dt.date] | None = None, before: int | None = None) -> DataFrame:
    """The table with its day column (and its batch, where ``before`` is given: only rows of earlier batches). With ``days``
    only their directories are listed; a table that is not there is empty."""
    fields = [*schema.fields, T.StructField(DAY, T.DateType())]
    if before is not None:
        fields.append(T.StructField(BATCH, T.LongType()))
    wide = T.StructType(fields)
    wanted = [path] if days is None else [f"{path}/{DAY}={day.isoformat()}" for day in sorted(set(days))]
    there = [p for p in wanted if _exists(spark, p)]
    if not there:
        return spark.createDataFrame([], wide)
    rows = spark.read.schema(wide).option("basePath", path).parquet(*there)
    return rows if before is None else rows.filter(F.col(BATCH) < before)


def stored_days(spark: SparkSession, path: str) -> list[dt.date]:
    """The days a table has, newest first, from the names of its directories."""
    pattern, fs = _file_system(spark, f"{path}/{DAY}=*")
    return sorted((dt.date.fromisoformat(s.getPath().getName().split("=")[1]) for s in fs.globStatus(pattern) or []), reverse=True)


def newest_days(
    spark: SparkSession, path: str, schema: T.StructType, enough: int, wanted: Callable[[DataFrame], DataFrame], before: dt.date | None = None
) -> DataFrame:
    """The newest days of a table that hold ``enough`` rows of those that ``wanted`` leaves, or all days.

    For lists of the newest rows by the time that the table is filed by: once so many are found, no older day can add one. Days
    are looked at from the newest on, twice as many each time, so there are few looks and at most twice the days that are needed
    are read.
    """
    days = [d for d in stored_days(spark, path) if before is None or d <= before]
    taken = 1
    while True:
        rows = read_days(spark, path, schema, days[:taken])
        if taken >= len(days) or wanted(rows).limit(enough).count() >= enough:
            return rows
        taken *= 2


def days_in(rows: DataFrame) -> list[dt.date]:
    """The distinct days of a frame with a day column, on the driver: as many as the calendar has in its span."""
    return [row[0] for row in rows.select(DAY).distinct().collect()]


def _exists(spark: SparkSession, path: str) -> bool:
    place, fs = _file_system(spark, path)
    return fs.exists(place)
