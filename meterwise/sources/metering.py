"""Metering reads: pruned by day when the table is laid out by day."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterwise.functions import constants as K
from meterwise.functions.expressions import moment
from meterwise.schemas import METERING, conform

DAY = "usage_date"


def read_metering(spark: SparkSession, path: str) -> DataFrame:
    """The metering table, with its ``usage_date`` partition column if it was written by :func:`write_metering`."""
    return spark.read.parquet(path)


def write_metering(metering: DataFrame, path: str, mode: str = "append") -> None:
    """Write metering rows in one directory per day, so that a lookback reads only the days it needs.

    The rebalance hint asks for one shuffle by day whose partitions are then merged and split by their real size: a
    day with a third of all rows is still written by many tasks, and small days do not leave many small files.
    """
    (
        conform(metering, METERING)
        .withColumn(DAY, F.to_date("start_time"))
        .hint("rebalance", F.col(DAY))
        .write.mode(mode)
        .partitionBy(DAY)
        .parquet(path)
    )


def lookback_bound(as_of: dt.datetime | str | Column | None, lookback_hours: int) -> Column:
    if as_of is None:
        raise ValueError("a lookback needs as_of")
    return moment(as_of) - F.make_dt_interval(hours=F.lit(lookback_hours))


def rows_since(metering: DataFrame, bound: Column, before: Column | None = None) -> DataFrame:
    """Rows that start at or after ``bound``, and before ``before``; with a day column, only those days are read."""
    rows = metering.filter(F.col("start_time") >= bound)
    if DAY in metering.columns:
        rows = rows.filter(F.col(DAY) >= F.to_date(bound))
    if before is not None:
        rows = rows.filter(F.col("start_time") < before)
        if DAY in metering.columns:
            rows = rows.filter(F.col(DAY) <= F.to_date(before))
    return rows


def scan_metering(
    metering: DataFrame,
    *,
    as_of: dt.datetime | str | Column | None = None,
    lookback_hours: int | None = None,
    exclude: Sequence[str] = (),
) -> DataFrame:
    """All rows, or the rows of the last ``lookback_hours`` before ``as_of``, without the excluded warehouses."""
    rows = metering
    if lookback_hours is not None:
        rows = rows_since(rows, lookback_bound(as_of, lookback_hours), moment(as_of))
    if exclude:
        rows = rows.filter(~F.col("warehouse_name").isin(*exclude))
    return rows


def metering_from_rows(spark: SparkSession, rows: Sequence[tuple]) -> DataFrame:
    """A metering frame from literal rows, for demos and tests."""
    return spark.createDataFrame(rows, METERING)


def live_scan(metering: DataFrame, as_of: dt.datetime | str | Column, lookback_hours: int = K.LOOKBACK_HOURS) -> DataFrame:
    """The rows the live idle scan looks at."""
    return scan_metering(metering, as_of=as_of, lookback_hours=lookback_hours, exclude=(K.PSEUDO_WAREHOUSE,))
