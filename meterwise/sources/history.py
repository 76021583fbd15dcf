"""Query-history reads."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterwise.functions.expressions import moment
from meterwise.schemas import QUERY_HISTORY, conform

DAY = "query_date"


def read_query_history(spark: SparkSession, path: str) -> DataFrame:
    """The query history, with its ``query_date`` partition column if :func:`write_query_history` wrote it."""
    return spark.read.parquet(path)


def write_query_history(history: DataFrame, path: str, mode: str = "append") -> None:
    """Write queries in one directory per day. Days are split and merged by size, as for metering."""
    (
        conform(history, QUERY_HISTORY)
        .withColumn(DAY, F.to_date("start_time"))
        .hint("rebalance", F.col(DAY))
        .write.mode(mode)
        .partitionBy(DAY)
        .parquet(path)
    )


def history_between(history: DataFrame, since: Column, before: Column) -> DataFrame:
    """Queries that start in ``[since, before)``; with a day column, only those days are read."""
    rows = history.filter((F.col("start_time") >= since) & (F.col("start_time") < before))
    if DAY in history.columns:
        rows = rows.filter(F.col(DAY).between(F.to_date(since), F.to_date(before)))
    return rows


def scan_query_history(history: DataFrame, as_of: dt.datetime | str | Column, days: int = 7) -> DataFrame:
    """Queries of the last ``days`` days before ``as_of`` that used cloud-services credits."""
    now = moment(as_of)
    rows = history_between(history, now - F.make_dt_interval(days=F.lit(days)), now)
    return rows.filter(F.col("credits_used_cloud_services") > 0)
