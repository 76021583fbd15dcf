"""Who spent what, and how spending moved from last week to this one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterwise.functions import constants as K
from meterwise.functions import expressions as X
from meterwise.operators.detection import Moment
from meterwise.sources.history import scan_query_history
from meterwise.sources.metering import rows_since


def cost_attribution(history: DataFrame, as_of: Moment, days: int = 7, limit: int = 10) -> DataFrame:
    """The users and roles with the highest cloud-services cost."""
    credits = F.sum("credits_used_cloud_services")
    return (
        scan_query_history(history, as_of, days)
        .groupBy("user_name", "role_name")
        .agg(
            F.count(F.lit(1)).alias("queries"),
            F.round(credits, 4).alias("credits"),
            F.round(X.dollars(credits), 2).alias("dollars"),
        )
        .orderBy(F.desc("credits"), "user_name", "role_name")
        .limit(limit)
    )


def change_text(this_week: Column, last_week: Column) -> Column:
    """Signed percentage at one decimal, or ``new`` without a last week to compare with."""
    percent = F.round(F.abs(this_week - last_week) * 100 / F.nullif(last_week, F.lit(0).cast("decimal(28,9)")), 1)
    text = F.concat(F.when(this_week < last_week, "-").otherwise("+"), percent.cast("decimal(28,1)").cast("string"))
    return F.when(last_week > 0, F.concat(text, F.lit("%"))).otherwise("new")


def week_over_week(metering: DataFrame, as_of: Moment) -> DataFrame:
    """Credits per warehouse in the week of ``as_of`` (from Monday, up to ``as_of``) and in the one before."""
    now = X.moment(as_of)
    today = F.to_date(now).cast("timestamp")
    monday = F.date_trunc("week", today)
    week = F.make_dt_interval(days=F.lit(7))
    start, used = F.col("start_time"), F.col("credits_used")
    nothing = F.lit(0).cast(metering.schema["credits_used"].dataType)
    this_week = F.when(start >= monday, used).otherwise(nothing)
    last_week = F.when((start >= monday - week) & (start < monday), used).otherwise(nothing)
    return (
        rows_since(metering, today - F.make_dt_interval(days=F.lit(14)), now)
        .filter(F.col("warehouse_name") != K.PSEUDO_WAREHOUSE)
        .groupBy("warehouse_name")
        .agg(F.sum(this_week).alias("this_week"), F.sum(last_week).alias("last_week"))
        .filter((F.col("this_week") > 0) | (F.col("last_week") > 0))
        .withColumn("change", change_text(F.col("this_week"), F.col("last_week")))
    )
