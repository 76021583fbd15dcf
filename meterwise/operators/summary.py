"""Executive summary: totals, savings, health scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meterwise.functions import constants as K
from meterwise.functions import expressions as X
from meterwise.operators.detection import Moment
from meterwise.schemas import SAVINGS_HISTORY, conform


def _saved() -> Column:
    return F.coalesce(F.sum(F.when(F.col("status") == K.RESOLVED, F.col("credits_wasted"))), F.lit(0))


def kpi_summary(anomalies: DataFrame) -> DataFrame:
    """One row of totals; sums over nothing are 0."""
    return anomalies.agg(
        F.count(F.lit(1)).alias("total_anomalies"),
        F.coalesce(F.sum("credits_wasted"), F.lit(0)).alias("credits_wasted"),
        _saved().alias("credits_saved"),
        F.count_if(F.col("status").isin(*K.UNRESOLVED)).alias("open_issues"),
    ).withColumn("dollars_saved", X.dollars(F.col("credits_saved")))


def environment_impact(anomalies: DataFrame) -> DataFrame:
    """Energy, emissions and trees that the saved credits stand for; never less than one tree."""
    saved = anomalies.agg(_saved().alias("credits_saved"))
    kwh = F.col("credits_saved") * F.lit(K.KWH_PER_CREDIT)
    co2 = F.col("kwh_saved") * F.lit(K.CO2_KG_PER_KWH)
    trees = F.greatest(F.lit(1).cast("bigint"), (F.col("co2_kg_avoided") / F.lit(K.CO2_KG_PER_TREE)).cast("bigint"))
    return saved.withColumn("kwh_saved", kwh).withColumn("co2_kg_avoided", co2).withColumn("trees", trees)


def snapshot_savings(anomalies: DataFrame) -> DataFrame:
    """Cumulative dollars saved at the end of each day on which something was resolved.

    The running total is taken over one row per day, so its single task stays small however many anomalies there are.
    """
    daily = (
        anomalies.filter((F.col("status") == K.RESOLVED) & F.col("resolved_at").isNotNull())
        .groupBy(F.to_date("resolved_at").alias("snapshot_date"))
        .agg(F.sum("credits_wasted").alias("credits"))
    )
    return running_savings(daily)


def running_savings(daily: DataFrame) -> DataFrame:
    """Cumulative dollars from (snapshot_date, credits), one row per day."""
    so_far = F.sum("credits").over(W.orderBy("snapshot_date").rowsBetween(W.unboundedPreceding, 0))
    rows = daily.select("snapshot_date", F.round(X.dollars(so_far), 2).alias("dollar_saved"))
    return conform(rows, SAVINGS_HISTORY)


def savings_trend(history: DataFrame, as_of: Moment | None = None, days: int | None = None) -> DataFrame:
    """Savings by day, oldest first; optionally only the ``days`` dates that end with that of ``as_of``."""
    rows = history.select("snapshot_date", "dollar_saved")
    if days is not None:
        last = F.to_date(X.moment(as_of))
        rows = rows.filter((F.col("snapshot_date") > F.date_sub(last, days)) & (F.col("snapshot_date") <= last))
    return rows.orderBy("snapshot_date")


def anomalies_by_warehouse(anomalies: DataFrame) -> DataFrame:
    """Count and credits per warehouse and type, most expensive first."""
    return (
        anomalies.groupBy("warehouse_name", "anomaly_type")
        .agg(F.count(F.lit(1)).alias("anomaly_count"), F.sum("credits_wasted").alias("credits"))
        .orderBy(F.desc("credits"), "warehouse_name", "anomaly_type")
    )


def recent_anomaly_counts(anomalies: DataFrame, as_of: Moment, days: int = 7) -> DataFrame:
    """Anomalies per warehouse detected in the last ``days`` days up to ``as_of``."""
    now = X.moment(as_of)
    bound = now - F.make_dt_interval(days=F.lit(days))
    return (
        anomalies.filter((F.col("detected_at") >= bound) & (F.col("detected_at") <= now))
        .groupBy("warehouse_name")
        .agg(F.count(F.lit(1)).alias("anomaly_count"))
    )


def health_scores(warehouses: DataFrame, anomalies: DataFrame, as_of: Moment) -> DataFrame:
    """0 to 100 per warehouse from its settings and its recent anomalies. A missing or zero suspend time counts as 600.

    The anomalies are counted per warehouse before the join, so both sides have one row per warehouse and the runtime
    plan may broadcast the smaller one.
    """
    recent = recent_anomaly_counts(anomalies, as_of).withColumnRenamed("warehouse_name", "name")
    suspend = F.coalesce(F.nullif(F.col("auto_suspend"), F.lit(0)), F.lit(600))
    idle = (F.col("state") == "STARTED") & (F.coalesce(F.col("running"), F.lit(0)) == 0)
    penalty = (
        F.when(suspend > 300, 15).otherwise(0)
        + F.when(suspend > 600, 10).otherwise(0)
        + F.when(idle, 20).otherwise(0)
        + F.least(F.col("anomaly_count") * 8, F.lit(40))
    )
    return (
        warehouses.join(recent, "name", "left")
        .withColumn("anomaly_count", F.coalesce(F.col("anomaly_count"), F.lit(0)))
        .withColumn("score", F.greatest(F.lit(100) - penalty, F.lit(0)).cast("bigint"))
        .select("name", "state", "anomaly_count", "score", X.score_band(F.col("score")).alias("band"))
    )


def quick_stats(notifications: DataFrame, anomalies: DataFrame, warehouses: DataFrame) -> DataFrame:
    """Unread notifications, open issues and warehouses, in one row."""
    unread = notifications.agg(F.count_if(~F.col("is_read")).alias("n"))
    issues = anomalies.agg(F.count_if(F.col("status").isin(*K.UNRESOLVED)).alias("n"))
    total = warehouses.agg(F.count(F.lit(1)).alias("n"))
    return anomalies.sparkSession.range(1).select(
        unread.scalar().alias("unread_notifications"),
        issues.scalar().alias("open_issues"),
        total.scalar().alias("warehouses_total"),
    )
