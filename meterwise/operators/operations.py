"""Operations and approvals: status, fix history, pending and past approvals, query drilldown."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meterwise.functions import constants as K
from meterwise.functions import expressions as X
from meterwise.sources.history import DAY


def warehouse_status(warehouses: DataFrame) -> DataFrame:
    state = F.col("state")
    label = F.when(state == "STARTED", "Running").when(state == "SUSPENDED", "Suspended").otherwise(state)
    return warehouses.select(
        "name",
        label.alias("status"),
        "size",
        "auto_suspend",
        F.concat(F.col("auto_suspend").cast("string"), F.lit("s")).alias("suspend_text"),
        "running",
        "queued",
    )


def _with_anomaly(newest: DataFrame, anomalies: DataFrame) -> DataFrame:
    """Join a handful of log rows to their anomalies.

    The log rows are limited first: anomalies are never deleted, so every row finds its own, and what is broadcast has
    at most the report's limit of rows. The anomaly table is only scanned, never shuffled.
    """
    what = anomalies.select("anomaly_id", "warehouse_name", "anomaly_type", "severity", "credits_wasted")
    return (
        what.join(F.broadcast(newest), "anomaly_id")
        .withColumn("dollar_saved", F.round(X.dollars(F.col("credits_wasted")), 2))
        .orderBy(F.desc("logged_at"), F.desc("log_id"))
    )


def auto_fix_history(audit_log: DataFrame, anomalies: DataFrame, limit: int = 10) -> DataFrame:
    """The newest automatic fixes with what they save."""
    newest = (
        audit_log.filter((F.col("action_type") == K.AUTO_ACTION) & (F.col("status") == K.COMPLETED))
        .select("log_id", "logged_at", "anomaly_id", "action_details", "sql_executed")
        .orderBy(F.desc("logged_at"), F.desc("log_id"))
        .limit(limit)
    )
    return _with_anomaly(newest, anomalies).select(
        "log_id",
        "logged_at",
        "warehouse_name",
        "anomaly_type",
        "severity",
        "dollar_saved",
        "action_details",
        "sql_executed",
    )


def waiting_fixes(anomalies: DataFrame, audit_log: DataFrame) -> DataFrame:
    """Acknowledged anomalies whose fix waits for approval, in no particular order."""
    waiting = audit_log.filter(F.col("status") == K.PENDING_APPROVAL).select(
        "anomaly_id", F.col("sql_executed").alias("proposed_fix"), "action_details"
    )
    return (
        anomalies.filter(F.col("status") == K.ACKNOWLEDGED)
        .select("anomaly_id", "warehouse_name", "anomaly_type", "severity", "credits_wasted", "description")
        .join(waiting, "anomaly_id")
        .withColumn("dollars_at_risk", X.dollars(F.col("credits_wasted")))
    )


def pending_approvals(anomalies: DataFrame, audit_log: DataFrame) -> DataFrame:
    """The waiting fixes, most expensive first."""
    return waiting_fixes(anomalies, audit_log).orderBy(F.desc("credits_wasted"), "anomaly_id")


def approval_kpis(pending: DataFrame) -> DataFrame:
    return pending.agg(
        F.count(F.lit(1)).alias("total_pending"),
        F.coalesce(X.dollars(F.sum("credits_wasted")), F.lit(0)).alias("dollars_at_risk"),
        F.count_if(F.col("severity").isin(*K.URGENT_SEVERITIES)).alias("high_count"),
    )


def recently_approved(audit_log: DataFrame, anomalies: DataFrame, limit: int = 5) -> DataFrame:
    """The newest human approvals; the warehouse comes from the anomaly, as approval rows carry none."""
    newest = (
        audit_log.filter(
            (F.col("action_type") == K.USER_ACTION)
            & (F.col("status") == K.COMPLETED)
            & F.col("approved_by").isNotNull()
        )
        .select("log_id", "logged_at", "anomaly_id", "approved_by")
        .orderBy(F.desc("logged_at"), F.desc("log_id"))
        .limit(limit)
    )
    return _with_anomaly(newest, anomalies).select(
        "log_id", "logged_at", "warehouse_name", "anomaly_type", "severity", "dollar_saved", "approved_by"
    )


def spike_queries(anomalies: DataFrame, history: DataFrame) -> DataFrame:
    """All queries that ran on the warehouse inside each spike's window.

    A window is cut into the hours it touches and joined on (warehouse, hour); a query lies in exactly one hour, so no
    pair comes out twice. The range test is then a residual condition on an equi-join, which the runtime plan may
    broadcast or split by skew. Of a history with a day column only the spikes' days are read.
    """
    last_instant = F.col("anomaly_end") - F.expr("interval 1 microsecond")
    touched = F.sequence(X.hour_number(F.col("anomaly_start")), X.hour_number(last_instant))
    spikes = (
        anomalies.filter(
            (F.col("anomaly_type") == K.COST_SPIKE) & (F.col("anomaly_end") > F.col("anomaly_start"))
        )
        .select("anomaly_id", "warehouse_name", "anomaly_start", "anomaly_end", F.explode(touched).alias("_hour"))
    )
    if DAY in history.columns:
        # One row per day: what is broadcast grows with the calendar only, and prunes the history's directories at run time.
        days = spikes.select(F.to_date(F.timestamp_seconds(F.col("_hour") * 3600)).alias("_day")).distinct()
        history = history.join(F.broadcast(days), F.col(DAY) == F.col("_day"), "left_semi")
    queries = history.select(
        "query_id",
        "warehouse_name",
        "user_name",
        "role_name",
        "start_time",
        "credits_used_cloud_services",
        X.hour_number(F.col("start_time")).alias("_hour"),
    )
    inside = (F.col("start_time") >= F.col("anomaly_start")) & (F.col("start_time") < F.col("anomaly_end"))
    return spikes.join(queries, ["warehouse_name", "_hour"]).filter(inside).drop("_hour")


def top_spike_queries(anomalies: DataFrame, history: DataFrame, limit: int = 5) -> DataFrame:
    """The ``limit`` most expensive queries of each spike. The rank limit also runs before the shuffle."""
    rank = F.row_number().over(
        W.partitionBy("anomaly_id").orderBy(F.desc("credits_used_cloud_services"), "query_id")
    )
    return spike_queries(anomalies, history).withColumn("cost_rank", rank).filter(F.col("cost_rank") <= limit)
