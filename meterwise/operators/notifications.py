"""In-app notifications: generation from the audit log, feed, counts, read marks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterwise.functions import constants as K
from meterwise.functions import expressions as X
from meterwise.functions import wording as T
from meterwise.operators.detection import Moment
from meterwise.operators.identity import shift_ids
from meterwise.schemas import NOTIFICATIONS, conform


def generate_notifications(audit_log: DataFrame, anomalies: DataFrame, after: Column | int = 0) -> DataFrame:
    """One unread notification per audit row that concerns an anomaly.

    Waiting fixes ask for approval, approvals report success, automatic fixes warn about a spike and inform otherwise.
    A scheduled run passes only the audit rows that are new, and the highest notification id so far as ``after``.
    """
    logged = audit_log.filter(F.col("anomaly_id").isNotNull() & (F.col("action_type") != K.DETECTION)).select(
        "log_id", "logged_at", "action_type", "anomaly_id", "action_details", "status"
    )
    # Numbered before the join: finding the first id then takes a scan of the log and no second join.
    logged = shift_ids(logged, "notification_id", "log_id", after)
    what = anomalies.select("anomaly_id", "anomaly_type", "warehouse_name")
    kind = (
        F.when(F.col("status") == K.PENDING_APPROVAL, K.APPROVAL_NEEDED)
        .when(F.col("action_type") == K.USER_ACTION, K.APPROVED)
        .when((F.col("action_type") == K.AUTO_ACTION) & (F.col("anomaly_type") == K.COST_SPIKE), K.WARNING)
        .otherwise(K.INFO)
    )
    title = F.lit(None).cast("string")
    for name, text in T.NOTICE_TITLES.items():
        title = F.when(F.col("notification_type") == name, T.fill(text, warehouse=F.col("warehouse_name"))).otherwise(title)
    rows = (
        logged.join(what, "anomaly_id")
        .withColumn("notification_type", kind)
        .select(
            "notification_id",
            F.col("logged_at").alias("created_at"),
            "notification_type",
            title.alias("title"),
            F.col("action_details").alias("message"),
            "warehouse_name",
            F.lit(False).alias("is_read"),
        )
    )
    return conform(rows, NOTIFICATIONS)


def notification_feed(
    notifications: DataFrame, as_of: Moment, notification_type: str | None = None, limit: int = 30, unread: bool = False
) -> DataFrame:
    """The newest notifications with badge and age, optionally of one type or only unread ones."""
    rows = notifications.filter(~F.col("is_read")) if unread else notifications
    if notification_type is not None:
        rows = rows.filter(F.col("notification_type") == notification_type)
    return (
        rows.orderBy(F.desc("created_at"), F.desc("notification_id"))
        .limit(limit)
        .withColumn("badge", X.badge_label(F.col("notification_type")))
        .withColumn("age", X.age_text(F.col("created_at"), X.moment(as_of)))
    )


def notification_counts(feed: DataFrame) -> DataFrame:
    """Unread and per-type counts inside a feed (not the whole table)."""
    kind = F.col("notification_type")
    return feed.agg(
        F.count_if(~F.col("is_read")).alias("unread"),
        F.count_if(kind == K.APPROVAL_NEEDED).alias("approvals_needed"),
        F.count_if(kind == K.INFO).alias("infos"),
        F.count_if(kind == K.APPROVED).alias("approved"),
        F.count_if(kind == K.WARNING).alias("warnings"),
    )


def mark_read(notifications: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """All notifications read, or only those whose ``notification_id`` is in ``ids``."""
    if ids is None:
        return notifications.withColumn("is_read", F.lit(True))
    chosen = ids.select("notification_id").distinct().withColumn("_chosen", F.lit(True))
    return (
        notifications.join(chosen, "notification_id", "left")
        .withColumn("is_read", F.col("is_read") | F.coalesce(F.col("_chosen"), F.lit(False)))
        .select(*notifications.columns)
    )
