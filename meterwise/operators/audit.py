"""Audit-trail reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterwise.functions import constants as K


def audit_stats(audit_log: DataFrame) -> DataFrame:
    return audit_log.agg(
        F.count(F.lit(1)).alias("total_entries"),
        F.count_if(F.col("action_type") == K.AUTO_ACTION).alias("auto_actions"),
        F.count_if(F.col("action_type") == K.USER_ACTION).alias("manual_actions"),
        F.count_if(F.col("status") == K.PENDING_APPROVAL).alias("pending"),
    )


def audit_warehouses(audit_log: DataFrame) -> DataFrame:
    """The warehouses to choose from in the log's filter."""
    return (
        audit_log.filter(F.col("warehouse_name").isNotNull()).select("warehouse_name").distinct().orderBy("warehouse_name")
    )


def audit_log_filtered(
    audit_log: DataFrame,
    warehouse: str | None = None,
    status: str | None = None,
    action_type: str | None = None,
    limit: int = 50,
) -> DataFrame:
    """The newest log rows that match every filter given."""
    chosen = {"warehouse_name": warehouse, "status": status, "action_type": action_type}
    rows = audit_log
    for column, value in chosen.items():
        if value is not None:
            rows = rows.filter(F.col(column) == value)
    return rows.orderBy(F.desc("logged_at"), F.desc("log_id")).limit(limit)
