"""Fixes for open anomalies: generation, routing by severity, approval and dismissal.

Every step maps whole tables to whole tables; what was a row cursor becomes columns that depend on the row.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meterwise.functions import constants as K
from meterwise.functions import expressions as X
from meterwise.functions import wording as T
from meterwise.operators.detection import Moment
from meterwise.operators.identity import assign_ids_along, highest, shift_ids
from meterwise.schemas import AUDIT_LOG, conform


class State(NamedTuple):
    anomalies: DataFrame
    audit_log: DataFrame


def _is_open() -> Column:
    return F.col("status").eqNullSafe(K.OPEN)


def _is_pending() -> Column:
    return F.col("status").eqNullSafe(K.PENDING_APPROVAL)


def _auto_fixable() -> Column:
    return F.coalesce(F.col("severity").isin(*K.AUTO_FIX_SEVERITIES), F.lit(False))


def _by_type(idle: Column, spike: Column, other: Column) -> Column:
    kind = F.col("anomaly_type")
    return F.when(kind == K.IDLE_COMPUTE, idle).when(kind == K.COST_SPIKE, spike).otherwise(other)


def generate_fixes(anomalies: DataFrame, *keep: Column) -> DataFrame:
    """One fix per open anomaly: statement, details and whether it is applied or waits for approval.

    ``keep`` are further columns to carry along from the anomaly.
    """
    warehouse, credits = F.col("warehouse_name"), F.col("credits_wasted")
    return anomalies.filter(_is_open()).select(
        "anomaly_id",
        "warehouse_name",
        "anomaly_type",
        "severity",
        "credits_wasted",
        _by_type(
            T.fill(T.IDLE_FIX, warehouse=warehouse),
            T.fill(T.SPIKE_FIX, warehouse=warehouse),
            T.fill(T.NO_FIX, kind=F.col("anomaly_type")),
        ).alias("sql_executed"),
        _by_type(
            T.fill(T.IDLE_FIX_DETAILS, warehouse=warehouse, credits=X.decimal_text(credits, 4)),
            T.fill(T.SPIKE_FIX_DETAILS, warehouse=warehouse, credits=X.decimal_text(credits, 2)),
            F.lit(T.NO_FIX_DETAILS),
        ).alias("action_details"),
        F.when(_auto_fixable(), K.COMPLETED).otherwise(K.PENDING_APPROVAL).alias("fix_status"),
        *keep,
    )


def fix_anomalies(anomalies: DataFrame, at: Moment) -> DataFrame:
    """The anomalies after the fixes: low and medium ones resolved, the others acknowledged; only open ones change."""
    solved = _is_open() & _auto_fixable()
    return anomalies.withColumns(
        {
            "status": F.when(solved, K.RESOLVED).when(_is_open(), K.ACKNOWLEDGED).otherwise(F.col("status")),
            "resolved_at": F.when(solved, X.moment(at)).otherwise(F.col("resolved_at")),
            "resolved_by": F.when(solved, K.AUTO_FIX_RESOLVER).otherwise(F.col("resolved_by")),
        }
    )


def fix_audit(anomalies: DataFrame, at: Moment, after: Column | int = 0) -> DataFrame:
    """The audit rows of the fixes: a projection, numbered in step with the anomaly ids.

    ``at`` may be a column of ``anomalies``.
    """
    applied = F.col("fix_status") == K.COMPLETED
    rows = generate_fixes(anomalies, X.moment(at).alias("logged_at")).select(
        "logged_at",
        F.when(applied, K.AUTO_ACTION).otherwise(K.RECOMMENDATION).alias("action_type"),
        "anomaly_id",
        "warehouse_name",
        "action_details",
        "sql_executed",
        F.when(applied, K.AUTO_FIX_ACTOR).alias("approved_by"),
        F.col("fix_status").alias("status"),
    )
    return conform(shift_ids(rows, "log_id", "anomaly_id", after), AUDIT_LOG)


def fix_summary(anomalies: DataFrame) -> DataFrame:
    """How many open anomalies are fixed at once and how many wait, with the run's message."""
    counts = anomalies.filter(_is_open()).agg(
        F.count_if(_auto_fixable()).alias("auto_applied"),
        F.count_if(~_auto_fixable()).alias("pending_approval"),
    )
    message = T.fill(T.FIX_SUMMARY, applied=F.col("auto_applied"), pending=F.col("pending_approval"))
    return counts.withColumn("message", message)


def apply_fixes(state: State, at: Moment) -> State:
    """Fix every open anomaly and log each fix behind the log's last row."""
    new_rows = fix_audit(state.anomalies, at, highest(state.audit_log, "log_id"))
    return State(fix_anomalies(state.anomalies, at), state.audit_log.unionByName(new_rows))


# --- human decisions ----------------------------------------------------------------------------------------------


def accepted_requests(audit_log: DataFrame, approvals: DataFrame) -> DataFrame:
    """The requests that meet a pending row; of several for one anomaly the first counts, as the rest find none.

    A request that names nobody is no decision.
    """
    first = approvals.filter(F.col("approved_by").isNotNull()).groupBy("anomaly_id").agg(
        F.min_by("approved_by", F.struct("requested_at", "approved_by")).alias("approver")
    )
    return first.join(audit_log.filter(_is_pending()).select("anomaly_id"), "anomaly_id", "left_semi")


def _close_pending(audit_log: DataFrame, decided: DataFrame) -> DataFrame:
    """Mark the pending rows of decided anomalies completed. Only pending rows are joined; the rest pass through."""
    actor = F.coalesce(F.col("approver"), F.col("approved_by"))
    closed = (
        audit_log.filter(_is_pending())
        .join(decided, "anomaly_id", "left")
        .withColumns(
            {
                "status": F.when(F.col("approver").isNotNull(), K.COMPLETED).otherwise(F.col("status")),
                "approved_by": actor,
            }
        )
    )
    return audit_log.filter(~_is_pending()).unionByName(closed.select(*audit_log.columns))


def approve_fixes(state: State, approvals: DataFrame, at: Moment) -> State:
    """Carry out a set of approvals (anomaly_id, approved_by, requested_at).

    Requests without a pending row change nothing. The added audit rows name no warehouse: reports take it from the
    anomaly.
    """
    return carry_out(state, accepted_requests(state.audit_log, approvals), at, highest(state.audit_log, "log_id"))


def carry_out(state: State, accepted: DataFrame, at: Moment, after: Column) -> State:
    """Resolves the accepted anomalies (anomaly_id, approver), closes their pending rows and logs the approvals behind the log id
    ``after``. ``state`` may be a part of the tables that has all rows of these anomalies."""
    hit = F.col("approver").isNotNull()
    anomalies = (
        state.anomalies.join(accepted, "anomaly_id", "left")
        .withColumns(
            {
                "status": F.when(hit, K.RESOLVED).otherwise(F.col("status")),
                "resolved_at": F.when(hit, X.moment(at)).otherwise(F.col("resolved_at")),
                "resolved_by": F.coalesce(F.col("approver"), F.col("resolved_by")),
            }
        )
        .select(*state.anomalies.columns)
    )
    words = {"anomaly": F.col("anomaly_id"), "approver": F.col("approver")}
    actions = accepted.select(
        X.moment(at).alias("logged_at"),
        F.lit(K.USER_ACTION).alias("action_type"),
        "anomaly_id",
        T.fill(T.APPROVAL_DETAILS, **words).alias("action_details"),
        F.col("approver").alias("approved_by"),
        F.lit(K.COMPLETED).alias("status"),
    )
    actions = assign_ids_along(actions, "log_id", "anomaly_id", after)
    log = _close_pending(state.audit_log, accepted).unionByName(conform(actions, AUDIT_LOG))
    return State(anomalies, log)


def approval_results(audit_log: DataFrame, approvals: DataFrame) -> DataFrame:
    """The answer to each approval request, in terms of the log before any of them is carried out."""
    named = F.col("approved_by").isNotNull()
    turn = F.row_number().over(W.partitionBy("anomaly_id").orderBy(F.desc(named), "requested_at", "approved_by"))
    pending = audit_log.filter(_is_pending()).select("anomaly_id").distinct().withColumn("_pending", F.lit(True))
    numbered = approvals.withColumn("_turn", turn).join(pending, "anomaly_id", "left")
    granted = named & F.coalesce(F.col("_pending"), F.lit(False)) & (F.col("_turn") == 1)
    words = {"anomaly": F.col("anomaly_id"), "approver": F.col("approved_by")}
    return numbered.select(
        "anomaly_id",
        "approved_by",
        "requested_at",
        granted.alias("granted"),
        F.when(granted, T.fill(T.APPROVAL_RESULT, **words))
        .when(~named, T.fill(T.APPROVAL_NAMELESS, **words))
        .otherwise(T.fill(T.APPROVAL_MISSING, **words))
        .alias("message"),
    )


def dismiss_fixes(state: State, dismissals: DataFrame) -> State:
    """Dismiss anomalies (anomaly_id, dismissed_by, requested_at) and close their pending rows; nothing is logged."""
    return dismiss_decided(state, decided_dismissals(dismissals))


def decided_dismissals(dismissals: DataFrame) -> DataFrame:
    """Who dismissed each anomaly first; a request that names nobody is no decision."""
    return dismissals.filter(F.col("dismissed_by").isNotNull()).groupBy("anomaly_id").agg(
        F.min_by("dismissed_by", F.struct("requested_at", "dismissed_by")).alias("approver")
    )


def dismiss_decided(state: State, decided: DataFrame) -> State:
    """``state`` may be a part of the tables that has all rows of the decided anomalies (anomaly_id, approver)."""
    anomalies = (
        state.anomalies.join(decided, "anomaly_id", "left")
        .withColumn("status", F.when(F.col("approver").isNotNull(), K.DISMISSED).otherwise(F.col("status")))
        .select(*state.anomalies.columns)
    )
    return State(anomalies, _close_pending(state.audit_log, decided))
