"""Named queries over the given tables, one or more per operator.

Tables the queries need but that are not given (metering, inventory, query history, rules) are derived from them, see
``meterwise.sources.derived``. The state after the full detection and remediation job is written once per session and
table folder, as an hourly installation would find it, and the reports read it from there.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterwise.functions import constants as K
from meterwise.functions import expressions as X
from meterwise.operators import (
    alerts,
    assistant,
    attribution,
    audit,
    baseline,
    compliance,
    detection,
    notifications,
    operations,
    remediation,
    summary,
)
from meterwise.operators.remediation import State
from meterwise.plans import daily, jobs
from meterwise.schemas import AUDIT_LOG, conform
from meterwise.session import shared_folder
from meterwise.sources import derived
from meterwise.sources.derived import AS_OF
from meterwise.sources.history import read_query_history, write_query_history
from meterwise.sources.marks import read_mark, write_mark
from meterwise.sources.metering import live_scan, read_metering, write_metering
from meterwise.sources.snapshots import committed_versions, read_version, write_version
from meterwise.streaming.hourly import HourlyMonitor, metering_stream

Query = Callable[[SparkSession, str], DataFrame]

FIRST_RUN_END = "2024-01-16 00:00:00"
MID_MONTH = dt.datetime(2024, 1, 17, 12)
SLICE_ENDS = ("2024-01-11 00:00:00", "2024-01-21 00:00:00", None)

_QUERIES: dict[str, Query] = {}
_roots: dict[tuple[str, ...], str] = {}


def present(df: DataFrame) -> DataFrame:
    """Values another engine can be compared on: decimals as doubles of nine digits, times as text."""

    def shown(field: T.StructField):
        column = F.col(field.name)
        if isinstance(field.dataType, T.DecimalType):
            column = F.round(column, 9).cast("double")
        elif isinstance(field.dataType, T.TimestampType):
            column = F.date_format(column, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(field.dataType, T.DateType):
            column = F.date_format(column, "yyyy-MM-dd")
        elif isinstance(field.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            column = column.cast("bigint")
        return column.alias(field.name)

    return df.select(*[shown(field) for field in df.schema.fields])


def query(function: Query) -> Query:
    """Register a query under its function's name."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return present(function(spark, sf_dir))

    run.__name__ = function.__name__
    _QUERIES[function.__name__] = run
    return function


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


# --- state shared by the reports ------------------------------------------------------------------------------


def _root(spark: SparkSession, sf_dir: str) -> str:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _roots:
        root = f"{shared_folder(spark)}/meterwise/{uuid.uuid4().hex}"
        jobs.rebuild_state(
            derived.metering(spark, sf_dir),
            root,
            1,
            as_of=AS_OF,
            detected_at=F.col("end_time"),
            applied_at=F.col("detected_at"),
        )
        _roots[key] = root
    return _roots[key]


def _detected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_version(spark, _root(spark, sf_dir), "detected", 1)


def _fixed(spark: SparkSession, sf_dir: str) -> State:
    root = _root(spark, sf_dir)
    return State(read_version(spark, root, "anomalies", 1), read_version(spark, root, "audit_log", 1))


def _approval(spark: SparkSession, sf_dir: str) -> State:
    """The fixed state with its approvals carried out, as a plan."""
    state = _fixed(spark, sf_dir)
    return remediation.approve_fixes(state, derived.approvals(_pending(state)), AS_OF)


def _approved(spark: SparkSession, sf_dir: str) -> State:
    """The same, written as the next version of the tables."""
    root = _root(spark, sf_dir)
    if jobs.state_version(spark, root) == 1:
        return jobs.save_state(_approval(spark, sf_dir), root)
    return jobs.load_state(spark, root)


def _pending(state: State) -> DataFrame:
    return state.audit_log.filter(F.col("status") == K.PENDING_APPROVAL)


def _generated(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = _approved(spark, sf_dir)
    return notifications.generate_notifications(state.audit_log, state.anomalies)


def _notifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The written notifications, a third of them read."""
    root = _root(spark, sf_dir)
    if 2 not in committed_versions(spark, root, "notifications"):
        rows = _generated(spark, sf_dir).withColumn("is_read", F.col("notification_id") % 3 == 0)
        write_version(rows, root, "notifications", 2)
    return read_version(spark, root, "notifications", 2)


def _activated(spark: SparkSession, sf_dir: str) -> DataFrame:
    parsed = alerts.parse_alert_responses(derived.alert_responses(spark, sf_dir))
    return alerts.activate_alerts(parsed.withColumnRenamed("alert_id", "rule_id"), AS_OF, "rule_id")


def _alert_root(spark: SparkSession, sf_dir: str) -> str:
    """The folder of the rule tables, which need no other state."""
    return _roots.setdefault((spark.sparkContext.applicationId, sf_dir, "alerts"), f"{shared_folder(spark)}/meterwise/{uuid.uuid4().hex}")


def _alert_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = _alert_root(spark, sf_dir)
    if not committed_versions(spark, root, "smart_alerts"):
        write_version(_activated(spark, sf_dir), root, "smart_alerts", 1)
    return read_version(spark, root, "smart_alerts", 1)


def _alert_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alerts.alert_metrics(derived.metering(spark, sf_dir), derived.query_history(spark, sf_dir))


def _written_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, written for queries that evaluate several times."""
    root = _alert_root(spark, sf_dir)
    if not committed_versions(spark, root, "metrics"):
        write_version(_alert_metrics(spark, sf_dir), root, "metrics", 1)
    return read_version(spark, root, "metrics", 1)


# --- scans and detection --------------------------------------------------------------------------------------


@query
def metering_scan(spark, sf_dir):
    return live_scan(derived.metering(spark, sf_dir), AS_OF)


@query
def detect_idle_lookback(spark, sf_dir):
    return detection.detect_idle(derived.metering(spark, sf_dir), as_of=AS_OF)


@query
def metering_scan_mid_month(spark, sf_dir):
    return live_scan(derived.metering(spark, sf_dir), MID_MONTH)


@query
def detect_idle_mid_month(spark, sf_dir):
    return detection.detect_idle(derived.metering(spark, sf_dir), as_of=MID_MONTH)


@query
def recent_anomaly_counts_mid_month(spark, sf_dir):
    return summary.recent_anomaly_counts(_fixed(spark, sf_dir).anomalies, MID_MONTH)


@query
def cost_attribution_mid_month(spark, sf_dir):
    return attribution.cost_attribution(derived.query_history(spark, sf_dir), MID_MONTH)


@query
def week_over_week_mid_month(spark, sf_dir):
    return attribution.week_over_week(derived.metering(spark, sf_dir), MID_MONTH)


@query
def detect_idle(spark, sf_dir):
    return detection.detect_idle(derived.metering(spark, sf_dir), as_of=AS_OF, lookback_hours=None, exclude=())


@query
def rolling_baseline(spark, sf_dir):
    rows = baseline.rolling_baseline(derived.metering(spark, sf_dir))
    average = X.baseline_average(F.col(baseline.SUM), F.col(baseline.COUNT))
    return rows.select(
        "warehouse_name",
        "start_time",
        "credits_used",
        baseline.SUM,
        baseline.COUNT,
        baseline.ROWS,
        average.alias("rolling_average"),
    )


@query
def detect_cost_spike(spark, sf_dir):
    return detection.detect_cost_spike(derived.metering(spark, sf_dir), as_of=AS_OF)


@query
def detect_cost_spike_lookback(spark, sf_dir):
    return detection.detect_cost_spike(derived.metering(spark, sf_dir), as_of=AS_OF, lookback_hours=24)


def _by_severity(found: DataFrame) -> DataFrame:
    return found.groupBy("warehouse_name", "severity").agg(
        F.count(F.lit(1)).alias("anomaly_count"), F.sum("credits_wasted").alias("credits")
    )


@query
def idle_severity(spark, sf_dir):
    return _by_severity(
        detection.detect_idle(derived.metering(spark, sf_dir), as_of=AS_OF, lookback_hours=None, exclude=())
    )


@query
def spike_severity(spark, sf_dir):
    return _by_severity(detection.detect_cost_spike(derived.metering(spark, sf_dir), as_of=AS_OF))


@query
def anomaly_text(spark, sf_dir):
    idle, spikes = jobs.detect_all(derived.metering(spark, sf_dir), detected_at=AS_OF)
    return idle.unionByName(spikes).select(
        "warehouse_name", "anomaly_start", "anomaly_type", "description", "suggested_fix"
    )


@query
def detect_incremental(spark, sf_dir):
    """A second run over the whole table, after a first one that ended in the middle of the month."""
    rows = derived.metering(spark, sf_dir)
    first = _detected(spark, sf_dir).filter(F.col("anomaly_start") < F.lit(FIRST_RUN_END).cast("timestamp"))
    idle, spikes = jobs.detect_all(rows, first, detected_at=AS_OF)
    return idle.unionByName(spikes).select("warehouse_name", "anomaly_start", "anomaly_type", "severity")


@query
def scan_audit(spark, sf_dir):
    rows = derived.metering(spark, sf_dir)
    idle = detection.detect_idle(rows, as_of=AS_OF)
    full = detection.detect_idle(rows, as_of=AS_OF, lookback_hours=None, exclude=())
    spikes = detection.detect_cost_spike(rows, as_of=AS_OF)
    return (
        detection.scan_audit(idle, "idle", at=AS_OF, parameter=K.LOOKBACK_HOURS, log_id=1)
        .unionByName(detection.scan_audit(full, "idle_full", at=AS_OF, log_id=2))
        .unionByName(detection.scan_audit(spikes, "spike", at=AS_OF, parameter=K.SPIKE_THRESHOLD, log_id=3))
        .select("log_id", "logged_at", "action_type", "action_details", "status")
    )


@query
def anomaly_ids(spark, sf_dir):
    idle, spikes = jobs.detect_all(derived.metering(spark, sf_dir), detected_at=AS_OF)
    return jobs.number_anomalies(idle.unionByName(spikes)).select(
        "anomaly_id", "warehouse_name", "anomaly_start", "anomaly_type"
    )


@query
def full_rebuild(spark, sf_dir):
    return jobs.detect_and_fix(
        derived.metering(spark, sf_dir),
        as_of=AS_OF,
        detected_at=F.col("end_time"),
        applied_at=F.col("detected_at"),
    ).anomalies


@query
def rebuild_after_cycles(spark, sf_dir):
    """A rebuild of a state that an earlier rebuild and two cycles have left: nothing of them remains."""
    rows = derived.metering(spark, sf_dir)
    root = f"{_root(spark, sf_dir)}/cycles"
    if not committed_versions(spark, root, "anomalies"):
        jobs.rebuild_state(rows.filter(F.col("start_time") < F.lit(FIRST_RUN_END).cast("timestamp")), root, as_of=FIRST_RUN_END)
        for at in (MID_MONTH, AS_OF):
            jobs.run_cycle(rows, root, as_of=at)
    return jobs.rebuild_state(
        rows, root, as_of=AS_OF, detected_at=F.col("end_time"), applied_at=F.col("detected_at")
    ).anomalies


@query
def live_cycle(spark, sf_dir):
    """One incremental cycle over the last day, on top of the state that the days before had left."""
    state = _fixed(spark, sf_dir)
    yesterday = X.moment(AS_OF) - F.expr("interval 24 hours")
    before = State(
        state.anomalies.filter(F.col("anomaly_start") < yesterday),
        state.audit_log.filter(F.col("logged_at") <= yesterday),
    )
    root = f"{shared_folder(spark)}/meterwise/{uuid.uuid4().hex}"
    # As in jobs.run_cycle the scan's result is written and read by each later step.
    metering = write_version(derived.metering(spark, sf_dir), root, "metering", 1, ("start_time", "warehouse_name"))
    new = write_version(jobs.find_new(metering, before, as_of=AS_OF), root, "detected", 1)
    return jobs.absorb(before, new, as_of=AS_OF).anomalies.select(
        "anomaly_id", "warehouse_name", "anomaly_start", "anomaly_type", "severity", "status", "resolved_at"
    )


@query
def live_cycle_days(spark, sf_dir):
    """The same cycle on a state that is filed by day: only the days of the scan are read, only those it adds to are written."""
    root = f"{shared_folder(spark)}/meterwise/{uuid.uuid4().hex}"
    state = _fixed(spark, sf_dir)
    yesterday = X.moment(AS_OF) - F.expr("interval 24 hours")
    before = State(
        state.anomalies.filter(F.col("anomaly_start") < yesterday), state.audit_log.filter(F.col("logged_at") <= yesterday)
    )
    daily.begin(before, root)
    write_metering(derived.metering(spark, sf_dir), f"{root}/metering")
    return daily.run_cycle(read_metering(spark, f"{root}/metering"), root, as_of=AS_OF).anomalies.select(
        "anomaly_id", "warehouse_name", "anomaly_start", "anomaly_type", "severity", "status", "resolved_at"
    )


def _hourly_root(spark: SparkSession, sf_dir: str) -> str:
    """A state filed by day over which the whole chain ran once more: it begins a day before the end and has been notified of."""
    key = (spark.sparkContext.applicationId, sf_dir, "hourly")
    if key not in _roots:
        root = f"{shared_folder(spark)}/meterwise/{uuid.uuid4().hex}"
        state = _fixed(spark, sf_dir)
        yesterday = X.moment(AS_OF) - F.expr("interval 24 hours")
        before = State(state.anomalies.filter(F.col("anomaly_start") < yesterday), state.audit_log.filter(F.col("logged_at") <= yesterday))
        daily.begin(before, root)
        daily.notify(spark, root)
        write_metering(derived.metering(spark, sf_dir), f"{root}/metering")
        daily.run_hour(read_metering(spark, f"{root}/metering"), root, as_of=AS_OF)
        _roots[key] = root
    return _roots[key]


@query
def cycle_notifications(spark, sf_dir):
    """The notifications that the chain's last cycle added."""
    rows = daily.notifications(spark, _hourly_root(spark, sf_dir), [AS_OF.date()])
    return rows.filter(F.col("created_at") == X.moment(AS_OF))


def _approved_root(spark: SparkSession, sf_dir: str) -> str:
    """The approved state filed by day, with its notifications."""
    key = (spark.sparkContext.applicationId, sf_dir, "approved")
    if key not in _roots:
        root = f"{shared_folder(spark)}/meterwise/{uuid.uuid4().hex}"
        daily.begin(_approved(spark, sf_dir), root)
        daily.notify(spark, root)
        _roots[key] = root
    return _roots[key]


@query
def audit_log_newest_days(spark, sf_dir):
    return daily.audit_page(spark, _approved_root(spark, sf_dir), status=K.COMPLETED, action_type=K.AUTO_ACTION).drop("error_message")


@query
def auto_fix_history_days(spark, sf_dir):
    return daily.fix_history(spark, _approved_root(spark, sf_dir))


@query
def recently_approved_days(spark, sf_dir):
    return daily.approvals_page(spark, _approved_root(spark, sf_dir))


@query
def notification_feed_days(spark, sf_dir):
    return daily.feed(spark, _approved_root(spark, sf_dir), AS_OF)


@query
def savings_snapshot_day(spark, sf_dir):
    """Savings by day, kept up by the jobs on a state: its beginning, a cycle, approvals and dismissals."""
    root = _days_state(spark, sf_dir)
    pending = _pending(_fixed(spark, sf_dir))
    daily.approve(spark, root, derived.approvals(pending), AS_OF)
    daily.dismiss(spark, root, derived.dismissals(pending))
    return daily.savings_history(spark, root)


# --- remediation ----------------------------------------------------------------------------------------------


def _days_state(spark: SparkSession, sf_dir: str) -> str:
    """The fixed state, filed by day in a folder of its own."""
    root = f"{shared_folder(spark)}/meterwise/{uuid.uuid4().hex}"
    daily.begin(_fixed(spark, sf_dir), root)
    return root


@query
def approve_fix_days(spark, sf_dir):
    state = _fixed(spark, sf_dir)
    rows = daily.approve(spark, _days_state(spark, sf_dir), derived.approvals(_pending(state)), AS_OF).anomalies
    return rows.select("anomaly_id", "warehouse_name", "severity", "status", "resolved_at", "resolved_by")


@query
def approve_fix_days_audit(spark, sf_dir):
    state = _fixed(spark, sf_dir)
    return conform(daily.approve(spark, _days_state(spark, sf_dir), derived.approvals(_pending(state)), AS_OF).audit_log, AUDIT_LOG).drop("error_message")


@query
def dismiss_fix_days(spark, sf_dir):
    state = _fixed(spark, sf_dir)
    rows = daily.dismiss(spark, _days_state(spark, sf_dir), derived.dismissals(_pending(state))).anomalies
    return rows.select("anomaly_id", "warehouse_name", "severity", "status", "resolved_at", "resolved_by")


@query
def generate_fixes(spark, sf_dir):
    return remediation.generate_fixes(_detected(spark, sf_dir))


@query
def apply_fixes_anomalies(spark, sf_dir):
    found = remediation.fix_anomalies(_detected(spark, sf_dir), F.col("detected_at"))
    return found.select("anomaly_id", "warehouse_name", "severity", "status", "resolved_at", "resolved_by")


@query
def apply_fixes_audit(spark, sf_dir):
    return remediation.fix_audit(_detected(spark, sf_dir), F.col("detected_at"), after=2).drop("error_message")


@query
def apply_fixes_summary(spark, sf_dir):
    return remediation.fix_summary(_detected(spark, sf_dir))


@query
def approve_fix_anomalies(spark, sf_dir):
    rows = _approval(spark, sf_dir).anomalies
    return rows.select("anomaly_id", "warehouse_name", "severity", "status", "resolved_at", "resolved_by")


@query
def approve_fix_audit(spark, sf_dir):
    return _approval(spark, sf_dir).audit_log.drop("error_message")


@query
def approve_fix_results(spark, sf_dir):
    """Answers to requests of which many wait for nothing, some repeat, name nobody or mean no anomaly."""
    state = _fixed(spark, sf_dir)
    return remediation.approval_results(state.audit_log, derived.approval_requests(state.anomalies))


@query
def dismiss_fix_anomalies(spark, sf_dir):
    state = _fixed(spark, sf_dir)
    rows = remediation.dismiss_fixes(state, derived.dismissals(_pending(state))).anomalies
    return rows.select("anomaly_id", "warehouse_name", "severity", "status", "resolved_at", "resolved_by")


@query
def dismiss_fix_audit(spark, sf_dir):
    state = _fixed(spark, sf_dir)
    rows = remediation.dismiss_fixes(state, derived.dismissals(_pending(state))).audit_log
    return rows.select("log_id", "action_type", "anomaly_id", "approved_by", "status")


# --- executive summary ----------------------------------------------------------------------------------------


@query
def kpi_summary(spark, sf_dir):
    return summary.kpi_summary(_fixed(spark, sf_dir).anomalies)


@query
def environment_impact(spark, sf_dir):
    return summary.environment_impact(_fixed(spark, sf_dir).anomalies)


@query
def snapshot_savings(spark, sf_dir):
    return summary.snapshot_savings(_fixed(spark, sf_dir).anomalies)


@query
def savings_trend(spark, sf_dir):
    return summary.savings_trend(summary.snapshot_savings(_fixed(spark, sf_dir).anomalies))


@query
def savings_trend_days(spark, sf_dir):
    return summary.savings_trend(summary.snapshot_savings(_fixed(spark, sf_dir).anomalies), AS_OF, days=7)


@query
def anomalies_by_warehouse(spark, sf_dir):
    return summary.anomalies_by_warehouse(_fixed(spark, sf_dir).anomalies)


@query
def recent_anomaly_counts(spark, sf_dir):
    return summary.recent_anomaly_counts(_fixed(spark, sf_dir).anomalies, AS_OF)


@query
def health_scores(spark, sf_dir):
    return summary.health_scores(derived.warehouses(spark, sf_dir), _fixed(spark, sf_dir).anomalies, AS_OF)


@query
def quick_stats(spark, sf_dir):
    return summary.quick_stats(
        _notifications(spark, sf_dir), _approved(spark, sf_dir).anomalies, derived.warehouses(spark, sf_dir)
    )


# --- operations and approvals ---------------------------------------------------------------------------------


@query
def warehouse_status(spark, sf_dir):
    return operations.warehouse_status(derived.warehouses(spark, sf_dir))


@query
def auto_fix_history(spark, sf_dir):
    state = _fixed(spark, sf_dir)
    return operations.auto_fix_history(state.audit_log, state.anomalies)


@query
def pending_approvals(spark, sf_dir):
    state = _fixed(spark, sf_dir)
    return operations.pending_approvals(state.anomalies, state.audit_log)


@query
def approval_kpis(spark, sf_dir):
    state = _fixed(spark, sf_dir)
    return operations.approval_kpis(operations.waiting_fixes(state.anomalies, state.audit_log))


@query
def recently_approved(spark, sf_dir):
    state = _approved(spark, sf_dir)
    return operations.recently_approved(state.audit_log, state.anomalies)


def _history_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query history as an installation keeps it, a directory per day."""
    path = f"{_root(spark, sf_dir)}/query_history"
    if read_mark(spark, f"{path}.json") is None:
        write_query_history(derived.query_history(spark, sf_dir), path, "overwrite")
        write_mark(spark, f"{path}.json", {"complete": True})
    return read_query_history(spark, path)


@query
def spike_query_drilldown(spark, sf_dir):
    return operations.spike_queries(_fixed(spark, sf_dir).anomalies, _history_by_day(spark, sf_dir))


@query
def spike_query_top(spark, sf_dir):
    rows = operations.top_spike_queries(_fixed(spark, sf_dir).anomalies, _history_by_day(spark, sf_dir))
    return rows.select("anomaly_id", "cost_rank", "query_id", "user_name", "credits_used_cloud_services")


# --- alerts ---------------------------------------------------------------------------------------------------


@query
def alert_prompts(spark, sf_dir):
    rules = derived.alert_rules(spark, sf_dir).select("alert_id", "rule")
    return alerts.alert_prompts(rules)


@query
def alert_parse(spark, sf_dir):
    return alerts.parse_alert_responses(derived.alert_responses(spark, sf_dir)).drop("rule", "response")


@query
def alert_activate(spark, sf_dir):
    return _activated(spark, sf_dir)


def _switched_off(rules: DataFrame) -> DataFrame:
    """The rules that ask for an exact value are the ones to go."""
    return rules.filter(F.col("parsed_condition") == "equals").select("alert_id")


@query
def alert_deactivate(spark, sf_dir):
    rules = _alert_table(spark, sf_dir)
    return alerts.deactivate_alerts(rules, _switched_off(rules)).select("alert_id", "parsed_condition", "is_active")


@query
def alert_metrics(spark, sf_dir):
    return _alert_metrics(spark, sf_dir)


@query
def alert_triggers(spark, sf_dir):
    return alerts.alert_triggers(_alert_metrics(spark, sf_dir), _alert_table(spark, sf_dir), AS_OF, present)


def _evaluated(spark: SparkSession, sf_dir: str, *moments: dt.datetime) -> DataFrame:
    """The rule table after evaluations of what was known at these times, as scheduled runs have written it."""
    rules = _alert_table(spark, sf_dir)
    root = f"{_alert_root(spark, sf_dir)}/evaluated"
    for as_of in moments:
        root = f"{root}/{as_of:%Y%m%d%H}"
        if not committed_versions(spark, root, "smart_alerts"):
            write_version(alerts.evaluate_alerts(_written_metrics(spark, sf_dir), rules, as_of), root, "smart_alerts", 1)
        rules = read_version(spark, root, "smart_alerts", 1)
    return rules


@query
def alert_triggers_new(spark, sf_dir):
    """What an evaluation finds after one in the middle of the month."""
    rules = _evaluated(spark, sf_dir, MID_MONTH)
    return alerts.alert_triggers(_written_metrics(spark, sf_dir), rules, AS_OF, present)


@query
def alert_history(spark, sf_dir):
    """What fired in an evaluation in the middle of the month, in one at its end, and in that one once more."""
    root = f"{shared_folder(spark)}/meterwise/{uuid.uuid4().hex}"
    metrics, rules = _written_metrics(spark, sf_dir), _alert_table(spark, sf_dir)
    for as_of in (MID_MONTH, AS_OF, AS_OF):
        rules = write_version(alerts.evaluate_and_record(metrics, rules, as_of, root), root, "rules", 1 + len(committed_versions(spark, root, "rules")))
    return alerts.alert_history(spark, root, present)


@query
def evaluate_alerts(spark, sf_dir):
    rules = alerts.evaluate_alerts(_alert_metrics(spark, sf_dir), _alert_table(spark, sf_dir), AS_OF)
    return rules.select("alert_id", "parsed_metric", "parsed_warehouse", "trigger_count", "evaluated_until")


@query
def evaluate_alerts_again(spark, sf_dir):
    """In the middle of the month, at its end, and at its end once more: the same counts as one run at the end."""
    rules = alerts.evaluate_alerts(_written_metrics(spark, sf_dir), _evaluated(spark, sf_dir, MID_MONTH, AS_OF), AS_OF)
    return rules.select("alert_id", "parsed_metric", "parsed_warehouse", "trigger_count", "evaluated_until")


@query
def active_alerts(spark, sf_dir):
    rules = alerts.evaluate_alerts(_alert_metrics(spark, sf_dir), _alert_table(spark, sf_dir), AS_OF)
    shown = alerts.active_alerts(alerts.deactivate_alerts(rules, _switched_off(rules)))
    return shown.select("alert_id", "natural_language_rule", "condition_symbol", "badge")


@query
def high_severity_outbox(spark, sf_dir):
    return alerts.high_severity_outbox(_fixed(spark, sf_dir).anomalies)


@query
def outbox_second_cycle(spark, sf_dir):
    """What a second run sends, after a first one that knew the first half of the month, and a third over the same state."""
    root = f"{shared_folder(spark)}/meterwise/{uuid.uuid4().hex}"
    rows = _fixed(spark, sf_dir).anomalies
    alerts.send_outbox(rows.filter(F.col("anomaly_start") < F.lit(FIRST_RUN_END).cast("timestamp")), root)
    second = alerts.send_outbox(rows, root)
    return second.unionByName(alerts.send_outbox(rows, root))


# --- intelligence ---------------------------------------------------------------------------------------------


@query
def ask_context(spark, sf_dir):
    return assistant.question_context(_fixed(spark, sf_dir).anomalies)


@query
def ask_prompts(spark, sf_dir):
    """A question about every warehouse of the inventory."""
    asked = derived.warehouses(spark, sf_dir).select(
        F.concat(F.lit("What drives the cost of "), F.col("name"), F.lit("?")).alias("question")
    )
    return assistant.question_prompts(asked, _fixed(spark, sf_dir).anomalies)


@query
def cost_attribution(spark, sf_dir):
    return attribution.cost_attribution(derived.query_history(spark, sf_dir), AS_OF)


@query
def week_over_week(spark, sf_dir):
    return attribution.week_over_week(derived.metering(spark, sf_dir), AS_OF)


# --- compliance -----------------------------------------------------------------------------------------------


@query
def compliance_findings(spark, sf_dir):
    return compliance.compliance_findings(derived.warehouses(spark, sf_dir))


@query
def compliance_score(spark, sf_dir):
    return compliance.compliance_score(derived.warehouses(spark, sf_dir))


# --- notifications and audit ----------------------------------------------------------------------------------


@query
def generate_notifications(spark, sf_dir):
    return _generated(spark, sf_dir)


@query
def notification_feed(spark, sf_dir):
    return notifications.notification_feed(_notifications(spark, sf_dir), AS_OF)


@query
def notification_feed_by_type(spark, sf_dir):
    return notifications.notification_feed(_notifications(spark, sf_dir), AS_OF, K.WARNING)


@query
def notification_counts(spark, sf_dir):
    return notifications.notification_counts(notifications.notification_feed(_notifications(spark, sf_dir), AS_OF))


@query
def notifications_mark_read(spark, sf_dir):
    rows = notifications.mark_read(_notifications(spark, sf_dir))
    return rows.groupBy("notification_type", "is_read").agg(F.count(F.lit(1)).alias("notifications"))


@query
def notification_feed_unread(spark, sf_dir):
    return notifications.notification_feed(_notifications(spark, sf_dir), AS_OF, unread=True)


@query
def notifications_mark_one(spark, sf_dir):
    """The oldest unread notification is marked as read."""
    rows = _notifications(spark, sf_dir)
    oldest = rows.filter(~F.col("is_read")).agg(F.min("notification_id").alias("notification_id"))
    return notifications.mark_read(rows, oldest).select("notification_id", "is_read")


@query
def audit_stats(spark, sf_dir):
    return audit.audit_stats(_approved(spark, sf_dir).audit_log)


@query
def audit_warehouses(spark, sf_dir):
    return audit.audit_warehouses(_approved(spark, sf_dir).audit_log)


@query
def audit_log_filtered(spark, sf_dir):
    return audit.audit_log_filtered(
        _approved(spark, sf_dir).audit_log, status=K.COMPLETED, action_type=K.AUTO_ACTION
    ).drop("error_message")


@query
def audit_log_of_warehouse(spark, sf_dir):
    return audit.audit_log_filtered(_approved(spark, sf_dir).audit_log, warehouse="WH_000000004").drop("error_message")


# --- streaming ------------------------------------------------------------------------------------------------


def _in_order(rows: DataFrame) -> list[DataFrame]:
    """The rows in three slices of time."""
    bounds = [F.lit(end).cast("timestamp") for end in SLICE_ENDS[:-1]]
    at = F.col("start_time")
    return [rows.filter(at < bounds[0]), rows.filter((at >= bounds[0]) & (at < bounds[1])), rows.filter(at >= bounds[1])]


def _out_of_order(rows: DataFrame) -> list[DataFrame]:
    """Two slices of time that lack every fifth hour, and then the rows of these hours."""
    is_held = X.hour_number(F.col("start_time")) % 5 == 2
    first, *rest = _in_order(rows.filter(~is_held))
    return [first, rest[0].unionByName(rest[1]), rows.filter(is_held)]


def _with_repeats(rows: DataFrame) -> list[DataFrame]:
    """Three slices of time; the second also repeats the hours of the first that some warehouses had, the third has other rows
    for hours that had one."""
    parts = _in_order(rows)
    again = parts[0].filter(F.col("warehouse_id") % 3 == 0)
    return [parts[0], parts[1].unionByName(again), parts[2].unionByName(_revised(rows))]


def _revised(rows: DataFrame) -> DataFrame:
    """Idle hours of some warehouses once more, with half a credit more."""
    more = {c: (F.col(c) + F.lit(0.5).cast("decimal(18,9)")).cast("decimal(18,9)") for c in ("credits_used", "credits_used_cloud_services")}
    idle = (F.col("credits_used_compute") == 0) & (F.col("credits_used_cloud_services") > 0)
    return rows.filter(idle & (F.col("warehouse_id") % 5 == 0)).withColumns(more)


def _replay(spark: SparkSession, sf_dir: str, monitor_options: dict, slices=_in_order) -> HourlyMonitor:
    """Append slices of the metering table to a folder and run the monitor after each, as a scheduler would."""
    folder = f"{shared_folder(spark)}/meterwise/{uuid.uuid4().hex}"
    rows = write_version(derived.metering(spark, sf_dir), folder, "source", 1, ("start_time", "warehouse_name"))
    for part in slices(rows):
        part.write.mode("append").parquet(f"{folder}/incoming")
        monitor = HourlyMonitor(
            folder,
            detected_at=F.col("end_time"),
            applied_at=F.col("detected_at"),
            as_of=AS_OF,
            **monitor_options,
        )
        monitor.start(metering_stream(spark, f"{folder}/incoming")).awaitTermination()
    return monitor


_STREAM_COLUMNS = (
    "anomaly_id", "warehouse_name", "anomaly_start", "anomaly_type", "severity", "credits_wasted", "status",
)


@query
def stream_idle(spark, sf_dir):
    monitor = _replay(spark, sf_dir, {"kinds": (K.IDLE_COMPUTE,)})
    return monitor.detected(spark).select(*_STREAM_COLUMNS)


@query
def stream_spike(spark, sf_dir):
    monitor = _replay(spark, sf_dir, {"kinds": (K.COST_SPIKE,)})
    return monitor.detected(spark).select(*_STREAM_COLUMNS)


@query
def stream_fixes(spark, sf_dir):
    monitor = _replay(spark, sf_dir, {"fix": True})
    return monitor.anomalies(spark).select(*_STREAM_COLUMNS, "resolved_at", "resolved_by")


@query
def stream_fixes_audit(spark, sf_dir):
    monitor = _replay(spark, sf_dir, {"fix": True})
    return monitor.audit_log(spark).select("log_id", "logged_at", "action_type", "anomaly_id", "action_details", "status")


_JUDGED_COLUMNS = ("warehouse_name", "anomaly_start", "anomaly_type", "severity", "credits_wasted", "description")


@query
def stream_late(spark, sf_dir):
    """Rows out of order: the anomalies that stand in the end are those of a batch job over all rows."""
    monitor = _replay(spark, sf_dir, {}, _out_of_order)
    return monitor.anomalies(spark).select(*_JUDGED_COLUMNS)


@query
def stream_repeats(spark, sf_dir):
    """Rows that are delivered again count once, rows that differ in a value count each; Spark's state store tells them apart."""
    monitor = _replay(spark, sf_dir, {"kinds": (K.IDLE_COMPUTE,), "repeats_within": "60 days"}, _with_repeats)
    return monitor.anomalies(spark).select(*_JUDGED_COLUMNS)
