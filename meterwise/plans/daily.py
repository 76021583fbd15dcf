"""The state in one directory per day: a cycle, an approval or a dismissal rewrites the days it touches and no others.

``anomalies`` are filed by the day they began, ``audit_log`` by the day of the entry. One mark, ``state.json``, holds the last ids
that count. It is replaced when both tables are written, so it commits them together: rows with higher ids belong to a
job that has not ended, readers leave them out and the next job overwrites them. Metering rows before the last scan are not read
again: the three newest of each warehouse are kept in ``carry``.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterwise.functions import constants as K
from meterwise.operators import audit, operations
from meterwise.operators import detection as D
from meterwise.operators.alerts import send_outbox
from meterwise.operators.baseline import latest_rows
from meterwise.operators.notifications import generate_notifications, notification_feed
from meterwise.operators.notifications import mark_read as marked_read
from meterwise.operators.remediation import State, accepted_requests, carry_out, decided_dismissals, dismiss_decided, fix_anomalies, fix_audit
from meterwise.operators.summary import running_savings
from meterwise.plans.jobs import number_anomalies, scan_rows_of
from meterwise.schemas import ANOMALIES, AUDIT_LOG, METERING, NOTIFICATIONS, SAVINGS_HISTORY, checked, conform
from meterwise.sources.days import DAY, day_of, days_in, newest_days, read_days, write_days
from meterwise.sources.marks import read_mark, write_mark
from meterwise.sources.metering import rows_since
from meterwise.sources.snapshots import committed_versions, read_all_versions, read_version, write_version


class Mark(NamedTuple):
    """How far the state has come: number of jobs, last ids, the job that wrote the carried rows and until when they hold, and the
    job that began this state."""

    job: int = 0
    anomaly: int = 0
    log: int = 0
    carried_by: int = 0
    carried_until: str | None = None
    begun: int = 0


def mark(spark: SparkSession, root: str) -> Mark:
    return Mark(**(read_mark(spark, f"{root}/state.json") or {}))


def _commit(spark: SparkSession, root: str, new: Mark) -> None:
    write_mark(spark, f"{root}/state.json", new._asdict())


def load(spark: SparkSession, root: str, anomaly_days=None, log_days=None) -> State:
    """Both tables as of the last job that ended, whole or of some days only; with their day column."""
    now = mark(spark, root)
    anomalies = read_days(spark, f"{root}/anomalies", ANOMALIES, anomaly_days)
    log = read_days(spark, f"{root}/audit_log", AUDIT_LOG, log_days)
    return State(anomalies.filter(F.col("anomaly_id") <= now.anomaly), log.filter(F.col("log_id") <= now.log))


def begin(state: State, root: str) -> None:
    """Files a whole state by day, in place of what was there. A reader between the two writes would see a mix, so the mark is
    taken back first and such a reader sees nothing."""
    spark = state.anomalies.sparkSession
    job = mark(spark, root).job + 1
    _commit(spark, root, Mark(job, begun=job))
    last = []
    for rows, name, schema, time, id in (
        (state.anomalies, "anomalies", ANOMALIES, "anomaly_start", "anomaly_id"), (state.audit_log, "audit_log", AUDIT_LOG, "logged_at", "log_id"),
    ):
        filed = checked(conform(rows, schema), schema).withColumn(DAY, day_of(time))
        filed.hint("rebalance", F.col(DAY)).write.mode("overwrite").partitionBy(DAY).parquet(f"{root}/{name}")
        last.append(read_days(spark, f"{root}/{name}", schema).agg(F.max(id)).first()[0] or 0)
    _savings_changed(read_days(spark, f"{root}/anomalies", ANOMALIES), None, root, job)
    _commit(spark, root, Mark(job, *last, begun=job))


def _days_between(since: dt.datetime, until: dt.datetime) -> list[dt.date]:
    return [since.date() + dt.timedelta(days=i) for i in range((until.date() - since.date()).days + 1)]


def _context(metering: DataFrame, root: str, now: Mark, since: dt.datetime) -> DataFrame:
    """The three newest rows of each warehouse before ``since``: those carried, and the rows since they were. Without carried
    rows, or for a time before them, all older rows are read once."""
    spark = metering.sparkSession
    rows = rows_since(metering, F.lit(dt.datetime.min.replace(year=1000)).cast("timestamp"), F.lit(since).cast("timestamp"))
    if now.carried_until and (carried_until := dt.datetime.fromisoformat(now.carried_until)) <= since:
        rows = rows_since(metering, F.lit(carried_until).cast("timestamp"), F.lit(since).cast("timestamp"))
        rows = conform(rows, METERING).unionByName(read_version(spark, root, "carry", now.carried_by, METERING))
    return write_version(conform(latest_rows(conform(rows, METERING)), METERING), root, "carry", now.job + 1)


def run_cycle(metering: DataFrame, root: str, *, as_of: dt.datetime, lookback_hours: int = K.LOOKBACK_HOURS) -> State:
    """One scheduled run: scan the last hours, log what is new, fix it. Metering is read from the start of the last scan on
    (where it has a day column, only those days), of the state only the days of the scan. All anomalies enter here and are
    fixed at once, so none is open in between."""
    spark = metering.sparkSession
    now, since = mark(spark, root), as_of - dt.timedelta(hours=lookback_hours)
    context = _context(metering, root, now, since)
    logged = load(spark, root, anomaly_days=_days_between(since, as_of)).anomalies
    idle = D.detect_idle(metering, logged, as_of=as_of, lookback_hours=lookback_hours)
    spikes = D.detect_cost_spike(metering, logged, as_of=as_of, lookback_hours=lookback_hours, context=context)
    found = write_version(idle.unionByName(spikes), root, "found", now.job + 1)
    new = write_version(checked(number_anomalies(found, now.anomaly), ANOMALIES), root, "detected", now.job + 1)
    count = new.count()
    fixed = fix_anomalies(new, as_of)
    if count:
        _savings_changed(fixed, None, root, now.job + 1)
        days = days_in(new.withColumn(DAY, day_of("anomaly_start")))
        held = conform(load(spark, root, anomaly_days=days).anomalies, ANOMALIES)
        write_days(held.unionByName(fixed), f"{root}/anomalies", "anomaly_start")
    entries = scan_rows_of(new, as_of, lookback_hours, now.log).unionByName(fix_audit(new, as_of, now.log + 2))
    _log(spark, root, entries, [as_of.date()])
    _commit(spark, root, Mark(now.job + 1, now.anomaly + count, now.log + 2 + count, now.job + 1, since.isoformat(), now.begun))
    return load(spark, root)


def _log(spark: SparkSession, root: str, entries: DataFrame, days: list[dt.date]) -> None:
    held = conform(load(spark, root, log_days=days).audit_log, AUDIT_LOG)
    write_days(checked(held.unionByName(entries), AUDIT_LOG), f"{root}/audit_log", "logged_at")


def _touched(state: State, decided: DataFrame, root: str, job: int) -> tuple[DataFrame, list[dt.date], list[dt.date]]:
    """The decisions, written once, with the days of their anomalies and of their waiting entries. Both lookups read ids and
    status only."""
    waiting = state.audit_log.filter(F.col("status") == K.PENDING_APPROVAL).select("anomaly_id", F.col(DAY).alias("_log_day"))
    placed = decided.join(state.anomalies.select("anomaly_id", F.col(DAY).alias("_day")), "anomaly_id", "left").join(waiting, "anomaly_id", "left")
    placed = write_version(placed, root, "decided", job)
    of = lambda name: [r[0] for r in placed.select(name).where(f"{name} is not null").distinct().collect()]
    return placed.select("anomaly_id", "approver").distinct(), of("_day"), of("_log_day")


def approve(spark: SparkSession, root: str, approvals: DataFrame, at: dt.datetime) -> State:
    """Carries out approvals (anomaly_id, approved_by, requested_at), see ``remediation.approve_fixes``."""
    now, state = mark(spark, root), load(spark, root)
    decided, days, log_days = _touched(state, accepted_requests(state.audit_log, approvals), root, now.job + 1)
    count = decided.count()
    if count:
        part = load(spark, root, days, [*log_days, at.date()])
        part = State(conform(part.anomalies, ANOMALIES), conform(part.audit_log, AUDIT_LOG))
        done = carry_out(part, decided, at, F.lit(now.log))
        _savings_changed(done.anomalies, part.anomalies, root, now.job + 1)
        write_days(conform(done.anomalies, ANOMALIES), f"{root}/anomalies", "anomaly_start")
        write_days(conform(done.audit_log, AUDIT_LOG), f"{root}/audit_log", "logged_at")
    _commit(spark, root, now._replace(job=now.job + 1, log=now.log + count))
    return load(spark, root)


def dismiss(spark: SparkSession, root: str, dismissals: DataFrame) -> State:
    """Carries out dismissals (anomaly_id, dismissed_by, requested_at), see ``remediation.dismiss_fixes``."""
    now, state = mark(spark, root), load(spark, root)
    decided, days, log_days = _touched(state, decided_dismissals(dismissals), root, now.job + 1)
    part = load(spark, root, days, log_days)
    done = dismiss_decided(State(conform(part.anomalies, ANOMALIES), conform(part.audit_log, AUDIT_LOG)), decided)
    if days:
        _savings_changed(done.anomalies, part.anomalies, root, now.job + 1)
        write_days(conform(done.anomalies, ANOMALIES), f"{root}/anomalies", "anomaly_start")
    if log_days:
        write_days(conform(done.audit_log, AUDIT_LOG), f"{root}/audit_log", "logged_at")
    _commit(spark, root, now._replace(job=now.job + 1))
    return load(spark, root)



# --- savings, notifications and messages of a state -----------------------------------------------------------------


_CHANGE = T.StructType([SAVINGS_HISTORY["snapshot_date"], T.StructField("credits", T.DecimalType(28, 9))])


def _saved(anomalies: DataFrame) -> DataFrame:
    """Credits saved by the day of the resolution."""
    solved = anomalies.filter((F.col("status") == K.RESOLVED) & F.col("resolved_at").isNotNull())
    return solved.groupBy(F.to_date("resolved_at").alias("snapshot_date")).agg(F.sum("credits_wasted").alias("credits"))


def _savings_changed(after: DataFrame, before: DataFrame | None, root: str, job: int) -> None:
    """Writes what a job changes: the savings of the anomalies it touches as they are after it, less what they were before. A
    day that is opened again is corrected by a signed row; no older anomaly is read."""
    change = _saved(after)
    if before is not None:
        change = change.unionByName(_saved(before).withColumn("credits", -F.col("credits")))
        change = change.groupBy("snapshot_date").agg(F.sum("credits").alias("credits"))
    write_version(conform(change, _CHANGE), root, "savings", job)


def savings_history(spark: SparkSession, root: str) -> DataFrame:
    """Cumulative dollars saved by day, from the changes that jobs have written: as many rows as days and jobs, however many
    anomalies there are."""
    now = mark(spark, root)
    changes = read_all_versions(spark, root, "savings", _CHANGE, before=now.job + 1, since=now.begun)
    daily = changes.groupBy("snapshot_date").agg(F.sum("credits").alias("credits")).filter(F.col("credits") != 0)
    return running_savings(daily)


def notify(spark: SparkSession, root: str) -> DataFrame:
    """The notifications of all entries logged since the last call, added to ``notifications`` (filed by day) and returned.

    The log is read behind the mark ``notifications.json`` only, anomalies only of the days that the entries' anomalies have. A
    call that died before its mark is repeated by the next: what it wrote has higher ids than the mark and is overwritten.
    """
    now = mark(spark, root)
    done = _notified(spark, root, now)
    new = load(spark, root).audit_log.filter(F.col("log_id") > done["log"])
    new = write_version(conform(new, AUDIT_LOG), root, "to_notify", now.job)
    anomalies = load(spark, root).anomalies.join(new.select("anomaly_id").distinct(), "anomaly_id", "left_semi")
    made = write_version(generate_notifications(new, anomalies, done["notification"]), root, "notified", now.job)
    last = made.agg(F.max("notification_id")).first()[0]
    if last is not None:
        days = days_in(made.withColumn(DAY, day_of("created_at")))
        held = read_days(spark, f"{root}/notifications", NOTIFICATIONS, days).filter(F.col("notification_id") <= done["notification"])
        write_days(conform(held, NOTIFICATIONS).unionByName(made), f"{root}/notifications", "created_at")
    write_mark(spark, f"{root}/notifications.json", {"begun": now.begun, "log": now.log, "notification": last or done["notification"]})
    return made


def _notified(spark: SparkSession, root: str, now: Mark) -> dict:
    found = read_mark(spark, f"{root}/notifications.json")
    return found if found and found["begun"] == now.begun else {"log": 0, "notification": 0}


def notifications(spark: SparkSession, root: str, days: list[dt.date] | None = None) -> DataFrame:
    """All notifications of a state, or those of some days; what is read follows from the marks of :func:`mark_read`."""
    done = _notified(spark, root, mark(spark, root))
    rows = read_days(spark, f"{root}/notifications", NOTIFICATIONS, days).filter(F.col("notification_id") <= done["notification"])
    upto = (read_mark(spark, f"{root}/read.json") or {"upto": 0})["upto"]
    single = read_all_versions(spark, root, "read", T.StructType([NOTIFICATIONS["notification_id"]]))
    rows = rows.withColumn("is_read", F.col("is_read") | (F.col("notification_id") <= upto))
    return marked_read(conform(rows, NOTIFICATIONS), single)


def mark_read(spark: SparkSession, root: str, ids: DataFrame | None = None) -> None:
    """Marks all notifications there are as read, by one number, or those of ``ids`` by a row each. No notification is
    rewritten."""
    if ids is None:
        done = _notified(spark, root, mark(spark, root))
        write_mark(spark, f"{root}/read.json", {"upto": done["notification"]})
    else:
        version = 1 + max(committed_versions(spark, root, "read"), default=0)
        write_version(ids.select(F.col("notification_id").cast("bigint")), root, "read", version)


# --- lists of the newest rows, from the newest days ----------------------------------------------------------------


def newest_log(spark: SparkSession, root: str, enough: int, wanted: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The part of the audit log that has its newest ``enough`` rows among those ``wanted`` leaves."""
    last = mark(spark, root).log
    return newest_days(spark, f"{root}/audit_log", AUDIT_LOG, enough, lambda rows: wanted(rows.filter(F.col("log_id") <= last))).filter(
        F.col("log_id") <= last
    )


def audit_page(spark: SparkSession, root: str, limit: int = 50, **filters) -> DataFrame:
    """``audit.audit_log_filtered`` over the newest days."""
    every = lambda rows: audit.audit_log_filtered(conform(rows, AUDIT_LOG), limit=limit, **filters)
    return every(newest_log(spark, root, limit, every))


def fix_history(spark: SparkSession, root: str, limit: int = 10) -> DataFrame:
    """``operations.auto_fix_history`` over the newest days of the log and the days of its anomalies."""
    fixes = lambda rows: rows.filter((F.col("action_type") == K.AUTO_ACTION) & (F.col("status") == K.COMPLETED))
    return operations.auto_fix_history(newest_log(spark, root, limit, fixes), load(spark, root).anomalies, limit)


def approvals_page(spark: SparkSession, root: str, limit: int = 5) -> DataFrame:
    """``operations.recently_approved`` over the newest days of the log."""
    approved = lambda rows: rows.filter(
        (F.col("action_type") == K.USER_ACTION) & (F.col("status") == K.COMPLETED) & F.col("approved_by").isNotNull()
    )
    return operations.recently_approved(newest_log(spark, root, limit, approved), load(spark, root).anomalies, limit)


def feed(spark: SparkSession, root: str, as_of: dt.datetime, kind: str | None = None, limit: int = 30) -> DataFrame:
    """``notifications.notification_feed`` over the newest days."""
    wanted = lambda rows: rows if kind is None else rows.filter(F.col("notification_type") == kind)
    days = days_in(newest_days(spark, f"{root}/notifications", NOTIFICATIONS, limit, wanted))
    return notification_feed(notifications(spark, root, days), as_of, kind, limit)


def run_hour(metering: DataFrame, root: str, *, as_of: dt.datetime, lookback_hours: int = K.LOOKBACK_HOURS) -> State:
    """The whole hourly chain: scan, log, fix, keep the savings, notify, send. Each step has a mark of its own, so a chain that
    stopped goes on where it was."""
    state = run_cycle(metering, root, as_of=as_of, lookback_hours=lookback_hours)
    notify(metering.sparkSession, root)
    send_outbox(conform(state.anomalies, ANOMALIES), root)
    return state
