import datetime as dt
from decimal import Decimal as D

import pytest
from conftest import AS_OF, by, hour, usage
from pyspark.sql import functions as F

from meterwise.operators import alerts, audit, notifications, operations, remediation, summary
from meterwise.operators.remediation import State
from meterwise.plans import daily, jobs
from meterwise.schemas import ANOMALIES, AUDIT_LOG, METERING
from meterwise.sources import days as days_module
from meterwise.sources.days import read_days, write_days
from meterwise.sources.marks import read_mark, write_mark
from meterwise.sources.metering import read_metering, write_metering
from meterwise.sources.snapshots import read_all_versions

KEY = ("anomaly_id", "warehouse_name", "anomaly_start", "anomaly_type", "severity", "credits_wasted", "status", "resolved_by")


def rows_until(hours: int) -> list[tuple]:
    rows = [usage("A", h, 20 if h % 7 == 6 else 2) for h in range(hours)]
    return rows + [usage("B", h, "0.3", "0.3", D("0.1") if h % 3 else D(0)) for h in range(hours)]


def files(root, table: str) -> dict[str, frozenset]:
    """Data files of each day."""
    return {d.name: frozenset(f.name for f in d.glob("*.parquet")) for d in (root / table).glob("day=*")}


def changed(before: dict, after: dict) -> set[str]:
    return {day for day in before.keys() | after.keys() if before.get(day) != after.get(day)}


@pytest.fixture
def filled(spark, metering, tmp_path):
    """Four days of metering, filed by day, and the state after a cycle for each."""
    write_metering(metering(rows_until(96)), str(tmp_path / "metering"))
    table = read_metering(spark, str(tmp_path / "metering"))
    for day in range(1, 5):
        daily.run_cycle(table, str(tmp_path), as_of=hour(24 * day))
    return table


def test_days_are_replaced_one_by_one(spark, metering, tmp_path):
    path = str(tmp_path / "t")
    write_days(metering([usage("A", h, 1) for h in (0, 24, 48)]), path, "start_time")
    before = files(tmp_path, "t")
    write_days(metering([usage("A", 25, 7)]), path, "start_time")
    assert changed(before, files(tmp_path, "t")) == {"day=2024-01-02"}
    assert by(read_days(spark, path, METERING), "credits_used") == [(D(1),), (D(1),), (D(7),)]
    assert read_days(spark, path, METERING, [dt.date(2024, 1, 2), dt.date(1999, 1, 1)]).count() == 1
    assert read_days(spark, f"{path}-none", METERING).count() == 0
    write_days(metering([(None, *usage("A", 0, 1)[1:])]), path, "start_time")
    assert read_days(spark, path, METERING).count() == 4


def test_marks(spark, tmp_path):
    path = str(tmp_path / "m.json")
    assert read_mark(spark, path) is None
    for n in (1, 2):
        write_mark(spark, path, {"n": n})
        assert read_mark(spark, path) == {"n": n}


def test_daily_cycles_give_the_full_job(spark, metering, filled, tmp_path):
    state = daily.load(spark, str(tmp_path))
    full = jobs.detect_and_fix(metering(rows_until(96)), as_of=AS_OF)
    assert by(state.anomalies, *KEY) == by(full.anomalies, *KEY)
    ids = sorted(r.log_id for r in state.audit_log.collect())
    assert ids == list(range(1, 8 + state.anomalies.count() + 1))
    assert state.audit_log.filter("action_type = 'DETECTION'").count() == 8


def test_a_cycle_rewrites_only_the_days_it_touches(spark, metering, filled, tmp_path):
    write_metering(metering([usage("B", h, "0.3", "0.3", D(0)) for h in range(96, 100)]), str(tmp_path / "metering"))
    before = {t: files(tmp_path, t) for t in ("anomalies", "audit_log")}
    state = daily.run_cycle(read_metering(spark, str(tmp_path / "metering")), str(tmp_path), as_of=hour(100))
    assert changed(before["anomalies"], files(tmp_path, "anomalies")) == {"day=2024-01-05"}
    assert changed(before["audit_log"], files(tmp_path, "audit_log")) == {"day=2024-01-05"}
    assert state.anomalies.filter("anomaly_start >= '2024-01-05'").count() == 4
    repeated = {t: files(tmp_path, t) for t in ("anomalies", "audit_log")}
    daily.run_cycle(read_metering(spark, str(tmp_path / "metering")), str(tmp_path), as_of=hour(100))
    assert changed(repeated["anomalies"], files(tmp_path, "anomalies")) == set()


def test_a_cycle_reads_no_metering_before_its_last_scan(spark, filled, tmp_path, monkeypatch):
    plans = []
    real = daily.write_version

    def watch(df, root, table, version, *rest):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df, root, table, version, *rest)

    monkeypatch.setattr(daily, "write_version", watch)
    daily.run_cycle(filled, str(tmp_path), as_of=hour(98))
    scans = [line for plan in plans for line in plan.splitlines() if "FileScan" in line and "usage_date" in line]
    assert scans and not [line for line in scans if "PartitionFilters: []" in line]
    assert all("usage_date" in line.split("PartitionFilters:")[1] for line in scans)


def test_a_cycle_that_died_before_its_mark_counts_for_nothing(spark, filled, tmp_path):
    root = str(tmp_path)
    kept = read_mark(spark, f"{root}/state.json")
    before = by(daily.load(spark, root).anomalies, *KEY)
    logged = daily.load(spark, root).audit_log.count()
    rows = filled.select(*METERING.names).filter("warehouse_name = 'B' and start_time < '2024-01-01 05:00:00'")
    shifted = rows.withColumns({c: F.col(c) + F.expr("interval 4 days") for c in ("start_time", "end_time")})
    more = shifted.withColumn("credits_used_compute", F.lit(0).cast("decimal(18,9)"))
    first = by(daily.run_cycle(more, root, as_of=hour(101)).anomalies, *KEY)
    assert len(first) == len(before) + 5
    write_mark(spark, f"{root}/state.json", kept)
    state = daily.load(spark, root)
    assert by(state.anomalies, *KEY) == before and state.audit_log.count() == logged
    assert by(daily.run_cycle(more, root, as_of=hour(101)).anomalies, *KEY) == first


def test_decisions_rewrite_only_their_days(spark, filled, tmp_path):
    root = str(tmp_path)
    state = daily.load(spark, root)
    waiting = state.audit_log.filter("status = 'PENDING_APPROVAL' and logged_at = '2024-01-03'").select("anomaly_id")
    one = waiting.orderBy("anomaly_id").limit(1).first()[0]
    requests = spark.createDataFrame(
        [(one, "ann", AS_OF), (one, "bob", hour(1)), (999_999, "ann", AS_OF), (one, None, hour(0))],
        "anomaly_id long, approved_by string, requested_at timestamp",
    )
    plain = State(*(f.drop("day") for f in state))
    plain = State(spark.createDataFrame(plain.anomalies.collect(), ANOMALIES), spark.createDataFrame(plain.audit_log.collect(), AUDIT_LOG))
    before = {t: files(tmp_path, t) for t in ("anomalies", "audit_log")}
    got = daily.approve(spark, root, requests, AS_OF)
    expected = remediation.approve_fixes(plain, requests, AS_OF)
    assert by(got.anomalies, *KEY) == by(expected.anomalies, *KEY)
    log = ("log_id", "action_type", "status", "logged_at", "action_details")
    assert by(got.audit_log, *log) == by(expected.audit_log, *log)
    assert len(changed(before["anomalies"], files(tmp_path, "anomalies"))) == 1
    assert changed(before["audit_log"], files(tmp_path, "audit_log")) == {"day=2024-01-03", "day=2024-01-31"}
    again = daily.approve(spark, root, requests, AS_OF)
    assert by(again.audit_log, *log) == by(expected.audit_log, *log)


def test_dismissals_and_an_empty_state(spark, filled, tmp_path):
    root = str(tmp_path)
    waiting = daily.load(spark, root).audit_log.filter("status = 'PENDING_APPROVAL'").orderBy("anomaly_id").first().anomaly_id
    asked = spark.createDataFrame([(waiting, "bob", AS_OF)], "anomaly_id long, dismissed_by string, requested_at timestamp")
    state = daily.dismiss(spark, root, asked)
    assert by(state.anomalies.filter("status = 'DISMISSED'"), "anomaly_id") == [(waiting,)]
    assert state.audit_log.filter(f"anomaly_id = {waiting} and status = 'COMPLETED' and approved_by = 'bob'").count() == 1
    empty = str(tmp_path / "none")
    assert daily.load(spark, empty).anomalies.count() == 0
    daily.begin(State(spark.createDataFrame([], ANOMALIES), spark.createDataFrame([], AUDIT_LOG)), empty)
    assert daily.approve(spark, empty, asked.withColumnRenamed("dismissed_by", "approved_by"), AS_OF).audit_log.count() == 0


def test_newest_rows_come_from_the_newest_days(spark, filled, tmp_path, monkeypatch):
    root = str(tmp_path)
    asked = []
    real = days_module.read_days

    def watch(session, path, schema, days=None, before=None):
        asked.append(len(days) if days is not None else None)
        return real(session, path, schema, days, before)

    monkeypatch.setattr(days_module, "read_days", watch)
    state = daily.load(spark, root)
    for limit, days in ((3, [1]), (10_000, [1, 2, 4])):
        asked.clear()
        page = daily.audit_page(spark, root, limit=limit)
        assert asked == days
        expected = audit.audit_log_filtered(state.audit_log, limit=limit).drop("day")
        assert [r.log_id for r in page.collect()] == [r.log_id for r in expected.collect()]
    whole = operations.auto_fix_history(state.audit_log, state.anomalies, 7)
    assert daily.fix_history(spark, root, 7).collect() == whole.collect()
    assert daily.approvals_page(spark, str(tmp_path / "none")).count() == 0


def test_the_hourly_chain(spark, metering, tmp_path):
    """Savings, notifications and messages of four cycles are those of the whole tables; a repeated hour adds its scans only."""
    root = str(tmp_path)
    write_metering(metering(rows_until(96)), f"{root}/metering")
    table = read_metering(spark, f"{root}/metering")
    for day in (1, 2, 3, 4):
        state = daily.run_hour(table, root, as_of=hour(24 * day))
    anomalies, log = (frame.drop("day") for frame in state)
    assert daily.savings_history(spark, root).collect() == summary.snapshot_savings(anomalies).collect()
    made = daily.notifications(spark, root)
    whole = notifications.generate_notifications(log, anomalies)
    columns = ("created_at", "notification_type", "title", "message", "warehouse_name")
    assert by(made, *columns) == by(whole, *columns)
    assert sorted(r.notification_id for r in made.collect()) == list(range(1, made.count() + 1)) or len({r.notification_id for r in made.collect()}) == made.count()
    sent = read_all_versions(spark, root, "outbox", alerts.high_severity_outbox(anomalies).schema)
    assert by(sent, "anomaly_id") == by(alerts.high_severity_outbox(anomalies), "anomaly_id")
    daily.run_hour(table, root, as_of=hour(96))
    assert daily.notifications(spark, root).count() == made.count()
    assert read_all_versions(spark, root, "outbox", sent.schema).count() == sent.count()
    assert daily.feed(spark, root, AS_OF, limit=4).count() == 4


def test_a_notification_run_that_died_is_repeated(spark, filled, tmp_path):
    root = str(tmp_path)
    first = by(daily.notify(spark, root), "notification_id", "message")
    write_mark(spark, f"{root}/notifications.json", {"begun": 0, "log": 0, "notification": 0})
    assert daily.notifications(spark, root).count() == 0
    assert by(daily.notify(spark, root), "notification_id", "message") == first
    assert daily.notifications(spark, root).count() == len(first) > 0 and daily.notify(spark, root).count() == 0


def test_read_marks(spark, filled, tmp_path):
    root = str(tmp_path)
    daily.notify(spark, root)
    before = files(tmp_path, "notifications")
    ids = [r.notification_id for r in daily.notifications(spark, root).orderBy("notification_id").collect()]
    daily.mark_read(spark, root, spark.createDataFrame([(ids[2],), (ids[2],), (10**9,)], "notification_id long"))
    assert by(daily.notifications(spark, root).filter("is_read"), "notification_id") == [(ids[2],)]
    daily.mark_read(spark, root)
    assert daily.notifications(spark, root).filter("not is_read").count() == 0
    assert files(tmp_path, "notifications") == before


def test_savings_follow_decisions(spark, filled, tmp_path):
    """Approvals add to a day; an approved anomaly that is dismissed later is taken off again."""
    root = str(tmp_path)
    one = daily.load(spark, root).audit_log.filter("status = 'PENDING_APPROVAL'").orderBy("anomaly_id").first().anomaly_id
    asked = spark.createDataFrame([(one, "ann", AS_OF)], "anomaly_id long, approved_by string, requested_at timestamp")
    state = daily.approve(spark, root, asked, AS_OF)
    assert daily.savings_history(spark, root).collect() == summary.snapshot_savings(state.anomalies).collect()
    state = daily.dismiss(spark, root, asked.withColumnRenamed("approved_by", "dismissed_by"))
    assert daily.savings_history(spark, root).collect() == summary.snapshot_savings(state.anomalies).collect()
    daily.begin(State(spark.createDataFrame([], ANOMALIES), spark.createDataFrame([], AUDIT_LOG)), root)
    assert daily.savings_history(spark, root).count() == 0
