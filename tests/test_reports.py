import datetime as dt
from decimal import Decimal as D

import pytest
from conftest import AS_OF, by, hour, usage

from meterwise.operators import attribution, audit, compliance, notifications, operations, remediation, summary
from meterwise.operators.remediation import State
from meterwise.session import build_session
from meterwise.sources.history import read_query_history, scan_query_history, write_query_history


def test_kpis_of_nothing(anomalies):
    row = summary.kpi_summary(anomalies([])).first()
    assert (row.total_anomalies, row.credits_wasted, row.credits_saved, row.open_issues) == (0, 0, 0, 0)
    green = summary.environment_impact(anomalies([])).first()
    assert (green.kwh_saved, green.trees) == (0, 1)


def test_trees_are_whole(anomalies):
    row = summary.environment_impact(anomalies([{"credits_wasted": D("100"), "status": "RESOLVED"}])).first()
    assert (row.kwh_saved, row.co2_kg_avoided, row.trees) == (D("380"), D("148.2"), 6)


def test_savings_by_day(anomalies):
    rows = [(0, "1"), (5, "2"), (30, "0.005"), (100, "4")]
    frame = anomalies(
        [{"status": "RESOLVED", "resolved_at": hour(h), "credits_wasted": D(c)} for h, c in rows]
        + [{"status": "DISMISSED", "resolved_at": hour(5)}, {"status": "OPEN"}]
    )
    history = summary.snapshot_savings(frame)
    assert by(history, "snapshot_date", "dollar_saved") == [
        (dt.date(2024, 1, 1), D("9.00")), (dt.date(2024, 1, 2), D("9.02")), (dt.date(2024, 1, 5), D("21.02")),
    ]
    trend = summary.savings_trend(history, dt.datetime(2024, 1, 5), days=3)
    assert [r.snapshot_date.day for r in trend.collect()] == [5]
    assert [r.snapshot_date.day for r in summary.savings_trend(history, dt.datetime(2024, 1, 5), days=4).collect()] == [2, 5]
    assert [r.snapshot_date.day for r in summary.savings_trend(history).collect()] == [1, 2, 5]


@pytest.mark.parametrize(
    ("settings", "recent", "score", "band"),
    [
        ({}, 0, 100, "Healthy"),
        ({"auto_suspend": 300}, 0, 100, "Healthy"),
        ({"auto_suspend": 301}, 0, 85, "Healthy"),
        ({"auto_suspend": 600}, 0, 85, "Healthy"),
        ({"auto_suspend": 601}, 0, 75, "Needs Attention"),
        ({"auto_suspend": None}, 0, 85, "Healthy"),
        ({"auto_suspend": 0}, 0, 85, "Healthy"),
        ({"running": 0}, 0, 80, "Healthy"),
        ({"running": None}, 0, 80, "Healthy"),
        ({"running": 0, "state": "SUSPENDED"}, 0, 100, "Healthy"),
        ({}, 4, 68, "Needs Attention"),
        ({}, 6, 60, "Needs Attention"),
        ({"auto_suspend": 900, "running": 0}, 9, 15, "Critical"),
    ],
)
def test_health(inventory, anomalies, settings, recent, score, band):
    found = anomalies([{"detected_at": hour(700 - i)} for i in range(recent)] + [{"detected_at": hour(1)}] * 3)
    row = summary.health_scores(inventory([settings]), found, AS_OF).first()
    assert (row.score, row.band) == (score, band)


def test_status_and_quick_stats(inventory, anomalies, spark):
    rows = inventory([{"name": n, "state": s} for n, s in [("A", "STARTED"), ("B", "SUSPENDED"), ("C", "RESIZING")]])
    assert by(operations.warehouse_status(rows), "name", "status", "suspend_text") == [
        ("A", "Running", "60s"), ("B", "Suspended", "60s"), ("C", "RESIZING", "60s"),
    ]
    found = anomalies([{"status": s} for s in ("OPEN", "ACKNOWLEDGED", "RESOLVED", "DISMISSED")])
    notes = spark.createDataFrame([(False,), (True,), (False,)], "is_read boolean")
    assert tuple(summary.quick_stats(notes, found, rows).first()) == (2, 2, 3)


@pytest.fixture
def worked(anomalies, empty_log, spark):
    rows = [
        {"severity": s, "detected_at": hour(i), "credits_wasted": D(i), "anomaly_type": t, "warehouse_name": f"W{i % 3}"}
        for i, (s, t) in enumerate([("LOW", "IDLE_COMPUTE"), ("MEDIUM", "COST_SPIKE"), ("HIGH", "COST_SPIKE")] * 8, start=1)
    ]
    state = remediation.apply_fixes(State(anomalies(rows), empty_log), AS_OF)
    asked = spark.createDataFrame([(i, "ann", AS_OF) for i in (3, 6, 9, 12, 15, 18)], "anomaly_id long, approved_by string, requested_at timestamp")
    return State(*(t.cache() for t in remediation.approve_fixes(state, asked, AS_OF)))


def test_fix_lists(worked):
    history = operations.auto_fix_history(worked.audit_log, worked.anomalies).collect()
    assert [r.log_id for r in history] == [23, 22, 20, 19, 17, 16, 14, 13, 11, 10]
    assert (history[0].dollar_saved, history[0].warehouse_name) == (D("69.00"), "W2")
    waiting = operations.pending_approvals(worked.anomalies, worked.audit_log)
    assert [r.anomaly_id for r in waiting.collect()] == [24, 21]
    assert tuple(operations.approval_kpis(waiting).first()) == (2, D("135"), 2)
    approved = operations.recently_approved(worked.audit_log, worked.anomalies).collect()
    assert [r.log_id for r in approved] == [30, 29, 28, 27, 26]
    assert (approved[0].warehouse_name, approved[0].dollar_saved, approved[0].approved_by) == ("W0", D("54"), "ann")


def test_grouped_anomalies(worked):
    rows = summary.anomalies_by_warehouse(worked.anomalies).collect()
    assert [r.credits for r in rows] == sorted((r.credits for r in rows), reverse=True)
    assert sum(r.anomaly_count for r in rows) == 24


def test_audit_reports(worked):
    assert tuple(audit.audit_stats(worked.audit_log).first()) == (30, 16, 6, 2)
    assert by(audit.audit_warehouses(worked.audit_log), "warehouse_name") == [("W0",), ("W1",), ("W2",)]
    assert audit.audit_log_filtered(worked.audit_log).count() == 30
    chosen = audit.audit_log_filtered(worked.audit_log, warehouse="W1", status="COMPLETED", action_type="AUTO_ACTION")
    assert [r.anomaly_id for r in chosen.collect()] == [22, 19, 16, 13, 10, 7, 4, 1]
    assert audit.audit_log_filtered(worked.audit_log, status="FAILED").count() == 0
    assert audit.audit_log_filtered(worked.audit_log, warehouse="x' OR '1'='1").count() == 0
    assert audit.audit_log_filtered(worked.audit_log, limit=3).count() == 3


def test_notifications(worked, spark):
    made = notifications.generate_notifications(worked.audit_log, worked.anomalies, after=7)
    kinds = made.groupBy("notification_type").count()
    assert by(kinds, "notification_type", "count") == [
        ("APPROVAL_NEEDED", 2), ("APPROVED", 6), ("INFO", 8 + 6), ("WARNING", 8),
    ]
    assert sorted(r.notification_id for r in made.collect()) == list(range(8, 38))
    feed = notifications.notification_feed(made, AS_OF, limit=5)
    assert [r.badge for r in feed.collect()] == ["Success"] * 5
    assert tuple(notifications.notification_counts(feed).first()) == (5, 0, 0, 5, 0)
    assert notifications.notification_feed(made, AS_OF, "WARNING").count() == 8
    assert notifications.mark_read(made).filter("is_read").count() == 30
    one = spark.createDataFrame([(8,), (8,), (999,)], "notification_id long")
    assert by(notifications.mark_read(made, one).filter("is_read"), "notification_id") == [(8,)]


@pytest.mark.parametrize(
    ("minutes", "text"),
    [(0, "0m ago"), (59, "59m ago"), (60, "1h ago"), (1439, "23h ago"), (1440, "1d ago"), (2879, "1d ago"), (2880, "2d ago")],
)
def test_age(spark, minutes, text):
    row = (1, AS_OF - dt.timedelta(minutes=minutes, seconds=0), "INFO", "t", "m", "w", False)
    from meterwise.schemas import NOTIFICATIONS

    frame = spark.createDataFrame([row], NOTIFICATIONS)
    assert notifications.notification_feed(frame, AS_OF).first().age == text


def test_week_over_week(metering):
    monday = 28 * 24  # 2024-01-29
    rows = [
        usage("UP", monday, 3), usage("UP", monday - 1, 2),
        usage("DOWN", monday + 5, 1), usage("DOWN", monday - 168, 3),
        usage("NEW", monday, 1),
        usage("GONE", monday - 168, 1),
        usage("OLD", monday - 169, 1),
        usage("CLOUD_SERVICES_ONLY", monday, 1),
        usage("SAME", monday, 1), usage("SAME", monday - 2, 1),
        usage("ZERO", monday, 0),
    ]
    assert by(attribution.week_over_week(metering(rows), AS_OF), "warehouse_name", "this_week", "last_week", "change") == [
        ("DOWN", 1, 3, "-66.7%"), ("GONE", 0, 1, "-100.0%"), ("NEW", 1, 0, "new"), ("SAME", 1, 1, "+0.0%"),
        ("UP", 3, 2, "+50.0%"),
    ]


def test_cost_attribution(history):
    rows = [(i, "W", f"U{i % 12:02d}", "R", hour(700), (i % 12) * 10 + 1) for i in range(24)]
    rows += [(90, "W", "OLD", "R", hour(1), 999), (91, "W", "FREE", "R", hour(700), 0)]
    frame = history(rows)
    top = attribution.cost_attribution(frame, AS_OF).collect()
    assert [r.user_name for r in top] == [f"U{i:02d}" for i in range(11, 1, -1)]
    assert (top[0].queries, top[0].credits, top[0].dollars) == (2, D("222"), D("666"))
    assert scan_query_history(frame, AS_OF).count() == 24


def test_spike_queries(anomalies, history):
    spikes = anomalies(
        [
            {"anomaly_type": "COST_SPIKE", "warehouse_name": "A", "anomaly_start": hour(1), "anomaly_end": hour(2)},
            # A window that starts inside an hour and covers parts of three.
            {"anomaly_type": "COST_SPIKE", "warehouse_name": "A", "anomaly_start": hour(5) + dt.timedelta(minutes=30),
             "anomaly_end": hour(7) + dt.timedelta(minutes=30)},
            {"anomaly_type": "IDLE_COMPUTE", "warehouse_name": "A", "anomaly_start": hour(1), "anomaly_end": hour(2)},
            {"anomaly_type": "COST_SPIKE", "warehouse_name": "A", "anomaly_end": None},
        ]
    )
    queries = [(i, w, "U", "R", hour(0) + dt.timedelta(minutes=15 * i), i) for i in range(40) for w in ("A", "B")]
    inside = [(1, q) for q in range(4, 8)] + [(2, q) for q in range(22, 30)]
    frame = history(queries)
    assert by(operations.spike_queries(spikes, frame), "anomaly_id", "query_id") == inside
    top = operations.top_spike_queries(spikes, frame, limit=2)
    assert by(top, "anomaly_id", "cost_rank", "query_id") == [(1, 1, 7), (1, 2, 6), (2, 1, 29), (2, 2, 28)]
    assert "WindowGroupLimit" in top._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    ("settings", "failed"),
    [
        ({}, []),
        ({"auto_suspend": 300}, []),
        ({"auto_suspend": None}, []),
        ({"auto_suspend": 0}, []),
        ({"auto_suspend": 301}, [("Auto-Suspend Timeout", "FAIL", "MEDIUM", "301s")]),
        ({"auto_suspend": 601}, [("Auto-Suspend Timeout", "FAIL", "HIGH", "601s")]),
        ({"auto_resume": "TRUE"}, []),
        ({"auto_resume": "false"}, [("Auto-Resume Disabled", "FAIL", "LOW", "false")]),
        ({"auto_resume": None}, [("Auto-Resume Disabled", "FAIL", "LOW", "false")]),
        ({"size": "Medium"}, []),
        ({"size": "Large"}, [("Potentially Oversized", "WARN", "MEDIUM", "Large")]),
        ({"size": "4X-Large"}, [("Potentially Oversized", "WARN", "MEDIUM", "4X-Large")]),
        ({"size": "Large", "name": "my_etl_wh"}, []),
        ({"size": None}, []),
    ],
)
def test_compliance(inventory, settings, failed):
    frame = inventory([settings])
    assert by(compliance.compliance_findings(frame), "check_name", "status", "severity", "current_value") == failed
    row = compliance.compliance_score(frame).first()
    assert (row.checks_passed, row.checks_total, row.issues_found) == (3 - len(failed), 3, len(failed))


def test_compliance_of_nothing(inventory):
    row = compliance.compliance_score(inventory([])).first()
    assert (row.score, row.checks_total, row.band) == (100, 0, "Healthy")


def test_score_is_cut_not_rounded(inventory):
    frame = inventory([{"auto_suspend": 900}] + [{}] * 99)
    assert compliance.compliance_score(frame).first().score == 99


def test_session_is_utc(spark):
    assert build_session().conf.get("spark.sql.session.timeZone") == "UTC"


def metrics_of(frame, name: str) -> list[int]:
    """The metric's value at each file scan of the executed plan."""
    plan = frame._jdf.queryExecution().executedPlan()
    if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        plan = plan.executedPlan()
    found, todo = [], [plan]
    while todo:
        node = todo.pop()
        if "QueryStageExec" in node.getClass().getSimpleName():
            todo.append(node.plan())
        if node.getClass().getSimpleName() == "FileSourceScanExec" and node.metrics().contains(name):
            found.append(node.metrics().apply(name).value())
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return found


def test_the_drilldown_reads_only_the_spikes_days(spark, anomalies, history, tmp_path):
    rows = [(d * 100 + h, "A", "u", "r", hour(24 * d + h), "0.5") for d in range(10) for h in range(24)]
    write_query_history(history(rows), str(tmp_path / "h"))
    table = read_query_history(spark, str(tmp_path / "h"))
    spikes = anomalies([dict(warehouse_name="A", anomaly_type="COST_SPIKE", anomaly_start=hour(24 * d + 5), anomaly_end=hour(24 * d + 7)) for d in (2, 6)])
    found = operations.spike_queries(spikes, table)
    assert by(found, "anomaly_id", "query_id") == [(1, 205), (1, 206), (2, 605), (2, 606)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan
    scans = metrics_of(found, "numPartitions")
    assert scans == [2]
