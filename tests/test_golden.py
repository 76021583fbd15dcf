"""The 19-row demo table, run through the whole job."""

import datetime as dt
from decimal import Decimal as D

import pytest
from conftest import by
from pyspark.sql import functions as F

from meterwise.operators import audit, baseline, detection, remediation, summary
from meterwise.plans import jobs
from meterwise.sources.metering import metering_from_rows

# --- fixed values: the demo table, in the order of its columns: start and end time, warehouse id and name, credits used, of
# which compute, of which cloud services ----------------------------------------------------------------------------
DEMO = [
    ("2026-07-25 08:00:00 -0700", "2026-07-25 09:00:00 -0700", 100, "ANALYTICS_WH", "2.100000000", "2.050000000", "0.050000000"),
    ("2026-07-25 09:00:00 -0700", "2026-07-25 10:00:00 -0700", 100, "ANALYTICS_WH", "1.900000000", "1.860000000", "0.040000000"),
    ("2026-07-25 10:00:00 -0700", "2026-07-25 11:00:00 -0700", 100, "ANALYTICS_WH", "2.300000000", "2.250000000", "0.050000000"),
    ("2026-07-25 11:00:00 -0700", "2026-07-25 12:00:00 -0700", 100, "ANALYTICS_WH", "2.000000000", "1.960000000", "0.040000000"),
    ("2026-07-25 12:00:00 -0700", "2026-07-25 13:00:00 -0700", 100, "ANALYTICS_WH", "0.050000000", "0.000000000", "0.050000000"),
    ("2026-07-25 13:00:00 -0700", "2026-07-25 14:00:00 -0700", 100, "ANALYTICS_WH", "0.048000000", "0.000000000", "0.048000000"),
    ("2026-07-25 14:00:00 -0700", "2026-07-25 15:00:00 -0700", 100, "ANALYTICS_WH", "0.052000000", "0.000000000", "0.052000000"),
    ("2026-07-25 01:00:00 -0700", "2026-07-25 02:00:00 -0700", 200, "ETL_WH", "4.200000000", "4.100000000", "0.100000000"),
    ("2026-07-25 02:00:00 -0700", "2026-07-25 03:00:00 -0700", 200, "ETL_WH", "3.800000000", "3.700000000", "0.100000000"),
    ("2026-07-25 03:00:00 -0700", "2026-07-25 04:00:00 -0700", 200, "ETL_WH", "4.100000000", "4.000000000", "0.100000000"),
    ("2026-07-25 04:00:00 -0700", "2026-07-25 05:00:00 -0700", 200, "ETL_WH", "16.500000000", "16.200000000", "0.300000000"),
    ("2026-07-25 05:00:00 -0700", "2026-07-25 06:00:00 -0700", 200, "ETL_WH", "15.800000000", "15.500000000", "0.300000000"),
    ("2026-07-25 06:00:00 -0700", "2026-07-25 07:00:00 -0700", 200, "ETL_WH", "4.300000000", "4.200000000", "0.100000000"),
    ("2026-07-25 18:00:00 -0700", "2026-07-25 19:00:00 -0700", 300, "DEV_WH", "0.120000000", "0.000000000", "0.120000000"),
    ("2026-07-25 19:00:00 -0700", "2026-07-25 20:00:00 -0700", 300, "DEV_WH", "0.118000000", "0.000000000", "0.118000000"),
    ("2026-07-25 20:00:00 -0700", "2026-07-25 21:00:00 -0700", 300, "DEV_WH", "0.122000000", "0.000000000", "0.122000000"),
    ("2026-07-25 21:00:00 -0700", "2026-07-25 22:00:00 -0700", 300, "DEV_WH", "0.115000000", "0.000000000", "0.115000000"),
    ("2026-07-25 22:00:00 -0700", "2026-07-25 23:00:00 -0700", 300, "DEV_WH", "0.119000000", "0.000000000", "0.119000000"),
    ("2026-07-25 23:00:00 -0700", "2026-07-26 00:00:00 -0700", 300, "DEV_WH", "0.121000000", "0.000000000", "0.121000000"),
]
# --------------------------------------------------------------------------------------------------------------------

AS_OF = dt.datetime(2026, 7, 26)


@pytest.fixture(scope="module")
def demo(spark):
    at = lambda text: dt.datetime.strptime(text, "%Y-%m-%d %H:%M:%S %z")
    rows = [(at(start), at(end), number, name, D(used), D(compute), D(cloud)) for start, end, number, name, used, compute, cloud in DEMO]
    return metering_from_rows(spark, rows)


@pytest.fixture(scope="module")
def state(demo):
    return jobs.detect_and_fix(demo, as_of=AS_OF)


def test_idle(demo):
    found = detection.detect_idle(demo, as_of=AS_OF, lookback_hours=None, exclude=())
    totals = found.groupBy("warehouse_name", "severity").agg(F.count("*").alias("n"), F.sum("credits_wasted").alias("c"))
    assert by(totals, "warehouse_name", "severity", "n", "c") == [
        ("ANALYTICS_WH", "LOW", 3, D("0.150")),
        ("DEV_WH", "MEDIUM", 6, D("0.715")),
    ]


def test_spike(demo):
    found = detection.detect_cost_spike(demo, as_of=AS_OF).collect()
    assert [(r.warehouse_name, r.severity, r.credits_wasted) for r in found] == [("ETL_WH", "HIGH", D("12.466666667"))]
    assert "Used 16.500 credits vs 4.033 rolling avg (4.1x normal)." in found[0].description


def test_near_misses(demo):
    rows = baseline.rolling_baseline(demo).filter("warehouse_name = 'ETL_WH'").orderBy("start_time").collect()
    assert [r.preceding_rows for r in rows] == [0, 1, 2, 3, 3, 3]
    ratio = rows[4].credits_used * rows[4].baseline_count / rows[4].baseline_sum
    assert round(ratio, 4) == D("1.9426")


def test_texts_show_the_session_zone(spark, demo):
    spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
    try:
        text = detection.detect_cost_spike(demo, as_of=AS_OF).first()
        assert "detected at 2026-07-25 04:00." in text.description
        assert "ETL_WH between 04:00-05:00." in text.suggested_fix
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_state_after_fixes(state):
    counts = state.anomalies.groupBy("status").count()
    assert by(counts, "status", "count") == [("ACKNOWLEDGED", 1), ("RESOLVED", 9)]
    kinds = state.audit_log.groupBy("action_type", "status").count()
    assert by(kinds, "action_type", "status", "count") == [
        ("AUTO_ACTION", "COMPLETED", 9),
        ("DETECTION", "COMPLETED", 2),
        ("RECOMMENDATION", "PENDING_APPROVAL", 1),
    ]
    assert [r.log_id for r in state.audit_log.orderBy("log_id").collect()] == list(range(1, 13))


def test_kpis(state):
    row = summary.kpi_summary(state.anomalies).first()
    assert (row.total_anomalies, row.credits_wasted, row.credits_saved, row.open_issues) == (
        10, D("13.331666667"), D("0.865"), 1,
    )
    assert row.dollars_saved == D("2.595")
    green = summary.environment_impact(state.anomalies).first()
    assert (green.kwh_saved, green.co2_kg_avoided, green.trees) == (D("3.287"), D("1.28193"), 1)


def test_second_run_finds_nothing(demo, state):
    idle, spikes = jobs.detect_all(demo, state.anomalies, detected_at=AS_OF)
    assert idle.count() == 0 and spikes.count() == 0
    row = detection.scan_audit(idle, "idle_full", at=AS_OF).first()
    assert row.action_details == "Idle compute scan (DEMO) completed. New anomalies found: 0"


def test_approval_of_the_pending_fix(spark, state):
    waiting = state.anomalies.filter("status = 'ACKNOWLEDGED'").first()
    request = spark.createDataFrame(
        [(waiting.anomaly_id, "carol", AS_OF)], "anomaly_id long, approved_by string, requested_at timestamp"
    )
    after = remediation.approve_fixes(state, request, AS_OF)
    assert after.anomalies.filter("status = 'RESOLVED'").count() == 10
    stats = audit.audit_stats(after.audit_log).first()
    assert (stats.total_entries, stats.auto_actions, stats.manual_actions, stats.pending) == (13, 9, 1, 0)


def test_lazy_and_written_state_agree(demo, state, tmp_path):
    written = jobs.rebuild_state(demo, str(tmp_path), 1, as_of=AS_OF)
    assert by(written.anomalies, "anomaly_id", "warehouse_name", "description") == by(
        state.anomalies, "anomaly_id", "warehouse_name", "description"
    )
    assert by(written.audit_log, "log_id", "action_details") == by(state.audit_log, "log_id", "action_details")
