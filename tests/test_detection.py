from decimal import Decimal as D

import pytest
from conftest import AS_OF, by, hour, usage
from pyspark.sql import functions as F

from meterwise.operators import detection
from meterwise.operators.baseline import latest_rows
from meterwise.schemas import ANOMALIES
from meterwise.sources.metering import read_metering, scan_metering, write_metering


def everything(frame, existing=None):
    return detection.detect_idle(frame, existing, as_of=AS_OF, lookback_hours=None, exclude=())


@pytest.mark.parametrize(
    ("cloud", "severity"),
    [("0.000000001", "LOW"), ("0.1", "LOW"), ("0.100000001", "MEDIUM"), ("1.0", "MEDIUM"), ("1.000000001", "HIGH")],
)
def test_idle_severity_bounds(metering, cloud, severity):
    row = everything(metering([usage("A", 0, cloud, cloud, D(0))])).first()
    assert (row.severity, row.credits_wasted) == (severity, D(cloud))


def test_idle_needs_no_compute_and_some_cloud(metering):
    rows = [
        usage("COMPUTES", 0, "1", "0.5", D("0.5")),
        usage("OFF", 0, "0", "0", D(0)),
        usage("UNKNOWN", 0, None, "0.5", None),
        usage("IDLE", 0, "0.5", "0.5", D(0)),
    ]
    assert by(everything(metering(rows)), "warehouse_name") == [("IDLE",)]


def test_lookback_and_pseudo_warehouse(metering):
    rows = [
        usage(name, h, "0.2", "0.2", D(0)) for name in ("A", "CLOUD_SERVICES_ONLY") for h in (0, 695, 696, 697, 719)
    ]
    found = detection.detect_idle(metering(rows), as_of=AS_OF)
    assert by(found, "warehouse_name", "anomaly_start") == [("A", hour(696)), ("A", hour(697)), ("A", hour(719))]
    assert everything(metering(rows)).count() == 10


def spike(metering, before, used):
    rows = [usage("A", i, value) for i, value in enumerate(before)] + [usage("A", len(before), used)]
    found = detection.detect_cost_spike(metering(rows), as_of=AS_OF).filter(F.col("anomaly_start") == hour(len(before)))
    return found.first()


@pytest.mark.parametrize(
    ("used", "severity"),
    [
        ("2.499999999", None), ("2.5", "MEDIUM"), ("4", "MEDIUM"), ("4.000000001", "HIGH"), ("8", "HIGH"),
        ("8.000000001", "CRITICAL"),
    ],
)
def test_spike_bounds(metering, used, severity):
    row = spike(metering, [1, 1, 1], used)
    assert (row.severity if row else None) == severity


def test_ratio_is_exact_where_the_average_is_not(metering):
    """The average of 1, 1 and 2 has no finite decimal form; 2.5 times it is 10/3, and so is the ratio's bound."""
    assert spike(metering, [3, 3, 4], "8.333333333") is None
    assert spike(metering, [3, 3, 4], "8.333333334").severity == "MEDIUM"
    assert spike(metering, [3, 3, 6], "10").severity == "MEDIUM"


def test_spike_needs_two_rows_and_a_positive_average(metering):
    assert spike(metering, [1], 100) is None
    assert spike(metering, [1, 1], 100).severity == "CRITICAL"
    assert spike(metering, [0, 0, 0], 100) is None


def test_threshold_is_a_parameter(metering):
    rows = [usage("A", i, v) for i, v in enumerate([2, 2, 2, 3])]
    assert detection.detect_cost_spike(metering(rows), as_of=AS_OF).count() == 0
    assert detection.detect_cost_spike(metering(rows), as_of=AS_OF, threshold=1.5).count() == 1


def test_texts(metering):
    row = spike(metering, ["1.2345", "2", "2.5"], "100.25")
    assert row.description == (
        "Warehouse A cost spike detected at 2024-01-01 03:00. Used 100.250 credits vs 1.912 rolling avg (52.4x normal)."
    )
    assert row.suggested_fix.startswith("Investigate queries running on A between 03:00-04:00. Consider: (1)")
    idle = everything(metering([usage("B", 30, "0.05", "0.05", D(0))])).first()
    assert idle.description == (
        "Warehouse B was running but idle from 2024-01-02 06:00 to 2024-01-02 07:00. "
        "Cloud services credits consumed: 0.050000"
    )
    assert idle.suggested_fix.endswith("Current idle cost: 0.050000 credits/hour.")


def test_lookback_keeps_the_older_baseline(metering):
    """Only recent rows are judged, but their baseline reaches back over the bound, however old the rows are."""
    rows = [usage("A", h, 1) for h in (0, 1, 2)] + [usage("A", 700, 10), usage("A", 701, 1)]
    rows += [usage("B", h, 1) for h in (690, 691, 692)] + [usage("B", 693, 10)]
    found = detection.detect_cost_spike(metering(rows), as_of=AS_OF, lookback_hours=24)
    assert by(found, "warehouse_name", "anomaly_start") == [("A", hour(700))]
    kept = latest_rows(metering([r for r in rows if r[0] < hour(696)]))
    again = detection.detect_cost_spike(metering(rows[3:5] + rows[8:]), as_of=AS_OF, lookback_hours=24, context=kept)
    assert by(again, "warehouse_name", "anomaly_start") == [("A", hour(700))]
    full = detection.detect_cost_spike(metering(rows), as_of=AS_OF)
    assert by(full, "warehouse_name", "anomaly_start") == [("A", hour(700)), ("B", hour(693))]


def test_logged_anomalies_are_not_found_again_whatever_their_status(metering, anomalies):
    rows = [usage("A", h, "0.2", "0.2", D(0)) for h in range(5)]
    logged = anomalies(
        [
            {"warehouse_name": "A", "anomaly_start": hour(0), "status": "RESOLVED"},
            {"warehouse_name": "A", "anomaly_start": hour(1), "status": "DISMISSED"},
            {"warehouse_name": "A", "anomaly_start": hour(2), "anomaly_type": "COST_SPIKE"},
            {"warehouse_name": "B", "anomaly_start": hour(3)},
        ]
    )
    assert by(everything(metering(rows), logged), "anomaly_start") == [(hour(2),), (hour(3),), (hour(4),)]


def test_new_anomalies_fit_the_table(metering):
    row = everything(metering([usage("A", 0, "0.2", "0.2", D(0))]))
    assert row.columns == ANOMALIES.names[1:]
    assert [f.dataType for f in row.schema.fields] == [f.dataType for f in ANOMALIES.fields[1:]]
    assert (row.first().status, row.first().resolved_at) == ("OPEN", None)


def test_scan_reports(metering, empty_log):
    found = everything(metering([usage("A", h, "0.2", "0.2", D(0)) for h in range(3)]))
    log = detection.append_scan_audit(empty_log, found, "idle", at=AS_OF, parameter=24)
    log = detection.append_scan_audit(log, found, "spike", at=AS_OF, parameter=D("2.5"))
    assert by(log, "log_id", "action_details") == [
        (1, "Idle compute scan completed. Lookback: 24 hours. New anomalies found: 3"),
        (2, "Cost spike scan (DEMO) completed. Threshold: 2.5x. New anomalies found: 3"),
    ]
    assert detection.scan_result(found, "idle").first().message == "Idle compute detection complete. 3 new anomalies logged."


def test_times_are_never_taken_from_the_clock(metering):
    with pytest.raises(ValueError):
        detection.detect_cost_spike(metering([usage("A", 0, 1)]))
    with pytest.raises(ValueError):
        scan_metering(metering([usage("A", 0, 1)]), lookback_hours=3)


def test_lookback_reads_only_its_days(spark, metering, tmp_path):
    rows = [usage(name, h, "0.2", "0.2", D(0)) for name in ("A", "B") for h in range(0, 720, 6)]
    write_metering(metering(rows), str(tmp_path / "m"))
    table = read_metering(spark, str(tmp_path / "m"))
    found = detection.detect_idle(table, as_of=AS_OF)
    assert found.count() == 8
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    scan = detection.detect_idle(table, as_of=AS_OF)._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert "PartitionFilters: [isnotnull(usage_date" in scan
    pushed = scan.split("PushedFilters: ")[1].split("ReadSchema")[0]
    assert "EqualTo(credits_used_compute,0E-9)" in pushed and "GreaterThan(credits_used_cloud_services,0E-9)" in pushed
    assert "credits_used:" not in scan.split("ReadSchema: ")[1]
