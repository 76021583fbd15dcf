from decimal import Decimal as D

import pytest
from conftest import AS_OF, by, hour, usage
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from meterwise import session
from meterwise.plans import jobs
from meterwise.schemas import METERING, conform
from meterwise.sources import snapshots
from meterwise.sources.metering import read_metering, write_metering


def test_versions(spark, tmp_path):
    root = str(tmp_path)
    for version in (1, 2):
        snapshots.write_version(spark.range(version * 10), root, "t", version)
    assert snapshots.committed_versions(spark, root, "t") == [1, 2]
    assert snapshots.read_version(spark, root, "t").count() == 20
    assert snapshots.read_version(spark, root, "t", 1).count() == 10
    schema = spark.range(1).schema
    assert snapshots.read_all_versions(spark, root, "t", schema).count() == 30
    assert snapshots.read_all_versions(spark, root, "t", schema, before=2).count() == 10
    assert snapshots.read_version(spark, root, "none", schema=schema).count() == 0
    with pytest.raises(AnalysisException):
        snapshots.read_version(spark, root, "none")


def test_an_unfinished_version_is_not_read(spark, tmp_path):
    root = str(tmp_path)
    snapshots.write_version(spark.range(10), root, "t", 1)
    snapshots.write_version(spark.range(20), root, "t", 2)
    (tmp_path / "t" / "version=2" / "_SUCCESS").unlink()
    assert snapshots.read_version(spark, root, "t").count() == 10
    assert snapshots.read_all_versions(spark, root, "t", spark.range(1).schema).count() == 10


def test_a_state_can_be_rewritten_from_itself(spark, tmp_path):
    root = str(tmp_path)
    frame = snapshots.write_version(spark.range(10), root, "t", 1)
    for version in (2, 3):
        frame = snapshots.write_version(frame.withColumn("id", F.col("id") + 1), root, "t", version)
    assert by(frame, "id") == [(i,) for i in range(2, 12)]


def test_clustered_write_prunes(spark, tmp_path):
    frame = snapshots.write_version(spark.range(0, 1000, 1, 4), str(tmp_path), "t", 1, ("id",))
    assert frame.count() == 1000
    assert "PushedFilters: [IsNotNull(id), GreaterThan(id,990)]" in (
        frame.filter("id > 990")._jdf.queryExecution().executedPlan().toString()
    )


def test_metering_layout(spark, metering, tmp_path):
    rows = [usage("A", h, 1) for h in range(60)]
    write_metering(metering(rows[:30]), str(tmp_path / "m"))
    write_metering(metering(rows[30:]), str(tmp_path / "m"))
    table = read_metering(spark, str(tmp_path / "m"))
    assert {p.name for p in (tmp_path / "m").glob("usage_date=*")} == {f"usage_date=2024-01-0{d}" for d in (1, 2, 3)}
    assert by(conform(table, METERING), "start_time") == [(hour(h),) for h in range(60)]


def test_live_cycles_add_up(spark, metering, tmp_path):
    """Running the live cycle day by day finds what one full run finds, and repeating a cycle finds nothing new."""
    rows = [usage("A", h, 20 if h % 7 == 6 else 2) for h in range(72)]
    rows += [usage("B", h, "0.3", "0.3", D("0.1") if h % 3 else D(0)) for h in range(72)]
    frame = metering(rows)
    root = str(tmp_path)
    for day in (1, 2, 3, 3):
        known = frame.filter(F.col("start_time") < F.lit(hour(24 * day)))
        state = jobs.run_cycle(known, root, as_of=hour(24 * day))
    assert jobs.state_version(spark, root) == 4
    full = jobs.detect_and_fix(frame, as_of=AS_OF)
    key = ("warehouse_name", "anomaly_start", "anomaly_type", "severity", "status", "anomaly_id")
    assert by(state.anomalies, *key) == by(full.anomalies, *key)
    assert state.audit_log.filter("action_type = 'DETECTION'").count() == 8
    ids = [r.log_id for r in state.audit_log.collect()]
    assert len(ids) == len(set(ids)) == 8 + full.anomalies.count()


def test_rebuild_wipes_what_cycles_have_written(spark, metering, tmp_path):
    frame = metering([usage("B", h, "0.3", "0.3", D(0)) for h in range(6)])
    root = str(tmp_path)
    for at in (3, 6):
        jobs.run_cycle(frame.filter(F.col("start_time") < F.lit(hour(at))), root, as_of=hour(at))
    jobs.rebuild_state(metering([]), root, as_of=hour(6))
    state = jobs.load_state(spark, root)
    assert state.anomalies.count() == 0 and state.audit_log.count() == 2
    assert jobs.run_cycle(frame, root, as_of=hour(6)).anomalies.count() == 6


def test_a_half_written_state_is_ignored(spark, metering, tmp_path):
    root = str(tmp_path)
    assert jobs.load_state(spark, root).anomalies.count() == 0
    frame = metering([usage("B", h, "0.3", "0.3", D(0)) for h in range(3)])
    jobs.run_cycle(frame, root, as_of=hour(3))
    jobs.run_cycle(metering([usage("B", 3, "0.3", "0.3", D(0))]), root, as_of=hour(4))
    (tmp_path / "audit_log" / "version=2" / "_SUCCESS").unlink()
    assert jobs.state_version(spark, root) == 1
    assert jobs.load_state(spark, root).anomalies.count() == 3
    assert jobs.run_cycle(metering([usage("B", 3, "0.3", "0.3", D(0))]), root, as_of=hour(4)).anomalies.count() == 4
    assert jobs.state_version(spark, root) == 2


def test_missing_values_stop_the_write(spark, metering, tmp_path):
    row = list(usage("A", 0, "0.2", "0.2", D(0)))
    row[0] = None
    with pytest.raises(Exception, match="anomaly_start must not be null"):
        jobs.rebuild_state(metering([tuple(row)]), str(tmp_path), 1, as_of=AS_OF)


def test_shared_folder_follows_the_setting(spark):
    configured = spark.conf.get("spark.checkpoint.dir", None)
    folder = session.shared_folder(spark)
    assert folder == configured.rstrip("/") if configured else folder == session.shared_folder(spark)
