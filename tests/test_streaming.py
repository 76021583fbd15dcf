import random
from decimal import Decimal as D

import pytest
from conftest import AS_OF, by, usage
from pyspark.sql import functions as F

from meterwise.functions import constants as K
from meterwise.operators import detection
from meterwise.plans import jobs
from meterwise.schemas import METERING
from meterwise.sources import snapshots
from meterwise.sources.metering import write_metering
from meterwise.streaming import hourly
from meterwise.streaming.hourly import HourlyMonitor, metering_stream

KEY = ("anomaly_id", "warehouse_name", "anomaly_start", "anomaly_type", "severity", "credits_wasted", "status")


def all_rows():
    """Five days of three warehouses with idle hours, spikes and, for one, gaps that cross the arrivals below."""
    rows = []
    for h in range(120):
        rows.append(usage("A", h, 40 if h % 17 == 16 else 2 + h % 3))
        rows.append(usage("B", h, "0.3", "0.3", D(0)) if h % 5 == 0 else usage("B", h, 1))
        if h % 20 < 2:
            rows.append(usage("SPARSE", h, 9 if h > 80 else 1))
    return rows


@pytest.fixture
def run(spark, metering, tmp_path):
    """Append rows to the incoming folder, let the monitor catch up, return it."""

    def go(rows, **options):
        if rows:
            metering(rows).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        usual = dict(detected_at=F.col("end_time"), applied_at=F.col("detected_at"), as_of=AS_OF)
        monitor = HourlyMonitor(str(tmp_path / "out"), **{**usual, **options})
        monitor.start(metering_stream(spark, str(tmp_path / "in"), max_files_per_trigger=1)).awaitTermination()
        return monitor

    return go


def split(rows, *bounds):
    hours = [(r[0] - rows[0][0]).total_seconds() / 3600 for r in rows]
    edges = [0, *bounds, 10**6]
    return [[r for r, h in zip(rows, hours, strict=True) if a <= h < b] for a, b in zip(edges, edges[1:], strict=False)]


def test_stream_equals_batch(spark, metering, run):
    rows = all_rows()
    for part in split(rows, 24, 48, 96):
        monitor = run(part, fix=True)
    batch = jobs.detect_and_fix(
        metering(rows), as_of=AS_OF, detected_at=F.col("end_time"), applied_at=F.col("detected_at")
    )
    assert batch.anomalies.filter("anomaly_type = 'COST_SPIKE' and warehouse_name = 'SPARSE'").count() > 0
    assert by(monitor.anomalies(spark), *KEY, "resolved_at") == by(batch.anomalies, *KEY, "resolved_at")
    log = monitor.audit_log(spark)
    assert log.filter("action_type = 'DETECTION'").count() == 8
    assert [r.log_id for r in log.orderBy("log_id").collect()] == list(range(1, log.count() + 1))
    assert log.count() == 8 + batch.anomalies.count()
    assert monitor.late_rows(spark).count() == 0


def test_one_hour_at_a_time(spark, metering, run):
    rows = [usage("A", h, v) for h, v in enumerate([1, 1, 9, 1, 30])]
    for row in rows:
        monitor = run([row], kinds=(K.COST_SPIKE,))
    expected = detection.detect_cost_spike(metering(rows), as_of=AS_OF)
    assert by(monitor.detected(spark), "anomaly_start", "credits_wasted") == by(expected, "anomaly_start", "credits_wasted")


def test_rows_delivered_twice_are_logged_once(spark, run):
    idle = [usage("B", h, "0.3", "0.3", D(0)) for h in range(4)]
    run(idle[:3] + idle[:1], kinds=(K.IDLE_COMPUTE,))
    monitor = run(idle[1:], kinds=(K.IDLE_COMPUTE,))
    assert by(monitor.detected(spark), "anomaly_id") == [(1,), (2,), (3,), (4,)]
    assert len({r.anomaly_start for r in monitor.detected(spark).collect()}) == 4


def test_late_rows_are_kept_and_still_judged_as_idle(spark, metering, run):
    rows = [usage("A", h, 1) for h in (0, 1, 2, 4)]
    late = [usage("A", 3, "0.5", "0.5", D(0))]
    run(rows)
    monitor = run(late)
    assert by(monitor.late_rows(spark), "start_time") == [(late[0][0],)]
    assert by(monitor.detected(spark), "anomaly_type", "anomaly_start") == [("IDLE_COMPUTE", late[0][0])]
    idle, spikes = jobs.detect_all(metering(rows + late), monitor.detected(spark), detected_at=AS_OF)
    assert idle.count() == 0 and spikes.count() == 0


JUDGED = ("warehouse_name", "anomaly_start", "anomaly_type", "severity", "credits_wasted", "description")


def test_late_rows_give_what_a_batch_job_gives(spark, metering, run):
    """Rows in random order over four arrivals, with gaps of days, equal times and repeats."""
    rng = random.Random(4)
    rows = []
    for warehouse in "ABCD":
        at = 0
        while at < 400:
            at += rng.choice([0, 1, 1, 2, 5, 30, 90])
            rows.append(usage(warehouse, at, rng.choice([1, 2, 3, 9, 30]), rng.choice([0, 1])))
    parts = [[] for _ in range(4)]
    for row in rows:
        parts[rng.randrange(4)].append(row)
    parts[2] += parts[0][:7]
    for part in parts:
        monitor = run(part, fix=True)
    idle, spikes = jobs.detect_all(metering(rows).distinct(), detected_at=AS_OF)
    assert by(monitor.anomalies(spark), *JUDGED) == by(idle.unionByName(spikes), *JUDGED)
    assert monitor.withdrawn(spark).count() > 0 and monitor.late_rows(spark).count() > 20
    ids = [r.anomaly_id for r in monitor.anomalies(spark).collect()]
    assert len(ids) == len(set(ids))
    assert monitor.anomalies(spark).filter("status in ('OPEN')").count() == 0


def test_a_late_row_withdraws_and_adds(spark, run):
    """Hour 4 is a spike over 1, 1, 1; the late hour 3 lifts its baseline and is a spike itself."""
    run([usage("A", h, v) for h, v in ((0, 1), (1, 1), (2, 1), (4, 5))], kinds=(K.COST_SPIKE,))
    monitor = run([usage("A", 3, 20)], kinds=(K.COST_SPIKE,))
    assert by(monitor.anomalies(spark), "anomaly_id", "anomaly_start") == [(2, usage("A", 3, 1)[0])]
    assert by(monitor.withdrawn(spark), "anomaly_id") == [(1,)]


def test_a_late_row_reads_only_the_days_around_it(spark, metering, run, monkeypatch):
    run([usage("A", h, 1) for h in range(24 * 12)], kinds=(K.COST_SPIKE,))
    asked = []
    real = hourly.read_days

    def watch(session, path, schema, days=None, before=None):
        if path.endswith("/rows") and days is not None:
            asked.append(len(set(days)))
        return real(session, path, schema, days, before)

    monkeypatch.setattr(hourly, "read_days", watch)
    run([usage("A", 24 * 5 + 7, 2)], kinds=(K.COST_SPIKE,))
    assert asked and max(asked) <= 3


@pytest.mark.parametrize("within", [None, "30 days"])
def test_repeats_are_dropped_and_rows_that_differ_are_kept(spark, metering, run, within):
    idle = [usage("B", h, "0.3", "0.3", D(0)) for h in range(4)]
    other = usage("B", 1, "0.4", "0.4", D(0))
    options = dict(kinds=(K.IDLE_COMPUTE,), repeats_within=within)
    run(idle, **options)
    monitor = run([*idle[1:3], other], **options)
    whole, _ = jobs.detect_all(metering([*idle, other]), detected_at=AS_OF)
    assert by(monitor.anomalies(spark), *JUDGED) == by(whole, *JUDGED)
    assert monitor.anomalies(spark).count() == 5


def test_a_repeated_batch_changes_nothing(spark, metering, run, tmp_path):
    first, second = split(all_rows(), 48)
    run(first, fix=True)
    monitor = run(second, fix=True)
    before = by(monitor.anomalies(spark), *KEY), by(monitor.audit_log(spark), "log_id", "action_details")
    monitor.process(metering(second), 1)
    assert (by(monitor.anomalies(spark), *KEY), by(monitor.audit_log(spark), "log_id", "action_details")) == before


def test_an_empty_trigger_starts_no_batch(spark, run):
    monitor = run([usage("B", 0, "0.3", "0.3", D(0))])
    run([])
    assert snapshots.committed_versions(spark, monitor.folder, "carry") == [0]


def test_stream_reads_the_table_layout(spark, metering, tmp_path):
    """A table written by day can be streamed as it is."""
    rows = all_rows()
    write_metering(metering(rows), str(tmp_path / "in"))
    stream = metering_stream(spark, str(tmp_path / "in"))
    assert stream.schema.names[: len(METERING)] == METERING.names
    monitor = HourlyMonitor(str(tmp_path / "out"), detected_at=AS_OF)
    monitor.start(stream).awaitTermination()
    idle, spikes = jobs.detect_all(metering(rows), detected_at=AS_OF)
    assert monitor.detected(spark).count() == idle.count() + spikes.count() > 0


def test_what_a_late_row_changes_is_judged_once(spark, run, monkeypatch):
    """The baseline of a batch with late rows is computed once per row, and the batch leaves none of its steps behind."""
    rows = [usage("A", h, 1) for h in range(48)]
    run(rows, kinds=(K.COST_SPIKE,))
    calls = spark.sparkContext.accumulator(0)

    @F.udf("boolean")
    def judged(at):
        calls.add(1)
        return True

    real = hourly.rolling_baseline
    monkeypatch.setattr(hourly, "rolling_baseline", lambda *a, **k: real(*a, **k).filter(judged.asNondeterministic()("start_time")))
    monitor = run([usage("A", 20, 9)], kinds=(K.COST_SPIKE,))
    # Once with the 48 rows of its day and the next, once among the three carried rows.
    assert 0 < calls.value <= 49 + 4
    assert monitor.late_rows(spark).count() == 1
    folders = snapshots._file_system(spark, f"{monitor.folder}/work-*")
    assert not folders[1].globStatus(folders[0])
