"""The full detection and remediation job."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession

from meterwise.functions import constants as K
from meterwise.operators import detection as D
from meterwise.operators.baseline import chunk_bounds
from meterwise.operators.detection import Moment
from meterwise.operators.identity import assign_anomaly_ids, highest
from meterwise.operators.remediation import State, fix_anomalies, fix_audit
from meterwise.schemas import ANOMALIES, AUDIT_LOG, NOTIFICATIONS, checked, conform
from meterwise.sources.snapshots import committed_versions, read_version, write_version


def detect_all(
    metering: DataFrame,
    existing: DataFrame | None = None,
    *,
    threshold: Decimal | float = K.SPIKE_THRESHOLD,
    detected_at: Moment,
    bounds: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """New idle anomalies and new spikes of the whole metering table, without ids."""
    idle = D.detect_idle(metering, existing, lookback_hours=None, exclude=(), detected_at=detected_at)
    spikes = D.detect_cost_spike(metering, existing, threshold=threshold, detected_at=detected_at, bounds=bounds)
    return idle, spikes


def number_anomalies(found: DataFrame, after: Column | int = 0) -> DataFrame:
    return conform(assign_anomaly_ids(found, after), ANOMALIES)


def _kind(anomalies: DataFrame, kind: str) -> DataFrame:
    return anomalies.filter(anomalies["anomaly_type"] == kind)


def scan_rows(new: DataFrame, threshold: Decimal | float, at: Moment, after: Column | int = 0) -> DataFrame:
    """The audit rows of an idle scan and a spike scan that found the anomalies in ``new``."""
    idle = D.scan_audit(_kind(new, K.IDLE_COMPUTE), "idle_full", at=at, log_id=after + 1)
    spike = D.scan_audit(_kind(new, K.COST_SPIKE), "spike", at=at, parameter=threshold, log_id=after + 2)
    return idle.unionByName(spike)


def scan_rows_of(new: DataFrame, at: Moment, lookback_hours: int, after: Column | int = 0) -> DataFrame:
    """The audit rows of the two scans of the last hours that found the anomalies in ``new``."""
    idle = D.scan_audit(_kind(new, K.IDLE_COMPUTE), "idle", at=at, parameter=lookback_hours, log_id=after + 1)
    spike = D.scan_audit(_kind(new, K.COST_SPIKE), "spike", at=at, parameter=K.SPIKE_THRESHOLD, log_id=after + 2)
    return idle.unionByName(spike)


def detect_and_fix(
    metering: DataFrame,
    *,
    as_of: Moment,
    threshold: Decimal | float = K.SPIKE_THRESHOLD,
    detected_at: Moment | None = None,
    applied_at: Moment | None = None,
) -> State:
    """Everything from empty tables, as one lazy plan. For large tables prefer :func:`rebuild_state`, which detects
    once and reads the result back for each later step."""
    idle, spikes = detect_all(metering, threshold=threshold, detected_at=_or(detected_at, as_of))
    new = number_anomalies(idle.unionByName(spikes))
    return _fixed(new, threshold, as_of, _or(applied_at, as_of))


def rebuild_state(
    metering: DataFrame,
    root: str,
    version: int | None = None,
    *,
    as_of: Moment,
    threshold: Decimal | float = K.SPIKE_THRESHOLD,
    detected_at: Moment | None = None,
    applied_at: Moment | None = None,
    rows_per_chunk: int = 2_000_000,
) -> State:
    """Wipe and rebuild: a new version of the anomalies and the audit log, detected from the whole metering table, and
    one without notifications. Readers take the newest version, so the new one is above those of all tables; a
    ``version`` is given only to repeat a write that failed. Chunks of the baseline with more than ``rows_per_chunk`` rows are cut
    further."""
    if version is None:
        version = next_version(metering.sparkSession, root)
    write_version(metering.sparkSession.createDataFrame([], NOTIFICATIONS), root, "notifications", version)
    bounds = chunk_bounds(metering, rows_per_chunk)
    if bounds is not None:
        bounds = write_version(bounds, root, "chunk_bounds", version)
    idle, spikes = detect_all(metering, threshold=threshold, detected_at=_or(detected_at, as_of), bounds=bounds)
    found = write_version(idle.unionByName(spikes), root, "found", version)
    numbered = write_version(checked(number_anomalies(found), ANOMALIES), root, "detected", version)
    state = _fixed(numbered, threshold, as_of, _or(applied_at, as_of))
    return _write_state(state, root, version)


_STATE_TABLES = ("notifications", "found", "detected", "anomalies", "audit_log")


def next_version(spark: SparkSession, root: str) -> int:
    """One above the newest version of any table of the state."""
    return 1 + max((v for table in _STATE_TABLES for v in committed_versions(spark, root, table)[-1:]), default=0)


def _write_state(state: State, root: str, version: int) -> State:
    return State(
        write_version(state.anomalies, root, "anomalies", version, ("anomaly_start", "warehouse_name")),
        write_version(checked(state.audit_log, AUDIT_LOG), root, "audit_log", version, ("logged_at", "log_id")),
    )


def _or(moment: Moment | None, default: Moment) -> Moment:
    return default if moment is None else moment


def _fixed(new: DataFrame, threshold: Decimal | float, as_of: Moment, applied_at: Moment) -> State:
    scans = scan_rows(new, threshold, as_of)
    return State(fix_anomalies(new, applied_at), scans.unionByName(fix_audit(new, applied_at, after=2)))


# --- one cycle at a time ----------------------------------------------------------------------------------------


def find_new(
    metering: DataFrame, state: State, *, as_of: Moment, lookback_hours: int = K.LOOKBACK_HOURS
) -> DataFrame:
    """What the last hours hold that is not logged yet, numbered behind the anomalies there are."""
    idle = D.detect_idle(metering, state.anomalies, as_of=as_of, lookback_hours=lookback_hours)
    spikes = D.detect_cost_spike(metering, state.anomalies, as_of=as_of, lookback_hours=lookback_hours)
    return number_anomalies(idle.unionByName(spikes), highest(state.anomalies, "anomaly_id"))


def absorb(state: State, new: DataFrame, *, as_of: Moment, lookback_hours: int = K.LOOKBACK_HOURS) -> State:
    """The state with new anomalies added, the two scans logged and every open anomaly fixed, older ones included."""
    last = highest(state.audit_log, "log_id")
    scans = scan_rows_of(new, as_of, lookback_hours, last)
    everything = conform(state.anomalies, ANOMALIES).unionByName(new)
    fixes = fix_audit(everything, as_of, last + 2)
    log = conform(state.audit_log, AUDIT_LOG).unionByName(scans).unionByName(fixes)
    return State(fix_anomalies(everything, as_of), log)


def state_version(spark: SparkSession, root: str) -> int:
    """The newest version of which both tables are complete; 0 if there is none."""
    both = set(committed_versions(spark, root, "anomalies")) & set(committed_versions(spark, root, "audit_log"))
    return max(both, default=0)


def load_state(spark: SparkSession, root: str) -> State:
    version = state_version(spark, root)
    if version == 0:
        return State(spark.createDataFrame([], ANOMALIES), spark.createDataFrame([], AUDIT_LOG))
    return State(
        read_version(spark, root, "anomalies", version, ANOMALIES),
        read_version(spark, root, "audit_log", version, AUDIT_LOG),
    )


def save_state(state: State, root: str) -> State:
    """Write both tables as the next version, sorted by time, and return them as read back."""
    version = state_version(state.anomalies.sparkSession, root) + 1
    return _write_state(state, root, version)


def run_cycle(
    metering: DataFrame, root: str, *, as_of: Moment, lookback_hours: int = K.LOOKBACK_HOURS
) -> State:
    """One scheduled run on the newest state: scan, log, fix, save. The scan's result is written once and read by each
    later step. A run that fails half way leaves the state as it was and can simply be repeated."""
    spark = metering.sparkSession
    state = load_state(spark, root)
    found = find_new(metering, state, as_of=as_of, lookback_hours=lookback_hours)
    new = write_version(checked(found, ANOMALIES), root, "detected", state_version(spark, root) + 1)
    return save_state(absorb(state, new, as_of=as_of, lookback_hours=lookback_hours), root)
