"""Idle-hour and cost-spike detection over metering rows."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterwise.functions import constants as K
from meterwise.functions import expressions as X
from meterwise.functions import wording as T
from meterwise.operators.baseline import CHUNK_HOURS, COUNT, ROWS, SUM, latest_rows, rolling_baseline
from meterwise.operators.identity import highest
from meterwise.schemas import ANOMALIES, AUDIT_LOG, conform
from meterwise.sources.metering import lookback_bound, scan_metering

Moment = dt.datetime | str | Column

SPIKE_COLUMNS = ("warehouse_name", "start_time", "end_time", "credits_used")


def _as_anomalies(rows: DataFrame, kind: str, detected_at: Moment, **columns: Column) -> DataFrame:
    """Shape detected rows as OPEN anomalies without an id."""
    shaped = rows.select(
        "warehouse_name",
        X.moment(detected_at).alias("detected_at"),
        F.col("start_time").alias("anomaly_start"),
        F.col("end_time").alias("anomaly_end"),
        F.lit(kind).alias("anomaly_type"),
        *[value.alias(name) for name, value in columns.items()],
        F.lit(K.OPEN).alias("status"),
    )
    return conform(shaped, ANOMALIES).drop("anomaly_id")


def exclude_logged(candidates: DataFrame, existing: DataFrame | None, since: Column | None = None) -> DataFrame:
    """Drop candidates already logged for the same warehouse, start and type, whatever became of them since.

    If no candidate began before ``since``, passing it keeps the older part of the log from being read.
    """
    if existing is None:
        return candidates
    key = ["warehouse_name", "anomaly_start", "anomaly_type"]
    if since is not None:
        existing = existing.filter(F.col("anomaly_start") >= since)
    return candidates.join(existing.select(*key), key, "left_anti").select(*candidates.columns)


def idle_rows(metering: DataFrame) -> DataFrame:
    """Hours in which a warehouse cost something without computing anything."""
    return metering.filter((F.col("credits_used_compute") == 0) & (F.col("credits_used_cloud_services") > 0))


def detect_idle(
    metering: DataFrame,
    existing: DataFrame | None = None,
    *,
    as_of: Moment | None = None,
    lookback_hours: int | None = K.LOOKBACK_HOURS,
    exclude: Sequence[str] = (K.PSEUDO_WAREHOUSE,),
    detected_at: Moment | None = None,
) -> DataFrame:
    """New idle anomalies. ``lookback_hours=None, exclude=()`` scans everything. A map-only job up to the anti join."""
    rows = idle_rows(scan_metering(metering, as_of=as_of, lookback_hours=lookback_hours, exclude=exclude))
    cloud = F.col("credits_used_cloud_services")
    words = {
        "warehouse": F.col("warehouse_name"),
        "start": X.minute_text(F.col("start_time")),
        "end": X.minute_text(F.col("end_time")),
        "credits": X.decimal_text(cloud, 6),
    }
    found = _as_anomalies(
        rows,
        K.IDLE_COMPUTE,
        _detection_time(detected_at, as_of),
        severity=X.idle_severity(cloud),
        credits_wasted=cloud,
        description=T.fill(T.IDLE_DESCRIPTION, **words),
        suggested_fix=T.fill(T.IDLE_SUGGESTION, **words),
    )
    return exclude_logged(found, existing, None if lookback_hours is None else lookback_bound(as_of, lookback_hours))


def spike_rows(baselined: DataFrame, threshold: Decimal | float = K.SPIKE_THRESHOLD) -> DataFrame:
    """Rows whose usage is at least ``threshold`` times the average of the (two or three) rows before."""
    bound = Decimal(str(threshold))
    return baselined.filter(
        (F.col(ROWS) >= K.BASELINE_MIN_ROWS)
        & (F.col(SUM) > 0)
        & X.ratio_exceeds(F.col("credits_used"), F.col(SUM), F.col(COUNT), bound, inclusive=True)
    )


def spikes_as_anomalies(spikes: DataFrame, detected_at: Moment) -> DataFrame:
    used, total, count = F.col("credits_used"), F.col(SUM), F.col(COUNT)
    average = X.baseline_average(total, count)
    return _as_anomalies(
        spikes,
        K.COST_SPIKE,
        detected_at,
        severity=X.spike_severity(used, total, count),
        credits_wasted=F.round(used - average, 9),
        description=T.fill(
            T.SPIKE_DESCRIPTION,
            warehouse=F.col("warehouse_name"),
            start=X.minute_text(F.col("start_time")),
            used=X.decimal_text(used, 3),
            average=X.decimal_text(average, 3),
            ratio=X.decimal_text(X.usage_ratio(used, total, count), 1),
        ),
        suggested_fix=T.fill(
            T.SPIKE_SUGGESTION,
            warehouse=F.col("warehouse_name"),
            start=X.clock_text(F.col("start_time")),
            end=X.clock_text(F.col("end_time")),
        ),
    )


def detect_cost_spike(
    metering: DataFrame,
    existing: DataFrame | None = None,
    *,
    threshold: Decimal | float = K.SPIKE_THRESHOLD,
    as_of: Moment | None = None,
    lookback_hours: int | None = None,
    detected_at: Moment | None = None,
    context: DataFrame | None = None,
    chunk_hours: int = CHUNK_HOURS,
    bounds: DataFrame | None = None,
) -> DataFrame:
    """New cost spikes. ``bounds`` of ``baseline.chunk_bounds`` spread a scan of everything over crowded warehouses, too.

    With a lookback, only the rows inside it are judged, against a baseline that may reach back before it: for that
    the last three earlier rows of each warehouse are enough. They are looked up in the older rows, of which only
    three per warehouse and task are shuffled; a job that keeps them (``latest_rows`` of its last run) can pass them
    as ``context``, and the older rows are not read at all.
    """
    since = None
    if lookback_hours is None:
        baselined = rolling_baseline(metering.select(*SPIKE_COLUMNS), chunk_hours, bounds=bounds)
    else:
        since = lookback_bound(as_of, lookback_hours)
        recent = scan_metering(metering, as_of=as_of, lookback_hours=lookback_hours).select(*SPIKE_COLUMNS)
        older = (metering if context is None else context).filter(F.col("start_time") < since).select(*SPIKE_COLUMNS)
        baselined = rolling_baseline(recent.unionByName(latest_rows(older)), chunk_hours)
        baselined = baselined.filter(F.col("start_time") >= since)
    found = spikes_as_anomalies(spike_rows(baselined, threshold), _detection_time(detected_at, as_of))
    return exclude_logged(found, existing, since)


def _detection_time(detected_at: Moment | None, as_of: Moment | None) -> Moment:
    if detected_at is not None:
        return detected_at
    if as_of is not None:
        return as_of
    raise ValueError("give detected_at or as_of: detection never reads the wall clock")


# --- scan reports -----------------------------------------------------------------------------------------------

_SCAN_TEXTS = {
    "idle": (T.IDLE_SCAN_AUDIT, T.IDLE_SCAN_RESULT),
    "idle_full": (T.IDLE_FULL_SCAN_AUDIT, T.IDLE_FULL_SCAN_RESULT),
    "spike": (T.SPIKE_SCAN_AUDIT, T.SPIKE_SCAN_RESULT),
}


def scan_audit(
    new: DataFrame, scan: str, *, at: Moment, parameter: object = "", log_id: Column | int = 1
) -> DataFrame:
    """The one audit row of a scan (``idle``, ``idle_full`` or ``spike``), with the number of anomalies it found."""
    words = {"rows": F.col("rows"), "parameter": F.lit(str(parameter))}
    row = new.agg(F.count(F.lit(1)).alias("rows")).select(
        (log_id if isinstance(log_id, Column) else F.lit(log_id)).alias("log_id"),
        X.moment(at).alias("logged_at"),
        F.lit(K.DETECTION).alias("action_type"),
        T.fill(_SCAN_TEXTS[scan][0], **words).alias("action_details"),
        F.lit(K.COMPLETED).alias("status"),
    )
    return conform(row, AUDIT_LOG)


def scan_result(new: DataFrame, scan: str) -> DataFrame:
    """The message a scan answers with."""
    return new.agg(F.count(F.lit(1)).alias("rows")).select(
        T.fill(_SCAN_TEXTS[scan][1], rows=F.col("rows")).alias("message")
    )


def append_scan_audit(audit_log: DataFrame, new: DataFrame, scan: str, *, at: Moment, parameter: object = "") -> DataFrame:
    """The audit log with the row of one more scan."""
    row = scan_audit(new, scan, at=at, parameter=parameter, log_id=highest(audit_log, "log_id") + 1)
    return audit_log.unionByName(row)
