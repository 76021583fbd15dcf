"""Small column expressions: severity grades, exact baseline arithmetic, text formats."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from meterwise.functions import constants as K


def moment(value: dt.datetime | str | Column) -> Column:
    """A timestamp column from a datetime, an ISO text or a column; operators never read the wall clock.

    A time without a zone is meant in the session's zone, whatever the zone of the driver's machine.
    """
    if isinstance(value, Column):
        return value.cast("timestamp")
    text = value.isoformat(sep=" ") if isinstance(value, dt.datetime) else value
    return F.lit(text).cast("timestamp")


def minute_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm")


def clock_text(ts: Column) -> Column:
    return F.date_format(ts, "HH:mm")


def decimal_text(value: Column, digits: int) -> Column:
    """Decimal rounded half up, with all ``digits`` kept: 0.05 at six digits reads 0.050000."""
    return F.round(value, digits).cast("string")


def dollars(credits: Column) -> Column:
    return credits * F.lit(K.CREDIT_RATE)


def idle_severity(cloud_credits: Column) -> Column:
    return (
        F.when(cloud_credits > F.lit(K.IDLE_HIGH_ABOVE), K.HIGH)
        .when(cloud_credits > F.lit(K.IDLE_MEDIUM_ABOVE), K.MEDIUM)
        .otherwise(K.LOW)
    )


def _small(count: Column) -> Column:
    # The baseline counts at most three rows. A one-digit decimal keeps products with credits at full scale,
    # where a bigint factor would make Spark cut decimal places.
    return count.cast("decimal(1,0)")


def _total(baseline_sum: Column) -> Column:
    return baseline_sum.cast("decimal(20,9)")


def baseline_average(baseline_sum: Column, baseline_count: Column) -> Column:
    return (baseline_sum.cast("decimal(24,13)") / F.nullif(_small(baseline_count), F.lit(0))).cast("decimal(22,13)")


def usage_ratio(used: Column, baseline_sum: Column, baseline_count: Column) -> Column:
    """used / average, as one division; null when the baseline is zero."""
    return used * _small(baseline_count) / F.nullif(_total(baseline_sum), F.lit(0).cast("decimal(20,9)"))


def ratio_exceeds(
    used: Column, baseline_sum: Column, baseline_count: Column, bound: Decimal, inclusive: bool = False
) -> Column:
    """used / average against a bound, cross-multiplied so that a ratio exactly on the bound is decided exactly."""
    left, right = used * _small(baseline_count), F.lit(bound) * _total(baseline_sum)
    return left >= right if inclusive else left > right


def spike_severity(used: Column, baseline_sum: Column, baseline_count: Column) -> Column:
    positive = baseline_sum > 0
    return (
        F.when(positive & ratio_exceeds(used, baseline_sum, baseline_count, K.SPIKE_CRITICAL_ABOVE), K.CRITICAL)
        .when(positive & ratio_exceeds(used, baseline_sum, baseline_count, K.SPIKE_HIGH_ABOVE), K.HIGH)
        .otherwise(K.MEDIUM)
    )


def day_number(ts: Column) -> Column:
    """Whole days since 1970 in UTC, whatever the session zone; -1 for a missing time."""
    return F.coalesce(F.floor(F.unix_seconds(ts) / F.lit(86400)).cast("bigint"), F.lit(-1).cast("bigint"))


def hour_number(ts: Column) -> Column:
    """Whole hours since 1970; cheaper per row than truncating in a time zone."""
    return F.floor(F.unix_seconds(ts) / F.lit(3600))


def score_band(score: Column) -> Column:
    return F.when(score >= 80, "Healthy").when(score >= 50, "Needs Attention").otherwise("Critical")


def condition_symbol(condition: Column) -> Column:
    return F.when(condition == "greater_than", ">").when(condition == "less_than", "<").otherwise("=")


def metric_class(metric: Column) -> Column:
    return (
        F.when(metric.contains("spend"), "spend")
        .when(metric.contains("idle") | metric.contains("hour"), "time")
        .otherwise("other")
    )


def age_text(then: Column, now: Column) -> Column:
    minutes = F.timestamp_diff("MINUTE", then, now)
    return (
        F.when(minutes < 60, F.concat(minutes.cast("string"), F.lit("m ago")))
        .when(minutes < 1440, F.concat(F.floor(minutes / 60).cast("string"), F.lit("h ago")))
        .otherwise(F.concat(F.floor(minutes / 1440).cast("string"), F.lit("d ago")))
    )


def badge_label(notification_type: Column) -> Column:
    return (
        F.when(notification_type == K.APPROVAL_NEEDED, "High")
        .when(notification_type == K.APPROVED, "Success")
        .when(notification_type == K.WARNING, "Warning")
        .otherwise("Info")
    )
