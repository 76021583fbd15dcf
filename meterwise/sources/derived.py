"""Domain tables derived from the given test tables, as described in FIXTURES.md."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterwise.functions import constants as K
from meterwise.functions.expressions import hour_number, moment
from meterwise.schemas import METERING, QUERY_HISTORY, WAREHOUSES, conform

AS_OF = dt.datetime(2024, 1, 31)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def warehouse_of(bucket: Column) -> Column:
    prefix = F.when(bucket % 4 == 3, "ETL_WH_").otherwise("WH_")
    return F.concat(prefix, F.lpad(bucket.cast("string"), 9, "0"))


def _credits(cents: Column) -> Column:
    return (cents.cast("decimal(18,4)") / 10000).cast("decimal(18,9)")


def _usage_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id",
        "user_id",
        "event_type",
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("user_id").alias("bucket"),
        F.floor(F.col("value") * 100 + 0.5).alias("cents"),
    )


def metering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per warehouse and hour; error events stand for cloud-services cost, all others for compute."""
    is_cloud = F.col("event_type") == "error"
    hourly = (
        _usage_events(spark, sf_dir)
        .groupBy("bucket", hour_number(F.col("ts")).alias("hour"))
        .agg(
            F.coalesce(F.sum(F.when(~is_cloud, F.col("cents"))), F.lit(0)).alias("compute"),
            F.coalesce(F.sum(F.when(is_cloud, F.col("cents"))), F.lit(0)).alias("cloud"),
        )
    )
    return conform(
        hourly.withColumn("start_time", F.timestamp_seconds(F.col("hour") * 3600)).select(
            "start_time",
            (F.col("start_time") + F.expr("interval 1 hour")).alias("end_time"),
            F.col("bucket").alias("warehouse_id"),
            warehouse_of(F.col("bucket")).alias("warehouse_name"),
            _credits(F.col("compute") + F.col("cloud")).alias("credits_used"),
            _credits(F.col("compute")).alias("credits_used_compute"),
            _credits(F.col("cloud")).alias("credits_used_cloud_services"),
        ),
        METERING,
    )


def query_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One query per event."""
    return conform(
        _usage_events(spark, sf_dir).select(
            F.col("event_id").alias("query_id"),
            warehouse_of(F.col("bucket")).alias("warehouse_name"),
            F.concat(F.lit("USER_"), F.col("user_id").cast("string")).alias("user_name"),
            F.concat(F.lit("ROLE_"), (F.col("user_id") % 5).cast("string")).alias("role_name"),
            F.col("ts").alias("start_time"),
            _credits(F.col("cents")).alias("credits_used_cloud_services"),
        ),
        QUERY_HISTORY,
    )


def warehouses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One warehouse per customer; there are ten customers for each user with metering rows."""
    key = F.col("c_custkey")
    size = F.element_at(F.array(*map(F.lit, ("X-Small", "Small", "Medium", "Large", "X-Large"))), (F.col("c_nationkey") % 5 + 1).cast("int"))
    return conform(
        table(spark, sf_dir, "customer").select(
            warehouse_of(key).alias("name"),
            F.when(key % 3 == 0, "SUSPENDED").otherwise("STARTED").alias("state"),
            size.alias("size"),
            F.lit("STANDARD").alias("type"),
            F.when(key % 7 != 3, (key % 25) * 60).alias("auto_suspend"),
            (key % 4 != 0).cast("string").alias("auto_resume"),
            (key % 2).alias("running"),
            (key % 5).alias("queued"),
        ),
        WAREHOUSES,
    )


def approvals(pending: DataFrame) -> DataFrame:
    """Approval requests: every pending anomaly with an even id."""
    return pending.filter(F.col("anomaly_id") % 2 == 0).select(
        "anomaly_id", F.lit("alice").alias("approved_by"), moment(AS_OF).alias("requested_at")
    )


def approval_requests(anomalies: DataFrame) -> DataFrame:
    """Requests for anomalies with an even id, some of them twice, some without a name, some for ids that do not exist."""
    key = F.col("anomaly_id")

    def asked(rows: DataFrame, id: Column, name: Column, minutes: int) -> DataFrame:
        return rows.select(
            id.alias("anomaly_id"), name.cast("string").alias("approved_by"),
            (moment(AS_OF) + F.make_dt_interval(mins=F.lit(minutes))).alias("requested_at"),
        )

    return (
        asked(anomalies.filter(key % 2 == 0), key, F.lit("alice"), 0)
        .unionByName(asked(anomalies.filter(key % 6 == 0), key, F.lit("carol"), -5))
        .unionByName(asked(anomalies.filter(key % 4 == 0), key, F.lit(None), -9))
        .unionByName(asked(anomalies.filter(key % 5 == 1), key, F.lit(None), 0))
        .unionByName(asked(anomalies.filter(key % 50 == 0), -key, F.lit("dave"), 0))
    )


def dismissals(pending: DataFrame) -> DataFrame:
    """Dismiss requests: every pending anomaly whose id ends in 1."""
    return pending.filter(F.col("anomaly_id") % 10 == 1).select(
        "anomaly_id", F.lit("bob").alias("dismissed_by"), moment(AS_OF).alias("requested_at")
    )


# --- alert rules: one per supplier, so that the rule table grows with the data ---------------------------------

_PERIODS = {
    "daily_spend": "spend in dollars per day",
    "weekly_spend": "spend in dollars per week",
    "credits_per_hour": "credits per hour",
    "idle_minutes": "idle minutes per day",
    "query_count": "queries per day",
}


def _pick(index: Column, values: tuple[str, ...]) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (index + 1).cast("int"))


def alert_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(alert_id, rule, metric, threshold, warehouse, condition): what each supplier would ask to be told about."""
    key = F.col("s_suppkey")
    metric = _pick(key % 5, K.ALERT_METRICS)
    # Thresholds up to 400, taken from the cents of the balance; for query counts whole numbers below 20.
    cents = F.abs(F.round(F.col("s_acctbal") * 100).cast("bigint"))
    threshold = F.when(key % 5 == 4, cents % 20).otherwise((cents % 40000) / 100.0)
    warehouse = F.when(key % 7 == 0, K.ANY_WAREHOUSE).otherwise(warehouse_of(F.col("s_nationkey")))
    rules = table(spark, sf_dir, "supplier").select(
        key.alias("alert_id"),
        metric.alias("metric"),
        threshold.cast("double").alias("threshold"),
        warehouse.alias("warehouse"),
        _pick((key / 5).cast("bigint") % 3, K.ALERT_CONDITIONS).alias("condition"),
    )
    what = _pick(F.array_position(F.array(*map(F.lit, K.ALERT_METRICS)), F.col("metric")) - 1, tuple(_PERIODS.values()))
    where = F.when(F.col("warehouse") == K.ANY_WAREHOUSE, "any warehouse").otherwise(F.col("warehouse"))
    rule = F.concat(
        F.lit("Notify me if "), where, F.lit(" has "), what, F.lit(" "),
        F.regexp_replace("condition", "_", " "), F.lit(" "),
        F.col("threshold").cast("decimal(18,2)").cast("string"),
    )
    return rules.withColumn("rule", rule)


def alert_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(alert_id, rule, response): model answers of seven shapes, from clean JSON to text without any."""
    rules = alert_rules(spark, sf_dir)
    limit = F.col("threshold").cast("decimal(18,2)").cast("string")

    def members(**parts: Column) -> Column:
        pairs = [F.concat(F.lit(f'"{name}": '), value) for name, value in parts.items()]
        return F.concat(F.lit("{"), F.concat_ws(", ", *pairs), F.lit("}"))

    def quoted(name: str) -> Column:
        return F.concat(F.lit('"'), F.col(name), F.lit('"'))

    clean = members(
        metric=quoted("metric"), threshold=limit, warehouse=quoted("warehouse"), condition=quoted("condition")
    )
    prose = F.concat(F.lit("Sure, here is the rule:\n"), clean, F.lit("\nLet me know."))
    partial = members(metric=quoted("metric"), threshold=limit)
    text_number = members(
        metric=quoted("metric"), threshold=F.concat(F.lit('"'), limit, F.lit('"')), warehouse=quoted("warehouse")
    )
    bad_number = members(metric=quoted("metric"), threshold=F.lit('"a lot"'))
    malformed = F.concat(F.lit('{"metric": '), F.col("metric"), F.lit(", oops}"))
    shapes = (clean, prose, partial, text_number, bad_number, malformed, F.lit("I cannot help with that."))
    shape = F.col("alert_id") % 8
    response = F.when(shape == 0, shapes[0])
    for number, text in enumerate(shapes[1:], start=1):
        response = response.when(shape == number, text)
    return rules.select("alert_id", "rule", response.otherwise(F.lit("{}")).alias("response"))
