"""Column layouts of the tables the library reads and keeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CREDITS = T.DecimalType(18, 9)


def _table(*fields: tuple[str, T.DataType, bool]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, nullable) for name, kind, nullable in fields])


METERING = _table(
    ("start_time", T.TimestampType(), True),
    ("end_time", T.TimestampType(), True),
    ("warehouse_id", T.LongType(), True),
    ("warehouse_name", T.StringType(), True),
    ("credits_used", CREDITS, True),
    ("credits_used_compute", CREDITS, True),
    ("credits_used_cloud_services", CREDITS, True),
)

ANOMALIES = _table(
    ("anomaly_id", T.LongType(), False),
    ("warehouse_name", T.StringType(), False),
    ("detected_at", T.TimestampType(), True),
    ("anomaly_start", T.TimestampType(), False),
    ("anomaly_end", T.TimestampType(), True),
    ("anomaly_type", T.StringType(), False),
    ("severity", T.StringType(), False),
    ("credits_wasted", CREDITS, True),
    ("description", T.StringType(), True),
    ("suggested_fix", T.StringType(), True),
    ("status", T.StringType(), True),
    ("resolved_at", T.TimestampType(), True),
    ("resolved_by", T.StringType(), True),
)

AUDIT_LOG = _table(
    ("log_id", T.LongType(), False),
    ("logged_at", T.TimestampType(), True),
    ("action_type", T.StringType(), False),
    ("anomaly_id", T.LongType(), True),
    ("warehouse_name", T.StringType(), True),
    ("action_details", T.StringType(), False),
    ("sql_executed", T.StringType(), True),
    ("approved_by", T.StringType(), True),
    ("status", T.StringType(), True),
    ("error_message", T.StringType(), True),
)

WAREHOUSES = _table(
    ("name", T.StringType(), False),
    ("state", T.StringType(), True),
    ("size", T.StringType(), True),
    ("type", T.StringType(), True),
    ("auto_suspend", T.IntegerType(), True),
    ("auto_resume", T.StringType(), True),
    ("running", T.IntegerType(), True),
    ("queued", T.IntegerType(), True),
)

QUERY_HISTORY = _table(
    ("query_id", T.LongType(), False),
    ("warehouse_name", T.StringType(), True),
    ("user_name", T.StringType(), True),
    ("role_name", T.StringType(), True),
    ("start_time", T.TimestampType(), True),
    ("credits_used_cloud_services", CREDITS, True),
)

SAVINGS_HISTORY = _table(
    ("snapshot_date", T.DateType(), False),
    ("dollar_saved", T.DecimalType(18, 2), True),
)

SMART_ALERTS = _table(
    ("alert_id", T.LongType(), False),
    ("natural_language_rule", T.StringType(), True),
    ("parsed_metric", T.StringType(), True),
    ("parsed_threshold", T.DoubleType(), True),
    ("parsed_warehouse", T.StringType(), True),
    ("parsed_condition", T.StringType(), True),
    ("is_active", T.BooleanType(), True),
    ("created_at", T.TimestampType(), True),
    ("trigger_count", T.LongType(), True),
    ("evaluated_until", T.TimestampType(), True),
)

NOTIFICATIONS = _table(
    ("notification_id", T.LongType(), False),
    ("created_at", T.TimestampType(), True),
    ("notification_type", T.StringType(), True),
    ("title", T.StringType(), True),
    ("message", T.StringType(), True),
    ("warehouse_name", T.StringType(), True),
    ("is_read", T.BooleanType(), True),
)


def conform(df: DataFrame, schema: T.StructType, **defaults: Column) -> DataFrame:
    """Project ``df`` onto ``schema``: same columns, order and types; a missing column takes its default, or null."""
    present = set(df.columns)
    return df.select(
        *[
            (F.col(f.name) if f.name in present else defaults.get(f.name, F.lit(None)))
            .cast(f.dataType)
            .alias(f.name)
            for f in schema.fields
        ]
    )


def checked(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Fail the job, naming the column, if a column that must not be null is. For frames about to be written."""
    required = [f.name for f in schema.fields if not f.nullable]
    return df.withColumns(
        {
            name: F.when(F.col(name).isNull(), F.raise_error(F.lit(f"{name} must not be null"))).otherwise(F.col(name))
            for name in required
        }
    )
