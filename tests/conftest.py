import datetime as dt
import sys
from decimal import Decimal
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from meterwise.schemas import ANOMALIES, AUDIT_LOG, METERING, QUERY_HISTORY, WAREHOUSES  # noqa: E402
from meterwise.session import build_session  # noqa: E402

AS_OF = dt.datetime(2024, 1, 31)
START = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "local[8]", "meterwise-tests", **{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "4"}
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def hour(n: int) -> dt.datetime:
    return START + dt.timedelta(hours=n)


def usage(warehouse: str, at: int, used, cloud="0", compute=None, warehouse_id: int = 1) -> tuple:
    """One metering row ``at`` hours after the start."""
    used = None if used is None else Decimal(str(used))
    cloud = Decimal(str(cloud))
    if compute is None:
        compute = None if used is None else used - cloud
    return (hour(at), hour(at + 1), warehouse_id, warehouse, used, compute, cloud)


@pytest.fixture
def metering(spark):
    return lambda rows: spark.createDataFrame(rows, METERING)


@pytest.fixture
def anomalies(spark):
    def make(rows):
        """rows: dicts with any of the table's columns; the rest takes usual values."""
        usual = dict(
            warehouse_name="WH", detected_at=hour(1), anomaly_start=hour(0), anomaly_end=hour(1),
            anomaly_type="IDLE_COMPUTE", severity="LOW", credits_wasted=Decimal("0.05"), description="d",
            suggested_fix="s", status="OPEN", resolved_at=None, resolved_by=None,
        )
        full = [{**usual, "anomaly_id": i, **row} for i, row in enumerate(rows, start=1)]
        return spark.createDataFrame([tuple(row[name] for name in ANOMALIES.names) for row in full], ANOMALIES)

    return make


@pytest.fixture
def empty_log(spark):
    return spark.createDataFrame([], AUDIT_LOG)


@pytest.fixture
def inventory(spark):
    def make(rows):
        usual = dict(
            name="WH", state="STARTED", size="Small", type="STANDARD", auto_suspend=60, auto_resume="true", running=1,
            queued=0,
        )
        full = [{**usual, **row} for row in rows]
        return spark.createDataFrame([tuple(row[name] for name in WAREHOUSES.names) for row in full], WAREHOUSES)

    return make


@pytest.fixture
def history(spark):
    """rows: (query_id, warehouse, user, role, start, credits)"""
    return lambda rows: spark.createDataFrame([(*r[:5], Decimal(str(r[5]))) for r in rows], QUERY_HISTORY)


def by(rows, *names):
    """Collected rows as tuples of the named columns, sorted."""
    return sorted(tuple(row[name] for name in names) for row in rows.collect())
