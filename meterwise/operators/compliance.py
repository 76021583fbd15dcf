"""Policy checks over the warehouse inventory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterwise.functions import compliance_texts as C
from meterwise.functions import constants as K
from meterwise.functions import expressions as X
from meterwise.functions import wording as T


def _suspend() -> Column:
    return F.coalesce(F.col("auto_suspend"), F.lit(0))


def _suspend_ok() -> Column:
    return _suspend() <= 300


def _resume_ok() -> Column:
    return F.coalesce(F.lower(F.col("auto_resume").cast("string")) == "true", F.lit(False))


def _size_ok() -> Column:
    oversize = F.col("size").isin(*K.OVERSIZE) & ~F.upper("name").contains("ETL")
    return ~F.coalesce(oversize, F.lit(False))


def _finding(
    passed: Column, check: str, status: str, severity: Column, current: Column, advice: str, fix: str
) -> Column:
    return F.struct(
        passed.alias("passed"),
        F.lit(check).alias("check_name"),
        F.lit(status).alias("status"),
        severity.alias("severity"),
        current.alias("current_value"),
        F.lit(advice).alias("recommended"),
        T.fill(fix, warehouse=F.col("name")).alias("fix"),
    )


def compliance_findings(warehouses: DataFrame) -> DataFrame:
    """One row per failed check. All three checks are made in one pass over the inventory, without a shuffle."""
    checks = F.array(
        _finding(
            _suspend_ok(),
            C.SUSPEND_CHECK,
            "FAIL",
            F.when(_suspend() > 600, K.HIGH).otherwise(K.MEDIUM),
            F.concat(_suspend().cast("string"), F.lit("s")),
            C.SUSPEND_ADVICE,
            T.IDLE_FIX,
        ),
        _finding(_resume_ok(), C.RESUME_CHECK, "FAIL", F.lit(K.LOW), F.lit("false"), C.RESUME_ADVICE, T.RESUME_FIX),
        _finding(_size_ok(), C.SIZE_CHECK, "WARN", F.lit(K.MEDIUM), F.col("size"), C.SIZE_ADVICE, T.OVERSIZE_FIX),
    )
    failed = F.filter(checks, lambda check: ~check["passed"])
    return (
        warehouses.select(F.col("name").alias("warehouse_name"), F.explode(failed).alias("f"))
        .select("warehouse_name", "f.*")
        .drop("passed")
    )


def compliance_score(warehouses: DataFrame) -> DataFrame:
    """Passed and total checks, and the share passed as a whole percentage; 100 without any warehouse."""
    passed = sum((F.count_if(ok) for ok in (_resume_ok(), _size_ok())), F.count_if(_suspend_ok()))
    counts = warehouses.agg(passed.alias("checks_passed"), (F.count(F.lit(1)) * 3).alias("checks_total"))
    score = F.coalesce(F.floor(F.col("checks_passed") * 100 / F.nullif(F.col("checks_total"), F.lit(0))), F.lit(100))
    return counts.select(
        "checks_passed",
        "checks_total",
        (F.col("checks_total") - F.col("checks_passed")).alias("issues_found"),
        score.cast("bigint").alias("score"),
        X.score_band(score).alias("band"),
    )
