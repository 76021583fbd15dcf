"""Dense row ids without sorting the whole table in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from meterwise.functions.expressions import day_number

_RANGE, _CELL, _OFFSET, _RANK = "_range", "_cell", "_offset", "_rank"
_ID_RANGE = 1 << 20


def assign_ids(
    df: DataFrame,
    id_column: str,
    order_by: Sequence[str | Column],
    *,
    coarse: Column,
    fine: Column,
    after: Column | int = 0,
) -> DataFrame:
    """Number the rows 1, 2, 3, ... in the order (coarse, fine, order_by), starting behind ``after``.

    Rows are ranked inside (coarse, fine) cells, in parallel. The number of rows before a cell is a running total
    over cell counts: first inside each coarse range, then over one row per range. Only that last total is computed
    in a single task, so choose ``coarse`` with a bounded number of values (days, or blocks of an id) and ``fine``
    with enough values to split the fullest range. Everything depends on the data alone, so a recomputed task
    assigns the same ids.
    """
    placed = df.withColumns({_RANGE: coarse, _CELL: fine})
    cells = placed.groupBy(_RANGE, _CELL).agg(F.count(F.lit(1)).alias("_n"))

    inside = W.partitionBy(_RANGE).orderBy(_CELL).rowsBetween(W.unboundedPreceding, -1)
    cell_offsets = cells.select(_RANGE, _CELL, F.coalesce(F.sum("_n").over(inside), F.lit(0)).alias("_in_range"))

    before = W.orderBy(_RANGE).rowsBetween(W.unboundedPreceding, -1)
    range_offsets = (
        cells.groupBy(_RANGE)
        .agg(F.sum("_n").alias("_n"))
        .select(_RANGE, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before_range"))
    )
    offsets = cell_offsets.join(range_offsets, _RANGE).select(
        _RANGE, _CELL, (F.col("_in_range") + F.col("_before_range")).alias(_OFFSET)
    )

    rank = F.row_number().over(W.partitionBy(_RANGE, _CELL).orderBy(*order_by))
    start = after if isinstance(after, Column) else F.lit(after)
    return (
        placed.withColumn(_RANK, rank)
        .join(offsets, [_RANGE, _CELL])
        .withColumn(id_column, (start + F.col(_OFFSET) + F.col(_RANK)).cast("bigint"))
        .drop(_RANGE, _CELL, _OFFSET, _RANK)
    )


def assign_anomaly_ids(anomalies: DataFrame, after: Column | int = 0) -> DataFrame:
    """Ids in order of the day an anomaly began. Cells are (day, one of 256 hash buckets of warehouse and hour)."""
    seconds = F.coalesce(F.unix_seconds("anomaly_start"), F.lit(-1))
    bucket = F.substring(F.md5(F.concat_ws("|", "warehouse_name", seconds.cast("string"))), 1, 2)
    return assign_ids(
        anomalies,
        "anomaly_id",
        ["warehouse_name", "anomaly_start", "anomaly_type"],
        coarse=day_number(F.col("anomaly_start")),
        fine=bucket,
        after=after,
    )


def assign_ids_along(df: DataFrame, id_column: str, key: str, after: Column | int = 0) -> DataFrame:
    """Dense ids in the order of a numeric key that is itself an id; cells are blocks of about a thousand keys."""
    return assign_ids(
        df,
        id_column,
        [key],
        coarse=F.floor(F.col(key) / F.lit(_ID_RANGE)),
        fine=F.floor(F.col(key) / F.lit(1024)),
        after=after,
    )


def shift_ids(df: DataFrame, id_column: str, key: str, after: Column | int = 0) -> DataFrame:
    """Ids behind ``after`` at the same distances as a unique numeric key has: one per row, in order, without a shuffle.

    They are dense where the keys are. ``df`` should be read from files, as the smallest key is looked up first.
    """
    start = after if isinstance(after, Column) else F.lit(after)
    first = df.agg(F.min(key)).scalar()
    return df.withColumn(id_column, (start + F.col(key) - first + 1).cast("bigint"))


def highest(df: DataFrame, id_column: str) -> Column:
    """The largest id so far, 0 for an empty table, as a scalar subquery column."""
    return F.coalesce(df.agg(F.max(id_column)).scalar(), F.lit(0))
