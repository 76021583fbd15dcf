"""Rolling usage baseline per warehouse, safe against a warehouse that holds most of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterwise.functions import constants as K

SUM, COUNT, ROWS = "baseline_sum", "baseline_count", "preceding_rows"
# Three days of hourly rows: the rows at chunk edges, which are shuffled again, are then a twelfth of all.
CHUNK_HOURS = 72
_CHUNK, _POSITION, _LAST, _BOUNDS = "_chunk", "_position", "_last", "_bounds"


def _time_order(metering: DataFrame) -> list[str]:
    """Time first, then every other column: rows that still tie are equal, so that it does not matter which is which.

    Start times are normally unique. The rest makes repeated ones come out the same way whenever they are sorted.
    """
    rest = [
        f.name
        for f in metering.schema.fields
        if f.name not in ("start_time", "warehouse_name") and not isinstance(f.dataType, T.MapType)
    ]
    return ["start_time", *rest]


def _baseline(window, more: dict[str, Column]) -> dict[str, Column]:
    frame = window.rowsBetween(-K.BASELINE_ROWS, -1)
    return {
        **{name: total.over(frame) for name, total in more.items()},
        SUM: F.sum("credits_used").over(frame),
        COUNT: F.count("credits_used").over(frame),
        ROWS: F.count(F.lit(1)).over(frame),
    }


def rolling_baseline(
    metering: DataFrame, chunk_hours: int = CHUNK_HOURS, more: dict[str, Column] | None = None, bounds: DataFrame | None = None
) -> DataFrame:
    """Add sum, non-null count and row count of ``credits_used`` over the three rows before each row.

    ``more`` names further aggregates of the same three rows.

    The frame counts rows, not hours: over a gap it reaches further back. One window per warehouse would put a
    warehouse with a third of all rows into one task, so the window runs per (warehouse, time chunk) instead. It is
    complete for every row but the first three of a chunk. Those get their values from a second window per warehouse
    that sees only the first and last three rows of each chunk: at most six rows per chunk however many rows the
    chunk has. Between the last three rows of one chunk and the first three of the next nothing is missing, so the
    second window is exact for them, gaps and short chunks included. All columns take part in the sort; select the ones
    needed before.

    ``bounds`` (see :func:`chunk_bounds`) cuts the chunks that hold very many rows further, at times with about as many rows
    between them.
    """
    chunked = metering.withColumn(_CHUNK, F.floor(F.unix_seconds("start_time") / F.lit(chunk_hours * 3600)))
    if bounds is not None:
        chunked = chunked.join(bounds, ["warehouse_name", _CHUNK], "left")
        piece = F.size(F.filter(F.coalesce(_BOUNDS, F.array()), lambda b: b < F.unix_micros("start_time")))
        chunked = chunked.withColumn(_CHUNK, F.struct(F.col(_CHUNK).alias("chunk"), piece.alias("piece"))).drop(_BOUNDS)
    in_time = [F.asc_nulls_last(name) for name in _time_order(metering)]
    within = W.partitionBy("warehouse_name", _CHUNK).orderBy(*in_time)
    position = F.row_number().over(within)
    more = more or {}
    body = chunked.withColumns({**_baseline(within, more), _POSITION: position}).filter(F.col(_POSITION) > K.BASELINE_ROWS)

    is_last = F.lead(F.lit(1), K.BASELINE_ROWS).over(within).isNull()
    edges = chunked.withColumns({_POSITION: position, _LAST: is_last}).filter(
        (F.col(_POSITION) <= K.BASELINE_ROWS) | F.col(_LAST)
    )
    across = W.partitionBy("warehouse_name").orderBy(*in_time)
    heads = edges.withColumns(_baseline(across, more)).filter(F.col(_POSITION) <= K.BASELINE_ROWS)
    columns = [*metering.columns, SUM, COUNT, ROWS, *more]
    return body.select(*columns).unionByName(heads.select(*columns))


def chunk_bounds(metering: DataFrame, rows_per_chunk: int = 2_000_000, chunk_hours: int = CHUNK_HOURS) -> DataFrame | None:
    """Where chunks of more than ``rows_per_chunk`` rows are to be cut: (warehouse_name, chunk, times), or nothing if none is.

    Rows are counted per warehouse and chunk, combined before the shuffle. Of the crowded chunks, of which there are no more
    than rows / rows_per_chunk, quantiles of the time are taken as bounds; one number, the largest count, comes to the driver.
    Rows of one and the same instant stay together.
    """
    chunk = F.floor(F.unix_seconds("start_time") / F.lit(chunk_hours * 3600)).alias(_CHUNK)
    counted = metering.groupBy("warehouse_name", chunk).agg(F.count(F.lit(1)).alias("n"))
    most = counted.agg(F.max("n")).first()[0] or 0
    if most <= rows_per_chunk:
        return None
    pieces = -(-most // rows_per_chunk)
    crowded = counted.filter(F.col("n") > rows_per_chunk).drop("n")
    rows = metering.select("warehouse_name", chunk, F.unix_micros("start_time").alias("at")).join(crowded, ["warehouse_name", _CHUNK], "left_semi")
    shares = [i / pieces for i in range(1, pieces)]
    return rows.groupBy("warehouse_name", _CHUNK).agg(F.array_distinct(F.percentile_approx("at", shares, 100 * pieces)).alias(_BOUNDS))


def latest_rows(metering: DataFrame, rows: int = K.BASELINE_ROWS) -> DataFrame:
    """The newest ``rows`` rows of every warehouse.

    Spark applies a rank limit before the shuffle as well, so each task sends on at most ``rows`` rows per warehouse.
    """
    newest_first = W.partitionBy("warehouse_name").orderBy(*map(F.desc_nulls_first, _time_order(metering)))
    return metering.withColumn("_rank", F.row_number().over(newest_first)).filter(F.col("_rank") <= rows).drop("_rank")
