"""The hourly scans as a Structured Streaming job.

Each micro-batch runs the batch operators inside ``foreachBatch``. What one batch must know of the earlier ones lies in the
shared folder, written by batch N and read by batch N + 1, so a repeated batch reads and overwrites exactly what it did before:

* ``rows``: the metering rows received, a directory per day and batch;
* ``carry``: the last three rows of every warehouse, for the baseline of the rows that follow;
* ``activity``: rows per warehouse and day, to know which days surround a late row;
* ``anomalies`` (a directory per day and batch), ``audit_log``, ``withdrawn``, and the last ids given.

The steps of a batch lie in ``work-N`` until it ends.

A row delivered again is dropped: either by Spark's own state (``repeats_within``, a watermark and
``dropDuplicatesWithinWatermark``), or else by comparing with the received rows of its day, however late it is. Rows that differ
are all judged, as a batch job would. A late row, that is one which arrives after newer ones of its warehouse, changes its own
baseline and that of the next three rows. These are read again with the rows around them, from their days only, and judged
anew; what differs from the log is added or withdrawn. So the anomalies that stand are at any time those of a batch job over all
rows received.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from meterwise.functions import constants as K
from meterwise.functions.expressions import moment
from meterwise.operators import detection as D
from meterwise.operators.baseline import latest_rows, rolling_baseline
from meterwise.operators.detection import Moment
from meterwise.operators.remediation import fix_anomalies, fix_audit
from meterwise.plans.jobs import number_anomalies, scan_rows
from meterwise.schemas import ANOMALIES, AUDIT_LOG, METERING, checked, conform
from meterwise.sources.days import BATCH, DAY, day_of, days_in, read_days, write_days
from meterwise.sources.marks import read_mark, write_mark
from meterwise.sources.snapshots import read_all_versions, read_version, remove, write_version

_LATE, _SEEN, _NEAR, _OLD, _AFTER, _TURN = "_late", "_seen", "_near", "_old", "_after", "_turn"
#: What makes a spike the same as one that is logged.
_JUDGED = ("warehouse_name", "anomaly_start", "anomaly_end", "severity", "credits_wasted", "description", _TURN)
_ROWS = T.StructType([*METERING.fields, T.StructField(_LATE, T.BooleanType())])
_ACTIVITY = T.StructType([METERING["warehouse_name"], T.StructField(DAY, T.DateType()), T.StructField("n", T.LongType())])
_WITHDRAWN = T.StructType([ANOMALIES["anomaly_id"], T.StructField("withdrawn_at", T.TimestampType())])


def metering_stream(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Metering files as a stream, in the order in which they were written."""
    reader = spark.readStream.schema(METERING)
    if max_files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.parquet(path)


def _same(left: DataFrame, right: DataFrame, columns: Sequence[str]) -> Column:
    """Equality in all columns, nulls included."""
    met = F.lit(True)
    for name in columns:
        met = met & left[name].eqNullSafe(right[name])
    return met


class HourlyMonitor:
    """Detection, and optionally fixes, over a stream of metering rows.

    ``folder`` must be reachable by all executors. Times default to the batch's processing time; pass columns of the
    metering row (``detected_at``) or of the anomaly (``applied_at``) to derive them from the data. With ``repeats_within`` (an
    interval such as ``"10 days"``) repeated rows are dropped by the stream's state store, which forgets after that time and then
    also drops rows that are later than that; without it no row is too late.
    """

    def __init__(
        self,
        folder: str,
        *,
        kinds: Sequence[str] = (K.IDLE_COMPUTE, K.COST_SPIKE),
        fix: bool = False,
        threshold: Decimal | float = K.SPIKE_THRESHOLD,
        detected_at: Moment | None = None,
        applied_at: Moment | None = None,
        as_of: Moment | None = None,
        repeats_within: str | None = None,
    ):
        self.folder = folder.rstrip("/")
        self.kinds = tuple(kinds)
        self.fix = fix
        self.threshold = threshold
        self.repeats_within = repeats_within
        self._times = detected_at, applied_at, as_of

    def start(self, stream: DataFrame, processing_time: str | None = None) -> StreamingQuery:
        """Start the query: everything available now and then stop, or one batch per ``processing_time``."""
        if self.repeats_within:
            stream = conform(stream, METERING).withWatermark("start_time", self.repeats_within)
            stream = stream.dropDuplicatesWithinWatermark()
        writer = stream.writeStream.foreachBatch(self.process).option("checkpointLocation", f"{self.folder}/checkpoint")
        trigger = {"processingTime": processing_time} if processing_time else {"availableNow": True}
        return writer.trigger(**trigger).start()

    # --- what the monitor has found ---

    def anomalies(self, spark: SparkSession) -> DataFrame:
        """The anomalies that stand, after their fixes (with ``fix``)."""
        done = self._progress(spark)
        logged = read_days(spark, f"{self.folder}/anomalies", ANOMALIES, before=done["batch"] + 1)
        return conform(self._standing(spark, logged, done["batch"] + 1), ANOMALIES)

    def detected(self, spark: SparkSession) -> DataFrame:
        """The same as they were detected."""
        if not self.fix:
            return self.anomalies(spark)
        none = {"status": F.lit(K.OPEN), "resolved_at": F.lit(None), "resolved_by": F.lit(None)}
        return conform(self.anomalies(spark).withColumns(none), ANOMALIES)

    def audit_log(self, spark: SparkSession) -> DataFrame:
        """All audit rows; those of anomalies withdrawn later stay."""
        return read_all_versions(spark, self.folder, "audit_log", AUDIT_LOG)

    def withdrawn(self, spark: SparkSession) -> DataFrame:
        """Ids of anomalies that late rows have shown to be none, or to be others."""
        return read_all_versions(spark, self.folder, "withdrawn", _WITHDRAWN)

    def late_rows(self, spark: SparkSession) -> DataFrame:
        """Rows that came after newer ones of their warehouse."""
        rows = read_days(spark, f"{self.folder}/rows", _ROWS, before=self._progress(spark)["batch"] + 1)
        return conform(rows.filter(_LATE), METERING)

    def _progress(self, spark: SparkSession, batch_id: int | None = None) -> dict:
        """Number of the last batch that ended, or of the one before ``batch_id``, and the last ids it has given."""
        name = "progress" if batch_id is None else f"progress-{batch_id - 1}"
        return read_mark(spark, f"{self.folder}/{name}.json") or {"batch": -1, "anomaly": 0, "log": 0}

    def _standing(self, spark: SparkSession, logged: DataFrame, before: int) -> DataFrame:
        gone = read_all_versions(spark, self.folder, "withdrawn", _WITHDRAWN, before=before)
        return logged.join(gone, "anomaly_id", "left_anti")

    # --- one batch ---

    def process(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        detected_at, applied_at, as_of = (F.current_timestamp() if t is None else t for t in self._times)
        last = self._progress(spark, batch_id)
        if batch_id:
            carried = read_version(spark, self.folder, "carry", batch_id - 1, METERING)
        else:
            carried = spark.createDataFrame([], METERING)
        work = f"{self.folder}/work-{batch_id}"

        def keep(frame: DataFrame, name: str) -> DataFrame:
            # Written rather than cached: what follows reads files, so no step is computed twice and plans stay short.
            return write_version(frame, work, name, 1)

        rows, late = self._received(batch, carried, batch_id, keep)
        write_days(rows.drop(DAY), f"{self.folder}/rows", "start_time", batch_id)
        write_version(conform(latest_rows(conform(rows, METERING).unionByName(carried)), METERING), self.folder, "carry", batch_id)
        active = rows.groupBy("warehouse_name", DAY).agg(F.count(F.lit(1)).alias("n"))
        write_version(active, self.folder, "activity", batch_id)
        found = []
        if K.IDLE_COMPUTE in self.kinds:
            found.append(D.detect_idle(conform(rows, METERING), lookback_hours=None, exclude=(), detected_at=detected_at))
        if K.COST_SPIKE in self.kinds:
            found.append(D.spikes_as_anomalies(self._timely_spikes(rows, carried), detected_at))
            if late:
                added, gone = self._corrections(rows, batch_id, detected_at, keep)
                found.append(added)
                write_version(conform(gone.withColumn("withdrawn_at", moment(as_of)), _WITHDRAWN), self.folder, "withdrawn", batch_id)
        # Numbering reads its input more than once.
        everything = keep(reduce(DataFrame.unionByName, found), "found")
        new = keep(checked(number_anomalies(everything, last["anomaly"]), ANOMALIES), "new")
        write_days(fix_anomalies(new, applied_at) if self.fix else new, f"{self.folder}/anomalies", "anomaly_start", batch_id)
        n = new.count()
        if self.fix:
            log = scan_rows(new, self.threshold, as_of, last["log"]).unionByName(fix_audit(new, applied_at, last["log"] + 2))
            write_version(log, self.folder, "audit_log", batch_id)
        done = {"batch": batch_id, "anomaly": last["anomaly"] + n, "log": last["log"] + (2 + n if self.fix else 0)}
        for name in (f"progress-{batch_id}", "progress"):
            write_mark(spark, f"{self.folder}/{name}.json", done)
        remove(spark, work)

    def _received(self, batch: DataFrame, carried: DataFrame, batch_id: int, keep) -> tuple[DataFrame, int]:
        """The batch's rows without those received before, with their day and whether they are late; and how many are."""
        seen = carried.groupBy("warehouse_name").agg(F.max("start_time").alias(_SEEN))
        marked = conform(batch, METERING).distinct().join(seen, "warehouse_name", "left")
        is_late = F.coalesce(F.col("start_time") <= F.col(_SEEN), F.lit(False))
        rows = keep(marked.withColumns({_LATE: is_late, DAY: day_of("start_time")}).select(*METERING.names, _LATE, DAY), "received")
        late = rows.filter(_LATE)
        count = late.count()
        if count and not self.repeats_within:
            # A row received before is not newer than all of its warehouse, so only late rows can be repeats.
            known = read_days(batch.sparkSession, f"{self.folder}/rows", _ROWS, days_in(late), before=batch_id)
            fresh = late.join(known, _same(late, known, METERING.names), "left_anti")
            rows = keep(rows.filter(~F.col(_LATE)).unionByName(conform(fresh, rows.schema)), "fresh")
            count = rows.filter(_LATE).count()
        return rows, count

    def _timely_spikes(self, rows: DataFrame, carried: DataFrame) -> DataFrame:
        """Spikes among the rows that are newer than all before, late rows being part of their baseline."""
        mine = rows.withColumn(_OLD, F.col(_LATE)).select(*D.SPIKE_COLUMNS, _OLD)
        before = carried.withColumn(_OLD, F.lit(True)).select(*D.SPIKE_COLUMNS, _OLD)
        return D.spike_rows(rolling_baseline(mine.unionByName(before)).filter(~F.col(_OLD)), self.threshold)

    def _corrections(self, rows: DataFrame, batch_id: int, detected_at: Moment, keep) -> tuple[DataFrame, DataFrame]:
        """Spikes to be added for the late rows and the three rows after each, and the ids of logged ones that are none now.

        Only the days around the late rows are read: those between which and a late row's day lie fewer than three rows of the
        warehouse.
        """
        spark = rows.sparkSession
        late = rows.filter(_LATE)
        active = read_all_versions(spark, self.folder, "activity", _ACTIVITY, before=batch_id + 1)
        active = active.join(late.select("warehouse_name").distinct(), "warehouse_name", "left_semi")
        active = active.groupBy("warehouse_name", DAY).agg(F.sum("n").alias("n"))
        marked = active.join(late.select("warehouse_name", DAY).distinct().withColumn(_NEAR, F.lit(True)), ["warehouse_name", DAY], "left")
        in_time = W.partitionBy("warehouse_name").orderBy(DAY)
        through = F.sum("n").over(in_time.rowsBetween(W.unboundedPreceding, 0))
        placed = marked.withColumns({"_through": through, "_before": through - F.col("n")})
        next_late = F.first(F.when(F.col(_NEAR), F.col("_before")), ignorenulls=True).over(in_time.rowsBetween(1, W.unboundedFollowing))
        last_late = F.last(F.when(F.col(_NEAR), F.col("_through")), ignorenulls=True).over(in_time.rowsBetween(W.unboundedPreceding, -1))
        placed = placed.withColumns({"_ahead": next_late - F.col("_through"), "_behind": F.col("_before") - last_late})
        close = lambda gap: F.coalesce(F.col(gap) < K.BASELINE_ROWS, F.lit(False))
        needed = placed.filter(F.col(_NEAR).isNotNull() | close("_ahead") | close("_behind")).select("warehouse_name", DAY)
        needed = keep(needed, "needed")
        days = days_in(needed)

        around = read_days(spark, f"{self.folder}/rows", _ROWS, days, before=batch_id + 1).join(needed, ["warehouse_name", DAY], "left_semi")
        mine = F.col(BATCH) == batch_id
        around = around.withColumns({_NEAR: mine & F.col(_LATE), _OLD: ~mine | F.col(_LATE)}).select(*D.SPIKE_COLUMNS, _NEAR, _OLD)
        # Read once: the baseline goes over its rows twice.
        around = keep(around, "around")
        judged = keep(rolling_baseline(around, more={_AFTER: F.max(_NEAR)}).filter(_OLD), "judged")
        # All rows of an hour are judged together, as the log does not tell them apart.
        changed = judged.filter(F.col(_NEAR) | F.coalesce(F.col(_AFTER), F.lit(False))).select("warehouse_name", "start_time").distinct()
        changed = keep(changed, "changed")
        judged = judged.join(changed, ["warehouse_name", "start_time"], "left_semi")
        spikes = D.spikes_as_anomalies(D.spike_rows(judged, self.threshold), detected_at)

        logged = self._standing(spark, read_days(spark, f"{self.folder}/anomalies", ANOMALIES, days, before=batch_id), batch_id)
        keys = changed.withColumnRenamed("start_time", "anomaly_start")
        logged = logged.filter(F.col("anomaly_type") == K.COST_SPIKE).join(keys, ["warehouse_name", "anomaly_start"], "left_semi")
        # Rows that differ in nothing a spike shows are told apart by number.
        turn = lambda order: F.row_number().over(W.partitionBy(*_JUDGED[:-1]).orderBy(order))
        spikes = keep(spikes.withColumn(_TURN, turn("detected_at")), "spikes")
        logged = keep(logged.withColumn(_TURN, turn("anomaly_id")), "logged")
        added = spikes.join(logged, _same(spikes, logged, _JUDGED), "left_anti").drop(_TURN)
        return added, logged.join(spikes, _same(logged, spikes, _JUDGED), "left_anti").select("anomaly_id")
