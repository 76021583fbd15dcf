import random

from conftest import by, hour
from pyspark.sql import functions as F

from meterwise.operators import identity


def test_ids_are_dense_ordered_by_day_and_stable(spark, anomalies):
    rng = random.Random(3)
    starts = [(f"W{rng.randint(0, 9)}", hour(h)) for h in rng.sample(range(5000), 400)]
    frame = anomalies([{"warehouse_name": w, "anomaly_start": s} for w, s in starts]).drop("anomaly_id")
    numbered = identity.assign_anomaly_ids(frame, after=100)
    rows = numbered.collect()
    assert sorted(r.anomaly_id for r in rows) == list(range(101, 501))
    days = [r.anomaly_start.date() for r in sorted(rows, key=lambda r: r.anomaly_id)]
    assert days == sorted(days)
    again = identity.assign_anomaly_ids(frame.repartition(7), after=100)
    key = ("warehouse_name", "anomaly_start", "anomaly_id")
    assert by(again, *key) == by(numbered, *key)


def test_one_full_day_is_split_into_cells(spark, anomalies):
    frame = anomalies([{"warehouse_name": f"W{i}", "anomaly_start": hour(3)} for i in range(300)]).drop("anomaly_id")
    rows = identity.assign_anomaly_ids(frame).collect()
    assert sorted(r.anomaly_id for r in rows) == list(range(1, 301))


def test_only_bounded_counts_are_ordered_in_one_task(anomalies):
    plan = identity.assign_anomaly_ids(anomalies([{}, {}]).drop("anomaly_id"))._jdf.queryExecution().executedPlan()
    single = plan.toString().count("Exchange SinglePartition")
    assert single == 1


def test_ids_along_a_sparse_key(spark):
    keys = [5, 1023, 1024, 1 << 20, (1 << 20) + 1, 1 << 40]
    frame = spark.createDataFrame([(k,) for k in keys], "k long")
    assert by(identity.assign_ids_along(frame, "id", "k", after=10), "id", "k") == list(zip(range(11, 17), keys, strict=True))


def test_shifted_ids_need_no_shuffle(spark, tmp_path):
    spark.createDataFrame([(k,) for k in (7, 8, 11)], "k long").write.parquet(str(tmp_path / "t"))
    frame = spark.read.parquet(str(tmp_path / "t"))
    shifted = identity.shift_ids(frame, "id", "k", after=identity.highest(frame, "k"))
    assert by(shifted, "k", "id") == [(7, 12), (8, 13), (11, 16)]
    assert "hashpartitioning" not in shifted._jdf.queryExecution().executedPlan().toString()


def test_highest_of_nothing_is_zero(spark):
    frame = spark.range(1).select(identity.highest(spark.range(0), "id").alias("h"), F.lit(1).alias("one"))
    assert frame.first().h == 0
