"""The chunked baseline against a plain loop."""

import random
from decimal import Decimal as D

import pytest
from conftest import AS_OF, usage
from pyspark.sql import functions as F

from meterwise.operators.baseline import chunk_bounds, latest_rows, rolling_baseline
from meterwise.plans import jobs


def expected(rows):
    result = {}
    for name in {r[3] for r in rows}:
        own = sorted((r for r in rows if r[3] == name), key=lambda r: r[0])
        for i, row in enumerate(own):
            before = own[max(0, i - 3) : i]
            known = [r[4] for r in before if r[4] is not None]
            result[name, row[0]] = (sum(known) if known else None, len(known), len(before))
    return result


def actual(frame):
    return {
        (r.warehouse_name, r.start_time): (r.baseline_sum, r.baseline_count, r.preceding_rows) for r in frame.collect()
    }


@pytest.fixture(scope="module")
def uneven():
    """Warehouses with gaps of all lengths, single rows, dense runs, missing values, and one with half of all rows."""
    rng = random.Random(7)
    rows = [usage("HOT", h, rng.randint(0, 50), "0") for h in range(1500)]
    for n in range(60):
        reach = rng.choice([5, 30, 200, 3000])
        hours = sorted(rng.sample(range(reach), rng.randint(1, min(reach, 40))))
        for h in hours:
            value = None if rng.random() < 0.05 else D(rng.randint(0, 10**6)) / 10**4
            rows.append(usage(f"W{n:02d}", h, value, "0"))
    return rows


@pytest.mark.parametrize("chunk_hours", [1, 2, 5, 24, 10**6])
def test_chunk_width_does_not_matter(metering, uneven, chunk_hours):
    assert actual(rolling_baseline(metering(uneven), chunk_hours)) == expected(uneven)


def test_all_columns_are_kept(metering):
    frame = metering([usage("A", 0, 1), usage("A", 1, 2)])
    out = rolling_baseline(frame)
    assert out.columns == [*frame.columns, "baseline_sum", "baseline_count", "preceding_rows"]


def test_rows_not_hours(metering):
    """Over a gap of weeks the baseline still holds the last three rows."""
    rows = [usage("A", 0, 1), usage("A", 1, 2), usage("A", 700, 9), usage("A", 5000, 4)]
    assert actual(rolling_baseline(metering(rows)))["A", rows[3][0]] == (D(12), 3, 3)


def test_repeated_start_times_all_survive(metering):
    rows = [usage("A", 0, 1)] * 2 + [usage("A", 0, 5), usage("A", 1, 7)]
    out = rolling_baseline(metering(rows)).orderBy("start_time", "credits_used").collect()
    assert [(r.credits_used, r.baseline_sum) for r in out] == [(1, None), (1, 1), (5, 2), (7, 7)]


def test_ties_lose_no_row(metering):
    """Rows that differ only in how their credits split still come out once each."""
    rows = [usage("A", 0, 2, D(n) / 100, 2 - D(n) / 100) for n in range(40)]
    out = rolling_baseline(metering(rows).repartition(8))
    assert sorted(r.credits_used_cloud_services for r in out.collect()) == [D(n) / 100 for n in range(40)]


def test_hot_warehouse_is_split(metering, uneven):
    """The window per warehouse sees a filtered few rows; the window over all rows is split by time as well."""
    lines = rolling_baseline(metering(uneven))._jdf.queryExecution().optimizedPlan().toString().splitlines()
    windows = [i for i, line in enumerate(lines) if "Window [" in line]
    per_warehouse = [i for i in windows if "_chunk" not in lines[i]]
    assert len(windows) == 3 and len(per_warehouse) == 1
    # Directly below the window per warehouse: the first or last rows of a chunk only.
    assert any("Filter" in line and "<= 3" in line for line in lines[per_warehouse[0] + 1 : per_warehouse[0] + 3])


def test_latest_rows(metering, uneven):
    out = latest_rows(metering(uneven))
    found = {}
    for r in out.collect():
        found.setdefault(r.warehouse_name, set()).add(r.start_time)
    for name in {r[3] for r in uneven}:
        assert found[name] == set(sorted(r[0] for r in uneven if r[3] == name)[-3:])
    assert "WindowGroupLimit" in out._jdf.queryExecution().executedPlan().toString()


def test_crowded_chunks_are_cut_at_quantiles(spark):
    """One warehouse has a million rows inside an hour: no window sees a tenth of them, and nothing changes."""
    n = 1_000_000
    rows = spark.range(n).select(
        F.when(F.col("id") % 50 == 0, "SMALL").otherwise("HOT").alias("warehouse_name"),
        F.timestamp_micros(F.lit(1_704_067_200_000_000) + F.col("id") * 3600).alias("start_time"),
        (F.col("id") * 7919 % 101).cast("decimal(18,9)").alias("credits_used"),
    )
    assert chunk_bounds(rows, n) is None
    bounds = chunk_bounds(rows, 50_000)
    cut = bounds.collect()
    assert [r.warehouse_name for r in cut] == ["HOT"] and 19 <= len(cut[0]["_bounds"]) <= 20
    piece = F.size(F.filter(F.col("_bounds"), lambda b: b < F.unix_micros("start_time"))).alias("piece")
    sizes = rows.join(bounds, "warehouse_name").groupBy(piece).count().agg(F.max("count")).first()[0]
    assert sizes < 60_000
    columns = ("warehouse_name", "start_time", "baseline_sum", "baseline_count", "preceding_rows")
    plain, spread = rolling_baseline(rows).select(*columns), rolling_baseline(rows, bounds=bounds).select(*columns)
    assert spread.count() == n and spread.exceptAll(plain).count() == 0


def test_bounds_with_gaps_ties_and_a_rebuild(spark, metering, tmp_path):
    rows = [usage(w, h // 2 * 2 if w == "B" else h * h, 3 + h * 7 % 11) for h in range(60) for w in ("A", "B", "C")]
    frame = metering(rows)
    bounds = chunk_bounds(frame, 5)
    plain = rolling_baseline(frame)
    assert rolling_baseline(frame, bounds=bounds).exceptAll(plain).count() == 0
    assert chunk_bounds(metering([]), 5) is None
    state = jobs.rebuild_state(frame, str(tmp_path / "a"), as_of=AS_OF, rows_per_chunk=5)
    whole = jobs.rebuild_state(frame, str(tmp_path / "b"), as_of=AS_OF)
    assert state.anomalies.exceptAll(whole.anomalies).count() == 0 == whole.anomalies.exceptAll(state.anomalies).count()
