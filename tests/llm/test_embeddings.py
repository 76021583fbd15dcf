"""Near-duplicate vectors against the full matrix of cosines, and the bounds of quantised products."""

import numpy as np
import pytest
from plain import components
from pyspark.sql import functions as F

from meterwise.llm import embeddings, registry
from meterwise.llm.components import components as graph_components

SCHEMA = "vec_id long, embedding array<float>, n_links string, rep int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, "clash", 0) for i, v in rows], SCHEMA).repartition(3)


def brute(rows, threshold=0.95):
    """Rows with distinct ids or equal vectors."""
    good = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = [(a, b) for k, (a, x) in enumerate(good) for b, y in good[:k] if len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= threshold]
    root = components({i for i, _ in rows if i is not None}, links)
    degree = {}
    for a, b in links:
        degree[a], degree[b] = degree.get(a, 0) + 1, degree.get(b, 0) + 1
    return sorted(((i, degree.get(i, 0), root.get(i), i is not None and root[i] == i) for i, _ in rows), key=str)


def run(frame, **options):
    return sorted((tuple(r) for r in embeddings.near_duplicates(frame, **options).collect()), key=str)


@pytest.mark.parametrize("block", [7, 10_000])
def test_against_all_pairs(spark, block):
    rng = np.random.default_rng(block)
    rows = []
    for i in range(120):
        base = rng.normal(size=16) if i < 20 else np.array(rows[rng.integers(20)][1]) + rng.normal(size=16) * rng.choice([0, 0.05, 0.2, 0.3])
        rows.append((i, [float(x) for x in np.float32(base * rng.choice([1, 7]))]))
    assert run(table(spark, rows), block=block) == brute(rows)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0, 1.0]), (8, [1e30, 1e30]), (9, [1e-30, 1e-30]),
        (10, [1.0, 1.0, 1.0]), (11, [-1.0, -1.0]), (12, [2.0, 2.0, 2.0]), (13, [5.0]), (14, [1.0]), (None, [1.0, 1.0]), (15, [1.0, 1.0]),
    ]
    assert run(table(spark, rows)) == brute(rows)


def test_many_copies(spark):
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(500)] + [(500 + i, [1.0, 2.0, 3.0 + i / 100]) for i in range(5)] + [(600, [-1.0, 0.0, 0.0])]
    assert run(table(spark, rows)) == brute(rows)


def test_no_vectors(spark):
    assert run(table(spark, [])) == [] and run(table(spark, [(1, None)])) == [(1, 0, 1, True)]


def test_product_bound_holds():
    """No pair is farther from its quantised product than the bound says, also with one very large component."""
    rng = np.random.default_rng(1)
    for spread in (1, 50):
        v = rng.normal(size=(300, 24))
        v[:, 0] *= spread
        q = embeddings.Quantised(v)
        product = (q.code.astype(float) @ q.code.T.astype(float)) * q.scale[:, None] * q.scale
        e = q.error
        assert (np.abs(q.unit @ q.unit.T - product) <= e[:, None] + e + e[:, None] * e + 1e-12).all()


def test_components(spark):
    rng = np.random.default_rng(3)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(1000 + i, 1001 + i) for i in range(64)] + [(5000, i) for i in range(2000, 2300)]
    edges = spark.createDataFrame([*links, (7, 7), *links[:20]], "a long, b long").unionByName(spark.range(1).select(F.lit(None).cast("long").alias("a"), F.lit(4).cast("long").alias("b")))
    got = {r.node: r.component for r in graph_components(edges).collect()}
    want = components({n for link in links for n in link}, links)
    assert got == {n: c for n, c in want.items() if any(n in link and link[0] != link[1] for link in links)}


def test_query(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    assert run_query(spark) == brute(rows)


def run_query(spark):
    return sorted((tuple(r) for r in registry.op7_near_embeddings(spark, "/root/testdata/sf0.001").collect()), key=str)
