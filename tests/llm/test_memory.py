"""What Python workers hold: slices of bounded size, chunks of the fit, memory given back at a task's end."""

import random
import tracemalloc

import pyarrow as pa
import pytest

from meterwise.llm import common, toxicity


def test_slices_of_a_batch_are_small():
    batch = pa.RecordBatch.from_pydict({"id": list(range(60)), "text": ["x" * 20_000] * 59 + ["y" * 900_000]})
    parts = list(common.row_slices(batch, "text"))
    assert pa.Table.from_batches(parts).equals(pa.Table.from_batches([batch]))
    assert max(sum(map(len, p.column(1).to_pylist())) for p in parts[:-1]) <= 1 << 18 and parts[-1].num_rows == 1


def test_a_task_gives_memory_back_at_its_end(monkeypatch):
    calls = []
    monkeypatch.setattr(common, "release", lambda: calls.append("released"))
    assert list(common.releasing(iter)([1, 2])) == [1, 2] and len(calls) == 1
    stopped = common.releasing(iter)([1, 2])
    next(stopped)
    stopped.close()
    assert len(calls) == 2
    with pytest.raises(ZeroDivisionError):
        list(common.releasing(lambda batches: (1 // b for b in batches))([0]))
    assert len(calls) == 3


def test_fit_works_chunk_by_chunk(monkeypatch):
    """Some 1.2 million features; beside them (4 bytes each) a chunk is worked on at a time."""
    monkeypatch.setattr(toxicity, "BITS", 12)
    rng = random.Random(1)
    texts = ["".join(rng.choices("abcdefghijklmnop ", k=3000)) + " bad" * (i % 2) for i in range(500)]
    tracemalloc.start()
    picked, weights, _ = toxicity.fit(texts, [i % 2 for i in range(500)])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(picked) and weights.any()
    assert peak < 80e6
