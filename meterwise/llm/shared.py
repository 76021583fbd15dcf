"""Which 64-bit hashes do several documents have: a filter of bounded size, from five shuffled bytes per hash and task."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.dataset
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterwise.llm.common import release, releasing, scratch

#: Bits of a filter; it is read by all tasks.
FILTER_BITS = 28
#: Bytes of a hash that are shuffled, more than the filter can tell apart.
PACKED = 5
#: Hashes of a task that are told apart at once.
COUNTED = 1_000_000


def write_filter(numbers: DataFrame, column: str) -> str:
    """Writes a filter of evenly spread 64-bit numbers as a table of words of 64 bits and returns its path; its size has a
    bound whatever their number. Tasks read it from the shared folder."""
    place = F.shiftrightunsigned(F.col(column), 64 - FILTER_BITS)
    bit = F.expr(f"shiftleft(1L, cast(shiftrightunsigned({column}, {64 - FILTER_BITS}) & 63 as int))")
    path = scratch(numbers.sparkSession, "filter")
    numbers.groupBy(F.shiftright(place, 6).cast("int").alias("word")).agg(F.bit_or(bit).alias("bits")).write.parquet(path)
    return path


class BitFilter:
    """A written filter: true for all numbers that were put in, and for some others."""

    def __init__(self, path: str) -> None:
        system, base = pyarrow.fs.FileSystem.from_uri(path)
        schema = pa.schema([("word", pa.int32()), ("bits", pa.int64())])
        table = pyarrow.dataset.dataset(base, filesystem=system, format="parquet", schema=schema).to_table()
        self.words = np.zeros(1 << (FILTER_BITS - 6), np.uint64)
        self.words[table.column("word").to_numpy()] = table.column("bits").to_numpy().view(np.uint64)

    def passes(self, numbers: np.ndarray) -> np.ndarray:
        place = numbers >> np.uint64(64 - FILTER_BITS)
        return (self.words[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1


def _pack(numbers: np.ndarray) -> bytes:
    return (numbers >> np.uint64(64 - 8 * PACKED)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :PACKED].tobytes()


def _unpack(held: bytes) -> np.ndarray:
    wide = np.zeros((len(held) // PACKED, 8), np.uint8)
    wide[:, 8 - PACKED :] = np.frombuffer(held, np.uint8).reshape(-1, PACKED)
    return wide.reshape(-1).view("<u8")


def shared_filter(frame: DataFrame, numbers_of: Callable[[pa.RecordBatch], Iterator[np.ndarray]], parts: int) -> str:
    """The filter of the numbers that more than one row has.

    ``numbers_of`` gives the evenly spread numbers of a batch in arrays that hold each row's whole, each number once per row.
    A task packs the distinct ones of its rows into one row per part, so a number of a third of all rows comes once per task.
    A part is a range of numbers, hence even.
    """

    @releasing
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush():
            numbers, counts = np.unique(np.concatenate(held), return_counts=True)
            owner = (numbers >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)
            cuts = np.searchsorted(owner, np.arange(parts + 1).astype(np.uint64))
            ranges = list(zip(cuts, cuts[1:], strict=False))
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(np.arange(parts, dtype=np.int32)),
                    pa.array([_pack(numbers[a:b]) for a, b in ranges], pa.binary()),
                    pa.array([_pack(numbers[a:b][counts[a:b] > 1]) for a, b in ranges], pa.binary()),
                ],
                names=["part", "numbers", "repeated"],
            )

        held, size = [], 0
        for batch in batches:
            for numbers in numbers_of(batch):
                held.append(numbers)
                size += len(numbers)
                if size > COUNTED:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        numbers, counts = np.unique(_unpack(b"".join(group["numbers"])), return_counts=True)
        found = np.union1d(numbers[counts > 1], _unpack(b"".join(group["repeated"])))
        del numbers, counts
        release()
        return pd.DataFrame({"number": found.view(np.int64)})

    packed = frame.mapInArrow(pack, "part int, numbers binary, repeated binary")
    return write_filter(packed.groupBy("part").applyInPandas(merge, "number long"), "number")
