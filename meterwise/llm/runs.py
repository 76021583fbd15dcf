"""Periodic runs of words, found with a run-length grammar made by recompression.

Each text is compressed by turns: every maximal block of one symbol becomes a symbol, then every pair of a left and a right
symbol does, sides being drawn by hash. What replaces a symbol depends on its neighbours only, so equal stretches are
compressed alike but for their edges, and the length of what two places have in common is found by climbing the grammar while
symbols agree and descending where they first differ. A run of period p and at least 2p words spans two places of the grid 0, p,
2p, ...; all grids together have n log n places. The places whose words agree are extended to both sides by such queries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterwise.llm.common import row_slices
from meterwise.llm.words import mix

LEAST = 12
#: Places of a grid that are looked at together.
PLACES = 1 << 21


class Grammar:
    """Levels of symbols over several sequences at once; level 0 has the words, with a symbol of its own around each sequence.

    ``symbols[l]`` are the symbols of a level, ``first[l]`` where their parts begin in the level below (with one entry more),
    ``parent[l]`` the symbol of the next level that a symbol is part of, ``block[l]`` whether the level was made of blocks.
    """

    def __init__(self, symbols: np.ndarray, fences: np.ndarray) -> None:
        """``fences`` marks the symbols between sequences; no two of them are equal."""
        self.symbols, self.first, self.parent, self.block = [symbols], [None], [], [False]
        fresh = int(symbols.max()) + 1 if len(symbols) else 0
        idle = turn = 0
        while idle < 2 and (~(fences[:-1] | fences[1:])).any():
            turn += 1
            changed, fresh, fences = self._blocks(fresh, fences)
            paired, fresh, fences = self._pairs(fresh, fences, turn)
            # A turn may pair nothing by chance; 64 in a row do not.
            idle = 0 if changed or paired else idle + 1 / 64
        self.parent.append(None)

    def _add(self, starts: np.ndarray, made: np.ndarray, block: bool) -> None:
        mark = np.zeros(len(self.symbols[-1]), np.int32)
        mark[starts] = 1
        self.parent.append(np.cumsum(mark, dtype=np.int32) - 1)
        self.first.append(np.append(starts, len(mark)).astype(np.int32))
        self.symbols.append(made)
        self.block.append(block)

    def _blocks(self, fresh: int, fences: np.ndarray) -> tuple[bool, int, np.ndarray]:
        below = self.symbols[-1]
        starts = np.flatnonzero(np.append(True, below[1:] != below[:-1]))
        if len(starts) == len(below):
            return False, fresh, fences
        lengths = np.diff(starts, append=len(below))
        made = below[starts].copy()
        long = np.flatnonzero(lengths > 1)
        known, place = np.unique((made[long].astype(np.int64) << 32) | lengths[long], return_inverse=True)
        made[long] = fresh + place
        self._add(starts, made, True)
        return True, fresh + len(known), fences[starts]

    def _pairs(self, fresh: int, fences: np.ndarray, turn: int) -> tuple[bool, int, np.ndarray]:
        below = self.symbols[-1]
        left = mix(below.astype(np.uint64) + (np.uint64(turn) << np.uint64(40))) & np.uint64(1) == 1
        pair = np.flatnonzero(left[:-1] & ~left[1:] & ~fences[:-1] & ~fences[1:])
        if len(pair) == 0:
            return False, fresh, fences
        begin = np.ones(len(below), bool)
        begin[pair + 1] = False
        known, place = np.unique((below[pair].astype(np.int64) << 32) | below[pair + 1], return_inverse=True)
        renamed = below.copy()
        renamed[pair] = fresh + place
        starts = np.flatnonzero(begin)
        self._add(starts, renamed[starts], False)
        return True, fresh + len(known), fences[starts]

    def common(self, x: np.ndarray, y: np.ndarray, step: int) -> np.ndarray:
        """For places x < y of one sequence: how many symbols from x and y on agree, to the right (step 1) or left (-1)."""
        begin = x
        x, y = x.astype(np.int64), y.astype(np.int64)
        result = np.zeros(len(x), np.int64)
        # Queries of a level are answered together: first all levels upwards, then downwards.
        waiting: list[list[np.ndarray]] = [[] for _ in self.symbols]
        query = np.arange(len(x))
        for level in range(len(self.symbols)):
            symbols = self.symbols[level]
            up, top = [], self.parent[level] is None
            while len(query):
                alike = symbols[x] == symbols[y]
                waiting[level].append(np.stack([query[~alike], x[~alike], y[~alike]]))
                query, x, y = query[alike], x[alike], y[alike]
                if top:
                    x, y = x + step, y + step
                    continue
                parent, first = self.parent[level], self.first[level + 1]
                px, py = parent[x], parent[y]
                if step > 0:
                    edge = (first[px] == x) & (first[py] == y)
                    rest = np.minimum(first[px + 1] - x, first[py + 1] - y)
                else:
                    edge = (first[px + 1] - 1 == x) & (first[py + 1] - 1 == y)
                    rest = np.minimum(x - first[px] + 1, y - first[py] + 1)
                up.append(np.stack([query[edge], px[edge], py[edge]]))
                ahead = (rest if self.block[level + 1] else np.ones(len(rest), np.int64)) * step
                query, x, y = query[~edge], (x + ahead)[~edge], (y + ahead)[~edge]
            query, x, y = np.concatenate(up, 1) if up else np.zeros((3, 0), np.int64)
            if len(query) == 0 and level + 1 < len(self.symbols):
                break
        query, x, y = np.zeros((3, 0), np.int64)
        for level in range(len(self.symbols) - 1, -1, -1):
            symbols = self.symbols[level]
            # Those that came down to this level compare symbols until two differ; those that stopped here do already.
            stopped = waiting[level]
            while len(query):
                alike = symbols[x] == symbols[y]
                stopped.append(np.stack([query[~alike], x[~alike], y[~alike]]))
                query, x, y = query[alike], x[alike] + step, y[alike] + step
            query, x, y = np.concatenate(stopped, 1) if stopped else np.zeros((3, 0), np.int64)
            if level == 0 or len(query) == 0:
                continue
            first, below = self.first[level], self.symbols[level - 1]
            many = np.minimum(first[x + 1] - first[x], first[y + 1] - first[y])
            x, y = (first[x], first[y]) if step > 0 else (first[x + 1] - 1, first[y + 1] - 1)
            if self.block[level]:
                # Two blocks of one symbol agree as far as the shorter one goes.
                ahead = np.where(below[x] == below[y], many, 0) * step
                x, y = x + ahead, y + ahead
        result[query] = (x - begin[query]) * step
        return result


def _grids(first: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places i and periods p of all grids, of periods up to half a sequence: i and i + p lie in it."""
    half = lengths // 2
    row = np.repeat(np.arange(len(lengths)), half)
    period = np.arange(len(row)) - np.repeat(np.cumsum(half) - half, half) + 1
    places = (lengths[row] - 1) // period
    ends = np.cumsum(places)
    begin = 0
    while begin < len(row):
        end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + PLACES, "right")))
        count = places[begin:end]
        p = np.repeat(period[begin:end].astype(np.int32), count)
        at = np.arange(len(p), dtype=np.int32) - np.repeat((np.cumsum(count) - count).astype(np.int32), count)
        at *= p
        at += np.repeat(first[row[begin:end]].astype(np.int32), count)
        yield at, p
        begin = end


def runs_of(sequences: list[np.ndarray], least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sequence, start, length and period of all runs, by sequence, start and period.

    The sequences have numbers from 0 on. A run has its smallest period q, at least ``least`` and 2q symbols, and no neighbour
    continues it.
    """
    lengths = np.array([len(s) for s in sequences], np.int64)
    first = np.cumsum(lengths + 1) - lengths
    symbols = np.zeros(int(lengths.sum()) + len(lengths) + 1, np.int32)
    fences = np.ones(len(symbols), bool)
    inside = np.repeat(first - np.cumsum(lengths) + lengths, lengths) + np.arange(int(lengths.sum()))
    symbols[inside] = np.concatenate(sequences) if len(sequences) else 0
    fences[inside] = False
    symbols[fences] = (int(symbols.max()) + 1 if len(inside) else 0) + np.arange(len(lengths) + 1)
    nothing = np.zeros(0, np.int64)
    wide = np.where(lengths >= least, lengths, 0)
    if not wide.any():
        return nothing, nothing, nothing, nothing
    grammar = Grammar(symbols, fences)
    found = [np.zeros((3, 0), np.int64)]
    for at, period in _grids(first, wide):
        alike = np.flatnonzero(symbols[at] == symbols[at + period])
        at, period = at[alike].astype(np.int64), period[alike].astype(np.int64)
        right = grammar.common(at, at + period, 1)
        left = grammar.common(at - 1, at + period - 1, -1)
        keep = (left + right >= period) & (left + right + period >= least)
        found.append(np.unique(np.stack([(at - left)[keep], (at + period + right)[keep], period[keep]]), axis=1))
    start, end, period = np.concatenate(found, 1)
    # A stretch has all multiples of its smallest period up to half its length; the smallest stays.
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    keep = np.ones(len(start), bool)
    keep[1:] = (start[1:] != start[:-1]) | (end[1:] != end[:-1])
    start, end, period = start[keep], end[keep], period[keep]
    order = np.lexsort((period, start))
    start, end, period = start[order], end[order], period[order]
    row = np.searchsorted(first, start, "right") - 1
    return row, start - first[row], end - start, period


def repeated_words(n: int, start: np.ndarray, length: np.ndarray, period: np.ndarray) -> np.ndarray:
    """Marks the words of a sequence that a run has after its first period."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, start + period, 1)
    np.add.at(change, start + length, -1)
    return np.cumsum(change[:-1]) > 0


def periodic_runs(docs: DataFrame, id: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """``id``, ``n_words``, ``runs`` (an array of start, length and period, by start and period) and ``collapsed`` (the words
    that no run has after its first period, joined by single blanks) of every row.

    Words are runs of bytes other than ASCII white space, compared as they are. Null and empty texts have no words. Every row is
    looked at by itself: null, equal ids and equal texts do not matter, other columns are not read. A text longer than a slice
    is a slice of its own; it takes some hundred bytes of memory per word.
    """

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in row_slices(batch, "__text"):
                words = [t.split() if t else [] for t in piece.column(1).to_pylist()]
                counts = np.array([len(w) for w in words], np.int64)
                every = np.empty(int(counts.sum()), object)
                every[:] = [w for row in words for w in row]
                cuts = np.cumsum(counts)
                row, *run = runs_of(np.split(pd.factorize(every)[0].astype(np.int32), cuts[:-1]), least)
                edges = np.searchsorted(row, np.arange(len(words) + 1))
                kept = []
                for i, own in enumerate(words):
                    if edges[i] < edges[i + 1]:
                        drop = repeated_words(len(own), *(c[edges[i] : edges[i + 1]] for c in run))
                        own = [w for w, d in zip(own, drop, strict=True) if not d]
                    kept.append(b" ".join(own))
                structs = pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in run], ["start", "length", "period"])
                lists = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), structs)
                columns = [piece.column(0), pa.array(counts), lists, pa.array(kept, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=[id, "n_words", "runs", "collapsed"])

    one = docs.select(F.col(id), F.encode(F.col(text).cast("string"), "UTF-8").alias("__text"))
    kind = one.schema[0].dataType.simpleString()
    found = one.mapInArrow(search, f"`{id}` {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed binary")
    return found.withColumn("collapsed", F.col("collapsed").cast("string"))


def planted(id: str = "doc_id", text: str = "text") -> Column:
    """The text with a repeating tail for a tenth of the ids (contract of op13): with h the crc32 of the id as text, g = h // 10
    and n words, if h % 10 is 0, the words from a = g % n on repeat the first 1 + (n - a) // (3 + g % 8) of them. Other texts,
    and those of null ids, stay as they are."""
    h = F.crc32(F.col(id).cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.filter(F.split(F.col(text).cast("string"), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    n = F.size(words).cast("long")
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    rest = n - a
    again = F.array_repeat(F.slice(words, a + 1, p), F.ceil(rest / p).cast("int"))
    tail = F.slice(F.flatten(again), 1, rest.cast("int"))
    return F.when((h % 10 == 0) & (n > 0), F.array_join(F.concat(F.slice(words, F.lit(1), a), tail), " ")).otherwise(F.col(text))
