"""Benchmark decontamination: a broadcast hash set of benchmark n-grams against every window of the documents."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterwise.llm.common import byte_view, free_names, releasing, row_slices, staged
from meterwise.llm.words import ALPHANUMERIC, Words

WINDOW = 10
#: Bytes of one broadcast block of windows; a larger set is scanned for in several passes.
BLOCK_BYTES = 64 << 20
#: The bits of the hash that select a cell of the filter in front of the sorted hashes.
FILTER_BITS = 22


def item_windows(items: DataFrame, id: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """The distinct windows of all items: ``n`` words, ``words`` (lower case, single blanks), ``item`` (the id as text).

    An item with fewer words than ``window`` is one window; without words, or null, it has none. Null ids are 'null'.
    """

    @releasing
    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in row_slices(batch, "__text"):
                words = Words(*byte_view(part.column(1)), ALPHANUMERIC)
                ids = part.column(0).to_pylist()
                found = []
                for row, name in enumerate(ids):
                    n = min(int(words.counts[row]), window)
                    if n:
                        begin = words.first[row]
                        found += [(n, words.text(i, n), name) for i in range(begin, words.first[row + 1] - n + 1)]
                yield pa.RecordBatch.from_pydict(
                    {"n": pa.array([f[0] for f in found], pa.int32()), "words": pa.array([f[1] for f in found], pa.binary()), "item": pa.array([f[2] for f in found], pa.string())}
                )

    one = items.select(F.coalesce(F.col(id).cast("string"), F.lit("null")).alias("__item"), F.col(text).cast("string").alias("__text"))
    return one.mapInArrow(windows, "n int, words binary, item string").distinct()


class WindowSet:
    """A block of windows: hashes, sorted, behind a bit filter; the words themselves to verify hits; the items of each."""

    def __init__(self, rows: list[tuple[int, bytes, str]]) -> None:
        self.items: dict[bytes, set[str]] = {}
        lengths: dict[int, list[bytes]] = {}
        for n, words, item in rows:
            if words not in self.items:
                self.items[words] = set()
                lengths.setdefault(n, []).append(words)
            self.items[words].add(item)
        self.hashes: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n, texts in lengths.items():
            data = np.frombuffer(b" ".join(texts), np.uint8)
            edges = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
            edges[-1] -= 1
            _, hashes = Words(data, edges, ALPHANUMERIC).windows(n)
            hashes = np.unique(hashes)
            cells = np.zeros(1 << FILTER_BITS, bool)
            cells[hashes >> np.uint64(64 - FILTER_BITS)] = True
            self.hashes[n] = (hashes, cells)

    def scan(self, words: Words) -> list[tuple[int, int, int, set[str]]]:
        """Verified hits: row, first word, number of words, items."""
        hits = []
        for n, (hashes, cells) in self.hashes.items():
            begin, found = words.windows(n)
            maybe = np.flatnonzero(cells[found >> np.uint64(64 - FILTER_BITS)])
            place = np.minimum(np.searchsorted(hashes, found[maybe]), len(hashes) - 1)
            for i in maybe[hashes[place] == found[maybe]]:
                first = int(begin[i])
                items = self.items.get(words.text(first, n))
                if items:
                    hits.append((int(words.row[first]), first, n, items))
        return hits


def _blocks(windows: DataFrame, limit: int) -> Iterator[list[tuple[int, bytes, str]]]:
    held, size = [], 0
    for row in windows.toLocalIterator():
        held.append((row["n"], bytes(row["words"]), row["item"]))
        size += len(held[-1][1]) + 200
        if size > limit:
            yield held
            held, size = [], 0
    if held:
        yield held


def contamination(
    docs: DataFrame,
    items: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """All columns of docs, and ``__words`` (number of words), ``__spans`` (byte ranges of the hit words in the UTF-8 text,
    ``[begin, end)``, neighbours joined), ``__hit`` (number of hit words) and ``__items`` (ids of the items with an
    occurring window, sorted as strings). Columns of docs with these four names are replaced.

    Words are lower-case runs of a-z, 0-9 and characters beyond ASCII. A window never crosses documents. The windows of the
    items are taken in blocks of ``block_bytes``; each block goes to all tasks, and each needs one pass over docs whose
    result is written before the next pass reads it, so what is broadcast has a bound whatever the number of items.
    No items: one pass with an empty set. Null and empty texts have no words. Repeated rows are each judged.
    """
    spark = docs.sparkSession
    clear = docs.drop("__words", "__spans", "__hit", "__items")
    windows = staged(item_windows(items, item_id, item_text, window), "windows")
    frame = clear.withColumns(
        {
            "__words": F.lit(0).cast("long"),
            "__spans": F.array().cast("array<struct<begin:long,end:long>>"),
            "__hit": F.lit(0).cast("long"),
            "__items": F.array().cast("array<string>"),
        }
    )
    schema = frame.schema
    first = True
    for block in _blocks(windows, block_bytes):
        if not first:
            frame = staged(frame, "contamination")
        frame = frame.mapInArrow(_pass(spark.sparkContext.broadcast(block), text, frame.columns), schema)
        first = False
    if first:
        frame = frame.mapInArrow(_pass(spark.sparkContext.broadcast([]), text, frame.columns), schema)
    return frame


_ADDED = ("__words", "__spans", "__hit", "__items")


def _pass(block, text: str, columns: list[str]):
    place = {name: columns.index(name) for name in ("__words", "__spans", "__hit", "__items", text)}

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WindowSet(block.value)
        for batch in batches:
            for part in row_slices(batch, text):
                data, edges = byte_view(part.column(place[text]))
                words = Words(data, edges, ALPHANUMERIC)
                spans = part.column(place["__spans"]).to_pylist()
                hit_counts = part.column(place["__hit"]).to_pylist()
                items = part.column(place["__items"]).to_pylist()
                by_row: dict[int, list] = {}
                for row, begin, n, found in known.scan(words):
                    by_row.setdefault(row, []).append((begin, n, found))
                for row, hits in by_row.items():
                    marked = np.zeros(int(words.counts[row]) + 1, bool)
                    first, base = int(words.first[row]), int(edges[row])
                    own = slice(first, int(words.first[row + 1]))
                    for s in spans[row]:
                        marked[:-1] |= (words.begin[own] - base >= s["begin"]) & (words.end[own] - base <= s["end"])
                    names = set(items[row])
                    for begin, n, found in hits:
                        marked[begin - first : begin - first + n] = True
                        names |= found
                    change = np.flatnonzero(np.diff(np.concatenate([[False], marked])))
                    spans[row] = [
                        {"begin": int(words.begin[first + a]) - base, "end": int(words.end[first + b - 1]) - base}
                        for a, b in zip(change[::2], change[1::2], strict=True)
                    ]
                    hit_counts[row] = int(marked.sum())
                    items[row] = sorted(names)
                arrays = list(part.columns)
                arrays[place["__words"]] = pa.array(words.counts.astype(np.int64))
                arrays[place["__spans"]] = pa.array(spans, part.column(place["__spans"]).type)
                arrays[place["__hit"]] = pa.array(hit_counts, pa.int64())
                arrays[place["__items"]] = pa.array(items, pa.list_(pa.string())).cast(part.column(place["__items"]).type)
                yield pa.RecordBatch.from_arrays(arrays, names=columns)

    return run


def _set_aside(docs: DataFrame, text: str) -> tuple[DataFrame, str]:
    """The documents with their columns under names that :func:`contamination` does not use, and what the text is called then."""
    names = {c: free_names(docs, c)[0] for c in docs.columns if c.lower() in _ADDED}
    return docs.withColumnsRenamed(names), names.get(text, text)


def without_contaminated(docs: DataFrame, items: DataFrame, text: str = "text", **names: str) -> DataFrame:
    """The documents without a hit, with their columns as they were."""
    frame, name = _set_aside(docs, text)
    return contamination(frame, items, text=name, **names).where("__hit = 0").select(*frame.columns).toDF(*docs.columns)


def without_spans(docs: DataFrame, items: DataFrame, text: str = "text", **names: str) -> DataFrame:
    """All documents, with the hit words cut out of their texts and each cut closed by one blank."""
    frame, name = _set_aside(docs, text)
    columns = frame.columns

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, where = batch.schema.get_field_index(name), batch.schema.get_field_index("__spans")
            texts = batch.column(at).to_pylist()
            for row, spans in enumerate(batch.column(where).to_pylist()):
                if spans:
                    raw, pieces, done = texts[row].encode(), [], 0
                    for span in spans:
                        pieces.append(raw[done : span["begin"]].rstrip(b" "))
                        done = span["end"]
                    pieces.append(raw[done:].lstrip(b" "))
                    texts[row] = b" ".join(p for p in pieces if p).decode()
            arrays = [pa.array(texts, batch.column(at).type) if i == at else c for i, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(arrays, names=batch.schema.names).select(columns)

    return contamination(frame, items, text=name, **names).mapInArrow(cut, frame.schema).toDF(*docs.columns)


def items_digest(items: list[str]) -> str:
    """Lower-case SHA-256 of the ids joined by commas; what the registered query computes with built-in functions."""
    return hashlib.sha256(",".join(items).encode()).hexdigest()
