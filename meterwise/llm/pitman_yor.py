"""Language-model scoring by a hierarchical Pitman-Yor process whose seating is sampled by Gibbs moves.

Every context (the word before) is a Chinese restaurant; all of them share one parent, the restaurant of single words, whose
base is uniform over the known words and one unknown. A table of a context's restaurant is a customer of the parent.
Contexts are hashed into 2^20 restaurants, so that their totals are a table of bounded size that each task may read; words
(the dishes) are told apart by 64 bits.

Training is spread by the predicted word. A part holds all restaurants' customers of its words, so it can seat them and the
customers they send to the parent; words too frequent for one part are dealt out by (context, word), and their sums (no more
rows than there are parts) are exchanged after every sweep, as are the totals of the restaurants. In between, a sweep sees the
totals of the one before. Documents are never gathered: a part returns one number per document for what it holds.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.dataset
import pyarrow.fs
import pyarrow.parquet
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from meterwise.llm.common import byte_view, discard, release, row_slices, scratch, staged
from meterwise.llm.words import NOT_SPACE, Words, mix

CONTEXT_BITS = 20
#: Text of a part, and of a slice of documents that a task encodes at once.
PART_BYTES = 4 << 20
SLICE_BYTES = 4 << 20
SLICE_ROWS = 1 << 16
PIECE_BYTES = 1 << 18
SLICE_TOKENS = 1 << 22
#: Sweeps whose seating is averaged, and sweeps before them.
SAMPLES = 2
BURN_IN = 2
#: Tables of a group, and customers of a row whose leaving is drawn one by one.
GROUP_TABLES = 8
_DRAWN = 4096
STRENGTH = 1.0
SEED = 11
_START = np.uint64(0x5851F42D4C957F2D)
_END = np.uint64(0x14057B7EF767814F)
_DEAL = np.uint64(0xA0761D6478BD642F)


def _by_row(frame: DataFrame, function: Callable[[], Callable[[SimpleNamespace], Iterator[dict]]], schema: str) -> DataFrame:
    """``function`` is called once per task; what it returns makes output rows of one input row. If that has an attribute
    ``close``, it makes further rows at the end of the task."""
    kind = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apply = function()
        for batch in batches:
            for i in range(batch.num_rows):
                row = SimpleNamespace(**{name: batch.column(at)[i].as_py() for at, name in enumerate(batch.schema.names)})
                for made in apply(row):
                    yield pa.RecordBatch.from_pylist([made], kind)
        for made in getattr(apply, "close", list)():
            yield pa.RecordBatch.from_pylist([made], kind)
        release()

    return frame.mapInArrow(run, schema)


def learnt(id: str = "doc_id") -> Column:
    """Rows that the model learns from; the others are held out."""
    return F.coalesce(F.crc32(F.coalesce(F.col(id).cast("string"), F.lit("")).cast("binary")) % 7 != 2, F.lit(True))


def tokens(batch: pa.RecordBatch, column: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, hash and context's hash of each token; every row ends with the end token."""
    words = Words(*byte_view(batch.column(batch.schema.get_field_index(column))), NOT_SPACE)
    first = np.concatenate([[0], np.cumsum(words.counts + 1)])
    word = np.full(first[-1], _END, np.uint64)
    word[np.arange(len(words.hash)) + words.row] = words.hash
    before = np.empty_like(word)
    before[1:] = word[:-1]
    before[first[:-1]] = _START
    return np.repeat(np.arange(words.rows), words.counts + 1), word, before


def _range(numbers: np.ndarray, parts: int) -> np.ndarray:
    return ((numbers >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _within(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    if len(known) == 0:
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def _part_of(word: np.ndarray, context: np.ndarray, frequent: np.ndarray, parts: int) -> np.ndarray:
    part = _range(word, parts)
    spread = _within(word, frequent)
    part[spread] = _range(mix(word[spread] + context[spread].astype(np.uint64) * _DEAL), parts)
    return part


def _frequent(docs: DataFrame, text: str, parts: int) -> np.ndarray:
    """Words with half a part's share of all tokens or more, ascending; at most two for each part."""

    def heavy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in row_slices(batch, text, PIECE_BYTES):
                word, counts = np.unique(tokens(piece, text)[1], return_counts=True)
                total = int(counts.sum())
                keep = counts * 4 * parts >= total
                numbers = np.concatenate([word[keep].view(np.int64), [0]])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(numbers), pa.array(np.concatenate([counts[keep], [total]])), pa.array(np.arange(len(numbers)) == len(numbers) - 1)],
                    names=["word", "n", "whole"],
                )
        release()

    counted = docs.select(text).mapInArrow(heavy, "word long, n long, whole boolean").groupBy("whole", "word").agg(F.sum("n").alias("n"))
    counted = staged(counted, "frequent-words")
    total = counted.where("whole").agg(F.sum("n")).first()[0] or 0
    rows = counted.where(~F.col("whole") & (F.col("n") * 2 * parts >= total)).select("word").collect() if parts > 1 else []
    discard(counted)
    return np.sort(np.array([r["word"] for r in rows], np.int64).view(np.uint64))


def _three(values: np.ndarray) -> bytes:
    return values.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3].tobytes()


def _from_three(data: bytes) -> np.ndarray:
    wide = np.zeros((len(data) // 3, 4), np.uint8)
    wide[:, :3] = np.frombuffer(data, np.uint8).reshape(-1, 3)
    return wide.reshape(-1).view("<u4").astype(np.int64)


def _planes(values: np.ndarray) -> bytes:
    """Small whole numbers with the like bytes of all together, which compresses well."""
    return values.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).reshape(-1).view("<u4").astype(np.int64)


_BLOCK = "part int, slice long, learnt int, words binary, lengths binary, contexts binary, rows binary, many binary, times binary, documents binary"


def _ipc(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _blocks(docs: DataFrame, id: str, text: str, frequent: np.ndarray, parts: int) -> DataFrame:
    """One row per slice of documents and part: which contexts come before which words in which documents. Documents of a
    slice are numbered, those to learn from first. A further row of the slice, of no part, has the documents themselves."""
    names_out = [c.split()[0] for c in _BLOCK.split(", ")]
    kinds = [pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 7]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held, taken = [], []
        rows = size = length = 0

        def block() -> pa.RecordBatch:
            row, word, before = (np.concatenate(x) for x in zip(*taken, strict=True))
            learn = np.concatenate([np.asarray(b.column(2)) for b in held])
            order = np.argsort(~learn, kind="stable")
            rank = np.empty(rows, np.int64)
            rank[order] = np.arange(rows)
            own = pa.RecordBatch.from_arrays(
                [pa.concat_arrays([b.column(0) for b in held]).take(pa.array(order)), pa.array(np.bincount(row, minlength=rows)[order]), pa.array(~learn[order])],
                names=["id", "n_tokens", "held_out"],
            )
            taken.clear()
            names, key = np.unique(word, return_inverse=True)
            key <<= CONTEXT_BITS + 16
            key |= (before >> np.uint64(64 - CONTEXT_BITS)).astype(np.int64) << 16
            key |= rank[row]
            del word, before, row
            key, times = np.unique(key, return_counts=True)
            place, context, row = key >> (CONTEXT_BITS + 16), (key >> 16) & ((1 << CONTEXT_BITS) - 1), key & 0xFFFF
            part = _part_of(names[place], context, frequent, parts)
            order = np.argsort(part, kind="stable")
            cuts = np.searchsorted(part[order], np.arange(parts + 1))
            made = [(-1 - (number % parts), number, None, *[None] * 6, _ipc(own))]
            for p in np.flatnonzero(np.diff(cuts)):
                at = order[cuts[p] : cuts[p + 1]]
                starts = np.flatnonzero(np.diff(place[at], prepend=-1))
                many = np.flatnonzero(times[at] > 1)
                lengths = np.diff(starts, append=len(at)).astype("<u4").tobytes()
                repeated = many.astype("<u4").tobytes(), times[at[many]].astype("<u4").tobytes()
                contexts, documents = _three(context[at]), row[at].astype("<u2").tobytes()
                made.append((int(p), number, int(learn.sum()), names[place[at[starts]]].tobytes(), lengths, contexts, documents, *repeated, None))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*made, strict=True), kinds, strict=True)], names=names_out)

        for batch in batches:
            for piece in row_slices(batch, "__text", PIECE_BYTES):
                for begin in range(0, piece.num_rows, SLICE_ROWS):
                    some = piece.slice(begin, SLICE_ROWS)
                    row, word, before = tokens(some, "__text")
                    full = rows + some.num_rows > SLICE_ROWS or size > SLICE_BYTES or length + len(word) > SLICE_TOKENS
                    if held and full:
                        yield block()
                        held, taken = [], []
                        number, rows, size, length = number + 1, 0, 0, 0
                    taken.append((row + rows, word, before))
                    # Only ids and marks are held, not the texts.
                    held.append(pa.RecordBatch.from_arrays([some.column(0), pa.nulls(some.num_rows), some.column(2)], names=["id", "no", "learn"]))
                    rows, size, length = rows + some.num_rows, size + some.nbytes, length + len(word)
        if held:
            yield block()
        release()

    one = docs.select(F.col(id).alias("__id"), F.col(text).cast("string").alias("__text"), learnt(id).alias("__learn"))
    return one.mapInArrow(encode, _BLOCK)


def _attended(sizes: np.ndarray, lengths: np.ndarray, target: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Rows with ``target`` customers each: whoever leaves is drawn evenly, whoever comes waits at the largest table for the sweep."""
    sizes, row = sizes.astype(np.int64), np.repeat(np.arange(len(lengths)), lengths)
    sums = np.concatenate([[0], np.cumsum(sizes)])
    ends = np.cumsum(lengths)
    held = sums[ends] - sums[ends - lengths]
    change = target - held
    at = np.flatnonzero(((change < 0) & (held <= _DRAWN))[row])
    if len(at):
        who = np.repeat(at, sizes[at])
        whose = row[who]
        order = np.lexsort((rng.random(len(who)), whose))
        place = np.arange(len(who)) - np.searchsorted(whose, whose)
        sizes -= np.bincount(who[order[place < -change[whose]]], minlength=len(sizes))
    for crowded in np.flatnonzero((change < 0) & (held > _DRAWN)):
        own = slice(ends[crowded] - lengths[crowded], ends[crowded])
        sizes[own] -= rng.multivariate_hypergeometric(sizes[own], -change[crowded], method="marginals")
    at = np.flatnonzero((change > 0)[row])
    if len(at):
        order = at[np.lexsort((sizes[at], row[at]))]
        largest = order[np.flatnonzero(np.diff(row[order], append=len(lengths)))]
        sizes[largest] += change[row[largest]]
    new = np.flatnonzero((lengths == 0) & (target > 0))
    row, sizes = np.concatenate([row[sizes > 0], new]), np.concatenate([sizes[sizes > 0], target[new]])
    return sizes[np.argsort(row, kind="stable")], np.bincount(row, minlength=len(lengths))


def _likely(customers: np.ndarray, fixed: np.ndarray, slope: np.ndarray, discount: float) -> tuple[np.ndarray, np.ndarray]:
    """About how many tables rows come to have, and by what factor tables of one customer more are rarer than in the process itself."""
    low, high = np.zeros(len(customers)), np.full(len(customers), 700.0)
    for _ in range(60):
        middle = (low + high) / 2
        weight = fixed / np.maximum(1 + slope * np.expm1(-middle * discount) / discount, 1e-9)
        few = -weight * np.expm1(-middle) * np.exp(middle * (1 - discount)) < customers
        low, high = np.where(few, middle, low), np.where(few, high, middle)
    return np.clip(-weight * np.expm1(-middle * discount) / discount, 1, customers), -np.expm1(-middle)


def _begun(customers: np.ndarray, tables: np.ndarray, rarer: np.ndarray, discount: float, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """A first seating of rows that will have many tables: row and size of each table, sizes drawn until all customers sit."""
    row = np.repeat(np.arange(len(customers)), np.ceil(1.2 * tables / discount).astype(np.int64) + 16)
    sizes = rng.geometric(np.maximum(rng.beta(discount, 1 - discount, len(row)), 1e-9))
    kept = rng.random(len(row)) < rarer[row] ** (sizes - 1.0)
    row, sizes = row[kept], np.minimum(sizes[kept], customers[row[kept]])
    sums = np.concatenate([[0], np.cumsum(sizes)])
    before = sums[:-1] - sums[np.searchsorted(row, row)]
    sizes = np.clip(customers[row] - before, 0, sizes)
    left = customers - np.bincount(row, sizes, len(customers)).astype(np.int64)
    return np.concatenate([row, np.arange(len(customers))]), np.concatenate([sizes, left])


def seat(
    sizes: np.ndarray, lengths: np.ndarray, target: np.ndarray, fixed: np.ndarray, slope: np.ndarray, discount: float, rng: np.random.Generator,
    first: bool = False,
) -> tuple[np.ndarray, np.ndarray]:
    """One Gibbs sweep over the tables of many (restaurant, dish) rows; returns their sizes and how many each row has.

    A row is first brought to ``target`` customers. Then every one of them, each once and in random order, leaves and is seated again:
    at a table of s customers with weight s - discount, at a new one with weight ``fixed + slope * tables``.

    Rows that come to have many tables are swept in groups. With g drawn from Gamma(fixed / slope + tables), the weight of a seating is a
    product over its tables, slope * g for each; so tables dealt out to groups at random are independent from group to group, and a new
    table of one of k groups has weight slope * g / k. Tables are dealt anew in every sweep; k follows from the weights and not
    from the tables, which would favour some seatings. The ``first`` sweep does not begin such rows at one table, which only one group could leave.
    """
    n = len(lengths)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    sizes, lengths = _attended(sizes, lengths, target, rng)
    groups, large = np.ones(n, np.int64), np.flatnonzero(target > 2 * GROUP_TABLES)
    tables, rarer = _likely(target[large], fixed[large], slope[large], discount)
    some = tables > 2 * GROUP_TABLES
    crowded, tables, rarer = large[some], tables[some], rarer[some]
    groups[crowded] = np.ceil(tables / GROUP_TABLES)
    row = np.repeat(np.arange(n), lengths)
    if first and len(crowded):
        whose, begun = _begun(target[crowded], tables, rarer, discount, rng)
        others = groups[row] == 1
        row, sizes = np.concatenate([row[others], crowded[whose[begun > 0]]]), np.concatenate([sizes[others], begun[begun > 0]])
        lengths = np.bincount(row, minlength=n)
    base = np.cumsum(groups) - groups
    fixed, slope = np.repeat(fixed, groups).astype(float), np.repeat(slope, groups).astype(float)
    group = base[row]
    if len(crowded):
        many = groups[crowded]
        steady, rise = fixed[base[crowded]], slope[base[crowded]]
        # So flat a slope leaves the weight of a new table as it is.
        flat = rise <= steady * 1e-12
        gamma = rng.gamma(np.where(flat, 1.0, steady / np.where(flat, 1.0, rise)) + lengths[crowded])
        inside = np.repeat(base[crowded] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        fixed[inside], slope[inside] = np.repeat(np.where(flat, steady, rise * gamma) / many, many), 0.0
        group += (rng.random(len(row)) * groups[row]).astype(np.int64)
    order = np.argsort(group, kind="stable")
    sizes, tables = _swept(sizes[order], np.bincount(group, minlength=len(fixed)), fixed, slope, discount, rng)
    return sizes, np.add.reduceat(tables, base)


def _swept(
    sizes: np.ndarray, lengths: np.ndarray, fixed: np.ndarray, slope: np.ndarray, discount: float, rng: np.random.Generator
) -> tuple[np.ndarray, np.ndarray]:
    """The sweep of :func:`seat`, over rows that are seated side by side, those of like work together."""
    starts = np.cumsum(lengths) - lengths
    sums = np.concatenate([[0], np.cumsum(sizes)])
    held = sums[starts + lengths] - sums[starts]
    largest = np.zeros(len(lengths), np.int64)
    some = np.flatnonzero(lengths)
    if len(some):
        largest[some] = np.maximum.reduceat(sizes, starts[some])
    # A lone customer has no other table to go to.
    still = held <= 1
    steps = np.where(_dominated(largest, held), held - largest + 2 * _epoch(held), held)
    order = np.lexsort((lengths, steps))
    order = order[~still[order]]
    made_lengths = np.where(still, held, 0)
    pieces = [(np.flatnonzero(held == 1), np.ones(int((held == 1).sum()), np.int64))]
    begin = 0
    while begin < len(order):
        rows = order[begin : begin + 65536]
        wide = np.maximum.accumulate(lengths[rows]) + 3
        rows = rows[: max(1, int(np.searchsorted(wide * np.arange(1, len(rows) + 1), 1 << 20, side="right")))]
        begin += len(rows)
        table = np.zeros((len(rows), int(wide[len(rows) - 1])), np.int64)
        total = int(lengths[rows].sum())
        line = np.repeat(np.arange(len(rows)), lengths[rows])
        column = np.arange(total) - np.repeat(np.cumsum(lengths[rows]) - lengths[rows], lengths[rows])
        table[line, column] = sizes[np.repeat(starts[rows], lengths[rows]) + column]
        table = _moved(table, held[rows], fixed[rows], slope[rows], discount, rng)
        full = table > 0
        made_lengths[rows] = full.sum(1)
        pieces.append((rows, table[full]))
    ends = np.cumsum(made_lengths)
    made_sizes = np.zeros(int(ends[-1]), np.int64)
    for rows, values in pieces:
        many = made_lengths[rows]
        column = np.arange(len(values)) - np.repeat(np.cumsum(many) - many, many)
        made_sizes[np.repeat(ends[rows] - many, many) + column] = values
    return made_sizes, made_lengths


def _epoch(customers: np.ndarray) -> np.ndarray:
    return np.ceil(1.5 * np.sqrt(customers)).astype(np.int64)


def _dominated(largest: np.ndarray, customers: np.ndarray) -> np.ndarray:
    return (customers >= 64) & (2 * largest >= customers)


def _moved(table: np.ndarray, held: np.ndarray, fixed: np.ndarray, slope: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Every customer of each row leaves once and is seated again; returns the tables, maybe with further columns.

    Where one table has most customers, nearly all of them come back to it. Over the next ``epoch`` moves of such a row the chance of that
    is ``sure`` at least, wherever the others go; those of its customers that the draw puts below ``sure`` change nothing and are
    counted together, the others are moved one at a time by what remains of their draw.
    """
    unmoved, waiting = table.copy(), held.copy()
    own, rest, sure = np.zeros(len(held), np.int64), np.zeros(len(held), np.int64), np.zeros(len(held))
    active = np.arange(len(held))
    while True:
        new = active[rest[active] == 0]
        if len(new):
            new = new[waiting[new] > 0]
            if len(new):
                big, first = table[new].argmax(1), np.zeros(len(new), np.int64)
                for numbers in (table, unmoved):
                    numbers[new, first], numbers[new, big] = numbers[new, big], numbers[new, first]
                largest, seated, customers = table[new, 0], unmoved[new, 0], held[new]
                some = _dominated(largest, customers)
                epoch = np.where(some, np.minimum(_epoch(customers), waiting[new]), waiting[new])
                tables = (table[new] > 0).sum(1)
                growth = slope[new] - discount
                most = customers - 1 + fixed[new] + np.maximum(growth * np.maximum(tables - epoch - 1, 0), growth * (tables + epoch))
                sure[new] = np.where(some, np.maximum((largest - epoch - 1 - discount) / most, 0.0), 0.0)
                chosen = rng.hypergeometric(seated, waiting[new] - seated, epoch)
                stay = rng.binomial(chosen, sure[new])
                unmoved[new, 0] -= chosen
                waiting[new] -= epoch
                own[new], rest[new] = chosen - stay, epoch - stay
            active = active[(rest[active] > 0) | (waiting[active] > 0)]
            if len(active) == 0:
                return table
        now = active[rest[active] > 0]
        if len(now) == 0:
            continue
        at_first = rng.random(len(now)) * rest[now] < own[now]
        reach = unmoved[now, 1:].cumsum(1)
        place = np.where(at_first, 0, 1 + (reach <= (rng.random(len(now)) * reach[:, -1])[:, None]).sum(1))
        unmoved[now, place] -= ~at_first
        table[now, place] -= 1
        own[now] -= at_first
        rest[now] -= 1
        some = table[now]
        taken = some > 0
        reach = np.where(taken, some - discount, 0.0).cumsum(1)
        tables = taken.sum(1)
        low = np.where(at_first, sure[now], 0.0)
        draw = (low + (1 - low) * rng.random(len(now))) * (reach[:, -1] + fixed[now] + slope[now] * tables)
        fresh = draw >= reach[:, -1]
        free = np.where(tables < table.shape[1], taken.argmin(1), table.shape[1])
        if (fresh & (tables == table.shape[1])).any():
            table, unmoved = (np.pad(x, ((0, 0), (0, 4 + x.shape[1] // 2))) for x in (table, unmoved))
        table[now, np.where(fresh, free, (reach <= draw[:, None]).sum(1))] += 1


@dataclass
class Totals:
    """What all parts share after a sweep: sums of the parent's restaurant and the rows of frequent words."""

    customers: float = 0.0
    tables: float = 0.0
    frequent: dict[int, tuple[int, int]] = field(default_factory=dict)
    path: str = ""


@dataclass
class Model:
    """A fitted model: folders of written tables, and scalars."""

    parts: int
    frequent: np.ndarray
    train_tokens: int
    vocabulary: int
    discount: tuple[float, float]
    counts: dict[int, int]
    context_path: str
    single_path: str
    samples: list[Totals]


def _read(path: str, columns: list[str]) -> pa.Table:
    system, base = pyarrow.fs.FileSystem.from_uri(_uri(path))
    return pyarrow.dataset.dataset(base, filesystem=system, format="parquet").to_table(columns=columns)


def context_table(path: str) -> np.ndarray:
    """A written table of numbers by context as an array of 2^20."""
    values = np.zeros(1 << CONTEXT_BITS, np.int64)
    if path:
        for span, data in zip(*(c.to_pylist() for c in _read(path, ["span", "data"]).columns), strict=True):
            values[span << 14 : (span + 1) << 14] = np.frombuffer(data, "<i8")
    return values


def _sparse(values: np.ndarray) -> bytes:
    """The numbers of a context table that are not 0, and their places."""
    found = np.flatnonzero(values)
    return _planes(np.concatenate([np.diff(found, prepend=0), values[found] & 0xFFFFFFFF, values[found] >> 32]))


def _add_sparse(total: np.ndarray, data: bytes) -> None:
    places, low, high = _from_planes(data).reshape(3, -1)
    total[np.cumsum(places)] += low + (high << 32)


def _spans(values: np.ndarray) -> Iterator[tuple[int, bytes]]:
    for span in np.unique(np.flatnonzero(values) >> 14):
        yield int(span), values[span << 14 : (span + 1) << 14].astype("<i8").tobytes()


def _sum_contexts(rows: DataFrame, file: str, column: str, name: str) -> str:
    """Adds up the context tables of all parts: spans of 2^14 contexts, so nothing grows with the data but the number of rows."""

    def add(group: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(1 << 14, np.int64)
        for data in group["data"]:
            total += np.frombuffer(data, "<i8")
        return pd.DataFrame({"span": [group["span"].iloc[0]], "data": [total.astype("<i8").tobytes()]})

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << CONTEXT_BITS, np.int64)
        for batch in batches:
            for file in batch.column(0).to_pylist():
                _add_sparse(total, getattr(_load(file, column), column))
        spans, tables = zip(*_spans(total), strict=True) if total.any() else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(spans, pa.int32()), pa.array(tables, pa.binary())], names=["span", "data"])
        release()

    path = scratch(rows.sparkSession, name)
    summed = rows.select(file).mapInArrow(combine, "span int, data binary").groupBy("span").applyInPandas(add, "span int, data binary")
    summed.write.parquet(path)
    return path


#: Rows of the part table; what grows with a part's text lies in its file, which tasks read and write themselves.
_STATIC = (
    "part int, slice long, path string, n_train long, n_words long, ones long, twos long, frequent array<struct<word:long,n:long>>, documents binary"
)
_SEATS = "part int, path string, seats string, customers long, parent_total long, frequent array<struct<word:long,c:long,t:long>>"
#: Parts that a task handles one after the other.
TASK_PARTS = 12


def _save(folder: str, values: dict) -> str:
    """Writes one row as a file of its own in the shared folder; a task that is repeated writes another."""
    system, base = pyarrow.fs.FileSystem.from_uri(_uri(folder))
    system.create_dir(base)
    name = f"{uuid.uuid4().hex}.parquet"
    pyarrow.parquet.write_table(pa.table({k: [v] for k, v in values.items()}), f"{base}/{name}", filesystem=system, compression="zstd")
    return f"{folder}/{name}"


def _load(path: str, *columns: str) -> SimpleNamespace:
    system, base = pyarrow.fs.FileSystem.from_uri(_uri(path))
    found = pyarrow.parquet.read_table(base, filesystem=system, columns=list(columns), partitioning=None)
    return SimpleNamespace(**found.to_pylist()[0])


def _uri(path: str) -> str:
    return path if ":" in path.split("/")[0] else f"file://{path}"


def _parted(rows: DataFrame, parts: int) -> DataFrame:
    return rows.repartition(max(1, parts // TASK_PARTS), "part")


def _merge(frequent: np.ndarray, folder: str):
    """Brings the blocks of a part together: its words, its (context, word) pairs with their counts, and where they occur."""

    names_out = ["part", "slice", "path", "n_train", "n_words", "ones", "twos", "frequent", "documents"]

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        part = int(group["part"].iloc[0])
        if part < 0:
            own = {c: group[c].tolist() for c in ("part", "slice", "documents")}
            return pd.DataFrame({c: pd.Series(own.get(c, [None] * len(group)), dtype=object) for c in names_out})
        group = group.sort_values("slice")
        whole = lambda column, kind: np.frombuffer(b"".join(group[column]), kind)
        names, place = np.unique(whole("words", np.uint64), return_inverse=True)
        key = (np.repeat(place, whole("lengths", "<u4")) << CONTEXT_BITS) | _from_three(b"".join(group["contexts"]))
        pairs, at = np.unique(key, return_inverse=True)
        lengths = group["rows"].str.len().to_numpy() // 2
        begin = np.cumsum(lengths) - lengths
        n = np.ones(len(at), np.int64)
        many = whole("many", "<u4") + np.repeat(begin, group["many"].str.len() // 4)
        n[many] = whole("times", "<u4")
        learn = whole("rows", "<u2") < np.repeat(group["learnt"].to_numpy(), lengths)
        counts = np.bincount(at[learn], n[learn], len(pairs)).astype(np.int64)
        entries = np.diff(at, prepend=0)
        entries[begin] = at[begin]
        word, context = pairs >> CONTEXT_BITS, pairs & ((1 << CONTEXT_BITS) - 1)
        word_counts = np.bincount(word, counts, len(names)).astype(np.int64)
        spread = _within(names, frequent)
        by_context = np.bincount(context, counts, 1 << CONTEXT_BITS).astype(np.int64)
        single = np.bincount(context[counts == 1], minlength=1 << CONTEXT_BITS)
        path = _save(
            folder,
            {
                "words": names.tobytes(), "word_counts": word_counts.tobytes(), "pair_runs": _planes(np.bincount(word, minlength=len(names))),
                "pair_contexts": _planes(context), "pair_counts": counts.tobytes(), "entries": _planes(entries), "rows": b"".join(group["rows"]),
                "many": _planes(many), "times": _planes(n[many]), "slices": group["slice"].tolist(), "slice_lengths": lengths.tolist(),
                "context_sums": _sparse(by_context), "single_sums": _sparse(single),
            },
        )
        made = pd.DataFrame(
            {
                "part": [part], "slice": [-1], "path": [path], "n_train": [int(counts.sum())], "n_words": [int((word_counts[~spread] > 0).sum())],
                "ones": [int((counts == 1).sum())], "twos": [int((counts == 2).sum())],
                "frequent": [[{"word": int(w), "n": int(n)} for w, n in zip(names[spread].view(np.int64), word_counts[spread], strict=True)]],
                "documents": [None],
            }
        )[names_out]
        del key, pairs, at, n, entries, many, learn
        release()
        return made

    return merge


def _ints(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<i8")


def _first_seats(path: str) -> dict:
    """Each word of a context at one table. Pairs that occur once stay so; only the others are kept here."""
    part = _load(path, "words", "pair_runs", "pair_contexts", "pair_counts")
    counts = _ints(part.pair_counts)
    word = np.repeat(np.arange(len(part.words) // 8), _from_planes(part.pair_runs))
    again = np.flatnonzero(counts > 1)
    singles = np.bincount(word[counts == 1], minlength=len(part.words) // 8)
    return {
        "words": part.words, "singles": singles.astype("<i8").tobytes(), "pair_words": _planes(word[again]),
        "pair_contexts": _planes(_from_planes(part.pair_contexts)[again]), "pair_counts": counts[again].tobytes(), "sizes": counts[again].tobytes(),
        "tables": _planes(np.ones(len(again), np.int64)), "parent_sizes": b"", "parent_tables": np.zeros(len(singles), "<i8").tobytes(),
        "table_sums": np.zeros(len(again), "<i8").tobytes(), "parents": [],
    }


_SEAT_COLUMNS = (
    "words", "singles", "pair_words", "pair_contexts", "pair_counts", "sizes", "tables", "parent_sizes", "parent_tables", "table_sums", "parents",
)


def _sweep(model: Model, last: Totals | None, number: int, folder: str):
    """One pass of Gibbs moves over a part: its pairs against the parent's last state, then the parent's own dishes."""
    keep = number >= BURN_IN
    first_discount, second_discount = model.discount
    base = 1.0 / (model.vocabulary + 1)

    def task() -> Callable[[SimpleNamespace], Iterator[dict]]:
        totals = context_table(model.single_path)
        if last is not None:
            totals = totals + context_table(last.path)

        def sweep(entry: SimpleNamespace) -> Iterator[dict]:
            part = int(entry.part)
            row = SimpleNamespace(**_first_seats(entry.path)) if last is None else _load(entry.seats, *_SEAT_COLUMNS)
            rng = np.random.default_rng([SEED, number, part])
            names = np.frombuffer(row.words, np.uint64)
            singles, word = _ints(row.singles), _from_planes(row.pair_words)
            context, counts = _from_planes(row.pair_contexts), _ints(row.pair_counts)
            sizes, tables = _ints(row.sizes), _from_planes(row.tables)
            spread = np.flatnonzero(_within(names, model.frequent))
            if last is not None:
                seated, parent = _parent(row, names, spread, last.frequent)
                chance = (seated - first_discount * parent) / (STRENGTH + last.customers)
                chance = chance + (STRENGTH + first_discount * last.tables) / (STRENGTH + last.customers) * base
                slope = second_discount * chance[word]
                fixed = (STRENGTH + second_discount * (totals[context] - tables)) * chance[word]
                sizes, tables = seat(sizes, tables, counts, fixed, slope, second_discount, rng, number == 1)
            sent = singles + np.bincount(word, tables, len(names)).astype(np.int64)
            goal = sent.copy()
            home = _range(names[spread], model.parts) == part
            known = last.frequent if last is not None else {}
            goal[spread] = [known.get(int(w), (0, 0))[0] if h else 0 for w, h in zip(names[spread].view(np.int64), home, strict=True)]
            parent_lengths = _ints(row.parent_tables)
            all_tables = last.tables if last is not None else 0.0
            fixed = np.maximum(STRENGTH + first_discount * (all_tables - parent_lengths), STRENGTH) * base
            parent_sizes, parent_lengths = seat(
                _ints(row.parent_sizes), parent_lengths, goal, fixed, np.full(len(names), first_discount * base), first_discount, rng
            )
            kept = np.stack([sent, parent_lengths]).astype("<i8").tobytes()
            sums = np.bincount(context, tables, 1 << CONTEXT_BITS).astype(np.int64)
            seats = _save(
                folder,
                {
                    "words": row.words, "singles": row.singles, "pair_words": row.pair_words, "pair_contexts": row.pair_contexts,
                    "pair_counts": row.pair_counts, "sizes": sizes.astype("<i8").tobytes(), "tables": _planes(tables),
                    "parent_sizes": parent_sizes.astype("<i8").tobytes(), "parent_tables": parent_lengths.astype("<i8").tobytes(),
                    "table_sums": (_ints(row.table_sums) + (tables if keep else 0)).astype("<i8").tobytes(),
                    "parents": [*(row.parents if number > BURN_IN else []), kept], "context_sums": _sparse(sums),
                },
            )
            often = zip(names[spread].view(np.int64), sent[spread], parent_lengths[spread], strict=True)
            yield {
                "part": part, "path": entry.path, "seats": seats, "customers": int(sent.sum()), "parent_total": int(parent_lengths.sum()),
                "frequent": [{"word": int(w), "c": int(c), "t": int(t)} for w, c, t in often],
            }

        return sweep

    return task


def _parent(row, names: np.ndarray, spread: np.ndarray, frequent: dict[int, tuple[int, int]], sample: int = -1) -> tuple[np.ndarray, np.ndarray]:
    """Customers and tables of each word in the parent's restaurant after a sweep; of frequent words, those of all parts."""
    seated, tables = np.frombuffer(row.parents[sample], "<i8").reshape(2, -1).copy()
    for at, word in zip(spread, names[spread].view(np.int64), strict=True):
        seated[at], tables[at] = frequent[int(word)]
    return seated, tables


def _totals(seats: DataFrame) -> Totals:
    row = seats.agg(F.sum("customers").alias("c"), F.sum("parent_total").alias("t")).first()
    often = seats.select(F.explode("frequent").alias("f")).groupBy("f.word").agg(F.sum("f.c").alias("c"), F.sum("f.t").alias("t")).collect()
    return Totals(
        float(row["c"] or 0), float(row["t"] or 0), {r["word"]: (r["c"], r["t"]) for r in often}, _sum_contexts(seats, "seats", "context_sums", "context-tables")
    )


def train(docs: DataFrame, id: str = "doc_id", text: str = "text") -> tuple[Model, DataFrame, DataFrame]:
    """The model, the written table of its parts with the slices' documents, and that of the parts' last seating. A part's file also
    knows where in the documents each pair occurs.

    All rows are encoded, those that ``learnt`` holds out with a count of nothing. Null texts are empty; an empty text is an
    end token after the start. Null ids are learnt from; rows that repeat an id or a text count as often as they occur.
    Without any row, or without one to learn from, the model knows nothing. Other columns are not read. ``docs`` should be read
    from files, so that a repeated task sees its rows in the same order.
    """
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length(F.col(text).cast("string")))).first()[0] or 0
    parts = max(1, -(-int(size) // PART_BYTES))
    one = docs.select(id, F.col(text).cast("string").alias(text))
    frequent = _frequent(one, text, parts)
    blocks = _blocks(one, id, text, frequent, parts)
    folder = scratch(spark, "parts")
    static = staged(blocks.groupBy("part").applyInPandas(_merge(frequent, folder), _STATIC), "pairs")
    known = _parted(static.where("part >= 0"), parts)
    sums = known.agg(*(F.sum(c).alias(c) for c in ("n_train", "n_words", "ones", "twos"))).first()
    often = known.select(F.explode("frequent").alias("f")).groupBy("f.word").agg(F.sum("f.n").alias("n")).collect()
    counts = {r["word"]: r["n"] for r in often}
    ones, twos = sums["ones"] or 0, sums["twos"] or 0
    discount = min(max((ones + 1) / (ones + 2 * twos + 2), 0.1), 0.95)
    model = Model(
        parts, frequent, int(sums["n_train"] or 0), int(sums["n_words"] or 0) + sum(n > 0 for n in counts.values()), (discount, discount), counts,
        _sum_contexts(known, "path", "context_sums", "contexts"), _sum_contexts(known, "path", "single_sums", "single-pairs"), [],
    )
    seats = known.select("part", "path", F.lit(None).cast("string").alias("seats"))
    last = before = None
    for number in range(BURN_IN + SAMPLES):
        seats = staged(_by_row(_parted(seats, parts), _sweep(model, last, number, f"{folder}-{number}"), _SEATS), "seats")
        last = _totals(_parted(seats, parts))
        if before is not None:
            discard(before)
            _delete(spark, f"{folder}-{number - 1}")
        before = seats
        if number >= BURN_IN:
            model.samples.append(last)
    return model, static, seats


def _delete(spark, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def pair_chances(
    model: Model, seats, context_counts: np.ndarray, samples: list[np.ndarray], names: np.ndarray, word: np.ndarray, context: np.ndarray, counts: np.ndarray
) -> np.ndarray:
    """The predictive probability of each (context, word) pair of a part, averaged over the sampled seatings."""
    first_discount, second_discount = model.discount
    base = 1.0 / (model.vocabulary + 1)
    spread = np.flatnonzero(_within(names, model.frequent))
    room = STRENGTH + context_counts[context]
    tables = (counts == 1).astype(float)
    tables[counts > 1] = _ints(seats.table_sums) / len(model.samples)
    chance = (counts - second_discount * tables) / room
    for number, (totals, by_context) in enumerate(zip(model.samples, samples, strict=True)):
        seated, parent = _parent(seats, names, spread, totals.frequent, number)
        single = (seated - first_discount * parent + (STRENGTH + first_discount * totals.tables) * base) / (STRENGTH + totals.customers)
        chance += (STRENGTH + second_discount * by_context[context]) / room * single[word] / len(model.samples)
    return chance


def _partial(model: Model):
    """For each part and slice: what the part's pairs add to the scores of the slice's documents."""

    columns = ("words", "word_counts", "pair_runs", "pair_contexts", "pair_counts", "entries", "rows", "many", "times", "slices", "slice_lengths")

    def task() -> Callable[[SimpleNamespace], Iterator[dict]]:
        context_counts = context_table(model.context_path)
        single = context_table(model.single_path)
        samples = [single + context_table(s.path) for s in model.samples]

        def partial(entry: SimpleNamespace) -> Iterator[dict]:
            row = _load(entry.path, *columns)
            seats = _load(entry.seats, "table_sums", "parents")
            names, counts = np.frombuffer(row.words, np.uint64), _ints(row.pair_counts)
            word, context = np.repeat(np.arange(len(names)), _from_planes(row.pair_runs)), _from_planes(row.pair_contexts)
            chances = np.log10(pair_chances(model, seats, context_counts, samples, names, word, context, counts))
            word_counts = _ints(row.word_counts).copy()
            for at in np.flatnonzero(_within(names, model.frequent)):
                word_counts[at] = model.counts[int(names[at : at + 1].view(np.int64)[0])]
            plain = np.log10((word_counts + 1) / (model.train_tokens + (model.vocabulary + 1)))[word]
            seen = (word_counts > 0)[word]
            entries, document = _from_planes(row.entries), np.frombuffer(row.rows, "<u2")
            n = np.ones(len(document), np.int64)
            n[_from_planes(row.many)] = _from_planes(row.times)
            begin = 0
            for slice_, length in zip(row.slices, row.slice_lengths, strict=True):
                at = np.cumsum(entries[begin : begin + length])
                rows, times = document[begin : begin + length], n[begin : begin + length]
                begin += length
                found, rows = np.unique(rows, return_inverse=True)
                own[slice_].append((found, *(np.bincount(rows, v[at] * times) for v in (chances, plain, seen))))
            yield from ()

        def close() -> Iterator[dict]:
            # The parts of a task are added up before anything is shuffled.
            for slice_, pieces in own.items():
                rows, *sums = (np.concatenate(x) for x in zip(*pieces, strict=True))
                found, rows = np.unique(rows, return_inverse=True)
                score, base, known = (np.bincount(rows, v) for v in sums)
                yield {"slice": slice_, "rows": found.tobytes(), "sums": score.tobytes() + base.tobytes(), "known": known.astype("<u4").tobytes()}

        own: dict[int, list] = defaultdict(list)
        partial.close = close
        return partial

    return task


def score(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score`` of every row, see
    :func:`train`; both scores are log10 probabilities of the whole text with its end. Perplexity is 10^(-score / n_tokens)."""
    model, static, seats = train(docs, id, text)
    kind = docs.schema[id].dataType.simpleString()
    sums = _by_row(_parted(seats.select("part", "path", "seats"), model.parts), _partial(model), "slice long, rows binary, sums binary, known binary")
    own = static.where("part < 0").select("slice", "documents")
    both = sums.withColumn("documents", F.lit(None).cast("binary")).unionByName(own, allowMissingColumns=True)

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros((3, SLICE_ROWS))
        for rows, data, known, documents in zip(*(table.column(c).to_pylist() for c in ("rows", "sums", "known", "documents")), strict=True):
            if documents is None:
                at = np.frombuffer(rows, "<u2")
                total[:2, at] += np.frombuffer(data, float).reshape(2, -1)
                total[2, at] += np.frombuffer(known, "<u4")
            else:
                own = pa.ipc.open_stream(documents).read_all()
        n = own.num_rows
        known = pa.array(np.rint(total[2, :n]).astype(np.int64))
        everything = pa.array(np.full(n, model.train_tokens, np.int64))
        return pa.table(
            [*(own.column(c) for c in ("id", "held_out", "n_tokens")), known, everything, pa.array(total[1, :n]), pa.array(total[0, :n])],
            names=[id, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    schema = f"`{id}` {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return both.groupBy("slice").applyInArrow(add, schema)
