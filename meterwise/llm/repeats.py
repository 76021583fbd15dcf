"""Byte strings that repeat across documents, found by merging Burrows-Wheeler transforms.

Every window of WIDTH bytes is filed under its minimiser, the smallest hash of GRAM consecutive bytes in it, so equal windows of
any two documents are filed together. Consecutive windows with the same minimiser are one piece of text. Where a minimiser
has one piece only, all that repeats is that piece as a whole. Where it has several, their windows may be equal in part:
such pieces are dealt out by minimiser, split into shards, each shard's transform is built, and the transforms are merged by
iterative interleave refinement, ten symbols a round, which gives the windows that are equal, without sorting all suffixes together. Where it has
more pieces than a task should hold, their windows are compared one by one instead.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterwise.llm.common import byte_view, discard, release, row_slices, staged
from meterwise.llm.shared import BitFilter, shared_filter, write_filter
from meterwise.llm.words import mix

WIDTH = 50
GRAM = 20
#: Windows of a piece at most; also the number of minimiser candidates of a window.
REACH = WIDTH - GRAM + 1
#: Bytes of pieces that are merged in one task, about; a minimiser with more pieces than PIECES is judged by its windows.
MERGED = 512 << 10
PIECES = 10_000
#: Bytes of a shard whose suffixes are sorted by themselves.
SHARD = 128 << 10
#: Symbols that a round of the merge goes on by; a divisor of WIDTH.
STEP = 10
#: Bytes of text that are hashed at once; the work arrays are some 25 times as large, and short ones stay in the cache.
SLICE = 64 << 10
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _grams(data: np.ndarray) -> np.ndarray:
    """A hash of the GRAM (20) bytes from each place on."""
    m = len(data) - GRAM + 1
    # The bytes from each place on, read as numbers: two of eight bytes and one of four. Each is mixed before the next
    # is added, so that differences in the same bytes of two of them do not cancel out.
    number = lambda kind, place: np.ndarray(m, kind, data, place, (1,))
    h = number("<u8", 0) * _A
    h ^= h >> np.uint64(32)
    h += number("<u8", 8)
    h *= _B
    h ^= h >> np.uint64(29)
    h += number("<u4", 16)
    return mix(h)


def pieces(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of consecutive rows' bytes: minimiser, hash of the bytes, row, first window and number of windows of every piece. A piece
    of n windows has n + WIDTH - 1 bytes. Pieces never cross rows."""
    none = np.zeros(0, np.int64)
    if len(data) < WIDTH:
        return none.astype(np.uint64), none.astype(np.uint64), none, none, none
    grams = least = _grams(data)
    for gap in (1, 2, 4, 8):
        least = np.minimum(least[:-gap], least[gap:])
    n = len(data) - WIDTH + 1
    least = np.minimum(least[:n], least[REACH - 16 : REACH - 16 + n])
    fresh = np.ones(n, bool)
    np.not_equal(least[1:], least[:-1], out=fresh[1:])
    fresh[edges[:-1][edges[:-1] < n]] = True
    begin = np.flatnonzero(fresh)
    row = np.searchsorted(edges, begin, "right") - 1
    # Up to the next piece or the row's last window; what begins behind that is none.
    count = np.minimum(np.append(begin[1:], n), edges[row + 1] - WIDTH + 1) - begin
    held = count > 0
    begin, row, count = begin[held], row[held], count[held]
    if len(begin) and count.max() > REACH:  # the same minimiser again and again, as in a run of one byte
        cuts = -(-count // REACH)
        step = np.arange(cuts.sum()) - np.repeat(np.cumsum(cuts) - cuts, cuts)
        begin, row, count = np.repeat(begin, cuts) + step * REACH, np.repeat(row, cuts), np.minimum(REACH, np.repeat(count, cuts) - step * REACH)
    # Smallest hashes lie close together; mixed anew they are spread evenly.
    return mix(least[begin]), _hashes(grams, begin, count + WIDTH - 1), row, begin, count


def _hashes(grams: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A hash of the bytes of each piece, from the hashes of grams that cover it."""
    h = mix(size.astype(np.uint64) * _B)
    for at in range(0, WIDTH + REACH - 1, GRAM):
        h = mix(h + grams[begin + np.minimum(at, size - GRAM)])
    return h


def _minimisers(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    """The minimisers of a batch's texts, each once per text."""
    for part in row_slices(batch, "__text", SLICE):
        minimiser, _, row, _, _ = pieces(*byte_view(part.column(part.schema.get_field_index("__text"))))
        # Rows ascend, and equal minimisers stay in their order.
        order = np.argsort(minimiser, kind="stable")
        minimiser, row = minimiser[order], row[order]
        keep = np.ones(len(row), bool)
        keep[1:] = (minimiser[1:] != minimiser[:-1]) | (row[1:] != row[:-1])
        yield minimiser[keep]


def _occurrences(texts: DataFrame, filter_path: str) -> DataFrame:
    """The pieces whose minimiser passes the filter: ``minimiser``, ``piece`` (hash of its bytes), ``doc``, ``tag``, ``at`` (first
    byte) and ``n`` (windows)."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passed = BitFilter(filter_path)
        release()
        for batch in batches:
            for part in row_slices(batch, "__text", SLICE):
                data, edges = byte_view(part.column(2))
                minimiser, piece, row, begin, count = (x[keep] for found in [pieces(data, edges)] for keep in [passed.passes(found[0])] for x in found)
                doc, tag = part.column(0).to_numpy(zero_copy_only=False), part.column(1).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_pydict(
                    {
                        "minimiser": pa.array(minimiser.view(np.int64)), "piece": pa.array(piece.view(np.int64)),
                        "doc": pa.array(doc[row]), "tag": pa.array(tag[row]), "at": pa.array((begin - edges[row]).astype(np.int64)), "n": pa.array(count.astype(np.int32)),
                    }
                )
        release()

    return texts.mapInArrow(find, "minimiser long, piece long, doc long, tag int, at long, n int")


def _held_by(minimiser: np.ndarray, piece: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """A number for a piece in a document."""
    return mix(minimiser ^ mix(piece ^ mix(doc.astype(np.int64).view(np.uint64) + _A)))


def _first_filter(known: DataFrame) -> str:
    """The filter of pieces in the smallest document that has them."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            minimiser, piece, doc = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            yield pa.RecordBatch.from_arrays([pa.array(_held_by(minimiser.view(np.uint64), piece.view(np.uint64), doc).view(np.int64))], names=["n"])

    return write_filter(known.select("minimiser", "piece", "least").mapInArrow(number, "n long"), "n")


def _piece_texts(texts: DataFrame, first_path: str) -> DataFrame:
    """``minimiser``, ``piece``, ``doc`` and ``text`` of the pieces that pass the filter with their document; a piece comes once per slice
    of texts and document. As the filter has one document of each piece, what many documents share is not handed on by each
    of them."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passed = BitFilter(first_path)
        release()
        for batch in batches:
            for part in row_slices(batch, "__text", SLICE):
                data, edges = byte_view(part.column(2))
                minimiser, piece, row, begin, count = pieces(data, edges)
                size = count + WIDTH - 1
                doc = part.column(0).to_numpy(zero_copy_only=False)[row]
                number = _held_by(minimiser, piece, doc)
                keep = np.flatnonzero(passed.passes(number))
                first = keep[np.unique(number[keep], return_index=True)[1]]
                raw = data.tobytes()
                held = [raw[b : b + s] for b, s in zip(begin[first].tolist(), size[first].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(minimiser[first].view(np.int64)), pa.array(piece[first].view(np.int64)), pa.array(doc[first], pa.int64()), pa.array(held, pa.binary())],
                    names=["minimiser", "piece", "doc", "text"],
                )
        release()

    return texts.mapInArrow(find, "minimiser long, piece long, doc long, text binary")


class Transform:
    """The suffixes of a shard, in order, and the symbol before each: its Burrows-Wheeler transform. Pieces are separated by
    the symbol 0, bytes count one more; the shard is read as a ring. Texts are distinct. With a depth, suffixes that have
    so many symbols in common stand in any order."""

    def __init__(self, texts: list[bytes], depth: int | None = None) -> None:
        raw = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
        sizes = np.array([len(t) + 1 for t in texts])
        self.symbols = raw.astype(np.int16) + 1
        self.symbols[np.cumsum(sizes) - 1] = 0
        n = len(self.symbols)
        enough = min(n, depth or n)
        used = np.bincount(self.symbols, minlength=257) > 0
        code, base = (np.cumsum(used) - 1)[self.symbols], int(used.sum())
        key, most, width = code, base, 1
        # As many symbols as can be sorted at once, before anything is sorted.
        while most * base < _sortable(n) and width < enough:
            key, most, width = key * base + np.roll(code, -width), most * base, width + 1
        while True:
            order, rank, most = _ranked(key, most)
            if most == n or width >= enough:
                break
            key = rank * most + np.roll(rank, -width)
            most, width = most * most, width * 2
        self.suffixes = order
        self.transform = self.symbols[order - 1]


def _sortable(n: int) -> int:
    """Numbers below this can be sorted together with their places, n of them."""
    return 1 << (63 - n.bit_length())


def _ranked(codes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, int]:
    """The order of the numbers, all below ``most``, their places among the distinct ones, and how many these are."""
    n = len(codes)
    if most <= _sortable(n):
        # One sort of numbers with their places takes about half the time of sorting places by their numbers.
        bits = n.bit_length()
        held = (codes << bits) | np.arange(n)
        held.sort()
        order = held & ((1 << bits) - 1)
        held >>= bits
    else:
        order = np.argsort(codes)
        held = codes[order]
    fresh = np.zeros(n, np.int64)
    fresh[1:] = held[1:] != held[:-1]
    fresh = np.cumsum(fresh)
    rank = np.empty(n, np.int64)
    rank[order] = fresh
    return order, rank, int(fresh[-1]) + 1


def _before(shards: list[Transform], step: int) -> np.ndarray:
    """Of each suffix, shard after shard in their orders, the ``step`` symbols that stand before it, as one small number."""
    edges = np.cumsum([0] + [len(s.suffixes) for s in shards])
    back = lambda x, gap: np.concatenate([np.roll(x[a:b], gap) for a, b in zip(edges, edges[1:], strict=False)])
    used = np.unique(np.concatenate([s.transform for s in shards]))
    code = np.zeros(257, np.int64)
    code[used] = np.arange(len(used))
    symbols, most = code[np.concatenate([s.symbols for s in shards])], len(used)
    # Stretches of so many symbols become one small number each, and these numbers together one for the step.
    enough = _sortable(int(edges[-1]))
    wide = max(c for c in range(1, step + 1) if step % c == 0 and (c == 1 or most**c <= enough))
    made = back(symbols, 1)
    for gap in range(2, wide + 1):
        made += back(symbols, gap) * most ** (gap - 1)
    _, made, most = _ranked(made, most**wide)
    part, each = made, most
    for gap in range(wide, step, wide):
        if most * each > enough:
            _, made, most = _ranked(made, most)
        made, most = made + back(part, gap) * most, most * each
    if wide < step:
        _, made, _ = _ranked(made, most)
    return np.concatenate([made[a:b][s.suffixes] for a, b, s in zip(edges, edges[1:], shards, strict=False)])


def merge_transforms(shards: list[Transform], depth: int, step: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merges the transforms by interleave refinement to suffixes in the order of their first ``depth`` symbols, a multiple of
    ``step``.

    Returns the shard and the place in it of each suffix in merged order, and the length of the prefix that it has in
    common with the one before it, rounded down to a multiple of ``step``, ``depth`` where it is that or more. Each round reads
    all transforms once in the order so far and puts what stands ``step`` symbols before each suffix behind the others with
    the same symbols: an order by h symbols becomes one by h + step, and neighbours that fall apart have h to h + step - 1
    symbols in common. No suffixes are compared.
    """
    before = _before(shards, step)
    n = len(before)
    # A number and the place it was read at are sorted as one, which keeps equal numbers in order.
    bits = n.bit_length()
    at, mask = np.arange(n), (1 << bits) - 1
    before <<= bits
    origin = np.repeat(np.arange(len(shards), dtype=np.min_scalar_type(len(shards))), [len(s.suffixes) for s in shards])
    common = np.full(n, depth, np.int16)
    common[0] = 0
    block = np.zeros(n, np.int32)
    read = at
    now = np.empty(n, np.int64)
    for h in range(0, depth, step):
        now[read] = before
        now |= at
        now.sort()
        order = now & mask
        now >>= bits
        block = block[order]
        apart = np.zeros(n, bool)
        apart[1:] = (now[1:] != now[:-1]) | (block[1:] != block[:-1])
        common[apart & (common == depth)] = h
        block = np.cumsum(apart, dtype=np.int32)
        origin = origin[order]
        read = np.argsort(origin, kind="stable")
        if block[-1] == n - 1:
            break
    place = np.empty(n, np.int64)
    place[read] = np.concatenate([s.suffixes for s in shards])
    return origin, place, common


def windows_of_smaller(texts: list[bytes], docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, first window and number of windows of the runs of windows of WIDTH bytes that also occur in a text with a smaller
    document. Texts are distinct."""
    shards, held, size = [], [], 0
    for i, text in enumerate(texts):
        held.append(text)
        size += len(text) + 1
        if size > SHARD or i == len(texts) - 1:
            shards.append(Transform(held, WIDTH))
            held, size = [], 0
    origin, place, common = merge_transforms(shards, WIDTH, STEP)
    # Where each suffix stands in all shards, one after the other, and what begins at each place.
    place += np.cumsum([0] + [len(s.symbols) for s in shards])[origin]
    sizes = np.array([len(t) + 1 for t in texts])
    ends = np.cumsum(sizes)
    starts = ends - sizes
    whole = (np.arange(ends[-1]) - np.repeat(starts, sizes) + WIDTH < np.repeat(sizes, sizes))[place]
    doc = np.where(whole, np.repeat(docs, sizes)[place], np.iinfo(np.int64).max)
    equal = np.flatnonzero(common < WIDTH)
    smallest = np.repeat(np.minimum.reduceat(doc, equal), np.diff(np.append(equal, len(doc))))
    # The last places of a text begin no window, so no run goes on in the next one.
    marked = np.zeros(len(doc) + 1, bool)
    marked[place[whole & (smallest < doc)]] = True
    edge = np.flatnonzero(np.diff(marked, prepend=False))
    text = np.searchsorted(ends, edge[::2], "right")
    return text, edge[::2] - starts[text], edge[1::2] - edge[::2]


def _partly_equal(placed: DataFrame, texts: DataFrame) -> DataFrame:
    """``doc``, ``tag``, ``at``, ``n``: windows of pieces that share their minimiser with other pieces and occur in a smaller document.

    ``placed`` has all occurrences of such pieces. A piece is judged once, for the smallest document that has it; in any
    other document all of it is repeated. A task that merges has whole minimisers of PIECES pieces at most, a row per piece.
    """
    known = staged(placed.groupBy("minimiser", "piece").agg(F.min("doc").alias("least"), F.min("n").alias("n")), "pieces")
    crowded = known.groupBy("minimiser").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > PIECES)
    crowded = staged(crowded.select(F.col("minimiser").alias("__m"), F.lit(True).alias("crowded")), "crowded")
    marked = known.join(crowded, F.col("minimiser") == F.col("__m"), "left").select("minimiser", "piece", "least", "n", F.coalesce("crowded", F.lit(False)).alias("crowded"))
    # Which numbers pass a filter wrongly falls out here.
    held = _piece_texts(texts, _first_filter(known)).withColumnsRenamed({"minimiser": "__m", "piece": "__p"})
    held = held.join(marked, (F.col("__m") == F.col("minimiser")) & (F.col("__p") == F.col("piece")) & (F.col("doc") == F.col("least")))
    held = staged(held.select("minimiser", "piece", "least", "crowded", "text"), "held")
    total = marked.where("not crowded").agg(F.sum(F.col("n") + WIDTH - 1).alias("n")).first()["n"] or 0
    buckets = max(1, -(-total // MERGED))
    dealt = held.where("not crowded").withColumn("bucket", F.pmod(F.xxhash64("minimiser"), F.lit(buckets)).cast("int")).select("bucket", "minimiser", "piece", "least", "text")

    def judge(found: pd.DataFrame) -> pd.DataFrame:
        # Rows that share the smallest document may each have given the piece. Pieces are told apart by hashes of their texts,
        # so texts are distinct.
        found = found.drop_duplicates(["minimiser", "piece"])
        text, begin, count = windows_of_smaller(found["text"].tolist(), found["least"].to_numpy())
        minimiser, piece, doc = (found[c].to_numpy()[text] for c in ("minimiser", "piece", "least"))
        del found
        release()
        return pd.DataFrame({"minimiser": minimiser, "piece": piece, "doc": doc, "from": begin.astype(np.int32), "count": count.astype(np.int32)})

    merged = dealt.groupBy("bucket").applyInPandas(judge, "minimiser long, piece long, doc long, from int, count int")
    judged = staged(merged.unionByName(_by_windows(held.where("crowded"))), "judged")
    # The one document of a piece may hold it more than once.
    partly = placed.join(judged, ["minimiser", "piece", "doc"]).select("doc", "tag", (F.col("at") + F.col("from")).alias("at"), F.col("count").alias("n"))
    later = placed.join(known.drop("n"), ["minimiser", "piece"]).where("doc > least").select("doc", "tag", "at", "n")
    return partly.unionByName(later)


def _by_windows(held: DataFrame) -> DataFrame:
    """The verdicts on the pieces of crowded minimisers (``minimiser``, ``piece``, ``least``, ``text``): ``minimiser``, ``piece``, ``doc``, ``from``,
    ``count``.

    The piece at the edge of a passage that many documents share differs in each of them, and they have windows in common. The
    least document of each window is found by an aggregate, combined before the shuffle, and joined back; windows that one
    document only has are not. Distinct windows have nothing in common that a transform could find.
    """
    at = F.explode(F.sequence(F.lit(0), F.length("text") - WIDTH))
    windows = held.withColumn("from", at).withColumn("window", F.substr(F.col("text"), F.col("from") + 1, F.lit(WIDTH))).drop("text")
    least = windows.groupBy("minimiser", "window").agg(F.min("least").alias("first"), F.max("least").alias("last")).where("first < last")
    # Staged, so that both sides of the join are shuffles, which adaptive execution can split.
    least = staged(least.select(F.col("minimiser").alias("__m"), F.col("window").alias("__w"), "first"), "windows")
    hit = windows.join(least, (F.col("minimiser") == F.col("__m")) & (F.col("window") == F.col("__w")) & (F.col("least") > F.col("first")))
    # Consecutive windows of a piece, of which it has REACH at most, become one row.
    hit = hit.groupBy("minimiser", "piece", F.col("least").alias("doc")).agg(F.collect_set("from").alias("hit"))
    edges = lambda gap: F.array_sort(F.filter("hit", lambda x: ~F.array_contains("hit", x + gap)))
    runs = hit.select("minimiser", "piece", "doc", F.explode(F.arrays_zip(edges(-1).alias("a"), edges(1).alias("b"))).alias("run"))
    return runs.select("minimiser", "piece", "doc", F.col("run.a").alias("from"), (F.col("run.b") - F.col("run.a") + 1).alias("count"))


def _tagged(docs: DataFrame, id: str, text: str, *more: str) -> DataFrame:
    """``__doc``, ``__tag``, ``__text`` and more columns. The tag is 0, or a hash of the text where several texts share an id."""
    one = docs.select(F.col(id).cast("long").alias("__doc"), F.shiftright(F.xxhash64(text), 32).cast("int").alias("__hash"), F.col(text).cast("string").alias("__text"), *more)
    twins = one.where("__doc is not null").groupBy(F.col("__doc").alias("__twin")).agg(F.min("__hash").alias("a"), F.max("__hash").alias("b")).where("a <> b")
    twins = staged(twins.select("__twin"), "twins")
    tag = F.when(F.col("__twin").isNotNull(), F.col("__hash")).otherwise(F.lit(0))
    return one.join(twins, F.col("__doc") == F.col("__twin"), "left").select("__doc", tag.alias("__tag"), "__text", *more)


def repeated_spans(docs: DataFrame, id: str = "doc_id", text: str = "text", parts: int | None = None) -> DataFrame:
    """``__doc``, ``__tag`` (of the text, so that rows that share an id are told apart) and ``__at``: the first bytes and numbers
    of windows that also start in a document with a smaller id. Windows are of the UTF-8 bytes; null texts and texts of
    less than WIDTH bytes have none. Ids are whole numbers; a row without one is neither judged nor a witness. Rows with
    the same id do not count as smaller than each other.
    """
    spark = docs.sparkSession
    texts = _tagged(docs, id, text).where("__doc is not null and octet_length(__text) >= 50")
    shared = shared_filter(texts.select("__text"), _minimisers, parts or int(spark.conf.get("spark.sql.shuffle.partitions")))
    found = staged(_occurrences(texts, shared), "occurrences")
    groups = found.groupBy("minimiser").agg(F.min("doc").alias("least"), F.max("doc").alias("most"), F.min("piece").alias("p"), F.max("piece").alias("q"))
    groups = groups.where("least < most").select("minimiser", "least", (F.col("p") == F.col("q")).alias("alone"))
    placed = staged(found.join(groups, "minimiser").where("not alone or doc > least").drop("least"), "placed")
    discard(found)
    whole = placed.where("alone").select("doc", "tag", "at", "n")
    several = placed.where("not alone").drop("alone")
    partly = _partly_equal(several, texts)
    spans = whole.unionByName(partly)
    return spans.groupBy(F.col("doc").alias("__doc"), F.col("tag").alias("__tag")).agg(F.collect_list(F.struct("at", "n")).alias("__at"))


def _cut(data: np.ndarray, edges: np.ndarray, held: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Begin, end and row of the runs of bytes that the rows' windows (``at``, ``n``) cover, and each row's other bytes."""
    rows = len(edges) - 1
    gone = np.zeros(len(data), bool)
    if held.null_count < rows:
        windows = held.flatten()
        at, n = (pc.struct_field(windows, c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("at", "n"))
        at += np.repeat(edges[:-1], pc.fill_null(pc.list_value_length(held), 0).to_numpy(zero_copy_only=False))
        change = np.zeros(len(data) + 1, np.int64)
        np.add.at(change, at, 1)
        np.subtract.at(change, at + n + WIDTH - 1, 1)
        gone = np.cumsum(change[:-1]) > 0
    first, last = gone.copy(), gone.copy()
    first[1:] &= ~gone[:-1]
    last[:-1] &= ~gone[1:]
    inner = edges[(edges > 0) & (edges < len(data))]
    first[inner], last[inner - 1] = gone[inner], gone[inner - 1]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    stays = np.concatenate([[0], np.cumsum(~gone)])[edges].astype(np.int32)
    kept = pa.Array.from_buffers(pa.binary(), rows, [None, pa.py_buffer(stays.tobytes()), pa.py_buffer(data[~gone].tobytes())])
    return begin, end, np.searchsorted(edges, begin, "right") - 1, kept


def without_repeats(docs: DataFrame, id: str = "doc_id", text: str = "text", parts: int | None = None) -> DataFrame:
    """Per row of docs: ``id``, ``n_bytes``, ``spans`` (byte ranges ``[begin, end)`` of the text that are covered by repeated
    windows, in order, apart from each other) and ``kept`` (the other bytes). Spans are judged on the input, so they do not
    depend on what is removed elsewhere; kept bytes may end within a character."""
    spans = staged(repeated_spans(docs, id, text, parts), "spans")
    kind = dict(docs.dtypes)[id]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in row_slices(batch, "__text", SLICE):
                data, edges = byte_view(part.column(1))
                begin, end, row, kept = _cut(data, edges, part.column(2))
                spans_of = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=part.num_rows))]).astype(np.int32)
                span = pa.StructArray.from_arrays([pa.array(begin - edges[row]), pa.array(end - edges[row])], names=["begin", "end"])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(np.diff(edges)), pa.ListArray.from_arrays(pa.array(spans_of), span), kept], names=[id, "n_bytes", "spans", "kept"]
                )

    # Most texts have no spans and need not be moved to meet them.
    met = write_filter(spans.select(F.xxhash64("__doc").alias("n")), "n")
    schema = f"`{id}` {kind}, n_bytes long, spans array<struct<begin:long,end:long>>, kept binary"
    tagged = _tagged(docs.withColumn("__id", F.col(id)), id, text, "__id").withColumn("__number", F.xxhash64("__doc"))
    maybe = tagged.mapInArrow(_passing(met, True), tagged.schema).drop("__number")
    joined = maybe.join(spans, ["__doc", "__tag"], "left").select("__id", "__text", "__at")

    def cut_others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in keep_others(batches):
            ids, texts = (batch.column(batch.schema.get_field_index(c)) for c in ("__id", "__text"))
            yield from cut([pa.RecordBatch.from_arrays([ids, texts, pa.nulls(batch.num_rows)], names=["__id", "__text", "__at"])])

    # The other texts are cut where they are, in the same Python task that finds them.
    keep_others = _passing(met, False)
    return joined.mapInArrow(cut, schema).unionByName(tagged.mapInArrow(cut_others, schema))


def _passing(filter_path: str, wanted: bool):
    """Keeps the rows whose ``__number`` passes the filter, or the others."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passed = BitFilter(filter_path)
        release()
        for batch in batches:
            for part in row_slices(batch, "__text", SLICE):
                number = part.column(part.schema.get_field_index("__number")).to_numpy(zero_copy_only=False).view(np.uint64)
                yield part.filter(pa.array(passed.passes(number) == wanted))
        release()

    return keep
