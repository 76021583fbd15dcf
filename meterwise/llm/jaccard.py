"""Similarity join on word shingles by a size-aware heavy-light method.

Small sets are light: all their subsets of the size that a link needs are enumerated, and sets that share one are linked
without a comparison. Large sets are heavy: they are found on inverted lists of their rarest shingles. The size where one
becomes cheaper than the other is computed from the lengths of the lists.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meterwise.llm.common import byte_view, discard, free_names, releasing, row_slices, staged
from meterwise.llm.components import components
from meterwise.llm.shared import BitFilter, shared_filter
from meterwise.llm.words import NOT_SPACE, Words, mix

SHINGLE = 5
#: Two sets link when 100 * intersection >= PERCENT * union.
PERCENT = 80
#: Sets above this size are never enumerated; their tokens are not kept for that.
LARGEST_LIGHT = 12
#: Shingles of a task that are counted at once.
COUNTED = 8_000_000
#: Bits of the filter that tells which documents take part in a comparison, at most.
FILTER_BITS = 26


def overlap(a: int, b: int, percent: int = PERCENT) -> int:
    """The least intersection with which sets of sizes a and b link."""
    return -(-percent * (a + b) // (100 + percent))


def partners(n: int, percent: int = PERCENT) -> range:
    """The sizes of sets that a set of size n can link with."""
    return range(-(-percent * n // 100), 100 * n // percent + 1)


def prefix(n, percent: int = PERCENT):
    """Of two sets that link, the first so many shingles of each in a common order share one."""
    return n + (-percent * n // 100) + 1


def shingle_sets(batch: pa.RecordBatch, column: str, shingle: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingles of each row as 64-bit hashes. Fewer words are one shingle, none give an empty set."""
    for part in row_slices(batch, column):
        words = Words(*byte_view(part.column(part.schema.get_field_index(column))), NOT_SPACE)
        begin, hashes = words.windows(shingle)
        edges = np.searchsorted(begin, words.first)
        for row in range(part.num_rows):
            n = int(words.counts[row])
            if 0 < n < shingle:
                h = np.full(1, n, np.uint64)
                for w in words.hash[words.first[row] : words.first[row + 1]]:
                    h = mix(h + w)
                yield h
            else:
                yield np.unique(hashes[edges[row] : edges[row + 1]])


class Order:
    """The order of shingles: first those not known to be frequent, by hash, then the frequent ones, the rarer first."""

    def __init__(self, frequent: np.ndarray, rank: np.ndarray) -> None:
        self.frequent, self.rank = frequent, rank

    def arrange(self, tokens: np.ndarray) -> np.ndarray:
        if not len(self.frequent) or not len(tokens):
            return tokens
        place = np.minimum(np.searchsorted(self.frequent, tokens), len(self.frequent) - 1)
        known = self.frequent[place] == tokens
        late = tokens[known]
        return np.concatenate([tokens[~known], late[np.argsort(self.rank[place[known]], kind="stable")]])


def frequent_shingles(texts: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that many documents have, sorted, and their rank by number of documents.

    A task counts the shingles of all its documents and hands on those in three of them and in one of 4,096; what
    the tasks hand on is added up. All shingles are counted, and which are handed on only decides an order, so no
    link depends on it. A document of s shingles adds s / 4,096 of them at most, so there are few whatever the input.
    """

    @releasing
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush():
            tokens, counts = np.unique(np.concatenate(held), return_counts=True)
            keep = counts >= max(3, docs / 4096)
            return pa.RecordBatch.from_arrays([pa.array(tokens[keep].view(np.int64)), pa.array(counts[keep].astype(np.int64))], names=["token", "n"])

        held, size, docs = [], 0, 0
        for batch in batches:
            for tokens in shingle_sets(batch, "__text", shingle):
                held.append(tokens)
                size += len(tokens)
                docs += 1
                if size > COUNTED:
                    yield flush()
                    held, size, docs = [], 0, 0
        if held:
            yield flush()

    found = texts.select("__text").mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    kept = staged(found.where(F.col("n") >= 16), "frequent")
    total, most = texts.count(), 1 << 20
    # The bound of the broadcast: the most frequent of them, down to a share of documents of which only so many can be.
    least = kept.where(F.col("n") >= total / 4096) if kept.count() > most else kept
    rows = least.orderBy(F.desc("n"), "token").limit(most).toPandas() if least.count() else None
    if rows is None or not len(rows):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    tokens, counts = rows["token"].to_numpy().view(np.uint64), rows["n"].to_numpy()
    rank = np.empty(len(tokens), np.int64)
    rank[np.lexsort((tokens, counts))] = np.arange(len(tokens))
    order = np.argsort(tokens)
    return tokens[order], rank[order]


def prefixes_of(order, shingle: int, percent: int):
    """A function that gives the prefixes of a batch's sets, spread evenly: hashes that come first in an order do not."""

    def prefixes(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        arranged = Order(*order.value)
        for tokens in shingle_sets(batch, "__text", shingle):
            if len(tokens):
                yield mix(arranged.arrange(tokens)[: prefix(len(tokens), percent)])

    return prefixes


def set_table(texts: DataFrame, order, shared: str, shingle: int, percent: int) -> DataFrame:
    """Per row: ``__id``, ``n`` (size of its set), ``digest`` (of the set), ``first`` (what other sets have, too, of its prefix), ``place``
    (where in its order) and ``small`` (all of a small set)."""
    kind = texts.schema["__id"].dataType.simpleString()

    @releasing
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arranged, passed = Order(*order.value), BitFilter(shared)
        for batch in batches:
            for begin in range(0, batch.num_rows, 500):
                part = batch.slice(begin, 500)
                sizes, digests, firsts, places, smalls = [], [], [], [], []
                for tokens in shingle_sets(part, "__text", shingle):
                    n = len(tokens)
                    first = arranged.arrange(tokens)[: prefix(n, percent) if n else 0]
                    sizes.append(n)
                    digests.append(hashlib.blake2b(tokens.tobytes(), digest_size=16).digest())
                    kept = np.flatnonzero(passed.passes(mix(first)))
                    firsts.append(first[kept].view(np.int64))
                    places.append(kept.astype(np.int32))
                    smalls.append(tokens.view(np.int64) if n <= LARGEST_LIGHT else None)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(firsts, pa.list_(pa.int64())), pa.array(places, pa.list_(pa.int32())), pa.array(smalls, pa.list_(pa.int64()))],
                    names=["__id", "n", "digest", "first", "place", "small"],
                )

    return staged(texts.select("__id", "__text").mapInArrow(sets, f"__id {kind}, n long, digest binary, first array<long>, place array<int>, small array<long>"), "sets")


def light_limit(mean_list: float, percent: int = PERCENT) -> int:
    """The largest size at which enumerating subsets makes no more rows than a set meets on its inverted lists."""
    limit = 0
    for n in range(1, LARGEST_LIGHT + 1):
        subsets = sum(comb(n, overlap(n, t, percent)) for t in partners(n, percent))
        if subsets > prefix(n, percent) * max(mean_list, 2.0):
            break
        limit = n
    return limit


def light_links(sets: DataFrame, limit: int, percent: int) -> DataFrame:
    """``a`` and ``b``: links that connect all small sets that share a subset as large as their sizes ask for.

    A row per subset and pair of sizes; in a group every set of the one size links with every set of the other, so each is
    tied to the smallest id of the other size. Groups are aggregated before the shuffle and never listed.
    """
    kind = sets.schema["rep"].dataType.simpleString()

    @releasing
    def subsets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 1000):
                ids, low, high, large, names = [], [], [], [], []
                for name, tokens in zip(*(c.to_pylist() for c in batch.slice(begin, 1000).columns), strict=True):
                    n = len(tokens)
                    for t in partners(n, percent):
                        if t <= limit:
                            for subset in itertools.combinations(tokens, overlap(n, t, percent)):
                                ids.append(name)
                                low.append(min(n, t))
                                high.append(max(n, t))
                                large.append(n >= t)
                                names.append(hashlib.blake2b(np.array(subset, np.int64).tobytes(), digest_size=16).digest())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, batch.schema.field(0).type), pa.array(low, pa.int32()), pa.array(high, pa.int32()), pa.array(large, pa.bool_()), pa.array(names, pa.binary())],
                    names=["id", "low", "high", "large", "subset"],
                )

    small = sets.where((F.col("n") > 0) & (F.col("n") <= limit)).select("rep", "small")
    rows = staged(small.mapInArrow(subsets, f"id {kind}, low int, high int, large boolean, subset binary"), "subsets")
    key = ["low", "high", "subset"]
    hubs = rows.groupBy(*key).agg(F.min(F.when(~F.col("large"), F.col("id"))).alias("low_id"), F.min(F.when(F.col("large"), F.col("id"))).alias("high_id"), F.count(F.lit(1)).alias("k"))
    hubs = hubs.where("k > 1").drop("k")
    # With equal sizes all rows are on the large side.
    other = F.when(F.col("low") == F.col("high"), F.col("high_id")).when(F.col("large"), F.col("low_id")).otherwise(F.col("high_id"))
    return rows.join(hubs, key).select(F.col("id").alias("a"), other.alias("b")).where("b is not null and a <> b").distinct()


def _taking_part(texts: DataFrame, reps: DataFrame):
    """A filter of bounded size over the ids in reps: true for all of them and for few others. What passes wrongly only
    costs time, so a full filter at any size of input gives the same result."""
    bits = 1 << int(min(FILTER_BITS, max(12, np.ceil(np.log2(reps.count() * 16 + 1)))))
    bit = F.pmod(F.xxhash64("rep"), F.lit(bits))
    words = reps.groupBy(F.shiftright(bit, 6).alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(xxhash64(rep), {bits}) & 63 as int))")).alias("m"))
    rows = words.toPandas()
    table = np.zeros(bits >> 6, np.int64)
    table[rows["w"].to_numpy()] = rows["m"].to_numpy()
    return texts.sparkSession.sparkContext.broadcast(table.view(np.uint64)), texts.withColumn("__bit", F.pmod(F.xxhash64("__id"), F.lit(bits)))


def whole_sets(texts: DataFrame, reps: DataFrame, shingle: int) -> DataFrame:
    """``id`` and ``tokens`` (sorted, as bytes) of the documents in reps, and of some others."""
    sent, marked = _taking_part(texts, reps)
    kind = texts.schema["__id"].dataType.simpleString()

    @releasing
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value
        for batch in batches:
            bit = batch.column(2).to_numpy(zero_copy_only=False)
            mine = (table[bit >> 6] >> (bit & 63).astype(np.uint64)) & np.uint64(1) == 1
            kept = batch.filter(pa.array(mine))
            for begin in range(0, kept.num_rows, 500):
                part = kept.slice(begin, 500)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([t.tobytes() for t in shingle_sets(part, "__text", shingle)], pa.binary())], names=["id", "tokens"])

    return staged(marked.select("__id", "__text", "__bit").mapInArrow(sets, f"id {kind}, tokens binary"), "whole-sets")


def verified(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs (``a``, ``b``) whose sets link, as a written table. Only the sets of documents in pairs are made."""
    kind = pairs.schema["a"].dataType.simpleString()
    sets = whole_sets(texts, pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct(), shingle)

    @releasing
    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                good = []
                for one, other in zip(part.column(2), part.column(3), strict=True):
                    x, y = (np.frombuffer(s.as_buffer(), np.uint64) for s in (one, other))
                    place = np.minimum(np.searchsorted(x, y), len(x) - 1)
                    common = int((x[place] == y).sum()) if len(x) else 0
                    good.append(common > 0 and 100 * common >= percent * (len(x) + len(y) - common))
                yield part.filter(pa.array(good)).select(["a", "b"])

    held = pairs.join(sets.select(F.col("id").alias("a"), F.col("tokens").alias("s")), "a").join(sets.select(F.col("id").alias("b"), F.col("tokens").alias("t")), "b")
    links = staged(held.select("a", "b", "s", "t").mapInArrow(test, f"a {kind}, b {kind}").distinct(), "links")
    discard(sets)
    return links


def needed(percent: int):
    """The overlap that links sets of sizes ``n_x`` and ``n_y``."""
    return F.ceil(percent * (F.col("n_x") + F.col("n_y")) / (100.0 + percent) - 1e-9)


def likely(met: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs ``a`` > ``b`` from a row per pair and list they meet on (``x``, ``n_x``, ``y``, ``n_y``), if their prefixes share
    enough: of the overlap that links them all but what is beyond the one prefix lies in both."""
    beyond = F.greatest(*(F.ceil(percent * F.col(n) / 100.0 - 1e-9) for n in ("n_x", "n_y"))) - 1
    pairs = met.groupBy(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).agg(F.min(needed(percent) - beyond).alias("least"))
    firsts = sets.where(F.size("first") > 0)
    both = pairs.join(firsts.select(F.col("rep").alias("a"), F.col("first").alias("p")), "a").join(firsts.select(F.col("rep").alias("b"), F.col("first").alias("q")), "b")
    return both.where(F.size(F.array_intersect("p", "q")) >= F.col("least")).select("a", "b").distinct()


def heavy_links(sets: DataFrame, lists: DataFrame, texts: DataFrame, known: DataFrame, shingle: int, percent: int) -> DataFrame:
    """``a`` and ``b``: links that connect all sets that link, given their postings ``lists`` (token, rep, n).

    First every set on a list is compared with up to three of the list of about its size: that with the smallest id, that
    whose shingles others have most, and any. What that links is one component;
    on a list all of whose sets are in one component nothing is left to find. On the others, the sets outside the
    list's largest component are paired with those of other components that the list's shingle is early enough for, and
    a pair is compared if it shares as many prefix shingles as a link needs. So copies in any number are compared with one of them, not with each other, and no
    link between components is lost.
    """
    alike = lambda x, y: 100 * F.least(x, y) >= percent * F.greatest(x, y)
    band = F.floor(F.log(F.col("n").cast("double")) / float(np.log(100 / percent)) + 1e-9).cast("int")
    banded = lists.withColumn("band", band)
    hub = F.struct("rep", "n")
    hubs = banded.groupBy("token", "band").agg(
        F.min(hub).alias("first"), F.max_by(hub, F.struct("known", F.xxhash64("rep"))).alias("common"), F.min_by(hub, F.xxhash64("rep", F.lit(1))).alias("any")
    )
    hubs = hubs.select("token", "band", F.explode(F.array_distinct(F.array("first", "common", "any"))).alias("hub"))
    near = banded.withColumn("band", F.explode(F.array(F.col("band") - 1, F.col("band"))))
    met = near.join(hubs, ["token", "band"]).where((F.col("rep") != F.col("hub.rep")) & alike(F.col("n"), F.col("hub.n")))
    met = met.select(F.col("rep").alias("x"), F.col("n").alias("n_x"), F.col("hub.rep").alias("y"), F.col("hub.n").alias("n_y"))
    pairs = staged(likely(met, sets, percent), "hub-pairs")
    first = verified(pairs, texts, shingle, percent)

    labels = components(first.unionByName(known)).select(F.col("node").alias("rep"), "component")
    labelled = staged(lists.join(labels, "rep", "left").withColumn("label", F.coalesce("component", "rep")).drop("component"), "labelled")
    groups = labelled.groupBy("token", "label").agg(F.count(F.lit(1)).alias("k"))
    largest = groups.groupBy("token").agg(F.max(F.struct("k", "label")).alias("top"), F.count(F.lit(1)).alias("labels")).where("labels > 1")
    open_ = labelled.join(largest.select("token", F.col("top.label").alias("top")), "token").withColumn("minor", F.col("label") != F.col("top"))
    open_ = staged(open_.drop("top"), "open-lists")
    discard(labelled)
    one = open_.where("minor").select("token", F.col("rep").alias("x"), F.col("n").alias("n_x"), F.col("label").alias("label_x"), F.col("place").alias("place_x"))
    two = open_.select(F.col("token").alias("token_y"), F.col("rep").alias("y"), F.col("n").alias("n_y"), F.col("label").alias("label_y"), "minor", F.col("place").alias("place_y"))
    rest = one.join(
        two,
        (F.col("token") == F.col("token_y"))
        & (F.col("label_x") != F.col("label_y"))
        & alike(F.col("n_x"), F.col("n_y"))
        # Knowing both sizes, a shorter beginning of each is enough; the frequent shingles stand at the end.
        & (F.col("place_x") <= F.col("n_x") - needed(percent))
        & (F.col("place_y") <= F.col("n_y") - needed(percent))
        & (~F.col("minor") | (F.col("x") < F.col("y"))),
    )
    others = staged(likely(rest, sets, percent).join(pairs, ["a", "b"], "left_anti"), "other-pairs")
    discard(open_)
    return first.unionByName(verified(others, texts, shingle, percent))


def shingle_components(docs: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """``id``, ``n_shingles`` and ``component_id`` (the smallest id that links lead to, the own one included) of every row.

    A set is the distinct runs of ``shingle`` words of the whole text, in lower case; with fewer words it is one run.
    Null and empty texts have an empty set and link with nothing. Rows that share an id are one node, linked by each
    of their texts; rows without an id have a size and a null component.
    """
    texts = docs.select(F.col(id).alias("__id"), F.col(text).cast("string").alias("__text"))
    order = docs.sparkSession.sparkContext.broadcast(frequent_shingles(texts, shingle))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shared = shared_filter(texts.select("__text"), prefixes_of(order, shingle, percent), parts)
    table = set_table(texts, order, shared, shingle, percent)
    nodes = table.where("n > 0 and __id is not null")
    smallest = nodes.groupBy("digest").agg(F.min("__id").alias("rep"), F.count(F.lit(1)).alias("k")).where("k > 1").drop("k")
    copies = staged(nodes.select("__id", "digest").join(smallest, "digest").where("__id <> rep"), "copies")
    single = nodes.join(copies.select("__id", "digest").distinct(), ["__id", "digest"], "left_anti").withColumnRenamed("__id", "rep")

    # How much of a prefix other sets have: all of it in a text that the others were made from.
    postings = single.select("rep", "n", (F.size("first") / F.col("n")).alias("known"), F.explode(F.arrays_zip("first", "place")).alias("t"))
    postings = postings.select("rep", "n", "known", F.col("t.first").alias("token"), F.col("t.place").alias("place"))
    lengths = postings.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    lists = staged(postings.join(lengths, "token"), "lists")
    size = lists.agg(F.avg("df").alias("mean")).first()["mean"] or 0.0
    limit = light_limit(size, percent)
    same = copies.select(F.col("__id").alias("a"), F.col("rep").alias("b"))
    light = staged(light_links(single, limit, percent), "light-links")
    # A set needs its lists if a partner may be larger than the light ones.
    heavy = heavy_links(single, lists.where(F.col("n") * 100 > limit * percent).drop("df"), texts, light, shingle, percent)
    members = components(same.unionByName(light).unionByName(heavy))
    discard(lists)
    return (
        table.select("__id", "n")
        .join(members, F.col("__id") == F.col("node"), "left")
        .select(F.col("__id").alias(id), F.col("n").alias("n_shingles"), F.coalesce("component", "__id").alias("component_id"))
    )


def representatives(docs: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of docs that stay when one document of each component does, the one with the smallest id; unchanged.

    Of rows that share an id one stays. Rows without an id, and texts without words, link with nothing and stay.
    Only the ids that go are joined, and only rows whose id repeats are compared with each other.
    """
    removed, repeated, count, turn = free_names(docs, "gone", "again", "k", "row")
    members = shingle_components(docs, id, text, shingle, percent)
    gone = staged(members.where(F.col("component_id") != F.col(id)).select(F.col(id).alias(removed)).distinct(), "gone")
    again = docs.where(F.col(id).isNotNull()).groupBy(F.col(id).alias(repeated)).agg(F.count(F.lit(1)).alias(count)).where(F.col(count) > 1)
    again = staged(again.select(repeated), "repeated-ids")
    kept = docs.join(gone, F.col(id) == F.col(removed), "left_anti")
    order = Window.partitionBy(id).orderBy(F.col(text), F.xxhash64(*docs.columns))
    one = kept.join(again, F.col(id) == F.col(repeated), "left_semi").withColumn(turn, F.row_number().over(order)).where(F.col(turn) == 1)
    return kept.join(again, F.col(id) == F.col(repeated), "left_anti").unionByName(one.drop(turn))
