"""Spelling variants: words one edit apart, found through an index of variable-length grams.

A dictionary holds all grams of MIN_GRAM characters and the longer ones whose beginning is frequent. A word is decomposed into
the longest gram of the dictionary at each of its places. An edit changes only grams that were read over its place, so each word has
a bound on how many of its grams an edit can affect; of any two words one edit apart, the rarest gram that the edit spares is among
the first bound + 1 grams of both, in order of frequency. Only these are indexed, under gram, place and length of the word,
which an edit shifts by at most one; lists that meet are merged by a join and each pair is verified.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.dataset
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterwise.llm.common import discard, row_slices, scratch, staged

MIN_GRAM = 2
MAX_GRAM = 5
#: A gram is made longer where it begins at more than one in so many places of all words. So no more grams than this are, and
#: the dictionary has a bound that does not depend on the number of words.
EXTENDED = 20_000
LEAST_LENGTH = 7
LEAST_COUNT = 2
#: How many times more frequent the form of a word is.
FACTOR = 10
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_RUN = re.compile("[A-Za-zÀ-ÿ]+")


def word_counts(
    docs: DataFrame, id: str = "doc_id", text: str = "text", least_length: int = LEAST_LENGTH, least: int = LEAST_COUNT, lose: int | None = None
) -> DataFrame:
    """``word`` and ``n`` of all words with ``least_length`` characters that occur ``least`` times or more.

    Words are maximal runs of letters (A-Z, a-z, U+00C0 to U+00FF) with only A-Z in lower case. With ``lose`` set, a run loses the
    character h % length where ``lose`` divides h, the crc32 of its id, a colon and the run. Null texts have no words; a null id
    is an empty text in front of the colon. Counts are added up inside a slice of texts before they are shuffled.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Counter[str] = Counter()
            held = 0
            for piece in row_slices(batch, "__text"):
                for name, content in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), strict=True):
                    if not content:
                        continue
                    own = [w for w in _RUN.findall(content.translate(_LOWER).decode()) if len(w) >= least_length]
                    if lose:
                        begin = zlib.crc32((name or b"") + b":")
                        for word, n in Counter(own).items():
                            h = zlib.crc32(word.encode(), begin)
                            if h % lose == 0:
                                cut = h % len(word)
                                word = word[:cut] + word[cut + 1 :]
                                if len(word) < least_length:
                                    continue
                            found[word] += n
                    else:
                        found.update(own)
                held += piece.nbytes
                if held > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])
                    found.clear()
                    held = 0
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])

    one = docs.select(
        F.col(id).cast("string").cast("binary").alias("__id"), F.encode(F.col(text).cast("string"), "UTF-8").alias("__text")
    )
    return one.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def gram_dictionary(words: DataFrame) -> DataFrame:
    """``gram`` and ``n`` (the places of all words where it begins): all grams of MIN_GRAM characters, and each longer one, up to
    MAX_GRAM, whose beginning without its last character is in the dictionary and begins at more than one in EXTENDED places."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found: Counter[str] = Counter()
            for word in batch["word"]:
                for size in range(MIN_GRAM, MAX_GRAM + 1):
                    found.update(word[i : i + size] for i in range(len(word) - size + 1))
            yield pd.DataFrame({"gram": list(found), "n": list(found.values())})

    counted = staged(words.select("word").mapInPandas(count, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n")), "grams")
    size = F.length("gram")
    places = counted.where(size == MIN_GRAM).agg(F.sum("n")).first()[0] or 0
    kept = level = counted.where(size == MIN_GRAM)
    for longer in range(MIN_GRAM + 1, MAX_GRAM + 1):
        frequent = level.where(F.col("n") * EXTENDED > places).select(F.col("gram").alias("beginning"))
        level = counted.where(size == longer).join(frequent, F.substring("gram", 1, longer - 1) == F.col("beginning"), "left_semi")
        kept = kept.unionByName(level)
    result = staged(kept, "gram-dictionary")
    discard(counted)
    return result


class Grams:
    """The dictionary as a task has it."""

    def __init__(self, path: str) -> None:
        system, base = pyarrow.fs.FileSystem.from_uri(path if ":" in path.split("/")[0] else f"file://{path}")
        table = pyarrow.dataset.dataset(base, filesystem=system, format="parquet").to_table()
        self.counts = dict(zip(table.column("gram").to_pylist(), table.column("n").to_pylist(), strict=True))

    def decompose(self, word: str) -> list[tuple[str, int]]:
        """The longest gram at each place, and how many characters were read to find it; the end of the word is one more."""
        made = []
        for i in range(len(word) - MIN_GRAM + 1):
            size = MIN_GRAM
            while size < MAX_GRAM and i + size < len(word) and word[i : i + size + 1] in self.counts:
                size += 1
            made.append((word[i : i + size], min(size + 1, MAX_GRAM)))
        return made


def affected(read: list[int]) -> int:
    """The most grams that one edit of a word can change, from how many characters were read at each place."""
    length = len(read) + MIN_GRAM - 1
    # A character that is replaced or lost changes what read it; one that comes in before place i, what read both neighbours
    # (the end of the word counts as one).
    changed = [sum(p <= i < p + r for p, r in enumerate(read)) for i in range(length)]
    parted = [sum(p < i < p + r for p, r in enumerate(read)) for i in range(length + 1)]
    return max(changed + parted)


def index_rows(words: DataFrame, grams: DataFrame) -> DataFrame:
    """The rarest grams of each word, one more than an edit can affect: ``word``, ``size``, ``place``, ``gram``."""
    path = scratch(words.sparkSession, "gram-table")
    grams.write.parquet(path)

    def decompose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Grams(path)
        for batch in batches:
            rows = []
            for word in batch["word"]:
                made = known.decompose(word)
                bound = affected([r for _, r in made])
                order = sorted(range(len(made)), key=lambda i: (known.counts.get(made[i][0], 0), made[i][0], i))
                rows += [(word, len(word), i, made[i][0]) for i in order[: bound + 1]]
            yield pd.DataFrame(rows, columns=["word", "size", "place", "gram"])

    return words.select("word").mapInPandas(decompose, "word string, size int, place int, gram string")


def near_words(words: DataFrame) -> DataFrame:
    """``word`` and ``near`` for all pairs of different words that one inserted, deleted or replaced character parts, once each
    (the shorter one first, of equally long ones the smaller one). ``words`` has each ``word`` once, of LEAST_LENGTH or more
    characters, so that an edit spares a gram of each."""
    grams = gram_dictionary(words)
    rows = staged(index_rows(words, grams), "gram-index")
    key = lambda place, size: F.xxhash64("gram", place, size).alias("key")
    place, size = F.col("place"), F.col("size")
    index = rows.select(key(place, size), F.col("word").alias("near"))
    # Words of one length share a gram at one place; a longer word has it there or one place on.
    ahead = F.explode(F.array(F.struct(place.alias("p"), size.alias("s")), F.struct(place.alias("p"), (size + 1).alias("s")), F.struct((place + 1).alias("p"), (size + 1).alias("s"))))
    asked = rows.select("gram", "word", ahead.alias("a")).select(key(F.col("a.p"), F.col("a.s")), "word")
    together = asked.join(index, "key").where(
        ((F.length("near") > F.length("word")) | (F.col("near") > F.col("word"))) & (F.levenshtein("word", "near", 1) == 1)
    )
    return together.select("word", "near").distinct()


def variants(words: DataFrame, factor: int = FACTOR) -> DataFrame:
    """``word``, ``form``, ``root``, ``n``, ``n_near``, ``form_n`` of each row of ``words`` (each word once, with its count n).

    A word's form is its near word of largest n (of equal ones the smallest), if that is ``factor`` times the word's n or more; its
    root is where forms lead to. Counts grow with every step, so no chain is longer than the logarithm of the largest count; roots
    are found by doubling. Words that nothing is near to have their row too.
    """
    words = staged(words.select("word", "n"), "words")
    pairs = staged(near_words(words), "near-words")
    both = pairs.unionByName(pairs.select(F.col("near").alias("word"), F.col("word").alias("near")))
    counted = both.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near")
    best = counted.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near").alias("w"))).alias("b"))
    formed = (-F.col("b.m") >= factor * F.col("n")) & F.col("b").isNotNull()
    found = words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(formed, F.col("b.w")).alias("form"), F.when(formed, -F.col("b.m")).alias("form_n")
    )
    found = staged(found, "forms")
    step = staged(found.where("form is not null").select("word", F.col("form").alias("to")), "steps")
    while True:
        onward = step.select(F.col("word").alias("to"), F.col("to").alias("__next"))
        longer = staged(step.join(onward, "to", "left").select("word", F.coalesce("__next", "to").alias("to"), F.col("__next").isNotNull().alias("moved")), "steps")
        moved = longer.where("moved").limit(1).count()
        discard(step)
        step = longer.select("word", "to")
        if not moved:
            break
    roots = step.select("word", F.col("to").alias("root"))
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
