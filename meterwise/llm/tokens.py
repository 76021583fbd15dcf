"""Token ids as binary shards, with a minimal perfect hash index from document keys to places in the shards.

A shard file is the ids of its documents one after another as little-endian unsigned integers (16 bits if the vocabulary
allows, else 32), then the end of each document as an unsigned 64-bit number of ids, then the number of documents and the
bytes per id, each as an unsigned 64-bit number. Documents are in ascending order of their keys, over the shards too.
"""

from __future__ import annotations

import io
import posixpath
import unicodedata
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meterwise.llm.common import byte_view, releasing, row_slices, scratch, staged
from meterwise.llm.words import mix

END_ID = 1
#: Keys of one part of the index, about.
PART_KEYS = 200_000
#: Words that an encoder remembers before it starts anew.
REMEMBERED = 400_000
_TRAILING = b".,;:!?#$%&*()[]{}-+=/"
_LEVEL_STEP = 0x9E3779B97F4A7C15


def byte_letters() -> list[str]:
    """The letter that a byte-level vocabulary writes for each byte: printable ones stand for themselves, the others follow
    from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters, more = {b: chr(b) for b in shown}, 0
    for b in range(256):
        if b not in letters:
            letters[b] = chr(0x100 + more)
            more += 1
    return [letters[b] for b in range(256)]


class Encoder:
    """Encodes texts with a tokenizers model whose pieces never contain white space, word by word, each word once.

    A word is what lies between ASCII white space. New words go through the whole tokenizer, unless they are plain: letters
    below U+0250 in composed form, with ASCII punctuation at the end at most. Such a word is one piece, and the run behind
    it another, so they go straight to the model in the form that normaliser and byte mapping give them.
    """

    def __init__(self, content: str, end_id: int) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(content)
        self.width = 2 if max(self.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        self.kind = np.dtype("<u2" if self.width == 2 else "<u4")
        self.end = np.array([end_id], self.kind).tobytes()
        self.letters = byte_letters()
        self.known: dict[bytes, bytes] = {}

    def _pack(self, ids: list[int]) -> bytes:
        return np.array(ids, self.kind).tobytes()

    def _piece(self, text: str) -> bytes:
        mapped = "".join([self.letters[b] for b in text.encode()])
        return self._pack([token.id for token in self.tokenizer.model.tokenize(mapped)])

    def _new(self, word: bytes) -> bytes:
        stem = word.rstrip(_TRAILING)
        text = stem.decode()
        plain = text.isalpha() and max(text) < "ɐ" and "İ" not in text and unicodedata.is_normalized("NFC", text)
        if not plain:
            return self._pack(self.tokenizer.encode(word.decode(), add_special_tokens=False).ids)
        found = self.known.get(low := text.lower().encode())
        if found is None:
            found = self.known[low] = self._piece(low.decode())
        if len(stem) < len(word):
            tail = word[len(stem) :]
            ends = self.known.get(tail)
            if ends is None:
                ends = self.known[tail] = self._piece(tail.decode())
            found += ends
        return found

    def encode(self, text: bytes) -> bytes:
        """The ids of the text, then the end id, as bytes."""
        known = self.known
        words = text.split()
        try:
            ids = [known[w] for w in words]
        except KeyError:
            if len(known) > REMEMBERED:
                known.clear()
            for word in words:
                if word not in known:
                    known[word] = self._new(word)
            ids = [known[w] for w in words]
        ids.append(self.end)
        return b"".join(ids)


def key_text(column: Column) -> Column:
    """Keys as text; null has a text of its own that no other key has."""
    return F.coalesce(F.concat(F.lit("="), column.cast("string")), F.lit(""))


def write_shards(docs: DataFrame, tokenizer_file: str, folder: str, id: str = "doc_id", text: str = "text", end_id: int = END_ID, shards: int | None = None) -> DataFrame:
    """Encodes and writes all texts; returns the written table of distinct keys: ``key`` (the id), ``shard`` (its path),
    ``ordinal`` (of the key's first document in the shard), ``documents`` (that share the key, one after another), ``tokens``.

    Texts are range-partitioned by key, so a shard is a task's documents; null keys come first, equal keys are in one shard,
    ordered by text. A null text has the end id only. File names have the task's attempt, and only tasks that succeeded
    are in the table.
    """
    spark = docs.sparkSession
    n = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    with open(tokenizer_file, encoding="utf-8") as file:
        content = spark.sparkContext.broadcast(file.read())
    system, path = pyarrow.fs.FileSystem.from_uri(folder)
    system.create_dir(path, recursive=True)

    @releasing
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, stream, ends, total = Encoder(content.value, end_id), None, [], 0
        keys, ordinals, counts, tokens, kind = [], [], [], [], None
        task = TaskContext.get()
        system, base = pyarrow.fs.FileSystem.from_uri(folder)
        file = posixpath.join(base, f"shard-{task.partitionId():05d}-{task.taskAttemptId()}.ids")
        for batch in batches:
            kind = batch.schema.field(0).type
            if stream is None and batch.num_rows:
                stream = system.open_output_stream(file, compression=None, buffer_size=1 << 20)
            for part in row_slices(batch, "__text"):
                data, edges = byte_view(part.column(1))
                whole = data.tobytes()
                for row, key in enumerate(part.column(0).to_pylist()):
                    ids = encoder.encode(whole[edges[row] : edges[row + 1]])
                    stream.write(ids)
                    size = len(ids) // encoder.width
                    if ends and keys and keys[-1] == key:
                        counts[-1] += 1
                        tokens[-1] += size
                    else:
                        keys.append(key)
                        ordinals.append(len(ends))
                        counts.append(1)
                        tokens.append(size)
                    total += size
                    ends.append(total)
        if stream is None:
            return
        stream.write(np.array(ends, "<u8").tobytes())
        stream.write(np.array([len(ends), encoder.width], "<u8").tobytes())
        stream.close()
        for begin in range(0, len(keys), 50_000):
            own = slice(begin, begin + 50_000)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys[own], kind), pa.array([file] * len(keys[own])), pa.array(ordinals[own], pa.int64()), pa.array(counts[own], pa.int64()), pa.array(tokens[own], pa.int64())],
                names=["key", "shard", "ordinal", "documents", "tokens"],
            )

    one = docs.select(F.col(id).alias("key"), F.col(text).cast("string").alias("__text"))
    ordered = one.repartitionByRange(n, "key").sortWithinPartitions("key", "__text")
    kind = one.schema[0].dataType.simpleString()
    return staged(ordered.mapInArrow(write, f"key {kind}, shard string, ordinal long, documents long, tokens long"), "token-keys")


def shard_starts(keys: DataFrame) -> DataFrame:
    """Per shard: ``shard``, ``start`` (ids in all shards before it), ``number`` (its place, from 0). A row per shard is all
    that the single window sees."""
    sums = keys.groupBy("shard").agg(F.sum("tokens").alias("__tokens"), F.min(F.struct(F.col("key").isNotNull(), "key")).alias("__first"))
    order = Window.orderBy("__first")
    return sums.select(
        "shard",
        (F.sum("__tokens").over(order) - F.col("__tokens")).alias("start"),
        (F.row_number().over(order) - 1).alias("number"),
    )


class PerfectHash:
    """A minimal perfect hash of distinct 64-bit numbers: at each level the numbers that have a slot for themselves are placed,
    the others go to the next; a number's place is how many were placed before its bit. About three bits a key."""

    GAMMA, LEVELS = 2.0, 48

    def __init__(self, sizes: np.ndarray, words: np.ndarray, ranks: np.ndarray) -> None:
        self.sizes, self.words, self.ranks = sizes, words, ranks
        self.begins = np.concatenate([[0], np.cumsum((sizes + 63) // 64)]).astype(np.int64)

    @staticmethod
    def _slots(hashes: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(hashes + np.uint64((level + 1) * _LEVEL_STEP % (1 << 64))) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, hashes: np.ndarray) -> PerfectHash:
        if len(np.unique(hashes)) < len(hashes):
            raise ValueError("the numbers are not distinct")
        sizes, parts, rest = [], [], hashes
        for level in range(cls.LEVELS):
            if not len(rest):
                break
            size = max(64, int(cls.GAMMA * len(rest)))
            slots = cls._slots(rest, level, size)
            alone = np.bincount(slots, minlength=(size + 63) // 64 * 64) == 1
            parts.append(np.packbits(alone, bitorder="little").view("<u8"))
            sizes.append(size)
            rest = rest[~alone[slots]]
        if len(rest):
            raise ValueError("some numbers found no slot")
        words = np.concatenate(parts) if parts else np.zeros(0, "<u8")
        ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(words))]).astype(np.int64)
        return cls(np.array(sizes, np.int64), words, ranks)

    def places(self, hashes: np.ndarray) -> np.ndarray:
        """The place of each number; -1 if it has no slot at any level, which no number that was built in has."""
        found = np.full(len(hashes), -1, np.int64)
        open_ = np.arange(len(hashes))
        for level, size in enumerate(self.sizes):
            if not len(open_):
                break
            slots = self._slots(hashes[open_], level, int(size))
            word = self.begins[level] + slots // 64
            bit = (slots % 64).astype(np.uint64)
            hit = (self.words[word] >> bit) & np.uint64(1) == 1
            below = self.words[word[hit]] & ((np.uint64(1) << bit[hit]) - np.uint64(1))
            found[open_[hit]] = self.ranks[word[hit]] + np.bitwise_count(below)
            open_ = open_[~hit]
        return found


def _hashed(keys: DataFrame, parts: int) -> DataFrame:
    """The part of the index, the number that is hashed there, and the fingerprint of each key."""
    text = key_text(F.col("key"))
    return keys.withColumns(
        {
            "part": F.pmod(F.xxhash64(text, F.lit("part")), F.lit(parts)).cast("int"),
            "number": F.xxhash64(text),
            "fingerprint": F.xxhash64(text, F.lit("fingerprint")),
        }
    )


def build_index(keys: DataFrame, folder: str, part_keys: int = PART_KEYS) -> DataFrame:
    """Writes the index of the key table and returns its written list of parts: ``part``, ``path``, ``parts``.

    A part holds the keys whose hash falls to it: the perfect hash, and by place the fingerprint (64 bits), the shard,
    the ordinal and the number of documents. Keys are distinct, so parts are even; their number grows with the keys.
    """
    parts = max(1, -(-keys.count() // part_keys))

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        part = int(frame["part"].iloc[0])
        numbers = frame["number"].to_numpy().view(np.uint64)
        index = PerfectHash.build(numbers)
        order = np.argsort(index.places(numbers))
        names, shard = np.unique(frame["shard"].to_numpy().astype(str), return_inverse=True)
        held = io.BytesIO()
        np.savez(
            held, sizes=index.sizes, words=index.words, ranks=index.ranks, names=names, shard=shard[order].astype("<u4"),
            fingerprint=frame["fingerprint"].to_numpy().view(np.uint64)[order], ordinal=frame["ordinal"].to_numpy().astype("<u8")[order],
            documents=frame["documents"].to_numpy().astype("<u8")[order],
        )
        system, base = pyarrow.fs.FileSystem.from_uri(folder)
        path = posixpath.join(base, f"index-{part:05d}-{uuid.uuid4().hex}.npz")
        with system.open_output_stream(path, compression=None) as stream:
            stream.write(held.getvalue())
        return pd.DataFrame({"part": [part], "path": [path], "parts": [parts]})

    rows = _hashed(keys.select("key", "shard", "ordinal", "documents"), parts).drop("key")
    return staged(rows.groupBy("part").applyInPandas(build, "part int, path string, parts int"), "token-index")


def look_up(keys: DataFrame, index: DataFrame, folder: str) -> DataFrame:
    """``key``, ``shard``, ``ordinal``, ``documents`` for each row of keys that is in the index: one hash, one compared
    fingerprint and one read of the record per key. A key that is not indexed passes with a chance of 2^-64."""
    first = index.select("parts").first()
    parts = first["parts"] if first else 1
    kind = keys.schema["key"].dataType.simpleString()

    def find(frame: pd.DataFrame) -> pd.DataFrame:
        system, _ = pyarrow.fs.FileSystem.from_uri(folder)
        with system.open_input_stream(frame["path"].iloc[0], compression=None) as stream:
            data = dict(np.load(io.BytesIO(stream.read())))
        place = PerfectHash(data["sizes"], data["words"], data["ranks"]).places(frame["number"].to_numpy().view(np.uint64))
        good = (place >= 0) & (data["fingerprint"][np.maximum(place, 0)] == frame["fingerprint"].to_numpy().view(np.uint64))
        at = place[good]
        shard = data["names"][data["shard"][at]].astype(object)
        ordinal, documents = data["ordinal"][at].astype(np.int64), data["documents"][at].astype(np.int64)
        return pd.DataFrame({"key": frame["key"][good], "shard": shard, "ordinal": ordinal, "documents": documents})

    wanted = _hashed(keys.select("key"), parts).join(index.select("part", "path"), "part")
    return wanted.groupBy("part").applyInPandas(find, f"key {kind}, shard string, ordinal long, documents long")


def read_documents(places: DataFrame, folder: str) -> DataFrame:
    """Reads the documents at the places: ``key``, ``shard``, ``offset`` (ids before it in the shard), ``n_tokens``,
    ``ids_crc32`` (of the ids as 32-bit numbers). A shard is opened once and only the asked-for ids are read from it."""
    kind = places.schema["key"].dataType.simpleString()

    def read(frame: pd.DataFrame) -> pd.DataFrame:
        path = frame["shard"].iloc[0]
        system, _ = pyarrow.fs.FileSystem.from_uri(folder)
        rows = []
        with system.open_input_file(path) as stream:
            size = stream.size()
            documents, width = (int(x) for x in np.frombuffer(stream.read_at(16, size - 16), "<u8"))
            ends = np.frombuffer(stream.read_at(documents * 8, size - 16 - documents * 8), "<u8").astype(np.int64)
            for name, ordinal, count in zip(frame["key"], frame["ordinal"], frame["documents"], strict=True):
                for place in range(ordinal, ordinal + count):
                    begin = int(ends[place - 1]) if place else 0
                    n = int(ends[place]) - begin
                    ids = np.frombuffer(stream.read_at(n * width, begin * width), f"<u{width}")
                    rows.append((name, path, begin, n, zlib.crc32(ids.astype("<u4").tobytes())))
        out = pd.DataFrame(rows, columns=["key", "shard", "offset", "n_tokens", "ids_crc32"])
        out["key"] = out["key"].astype(frame["key"].dtype)
        return out

    return places.groupBy("shard").applyInPandas(read, f"key {kind}, shard string, offset long, n_tokens long, ids_crc32 long")


def token_table(docs: DataFrame, tokenizer_file: str, id: str = "doc_id", text: str = "text", end_id: int = END_ID, shards: int | None = None, folder: str | None = None) -> DataFrame:
    """Writes shards and index, looks every key up in the index and reads its documents back: ``id``, ``start`` (ids of all
    documents before it), ``n_tokens``, ``ids_crc32``, ``shard``, ``number`` of the shard. Every row of docs gives a row, rows
    that share a key too. No rows write nothing."""
    spark = docs.sparkSession
    folder = folder or scratch(spark, "tokens")
    keys = write_shards(docs, tokenizer_file, folder, id, text, end_id, shards)
    index = build_index(keys, folder)
    found = look_up(keys, index, folder)
    documents = read_documents(found, folder)
    starts = staged(shard_starts(keys), "token-starts")
    return documents.join(starts, "shard").select(
        F.col("key").alias(id), (F.col("start") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32", "shard", "number"
    )
