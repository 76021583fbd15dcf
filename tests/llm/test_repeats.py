"""Repeated bytes against a dictionary of all windows, merged transforms against sorted suffixes."""

import hashlib
import random

import numpy as np
import pytest

from plain import docs  # noqa: F401

from meterwise.llm import registry, repeats


def brute(rows):
    """(doc_id, n_bytes, n_removed, spans, kept) of rows with ids."""
    first = {}
    for doc, text in rows:
        raw = (text or "").encode()
        for i in range(len(raw) - 49):
            w = raw[i : i + 50]
            first[w] = min(first.get(w, doc), doc)
    result = []
    for doc, text in rows:
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - 49):
            if first[raw[i : i + 50]] < doc:
                gone[i : i + 50] = b"\1" * 50
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        result.append((doc, len(raw), sum(gone), spans, bytes(c for c, g in zip(raw, gone, strict=True) if not g)))
    return sorted(result)


def run(frame):
    return sorted((r.doc_id, r.n_bytes, sum(s.end - s.begin for s in r.spans), len(r.spans), bytes(r.kept)) for r in repeats.without_repeats(frame).collect())


def corpus(seed):
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdeé", k=rng.randint(1, 9))) for _ in range(300)]
    passages = [" ".join(rng.choices(words, k=20)) for _ in range(6)]
    rows = []
    for i in range(60):
        parts = [" ".join(rng.choices(words, k=rng.randint(0, 60)))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            a = rng.randint(0, 40)
            parts += [p[a : a + rng.randint(30, 120)], " ".join(rng.choices(words, k=rng.randint(0, 10)))]
        rows.append((i * 3, " ".join(parts)))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_against_all_windows(docs, seed):
    rows = corpus(seed)
    assert run(docs(rows)) == brute(rows)


def test_special_texts(docs):
    line = "the same line of text again and again, in every document\n"
    rows = [
        (1, None), (2, ""), (3, "x" * 49), (4, "x" * 50), (5, "x" * 51), (6, "x" * 5000), (7, "ab" * 300), (8, "ab" * 300), (9, line * 40),
        (10, line[:20] + line * 3), (11, "é" * 25), (12, "é" * 26 + "\0" * 60), (13, "\0" * 70), (14, "q" + "ab" * 100), (15, "x" * 49), (16, line * 40),
    ]
    assert run(docs(rows).withColumnRenamed("lang", "spans")) == brute(rows)


def test_repeated_and_missing_ids(docs):
    """Rows with one id are not witnesses against each other; rows without an id take no part."""
    text, other = "a passage that is long enough to be found twice in the table, surely", "another passage, also long enough to be found more than once or twice"
    rows = [(1, text), (1, text), (1, other), (2, text + " " + other), (None, text), (None, other)]
    got = [(r.doc_id, r.n_bytes, len(r.kept)) for r in repeats.without_repeats(docs(rows)).collect()]
    whole = [(doc, len(t), 1 if doc == 2 else len(t)) for doc, t in rows]
    assert sorted(got, key=str) == sorted(whole, key=str)


def test_no_documents(docs):
    assert repeats.without_repeats(docs([])).count() == 0


def test_crowded_minimisers_are_split_by_window(docs, monkeypatch):
    monkeypatch.setattr(repeats, "PIECES", 1)
    rows = corpus(3)
    assert run(docs(rows)) == brute(rows)


def test_no_task_has_a_row_per_document(docs, monkeypatch):
    """A passage that all documents share, with other text around it in each: what a Python task gets does not grow with them."""
    from pyspark.sql.pandas.group_ops import PandasCogroupedOps, PandasGroupedOpsMixin

    monkeypatch.setattr(repeats, "PIECES", 5)
    monkeypatch.setattr(repeats, "MERGED", 2_000)
    most = []

    def watched(kind, frames):
        apply = kind.applyInPandas

        def wrapped(self, func, schema):
            for frame in frames(self):
                if "bucket" in frame.columns:
                    most.append(frame.groupBy("bucket").count().agg({"count": "max"}).first()[0] or 0)
            return apply(self, func, schema)

        monkeypatch.setattr(kind, "applyInPandas", wrapped)

    watched(PandasGroupedOpsMixin, lambda group: [group._df])
    watched(PandasCogroupedOps, lambda pair: [pair._gd1._df, pair._gd2._df])
    rng = random.Random(4)
    passage = "".join(rng.choices("abcdefgh ", k=140))
    unlike = lambda: "".join(rng.choices("ijklmnop ", k=90))
    rows = [(i, unlike() + passage + unlike()) for i in range(150)]
    assert run(docs(rows)) == brute(rows)
    assert most and max(most) < 75


@pytest.mark.parametrize("shards", [1, 2, 5])
def test_merged_order_is_the_order_of_suffixes(shards):
    rng = random.Random(shards)
    texts = sorted({bytes(rng.choices(b"\0ab\xff", k=rng.randint(1, 30))) for _ in range(40)})
    groups = [texts[i::shards] for i in range(shards)]
    built = [repeats.Transform(g) for g in groups]
    depth = 12
    origin, place, common = repeats.merge_transforms(built, depth)
    rings = [t.symbols for t in built]
    read = [tuple(np.take(rings[o], range(p, p + depth), mode="wrap")) for o, p in zip(origin, place, strict=True)]
    assert read == sorted(read) and len(set(zip(origin.tolist(), place.tolist(), strict=True))) == sum(map(len, rings))
    for before, now, c in zip(read, read[1:], common[1:], strict=False):
        assert c == next((i for i in range(depth) if before[i] != now[i]), depth) // 2 * 2


def test_query_digest(spark):
    rows = registry.op4_repeated_bytes(spark, "/root/testdata/sf0.001").collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert [tuple(r) for r in sorted(rows)] == [(d, n, g, s, hashlib.sha256(k).hexdigest()) for d, n, g, s, k in brute(texts.items())]


@pytest.mark.parametrize(("shards", "step"), [(1, 1), (2, 3), (3, 6), (2, 12)])
def test_rounds_of_any_number_of_symbols(shards, step):
    """Longer steps, and shards that are in order as far as the depth only, give the same prefixes in the same order."""
    rng = random.Random(step)
    texts = sorted({bytes(rng.choices(range(256) if i % 2 else b"ab", k=rng.randint(1, 40))) for i in range(60)})
    built = [repeats.Transform(texts[i::shards], 12) for i in range(shards)]
    origin, place, common = repeats.merge_transforms(built, 12, step)
    read = [tuple(np.take(built[o].symbols, range(p, p + 12), mode="wrap")) for o, p in zip(origin, place, strict=True)]
    assert read == sorted(read) and len(set(zip(origin.tolist(), place.tolist(), strict=True))) == len(read)
    for before, now, c in zip(read, read[1:], common[1:], strict=False):
        assert c == next((i for i in range(12) if before[i] != now[i]), 12) // step * step


def test_cut_spans_end_with_their_rows():
    """Windows that touch a row's end and the next row's start, empty rows between, rows without windows."""
    texts = [b"a" * 60, b"", b"b" * 50 + b"c" * 10, b"d" * 5, b""]
    data, edges = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0] + [len(t) for t in texts])
    kind = repeats.pa.list_(repeats.pa.struct([("at", repeats.pa.int64()), ("n", repeats.pa.int32())]))
    held = repeats.pa.array([None, [{"at": 5, "n": 6}, {"at": 6, "n": 1}], None, [{"at": 0, "n": 1}], None, []], kind)[1:]
    begin, end, row, kept = repeats._cut(data, edges, held)
    assert [(b, e, r) for b, e, r in zip(begin.tolist(), end.tolist(), row.tolist(), strict=True)] == [(5, 60, 0), (60, 110, 2)]
    assert kept.to_pylist() == [b"aaaaa", b"", b"c" * 10, b"d" * 5, b""]


def test_a_bucket_is_merged_without_sorting_places_by_numbers(monkeypatch):
    """Several shards of pieces that have much in common: numbers are sorted with their places in them, which takes about half
    the time; only the shard of a suffix, a byte, is sorted by. The runs are those of a dictionary of all windows."""
    rng = random.Random(5)
    passages = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyzé ", k=90)) for _ in range(300)]
    texts = sorted({(p[a : a + 50 + rng.randint(0, 20)] + rng.choice("ABCDEFGH")).encode()[:80] for p in passages for a in range(20)})
    docs = np.array([rng.randint(0, 40) for _ in texts])
    assert sum(map(len, texts)) > 2 * repeats.SHARD
    plain, widths = np.argsort, []
    monkeypatch.setattr(np, "argsort", lambda numbers, *more, **named: widths.append(numbers.dtype.itemsize) or plain(numbers, *more, **named))
    text, begin, count = repeats.windows_of_smaller(texts, docs)
    assert max(widths) == 1
    first = {}
    for t, d in zip(texts, docs.tolist(), strict=True):
        for i in range(len(t) - 49):
            first[t[i : i + 50]] = min(first.get(t[i : i + 50], d), d)
    want = {(k, i) for k, (t, d) in enumerate(zip(texts, docs.tolist(), strict=True)) for i in range(len(t) - 49) if first[t[i : i + 50]] < d}
    runs = list(zip(text.tolist(), begin.tolist(), count.tolist(), strict=True))
    got = [(k, i) for k, a, n in runs for i in range(a, a + n)]
    assert want and len(got) == len(want) and set(got) == want
    assert all((k, a - 1) not in want and (k, a + n) not in want for k, a, n in runs)


def test_ranks_of_numbers_of_any_size():
    """Numbers that leave room for their places, and numbers that do not."""
    few = np.random.default_rng(1).integers(0, 500, 2000)
    for factor, most in ((1, 500), (1 << 53, 1 << 62)):
        order, rank, n = repeats._ranked(few * factor, most)
        want, places = np.unique(few, return_inverse=True)
        assert n == len(want) and rank.tolist() == places.tolist()
        assert sorted(order.tolist()) == list(range(2000)) and (np.diff(few[order]) >= 0).all()


def test_hashes_tell_grams_and_pieces_apart():
    """Every byte counts, differences in several words do not cancel out, and where a piece stands does not matter."""
    high = np.zeros((256, 256, 20), np.uint8)
    high[:, :, 7], high[:, :, 15] = np.arange(256)[:, None], np.arange(256)[None, :]
    assert len(np.unique(repeats._grams(high.reshape(-1))[::20])) == 1 << 16
    rng = np.random.default_rng(2)
    for size in range(50, 81):
        text = rng.integers(0, 256, size, np.uint8)
        versions = [text] + [np.where(np.arange(size) == i, text ^ 1, text) for i in range(size)] + [text]
        data = np.concatenate(versions)
        begin = np.arange(len(versions)) * size
        found = repeats._hashes(repeats._grams(data), begin, np.full(len(versions), size))
        assert found[0] == found[-1] and len(set(found.tolist())) == size + 1


def test_pieces_end_with_their_rows():
    """Rows shorter than a window, empty rows and rows of one byte among others: all windows of all rows, each once."""
    rng = random.Random(7)
    texts = [b"", b"x" * 49, b"y" * 200, b"", bytes(rng.choices(b"abc", k=300)), b"z" * 50, b"q", bytes(rng.choices(range(256), k=51)), b"r" * 3, b""]
    data, edges = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0] + [len(t) for t in texts])
    minimiser, piece, row, begin, count = repeats.pieces(data, edges)
    windows = [(r, b + i) for r, b, n in zip(row.tolist(), begin.tolist(), count.tolist(), strict=True) for i in range(n)]
    assert windows == [(r, edges[r] + i) for r, t in enumerate(texts) for i in range(len(t) - 49)]
    assert count.max() <= repeats.REACH and len(minimiser) == len(piece) == len(row)
