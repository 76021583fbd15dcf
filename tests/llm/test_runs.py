import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from meterwise.llm import registry, runs


def plain_runs(words, least=12):
    """Every period by comparing each word with the one a period on; of one stretch the smallest period stays."""
    n, found = len(words), {}
    for p in range(1, n // 2 + 1):
        k = 0
        while k < n - p:
            j = k
            while j < n - p and words[j] == words[j + p]:
                j += 1
            if j - k >= p and j - k + p >= least:
                found.setdefault((k, j + p), p)
            k = max(j, k + 1)
    return sorted(((a, b - a, p) for (a, b), p in found.items()), key=lambda r: (r[0], r[2]))


def collapsed(words, found):
    drop = {i for start, length, period in found for i in range(start + period, start + length)}
    return " ".join(w for i, w in enumerate(words) if i not in drop)


def words_of(text):
    return (text or "").translate(str.maketrans({chr(c): " " for c in range(9, 14)})).split(" ")


def split(text):
    return [w for w in words_of(text) if w]


def sequences(seed, n=400):
    rng = random.Random(seed)
    for _ in range(n):
        size, letters = rng.randrange(0, 70), rng.randrange(1, 5)
        made = [rng.randrange(letters) for _ in range(size)]
        if size > 4 and rng.random() < 0.5:
            a = rng.randrange(size)
            p = rng.randrange(1, size - a + 1)
            made = [made[i] if i < a else made[a + (i - a) % p] for i in range(size)]
        if rng.random() < 0.2:
            made = [x for x in made for _ in range(rng.randrange(1, 6))]
        yield made


@pytest.mark.parametrize("least", [1, 2, 5, 12])
def test_runs_equal_brute_force(least):
    made = list(sequences(least))
    for begin in range(0, len(made), 7):
        some = made[begin : begin + 7]
        row, start, length, period = runs.runs_of([np.array(s, np.int32) for s in some], least)
        for i, s in enumerate(some):
            own = [tuple(map(int, r)) for k, *r in zip(row, start, length, period, strict=True) if k == i]
            assert own == plain_runs(s, least), s


def test_words_of_fibonacci_and_long_blocks():
    a, b = [0], [0, 1]
    while len(b) < 600:
        a, b = b, b + a
    for s in (b, [3] * 5000, [1, 2] * 700 + [1], list(range(2000)) * 2, [0] * 999 + [1] + [0] * 999):
        row, start, length, period = runs.runs_of([np.array(s, np.int32)])
        assert list(zip(start, length, period, strict=True)) == plain_runs(s)


def test_common_extensions_equal_comparison():
    rng = np.random.default_rng(2)
    words = rng.integers(0, 2, 300).astype(np.int32)
    symbols = np.concatenate([[7], words, [8]]).astype(np.int32)
    fences = np.zeros(302, bool)
    fences[[0, 301]] = True
    grammar = runs.Grammar(symbols, fences)
    assert len(grammar.symbols[-1]) == 3
    x, y = np.sort(rng.integers(1, 301, (2, 4000)), axis=0)
    x, y = x[x < y], y[x < y]
    for step in (1, -1):
        got = grammar.common(x, y, step)
        for i, j, n in zip(x, y, got, strict=True):
            k = 0
            while 0 <= i + step * k < 302 and 0 <= j + step * k < 302 and symbols[i + step * k] == symbols[j + step * k]:
                k += 1
            assert k == n


ROWS = [
    (1, "a b c d e f " * 5),
    (2, None),
    (3, ""),
    (4, " \t\n\x0b\x0c\r "),
    (None, "x " * 30),
    (6, "Ja ja " * 9 + "ende"),
    (6, "Ja ja " * 9 + "ende"),
    (7, "ö ö ü " * 8),
    (8, "eins zwei drei"),
]


def test_operator(spark):
    frame = spark.createDataFrame([(*r, 1, "k") for r in ROWS], "doc_id long, text string, runs int, collapsed string")
    got = sorted(map(tuple, runs.periodic_runs(frame).collect()), key=repr)
    expected = []
    for id, text in ROWS:
        words = split(text)
        found = plain_runs(words)
        expected.append((id, len(words), [r for r in found], collapsed(words, found)))
    plain = [(g[0], g[1], [tuple(r) for r in g[2]], g[3]) for g in got]
    assert sorted(plain, key=repr) == sorted(expected, key=repr)
    assert runs.periodic_runs(frame.limit(0)).count() == 0


def test_other_names_and_kinds(spark):
    frame = spark.createDataFrame([("k", "a b " * 20)], "__text string, text string").withColumnRenamed("__text", "name")
    assert runs.periodic_runs(frame, "name").first().n_words == 40
    clash = frame.withColumnRenamed("text", "__text")
    assert runs.periodic_runs(clash, "name", "__text").first().runs[0].period == 2


def test_a_text_beyond_a_slice(spark):
    words = [f"w{i}" for i in range(150_000)]
    text = " ".join(words + words[:100] * 3)
    row = runs.periodic_runs(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [tuple(r) for r in row.runs] == [(150_000, 300, 100)]


def plain_query(id, text):
    words = split(text)
    n = len(words)
    if id is not None and n:
        h = zlib.crc32(str(id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = plain_runs(words)
    top = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else None
    lines = "".join(f"{s},{m},{p}\n" for s, m, p in found)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    longest = (*top, 1000 * top[1] // top[2]) if top else (None,) * 4
    return (id, len(found), *longest, sha(lines), sha(collapsed(words, found)))


def test_the_query_equals_a_plain_version(spark, tmp_path):
    rng = random.Random(8)
    rows = list(ROWS)
    for id in range(10, 200):
        size = rng.randrange(0, 90)
        rows.append((id, "  ".join(rng.choice(["der", "die", "Die", "das"]) for _ in range(size))))
    assert sum(zlib.crc32(str(id).encode()) % 10 == 0 for id, _ in rows if id) > 10
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = registry.op13_periodic_runs(spark, str(tmp_path))
    assert [f.dataType.simpleString() for f in got.schema] == ["bigint"] * 6 + ["string"] * 2
    assert sorted(map(tuple, got.collect()), key=repr) == sorted((plain_query(*r) for r in rows), key=repr)
    assert registry.op13_periodic_runs(spark, str(tmp_path)).where(F.col("n_runs") == 0).where("start is not null").count() == 0
