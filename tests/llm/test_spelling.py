import random
import zlib
from collections import Counter, defaultdict

import pytest

from meterwise.llm import registry, spelling

LETTERS = set("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ") | {chr(c) for c in range(0xC0, 0x100)}
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_counts(rows, lose=None, length=7, least=2):
    counts = Counter()
    for id, text in rows:
        run = ""
        for c in [*(text or ""), " "]:
            if c in LETTERS:
                run += c
                continue
            if run:
                word = run.translate(LOW)
                h = zlib.crc32(f"{'' if id is None else id}:{word}".encode())
                if lose and h % lose == 0:
                    cut = h % len(word)
                    word = word[:cut] + word[cut + 1 :]
                if len(word) >= length:
                    counts[word] += 1
            run = ""
    return {w: n for w, n in counts.items() if n >= least}


def edited(a, b):
    """Exactly one inserted, deleted or replaced character, by trying all."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def plain_variants(counts, factor=10):
    near = defaultdict(set)
    words = sorted(counts)
    for i, a in enumerate(words):
        for b in words[i + 1 :]:
            if edited(a, b):
                near[a].add(b)
                near[b].add(a)
    form = {}
    for w in words:
        if near[w]:
            best = min(near[w], key=lambda v: (-counts[v], v))
            if counts[best] >= factor * counts[w]:
                form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, form.get(w), root(w), counts[w], len(near[w]), counts[form[w]] if w in form else None) for w in words)


def changed(rng, word):
    i, c = rng.randrange(len(word)), rng.choice("abcdeéßü")
    return rng.choice([word[:i] + c + word[i + 1 :], word[:i] + word[i + 1 :], word[:i] + c + word[i:], word + c, c + word])


def vocabulary(seed, n=150):
    rng = random.Random(seed)
    made = {}
    for _ in range(n):
        word = "".join(rng.choice("abcdeéßü"[: rng.randrange(1, 9)]) for _ in range(rng.randrange(7, 14)))
        made[word] = rng.choice([2, 3, 20, 200, 30_000])
        for _ in range(rng.randrange(0, 6)):
            other = changed(rng, word)
            if len(other) >= 7:
                made.setdefault(other, rng.choice([2, 2, 3, 40]))
                word = other if rng.random() < 0.3 else word
    return made


def collected(frame):
    return sorted(map(tuple, frame.select("word", "form", "root", "n", "n_near", "form_n").collect()))


@pytest.mark.parametrize("seed", range(4))
def test_variants_equal_brute_force(spark, seed, monkeypatch):
    if seed % 2:
        # Hardly any gram is frequent, or nearly all are.
        monkeypatch.setattr(spelling, "EXTENDED", 20 if seed == 1 else 10**9)
    counts = vocabulary(seed)
    frame = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert collected(spelling.variants(frame)) == plain_variants(counts)


def test_chains_ties_and_lonely_words(spark):
    counts = {"abcdefg": 2, "abcdefgh": 20, "abcdefghi": 200, "abcdefghij": 2000, "abcdefgx": 20, "zzzzzzzzz": 5, "aaaaaaa": 3, "aaaaaaaa": 3}
    got = collected(spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n long")))
    assert got == plain_variants(counts)
    assert {w: (f, r) for w, f, r, *_ in got}["abcdefg"] == ("abcdefgh", "abcdefghij")
    assert spelling.variants(spark.createDataFrame([], "word string, n long")).count() == 0


def test_one_edit_spares_a_gram_of_each(spark):
    """The bound of affected grams: of both words' decompositions, what an edit spares is among the rarest bound + 1."""
    rng = random.Random(9)
    words = list(vocabulary(9))
    grams = spelling.gram_dictionary(spark.createDataFrame([(w,) for w in words], "word string"))
    kept = {r.gram: r.n for r in grams.collect()}
    assert {len(g) for g in kept} >= {2, 3}
    table = object.__new__(spelling.Grams)
    table.counts = kept
    for _ in range(3000):
        a = rng.choice(words)
        b = changed(rng, a)
        if len(b) < 7 or a == b:
            continue
        chosen = []
        for w in (a, b):
            made = table.decompose(w)
            assert [w[i : i + len(g)] for i, (g, _) in enumerate(made)] == [g for g, _ in made]
            bound = spelling.affected([r for _, r in made])
            assert bound < len(made)
            order = sorted(range(len(made)), key=lambda i: (kept.get(made[i][0], 0), made[i][0], i))[: bound + 1]
            chosen.append({(made[i][0], i) for i in order})
        shift = len(b) - len(a)
        assert any((g, i) in chosen[1] or (g, i + shift) in chosen[1] for g, i in chosen[0]), (a, b)


ROWS = [
    (1, "Straßenbahn STRASSENBAHN strassenbahn; Straßenbahn, x"),
    (2, None),
    (3, ""),
    (None, "Straßenbahn niemandem niemandem"),
    (5, "élèvesss ÉLÈVESSS élèvesss × ÷ unterwegs-unterwegs"),
    (5, "élèvesss"),
]


@pytest.mark.parametrize("lose", [None, 2, 31])
def test_counts_equal_a_plain_version(spark, lose):
    rng = random.Random(4)
    rows = ROWS + [(i, " ".join(rng.choice(["Verkehrsmittel", "verkehrsmittel", "abcdefg", "abcdefgh", "kurz"]) for _ in range(40))) for i in range(60)]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, word int")
    got = {r.word: r.n for r in spelling.word_counts(frame, lose=lose).collect()}
    assert got == plain_counts(rows, lose)


def test_the_query_equals_a_plain_version(spark, tmp_path):
    rng = random.Random(6)
    words = list(vocabulary(6))
    rows = ROWS + [(i, " ".join(rng.choice(words[: rng.randrange(1, len(words))]) for _ in range(60))) for i in range(300)]
    rows.append((999, "langeswort " * 200_000))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = registry.op12_spelling_variants(spark, str(tmp_path))
    assert [f.dataType.simpleString() for f in got.schema] == ["string"] * 3 + ["bigint"] * 3
    assert collected(got) == plain_variants(plain_counts(rows, 31))
