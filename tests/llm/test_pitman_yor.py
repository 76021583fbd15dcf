import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from meterwise.llm import pitman_yor as P
from meterwise.llm import registry

END = object()


def tokens(text):
    low = (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    words = low.translate(str.maketrans({chr(c): " " for c in (*range(9, 14), 32)})).split(" ")
    return [w for w in words if w] + [END]


def out(id) -> bool:
    return id is not None and zlib.crc32(str(id).encode()) % 7 == 2


def plain_base(rows):
    counts = Counter(w for id, text in rows if not out(id) for w in tokens(text))
    n, v = sum(counts.values()), len(counts)
    for id, text in rows:
        own = tokens(text)
        yield id, out(id), len(own), sum(counts[w] > 0 for w in own), n, sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in own)


def corpus(n=300, seed=3):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    rows = []
    for id in range(n):
        word, words = rng.randrange(60), []
        for _ in range(rng.randrange(0, 60)):
            word = (word * 7 + rng.choice([1, 1, 1, 2, 5])) % 60
            words.append(vocabulary[word].upper() if rng.random() < 0.1 else vocabulary[word])
        rows.append((id, " \t".join(words)))
    return [*rows, (1000, None), (1001, ""), (1002, "  \n"), (1003, "nie gesehen öl"), (None, "w1 w2 w3"), (5, "w1 w8 w9")]


@pytest.fixture
def docs(spark):
    return lambda rows: spark.createDataFrame(rows, "doc_id long, text string")


def close(a, b):
    return abs(a - b) <= 1e-9 * max(1, abs(a))


def test_counts_and_base_equal_a_plain_version(docs):
    rows = corpus()
    got = sorted(map(tuple, P.score(docs(rows)).drop("score").collect()), key=repr)
    expected = sorted(plain_base(rows), key=repr)
    assert len(got) == len(expected)
    for a, b in zip(got, expected, strict=True):
        assert a[:5] == b[:5] and close(a[5], b[5])


def test_scores_equal_a_plain_version_of_the_sampled_seating(docs, spark):
    """The seating is taken over from the files; all predictive probabilities are computed anew, token by token, from dicts."""
    rows = corpus()
    frame = docs(rows)
    got = {(r.doc_id, r.n_tokens): r.score for r in P.score(frame).collect()}
    model, static, seats = P.train(frame)
    assert len(model.samples) == P.SAMPLES and static.where("part >= 0").count() == seats.count() == model.parts == 1
    entry = seats.first()
    part = P._load(entry.path, "words", "pair_runs", "pair_contexts", "pair_counts")
    names = np.frombuffer(part.words, np.uint64)
    word = np.repeat(np.arange(len(names)), P._from_planes(part.pair_runs))
    context, counts = P._from_planes(part.pair_contexts), P._ints(part.pair_counts)
    held = P._load(entry.seats, "parents", "table_sums", "sizes", "tables", "parent_sizes", "parent_tables")
    # What tables say in the last sample: sizes add up, the parent's customers are the tables.
    tables = P._from_planes(held.tables)
    ends = np.cumsum(tables)
    assert (np.add.reduceat(P._ints(held.sizes), ends - tables) == counts[counts > 1]).all()
    sent = np.bincount(word, np.where(counts == 1, 1, 0), len(names)) + np.bincount(word[counts > 1], tables, len(names))
    seated, parent = np.frombuffer(held.parents[-1], "<i8").reshape(2, -1)
    assert (seated == sent).all() and ((parent > 0) == (seated > 0)).all() and (parent <= seated).all()
    assert model.samples[-1].customers == seated.sum() and model.samples[-1].tables == parent.sum()

    d1, d2 = model.discount
    pair_tables = {}
    sums = iter(P._ints(held.table_sums))
    for w, c, n in zip(word, context, counts, strict=True):
        pair_tables[w, c] = (n, next(sums) / P.SAMPLES if n > 1 else float(n))
    context_counts = Counter()
    for (w, c), (n, _) in pair_tables.items():
        context_counts[c] += n
    place = {int(h): i for i, h in enumerate(names)}
    by_context = [P.context_table(s.path) + P.context_table(model.single_path) for s in model.samples]
    base = 1 / (model.vocabulary + 1)

    def chance(w, c):
        n, t = pair_tables[w, c]
        room = 1.0 + context_counts[c]
        total = (n - d2 * t) / room
        for number, sample in enumerate(model.samples):
            seated, parent = np.frombuffer(held.parents[number], "<i8").reshape(2, -1)
            single = (seated[w] - d1 * parent[w] + (1.0 + d1 * sample.tables) * base) / (1.0 + sample.customers)
            total += (1.0 + d2 * by_context[number][c]) / room * single / len(model.samples)
        return total

    import pyarrow as pa

    batch = pa.record_batch([pa.array([t for _, t in rows], pa.string())], names=["t"])
    row, hashes, before = P.tokens(batch, "t")
    totals, lengths = Counter(), Counter()
    for r, w, c in zip(row, hashes, before >> np.uint64(64 - P.CONTEXT_BITS), strict=True):
        totals[r] += math.log10(chance(place[int(w)], int(c)))
        lengths[r] += 1
    for i, (id, _) in enumerate(rows):
        if id != 5:
            assert close(got[id, lengths[i]], totals[i])
    # Probabilities of all words after a context, and of one unknown, add up to one.
    for c in list(context_counts)[:20]:
        if context_counts[c]:
            room, total = 1.0 + context_counts[c], 0.0
            for number, sample in enumerate(model.samples):
                seated, parent = np.frombuffer(held.parents[number], "<i8").reshape(2, -1)
                known = np.bincount(word, counts, len(names)) > 0
                single = (seated - d1 * parent + (1.0 + d1 * sample.tables) * base) / (1.0 + sample.customers)
                rest = (1.0 + d1 * sample.tables) * base / (1.0 + sample.customers)
                total += (1.0 + d2 * by_context[number][c]) / room * (single[known].sum() + rest) / len(model.samples)
            total += sum((n - d2 * t) / room for (w, k), (n, t) in pair_tables.items() if k == c)
            assert abs(total - 1) < 1e-9


def test_many_parts_and_frequent_words_give_like_scores(docs, monkeypatch):
    """Small parts and slices deal frequent words out; counts stay exact and scores differ by the draws only."""
    rows = corpus()
    whole = {r.doc_id: r for r in P.score(docs(rows)).collect()}
    monkeypatch.setattr(P, "PART_BYTES", 2000)
    monkeypatch.setattr(P, "SLICE_BYTES", 3000)
    monkeypatch.setattr(P, "PIECE_BYTES", 1000)
    split = P.score(docs(rows)).collect()
    assert len(split) == len(rows)
    for r in split:
        one = whole[r.doc_id]
        if r.doc_id != 5:
            assert (r.n_tokens, r.n_known, r.train_tokens) == (one.n_tokens, one.n_known, one.train_tokens)
            assert close(r.base_score, one.base_score)
            assert abs(r.score - one.score) <= 0.05 * r.n_tokens


def test_held_out_texts_are_better_predicted_than_by_single_words(docs):
    scored = P.score(docs(corpus(900))).where("held_out and n_tokens > 10").collect()
    assert len(scored) > 50
    assert sum(r.score for r in scored) > 1.5 * 0.5 * sum(r.base_score for r in scored)
    assert sum(r.score > r.base_score for r in scored) > 0.95 * len(scored)


def test_gibbs_moves_follow_the_process():
    """The mean number of tables of n customers of one dish equals that of exhaustive enumeration."""
    discount, fixed, slope, n = 0.5, 0.4, 0.2, 5
    weights = Counter()

    def place(sizes, seated, weight):
        if seated == n:
            weights[len(sizes)] += weight
            return
        for i, s in enumerate(sizes):
            place([*sizes[:i], s + 1, *sizes[i + 1 :]], seated + 1, weight * (s - discount))
        place([*sizes, 1], seated + 1, weight * (fixed + slope * len(sizes)))

    place([], 0, 1.0)
    expected = sum(t * w for t, w in weights.items()) / sum(weights.values())
    rng = np.random.default_rng(5)
    many = 20_000
    sizes, lengths = np.full(many, n), np.ones(many, np.int64)
    target = np.full(many, n)
    for _ in range(12):
        sizes, lengths = P.seat(sizes, lengths, target, np.full(many, fixed), np.full(many, slope), discount, rng)
    assert (np.add.reduceat(sizes, np.cumsum(lengths) - lengths) == n).all()
    assert abs(lengths.mean() - expected) < 0.03


def test_seats_follow_a_change_of_customers():
    rng = np.random.default_rng(1)
    empty = np.zeros(0, np.int64)
    target = np.array([0, 1, 3, 1000])
    sizes, lengths = P.seat(empty, np.zeros(4, np.int64), target, np.full(4, 0.5), np.full(4, 0.1), 0.5, rng)
    held = [sizes[e - n : e].sum() for e, n in zip(np.cumsum(lengths), lengths, strict=True)]
    assert held == [0, 1, 3, 1000]
    target = np.array([2, 0, 1, 7])
    sizes, lengths = P.seat(sizes, lengths, target, np.full(4, 0.5), np.full(4, 0.1), 0.5, rng)
    held = [sizes[e - n : e].sum() for e, n in zip(np.cumsum(lengths), lengths, strict=True)]
    assert held == [2, 0, 1, 7]


@pytest.mark.parametrize("rows", [[], [(2, "all held out")], [(None, None)], [(1, "ein Text")] * 3])
def test_few_rows(docs, rows):
    rows = [r for r in rows if r[1] != "all held out"] or ([(next(i for i in range(99) if out(i)), "a b")] if rows else [])
    got = sorted(map(tuple, P.score(docs(rows)).collect()), key=repr)
    expected = sorted(plain_base(rows), key=repr)
    assert [g[:5] for g in got] == [e[:5] for e in expected]
    assert all(close(g[5], e[5]) and math.isfinite(g[6]) for g, e in zip(got, expected, strict=True))


def test_clashing_columns_and_a_long_text(spark):
    long_text = " ".join(f"x{i % 997}" for i in range(400_000))
    frame = spark.createDataFrame([("a", long_text, 1, 2), ("b", "x1 x2", 1, 2)], "__id string, __text string, part int, score int")
    got = {r["__id"]: r for r in P.score(frame, "__id", "__text").collect()}
    assert got["a"].n_tokens == 400_001 and got["b"].n_tokens == 3
    assert got["a"].score > got["a"].base_score


def test_the_query(spark, tmp_path):
    spark.createDataFrame(corpus(), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = registry.op11_pitman_yor(spark, str(tmp_path))
    assert got.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    assert got.count() == len(corpus())


def test_seating_leaves_no_customer_out():
    """A row may have far more customers than a sweep moves: all of them sit, whatever the row held before."""
    rng = np.random.default_rng(3)
    target = np.array([1, 5, 5000, 70, 40_000])
    sizes, lengths = np.array([1, 3, 9000, 2]), np.array([1, 1, 1, 0, 1])
    for _ in range(3):
        sizes, lengths = P.seat(sizes, lengths, target, np.full(5, 0.2), np.full(5, 0.1), 0.6, rng)
        ends = np.cumsum(lengths)
        assert [int(s.sum()) for s in np.split(sizes, ends[:-1])] == target.tolist() and sizes.min() > 0


def test_a_sweep_seats_every_customer_anew():
    """Where a new table is as good as sure, nobody stays: not of a large dish, not of one that others have joined or left."""
    rng = np.random.default_rng(4)
    target = np.array([1, 9, 700, 20_000, 300, 50])
    sizes, lengths = np.array([1, 9, 700, 20_000, 100, 40, 60]), np.array([1, 1, 1, 1, 1, 2])
    sizes, lengths = P.seat(sizes, lengths, target, np.full(6, 1e15), np.full(6, 0.1), 0.6, rng)
    assert lengths.tolist() == target.tolist() and (sizes == 1).all()


def mean_tables(n, fixed, slope, discount):
    """The exact mean number of tables, by the weights of all seatings of one customer after the other."""
    weights, t = np.zeros(n + 2), np.arange(n + 2)
    weights[1] = 1.0
    for i in range(1, n):
        new = weights * (fixed + slope * t)
        weights = weights * np.maximum(i - discount * t, 0)
        weights[1:] += new[:-1]
        weights /= weights.sum()
    return float((weights * t).sum())


@pytest.mark.parametrize(("n", "fixed", "slope", "discount"), [(60, 30.0, 0.2, 0.6), (120, 3.0, 0.9, 0.5), (300, 0.5, 0.1, 0.7)])
def test_large_rows_follow_the_process(n, fixed, slope, discount, monkeypatch):
    """Rows of many tables, swept in groups, and rows that one table dominates keep the law that plain sweeps have reached."""
    rng, many = np.random.default_rng(6), 1500
    rows = np.full(many, n), np.full(many, fixed), np.full(many, slope), discount, rng
    sizes, lengths = np.full(many, n), np.ones(many, np.int64)
    with monkeypatch.context() as plain:
        plain.setattr(P, "GROUP_TABLES", n)
        plain.setattr(P, "_dominated", lambda largest, customers: np.zeros(len(customers), bool))
        for _ in range(25):
            sizes, lengths = P.seat(sizes, lengths, *rows)
    expected, means = mean_tables(n, fixed, slope, discount), []
    for _ in range(12):
        sizes, lengths = P.seat(sizes, lengths, *rows)
        assert (np.add.reduceat(sizes, np.cumsum(lengths) - lengths) == n).all() and sizes.min() > 0
        means.append(lengths.mean())
    assert abs(np.mean(means) - expected) < 0.01 * expected + 0.03


def test_many_tables_are_there_after_the_first_sweep():
    rng, many, n = np.random.default_rng(8), 300, 300
    sizes, lengths = P.seat(np.full(many, n), np.ones(many, np.int64), np.full(many, n), np.full(many, 60.0), np.full(many, 0.05), 0.8, rng, True)
    assert (np.add.reduceat(sizes, np.cumsum(lengths) - lengths) == n).all()
    assert abs(lengths.mean() - mean_tables(n, 60.0, 0.05, 0.8)) < 8
