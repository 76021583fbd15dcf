"""Toxicity: held-out accuracy on the given tables, odd inputs on small ones."""

import math
import random
import zlib

import numpy as np

from plain import docs  # noqa: F401

from meterwise.llm import registry, toxicity

SF_DIR = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    scores = {r.doc_id: r for r in registry.op10_toxicity(spark, SF_DIR).collect()}
    assert len(scores) == spark.read.parquet(f"{SF_DIR}/documents.parquet").count()
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").collect() if r.toxic is not None}
    own = [(scores[d], y) for d, y in labels.items() if scores[d].held_out]
    assert all(r.held_out == (zlib.crc32(str(d).encode()) % 3 == 1) for d, r in scores.items())
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in scores.values())
    caught = np.mean([r.predicted for r, y in own if y == 1])
    wrong = np.mean([r.predicted for r, y in own if y == 0])
    # Three hundred examples of the class here; ten times as many catch all but one in a thousand.
    assert caught > 0.55 and wrong < 0.005


def labelled(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_learns_rare_spellings(spark, docs):
    rows = [(i, f"plain words about item {i} and more" + (" zqxv!" if i % 2 else "")) for i in range(40)]
    model = toxicity.train(docs(rows), labelled(spark, [(i, 0, i % 2) for i in range(40)]))
    new = docs([(1, "some other ZQXV here"), (2, "some other thing here"), (3, None), (4, ""), (5, "zqxv " * 30_000), (None, "zqxv"), (1, "some other ZQXV here")])
    got = sorted((str(r.doc_id), r.score >= 0.7) for r in toxicity.score(new.withColumnRenamed("lang", "score"), model).collect())
    assert got == [("1", True), ("1", True), ("2", False), ("3", False), ("4", False), ("5", True), ("None", True)]
    kept = toxicity.without_toxic(new, model)
    assert kept.columns == new.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3, 4]


def test_same_model_from_any_partitioning(spark, docs):
    rows = [(i, f"text {i * 7919 % 101} {'bad' if i % 3 == 0 else 'good'}") for i in range(60)]
    labels = labelled(spark, [(i, 0, int(i % 3 == 0)) for i in range(60)])
    one, two = (toxicity.train(docs(rows, n), labels).first() for n in (1, 5))
    assert one.buckets == two.buckets and np.allclose(one.weights, two.weights)


def test_labels_of_one_class_none_or_odd(spark, docs):
    frame = docs([(1, "a"), (1, "b"), (2, None), (None, "x")])
    none = toxicity.train(frame, labelled(spark, []))
    assert none.count() == 0 and all(r.score < 0.01 for r in toxicity.score(frame, none).collect())
    odd = toxicity.train(frame, labelled(spark, [(1, 0, None), (2, 0, 7), (None, 0, 1), (99, 0, 1)]))
    assert odd.count() == 0
    toxic = toxicity.train(frame, labelled(spark, [(1, 0, 1), (1, 0, 0)]))
    assert all(r.score > 0.99 for r in toxicity.score(frame, toxic).collect())
    assert toxicity.score(docs([]), toxic).count() == 0 and toxicity.without_toxic(docs([]), none).count() == 0


def test_texts_that_tell_nothing_apart(spark, docs):
    """Equal texts, too few rows for any feature, and empty ones: the share of the class, and no crash."""
    for texts in (["same text"] * 2, ["same text"] * 6, ["", "x"]):
        rows = list(enumerate(texts))
        model = toxicity.train(docs(rows), labelled(spark, [(i, 0, i % 2) for i, _ in rows]))
        assert model.first().buckets == [] and model.first().intercept == 0
        assert all(abs(r.score - 0.5) < 1e-12 for r in toxicity.score(docs(rows), model).collect())
        assert toxicity.without_toxic(docs(rows), model).count() == len(rows)


def plain_buckets(text):
    """The buckets of a text's n-grams, one character at a time."""
    padded = " " + " ".join((text or "").lower().split()) + " "
    found = set()
    for n in toxicity.GRAMS:
        for i in range(len(padded) - n + 1):
            h = 0
            for c in padded[i : i + n]:
                h = (h * 0x9E3779B1 + ord(c)) & 0xFFFFFFFF
            h = ((h ^ (h >> 15)) * 0x85EBCA6B) & 0xFFFFFFFF
            found.add((h ^ (h >> 13)) >> (32 - toxicity.BITS))
    return found


def plain_model(texts, labels):
    """Counts, ratios and features in dicts, and the logistic regression one row at a time."""
    own = [plain_buckets(t) for t in texts]
    ones, n = sum(labels), len(labels)
    seen = {}
    for buckets, y in zip(own, labels, strict=True):
        for b in buckets:
            seen.setdefault(b, [0, 0])[y] += 1
    ratio = {b: math.log((c[1] + 1) / (ones + 2)) - math.log((c[0] + 1) / (n - ones + 2)) for b, c in seen.items()}
    evidence = {b: abs(ratio[b]) * math.sqrt(sum(c)) for b, c in seen.items() if sum(c) >= 3}
    picked = sorted(sorted((b for b in evidence if evidence[b] > 0), key=lambda b: (-evidence[b], b))[: toxicity.FEATURES])
    place = {b: i for i, b in enumerate(picked)}
    rows = [[(place[b], ratio[b]) for b in buckets if b in place] for buckets in own]
    share = [0.5 / ones if y else 0.5 / (n - ones) for y in labels]
    v = [1.0] * len(picked)
    for _ in range(12):
        norm = math.sqrt(sum(x * x for x in v)) + 1e-12
        v = [x / norm for x in v]
        u = [sum(r * v[f] for f, r in row) for row in rows]
        v = [0.0] * len(picked)
        for row, s, x in zip(rows, share, u, strict=True):
            for f, r in row:
                v[f] += r * s * x
    step = 1 / (0.3 * math.sqrt(sum(x * x for x in v)) + 0.3 + 1e-4)
    w, b, w_old, b_old = [0.0] * len(picked), 0.0, [0.0] * len(picked), 0.0
    for t in range(300):
        m = t / (t + 3)
        wy, by = [x + m * (x - o) for x, o in zip(w, w_old, strict=True)], b + m * (b - b_old)
        slope, all_ = [1e-4 * x for x in wy], 0.0
        for row, s, y in zip(rows, share, labels, strict=True):
            z = sum(r * wy[f] for f, r in row) + by
            g = s * (1 / (1 + math.exp(-z)) - y)
            all_ += g
            for f, r in row:
                slope[f] += r * g
        w_old, b_old = w, b
        w, b = [x - step * s for x, s in zip(wy, slope, strict=True)], by - step * all_
    weight = {bucket: x * ratio[bucket] for bucket, x in zip(picked, w, strict=True)}
    return lambda text: 1 / (1 + math.exp(-(sum(weight.get(x, 0.0) for x in plain_buckets(text)) + b)))


def test_scores_equal_a_plain_version(spark, docs):
    rng = random.Random(3)
    words = ["haus", "Baum", "über", "mies", "pfui", "gut", "x"]
    texts = [" ".join(rng.choice(words[: 4 + 3 * (i % 2)]) for _ in range(rng.randrange(0, 9))) for i in range(40)]
    labels = [int(i % 2 == 1 and rng.random() < 0.8) for i in range(40)]
    model = toxicity.train(docs(list(enumerate(texts))), labelled(spark, [(i, 0, y) for i, y in enumerate(labels)]))
    plain = plain_model(texts, labels)
    new = [*texts, None, "", "ganz neue Worte pfui", "pfui " * 20_000]
    got = {r.doc_id: r.score for r in toxicity.score(docs(list(enumerate(new))), model).collect()}
    assert all(abs(got[i] - plain(t)) < 1e-6 for i, t in enumerate(new))
