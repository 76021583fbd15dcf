"""Toxicity: a linear classifier over character n-grams that are scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterwise.llm.common import release, releasing, row_slices, staged

GRAMS = (3, 4, 5)
BITS = 20
#: Rows of each class that the model is fitted on, at most; they are those with the smallest hashed ids.
FIT_ROWS = 3000
#: Features that the linear model gets, those with the most weight of evidence in the rows it is fitted on.
FEATURES = 20_000
_MULTIPLIER = np.uint32(0x9E3779B1)
_MIXER = np.uint32(0x85EBCA6B)


def gram_buckets(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each n: the rows of the first and last character and the hash bucket of all runs of n characters of the
    lower-case texts, white space as one blank, a blank before and after each text. Null is an empty text. Runs over
    two rows are among them."""
    lowered = [" " + " ".join((t or "").lower().split()) + " " for t in texts]
    sizes = np.array([len(t) for t in lowered])
    codes = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    rows = np.repeat(np.arange(len(sizes)), sizes)
    h = np.zeros(len(codes), np.uint32)
    for n in range(1, max(GRAMS) + 1):
        m = len(codes) - n + 1
        if m <= 0:
            return
        h = h[:m] * _MULTIPLIER + codes[n - 1 :]
        if n in GRAMS:
            mixed = (h ^ (h >> np.uint32(15))) * _MIXER
            yield rows[:m], rows[n - 1 :], (mixed ^ (mixed >> np.uint32(13))) >> np.uint32(32 - BITS)


def present(texts: list[str | None], chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and buckets, each pair once, of the n-grams whose bucket is chosen."""
    keys = []
    for rows, last, buckets in gram_buckets(texts):
        keep = np.flatnonzero(chosen[buckets])
        keep = keep[rows[keep] == last[keep]]
        keys.append((rows[keep] << BITS) | buckets[keep].astype(np.int64))
    found = np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.int64)
    return found >> BITS, found & ((1 << BITS) - 1)


def _chunks(texts: list[str | None], limit: int = 1 << 19) -> Iterator[tuple[int, list[str | None]]]:
    begin, held = 0, 0
    for i, text in enumerate(texts):
        size = len(text or "")
        if i > begin and held + size > limit:
            yield begin, texts[begin:i]
            begin, held = i, 0
        held += size
    if texts:
        yield begin, texts[begin:]


def fit(texts: list[str | None], labels: list[int]) -> tuple[np.ndarray, np.ndarray, float]:
    """Buckets, their weights and the intercept.

    r = log((1 + documents of class 1 with the bucket) / their sum) - the same for class 0. The features with the largest
    |r| * sqrt(documents) are kept. Each is worth r where it is present; a logistic regression with an L2 penalty over
    these scaled features is minimised by accelerated gradient steps. With one class only, or none, all weights are 0 and the
    score is that class's (or 0); where no feature is in three rows or tells the classes apart, it is the share of class 1.
    """
    y = np.asarray(labels, float)
    if len(y) == 0 or y.min() == y.max():
        return np.zeros(0, np.int64), np.zeros(0), 8.0 if len(y) and y[0] else -8.0
    everything = np.ones(1 << BITS, bool)
    counts = np.zeros((2, 1 << BITS))
    for begin, part in _chunks(texts):
        rows, buckets = present(part, everything)
        one = y[begin + rows] == 1
        counts[1] += np.bincount(buckets[one], minlength=1 << BITS)
        counts[0] += np.bincount(buckets[~one], minlength=1 << BITS)
    documents = counts.sum(0)
    counts += 1
    # Shares of the class's documents: long documents of one class then do not shift every feature.
    ratio = np.log(counts[1] / (y.sum() + 2)) - np.log(counts[0] / ((1 - y).sum() + 2))
    evidence = np.where(documents >= 3, np.abs(ratio) * np.sqrt(documents), 0)
    picked = np.sort(np.argsort(-evidence, kind="stable")[:FEATURES])
    picked = picked[evidence[picked] > 0]
    if len(picked) == 0:
        # Nothing tells the classes apart: every text gets the share of class 1.
        return picked, np.zeros(0), float(np.log(y.sum() / (1 - y).sum()))
    chosen = np.zeros(1 << BITS, bool)
    chosen[picked] = True
    # A chunk's rows, their features row after row, and how many each row has. Sums go chunk by chunk, so what they need
    # beside the features has a bound.
    taken, ratio = [], ratio[picked]
    for begin, part in _chunks(texts):
        rows, buckets = present(part, chosen)
        taken.append((slice(begin, begin + len(part)), np.searchsorted(picked, buckets).astype(np.int32), np.bincount(rows, minlength=len(part))))

    def sums(weights: np.ndarray) -> np.ndarray:
        """Of each row, the sum of its features' scaled weights."""
        made, scaled = np.zeros(len(y)), ratio * weights
        for own, features, lengths in taken:
            full = np.flatnonzero(lengths)
            if len(full):
                made[own][full] = np.add.reduceat(scaled[features], (np.cumsum(lengths) - lengths)[full])
        return made

    def back(values: np.ndarray) -> np.ndarray:
        """Of each feature, the scaled sum of its rows' values."""
        made = np.zeros(len(picked))
        for own, features, lengths in taken:
            np.add.at(made, features.astype(np.int64), np.repeat(values[own], lengths))
        return made * ratio

    n = len(y)
    share = np.where(y == 1, 0.5 / y.sum(), 0.5 / (n - y.sum()))
    penalty = 1e-4
    # The Lipschitz constant of the gradient, from a few power iterations.
    v = np.ones(len(picked))
    for _ in range(12):
        v /= np.linalg.norm(v) + 1e-12
        v = back(share * sums(v))
    step = 1 / (0.3 * np.linalg.norm(v) + 0.3 + penalty)
    w, b, w_old, b_old = np.zeros(len(picked)), 0.0, np.zeros(len(picked)), 0.0
    for t in range(300):
        m = t / (t + 3)
        wy, by = w + m * (w - w_old), b + m * (b - b_old)
        z = sums(wy) + by
        g = share * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y)
        w_old, b_old = w, b
        w = wy - step * (back(g) + penalty * wy)
        b = by - step * g.sum()
    return picked, w * ratio, float(b)


def train(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic", fit_rows: int = FIT_ROWS) -> DataFrame:
    """The model as a written table of one row: ``buckets``, ``weights``, ``intercept``.

    It is fitted on a bounded sample, ``fit_rows`` labelled rows of each class at most, in one task. Labels other than 0 and 1
    are left out; an id that is labelled more than once gets its larger label.
    """
    usable = labels.where(F.col(label).isin(0, 1)).groupBy(F.col(id).alias("__id")).agg(F.max(label).alias("__y"))
    order = [F.xxhash64("__id"), F.col("__id")]
    ids = usable.where("__y = 1").orderBy(*order).limit(fit_rows).unionByName(usable.where("__y = 0").orderBy(*order).limit(fit_rows))
    chosen = staged(ids, "labelled")
    one = docs.select(F.col(id).alias("__id"), F.col(text).cast("string").alias("__text"))
    # Of rows that repeat an id, one is used.
    sample = one.join(chosen, "__id").groupBy("__id").agg(F.min(F.struct("__y", "__text")).alias("r")).select("__id", "r.*")

    def learn(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("__id")
        buckets, weights, intercept = fit(list(frame["__text"]), list(frame["__y"]))
        release()
        return pd.DataFrame({"buckets": [buckets], "weights": [weights], "intercept": [intercept]})

    schema = "buckets array<long>, weights array<double>, intercept double"
    return staged(sample.withColumn("__all", F.lit(1)).groupBy("__all").applyInPandas(learn, schema), "toxicity-model")


class Scorer:
    """The model, once per task, as a table of weights by bucket."""

    def __init__(self, buckets: np.ndarray, weights: np.ndarray, intercept: float) -> None:
        self.table = np.zeros(1 << BITS)
        self.table[buckets] = weights
        self.chosen = self.table != 0
        self.intercept = intercept

    def scores(self, texts: list[str | None]) -> np.ndarray:
        rows, found = present(texts, self.chosen)
        z = np.bincount(rows, self.table[found], len(texts)) + self.intercept
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _broadcast(docs: DataFrame, model: DataFrame):
    """The model has FEATURES weights at most, so it may go to every task. Without a row it has no evidence at all."""
    row = model.first()
    content = ([], [], -8.0) if row is None else (row["buckets"], row["weights"], row["intercept"])
    buckets, weights, intercept = content
    return docs.sparkSession.sparkContext.broadcast((np.asarray(buckets, np.int64), np.asarray(weights, float), intercept))


def score(docs: DataFrame, model: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``id`` and ``score`` (0 to 1) of every row, from its whole text. Null and empty texts get the score of no evidence;
    repeated rows and null ids are scored like any other row."""
    sent = _broadcast(docs, model)

    @releasing
    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*sent.value)
        for batch in batches:
            for part in row_slices(batch, "__text"):
                values = pa.array(scorer.scores(part.column(1).to_pylist()))
                yield pa.RecordBatch.from_arrays([part.column(0), values], names=[id, "score"])

    one = docs.select(F.col(id), F.col(text).cast("string").alias("__text"))
    return one.mapInArrow(scores, f"`{id}` {one.schema[0].dataType.simpleString()}, score double")


def without_toxic(docs: DataFrame, model: DataFrame, threshold: float = 0.7, text: str = "text") -> DataFrame:
    """The rows of docs with a score below the threshold, unchanged. Each row is judged by itself, so repeated and null ids
    do not matter; null and empty texts stay unless no evidence at all is already beyond the threshold."""
    sent = _broadcast(docs, model)

    @releasing
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*sent.value)
        for batch in batches:
            for part in row_slices(batch, text):
                texts = part.column(part.schema.get_field_index(text)).to_pylist()
                yield part.filter(pa.array(scorer.scores(texts) < threshold))

    return docs.mapInArrow(keep, docs.schema)


def held_out(id: str = "doc_id"):
    """Rows whose labels are never learnt from."""
    return F.coalesce(F.crc32(F.coalesce(F.col(id).cast("string"), F.lit("")).cast("binary")) % 3 == 1, F.lit(False))
