"""Decontamination against windows of word lists. The query itself is checked by its SQL."""

import re

from plain import LOWER, docs  # noqa: F401
from pyspark.sql import functions as F

from meterwise.llm import decontamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ITEM = "one two three four five six seven eight nine ten eleven twelve"
ITEMS = [(10, ITEM), (2, "short item"), (3, None), (4, ""), (5, "ünï 42"), (6, ITEM), (None, "no id here at all my friends of old times")]
TEXTS = [
    "x " + ITEM.upper() + " y", "One, two; three-four five_six seven.eight nine\nten", "one two three four five six seven eight nine", "", None, "... --- ...",
    "a Short  ITEM, a short item short item", "short", "item short", "ÜNÏ 42", "ünï 42 x " * 3000, ITEM + " " + ITEM, "no id here at all my friends of old times", "short\x00item",
]


def items(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def brute(texts, known):
    windows = {}
    for name, text in known:
        words = WORD.findall((text or "").translate(LOWER))
        n = min(10, len(words))
        for i in range(len(words) - n + 1 if n else 0):
            windows.setdefault(tuple(words[i : i + n]), set()).add("null" if name is None else str(name))
    result = []
    for doc, text in texts:
        words = WORD.findall((text or "").translate(LOWER))
        hit, names = set(), set()
        for n in {len(w) for w in windows}:
            for i in range(len(words) - n + 1):
                found = windows.get(tuple(words[i : i + n]))
                if found:
                    hit |= set(range(i, i + n))
                    names |= found
        result.append((doc, len(words), len(hit), sorted(names)))
    return sorted(result)


def run(frame, known, **options):
    return sorted((r.doc_id, r["__words"], r["__hit"], list(r["__items"])) for r in decontamination.contamination(frame, known, **options).collect())


def test_all_kinds_of_texts_and_items(spark, docs):
    rows = list(enumerate(TEXTS))
    assert run(docs(rows), items(spark, ITEMS)) == brute(rows, ITEMS)


def test_several_blocks_give_the_same(spark, docs):
    rows = list(enumerate(TEXTS))
    assert run(docs(rows), items(spark, ITEMS), block_bytes=300) == brute(rows, ITEMS)


def test_spans_and_removal(spark, docs):
    rows = [(1, "keep this Short,  item and that"), (2, None), (3, "clean"), (4, "short item"), (1, "clean too"), (None, "short item é")]
    frame = docs(rows).withColumnRenamed("lang", "__hit")
    known = items(spark, ITEMS)
    kept = decontamination.without_contaminated(frame.drop("__hit"), known)
    assert sorted((str(r.doc_id), r.text) for r in kept.collect()) == [("1", "clean too"), ("2", None), ("3", "clean")]
    cut = decontamination.without_spans(docs(rows), known)
    assert cut.columns == docs(rows).columns
    assert sorted((str(r.doc_id), str(r.text)) for r in cut.collect()) == [("1", "clean too"), ("1", "keep this and that"), ("2", "None"), ("3", "clean"), ("4", ""), ("None", "é")]
    assert decontamination.contamination(frame, known).where("__words is null").count() == 0


def test_nothing_to_compare(spark, docs):
    none = items(spark, [])
    assert run(docs([(1, "a b")]), none) == [(1, 2, 0, [])] and run(docs([]), items(spark, ITEMS)) == []
    assert decontamination.without_contaminated(docs([(1, "a b")]), none).count() == 1


def test_digest_of_no_items(spark):
    assert spark.range(1).select(F.sha2(F.lit("").cast("binary"), 256).alias("s")).first().s == decontamination.items_digest([])


def test_columns_of_any_name_are_kept(spark, docs):
    frame = docs([(1, "keep this short item and that"), (2, "clean")])
    for name in ("__words", "__spans", "__Hit", "__items"):
        frame = frame.withColumn(name, F.lit(name))
    kept = decontamination.without_contaminated(frame, items(spark, ITEMS))
    assert kept.columns == frame.columns and [tuple(r)[-4:] for r in kept.collect()] == [("__words", "__spans", "__Hit", "__items")]
    cut = decontamination.without_spans(frame.withColumn("__items", F.col("text")), items(spark, ITEMS), text="__items")
    assert cut.columns == frame.columns and {r["__items"] for r in cut.collect()} == {"keep this and that", "clean"}
