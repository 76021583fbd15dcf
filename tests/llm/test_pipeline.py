"""The pipeline against a plain version of its stages."""

import hashlib
import math
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
from plain import LOWER, brute_components
from tokenizers import Tokenizer

import corpus_pipeline
from meterwise.llm import registry, toxicity

SF_DIR = "/root/testdata/sf0.001"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def windows(text):
    words = re.findall(WORD, (text or "").translate(LOWER))
    n = min(10, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if n else set()


def copies(doc, mean):
    parts = max(1, math.ceil(mean / 16))
    total = 0
    for part in range(1, parts + 1):
        u = Fraction(int(hashlib.md5(f"mixture:{part}:{doc}".encode()).hexdigest()[:13], 16), 1 << 52)
        p = c = math.exp(-mean / parts)
        k = 0
        while c <= u:
            k += 1
            p = p * (mean / parts) / k
            c += p
        total += k
    return total


def test_against_plain_version(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    frame = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    # The classifier itself is judged in its own test; here its scores are taken over.
    model = toxicity.train(frame, labels.where(~toxicity.held_out("doc_id")))
    kept = {r.doc_id for r in toxicity.score(frame, model).collect() if r.score < 0.7}
    kept = {i for i, _, c in brute_components([(d, docs[d].text) for d in kept]) if i == c}
    items = set().union(*(windows(r.text) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()))
    lengths = {len(w) for w in items}

    def clean(text):
        words = re.findall(WORD, (text or "").translate(LOWER))
        return not any(tuple(words[i : i + n]) in items for n in lengths for i in range(len(words) - n + 1))

    kept = {d for d in kept if clean(docs[d].text)}
    n = Counter(docs[d].source for d in kept)
    weight = {s: round(math.sqrt(k) * 1000) for s, k in n.items()}
    share = {s: weight[s] / sum(weight.values()) * len(kept) / n[s] for s in n}
    tokenizer = Tokenizer.from_file(registry.tokenizer_file())
    want, start = [], 0
    for d in sorted(kept):
        ids = [*tokenizer.encode(docs[d].text or "", add_special_tokens=False).ids, 1]
        for _ in range(copies(d, share[docs[d].source])):
            want.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            start += len(ids)
    got = sorted((tuple(r)[:4] for r in corpus_pipeline.run(spark, SF_DIR).collect()), key=lambda r: r[1])
    assert got == want


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF_DIR).columns == docs.columns


def test_stages_on_no_documents(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF_DIR).count() == 0
