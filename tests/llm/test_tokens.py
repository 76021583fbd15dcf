"""Token files against the tokenizer itself, and the index against keys it does not hold."""

import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from plain import docs  # noqa: F401

from meterwise.llm import registry, tokens
from meterwise.llm.common import scratch

TEXTS = [
    "Hello, WORLD! it's 3.14 and don't --- stop", "", None, "  \t\n ", "été Straße ÀÉ naïve Ünï ÿ", "été combining", "İstanbul ΣΟΦΟΣ ǅ ɐbc",
    "<|endoftext|> <|startoftext|>x <|ENDOFTEXT|>", "a b c\u0085d\x1ce", "日本語 テキスト 🙂🙂 ", "'s 'tis rock'n'roll ''", "x" * 30_000, "word. word, word; word!? (word) #word$ &&&",
    "ﬁ ＡＢＣ Ⅷ ½", "one\x0btwo\x0cthree",
]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(registry.tokenizer_file())


def expected(rows, tokenizer):
    start, result = 0, []
    for key, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        result.append((key, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return result


def check(spark, docs, rows, tokenizer, **options):
    got = [tuple(r)[:4] for r in tokens.token_table(docs(rows).withColumnRenamed("lang", "shard"), registry.tokenizer_file(), **options).collect()]
    assert sorted(got, key=lambda r: r[1]) == expected(rows, tokenizer)


def test_texts_of_all_kinds(spark, docs, tokenizer):
    check(spark, docs, list(enumerate(TEXTS)), tokenizer)


def test_repeated_and_null_keys(spark, docs, tokenizer):
    rows = [(3, "a b"), (3, "a b"), (3, "c"), (1, "first"), (None, "no key"), (None, None), (9, "last"), (1, "first")]
    check(spark, docs, rows, tokenizer, shards=5)


def test_no_documents(spark, docs):
    assert tokens.token_table(docs([]), registry.tokenizer_file()).count() == 0


def test_index_does_not_find_other_keys(spark, docs):
    folder = scratch(spark, "tokens")
    keys = tokens.write_shards(docs([(i * 2, f"text {i}") for i in range(300)]), registry.tokenizer_file(), folder)
    index = tokens.build_index(keys, folder, part_keys=50)
    assert index.count() == 6
    asked = spark.range(600).select("id").withColumnRenamed("id", "key")
    found = tokens.look_up(asked, index, folder).collect()
    assert sorted(r.key for r in found) == list(range(0, 600, 2)) and len(index.columns) == 3


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 50_000])
def test_perfect_hash_is_minimal(n):
    numbers = np.random.default_rng(n).integers(0, 1 << 63, n, dtype=np.uint64)
    places = tokens.PerfectHash.build(numbers).places(numbers)
    assert sorted(places) == list(range(n))


def test_perfect_hash_refuses_repeated_numbers():
    with pytest.raises(ValueError):
        tokens.PerfectHash.build(np.array([5, 5], np.uint64))
