"""Rollups against a dictionary of what counts. The query itself is checked by its SQL."""

import random

from plain import docs  # noqa: F401

from meterwise.llm import rollups
from meterwise.llm.common import scratch

SCHEMA = "doc string, source string, lang string, version string, n_tokens long, kind string"


def change(doc, kind="insert", n=1, version="v1", source="a", lang="en"):
    return (doc, source, lang, version, n, kind)


class State:
    def __init__(self, spark):
        self.spark, self.rollup, self.live = spark, rollups.TokenRollup(spark, scratch(spark, "rollup")), {}

    def apply(self, name, rows):
        best = {}
        for doc, source, lang, version, n, kind in rows:
            if doc is None or kind not in ("insert", "revise", "delete") or (version is None and kind != "delete"):
                continue
            order = (kind == "delete", n or 0, source is not None, source or "", lang is not None, lang or "")
            if (doc, version) not in best or order > best[doc, version][0]:
                best[doc, version] = (order, source, lang)
        gone = {doc for doc, version in best if version is None}
        self.live = {k: v for k, v in self.live.items() if k[0] not in gone}
        for (doc, version), (order, source, lang) in best.items():
            if doc in gone:
                continue
            self.live.pop((doc, version), None)
            if not order[0]:
                self.live[doc, version] = (source, lang, order[1])
        return self.rollup.commit(name, self.spark.createDataFrame(rows, SCHEMA))

    def check(self):
        want = {}
        for (_, version), (source, lang, n) in self.live.items():
            documents, tokens = want.get((source, lang, version), (0, 0))
            want[source, lang, version] = (documents + 1, tokens + n)
        got = {(r.source, r.lang, r.version): (r.documents, r.tokens) for r in self.rollup.totals().collect()}
        assert got == want


def test_inserts_revisions_deletes_and_replays(spark):
    state = State(spark)
    state.check()
    assert state.apply("1", [change("d1", n=5), change("d2", n=7, source=None), change("d3", n=0, lang=None), change("d1", n=4, version="v2")])
    state.check()
    assert not state.rollup.commit("1", spark.createDataFrame([change("d9")], SCHEMA))
    state.check()
    assert state.apply("2/odd name", [change("d1", "revise", 9), change("d2", "delete"), change("unknown", "delete"), change("d4", "revise", 3)])
    state.check()
    assert state.apply("3", [change("d1", "delete", version=None), change("d1", n=3), change("d3", n=0, lang=None), change("d3", n=2), change("d3", n=2)])
    state.check()
    assert state.apply("4", [change(None), change("d5", version=None), change("d5", "other"), change("d6", n=None)])
    state.check()
    assert state.apply("5", []) and state.rollup.batches() == ["1", "2%2Fodd%20name", "3", "4", "5"]
    state.check()


def test_random_batches(spark):
    rng, state = random.Random(1), State(spark)
    for i in range(4):
        kinds = ["insert", "insert", "revise", "delete"]
        rows = [change(f"d{rng.randrange(15)}", rng.choice(kinds), rng.randrange(9), rng.choice(["v1", "v2"]), rng.choice("ab")) for _ in range(20)]
        state.apply(str(i), rows + [change(f"d{rng.randrange(15)}", "delete", version=None)])
        state.check()


def test_failed_batch_leaves_nothing(spark):
    state = State(spark)
    state.apply("1", [change("d1", n=5)])
    broken = spark.createDataFrame([change("d2")], SCHEMA).selectExpr("doc", "source", "lang", "version", "cast(raise_error('lost') as long) as n_tokens", "kind")
    try:
        state.rollup.commit("2", broken)
    except Exception as error:  # noqa: BLE001
        assert "lost" in str(error)
    assert state.rollup.batches() == ["1"]
    state.check()


def test_counts(spark, docs):
    frame = docs([(1, None), (2, ""), (3, "One two\tthree\x0bÉté, 4!"), (4, "x " * 50_000)])
    rows = frame.select("doc_id", rollups.counted(frame.text, "runs-1"), rollups.counted(frame.text, "words-2")).collect()
    assert sorted(map(tuple, rows)) == [(1, 0, 0), (2, 0, 0), (3, 5, 5), (4, 50_000, 50_000)]
