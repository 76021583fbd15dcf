"""Licence rules on small texts. The query itself is checked by its SQL."""

import duckdb
import pytest

from plain import docs  # noqa: F401

from meterwise.llm import licences, registry

S = licences.SENTENCES
TEXTS = {
    "": (0, None, ""),
    None: (0, None, ""),
    "Nothing to see. Move on.": (0, None, ""),
    f"Text before.\n{S['mit-released']}.\nText after.": (1, "mit-line", "MIT"),
    f"  {S['mit-released'].upper()}!!  ": (1, "mit-line", "MIT"),
    f"We were {S['mit-released']}.": (0, None, ""),
    f"{S['cc-by-nc']}. And: {S['apache-under']}.": (1, "cc-by-nc-line", "CC-BY-NC-4.0"),
    f"{S['cc-by-nc']}. {S['apache-under']}. {S['cc-by-nc']}.": (3, "apache-line", "Apache-2.0,CC-BY-NC-4.0"),
    ". ".join(S[k] for k in ("apache-under-long", "apache-copy", "apache-as-is", "apache-see")): (4, "apache-header", "Apache-2.0"),
    ". ".join(S[k] for k in ("apache-copy", "apache-under-long", "apache-as-is", "apache-see")): (4, "apache-part", "Apache-2.0"),
    f"{S['bsd-redistribution']}\n\n1. Keep the notice.\n{S['all-rights']}.\n{S['bsd-endorse']}.": (3, "bsd3-text", "BSD-3-Clause,BSD-2-Clause,Proprietary"),
    f"{S['bsd-endorse']}.\n{S['bsd-redistribution']}": (2, "bsd2-text", "BSD-2-Clause"),
    "filler words. " * 20_000 + S["gpl3-work"] + ".": (1, "gpl3-line", "GPL-3.0"),
}


@pytest.mark.parametrize("copies", [1, 2])
def test_rules(docs, copies):
    rows = [(i, text) for i, text in enumerate(TEXTS)] * copies
    got = licences.scan(docs(rows).withColumnRenamed("lang", "rule")).collect()
    assert len(got) == len(rows)
    for r in got:
        n, rule, found = list(TEXTS.values())[r.doc_id]
        assert (r.n_sentences, r.rule, r.licences) == (n, rule, found)


def test_no_documents_and_no_rule(docs):
    assert licences.scan(docs([])).count() == 0
    assert licences.scan(docs([(None, S["mit-short"])])).first().sentence_ids == "<mit-short>"


def test_known_sentences_are_distinct_and_rules_name_them():
    assert len({licences.normal(s) for s in S.values()}) == len(S)
    assert {name for _, _, sequence in licences.RULES for name in sequence} - {"*"} <= set(S)


APACHE = """Copyright 2020 Someone

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
"""
MIT = """MIT License

Copyright (c) 2020 Someone

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM.
"""
GPL = """    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
    GNU General Public License for more details.
"""
BSD = """Copyright (c) 2020, Someone. All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice.
2. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
WRAPPED = {
    APACHE: ("<apache-under-long><apache-copy><apache-as-is><apache-see>", "apache-header", "Apache-2.0"),
    MIT: ("<mit-short><mit-grant><mit-notice><mit-as-is>", "mit-text", "MIT"),
    GPL: ("<gpl-free><gpl-hope><gpl-see>", "gpl3-header", "GPL-3.0-or-later"),
    BSD: ("<all-rights><bsd-redistribution><bsd-endorse>", "bsd3-text", "BSD-3-Clause"),
}


@pytest.mark.parametrize("mark", ["", "# ", " * ", "// ", "REM ", "dnl "])
@pytest.mark.parametrize("end", ["\n", "\r\n", "\r"])
def test_wrapped_notices(docs, mark, end):
    rows = list(enumerate(end.join((mark + line).rstrip() for line in text.split("\n")) for text in WRAPPED))
    for r in licences.scan(docs(rows)).collect():
        assert (r.sentence_ids, r.rule, r.licence) == list(WRAPPED.values())[r.doc_id]


def test_lines_and_headings(docs):
    texts = {
        "MIT License\n\nCopyright (c) 2020 Someone. All rights reserved.": ("<mit-short><all-rights>", "mit-heading"),
        "Some package\nReleased under the MIT License\nSee its page": ("<mit-released>", "mit-line"),
        "Licensed under the Apache License, Version 2.0\nCopyright 2020 Someone": ("<apache-under>", "apache-line"),
        "Released under the\n\nMIT License": ("<mit-short>", "mit-heading"),
        "Released under the. MIT License": ("<mit-short>", "mit-heading"),
        "all rights\nreserved": ("<all-rights>", "rights-reserved"),
        "all rights reserved by us\nor all rights reserved": ("", None),
    }
    for r in licences.scan(docs(list(enumerate(texts)))).collect():
        assert (r.sentence_ids, r.rule) == list(texts.values())[r.doc_id]


def test_the_sql_finds_what_the_query_finds(spark, tmp_path):
    """Wrapped, indented, commented and broken notices, and every known sentence by itself and wrapped at each of its words."""
    texts = [*TEXTS, APACHE, "# " + APACHE.replace("\n", "\n# "), "/* " + APACHE.replace("\n", "\r\n * ") + "*/"]
    texts += ["MIT License\n\nCopyright (c) X\n\n" + S["mit-grant"].replace(" ", "\n", 9), "Released under the\n * MIT License", "dnl Released under\ndnl the MIT License\n"]
    texts += ["\nMIT License", "\n\n MIT License \n", "MIT\n\nLicense", "MIT License\nMIT License\nThe MIT License", "REM MIT License", "x\nRELEASED\r\nunder the MIT  License!"]
    for sentence in S.values():
        words = sentence.split(" ")
        texts += [f"{sentence}.", " ".join(words[: len(words) // 2]) + "\n// " + " ".join(words[len(words) // 2 :]), "\n".join(words), f"{sentence} indeed"]
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    query = registry.op9_licence_scan(spark, str(tmp_path))
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    result = connection.execute(registry.oracle_sql()["op9_licence_scan"])
    assert [d[0] for d in result.description] == query.columns
    got, expected = sorted(map(tuple, query.collect())), sorted(result.fetchall())
    for a, b in zip(got, expected, strict=True):
        assert a == b, texts[a[0]]
    assert sum(r[2] > 0 for r in got) > 3 * len(S)
    assert all(r.n_sentences == 1 for r in licences.scan(spark.createDataFrame([(i, s) for i, s in enumerate(S.values())], "doc_id long, text string")).collect())


def test_an_identifier_line(docs):
    rows = [(1, "# SPDX-License-Identifier: AGPL-3.0-only\nimport os"), (2, "// SPDX-License-Identifier: Apache-2.0")]
    assert {r.doc_id: r.licence for r in licences.scan(docs(rows)).collect()} == {1: "AGPL-3.0-only", 2: "Apache-2.0"}
