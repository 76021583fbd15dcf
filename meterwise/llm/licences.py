"""Licence scans: known licence sentences become identifiers, and ordered rules match the identifiers' sequence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sentences of licence notices, as their licences or the customary headers word them.
SENTENCES = {
    "apache-under": "Licensed under the Apache License, Version 2.0",
    "apache-under-long": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License',
    "apache-copy": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "apache-as-is": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied',
    "apache-see": "See the License for the specific language governing permissions and limitations under the License",
    "mit-released": "Released under the MIT License",
    "mit-title": "The MIT License",
    "mit-short": "MIT License",
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
    "mit-as-is": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT',
    "gpl3-work": "This work is licensed under the GNU General Public License, version 3",
    "gpl-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE",
    "gpl-see": "See the GNU General Public License for more details",
    "bsd-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-endorse": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "cc-by-nc": "Licensed under CC BY-NC 4.0",
    "cc-by": "Licensed under CC BY 4.0",
    "cc-by-work": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-sa": "Licensed under CC BY-SA 4.0",
    "cc-by-sa-work": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "cc-by-nc-work": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    "cc-by-nc-sa-work": "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License",
    "cc-by-nd-work": "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License",
    "cc0-waived": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
    "mpl-form": "This Source Code Form is subject to the terms of the Mozilla Public License, v",
    "mpl-copy": "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/",
    "lgpl21-free": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version",
    "lgpl3-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "lgpl-see": "See the GNU Lesser General Public License for more details",
    "agpl3-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
    "agpl-see": "See the GNU Affero General Public License for more details",
    "gpl2-free": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "unlicense": "This is free and unencumbered software released into the public domain",
    "boost-line": "Distributed under the Boost Software License, Version 1.0",
    "epl2-terms": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at http://www.eclipse.org/legal/epl-2.0",
    "zlib-as-is": "This software is provided 'as-is', without any express or implied warranty",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "isc-line": "Released under the ISC License",
    "bsd-line": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file",
    "all-rights": "All rights reserved",
}
#: Identifiers that a line "SPDX-License-Identifier: ..." may have.
SPDX = (
    "Apache-2.0", "MIT", "BSD-2-Clause", "BSD-3-Clause", "ISC", "MPL-2.0", "EPL-2.0", "Unlicense", "BSL-1.0", "Zlib", "CC0-1.0", "CC-BY-4.0",
    "CC-BY-SA-4.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-or-later",
    "AGPL-3.0-only", "AGPL-3.0-or-later",
)
SENTENCES |= {f"spdx-{name.lower()}": f"SPDX-License-Identifier: {name}" for name in SPDX}

#: Rules in order, the more telling first: name, licence, and the sentences that must follow one another among the known
#: sentences of a text, "*" standing for any number of others.
RULES = [
    *((f"spdx-{name.lower()}-line", name, [f"spdx-{name.lower()}"]) for name in SPDX),
    ("apache-header", "Apache-2.0", ["apache-under-long", "apache-copy", "apache-as-is", "apache-see"]),
    ("mit-text", "MIT", ["mit-grant", "mit-notice", "mit-as-is"]),
    ("gpl3-header", "GPL-3.0-or-later", ["gpl-free", "gpl-hope", "gpl-see"]),
    ("bsd3-text", "BSD-3-Clause", ["bsd-redistribution", "*", "bsd-endorse"]),
    ("bsd2-text", "BSD-2-Clause", ["bsd-redistribution"]),
    ("apache-part", "Apache-2.0", ["apache-under-long"]),
    ("apache-line", "Apache-2.0", ["apache-under"]),
    ("mit-part", "MIT", ["mit-grant"]),
    ("mit-line", "MIT", ["mit-released"]),
    ("mit-name", "MIT", ["mit-title"]),
    ("mit-heading", "MIT", ["mit-short"]),
    ("gpl3-part", "GPL-3.0-or-later", ["gpl-free"]),
    ("gpl3-line", "GPL-3.0", ["gpl3-work"]),
    ("gpl2-header", "GPL-2.0-or-later", ["gpl2-free", "gpl-hope", "gpl-see"]),
    ("gpl2-part", "GPL-2.0-or-later", ["gpl2-free"]),
    ("lgpl21-part", "LGPL-2.1-or-later", ["lgpl21-free"]),
    ("lgpl3-part", "LGPL-3.0-or-later", ["lgpl3-free"]),
    ("agpl3-part", "AGPL-3.0-or-later", ["agpl3-free"]),
    ("mpl2-header", "MPL-2.0", ["mpl-form", "*", "mpl-copy"]),
    ("mpl2-part", "MPL-2.0", ["mpl-form"]),
    ("isc-text", "ISC", ["isc-grant"]),
    ("isc-line", "ISC", ["isc-line"]),
    ("unlicense-text", "Unlicense", ["unlicense"]),
    ("boost-line", "BSL-1.0", ["boost-line"]),
    ("epl2-terms", "EPL-2.0", ["epl2-terms"]),
    ("zlib-text", "Zlib", ["zlib-as-is", "*", "zlib-grant"]),
    ("cc0-line", "CC0-1.0", ["cc0-waived"]),
    ("cc-by-nc-line", "CC-BY-NC-4.0", ["cc-by-nc"]),
    ("cc-by-nc-sa-work", "CC-BY-NC-SA-4.0", ["cc-by-nc-sa-work"]),
    ("cc-by-nc-work", "CC-BY-NC-4.0", ["cc-by-nc-work"]),
    ("cc-by-nd-work", "CC-BY-ND-4.0", ["cc-by-nd-work"]),
    ("cc-by-sa-line", "CC-BY-SA-4.0", ["cc-by-sa"]),
    ("cc-by-sa-work", "CC-BY-SA-4.0", ["cc-by-sa-work"]),
    ("cc-by-line", "CC-BY-4.0", ["cc-by"]),
    ("cc-by-work", "CC-BY-4.0", ["cc-by-work"]),
    ("bsd-line", "BSD-3-Clause", ["bsd-line"]),
    ("rights-reserved", "Proprietary", ["all-rights"]),
]


def normal(sentence: str) -> str:
    """Lower case, every run of anything but a-z and 0-9 one blank; the same as the column form below."""
    low = sentence.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    return " ".join("".join(c if c in "abcdefghijklmnopqrstuvwxyz0123456789" else " " for c in low).split())


def lines(text: Column) -> Column:
    """A text's lines, normalised, each behind a line break. Line breaks are two after . ! ? before white space, and as many as
    there are where lines have no letters a-z or digits. Comment marks go with the punctuation; REM and dnl go too."""
    low = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    cut = F.regexp_replace(low, r"[.!?][ \t\r\n]+", "\n\n")
    clean = F.regexp_replace(cut, r"[^a-z0-9\r\n]+", " ")
    return F.regexp_replace(clean, r"(?:^ ?| ?(?:\r\n?|\n) ?)(?:(?:dnl|rem)\b ?)?", "\n")


def longest_first(sentences: dict[str, str]) -> list[str]:
    return sorted(sentences, key=lambda s: (-len(s), s))


def known_sentences(text: Column, known: dict[str, str] | None = None) -> Column:
    """Identifiers of the known sentences of a text, in order. Null and empty texts have none.

    A sentence begins where a line does or after . ! ? before white space, and ends where a line does or before such a mark, so
    it may be wrapped over lines in any way and needs no blank line or full stop around it. It does not reach over a full
    stop or a blank line, but for one before an address, which the Apache header sets off. Where two begin at the same
    place the longer counts, and what belongs to a found sentence is not read again.
    """
    by_text = {normal(s): name for name, s in (known or SENTENCES).items()}
    wrapped = [s.replace(" http ", " (?:\n)?http ").replace(" ", r"[ \n]") for s in longest_first(by_text)]
    table = F.create_map(*[F.lit(x) for pair in by_text.items() for x in pair])
    pattern = r"(?<=\n)(?:" + "|".join(wrapped) + r")(?=\n| ?\z)"
    found = F.regexp_extract_all(lines(F.coalesce(text.cast("string"), F.lit(""))), F.lit(pattern), F.lit(0))
    return F.transform(found, lambda s: F.element_at(table, F.regexp_replace(s, r"\n+", " ")))


def _pattern(sequence: list[str]) -> str:
    return "%" + "".join("%" if name == "*" else f"<{name}>" for name in sequence) + "%"


def scan(docs: DataFrame, id: str = "doc_id", text: str = "text", known: dict[str, str] | None = None, rules: list[tuple[str, str, list[str]]] | None = None) -> DataFrame:
    """Per row: ``id``, ``sentence_ids`` (in order, as text), ``n_sentences``, ``rule`` (first that matches, or null), ``licence``
    (of that rule) and ``licences`` (all whose rules match, in the order of the rules, each once).

    Sentences and rules are literals of the plan, and a text is one row from beginning to end: there is no shuffle, no join and
    no Python, and long texts and hot sources do not matter. Null and empty texts match nothing; repeated rows each give
    a row.
    """
    rules = RULES if rules is None else rules
    ids = F.array_join(F.transform("__found", lambda s: F.concat(F.lit("<"), s, F.lit(">"))), "")
    found = docs.select(F.col(id), known_sentences(F.col(text), known).alias("__found")).withColumn("sentence_ids", ids)
    hits = [F.when(F.col("sentence_ids").like(_pattern(sequence)), F.struct(F.lit(name).alias("rule"), F.lit(licence).alias("licence"))) for name, licence, sequence in rules]
    matched = F.filter(F.array(*hits), lambda r: r.isNotNull())
    return (
        found.withColumn("__rules", F.when(F.col("sentence_ids") == "", F.array().cast("array<struct<rule:string,licence:string>>")).otherwise(matched))
        .select(
            id,
            "sentence_ids",
            F.size("__found").cast("long").alias("n_sentences"),
            F.get("__rules", F.lit(0))["rule"].alias("rule"),
            F.get("__rules", F.lit(0))["licence"].alias("licence"),
            F.array_join(F.array_distinct(F.transform("__rules", lambda r: r["licence"])), ",").alias("licences"),
        )
    )
