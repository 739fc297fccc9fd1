"""License scans by canonical digest lookup.

A text is normalised: A-Z in lower case, copyright lines dropped (lines of prose that
happen to begin with the word are none), punctuation and white space folded to single spaces, equivalent spellings made one. The digest of the whole
normal text is then hash-joined with the digests of known licences, which are as few as
the table below; the same lookup is made for lines that hold one of a few pieces, which are
taken from the known normal forms so that no line that can match lacks them all. All of
it is one pass of built-in functions without a shuffle.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (pattern, replacement), applied in this order; they mean the same to Java and RE2.
STEPS: tuple[tuple[str, str], ...] = (
    # copyright lines: a sign, a year, or a blank to fill in stands behind the word, so prose that wraps there stays
    (
        r"(^|\n)[ \t#*/;>-]*(copyright[ \t:,]*(\(c\)|©|[0-9]{4}|[<\[{]|by )|\(c\)[ \t]*([0-9]{4}|copyright)|©|all rights reserved)[^\n]*",
        r"\n",
    ),
    # punctuation, symbols, white space
    ("[\\x00-\\x2f\\x3a-\\x60\\x7b-\\x7f «»‐-‧‰-⁞]+", " "),
)

#: Spellings that count as one, where a word of the normal text begins.
SPELLINGS: tuple[tuple[str, str], ...] = (
    ("(^| |sub)licence", "$1license"),
    ("(^| )sub license", "$1sublicense"),
    ("(^| )non commercial", "$1noncommercial"),
    ("(^| )copyright owner", "$1copyright holder"),
    ("(^| )organisation", "$1organization"),
    ("(^| )source and binary forms? with or without modifications?", "$1source and binary forms with or without modification"),
    ("(^| )per cent", "$1percent"),
    ("(^| )whilst", "$1while"),
    ("(^| )v(ersion|er)? ?([0-9])", "$1version $3"),
    ("(^| )https", "$1http"),
)

_AS_IS = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT '
    "LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO "
    "EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN "
    "AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE "
    "OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC_AS_IS = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE '
    "INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR "
    "ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF "
    "USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF "
    "OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_BSD_START = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
    "the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, "
    "this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the "
    "above copyright notice, this list of conditions and the following disclaimer in the documentation and/or "
    "other materials provided with the distribution. "
)
_BSD_END = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED '
    "WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A "
    "PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY "
    "DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
    "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER "
    "CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE "
    "OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH "
    "DAMAGE."
)
_GRANT = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
    "hereby granted"
)

#: SPDX identifiers and the texts they stand for.
TEXTS: tuple[tuple[str, str], ...] = (
    ("MIT",
     'MIT License Permission is hereby granted, free of charge, to any person obtaining a copy of this software and '
     'associated documentation files (the "Software"), to deal in the Software without restriction, including '
     "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
     "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
     "following conditions: The above copyright notice and this permission notice shall be included in all copies "
     "or substantial portions of the Software. " + _AS_IS),
    ("BSD-2-Clause", _BSD_START + _BSD_END),
    ("BSD-3-Clause",
     _BSD_START + "3. Neither the name of the copyright holder nor the names of its contributors may be used to "
     "endorse or promote products derived from this software without specific prior written permission. " + _BSD_END),
    ("ISC",
     _GRANT + ", provided that the above copyright notice and this permission notice appear in all copies. "
     + _ISC_AS_IS),
    ("0BSD", _GRANT + ". " + _ISC_AS_IS),
    ("Zlib",
     "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be "
     "held liable for any damages arising from the use of this software. Permission is granted to anyone to use "
     "this software for any purpose, including commercial applications, and to alter it and redistribute it "
     "freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; "
     "you must not claim that you wrote the original software. If you use this software in a product, an "
     "acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source "
     "versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. "
     "This notice may not be removed or altered from any source distribution."),
)

#: One-line notices. Each has "licen" or "public domain" in its normal form.
NOTICES: tuple[tuple[str, str], ...] = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License");'),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "Licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-only", "SPDX-License-Identifier: GPL-3.0-only"),
    ("GPL-2.0-only", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0-only", "SPDX-License-Identifier: GPL-2.0-only"),
    ("LGPL-3.0-only", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, version 2.0."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC0-1.0", "This work is dedicated to the public domain."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)

KNOWN = TEXTS + NOTICES

#: Titles under which the texts above are usual, besides none.
TITLES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("MIT", ("MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)")),
    ("BSD-2-Clause", ("BSD 2-Clause License", "The BSD 2-Clause License", 'BSD 2-Clause "Simplified" License', "Simplified BSD License")),
    ("BSD-3-Clause", ("BSD 3-Clause License", "The BSD 3-Clause License", 'BSD 3-Clause "New" or "Revised" License', "New BSD License")),
    ("ISC", ("ISC License", "The ISC License", "ISC License (ISC)")),
    ("0BSD", ("BSD Zero Clause License", "Zero-Clause BSD", "Zero-Clause BSD License")),
    ("Zlib", ("zlib License", "The zlib License", "zlib/libpng License")),
)

#: Where the texts of the longer licences end when they come without their appendix.
_APPENDICES = ("APPENDIX: How to apply", "How to Apply These Terms", "Exhibit A - Source Code Form License Notice")


def usual_forms() -> tuple[tuple[str, str], ...]:
    """The texts with and without titles, list numbers and appendices; the longer ones lie in licenses/."""
    out = []
    for license_id, titles in TITLES:
        body = dict(TEXTS)[license_id].removeprefix("MIT License ")
        bodies = [body]
        if license_id.startswith("BSD"):
            bodies.append(body.replace("met: 1. ", "met: ").replace(" 2. ", " ").replace(" 3. ", " "))
        if license_id == "ISC":
            bodies.append(body.replace("and/or distribute", "and distribute"))
        out += [(license_id, f"{title} {text}") for text in bodies for title in ("", *titles)]
    for path in sorted((Path(__file__).parent / "licenses").glob("*.txt")):
        text = path.read_text("utf-8")
        ends = [at for x in _APPENDICES if (at := text.rfind(x)) > 0]
        out += [(path.stem, text[:end]) for end in (len(text), *ends)]
    return tuple(out)


#: What every text holds in which one of the spellings applies: one look instead of ten.
_ANY_SPELLING = "licence|sub licen|non commercial|copyright owner|organisation|binary form|per cent|whilst|v(ersion|er)? ?[0-9]|https"


def _folded(text: Column) -> Column:
    """Lower case, without copyright lines and punctuation; null stays null."""
    out = F.translate(text, _UPPER, _LOWER)
    for pattern, to in STEPS:
        out = F.regexp_replace(out, pattern, to.replace(r"\n", "\n"))
    return out


def _one_spelling(folded: Column) -> Column:
    out = folded
    for pattern, to in SPELLINGS:
        out = F.regexp_replace(out, pattern, to)
    return F.trim(F.when(folded.rlike(_ANY_SPELLING), out).otherwise(folded))


def normal_text(text: Column) -> Column:
    """The normal form of a text; null stays null."""
    return _one_spelling(_folded(text))


def anchors(normal_forms: Iterable[str]) -> tuple[str, ...] | None:
    """A few pieces of which every text with one of these normal forms holds one in lower case.

    A word of a normal form stands in the text as it is, but for those that a spelling may have
    made; of "license" and what it is part of, all spellings hold "licen". None where a form
    has no such word.
    """
    made = {w for _, to in SPELLINGS for w in re.sub(r"[$][0-9]", " ", to).split()}
    open_ = [{"licen" if "licens" in w else w for w in form.split() if "licens" in w or not any(m in w for m in made)} for form in normal_forms]
    chosen: list[str] = []
    while open_:
        count = Counter(w for words in open_ for w in words)
        if not all(open_):
            return None
        best = min(count, key=lambda w: (-count[w], -len(w), w))
        chosen.append(best)
        open_ = [words for words in open_ if best not in words]
    return tuple(chosen)


def _spelled(text: Column, pieces: tuple[str, ...] | None = ("licen", "public")) -> Column:
    """Whether a text holds one of the pieces in lower case; always true where pieces is None."""
    if pieces is None:
        return F.lit(True)
    low = F.translate(text, _UPPER, _LOWER)
    found = F.lit(False)
    for piece in pieces:
        found = found | low.contains(piece)
    return found


def known_digests(spark, known: tuple[tuple[str, str], ...] = KNOWN) -> DataFrame:
    """license_id and digest of the normal form, one row for each digest."""
    rows = spark.createDataFrame(list(known), "license_id string, text string")
    forms = rows.select("license_id", normal_text(F.col("text")).alias("form"))
    return forms.groupBy(F.md5("form").alias("digest")).agg(F.min("license_id").alias("license_id"), F.min("form").alias("form"))


def scan_licenses(documents: DataFrame, known: tuple[tuple[str, str], ...] | None = None) -> DataFrame:
    """Per row: doc_id, license_id (of the whole text, else null), digest, notices
    (licence ids of its lines, sorted, comma-joined), n_notices (such lines).

    Null texts have a null digest and no licence; texts without a word outside their
    copyright lines match nothing. Repeated rows get equal results; other columns are
    not looked at; an empty table gives no rows. The known texts are a fixed table (KNOWN
    and its usual forms where none is given), so their digests are broadcast.
    """
    spark = documents.sparkSession
    rows = known_digests(spark, KNOWN + usual_forms() if known is None else known).collect()  # as many as there are known texts
    pieces = anchors(r["form"] for r in rows)
    table = spark.createDataFrame([(r["digest"], r["license_id"]) for r in rows], "_known string, license_id string")
    entries = [F.struct(F.lit(r["digest"]), F.lit(r["license_id"])) for r in rows]
    lookup = F.map_from_entries(F.array(*entries)) if entries else F.create_map().cast("map<string,string>")
    lines = F.filter(F.split("text", "\n"), lambda x: _spelled(x, pieces))
    folds = F.transform(lines, _folded)  # on its own, so that no line is folded more than once
    found = F.filter(F.transform(folds, lambda x: F.try_element_at(lookup, F.md5(_one_spelling(x)))), lambda x: x.isNotNull())
    folded = documents.select("doc_id", _folded(F.col("text")).alias("_folded"), F.when(_spelled(F.col("text"), pieces), found).alias("_found"))
    digests = folded.select("doc_id", F.md5(_one_spelling(F.col("_folded"))).alias("digest"), "_found")
    joined = digests.join(F.broadcast(table), digests["digest"] == table["_known"], "left")
    none = F.array().cast("array<string>")
    return joined.select(
        "doc_id",
        "license_id",
        "digest",
        F.array_join(F.array_sort(F.array_distinct(F.coalesce("_found", none))), ",").alias("notices"),
        F.size(F.coalesce("_found", none)).cast("long").alias("n_notices"),
    )


def _sql_string(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def normal_sql(text: str) -> str:
    """The same normal form as DuckDB SQL."""
    out = f"translate({text}, '{_UPPER}', '{_LOWER}')"
    for pattern, to in STEPS:
        to = "chr(10)" if to == r"\n" else _sql_string(to)
        out = f"regexp_replace({out}, {_sql_string(pattern)}, {to}, 'g')"
    for pattern, to in SPELLINGS:
        out = f"regexp_replace({out}, {_sql_string(pattern)}, {_sql_string(to.replace('$', chr(92)))}, 'g')"
    return f"trim({out}, ' ')"


def oracle_sql(known: tuple[tuple[str, str], ...] = KNOWN) -> str:
    values = ", ".join(f"({_sql_string(a)}, {_sql_string(b)})" for a, b in known)
    return f"""
with known as (
  select min(license_id) as license_id, digest from (
    select license_id, md5({normal_sql('text')}) as digest from (values {values}) as k(license_id, text)
  ) group by digest
), lines as (
  select doc_id, unnest(string_split(text, chr(10))) as line from documents
), noticed as (
  select s.doc_id, k.license_id from (select doc_id, md5({normal_sql('line')}) as digest from lines) s
  join known k on s.digest = k.digest
), notices as (
  select doc_id, string_agg(distinct license_id, ',' order by license_id) as notices, count(*)::bigint as n_notices
  from noticed group by doc_id
)
select d.doc_id, k.license_id, d.digest, coalesce(n.notices, '') as notices, coalesce(n.n_notices, 0)::bigint as n_notices
from (select doc_id, md5({normal_sql('text')}) as digest from documents) d
left join known k on d.digest = k.digest left join notices n on d.doc_id = n.doc_id
"""
