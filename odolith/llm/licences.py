"""Licence scan by canonical digest lookup.

A text is brought to a canonical form: lower case, lines that state a copyright dropped, equivalent spellings made one,
punctuation and white space reduced to single spaces. Its SHA-256 is joined with the digests of known licences. Whole
texts are looked up, and so is each line that speaks of a licence, which finds one-line notices inside other text. If
one of the known notices does not speak of a licence, all lines are looked up.

Known are the full texts of MIT, ISC, BSD-2-Clause and BSD-3-Clause, each alone, under its usual titles and with or
without "All rights reserved.", and of Apache-2.0, GPL-2.0, GPL-3.0 and CC0-1.0, with or without what they append.

All work is column expressions. The table of known licences is a constant of this module (or an argument of the
operator), so it is small; texts are not shuffled, only digests of lines are.

Nulls and edges: a null or empty text, and one that is empty in canonical form, matches nothing; a null doc_id is
kept; repeated rows each get the same answer; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from odolith.llm.licence_texts import APACHE2, CC0, GPL2, GPL3

# Public licence texts and notices, by SPDX identifier.
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
BSD2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
BSD3 = BSD2.replace("\n\nTHIS SOFTWARE", "\n\n3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n\nTHIS SOFTWARE")
TITLES = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)"),
    "ISC": ("ISC License", "The ISC License", "ISC License (ISC)"),
    "BSD-2-Clause": ("BSD 2-Clause License", "The BSD 2-Clause License", "The 2-Clause BSD License", 'BSD 2-Clause "Simplified" License', "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "The BSD 3-Clause License", "The 3-Clause BSD License", 'BSD 3-Clause "New" or "Revised" License', "New BSD License", "Modified BSD License"),
}


def forms(name: str, body: str) -> list[tuple[str, str]]:
    """A short licence as it is distributed: under a title or none, with or without a line on rights, points numbered or not."""
    bodies = dict.fromkeys((body, re.sub(r"(?m)^[0-9]\. ", "* ", body)))
    return [(name, "\n\n".join(x for x in (title, rights, b) if x)) for b in bodies for title in ("", *TITLES[name]) for rights in ("", "All rights reserved.")]


def parts(name: str, text: str, end: str) -> list[tuple[str, str]]:
    """A long licence whole, and up to what is appended after `end`; its links with or without encryption."""
    found = (text, text[: text.index(end)], text[: text.index(end)] + end)
    return [(name, x) for t in found for x in dict.fromkeys((t, t.replace("https://", "http://")))]


FULL = (
    *forms("MIT", MIT), *forms("ISC", ISC), *forms("BSD-2-Clause", BSD2), *forms("BSD-3-Clause", BSD3), *parts("Apache-2.0", APACHE2, "END OF TERMS AND CONDITIONS"),
    # the year and owner that are filled in make a line on copyright
    ("Apache-2.0", APACHE2.replace("Copyright [yyyy] [name of copyright owner]", "")), *parts("GPL-2.0", GPL2, "END OF TERMS AND CONDITIONS"), *parts("GPL-3.0", GPL3, "END OF TERMS AND CONDITIONS"),
    ("CC0-1.0", CC0), ("CC0-1.0", CC0.split("\n", 1)[1]),
)
KNOWN = (
    ("MIT", MIT),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("ISC", ISC),
    ("ISC", "SPDX-License-Identifier: ISC"),
    ("BSD-2-Clause", BSD2),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
    *FULL,
)
SPEAKS = r"(?i)licen[cs]e|\bCC0\b|SPDX"
# Spellings held to be equivalent, the second being the canonical one.
EQUIVALENT = (
    ("licence", "license"), ("licenced", "licensed"), ("sub license", "sublicense"), ("acknowledgement", "acknowledgment"), ("merchantibility", "merchantability"), ("non infringement", "noninfringement"),
    ("organisation", "organization"), ("authorised", "authorized"), ("favour", "favor"), ("copyright owner", "copyright holder"), ("copyright owners", "copyright holders"), ("non commercial", "noncommercial"), ("per cent", "percent"),
)
COPYRIGHT_LINE = r"(?m)^[^\p{L}\p{N}\n©(]*(?:\(c\)|©|copyright\b[^\n]*(?:[0-9]{4}|\(c\)|©))[^\n]*$"


def canonical(text: Column) -> Column:
    out = F.regexp_replace(F.lower(text), COPYRIGHT_LINE, " ")
    out = F.concat(F.lit(" "), F.trim(F.regexp_replace(out, r"[^\p{L}\p{N}]+", " ")), F.lit(" "))
    for other, plain in EQUIVALENT:
        out = F.replace(out, F.lit(f" {other} "), F.lit(f" {plain} "))
    return F.trim(out)


def known_digests(spark, known: tuple[tuple[str, str], ...] = KNOWN) -> DataFrame:
    rows = spark.createDataFrame(known, "licence string, text string")
    return rows.select("licence", F.sha2(canonical(F.col("text")), 256).alias("digest")).distinct()


def scan(docs: DataFrame, known: tuple[tuple[str, str], ...] = KNOWN) -> DataFrame:
    """doc_id, licence (of the whole text, null if none) and notices (sorted, of its lines) of every row of docs (doc_id, text)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.split(text, "\n")
    if all("\n" in t.strip() or re.search(SPEAKS, t) for _, t in known):
        lines = F.filter(lines, lambda x: x.rlike(SPEAKS))
    rows = docs.select("doc_id", F.sha2(text, 256).alias("blob"), F.sha2(canonical(text), 256).alias("whole"), F.transform(lines, lambda x: F.sha2(canonical(x), 256)).alias("lines"))
    units = rows.select("blob", F.explode(F.concat(F.array(F.struct(F.col("whole").alias("digest"), F.lit(True).alias("is_whole"))), F.transform("lines", lambda x: F.struct(x.alias("digest"), F.lit(False).alias("is_whole"))))).alias("u")).select("blob", "u.*")
    empty = F.sha2(F.lit(""), 256)
    hits = units.filter(F.col("digest") != empty).join(F.broadcast(known_digests(docs.sparkSession, known)), "digest")
    found = hits.groupBy("blob").agg(F.min(F.when(F.col("is_whole"), F.col("licence"))).alias("licence"), F.array_join(F.array_sort(F.collect_set(F.when(~F.col("is_whole"), F.col("licence")))), ",").alias("notices"))
    return rows.select("doc_id", "blob").join(found, "blob", "left").select("doc_id", "licence", F.coalesce("notices", F.lit("")).alias("notices"))
