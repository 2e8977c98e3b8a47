"""Licence scan by canonical digest lookup (operator 5)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from judgelake.llm.common import table

#: Equivalent spellings, replaced in this order in lower-case text.
SPELLINGS = (("licence", "license"), ("copyleft license", "copyleft"), ("&", " and "), ("non-commercial", "noncommercial"),
             ("sub-license", "sublicense"), ("http://", "https://"), ("v.", "version "), ("merchantibility", "merchantability"))
#: A line that only states a copyright is left out of whole texts.
COPYRIGHT_LINE = r"^[^a-z0-9]*(copyright|\(c\)|©|all rights reserved)"
#: Sentences end at these marks followed by blanks.
SENTENCE_END = r"[.!?] +"

#: Texts and notices of known licences. A parameter of the operator.
KNOWN_LICENSES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", """MIT License

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the
Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR
OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN
ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF
THIS SOFTWARE."""),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Released under the Apache License, Version 2.0."),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an
"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific
language governing permissions and limitations under the License."""),
    ("BSD-2-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted
provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL,
SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES;
LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN
CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS
SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "Licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0."),
)


def canonical(text):
    """Lower case, equivalent spellings made one, and every run of other characters than a-z and 0-9 one blank."""
    out = F.lower(text)
    for a, b in SPELLINGS:
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(out, "[^a-z0-9]+", " "))


def without_copyright(text):
    lines = F.filter(F.split(text, "\n", -1), lambda x: ~F.lower(x).rlike(COPYRIGHT_LINE))
    return F.array_join(lines, "\n")


def license_scan(docs: DataFrame, known=KNOWN_LICENSES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, scope, license, n): units of every whole text whose canonical digest is that of a known licence.

    Units are the entire text without its copyright lines (scope text), each of its
    lines (line), and the sentences of lines that have several (sentence). n counts
    the units of the document. Defined cases: null and blank units match nothing;
    repeated rows add up; rows of a null id are counted under null; a digest known
    under several names gives a row for each; empty tables give no rows.
    """
    spark = docs.sparkSession
    known_df = (spark.createDataFrame(list(known), "license string, t string")
                .select("license", F.sha2(canonical(without_copyright(F.col("t"))), 256).alias("digest")).distinct())
    text = F.col(f"`{text_col}`").cast("string")
    # one pass: each line is made canonical once, for itself and for the whole text (no spelling reaches over a line's end)
    lines = F.transform(F.split(text, "\n", -1), lambda x: F.struct(
        F.lower(x).rlike(COPYRIGHT_LINE).alias("claim"), canonical(x).alias("c"), F.split(x, SENTENCE_END, -1).alias("s")))

    def unit(scope, c):
        return F.struct(F.lit(scope).alias("scope"), c.alias("c"))
    whole = lambda ls: F.array_join(F.transform(F.filter(ls, lambda x: ~x["claim"] & (x["c"] != "")), lambda x: x["c"]), " ")
    units = lambda ls: F.filter(F.concat(
        F.array(unit("text", whole(ls))), F.transform(ls, lambda x: unit("line", x["c"])),
        F.flatten(F.transform(F.filter(ls, lambda x: F.size(x["s"]) > 1),
                              lambda x: F.transform(x["s"], lambda y: unit("sentence", canonical(y)))))), lambda u: u["c"] != "")
    found = F.element_at(F.transform(F.array(lines), units), 1)  # the lines once, however often the units name them
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.explode(found).alias("u"))
    digests = rows.select("doc_id", "u.scope", F.sha2("u.c", 256).alias("digest"))
    # the known digests are a parameter of fixed size: they meet the units before any exchange
    return (digests.join(F.broadcast(known_df), "digest").groupBy("doc_id", "scope", "license")
            .agg(F.count("*").alias("n")))


def op5_licenses(spark, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def _canonical_sql(x: str) -> str:
    out = f"lower({x})"
    for a, b in SPELLINGS:
        out = f"replace({out}, '{a}', '{b}')"
    return f"trim(regexp_replace({out}, '[^a-z0-9]+', ' ', 'g'))"


def _without_copyright_sql(x: str) -> str:
    return (f"array_to_string(list_filter(string_split({x}, chr(10)), "
            f"lambda y: NOT regexp_matches(lower(y), '{COPYRIGHT_LINE}')), chr(10))")


def oracle() -> str:
    values = ", ".join("('{}', '{}')".format(a, b.replace("'", "''")) for a, b in KNOWN_LICENSES)
    return f"""
WITH known AS (SELECT DISTINCT l AS license, sha256({_canonical_sql(_without_copyright_sql('t'))}) AS digest
               FROM (VALUES {values}) v(l, t)),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS u FROM documents),
sentences AS (SELECT doc_id, unnest(s) AS u FROM (SELECT doc_id, string_split_regex(u, '{SENTENCE_END}') AS s FROM lines)
              WHERE len(s) > 1),
units AS (SELECT doc_id, 'text' AS scope, {_without_copyright_sql('text')} AS u FROM documents
          UNION ALL SELECT doc_id, 'line', u FROM lines UNION ALL SELECT doc_id, 'sentence', u FROM sentences),
canon AS (SELECT doc_id, scope, {_canonical_sql('u')} AS c FROM units)
SELECT doc_id, scope, license, count(*) AS n FROM canon JOIN known ON sha256(c) = digest
WHERE c <> '' GROUP BY doc_id, scope, license"""
