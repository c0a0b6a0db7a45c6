"""License scan by canonical digest lookup (operator 7, native).

Whole texts are brought to a canonical form (lower case, copyright lines out,
punctuation and white space to single spaces, equivalent spellings to one) and
their digests hash-joined to those of known licences in the same form. ``digest``
is that of this form; a licence is also found by the digest of a wider form that
leaves out notices without a year and lines of rights reserved too. ``notices``
finds known licences and notices inside longer texts.

Nulls, ties and clashes: a null or blank text has a null digest and no licence;
two licences with one canonical form give the first id in order; repeated rows
come back each; null doc_ids are ordinary; extra columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.license_texts import MORE_LICENSES

# Public licence texts and notices, and spellings that licence matching holds equal.
LICENSES = {
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "MIT-line": "Released under the MIT License.",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
    "MIT": "MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
}
SPELLINGS = (("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("sublicence", "sublicense"), ("acknowledgement", "acknowledgment"), ("organisation", "organization"), ("merchantibility", "merchantability"), ("judgement", "judgment"), ("https", "http"), ("noncommercial", "non commercial"))
#: A notice has a year; a line of a licence that only begins with the word stays.
COPYRIGHT_LINE = r"(?md)^[^\p{L}\p{N}\n(]*(?:copyright|©|\(c\))[ \t]*(?:\(c\)|©)?[ \t]*[0-9]{4}[^\n]*$"
#: The wider rule: any notice with the word or the sign, but not a wrapped licence line (told by what follows the word)
#: nor a list item (c), which counts with a year next to it or at the line's end; and lines of rights reserved alone.
NOTICE_LINE = (
    r"(?md)^[^\p{L}\p{N}\n(]*(?:copyright(?![\p{L}\p{N}])(?![ \t\r]*$)(?![ \t]*[,;/])"
    r"(?![ \t]+(?:holders?|notices?|laws?|owners?|owned|and|or|licen[cs]es?|licen[cs]ed|statements?|disclaimers?|permissions?|interests?|protection|treaty|treaties|acts?|rights?|is|are|in|of|on|to|for|as|that|which|may|shall|will|does|under|with|infringements?)(?![\p{L}\p{N}]))"
    r"[^\n]*|©[^\n]*|\(c\)[ \t]*(?:©[ \t]*|copyright[ \t]*)?[0-9]{4}[^\n]*|\(c\)[^\n]*[^\p{L}\p{N}\n][0-9]{4}[^\p{L}\p{N}\n]*|all rights reserved[^\p{L}\p{N}\n]*)$"
)
NOT_WORD = r"[^\p{L}\p{N}]+"


def _words(t: Column) -> Column:
    t = F.concat(F.lit(" "), F.trim(F.regexp_replace(t, NOT_WORD, " ")), F.lit(" "))
    for a, b in SPELLINGS:
        # twice, as neighbours share a space
        for _ in range(2):
            t = F.replace(t, F.lit(f" {a} "), F.lit(f" {b} "))
    return F.trim(t)


def canonical(text: Column) -> Column:
    return _words(F.regexp_replace(F.lower(text), COPYRIGHT_LINE, " "))


def wider(text: Column) -> Column:
    return _words(F.regexp_replace(F.lower(text), NOTICE_LINE, " "))


def known_digests(spark) -> DataFrame:
    rows = spark.createDataFrame(sorted((LICENSES | MORE_LICENSES).items()), "license_id string, body string")
    forms = F.explode(F.array_distinct(F.array(canonical(F.col("body")), wider(F.col("body")))))
    return rows.select("license_id", forms.alias("form")).groupBy(F.sha2("form", 256).alias("known_digest")).agg(F.min("license_id").alias("license_id"))


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, license_id) of every document; the broadcast side is the table of known licences, fixed above."""
    of = lambda form: F.sha2(F.nullif(form, F.lit("")), 256)
    d = docs.select("doc_id", of(canonical(F.col("text"))).alias("digest"), of(wider(F.col("text"))).alias("wider_digest"))
    known = known_digests(docs.sparkSession)
    first = F.broadcast(known.toDF("digest_1", "license_1"))
    second = F.broadcast(known.toDF("digest_2", "license_2"))
    found = d.join(first, F.col("digest") == F.col("digest_1"), "left").join(second, F.col("wider_digest") == F.col("digest_2"), "left")
    return found.select("doc_id", "digest", F.coalesce("license_1", "license_2").alias("license_id"))


def notices(docs: DataFrame) -> DataFrame:
    """(doc_id, license_id) for each known licence or notice that stands anywhere in a document, in whole words.

    Longer ones go first and are taken out, so the first words of one don't count as another. Lines of copyright are
    read both ways: left out, as they may stand inside a licence, and kept, as they may hold a notice.
    """
    rows = docs.sparkSession.createDataFrame(sorted((LICENSES | MORE_LICENSES).items()), "license_id string, body string")
    known = rows.select("license_id", F.explode(F.array_distinct(F.array(wider(F.col("body")), _words(F.lower("body"))))).alias("form")).collect()
    known.sort(key=lambda r: (-len(r["form"]), r["license_id"]))
    table = F.array(*[F.struct(F.lit(r["license_id"]).alias("id"), F.lit(f" {r['form']} ").alias("form")) for r in known])
    both = F.concat(F.lit(" "), wider(F.col("text")), F.lit(" | "), _words(F.lower("text")), F.lit(" "))
    start = F.struct(both.alias("rest"), F.array().cast("array<string>").alias("ids"))
    out = F.lit(" | ")

    def take(a: Column, k: Column) -> Column:
        # twice, as neighbours share a space
        rest = F.replace(F.replace(a["rest"], k["form"], out), k["form"], out)
        return F.when(F.contains(a["rest"], k["form"]), F.struct(rest.alias("rest"), F.array_append(a["ids"], k["id"]).alias("ids"))).otherwise(a)

    ids = F.aggregate(table, start, take, lambda a: F.array_distinct(a["ids"]))
    # the outer form, as else the optimiser evaluates the array again to filter by its size
    return docs.where("text IS NOT NULL").select("doc_id", F.explode_outer(ids).alias("license_id")).where("license_id IS NOT NULL")


def oracle() -> str:
    """The same in DuckDB, line by line and word by word: its regular expressions know no look-ahead."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    solid, off = r"[\p{L}\p{N}]", r"^[^\p{L}\p{N}\n(]*"
    words = "holder|holders|notice|notices|law|laws|owner|owners|owned|and|or|license|licence|licenses|licences|licensed|licenced|statement|statements|disclaimer|disclaimers|permission|permissions|interest|interests|protection|treaty|treaties|act|acts|right|rights|is|are|in|of|on|to|for|as|that|which|may|shall|will|does|under|with|infringement|infringements"
    m = lambda p: f"regexp_matches(x, '{p}')"
    rest = "substr(x, strpos(x, 'copyright') + 9)"
    r = lambda p: f"regexp_matches({rest}, '{p}')"
    named = f"({m(off + 'copyright')} AND NOT {r('^' + solid)} AND NOT {r(r'^[ \t\r]*$')} AND NOT {r(r'^[ \t]*[,;/]')} AND NOT {r(r'^[ \t]+(' + words + r')([^\p{L}\p{N}]|$)')})"
    listed = rf"\(c\)[ \t]*(©[ \t]*|copyright[ \t]*)?[0-9]{{4}}"
    ends = rf"\(c\).*[^\p{{L}}\p{{N}}\n][0-9]{{4}}[^\p{{L}}\p{{N}}\n]*$"
    wide = f"({named} OR {m(off + '(©|' + listed + '|' + ends + r'|all rights reserved[^\p{L}\p{N}\n]*$)')})"
    narrow = m(off + r"(copyright|©|\(c\))[ \t]*(\(c\)|©)?[ \t]*[0-9]{4}")
    table = "MAP {" + ", ".join(f"{quoted(a)}: {quoted(b)}" for a, b in SPELLINGS) + "}"

    def form(text: str, line: str) -> str:
        kept = f"array_to_string(list_filter(string_split(lower({text}), chr(10)), lambda x: NOT {line}), ' ')"
        split = rf"list_filter(regexp_split_to_array({kept}, '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')"
        return f"array_to_string(list_transform({split}, lambda w: coalesce({table}[w], w)), ' ')"

    rows = ", ".join(f"({quoted(k)}, {quoted(v)})" for k, v in sorted((LICENSES | MORE_LICENSES).items()))
    both = lambda text: f"{form(text, narrow)} AS f1, {form(text, wide)} AS f2"
    return (
        f"WITH k AS (SELECT license_id, {both('body')} FROM (VALUES {rows}) t(license_id, body)), "
        "known AS (SELECT f, min(license_id) AS license_id FROM (SELECT license_id, f1 AS f FROM k UNION ALL SELECT license_id, f2 FROM k) GROUP BY 1), "
        f"d AS (SELECT doc_id, {both('text')} FROM documents) "
        "SELECT doc_id, CASE WHEN f1 <> '' THEN sha256(f1) END AS digest, coalesce(a.license_id, b.license_id) AS license_id "
        "FROM d LEFT JOIN known a ON f1 = a.f LEFT JOIN known b ON f2 = b.f"
    )
