"""License scans: whole texts in canonical form are hash-joined to the digests of known licences.

Method. The canonical form is lower case, without copyright notices, with every run of other characters than
letters and digits as one space, and with one spelling where several are equivalent. The SHA-256 of the form
is looked up in a table of known licences, to which further texts can be given. DataFrame functions only.

Notices. A line is one if it begins with a mark (copyright, (c) or the sign) followed by a year, another mark or
'by', or holding 'all rights reserved', or if it is 'all rights reserved' alone. Other lines that begin with
copyright or the sign are left out where they stand between blank lines, as a holder's name does; a body line
that a wrap made to begin so stays.

Edge cases. Null texts count as empty; an empty form has a digest but matches no licence. Two known licences
with one form give the smaller id. Repeated rows are looked up one by one, extra columns stay out of the
result. An empty table on either side gives no matches; documents are never lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from latticework.session import attach

#: Short licence notices and texts as published.
KNOWN = [
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("MIT", "Released under the MIT License."),
    ("MIT", """MIT License

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("Zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""),
]

#: Lines left out, and spellings taken as equal, after lower-casing and spacing.
_BODY = r"(?![ \t]+(?:notices?|holders?|owners?|laws?|licen[cs]es?|statements?|and|or|is|in|may|shall|must)\b)"
_NAMED = rf"(?:copyright\b{_BODY}|©)"
_DATED = r"[\[<{(]?(?:(?:19|20)\d\d|yyyy|year)\b"
NOTICE_LINE = (
    rf"(^|\n)[ \t\r\f]*(?:(?:copyright\b|\(c\)|©)[ \t,:]*(?:\(c\)|{_NAMED}|{_DATED}|by\b)[^\n]*"
    r"|(?:copyright\b|\(c\)|©)[^\n]*all rights reserved[^\n]*|all rights reserved[ \t\r\f.!]*(?=\n|\z))"
)
NOTICE_PARAGRAPH = rf"(^\s*|\n[ \t\r\f]*\n[ \t\r\f]*){_NAMED}[^\n]*(?:\n[ \t\r\f]*{_NAMED}[^\n]*)*+(?=\n[ \t\r\f]*\n|\s*\z)"
#: The lines that the SQL form leaves out: all that begin with a mark, so wrapped body lines as well.
COPYRIGHT_LINE = r"(^|\n)[ \t\r\f]*(copyright|\(c\)|©|all rights reserved)[^\n]*"
SEPARATORS = r"[^\p{L}\p{N}]+"
SPELLINGS = [
    ("licence", "license"), ("sub license", "sublicense"), ("non commercial", "noncommercial"), ("non infringement", "noninfringement"),
    ("copyright owner", "copyright holder"), ("acknowledgement", "acknowledgment"), ("organisation", "organization"), ("judgement", "judgment"),
    ("favour", "favor"), ("fulfil ", "fulfill "), ("per cent", "percent"), ("http ", "https "),
]


def canonical(text: Column) -> Column:
    """The canonical form of a text, with one space on either side of every word."""
    lower = F.lower(F.coalesce(text, F.lit("")))
    body = F.regexp_replace(F.regexp_replace(lower, NOTICE_LINE, "\n"), NOTICE_PARAGRAPH, "\n\n")
    spaced = F.regexp_replace(body, SEPARATORS, " ")
    out = F.concat(F.lit(" "), F.trim(spaced), F.lit(" "))
    for spelling, same in SPELLINGS:
        out = F.replace(out, F.lit(f" {spelling}"), F.lit(f" {same}"))
    return out


def known_licences(spark: SparkSession, more: DataFrame | None = None) -> DataFrame:
    """``license_id, text`` of the fixed texts, and of a table ``more`` with further ones."""
    known = spark.createDataFrame(KNOWN, "license_id string, text string")
    return known if more is None else known.unionByName(more.select("license_id", "text"))


def scan(docs: DataFrame, licences: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, digest, license_id`` of every document; ``license_id`` is null where its text is no known licence."""
    known = licences.select(canonical(F.col("text")).alias("form"), "license_id").filter(F.trim("form") != "")
    known = known.groupBy(F.sha2("form", 256).alias("digest")).agg(F.min("license_id").alias("license_id"))
    looked = docs.select(F.col(id_col).alias("doc_id"), F.sha2(canonical(F.col(text_col)), 256).alias("digest"))
    return attach(looked, known, "digest")
