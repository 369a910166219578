"""Licence scans by canonical digests.

A text is brought to a canonical form (case, punctuation, comment markers, quotes and spaces of any kind, copyright lines,
equivalent spellings) and hashed; the digest of the entire canonical text is joined to those of known licence texts and
notices. Documents are looked up as a whole, and each of their lines as a text of its own, because a notice is usually a line.

Everything is DataFrame functions. Scale: the known digests are a table, ours or the caller's, and broadcast if they are
MAX_KNOWN at the most, by a count. A text can only match if it begins with a first word of a known one, or with one that a
spelling makes such a word; lines are judged by that before they are brought to their canonical form. Only lines that
matched are shuffled, and documents as (id, digests) without their texts.

Edge cases: a null text, or one with nothing left in its canonical form, has the digest of "" and matches nothing;
repeated rows each get their row; a null id gets its own matches; a digest that is known under several ids counts as the
one that sorts first; only doc_id and text are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import materialise
from .line_dedup import split_lines

MAX_KNOWN = 100_000
# Wording of public licences and of the usual notices.
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
ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""
APACHE2_HEADER = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
KNOWN: list[tuple[str, str]] = [
    ("MIT", MIT),
    ("MIT", "MIT License\n" + MIT),
    ("MIT", "The MIT License (MIT)\n" + MIT),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("ISC", ISC),
    ("ISC", "ISC License\n" + ISC),
    ("BSD-2-Clause", BSD2),
    ("BSD-2-Clause", "BSD 2-Clause License\n" + BSD2),
    ("BSD-3-Clause", BSD3),
    ("BSD-3-Clause", "BSD 3-Clause License\n" + BSD3),
    ("Zlib", ZLIB),
    ("Zlib", "zlib License\n" + ZLIB),
    ("Apache-2.0", APACHE2_HEADER),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
]
#: Identifiers that the tag "SPDX-License-Identifier: <id>" is known with.
SPDX = ["0BSD", "AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-2.0", "Artistic-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC0-1.0", "EPL-2.0", "EUPL-1.2", "GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later", "ISC", "LGPL-2.1", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0", "LGPL-3.0-only", "LGPL-3.0-or-later", "MIT", "MIT-0", "MPL-2.0", "PostgreSQL", "Python-2.0", "Unlicense", "WTFPL", "Zlib"]
KNOWN += [(i, f"SPDX-License-Identifier: {i}") for i in SPDX]
#: Spellings that count as the same, applied to lower-cased words.
SPELLINGS: list[tuple[str, str]] = [
    ("licence", "license"),
    ("licenced", "licensed"),
    ("licences", "licenses"),
    ("sublicence", "sublicense"),
    ("unlicence", "unlicense"),
    ("sub license", "sublicense"),
    ("acknowledgement", "acknowledgment"),
    ("merchantibility", "merchantability"),
    ("non infringement", "noninfringement"),
    ("noncommercial", "non commercial"),
    ("organisation", "organization"),
    ("copyright owner", "copyright holder"),
    ("copyright owners", "copyright holders"),
    ("and or", "or"),
    ("https", "http"),
]


#: Canonical digests of entire public licence texts, with the first word of their canonical form.
DIGESTS: list[tuple[str, str, str]] = [
    ("Apache-2.0", "apache", "7f01b5c5a6f1313d84dcc69200fddb49761bc32697840688f3efa623778bf175"),
    ("Artistic-1.0-Perl", "the", "e963bc30f4d3c45f45030c34409ee37315564625649c1394e32bb5ddd99e01b2"),
    ("CC0-1.0", "creative", "891968ade68c0a40cc2b1974e64ce18e87b058a90c18b0d9449bbd898d172b1d"),
    ("GFDL-1.2", "gnu", "02395196a0b448e79d55b684797cc614bb5f6ca535df9d119f57d6bd1f2ab275"),
    ("GFDL-1.3", "gnu", "fff021fefd31950a459295f7fa5f56da2da92be592abe8bc82e43fa442b3895f"),
    ("GPL-1.0", "gnu", "425b73aa435a1e84f0465aef53c1ffe5a26087ccdb3331b37dc650836af0e43d"),
    ("GPL-2.0", "gnu", "7425a5ad1a86c0fb0ef86e24181a5b3ea1bd99195395cf95c18c028da0e8516c"),
    ("GPL-3.0", "gnu", "5a281f634db6b415a4491779bb7121c752940f250ef622ab9ab829920e8cfbb6"),
    ("LGPL-2.0", "gnu", "c76b4873e6b3cac1b9bd64b1bfc53fd0d45f19077cd10583549d96f864105e81"),
    ("LGPL-2.1", "gnu", "beebb7d0f5ba0a4a1dea2ce270edee98c9ec8508ff67599a990066f5942a9d18"),
    ("LGPL-3.0", "gnu", "dd538d15d532339d4a394323937d54825be6b2224b8e1985cf9c9e707c966d9c"),
    ("MPL-1.1", "mozilla", "3e09f15d32dbcedcd46539cb8083a1a3c4ecbff60fea0310228072dbe6a57866"),
    ("MPL-2.0", "mozilla", "f82071285728ca3ec7685ee9bc4acdae0b8267142a4d20b8f1805eabedb4a98a"),
]
#: White space and marks that count as punctuation beyond ASCII: spaces, quotes, dashes, bullets, the byte order mark.
BEYOND = r"\x{85}\x{A0}\x{1680}\x{2000}-\x{200B}\x{2010}-\x{2015}\x{2018}-\x{201F}\x{2022}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
PUNCTUATION = rf"[\x00-\x2F\x3A-\x60\x7B-\x7F{BEYOND}]+"
#: A line that, after comment markers and spaces, begins with "copyright" and has a sign or a year, or begins with the sign, or
#: says no more than "all rights reserved".
MARKERS = rf"[\x00-\x09\x0B-\x2F\x3A-\x60\x7B-\x7F{BEYOND}]*"
COPYRIGHT_LINE = rf"(?:^|\n){MARKERS}(?:copyright{MARKERS}(?:\(c\)|©)[^\n]*|copyright[^\n]*(?:19|20)[0-9][0-9][^\n]*|\(c\){MARKERS}(?:[0-9]|copyright)[^\n]*|©[^\n]*|all rights reserved{MARKERS}(?:\n|$))"


def _wide(words: str) -> str:
    """Words as they stand in the text while spellings are replaced: two spaces between them, so matches share none."""
    return f" {words.replace(' ', '  ')} "


def canonical(text: Column) -> Column:
    """Canonical form: lower case, without copyright lines, words with single spaces, one spelling of each. Letters beyond
    ASCII are kept, so that different texts stay different."""
    plain = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), COPYRIGHT_LINE, "\n")
    words = F.concat(F.lit(" "), F.regexp_replace(plain, PUNCTUATION, "  "), F.lit(" "))
    for seen, meant in SPELLINGS:
        words = F.replace(words, F.lit(_wide(seen)), F.lit(_wide(meant)))
    return F.btrim(F.replace(words, F.lit("  "), F.lit(" ")))


def canonical_digest(text: Column) -> Column:
    return F.sha2(canonical(text), 256)


def first_word(text: Column) -> Column:
    """The first word of a text as it stands, lower-cased."""
    return F.regexp_extract(F.lower(text), rf"^(?:{PUNCTUATION})?([^\x00-\x2F\x3A-\x60\x7B-\x7F{BEYOND}]+)", 1)


def beginnings(words: list[str]) -> list[str]:
    """The first words that texts may have whose canonical form begins with one of these."""
    out, new = set(words), True
    while new:
        new = {seen.split()[0] for seen, meant in SPELLINGS if meant.split()[0] in out} - out
        out |= new
    return sorted(out)


def known_digests(spark: SparkSession, known: DataFrame | None = None) -> DataFrame:
    """(digest, license_id, word) of known texts, one row for each digest; word is the first one of the canonical text.
    known: (license_id, text) of the caller's list, ours where not given."""
    rows = spark.createDataFrame(KNOWN, "license_id string, text string") if known is None else known.select("license_id", "text")
    out = rows.select("license_id", canonical(F.col("text")).alias("c")).where("license_id IS NOT NULL AND c <> ''").select("license_id", F.sha2("c", 256).alias("digest"), F.substring_index("c", " ", 1).alias("word"))
    if known is None:
        out = out.unionByName(spark.createDataFrame(DIGESTS, "license_id string, word string, digest string"))
    return out.groupBy("digest").agg(F.min("license_id").alias("license_id"), F.min("word").alias("word"))


def license_scan(documents: DataFrame, known: DataFrame | None = None, max_known: int = MAX_KNOWN) -> DataFrame:
    """doc_id, text_sha256 (canonical digest), license_id (of the whole text, or null), notices (sorted distinct ids of
    the lines that are notices, comma-joined), n_notices (such lines). known: see known_digests."""
    table = known_digests(documents.sparkSession, known)
    words = [r.word for r in table.select("word").distinct().limit(1001).collect()]
    table = table.select("digest", "license_id")
    small = known is None or table.count() <= max_known
    table = F.broadcast(table) if small else materialise(table, "known-licenses")
    own = F.xxhash64(F.coalesce("text", F.lit("")))
    lines = documents.select("doc_id", own.alias("same"), F.posexplode(split_lines(F.col("text"))).alias("at", "line"))
    if len(words) <= 1000:
        lines = lines.where(first_word(F.col("line")).isin(beginnings(words)))
    noticed = lines.withColumn("digest", canonical_digest(F.col("line"))).join(table, "digest")
    notices = noticed.groupBy(F.col("doc_id").alias("n_doc"), F.col("same").alias("n_same")).agg(F.array_join(F.array_sort(F.collect_set("license_id")), ",").alias("notices"), F.size(F.collect_set("at")).alias("n_all"))
    digests = documents.select("doc_id", own.alias("same"), canonical_digest(F.col("text")).alias("digest"))
    whole = digests.join(table, "digest", "left").withColumnRenamed("digest", "text_sha256")
    out = whole.join(notices, F.col("doc_id").eqNullSafe(F.col("n_doc")) & (F.col("same") == F.col("n_same")), "left")
    return out.select("doc_id", "text_sha256", "license_id", F.coalesce("notices", F.lit("")).alias("notices"), F.coalesce("n_all", F.lit(0)).cast("long").alias("n_notices"))


def _canonical_sql(text: str) -> str:
    words = f"concat(' ', regexp_replace(regexp_replace(lower(coalesce({text}, '')), '{COPYRIGHT_LINE}', chr(10), 'g'), '{PUNCTUATION}', '  ', 'g'), ' ')"
    for seen, meant in SPELLINGS:
        words = f"replace({words}, '{_wide(seen)}', '{_wide(meant)}')"
    return f"trim(replace({words}, '  ', ' '))"


def oracle() -> str:
    values = ", ".join("('{}', '{}')".format(i, t.replace("'", "''")) for i, t in KNOWN)
    digests = ", ".join(f"('{i}', '{d}')" for i, _, d in DIGESTS)
    return f"""
WITH known AS (
  SELECT digest, min(i) AS license_id FROM (
    SELECT i, sha256({_canonical_sql("t")}) AS digest FROM (VALUES {values}) v(i, t)
    UNION ALL SELECT i, d FROM (VALUES {digests}) w(i, d)
  ) GROUP BY 1
), lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents
), notices AS (
  SELECT doc_id, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS notices, count(*) AS n
  FROM lines JOIN known ON digest = sha256({_canonical_sql("line")}) GROUP BY doc_id
), own AS (SELECT doc_id, sha256({_canonical_sql("text")}) AS text_sha256 FROM documents)
SELECT o.doc_id, o.text_sha256, k.license_id, coalesce(n.notices, '') AS notices, coalesce(n.n, 0) AS n_notices
FROM own o LEFT JOIN known k ON k.digest = o.text_sha256 LEFT JOIN notices n ON n.doc_id = o.doc_id
"""
