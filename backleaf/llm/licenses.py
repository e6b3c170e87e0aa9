"""Licence scans: canonical digests of whole texts, looked up among known licences.

A text's canonical form has lower-case A-Z, no copyright lines and no "all rights reserved", one spelling of words that licences
spell in several ways, and one space for each run of other signs than a-z, 0-9 and those beyond
ASCII. Equal digests of the canonical form mean equal licences. Whole texts are joined by hash with
the digests of known licences; a text's lines are looked up among the digests of known notices,
which shows files that carry a licence line below their own content.

All of it is DataFrame and SQL functions, with one definition (as SQL) for corpus and known texts.

Defined results: a null or empty text, or one of signs only, matches nothing and has the digest of the empty
text; repeated rows all come back; an empty table gives an empty result; the input's columns are passed
on first, in their order, and one whose name the result needs gets underscores after its name.
"""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from backleaf.llm.common import beside, stage

# Spellings that count as equal, from the matching guidelines for licence lists.
EQUIVALENT = (
    ("https", "http"),
    ("acknowledgement", "acknowledgment"),
    ("analogue", "analog"),
    ("analyse", "analyze"),
    ("artefact", "artifact"),
    ("authorisation", "authorization"),
    ("authorised", "authorized"),
    ("calibre", "caliber"),
    ("cancelled", "canceled"),
    ("capitalisation", "capitalization"),
    ("catalogue", "catalog"),
    ("categorise", "categorize"),
    ("centre", "center"),
    ("emphasised", "emphasized"),
    ("favour", "favor"),
    ("fulfilment", "fulfillment"),
    ("initialise", "initialize"),
    ("judgement", "judgment"),
    ("labelling", "labeling"),
    ("labour", "labor"),
    ("licence", "license"),
    ("maximise", "maximize"),
    ("modelled", "modeled"),
    ("offence", "offense"),
    ("optimise", "optimize"),
    ("organisation", "organization"),
    ("organise", "organize"),
    ("practise", "practice"),
    ("programme", "program"),
    ("realise", "realize"),
    ("recognise", "recognize"),
    ("signalling", "signaling"),
    ("utilisation", "utilization"),
    ("whilst", "while"),
    ("non commercial", "noncommercial"),
    ("per cent", "percent"),
    ("sub license", "sublicense"),
    ("copyright holder", "copyright owner"),
)

# Texts of known licences (identifier, text).
_NO_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
    "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY "
    "CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
    "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF '
    "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY "
    "DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, "
    "ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_BSD_HEAD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n"
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n"
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution.\n"
)
_BSD_TAIL = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED '
    "TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR "
    "CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
    "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF "
    "LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS "
    "SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
LICENSES = (
    (
        "MIT",
        "MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
        'files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software.\n\n" + _NO_WARRANTY,
    ),
    (
        "ISC",
        "ISC License\n\nPermission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies.\n\n" + _ISC_WARRANTY,
    ),
    (
        "0BSD",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\n" + _ISC_WARRANTY,
    ),
    ("BSD-2-Clause", _BSD_HEAD + _BSD_TAIL),
    (
        "BSD-3-Clause",
        _BSD_HEAD + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived "
        "from this software without specific prior written permission.\n" + _BSD_TAIL,
    ),
    (
        "Zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages "
        "arising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, including commercial "
        "applications, and to alter it and redistribute it freely, subject to the following restrictions:\n\n1. The origin of this software must not "
        "be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in "
        "the product documentation would be appreciated but is not required.\n2. Altered source versions must be plainly marked as such, and must "
        "not be misrepresented as being the original software.\n3. This notice may not be removed or altered from any source distribution.",
    ),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may '
        "obtain a copy of the License at\n\nhttp://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or '
        "implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
)

# One-line notices (identifier, line).
NOTICES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-only"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
)

#: First lines under which the texts of LICENSES are found; none is one of them.
TITLES = {
    "MIT": ("", "MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)", "License: MIT", "(The MIT License)"),
    "ISC": ("", "ISC License", "The ISC License", "ISC License (ISC)", "The ISC License (ISC)"),
    "0BSD": ("", "BSD Zero Clause License", "Zero-Clause BSD", "Zero-Clause BSD License", "BSD 0-Clause License"),
    "BSD-2-Clause": ("", "BSD 2-Clause License", "The BSD 2-Clause License", "The 2-Clause BSD License", 'BSD 2-Clause "Simplified" License', "Simplified BSD License", "BSD License", "The BSD License"),
    "BSD-3-Clause": ("", "BSD 3-Clause License", "The BSD 3-Clause License", "The 3-Clause BSD License", 'BSD 3-Clause "New" or "Revised" License', "New BSD License", "The New BSD License", "Modified BSD License", "Revised BSD License", "BSD License", "The BSD License"),
    "Zlib": ("", "zlib License", "The zlib License", "The zlib/libpng License", "zlib/libpng License"),
    "Apache-2.0": ("",),
}
#: Folder of the full texts of longer licences, a file for each identifier.
TEXTS = Path(__file__).with_name("license_texts")


def variants() -> tuple[tuple[str, str], ...]:
    """(identifier, text): LICENSES under each of their titles, with and without numbers before the conditions."""
    out = []
    for i, text in LICENSES:
        body = text.split("\n\n", 1)[1] if text.split("\n\n", 1)[0] in TITLES[i] else text
        plain = re.sub(r"(^|\n)[1-3]\. ", r"\1", body)
        out += [(i, f"{title}\n\n{b}") for title in TITLES[i] for b in dict.fromkeys((body, plain))]
    return tuple(out)


def full_texts() -> tuple[tuple[str, str], ...]:
    """(identifier, text): the files in TEXTS, whole and without what they append after their terms."""
    out = []
    for at in sorted(TEXTS.glob("*.txt")):
        text = at.read_text(encoding="utf-8")
        out += [(at.stem, text)]
        end = re.search(r"END OF TERMS AND CONDITIONS", text)
        out += [(at.stem, text[: end.end()]), (at.stem, text[: end.start()])] if end else []
    return tuple(out)


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: What a line may start with before its words.
_MARKS = r"[ \t*#/;>-]*"
# The words that follow "copyright" where a sentence of a licence goes on.
_SENTENCE_WORDS = "notices?|holders?|owners?|ownership|licen[cs]es?|laws?|statements?|interests?|disclaimers?|treaty|treaties|permission|doctrines|resulting|and|or|in|to|as|of|for|is|are|on|if"
_OWNER, _ALL_RIGHTS = r"\(c\)[ \t,]*([0-9]|copyright\b)|©", r"all rights reserved[ \t.\r]*"
#: A phrase that no licence needs, wherever it stands.
RESERVED = "(^| )all rights reserved( |$)"
_ON = rf"[ \t]*[.;)\"'-]|[ \t]*\(c\)[ \t]*_|,[ \t]*[^0-9 \t]|[ \t]+({_SENTENCE_WORDS})\b"
_AUTHORS = r"[^\n]*\b(authors|contributors)\b"
#: A line (lower-case) that names a copyright owner or reserves rights: "copyright" with a sign, year or name, "(c)" with a year, "©".
#: It belongs to the licence all the same if its sentence goes on after "copyright"; "the" goes on unless authors follow.
OWNER_LINE = rf"(^|\n){_MARKS}(copyright\b(?!{_ON}|[ \t]*(\r?\n|$)|[ \t]+the\b(?!{_AUTHORS}))|{_OWNER}|{_ALL_RIGHTS}(?=\n|$))[^\n]*"
#: The same for one line, without lookahead, for DuckDB: lines that match the first and neither of the others.
OWNER_START, GOES_ON, GOES_ON_THE, AUTHORS = rf"^{_MARKS}(copyright\b|{_OWNER}|{_ALL_RIGHTS}$)", rf"^{_MARKS}copyright({_ON}|[ \t]*\r?$)", rf"^{_MARKS}copyright[ \t]+the\b", rf"^{_AUTHORS}"
SIGNS = r"[^a-z0-9\n\x{80}-\x{10FFFF}]+"


def canonical(text: Column) -> Column:
    """The canonical form, with lines still apart: a space between words, \\n between lines."""
    out = F.translate(F.coalesce(text, F.lit("")), _UPPER, _UPPER.lower())
    out = F.regexp_replace(out, OWNER_LINE, "$1")
    out = F.regexp_replace(out, SIGNS, " ")
    for variant, one in EQUIVALENT:
        out = F.replace(out, F.lit(variant), F.lit(one))
    return out


def whole(canonical_text: Column) -> Column:
    """All lines as one; spellings of several words are replaced once more, as a line may have ended within them."""
    out = F.regexp_replace(F.regexp_replace(canonical_text, "[ \n]+", " "), RESERVED, " ")
    for variant, one in EQUIVALENT:
        if " " in variant:
            out = F.replace(out, F.lit(variant), F.lit(one))
    return F.trim(out)


def digest(canonical_text: Column) -> Column:
    return F.sha2(canonical_text, 256)


def known(spark: SparkSession, texts: tuple[tuple[str, str], ...] | DataFrame) -> DataFrame:
    """(license_id, digest), one row for each digest; texts is a list or a table (license_id, text)."""
    if isinstance(texts, DataFrame):
        rows = texts.select("license_id", digest(whole(canonical(F.col("text")))).alias("digest"))
        return rows.groupBy("digest").agg(F.min("license_id").alias("license_id"))
    listed = F.array(*[F.struct(F.lit(i).alias("license_id"), F.lit(t).alias("text")) for i, t in texts])
    rows = spark.range(1).select(F.explode(listed).alias("x")).select("x.*")
    return rows.select("license_id", digest(whole(canonical(F.col("text")))).alias("digest")).groupBy("digest").agg(F.min("license_id").alias("license_id"))


def scan(
    df: DataFrame,
    text_col: str = "text",
    licenses: tuple[tuple[str, str], ...] | DataFrame | None = None,
    notices: tuple[tuple[str, str], ...] = NOTICES,
    most_broadcast: int = 100_000,
    line_slack: int = 2,
) -> DataFrame:
    """df with text_digest, license_id (of the whole text, or null) and notice_ids (sorted, of its lines).

    licenses: a list, or a table (license_id, text); by default LICENSES, variants(), full_texts() and NOTICES. Its
    digests are broadcast if they are counted to be at most most_broadcast, about 100 bytes each, else joined by shuffle.
    line_slack: canonical lines over line_slack times as long as the longest notice are not hashed, as none equals a
    notice (canonical forms may grow, by less than that).
    """
    licenses = LICENSES + variants() + full_texts() + NOTICES if licenses is None else licenses
    made = ("text_digest", "license_id", "notice_ids")
    line_ids: dict[str, str] = {x.digest: x.license_id for x in known(df.sparkSession, notices).collect()}
    longest = max((len(t) for _, t in notices), default=0)
    own = [f"c{i}" for i in range(len(df.columns))]
    rows = df.select(*[df[c].alias(n) for c, n in zip(df.columns, own)], canonical(df[text_col]).alias("canonical"))
    rows = rows.select(*own, digest(whole(F.col("canonical"))).alias("text_digest"), F.filter(F.split("canonical", "\n"), lambda x: F.char_length(x).between(2, line_slack * longest)).alias("lines"))
    found = F.transform("lines", lambda x: digest(F.trim(x)))
    table = F.create_map(*[F.lit(x) for item in line_ids.items() for x in item])
    ids = F.array_sort(F.array_distinct(F.transform(F.array_intersect(found, F.array(*map(F.lit, line_ids))), lambda d: F.element_at(table, d))))
    by_digest = known(df.sparkSession, licenses).withColumnRenamed("digest", "text_digest")
    if isinstance(licenses, DataFrame):
        by_digest = stage(by_digest, "licences")
    if not isinstance(licenses, DataFrame) or by_digest.count() <= most_broadcast:
        by_digest = F.broadcast(by_digest)
    rows = rows.select(*own, "text_digest", ids.alias("notice_ids")).join(by_digest, "text_digest", "left")
    return rows.select(*[F.col(n).alias(c) for c, n in zip(beside(df.columns, made), own)], *made)


def canonical_sql(text: str) -> str:
    """canonical() in DuckDB's SQL: lines that name an owner are filtered out one by one."""
    lower = f"translate(coalesce({text}, ''), '{_UPPER}', '{_UPPER.lower()}')"
    starts, on, the, authors = (f"regexp_matches(x, '{p}')" for p in (OWNER_START, GOES_ON.replace("'", "''"), GOES_ON_THE, AUTHORS))
    out = f"array_to_string(list_filter(string_split({lower}, chr(10)), lambda x: NOT ({starts} AND NOT ({on} OR {the} AND NOT {authors}))), chr(10))"
    out = f"regexp_replace({out}, '{SIGNS}', ' ', 'g')"
    for variant, one in EQUIVALENT:
        out = f"replace({out}, '{variant}', '{one}')"
    return out


def whole_sql(canonical: str) -> str:
    out = f"regexp_replace({canonical}, '[ \n]+', ' ', 'g')"
    for variant, one in EQUIVALENT:
        if " " in variant:
            out = f"replace({out}, '{variant}', '{one}')"
    return f"trim({out})"


def known_sql(texts: tuple[tuple[str, str], ...]) -> str:
    quoted = ", ".join("('{}', '{}')".format(i, t.replace("'", "''")) for i, t in texts)
    return f"""SELECT min(license_id) AS license_id, sha256({whole_sql(canonical_sql('text'))}) AS digest
        FROM (VALUES {quoted}) v(license_id, text) GROUP BY 2"""


def scan_sql() -> str:
    """scan() of the table documents in DuckDB's SQL, with notice_ids as one string."""
    return f"""WITH c AS (SELECT doc_id, row_number() OVER () AS r, {canonical_sql('text')} AS canonical FROM documents),
    w AS (SELECT doc_id, r, canonical, sha256({whole_sql('canonical')}) AS text_digest FROM c),
    l AS (SELECT r, sha256(trim(unnest(string_split(canonical, chr(10))))) AS digest FROM w),
    n AS (SELECT r, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS notice_ids FROM l JOIN ({known_sql(NOTICES)}) k USING (digest) GROUP BY r)
    SELECT doc_id, text_digest, k.license_id, coalesce(notice_ids, '') AS notice_ids
    FROM w LEFT JOIN ({known_sql(LICENSES + variants() + full_texts() + NOTICES)}) k ON k.digest = text_digest LEFT JOIN n USING (r)"""
