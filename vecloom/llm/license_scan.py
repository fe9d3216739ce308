"""License scans by canonical digests, with DataFrame operations only.

A text is brought to a canonical form - A-Z in lower case, copyright lines dropped,
punctuation and white space to single spaces, equivalent spellings made one - and
the SHA-256 of all of it is looked up among the digests of known licence texts, by
a hash join against that fixed table. The same lookup over each line finds
licence notices that stand as a line of their own.

Defined results: a null text is an empty one and matches nothing; null and repeated
doc_ids pass through; a text that consists of copyright lines is empty; other
columns are ignored; no rows give no rows. Known texts with one canonical form
count as the first of them by name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Known licence texts, whole.
LICENSES = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "notice:Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "notice:CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "notice:GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "notice:MIT": "Released under the MIT License.",
}

#: Spellings that count as one, as (variant, canonical form), after punctuation has gone.
SPELLINGS = (
    ("licence", "license"),
    ("isation", "ization"),
    ("acknowledgement", "acknowledgment"),
    ("judgement", "judgment"),
    ("favour", "favor"),
    ("behaviour", "behavior"),
    ("analogue", "analog"),
    ("fulfilment", "fulfillment"),
    ("sub license", "sublicense"),
    ("non commercial", "noncommercial"),
    ("non infringement", "noninfringement"),
    ("copyright owner", "copyright holder"),
)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A copyright line with the break before it.
_COPYRIGHT = r"\n[\x00-\x09\x0b-/:-@\[-`{-\x7f]*(?:copyright \(c\)|copyright ©|copyright [0-9]|\(c\) [0-9]|©|all rights reserved)[^\n]*"
#: ASCII marks and white space but for the line break, and common typographic marks.
_MARKS = r"[\x00-\x09\x0b-/:-@\[-`{-\x7f“”‘’–—…©®•]+"


def _spelled(x: Column) -> Column:
    for variant, canonical in SPELLINGS:
        x = F.replace(x, F.lit(variant), F.lit(canonical))
    return x


def canonical_lines(text: Column) -> Column:
    """The text in canonical form but for its line breaks and spellings."""
    low = F.translate(F.concat(F.lit("\n"), F.coalesce(text, F.lit(""))), _UPPER, _LOWER)
    return F.regexp_replace(F.regexp_replace(low, _COPYRIGHT, "\n"), _MARKS, " ")


def canonical_text(lines: Column) -> Column:
    return _spelled(F.trim(F.regexp_replace(lines, r"[ \n]+", " ")))


def known_digests(spark: SparkSession, licenses: dict[str, str] = LICENSES) -> DataFrame:
    """digest, license_id, size (of the canonical form): one row for each known text."""
    table = spark.createDataFrame(sorted(licenses.items()), "license_id string, text string").coalesce(1)
    form = canonical_text(canonical_lines(F.col("text")))
    return table.select(F.sha2(form, 256).alias("digest"), "license_id", F.length(form).alias("size")).groupBy("digest").agg(F.min("license_id").alias("license_id"), F.min("size").alias("size"))


def scan_licenses(docs: DataFrame, licenses: dict[str, str] = LICENSES) -> DataFrame:
    """One row per document: doc_id, text_digest, license_id (of the whole text, else null),
    notices (names of the known texts that are a line of it, sorted, comma-joined).
    """
    known = known_digests(docs.sparkSession, licenses)
    # as many rows as there are known texts, so the driver may hold them
    table = known.collect()
    sizes = [r["size"] for r in table] or [0]
    names = F.create_map(*[F.lit(x) for r in table for x in (r["digest"], r["license_id"])]) if table else F.create_map().cast("map<string,string>")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), canonical_lines(docs["text"]).alias("lines"))
    line = F.filter(F.transform(F.split("lines", "\n"), lambda x: _spelled(F.trim(x))), lambda x: F.length(x).between(min(sizes), max(sizes)))
    found = F.filter(F.transform(line, lambda x: F.element_at(names, F.sha2(x, 256))), lambda x: x.isNotNull())
    rows = rows.select("doc_id", F.sha2(canonical_text(F.col("lines")), 256).alias("text_digest"), F.array_join(F.array_sort(F.array_distinct(found)), ",").alias("notices"))
    fixed = known.select(F.col("digest").alias("text_digest"), "license_id")
    return rows.join(F.broadcast(fixed), "text_digest", "left").select("doc_id", "text_digest", "license_id", "notices")


def oracle_sql(licenses: dict[str, str] = LICENSES) -> str:
    """DuckDB SQL for the rows of scan_licenses over documents."""

    def quoted(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    def spelled(x: str) -> str:
        for variant, canonical in SPELLINGS:
            x = f"replace({x}, {quoted(variant)}, {quoted(canonical)})"
        return x

    lines = f"regexp_replace(regexp_replace(translate(chr(10) || coalesce(text, ''), '{_UPPER}', '{_LOWER}'), {quoted(_COPYRIGHT)}, chr(10), 'g'), {quoted(_MARKS)}, ' ', 'g')"
    form = spelled("trim(regexp_replace(lines, '[ \\n]+', ' ', 'g'))")
    values = ", ".join(f"({quoted(k)}, {quoted(v)})" for k, v in sorted(licenses.items()))
    return f"""
WITH known AS (
  SELECT sha256({form}) AS digest, min(license_id) AS license_id
  FROM (SELECT license_id, {lines} AS lines FROM (VALUES {values}) AS t(license_id, text)) GROUP BY 1
),
docs AS (SELECT doc_id, lines, sha256({form}) AS text_digest, row_number() OVER () AS n FROM (SELECT doc_id, {lines} AS lines FROM documents)),
noted AS (
  SELECT n, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS notices
  FROM (SELECT n, sha256({spelled("trim(line)")}) AS digest FROM (SELECT n, unnest(string_split(lines, chr(10))) AS line FROM docs)) JOIN known USING (digest)
  GROUP BY n
)
SELECT doc_id, text_digest, license_id, coalesce(notices, '') AS notices
FROM docs LEFT JOIN known ON text_digest = digest LEFT JOIN noted USING (n)
"""
