"""Licence scan by canonical digests.

A text and each of its lines are brought to a canonical form (lower case, copyright lines
gone, punctuation as blanks, one spelling for equivalent words) and digested; entire
canonical texts are then hash-joined to the digests of known licences. The known table has a
fixed size, so it is broadcast. Everything runs in Spark's own functions.

Known in full, in the variants of ``license_texts``: Apache-2.0, GPL-2.0, GPL-3.0, LGPL-2.0,
LGPL-2.1, LGPL-3.0, MPL-2.0, CC0-1.0, CC-BY-SA-4.0, BSD-2-Clause, BSD-3-Clause, MIT, ISC, Zlib,
BSL-1.0, Unlicense. Not known in full: AGPL-3.0, CC-BY-4.0 and CC-BY-NC-4.0 (of the two CC
licences only the notice), texts with other words, and texts with anything before or after.

Defined results: null texts are empty and match nothing; rows with equal texts get equal
results; a canonical text without a letter or digit never matches; an empty table gives no
rows. Only the id and text columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beliefmill.llm.common import text_id, text_of
from beliefmill.llm.license_texts import full_digests

# Lines that name holders, and spellings that count as equal.
COPYRIGHT_LINE = r"(?m)^[^\p{L}\p{N}\n]*(copyright|\(c\)|©|all rights reserved)[^\n]*$"
PUNCTUATION = r"[^\p{L}\p{N}\n]+"
SPELLINGS = [("licence", "license"), ("sub license", "sublicense"), ("non commercial", "noncommercial"), ("http ", "https "), ("and or", "or"), ("version 2 0", "2 0"), ("version 3", "3")]
# Notices, and short licences in full. More full texts are in license_texts.
KNOWN = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License");'),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License v3.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "Released under CC0 1.0 Universal."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, Version 2.0."),
    ("MIT", """MIT License

Copyright (c) <year> <holder>

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
]


def base_form(text: Column) -> Column:
    """Lower case without copyright lines and punctuation; line ends stay."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), COPYRIGHT_LINE, ""), PUNCTUATION, " ")


def spell(text: Column) -> Column:
    for old, new in SPELLINGS:
        text = F.replace(text, F.lit(old), F.lit(new))
    return F.trim(text)


def whole_form(text: Column) -> Column:
    return spell(F.trim(F.regexp_replace(base_form(text), "[ \n]+", " ")))


def known_digests(spark, known: list[tuple[str, str]] | None = None) -> DataFrame:
    """digest, license of the given texts; by default of KNOWN and of all full texts kept."""
    rows = spark.createDataFrame(known or KNOWN, "license string, text string")
    digests = rows.select(F.sha2(whole_form(F.col("text")).cast("binary"), 256).alias("digest"), "license")
    return (digests if known else digests.unionByName(full_digests(spark))).distinct()


def scan(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """doc_id, text_digest, license (of the entire text), line_licenses (sorted ids of entire
    lines, joined by commas, null without one), license_lines (how many lines)."""
    known = F.broadcast(known if known is not None else known_digests(docs.sparkSession))
    rows = docs.select("doc_id", text_of("text").alias("text"))
    lines = rows.select(text_id("text").alias("tid"), F.posexplode(F.split(base_form(F.col("text")), "\n")).alias("line", "form"))
    lines = lines.select("tid", "line", spell(F.trim("form")).alias("form")).where("form <> ''")
    found = lines.select("tid", "line", F.sha2(F.col("form").cast("binary"), 256).alias("digest")).join(known, "digest")
    found = found.groupBy("tid", "line").agg(F.min("license").alias("license")).groupBy("tid").agg(F.array_join(F.sort_array(F.collect_set("license")), ",").alias("line_licenses"), F.count(F.lit(1)).alias("license_lines"))
    texts = rows.select("doc_id", text_id("text").alias("tid"), F.sha2(whole_form(F.col("text")).cast("binary"), 256).alias("text_digest"))
    whole = texts.join(known.groupBy("digest").agg(F.min("license").alias("license")).withColumnRenamed("digest", "text_digest"), "text_digest", "left")
    return whole.join(found, "tid", "left").select("doc_id", "text_digest", "license", "line_licenses", F.coalesce("license_lines", F.lit(0)).cast("long").alias("license_lines"))


def scan_sql() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"

    def spelled(x: str) -> str:
        for old, new in SPELLINGS:
            x = f"replace({x}, {quote(old)}, {quote(new)})"
        return f"trim({x})"

    base = f"regexp_replace(regexp_replace(lower(text), {quote(COPYRIGHT_LINE)}, '', 'g'), {quote(PUNCTUATION)}, ' ', 'g')"
    whole = spelled(rf"trim(regexp_replace({base}, '[ \n]+', ' ', 'g'))")
    values = ", ".join(f"({quote(a)}, {quote(b)})" for a, b in KNOWN)
    return f"""
    WITH known AS (SELECT sha256({whole}) AS digest, min(license) AS license FROM (VALUES {values}) k(license, text) GROUP BY 1),
    rows AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
    parts AS (SELECT text, string_split({base}, chr(10)) AS p FROM (SELECT DISTINCT text FROM rows)),
    lines AS (SELECT text, {spelled("trim(unnest(p))")} AS form FROM parts),
    hits AS (SELECT text, string_agg(DISTINCT license, ',' ORDER BY license) AS line_licenses, count(*) AS license_lines
             FROM lines JOIN known ON digest = sha256(form) WHERE form <> '' GROUP BY text),
    texts AS (SELECT doc_id, text, sha256({whole}) AS text_digest FROM rows)
    SELECT doc_id, text_digest, k.license, line_licenses, coalesce(license_lines, 0)::BIGINT AS license_lines
    FROM texts t LEFT JOIN known k ON k.digest = t.text_digest LEFT JOIN hits h ON h.text = t.text"""
