"""Licence scan by canonical digests.

A text is brought to canonical form (case, copyright lines, punctuation, white
space, equivalent spellings), and its digest is looked up among those of known
licence texts.  Whole texts give ``whole_text``; single lines are looked up alike, apart
from them (``line_licenses``), so a notice that ends a document is found too.
Long licences are known by their digest alone.  DataFrame functions only: the known digests
are a table, broadcast behind a check of its size, else both sides shuffle.

Defined cases: null or empty texts match nothing; repeated rows give their rows;
a licence found in several lines counts each; a digest that several licences
share names them all, joined by OR; a null doc_id is carried through;
extra columns are ignored; an empty list of known texts gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import materialize, sized_broadcast

#: Spellings that count as equal, in the order of replacement (fixed values).
SPELLINGS = [
    ("licence", "license"),
    ("sub license", "sublicense"),
    ("non infringement", "noninfringement"),
    ("organisation", "organization"),
    ("favour", "favor"),
    ("https", "http"),
    ("per cent", "percent"),
]
#: Lines that are copyright statements alone.
COPYRIGHT = r"(?im)^[^a-z0-9\n]*(?:copyright|\(c\)|©)[^\n]*$"

#: Known texts (fixed values): whole licences and the notices that refer to one.
KNOWN = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License");'),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "Licensed under the GNU General Public License, version 2."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is released under the MIT License."),
    ("MIT", "Released under the MIT license."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("LicenseRef-all-rights-reserved", "All rights reserved."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0."),
    (
        "MIT",
        "MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "Zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:\n\n1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.\n2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.\n3. This notice may not be removed or altered from any source distribution.",
    ),
]


#: Digests (md5 of the canonical form) and lengths of whole published licences (fixed values).
DIGESTS = [
    ("Apache-2.0", "3f4bdf128d873ad53471b7e9441114d0", 9700),
    ("Artistic-1.0-Perl", "6f45651e3e829ff0f6d4fc9f04384095", 5626),
    ("BSD-3-Clause", "6989781d8e3e31bf06f590dd203d4e65", 1381),
    ("CC0-1.0", "d2a76f70ce19809695b7fb93c6241c23", 6691),
    ("GFDL-1.2", "fd920ddc37a3d7e8c50763b83c95353c", 19514),
    ("GFDL-1.3", "69253b6f159e4a07012cc5d95badaa85", 21882),
    ("GPL-1.0", "e64afbb3eb9ed9907294af675f791aba", 11702),
    ("GPL-2.0", "e374d0b43c25aed1a2b28951fe92a546", 17053),
    ("GPL-3.0", "3d166aeeeb2ec1fea896f0a01f69dc5c", 33204),
    ("LGPL-2.0", "7d054715126defc8a18808a6934f14a4", 23874),
    ("LGPL-2.1", "519c5306e9399a753b0e3b10cc3f1fbd", 24961),
    ("LGPL-3.0", "b31b7335bc37919e8cdd79154e04d88d", 7104),
    ("MIT", "90a17991c3ba7b04d183a6467fbe3449", 988),
    ("MIT", "66dd1caf442553ce09fa72a9da2e8c0e", 1008),
    ("MPL-1.1", "a708f02208e9c42d3644490185833425", 22339),
    ("MPL-2.0", "35fb4d2625087f7fd780039aa7b4ebb2", 14271),
]


def canonical(text: Column) -> Column:
    """The canonical form; an empty string if nothing is left."""
    out = F.lower(F.regexp_replace(text, COPYRIGHT, ""))
    out = F.trim(F.regexp_replace(out, "[^a-z0-9]+", " "))
    for a, b in SPELLINGS:
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def digests(known: DataFrame) -> DataFrame:
    """license, digest, length of known(license, text)."""
    forms = known.select("license", canonical(F.col("text")).alias("c")).where("c <> ''")
    return forms.select("license", F.md5("c").alias("digest"), F.length("c").alias("length"))


def known_texts(spark: SparkSession) -> DataFrame:
    """license, digest, length of the licences above."""
    return digests(spark.createDataFrame(KNOWN, "license string, text string")).unionByName(spark.createDataFrame(DIGESTS, "license string, digest string, length int"))


def find_licenses(docs: DataFrame, known: DataFrame) -> DataFrame:
    """doc_id, whole_text (licence or null), line_licenses, n_lines for each row of docs(doc_id, text) with a match; known(license, digest, length)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text <> ''")
    known = known.groupBy("digest").agg(F.array_join(F.array_sort(F.collect_set("license")), " OR ").alias("license"), F.max("length").alias("length"))
    known = materialize(known, "known")
    # A line has to be as long as its canonical form, and a text as the shortest.
    shortest = known.agg(F.coalesce(F.min("length"), F.lit(1 << 30))).first()[0] - 16
    keyed = docs.withColumn("row_key", F.xxhash64("doc_id", "text"))
    lines = keyed.select("row_key", F.posexplode(F.split("text", "\n")).alias("line", "unit")).where(F.length("unit") >= shortest)
    units = lines.unionByName(keyed.select("row_key", F.lit(-1).alias("line"), F.col("text").alias("unit")).where(F.contains("unit", F.lit("\n"))))
    # Texts of one line are their line.
    digests = units.select("row_key", "line", F.md5(canonical(F.col("unit"))).alias("digest"))
    hits = digests.join(sized_broadcast(known.select("digest", "license"), 100), "digest").distinct()
    whole = F.max(F.when(F.col("line") < 0, F.col("license")))
    found = hits.groupBy("row_key").agg(whole.alias("whole_text"), F.array_sort(F.collect_set(F.when(F.col("line") >= 0, F.col("license")))).alias("line_licenses"), F.count_if(F.col("line") >= 0).alias("n_lines"))
    found = materialize(found, "licenses")
    one = ~F.contains("text", F.lit("\n"))
    return keyed.join(sized_broadcast(found, 120), "row_key").select("doc_id", F.when(one, F.get("line_licenses", F.lit(0))).otherwise(F.col("whole_text")).alias("whole_text"), F.array_join("line_licenses", ",").alias("line_licenses"), F.col("n_lines").cast("long").alias("n_lines"))


def oracle() -> str:
    """The same in DuckDB SQL."""

    def form(text: str) -> str:
        out = f"trim(regexp_replace(lower(regexp_replace({text}, '(?im)^[^a-z0-9\\n]*(?:copyright|\\(c\\)|©)[^\\n]*$', '', 'g')), '[^a-z0-9]+', ' ', 'g'))"
        for a, b in SPELLINGS:
            out = f"replace({out}, '{a}', '{b}')"
        return out

    rows = ", ".join("('{}', '{}')".format(a, b.replace("'", "''")) for a, b in KNOWN)
    more = ", ".join(f"('{a}', '{b}')" for a, b, _ in DIGESTS)
    return f"""
with forms as (select license, md5(c) as digest from (select license, {form("text")} as c from (values {rows}) as t(license, text)) where c <> '' union all select * from (values {more}) as t(license, digest)),
known as (select digest, string_agg(distinct license, ' OR ' order by license) as license from forms group by digest),
split as (select doc_id, text, string_split(text, chr(10)) as lines from documents where text <> ''),
units as (
  select doc_id, text, i as line, lines[i] as unit from split, unnest(range(1, len(lines) + 1)) as r(i)
  union all select doc_id, text, -1, text from split
), hits as (select doc_id, text, line, license from units join known on md5({form("unit")}) = known.digest)
select doc_id, max(license) filter (where line < 0) as whole_text,
  coalesce(array_to_string(list_sort(list(distinct license) filter (where line >= 0)), ','), '') as line_licenses, count(*) filter (where line >= 0) as n_lines
from hits group by doc_id, text
"""
