"""License notices: MinHash bands over overlapping windows retrieve templates, exact containment verifies them."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Short notices as they are commonly worded, and the texts and file headers that licenses ask for.
NOTICES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "MIT": "Released under the MIT License.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "LGPL-3.0": "Distributed under the terms of the GNU Lesser General Public License, version 3.",
    "AGPL-3.0": "Covered by the GNU Affero General Public License, version 3.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "Dedicated to the public domain under CC0 1.0 Universal.",
    "ISC": "Permission to use, copy, modify, and distribute this software for any purpose is hereby granted.",
    "MIT text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
        'substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING '
        "BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE "
        "AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, "
        "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "ISC text": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that "
        'the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS '
        "ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE "
        "AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA "
        "OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR "
        "PERFORMANCE OF THIS SOFTWARE."
    ),
    "BSD-2-Clause text": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions "
        "are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following "
        "disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following "
        "disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT "
        'HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF '
        "MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."
    ),
    "Apache-2.0 header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You '
        "may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        'writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, '
        "either express or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "GPL-3.0-or-later header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published "
        "by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in "
        "the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A "
        "PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public "
        "License along with this program."
    ),
    "MPL-2.0 header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
        "file, You can obtain one at https://mozilla.org/MPL/2.0/."
    ),
}
WORDS = 5
CONTAINMENT = 0.8
#: Bands of one row. A window that holds 0.8 of a template's shingles has a Jaccard similarity of 0.55 or more with it,
#: and misses all bands with chance (1 - 0.55)^24 = 5e-9.
BANDS = 24
#: Templates are broadcast, so there is a limit on their number.
MOST_TEMPLATES = 10_000


def words(text: Column) -> Column:
    """Lower-cased runs of ASCII letters and digits."""
    return F.regexp_extract_all(F.lower(F.coalesce(text.cast("string"), F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def shingle(w: Column, i: Column) -> Column:
    return F.xxhash64(*(F.get(w, i + j) for j in range(WORDS)))


def shingle_set(w: Column) -> Column:
    """Hashes of the distinct shingles of a word array; none if it has fewer than WORDS words."""
    at = F.when(F.size(w) >= WORDS, F.sequence(F.lit(0), F.size(w) - WORDS)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(at, lambda i: shingle(w, i)))


def _row(j: int):
    return lambda x: F.xxhash64(x, F.lit(j))


def _marked(j: int):
    return lambda x: F.struct(F.xxhash64(x, F.lit(j)).alias("v"), x.alias("x"))


def signature(h: Column) -> Column:
    """BANDS minima of a nonempty shingle set."""
    return F.array(*(F.array_min(F.transform(h, _row(j))) for j in range(BANDS)))


def template_table(spark: SparkSession, notices: dict[str, str]) -> DataFrame:
    """license, n_words, step, span, shingles, signature and the shingles that give the signature, a row each."""
    if len(notices) > MOST_TEMPLATES:
        raise ValueError(f"more than {MOST_TEMPLATES} templates")
    t = spark.createDataFrame(sorted(notices.items()), "license string, notice string")
    t = t.withColumn("w", words(F.col("notice"))).where(F.size("w") >= WORDS)
    t = t.select("license", F.size("w").alias("n_words"), shingle_set(F.col("w")).alias("shingles"))
    t = t.withColumn("step", F.greatest(F.lit(1), F.expr("n_words div 4").cast("int")))
    t = t.withColumn("span", F.col("n_words") + F.col("step") - 1).withColumn("signature", signature(F.col("shingles")))
    marked = [F.transform("shingles", _marked(j)) for j in range(BANDS)]
    least = [F.array_min(m)["x"] for m in marked]
    return t.withColumn("least", F.array_distinct(F.array(*least)))


def scan_licenses(docs: DataFrame, notices: dict[str, str] | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents that hold a notice: doc_id, license, containment (the best), n_windows, first_word.

    For a template of n words, windows of n + s - 1 words start at every s-th word, s = max(1, n div 4), so each
    occurrence lies whole in one. A window's candidates are the templates that agree with it in a band; one that holds
    CONTAINMENT or more of a candidate's distinct shingles is a match. n_windows counts matches and first_word is the
    start of the first one. A window agrees in a band only if it holds the shingle that gives the template's minimum
    there, so windows without any of these are passed over before signatures are computed; none is lost by that.

    Null, empty and short texts (under WORDS words) match nothing. Rows that share an id count as one document. Null
    ids are reported under null. Templates of fewer than WORDS words are left out. Empty table: no rows. Other
    columns are not carried.
    """
    spark = docs.sparkSession
    t = template_table(spark, NOTICES if notices is None else notices)
    d = docs.select(F.col(key).alias("doc_id"), words(F.col(text)).alias("w")).where(F.size("w") >= WORDS)
    hits = d.select("doc_id", "w", F.explode(F.sequence(F.lit(0), F.size("w") - WORDS)).alias("at"))
    hits = hits.withColumn("x", shingle(F.col("w"), F.col("at")))
    spans = t.select(F.explode("least").alias("x"), "span", "step").distinct()
    hits = hits.join(F.broadcast(spans), "x")
    # the windows of this grid that hold the whole shingle
    last = F.expr("at div step").cast("int")
    first = F.greatest(F.lit(0), F.ceil((F.col("at") + WORDS - F.col("span")) / F.col("step")).cast("int"))
    windows = hits.select("doc_id", "w", "span", "step", F.explode(F.when(first <= last, F.sequence(first, last))).alias("k"))
    windows = windows.select("doc_id", "span", "step", (F.col("k") * F.col("step")).alias("at"), F.slice("w", F.col("k") * F.col("step") + 1, F.col("span")).alias("w"))
    windows = windows.distinct().withColumn("h", shingle_set(F.col("w")))
    bands = windows.select("doc_id", "span", "step", "at", "h", F.posexplode(signature(F.col("h"))).alias("band", "value"))
    known = t.select("license", "span", "step", "shingles", F.posexplode("signature").alias("band", "value"))
    found = bands.join(F.broadcast(known), ["span", "step", "band", "value"])
    found = found.groupBy("doc_id", "license", "at", "h", "shingles").agg(F.count("*").alias("agreeing"))
    held = F.size(F.array_intersect("h", "shingles")) / F.size("shingles")
    found = found.withColumn("containment", held).where(F.col("containment") >= CONTAINMENT)
    return found.groupBy("doc_id", "license").agg(
        F.max("containment").alias("containment"), F.countDistinct("at").alias("n_windows"), F.min("at").cast("int").alias("first_word")
    )


def _oracle() -> str:
    values = ", ".join(f"('{name}', '{text.replace(chr(39), chr(39) * 2)}')" for name, text in sorted(NOTICES.items()))
    at = " || ' ' || ".join(f"w[i + {j}]" for j in range(1, WORDS + 1))
    return f"""
WITH t0 AS (SELECT license, regexp_extract_all(lower(notice), '[a-z0-9]+') AS w FROM (VALUES {values}) v(license, notice)),
t AS (SELECT license, len(w) AS n, greatest(1, len(w) // 4) AS step,
    list_distinct(list_transform(range(len(w) - {WORDS - 1}), lambda i: {at})) AS s FROM t0 WHERE len(w) >= {WORDS}),
ts AS (SELECT license, n, step, len(s) AS m, unnest(s) AS x FROM t),
d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(len(w) - {WORDS - 1})) AS i FROM d WHERE len(w) >= {WORDS}),
x AS (SELECT doc_id, i, {at} AS x FROM p),
hit AS (SELECT DISTINCT doc_id, i, x, license, n, step, m FROM x JOIN ts USING (x)),
win AS (SELECT doc_id, license, m, x, unnest(range(greatest(0, CAST(ceil((i + {WORDS} - (n + step - 1)) / step::DOUBLE) AS BIGINT)), i // step + 1)) * step AS pos FROM hit),
c AS (SELECT doc_id, license, pos, count(DISTINCT x) / max(m)::DOUBLE AS containment FROM win GROUP BY ALL)
SELECT doc_id, license, max(containment) AS containment, count(DISTINCT pos) AS n_windows, CAST(min(pos) AS INTEGER) AS first_word
FROM c WHERE containment >= {CONTAINMENT} GROUP BY doc_id, license
"""


ORACLE_SQL = _oracle()
assert math.isclose(0.8 / (1.25 + 0.2), 0.55, abs_tol=0.01)
