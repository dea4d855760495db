"""License scans: MinHash bands over overlapping text windows, then exact containment.

Templates and texts are lower-cased and cut into words of letters and digits; shingles are
``SHINGLE`` consecutive words, hashed to 64 bits.  A text is covered by windows of shingles,
one family for each size class of templates (powers of two), overlapping so that any passage
of a template's length lies inside a window at most twice as long: windows of 2 s shingles
begin at every multiple of s.

*Bands.*  A window's signature has ``PERMUTATIONS`` min-hashes, one row a band.  A template
and a window that holds 0.8 of it have Jaccard similarity of at least 0.8 m / (2 s + 0.2 m)
with m > s / 2, i.e. above 0.18; with 40 bands of one row the chance to share none is below
(1 - 0.18)^40 = 0.04 %, and 1e-6 where the passage is whole and fills its class.  Templates
of one shingle collide always.

A band of one row collides only if the window holds the template's minimal shingle of that
permutation.  So windows are formed only where a text has a shingle of some template at
all, which loses no collision: texts without such shingles, most of them, are done after
one pass over their words.  Up to ``inline`` template shingles are constants of the plan;
beyond, the texts' shingles meet them by a join.

*Verification.*  For every retrieved (window, template), the share of the template's distinct
shingles that the window holds, exactly; matches reach ``threshold``.  Of the windows of a
document that match a template, the best (then first) is reported.

Defined cases: null and empty texts match nothing; a template of fewer words than a shingle
is refused; repeated rows come out as often; no documents give no rows; other columns, of any
name, are ignored.  A long text is held as the hashes of its words and shingles; of its windows
only those that may match, each with its own shingles.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.text import columns_of
from quern.operators.null_safe import null_safe_join
from quern.scratch import Scratch

SHINGLE = 5
PERMUTATIONS = 40

#: Notices by which texts name their license, and whole licenses, by SPDX identifier.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "MIT-licensed": "Licensed under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "BSD-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "MPL-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
    ),
    "BSD-2-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
        "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
    ),
    "Unlicense": (
        "This is free and unencumbered software released into the public domain. "
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. "
        "In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law."
    ),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: "
        "1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. "
        "2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. "
        "3. This notice may not be removed or altered from any source distribution."
    ),
    "ISC-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
}

_BREAKS = r"[^\p{L}\p{N}]+"


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), _BREAKS), lambda w: w != "")


def _shingles(words: Column, counted: Column) -> Column:
    """Hashes of the shingles of an array of word hashes, in order."""
    return F.when(counted < SHINGLE, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.greatest(counted - SHINGLE + 1, F.lit(1))), lambda i: F.xxhash64(F.slice(words, i, SHINGLE))))


def hashed(docs: DataFrame, *keep: str) -> DataFrame:
    """``keep``, row (a number) and s: the shingle hashes of each text.

    The number keeps filters on s from being pushed below it, where the words of a text would be
    made anew for each shingle.
    """
    words = docs.select(*keep, F.transform(_words(F.col("text")), lambda w: F.xxhash64(w)).alias("w"))
    return words.select(*keep, F.monotonically_increasing_id().alias("row"), _shingles(F.col("w"), F.size("w")).alias("s"))


def template_table(spark, templates: dict[str, str]) -> DataFrame:
    """license, size (class), m (distinct shingles) and t (their hashes) of each template."""
    short = [n for n, t in templates.items() if len(re.findall(r"[^\W_]+", t)) < SHINGLE]
    if short:
        raise ValueError(f"templates of fewer than {SHINGLE} words: {short}")
    texts = spark.createDataFrame(list(templates.items()), "license string, text string")
    distinct = hashed(texts, "license").select("license", F.array_distinct("s").alias("t"))
    size = F.pow(F.lit(2.0), F.ceil(F.log2(F.size("t").cast("double")))).cast("int")
    return distinct.select("license", size.alias("size"), F.size("t").alias("m"), "t")


def _signature(shingles: Column) -> Column:
    """For each permutation, the smallest hash of (permutation, shingle)."""
    return F.transform(F.sequence(F.lit(1), F.lit(PERMUTATIONS)), lambda k: F.struct(
        k.alias("band"), F.array_min(F.transform(shingles, lambda h: F.xxhash64(h, k))).alias("low")))


def _windows_of(size: int) -> Column:
    """Begin, size class and distinct shingles of the windows that hold one of the shingles at ``hits``."""
    multiple = lambda i: F.floor(i / size)
    at = F.array_distinct(F.flatten(F.transform("hits", lambda i: F.array(multiple(i), F.greatest(multiple(i) - 1, F.lit(0))))))
    return F.transform(at, lambda k: F.struct((k * size).cast("int").alias("at"), F.lit(size).alias("size"), F.array_distinct(F.slice("s", (k * size + 1).cast("int"), 2 * size)).alias("h")))


def _near(docs: DataFrame, known: DataFrame, constants: list[int] | None) -> DataFrame:
    """row, doc_id, th, s and hits (the places of template shingles) of the texts that have any."""
    keyed = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
    if constants is not None:
        places = F.filter(F.transform("s", lambda h, i: F.when(h.isin(constants), i)), lambda i: i.isNotNull())
        return hashed(keyed, "doc_id", "th").select("row", "doc_id", "th", "s", places.alias("hits")).where(F.size("hits") > 0)
    wanted = known.select(F.explode("t").alias("h")).distinct()
    each = hashed(keyed, "doc_id", "th").select("doc_id", "th", F.posexplode("s").alias("i", "h"))
    places = each.join(wanted, "h", "left_semi").groupBy("doc_id", "th").agg(F.sort_array(F.collect_set("i")).alias("hits"))
    met = null_safe_join(keyed, places, ["doc_id", "th"])
    return hashed(met, "doc_id", "th", "hits").select("row", "doc_id", "th", "s", "hits")


def scan(docs: DataFrame, scratch: Scratch, templates: dict[str, str] | None = None, threshold: float = 0.8, inline: int = 20_000) -> DataFrame:
    """doc_id, th (hash of the text), license, containment, first_shingle: one row for each license of each row of ``docs``."""
    known = template_table(docs.sparkSession, templates or TEMPLATES)
    rows = known.select("size", "m", "t").collect()  # as large as the parameter, which is here already
    few = sum(r["m"] for r in rows) <= inline
    sizes = sorted({r["size"] for r in rows})
    numbered = scratch.cut(_near(columns_of(docs, "doc_id", "text"), known, sorted({h for r in rows for h in r["t"]}) if few else None), "near")
    # of each size class s, the windows [s k, s k + 2 s) that hold a hit: k and k - 1 for a hit at s k
    windows = numbered.select("row", "doc_id", "th", F.explode(F.flatten(F.array(*map(_windows_of, sizes)))).alias("w"))
    windows = windows.select("row", "doc_id", "th", "w.at", "w.size", "w.h")
    banded = windows.select("row", "doc_id", "th", "at", "size", "h", F.explode(_signature(F.col("h"))).alias("b"))
    bands = known.select("license", "size", F.explode(_signature(F.col("t"))).alias("b")).select("license", "size", "b.band", "b.low")
    retrieved = banded.select("row", "doc_id", "th", "at", "size", "h", "b.band", "b.low").join(F.broadcast(bands) if few else bands, ["size", "band", "low"])
    met = retrieved.join(known.select("license", "m", "t"), "license")
    contained = F.size(F.array_intersect("h", "t")) / F.col("m")
    first = F.col("at") + F.array_min(F.transform("t", lambda h: F.when(F.array_position("h", h) > 0, F.array_position("h", h) - 1)))
    matched = met.select("row", "doc_id", "th", "license", contained.alias("containment"), first.cast("long").alias("first_shingle")).where(F.col("containment") >= threshold)
    best = matched.groupBy("row", "license").agg(F.max(F.struct("containment", (-F.col("first_shingle")).alias("first"), "doc_id", "th")).alias("x"))
    return best.select("x.doc_id", "x.th", "license", "x.containment", (-F.col("x.first")).alias("first_shingle"))


def op1_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"), Scratch(spark)).select("doc_id", "license", "containment")


_VALUES = ", ".join("('{}', '{}')".format(n, t.replace("'", "''")) for n, t in TEMPLATES.items())
#: The same in DuckDB, by the words of the shingles, for the templates above.
OP1_SQL = f"""
WITH T0(license, text) AS (VALUES {_VALUES}),
T1 AS (SELECT license, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w FROM T0),
T2 AS (SELECT DISTINCT license, list_slice(w, p, p + 4) AS g FROM (SELECT license, w, unnest(range(1, len(w) - 3)) AS p FROM T1)),
M AS (SELECT license, count(*) AS m, CAST(pow(2, ceil(log2(count(*)))) AS BIGINT) AS size FROM T2 GROUP BY license),
D1 AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w FROM documents),
D2 AS (SELECT doc_id, p - 1 AS p, list_slice(w, p, p + 4) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS p FROM D1 WHERE len(w) >= 5)),
H AS (SELECT doc_id, license, g, p // size AS k, m FROM D2 JOIN T2 USING (g) JOIN M USING (license)),
K AS (SELECT doc_id, license, g, k, m FROM H UNION ALL SELECT doc_id, license, g, k - 1, m FROM H WHERE k > 0),
C AS (SELECT doc_id, license, k, count(DISTINCT g) / max(m) AS containment FROM K GROUP BY doc_id, license, k)
SELECT doc_id, license, max(containment) AS containment FROM C WHERE containment >= 0.8 GROUP BY doc_id, license
"""


def brute_force(rows: list[tuple[int | None, str | None]], templates: dict[str, str] | None = None, threshold: float = 0.8) -> set[tuple]:
    """(doc_id, license) of texts with a window of the template's class that holds ``threshold`` of it; for tests."""
    import regex

    def shingles(text):
        w = [x for x in regex.split(r"[^\p{L}\p{N}]+", (text or "").lower()) if x]
        return [tuple(w[i : i + SHINGLE]) for i in range(len(w) - SHINGLE + 1)]

    out = set()
    for name, template in (templates or TEMPLATES).items():
        t = set(shingles(template))
        size = 1 << (len(t) - 1).bit_length()
        for doc_id, text in rows:
            s = shingles(text)
            if any(len(t & set(s[a : a + 2 * size])) >= threshold * len(t) for a in range(0, max(len(s), 1), size)):
                out.add((doc_id, name))
    return out
