"""License scan: MinHash bands over overlapping windows retrieve templates, exact containment verifies them.

Texts and templates are lower-cased words of letters and digits, in shingles of five. A template of t shingles is sought in
windows of L shingles, L the power of two with t <= L / 2, laid out at every L / 2: some window holds all of an
occurrence, and its Jaccard similarity to the template is at least 0.17 if three quarters of it are there. With bands
of one row each, `BANDS` = 48 of them collide in one at least with probability over 1 - (1 - 0.17)^48 = 0.9998. A window
that has no shingle of any template collides in no band, so documents and windows without one are passed over first;
nothing is lost by that. A match is a window that contains 75 % or more of the template's shingles;
where related templates (versions of one license) match overlapping windows, those of greatest containment stand. Built-in functions only.

Defined cases: null and empty texts match nothing; a text of fewer than five words is one shingle; a document that
matches a template in several windows gives one row, with the best containment and the place of the first word there that begins
a shingle of the template; rows equal in doc_id and text count as one document; an empty table gives no rows; extra
columns are ignored. Templates are a short list and may be broadcast; those of fewer than five words are no licence text and are passed over.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import keyed, stash

SHINGLE = 5
BANDS = 48
PERCENT = 75

# License statements as they are published.
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0-sentence": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "BSD-3-Clause-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "ISC-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "Zlib-text": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}


def shingled(df: DataFrame, text: str, out: str) -> DataFrame:
    w = F.array_remove(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+"), "")
    # the words are bound by a lambda, so that no plan puts their computation inside the one over shingles
    return df.withColumn(out, F.get(F.transform(F.array(F.transform(w, lambda x: F.xxhash64(x))), _shingles), F.lit(0)))


def _shingles(at: Column) -> Column:
    n = F.size(at)
    whole = F.aggregate(at, F.lit(0).cast("long"), lambda a, x: F.xxhash64(a, x))
    many = F.transform(F.sequence(F.lit(0), F.greatest(n - SHINGLE, F.lit(0))), lambda i: F.xxhash64(*(F.get(at, i + j) for j in range(SHINGLE))))
    return F.when(n >= SHINGLE, many).when(n > 0, F.array(whole)).otherwise(F.array().cast("array<long>"))


def relatives(rows: list) -> list[int]:
    """A number for each template that those share half their shingles with, such as versions of one license."""
    kin = list(range(len(rows)))
    for i, a in enumerate(rows):
        for j, b in enumerate(rows[:i]):
            if 2 * len({*a.parts} & {*b.parts}) >= min(len(a.parts), len(b.parts)):
                old, new = kin[i], kin[j]
                kin = [new if k == old else k for k in kin]
    return kin


def width(shingles: int) -> int:
    """Window of a template: the least power of two of which it fills at most half, four at least."""
    return max(4, 1 << (2 * shingles - 1).bit_length())


def signature(shingles: Column, bands: int = BANDS) -> Column:
    """The least hash of the shingles under each of `bands` hash functions."""
    return F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.array_min(F.transform(shingles, lambda x: F.xxhash64(x, i))))


def scan(docs: DataFrame, templates: dict[str, str] | None = None, bands: int = BANDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, license, containment, first_word (from 0), windows: a row for each document and template found in it."""
    spark = docs.sparkSession
    known = TEMPLATES if templates is None else templates
    listed = spark.createDataFrame([(k, v) for k, v in known.items()], "license string, words string")
    plates = shingled(listed, "words", "parts").withColumn("parts", F.array_distinct("parts")).drop("words").collect()  # the list above
    by_width: dict[int, list] = {}
    for r in plates:
        if r.parts and len(re.findall(r"\w+", known[r.license])) >= SHINGLE:
            by_width.setdefault(width(len(r.parts)), []).append(r)
    every = sorted({x for rows in by_width.values() for r in rows for x in r.parts})
    if not every:
        return spark.createDataFrame([], f"doc_id {dict(docs.dtypes)['doc_id']}, license string, containment double, first_word long, windows long")
    texts = shingled(keyed(docs.select("doc_id", "text")), "text", "sh").filter(F.arrays_overlap("sh", F.lit(every)))
    some = stash(texts.select("doc_id", "_id", "_h", "sh"))
    found = None
    for size, rows in sorted(by_width.items()):
        parts = F.lit(sorted({x for r in rows for x in r.parts}))
        starts = F.sequence(F.lit(0), F.greatest(F.size("sh") - 1, F.lit(0)), F.lit(size // 2))
        windows = F.filter(F.transform(starts, lambda s: F.struct(s.alias("start"), F.slice("sh", s + 1, size).alias("part"))), lambda w: F.arrays_overlap(w["part"], parts))
        cut = some.select("doc_id", "_id", "_h", F.explode(windows).alias("w")).select("doc_id", "_id", "_h", "w.start", F.col("w.part").alias("raw"), F.array_distinct("w.part").alias("part"))
        bands_of = cut.select("*", F.posexplode(signature(F.col("part"), bands)).alias("band", "value"))
        plate = spark.createDataFrame([(r.license, r.parts, kin) for r, kin in zip(rows, relatives(rows))], "license string, parts array<long>, kin int")
        plate = F.broadcast(plate.select("license", "parts", "kin", F.posexplode(signature(F.col("parts"), bands)).alias("band", "value")))
        hits = bands_of.join(plate, ["band", "value"]).dropDuplicates(["_id", "_h", "start", "license"])
        share = F.size(F.array_intersect("part", "parts")) / F.size("parts")
        own = F.transform(F.col("raw"), lambda x, i: F.when(F.array_contains("parts", x), i))
        word = F.col("start") + F.array_min(F.filter(own, lambda i: i.isNotNull()))
        here = hits.select("doc_id", "_id", "_h", "license", "kin", "start", word.alias("word"), share.alias("containment")).filter(F.col("containment") * 100 >= percent)
        around = Window.partitionBy("_id", "_h", "kin").orderBy("start").rangeBetween(1 - size, size - 1)
        here = here.withColumn("_best", F.max("containment").over(around)).filter("containment = _best").drop("_best", "kin")
        found = here if found is None else found.unionByName(here)
    best = found.groupBy("_id", "_h", "license").agg(F.first("doc_id").alias("doc_id"), F.max("containment").alias("containment"), F.min_by("word", F.struct(-F.col("containment"), "word")).cast("long").alias("first_word"), F.count("*").alias("windows"))
    return best.select("doc_id", "license", "containment", "first_word", "windows")
