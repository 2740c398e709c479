"""License scans: MinHash bands over overlapping windows retrieve templates, exact shingle containment verifies. DataFrame operations only.

Templates are a table. Those of like length make a class, with windows so long and so near each other that every
stretch in which a template of the class can lie stands whole in one. A window's shingle hashes are sorted, and the
first of each band of the hash range is that band's MinHash, so that one hash function serves all bands; templates that
share the value of a band are retrieved. The number of bands is set by how likely a window must be to meet its template.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import written

SHINGLE = 5
CONTAINMENT = 0.8
#: Bound on the chance that the bands miss a window that contains a template.
MISS = 1e-4
#: Longest templates, in words, of the smallest class and of each further one by this factor.
SMALLEST, FACTOR = 32, 8
#: Shingles of templates that are broadcast at once; more are gone through in parts.
BROADCAST_SHINGLES = 1_000_000

_CC = "This work is licensed under a Creative Commons {} 4.0 International License."
_GNU = (
    "This {} is free software: you can redistribute it and/or modify it under the terms of the GNU {} General Public License as published "
    "by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution."
)
_AS_IS = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF "
    "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY "
    "CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE "
    "SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
    "\"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, "
    "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to "
    "the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
)

#: License notices in their usual wording. Of notices of one family, which differ by a name or number, a window shows the best alone.
TEMPLATES = [
    ("Apache-2.0", "short Apache", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0 notice",
        "Apache",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        "writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, "
        "either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ),
    ("MIT", "short MIT", "Released under the MIT License."),
    ("MIT notice", "MIT", _MIT),
    ("MIT text", "MIT text", f"{_MIT} {_AS_IS}"),
    ("BSD-2-Clause", "short BSD", "Released under the BSD 2-Clause License."),
    ("BSD-3-Clause", "short BSD", "Released under the BSD 3-Clause License."),
    ("BSD-2-Clause text", "BSD", _BSD),
    (
        "BSD-3-Clause text",
        "BSD third clause",
        f"{_BSD} Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
        "software without specific prior written permission.",
    ),
    (
        "ISC text",
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
        "copyright notice and this permission notice appear in all copies.",
    ),
    (
        "Zlib text",
        "Zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising "
        "from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to "
        "alter it and redistribute it freely, subject to the following restrictions:",
    ),
    ("GPL-2.0", "short GPL", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "short GPL", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0 notice", "GPL", _GNU.format("program", "", "2")),
    ("GPL-3.0 notice", "GPL", _GNU.format("program", "", "3")),
    ("LGPL-2.1 notice", "GPL", _GNU.format("library", "Lesser", "2.1")),
    ("LGPL-3.0 notice", "GPL", _GNU.format("library", "Lesser", "3")),
    ("AGPL-3.0 notice", "GPL", _GNU.format("program", "Affero", "3")),
    (
        "MPL-2.0 notice",
        "MPL",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You "
        "can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    (
        "EPL-2.0 notice",
        "EPL",
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at "
        "https://www.eclipse.org/legal/epl-2.0/.",
    ),
    ("BSL-1.0 notice", "BSL", "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt)"),
    ("CC-BY-4.0", "short CC", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "short CC", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "short CC", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "short CC", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-NC-SA-4.0", "short CC", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-NC-ND-4.0", "short CC", "Licensed under CC BY-NC-ND 4.0."),
    ("CC-BY-4.0 notice", "CC", _CC.format("Attribution")),
    ("CC-BY-SA-4.0 notice", "CC", _CC.format("Attribution-ShareAlike")),
    ("CC-BY-NC-4.0 notice", "CC", _CC.format("Attribution-NonCommercial")),
    ("CC-BY-ND-4.0 notice", "CC", _CC.format("Attribution-NoDerivatives")),
    ("CC-BY-NC-SA-4.0 notice", "CC", _CC.format("Attribution-NonCommercial-ShareAlike")),
    ("CC-BY-NC-ND-4.0 notice", "CC", _CC.format("Attribution-NonCommercial-NoDerivatives")),
    (
        "CC0-1.0 notice",
        "CC0",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    ),
    (
        "Unlicense text",
        "Unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute "
        "this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
    (
        "GFDL-1.3 notice",
        "GFDL",
        "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.3 or any "
        "later version published by the Free Software Foundation; with no Invariant Sections, no Front-Cover Texts, and no Back-Cover Texts.",
    ),
    ("OFL-1.1 notice", "OFL", "This Font Software is licensed under the SIL Open Font License, Version 1.1."),
]


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits; an empty array for null."""
    plain = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    return F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(plain, " "))


def shingles(array: Column) -> Column:
    """64-bit hashes of the five-word shingles, in order; of fewer words, none."""
    hashed = F.transform(F.sequence(F.lit(0), F.size(array) - SHINGLE), lambda i: F.xxhash64(*[F.get(array, i + j) for j in range(SHINGLE)]))
    return F.when(F.size(array) >= SHINGLE, hashed).otherwise(F.array().cast("array<bigint>"))


def layout(number: int) -> tuple[int, int, int]:
    """For class `number`: the shingles in a window, the step between windows and the bits that name a band.

    A stretch that contains a template of n words by CONTAINMENT may be n / CONTAINMENT words long; each such stretch
    stands whole in a window. At least `held` of the smallest template's shingles are in it. With windows of w shingles
    and B bands, about w / B fall into a band, and a shingle is the first of its band with the chance
    (1 - exp(-w / B)) / (w / B). The bands are the fewest with which none of the `held` is with a chance of MISS at most.
    """
    most = SMALLEST * FACTOR**number
    step = 2 * most
    window = math.ceil(most / CONTAINMENT) + step - 1 - SHINGLE + 1
    fewest = SHINGLE if number == 0 else most // FACTOR + 1
    held = math.ceil(CONTAINMENT * (fewest - SHINGLE + 1))
    bits = 1
    while True:
        load = window / (1 << bits)
        if (1 - (1 - math.exp(-load)) / load) ** held <= MISS:
            return window, step, bits
        bits += 1


def banded(ordered: Column, bits: Column) -> Column:
    """The least hash of each band of a sorted array; a band is the hashes whose first `bits` bits agree."""
    band = lambda h: F.call_function("shiftrightunsigned", h, F.lit(64) - bits)
    return F.filter(ordered, lambda h, i: F.coalesce(band(h) != band(F.get(ordered, i - 1)), F.lit(True)))


def _windows(size: Column, number: int, inside: int, step: int, bits: int) -> Column:
    """Where the windows of a class begin among `size` shingles."""
    begin = F.sequence(F.lit(0), F.greatest(size - inside + step - 1, F.lit(0)), F.lit(step))
    return F.transform(begin, lambda at: F.struct(F.lit(number).alias("class"), at.alias("at"), F.lit(inside).alias("inside"), F.lit(bits).alias("bits")))


def template_table(spark, templates: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(templates, "license string, family string, text string")


def license_scan(docs: DataFrame, templates: DataFrame | None = None) -> DataFrame:
    """One row per document and template found in it: doc_id, license, containment (the best window's), places (windows it is found in).

    A template (license, family, text) is found where a window holds at least 0.8 of its distinct five-word shingles; of
    the templates of a family, a window shows those that it holds best. Templates of fewer than five words can't be found.
    Null and empty texts hold nothing. Repeated rows of one doc_id count together, as do rows without an id. An empty
    table gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    templates = template_table(spark, TEMPLATES) if templates is None else templates
    known = templates.select("license", "family", words(F.col("text")).alias("words"))
    number = F.ceil(F.log(F.size("words") / F.lit(SMALLEST)) / math.log(FACTOR) - 1e-9)
    known = known.select("license", "family", F.greatest(number, F.lit(0)).cast("int").alias("class"), F.array_distinct(shingles(F.col("words"))).alias("wanted"))
    known = written(known.where(F.size("wanted") > 0), "license-templates")
    classes = sorted(r["class"] for r in known.select("class").distinct().collect())  # one a factor of length
    if not classes:
        return spark.createDataFrame([], "doc_id long, license string, containment double, places long")
    layouts = {c: layout(c) for c in classes}
    pick = lambda at: F.element_at(F.create_map(*[F.lit(x) for c in classes for x in (c, layouts[c][at])]), F.col("class"))
    index = known.withColumn("ordered", F.array_sort("wanted")).withColumn("bits", pick(2))
    index = written(index.select("license", "class", F.explode(banded(F.col("ordered"), F.col("bits"))).alias("value")), "license-index")
    parts = -(-known.agg(F.sum(F.size("wanted"))).first()[0] // BROADCAST_SHINGLES)

    # Exploding a single value keeps the optimizer from pasting its expression into what uses it, once for each element.
    found = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.explode(F.array(words(docs["text"]))).alias("words"))
    found = found.select("doc_id", "row", F.explode(F.array(shingles(F.col("words")))).alias("all")).where(F.size("all") > 0)
    windows = F.concat(*[_windows(F.size("all"), c, *layouts[c]) for c in classes])
    found = found.select("doc_id", "row", "all", F.explode(windows).alias("w")).select("doc_id", "row", "w.class", "w.at", "w.bits", F.slice("all", F.col("w.at") + 1, F.col("w.inside")).alias("held"))
    found = found.select("doc_id", "row", "class", "at", "bits", "held", F.explode(F.array(F.array_sort("held"))).alias("ordered"))
    found = found.select("doc_id", "row", "class", "at", "held", F.explode(banded(F.col("ordered"), F.col("bits"))).alias("value"))
    hits = None
    for part in range(parts):
        here = F.pmod(F.xxhash64("license"), F.lit(parts)) == part
        met = found.join(F.broadcast(index.where(here)), ["class", "value"])
        share = F.size(F.array_intersect("held", "wanted")) / F.size("wanted")
        hit = met.join(F.broadcast(known.where(here).drop("class")), "license").select("doc_id", "row", "class", "at", "family", "license", share.alias("containment"))
        hit = hit.where(F.col("containment") >= CONTAINMENT)
        hits = hit if hits is None else hits.unionByName(hit)
    hits = hits.distinct().withColumn("best", F.max("containment").over(W.partitionBy("row", "class", "at", "family"))).where("containment = best")
    return hits.groupBy("doc_id", "license").agg(F.max("containment").alias("containment"), F.countDistinct("row", "class", "at").alias("places"))
