"""License scan: MinHash bands over overlapping text windows find templates, exact shingle containment verifies them.

DataFrame operations only. Words are runs of letters and digits, lower-cased; a shingle is SHINGLE words. A text is cut
into windows of WINDOW shingles, STRIDE apart, and a template into all its windows (a shorter template is one window).
Each of BANDS bands holds one minimum (the shingles' hashes under a permutation). A window that holds a whole template
of n shingles has likeness n / WINDOW at least, 1 for longer templates, so one of the bands collides with probability
1 - (1 - n / WINDOW) ** BANDS: over 0.9999 for the shortest template, of 3 shingles. A hit counts if at least
`containment` of the template's shingles stand within the template's length around the window; of several templates at
one place the one with the best containment counts, then the longest.

Templates under SHINGLE words have no shingle; all their words must stand one after another. Null texts and empty texts:
no row. Several hits of a template in a text are one row with the best containment. Rows with equal doc_id count as one
document. Extra columns are ignored; ties take the least position. Very long texts are searched whole. An empty table
gives no row; a template without words is never found. Windows of templates are held on every executor up to MOST_WINDOWS;
beyond, they are searched in portions of as many.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

SHINGLE, WINDOW, STRIDE, BANDS = 3, 6, 2, 16
#: Windows of templates that are searched for at once.
MOST_WINDOWS = 20_000

#: Statements by which texts declare a licence, and the licence's SPDX identifier.
TEMPLATES = [
    ("MIT", "Released under the MIT License"),
    ("MIT", "This project is licensed under the terms of the MIT license"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("LGPL-2.1", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("AGPL-3.0", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("CC-BY-4.0", "licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-SA-4.0", "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"),
]


def word_hashes(text: Column) -> Column:
    """Hashes of the words of a text, in order."""
    words = F.filter(F.split(F.lower(text), "[^\\p{L}\\p{N}]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def shingle_at(hashes: Column, i: Column) -> Column:
    """The shingle that begins at word i (from 0), or the last one; never null, which keeps the generated code small
    enough to be compiled."""
    i = F.least(i, F.size(hashes) - SHINGLE)
    return F.xxhash64(*(F.get(hashes, i + k) for k in range(SHINGLE)))


def shingles(hashes: Column) -> Column:
    n = F.size(hashes) - SHINGLE + 1
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.xxhash64(*(F.get(hashes, i + k) for k in range(SHINGLE))))).otherwise(F.array().cast("array<bigint>"))


def minima(window: list[Column]) -> list[Column]:
    """One minimum a band; XOR with a constant permutes the hashes."""
    keys = [(0x9E3779B97F4A7C15 * (2 * b + 1)) % 2**64 for b in range(BANDS)]
    return [F.least(*(s.bitwiseXOR(F.lit(k - 2**64 if k >= 2**63 else k)) for s in window)) for k in keys]


def template_windows(templates: DataFrame) -> DataFrame:
    """template, license, shingles, words, and a row for each window of templates(template, license, h) with its BANDS minima."""
    t = templates.select("*", F.array_distinct(shingles(F.col("h"))).alias("shingles"), F.size("h").alias("words"))
    t = t.select("template", "license", "shingles", "words", "h", F.explode(F.sequence(F.lit(0), F.greatest(F.size("h") - SHINGLE + 1 - WINDOW, F.lit(0)))).alias("at"))
    return t.select("template", "license", "shingles", "words", *(m.alias(f"m{b}") for b, m in enumerate(minima([shingle_at(F.col("h"), F.col("at") + k) for k in range(WINDOW)]))))


def exact(docs: DataFrame, templates: DataFrame) -> DataFrame:
    """doc_id, at, license, template, words, containment of templates(template, license, h) of under SHINGLE words."""
    t = templates.select("license", "template", F.size("h").alias("words"), F.xxhash64(F.size("h"), *(F.get("h", F.lit(k)) for k in range(SHINGLE - 1))).alias("key"))
    lengths = [r.words for r in t.select("words").distinct().collect()]  # under SHINGLE
    d = docs.select("doc_id", word_hashes(F.col("text")).alias("h")).select("doc_id", "h", F.explode(F.when(F.size("h") > 0, F.sequence(F.lit(0), F.size("h") - 1))).alias("at"))
    key = lambda n: F.when(F.col("at") + n <= F.size("h"), F.xxhash64(F.lit(n), *(F.get("h", F.col("at") + k) if k < n else F.lit(None).cast("long") for k in range(SHINGLE - 1))))
    d = d.select("doc_id", "at", F.explode(F.array(*map(key, lengths))).alias("key"))
    return d.join(F.broadcast(t), "key").select("doc_id", "at", "license", "template", "words", F.lit(1.0).alias("containment"))


def scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None, containment: float = 0.8) -> DataFrame:
    """doc_id, license, template, containment, word (position of the first window that hit) of every statement found."""
    spark = docs.sparkSession
    given = [(k, a, b) for k, (a, b) in enumerate(TEMPLATES if templates is None else templates)]
    known = spark.createDataFrame(given, "template int, license string, text string").select("template", "license", word_hashes(F.col("text")).alias("h")).where(F.size("h") > 0)
    sizes = {r.template: r.n for r in known.select("template", F.size("h").alias("n")).collect()}
    hits = []
    if any(n < SHINGLE for n in sizes.values()):
        hits.append(exact(docs, known.where(F.size("h") < SHINGLE)))
    portion, windows = [], 0
    for k, n in sorted(sizes.items()):
        if n >= SHINGLE:
            portion.append(k)
            windows += max(1, n - SHINGLE + 2 - WINDOW)
        if portion and (windows >= MOST_WINDOWS or k == max(sizes)):
            hits.append(near(docs, known.where(F.col("template").isin(portion)), containment))
            portion, windows = [], 0
    if portion:
        hits.append(near(docs, known.where(F.col("template").isin(portion)), containment))
    if not hits:
        return docs.limit(0).select("doc_id", F.lit("").alias("license"), F.lit(0).alias("template"), F.lit(0.0).alias("containment"), F.lit(0).alias("word"))
    hits = reduce(DataFrame.unionByName, hits)
    # of the templates that fit one place (versions of one licence) the best and longest counts
    hits = hits.groupBy("doc_id", "at").agg(F.max_by(F.struct("license", "template", "containment"), F.struct("containment", "words", -F.col("template"))).alias("x")).select("doc_id", "at", "x.*")
    return hits.groupBy("doc_id", "license", "template").agg(F.max("containment").alias("containment"), F.min("at").alias("word"))


def near(docs: DataFrame, templates: DataFrame, containment: float) -> DataFrame:
    """doc_id, at, license, template, words, containment of templates(template, license, h), by bands and containment."""
    t = template_windows(templates)
    minimum = t.collect()  # MOST_WINDOWS, or one template's
    longest = max([r.words for r in minimum], default=SHINGLE)
    known = [sorted({r[f"m{b}"] for r in minimum}) for b in range(BANDS)]
    d = docs.select("doc_id", word_hashes(F.col("text")).alias("h"))
    starts = F.when(F.size("h") >= SHINGLE, F.sequence(F.lit(0), F.size("h") - SHINGLE, F.lit(STRIDE)))
    d = d.select("doc_id", "h", F.explode(starts).alias("at"))
    # inline() of one struct: each hash is computed once, and the filter stays above it
    d = d.select("doc_id", "h", "at", F.inline(F.array(F.struct(*(shingle_at(F.col("h"), F.col("at") + k).alias(f"s{k}") for k in range(WINDOW))))))
    bands, held = minima([F.col(f"s{k}") for k in range(WINDOW)]), []
    for b in range(0, BANDS, 4):  # a few bands at a time: methods of over 8 kB are not compiled
        more = F.inline(F.array(F.struct(*(bands[k].alias(f"m{k}") for k in range(b, b + 4)))))
        d = d.select("doc_id", "h", "at", *held, *(f"s{k}" for k in range(WINDOW)), more)
        held += [f"m{k}" for k in range(b, b + 4)]
    d = d.where(reduce(lambda a, b: a | b, [F.col(f"m{b}").isin(known[b]) for b in range(BANDS)]))
    d = d.select("doc_id", "at", F.slice("h", F.greatest(F.col("at") - longest, F.lit(0)) + 1, 2 * longest + WINDOW + SHINGLE).alias("near"), F.explode(F.array(*(F.struct(F.lit(b).alias("band"), F.col(f"m{b}").alias("m")) for b in range(BANDS)))).alias("x"))
    bands = t.select("template", "license", "shingles", "words", F.explode(F.array(*(F.struct(F.lit(b).alias("band"), F.col(f"m{b}").alias("m")) for b in range(BANDS)))).alias("x")).select("template", "license", "shingles", "words", "x.*").distinct()
    hits = d.select("doc_id", "at", "near", "x.*").join(F.broadcast(bands), ["band", "m"])
    skip = F.least(F.col("at"), F.lit(longest))  # words of `near` before the window
    begin = F.greatest(skip - F.col("words"), F.lit(0))
    around = F.slice("near", begin + 1, skip - begin + F.col("words") + WINDOW + SHINGLE)
    share = let(around, lambda a: F.size(F.array_intersect("shingles", shingles(a))) / F.size("shingles"))
    return hits.select("doc_id", "at", "license", "template", "words", F.explode(F.array(share)).alias("containment")).where(F.col("containment") >= containment)
