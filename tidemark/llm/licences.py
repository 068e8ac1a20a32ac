"""Find licence texts and notices by Dice coefficient over word bigrams. DataFrame functions only.

A template is compared with windows of its own size over a text's words, so it
is found wrapped, indented, commented out, in the middle of a line or of a text.
Bounds on sizes prune first: at a Dice of 0.8 two thirds of a template's bigrams
must be there at all, which one intersection with the bigrams of all templates
together rules out for nearly every text.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.words import ascii_lower

# Notices by which works name their licence. Callers may pass others.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("proprietary", "All rights reserved."),
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use,
copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software
is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included
in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO
EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT,
TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("BSD-2-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that
the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions
and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions
and the following disclaimer in the documentation and/or other materials provided with the distribution."""),
    ("BSD-3-Clause", """Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the
following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright
holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific
prior written permission."""),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable
law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR
CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations
under the License."""),
    ("GPL-2.0", """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public
License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."""),
    ("GPL-3.0", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."""),
    ("LGPL-2.1", """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General
Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later
version."""),
    ("AGPL-3.0", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General
Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later
version."""),
    ("MPL-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies."""),
    ("Unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish,
use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or
non-commercial, and by any means."""),
    ("proprietary", """No part of this publication may be reproduced, distributed, or transmitted in any form or by any means without
the prior written permission of the publisher"""),
]


def _words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(text), "[^a-z0-9]+"), "")


def _pairs(words: Column) -> Column:
    """Pairs of neighbouring words in order; a single word stands for itself."""
    rest = F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0)))
    pairs = F.zip_with(F.slice(words, F.lit(1), F.size(rest)), rest, lambda a, b: F.concat(a, F.lit(" "), b))
    return F.when(F.size(words) > 1, pairs).otherwise(words)


def template_pairs(spark, templates: list[tuple[str, str]]) -> list[tuple[int, str, int, list[str]]]:
    """``(number, licence, pairs in all, distinct pairs)`` of the given list, made by the same functions as those of texts."""
    rows = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(templates)], "i int, licence string, notice string")
    made = rows.select("i", "licence", _pairs(_words(F.col("notice"))).alias("p")).where("size(p) > 0")
    return [(r.i, r.licence, r.n, r.b) for r in sorted(made.select("i", "licence", F.size("p").alias("n"), F.array_distinct("p").alias("b")).collect())]


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", templates: list[tuple[str, str]] = TEMPLATES, least: float = 0.8) -> DataFrame:
    """One row per document and template that match: ``key, template, licence, start, dice`` of the best window.

    Both sides are lower-cased and cut at all but a-z and 0-9. A window begins at
    a bigram of the template, has as many words as it, and ends at its last
    bigram of the template. With sets A and B of bigrams, Dice is
    2|A and B| / (|A| + |B|); of a text's windows the one with the highest Dice
    counts, the first of equal ones, from ``least`` on; ``start`` is its first
    word, from 0. Dice can reach ``least`` only if the text has
    |B| * least / (2 - least) of the template's bigrams, which goes first.
    Templates are a given list, not a table. Nothing is shuffled. Null and empty
    texts match nothing; texts of any length are scanned whole; repeated rows
    give repeated matches; a null key stays null; other columns don't matter,
    whatever their names.
    """
    known = template_pairs(docs.sparkSession, templates)
    if not known:
        known = [(-1, "", 1, [""])]
    need = {i: ceil(len(b) * least / (2 - least) - 1e-9) for i, _, _, b in known}
    every = F.array(*[F.lit(x) for x in sorted({x for *_, b in known for x in b})])
    rows = docs.where(F.length(text) > 0).select(F.col(key).alias("key"), _pairs(_words(F.col(text))).alias("pairs"))
    rows = rows.select("key", "pairs", F.array_intersect("pairs", every).alias("met")).where(F.size("met") >= min(need.values()))
    sets = F.array(*[
        F.struct(F.lit(i).alias("template"), F.lit(licence).alias("licence"), F.lit(n).alias("n"), F.lit(need[i]).alias("need"), F.array(*[F.lit(x) for x in b]).alias("b"))
        for i, licence, n, b in known
    ])
    likely = F.filter(sets, lambda t: F.size(F.array_intersect(F.col("met"), t["b"])) >= t["need"])
    rows = rows.select("key", "pairs", F.explode(likely).alias("t")).select("key", "pairs", "t.*")

    def dice(start: Column) -> Column:
        window = F.slice("pairs", start + 1, F.col("n"))
        # Places of template bigrams in the window; its last one ends it.
        end = F.array_max(F.transform(window, lambda x, i: F.when(F.array_contains("b", x), i)))
        inside = F.array_distinct(F.slice(window, F.lit(1), end + 1))
        return 2.0 * F.size(F.array_intersect(inside, F.col("b"))) / (F.size(inside) + F.size("b"))

    starts = F.filter(F.transform("pairs", lambda x, i: F.when(F.array_contains("b", x), i)), lambda i: i.isNotNull())
    best = F.array_max(F.transform(starts, lambda p: F.struct(dice(p).alias("dice"), (-p).alias("back"))))
    found = rows.select("key", "template", "licence", best.alias("best")).where(F.col("best.dice") >= least)
    return found.select(F.col("key").alias(key), "template", "licence", (-F.col("best.back")).alias("start"), F.col("best.dice").alias("dice"))
