"""License scans: runs of words against licence templates by the Dice coefficient of word bigrams. DataFrame functions only.

A text is normalised to words of ASCII letters, digits and other characters outside ASCII. For each template the run of words
with the highest Dice coefficient of its bigrams and the template's is sought, wherever it starts and ends, so a notice is found
inside a longer line and wrapped over several. Sizes prune the work: a coefficient of t needs sizes within a factor of
(2 - t) / t, so a template of n bigrams is out where a text holds fewer than n * t / (2 - t) of them, and no run is longer than
n * (2 - t) / t. A best run starts and ends with a bigram of the template, which leaves the template's bigrams as the only ends.

Texts that hold none of the words without which no template can reach the threshold are done at once. The others, each distinct
text once, are cut into bigrams that are joined with the broadcast bigrams of the templates. Runs are built from pairs of hits
in one block of text or the next, so a long text is many rows and no pair is further apart than the longest run.
"""

from __future__ import annotations

import math
import re
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ascii_lower, broadcast_if_small, materialize

THRESHOLD = 0.75
#: The paragraphs of licences that are published as one short text.
_MIT_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
_MIT_NOTICE = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_MIT_WARRANTY = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
_ISC_WARRANTY = "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
_BSD_GRANT = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_SOURCE = "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
_BSD_BINARY = "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_NAMES = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_WARRANTY = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_APACHE_NOTICE = "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."
_GPL_NOTICE = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/."
#: Identifiers of licences, as files name them in one line.
SPDX = "AGPL-3.0-only AGPL-3.0-or-later Apache-2.0 BSD-2-Clause BSD-3-Clause CC-BY-4.0 CC-BY-SA-4.0 CC0-1.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0-only GPL-3.0-or-later ISC LGPL-2.1-only LGPL-3.0-or-later MIT MPL-2.0 Unlicense".split()
#: Notices as licences and their users publish them (the name, then the wording).
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("CC-BY", "Licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY", "Licensed under CC BY 4.0."),
    ("CC-BY-NC", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0 Universal."),
    ("GPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation."),
    ("GPL", "This work is licensed under the GNU General Public License, version 3."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("LGPL", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."),
    ("MIT", "Released under the MIT License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Proprietary", "Copyright. All rights reserved. No part of this work may be reproduced without permission."),
    ("Proprietary", "All rights reserved."),
    ("MIT", _MIT_GRANT),
    ("MIT", f"{_MIT_GRANT} {_MIT_NOTICE} {_MIT_WARRANTY}"),
    ("ISC", f"{_ISC_GRANT} {_ISC_WARRANTY}"),
    ("BSD", f"{_BSD_GRANT} {_BSD_SOURCE} {_BSD_BINARY} {_BSD_WARRANTY}"),
    ("BSD", f"{_BSD_GRANT} {_BSD_SOURCE} {_BSD_BINARY} {_BSD_NAMES} {_BSD_WARRANTY}"),
    ("Apache-2.0", _APACHE_NOTICE),
    ("GPL", _GPL_NOTICE),
    *[(name, f"SPDX-License-Identifier: {name}") for name in SPDX],
    *[(f"{name}-{version}", f"Available under {name} {version}") for name in ("CC-BY", "CC-BY-SA", "CC-BY-NC") for version in ("3.0", "4.0")],
)
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def template_bigrams(text: str) -> list[str]:
    words = re.sub(r"[^a-z0-9]+", " ", text.lower()).split()
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:], strict=False)))


def size_bounds(n: int, threshold: float) -> tuple[int, int]:
    """The least and the most bigrams of a unit that can reach the threshold with a template of n."""
    return math.ceil(n * threshold / (2 - threshold) - 1e-9), math.floor(n * (2 - threshold) / threshold + 1e-9)


#: Words too common to look for first.
COMMON = frozenset("0 a all an and any are as be but by for from in including is it may must not of on or other out shall that the this to under use with without you".split())


def needed_words(templates: tuple[tuple[str, str], ...], threshold: float) -> list[str]:
    """Words of which every unit that reaches the threshold with some template holds one.

    A match shares at least m of a template's bigrams. Words are taken, rare ones first and then those of the most bigrams, until fewer
    than m bigrams are free of them: a unit with none of these words cannot match that template. Words are sought as parts of longer
    ones, so a word that holds another is not needed.
    """
    out: set[str] = set()
    for _, text in templates:
        grams = [g.split() for g in template_bigrams(text)]
        m = math.ceil(threshold * (size_bounds(len(grams), threshold)[0] + len(grams)) / 2 - 1e-9)
        grams = [g for g in grams if not any(o in w for o in out for w in g)]
        while len(grams) >= m:
            word = min({w for g in grams for w in g}, key=lambda w: (w in COMMON, len(w) < 4, -sum(w in x for g in grams for x in g), -len(w), w))
            out.add(word)
            grams = [g for g in grams if not any(word in w for w in g)]
    return sorted(w for w in out if not any(o != w and o in w for o in out))


def template_rows(templates: tuple[tuple[str, str], ...], threshold: float) -> tuple[str, str]:
    """Two lists of SQL rows: (template, license, n, least, longest) and (template, no, gram)."""
    kinds, grams = [], []
    for k, (name, text) in enumerate(templates):
        own = template_bigrams(text)
        least, longest = size_bounds(len(own), threshold)
        kinds.append(f"({k}, '{name}', {len(own)}, {least}, {longest})")
        grams += [f"({k}, {i}, '{g}')" for i, g in enumerate(own)]
    return ", ".join(kinds), ", ".join(grams)


def best_runs(spark: SparkSession, texts: DataFrame, templates: tuple[tuple[str, str], ...], threshold: float) -> DataFrame:
    """texts (key, text), keys distinct -> (key, matches), for keys with a match: array of (dice, license, template, first_word, n_words)."""
    kinds, grams = template_rows(templates, threshold)
    kinds = F.broadcast(spark.sql(f"SELECT * FROM VALUES {kinds} AS t(template, license, n, least, longest)"))
    grams = F.broadcast(spark.sql(f"SELECT * FROM VALUES {grams} AS v(template, no, gram)"))
    words = texts.select("key", F.filter(F.split(ascii_lower(F.col("text")), SEPARATORS), lambda w: w != "").alias("w")).where(F.size("w") > 1)
    n = F.size("w")
    pairs = words.select("key", F.posexplode(F.zip_with(F.slice("w", 1, n - 1), F.slice("w", 2, n - 1), lambda a, b: F.concat_ws(" ", a, b))).alias("pos", "gram"))
    hits = materialize(pairs.join(grams, "gram").select("key", "template", "no", "pos"), "licence_hits")
    enough = hits.groupBy("key", "template").agg(F.count_distinct("no").alias("held")).join(kinds, "template").where("held >= least").select("key", "template", "n", "longest", "license")
    placed = materialize(hits.join(broadcast_if_small(materialize(enough, "licence_pairs")), ["key", "template"]).withColumn("block", F.floor(F.col("pos") / F.col("longest"))), "licence_places")
    ends = placed.select("key", "template", "no", F.col("pos").alias("end"), F.explode(F.array(F.col("block") - 1, "block")).alias("block"))
    reached = placed.drop("no").join(ends, ["key", "template", "block"]).where(F.col("end").between(F.col("pos"), F.col("pos") + F.col("longest") - 1))
    # a bigram counts once in a run: at its first place after the start, and a best run ends at such a place
    first = reached.groupBy("key", "template", "license", "n", "pos", "no").agg(F.min("end").alias("end"))
    shared = F.count(F.lit(1)).over(Window.partitionBy("key", "template", "pos").orderBy("end"))
    size = F.col("end") - F.col("pos") + 1
    runs = first.withColumn("dice", F.lit(2.0) * shared / (F.col("n") + size)).where(F.col("dice") >= threshold)
    best = runs.groupBy("key", "template", "license").agg(F.max(F.struct("dice", (-F.col("pos")).alias("pos"), (-size).alias("size"))).alias("x"))
    each = F.array_sort(F.collect_list(F.struct((-F.col("x.dice")).alias("o"), (-F.col("x.pos")).alias("pos"), (-F.col("x.size")).alias("size"), "template", "license")))
    found = best.groupBy("key").agg(each.alias("each"))
    return found.select("key", F.transform("each", lambda m: F.struct((-m["o"]).alias("dice"), m["license"].alias("license"), m["template"].alias("template"), (m["pos"] + 1).alias("first_word"), (m["size"] + 1).alias("n_words"))).alias("matches"))


MATCHES = "array<struct<dice:double,license:string,template:int,first_word:int,n_words:int>>"


def scan(docs: DataFrame, *, text_col: str = "text", templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """All columns of docs and ls_matches: array of (dice, license, template, first_word, n_words), best first, one for each template.

    template is the index in `templates`; first_word (from 1) and n_words tell the run. A run's size is its number of bigrams,
    repeats counted; a template's bigrams are distinct and each counts once. Of runs that tie the first and then the shortest is
    taken; matches that tie are in order of place, length and template. Null and empty texts: no match. Very long texts are read
    whole. Ids are not read: null and repeated ids and repeated rows have the matches of their text. Columns may have any names:
    only a column ls_matches is replaced. Empty table: no rows.
    """
    spark, raw, needed = docs.sparkSession, F.coalesce(F.col(f"`{text_col}`"), F.lit("")), needed_words(templates, threshold)
    holds = reduce(or_, [F.contains(F.lower(F.col("text")), F.lit(w)) for w in needed])
    texts = docs.select(raw.alias("text")).where(holds).select(F.sha2("text", 256).alias("key"), "text").dropDuplicates(["key"])
    found = broadcast_if_small(materialize(best_runs(spark, texts, templates, threshold), "licences"), 50_000)
    kept = [c for c in docs.columns if c != "ls_matches"]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.sha2(raw, 256).alias("of"))
    return rows.join(found, rows["of"] == found["key"], "left").select("row.*", F.coalesce(F.col("matches").cast(MATCHES), F.array().cast(MATCHES)).alias("ls_matches"))
