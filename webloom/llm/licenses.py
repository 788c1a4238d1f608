"""License scans: exact set-similarity join of text blocks with license templates. Native only."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import LOWER, UPPER, WORD_PATTERN, ascii_lower, inline_table, join_counted, materialize

#: (phrase, label): base labels stand wherever a phrase's words stand consecutively.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: Texts and notices of public licenses and the labels of this method. Fixed values.
TEMPLATES = (
    ("text:mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge,
publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so,
subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial
portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO
THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS
BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN
CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("text:bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following
disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer
in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND
CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND
FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT,
INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF
USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT
(INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("text:isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR
DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE
AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR
PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE
OF THIS SOFTWARE."""),
    ("text:apache-2.0-notice", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with
the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed
to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND,
either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("text:gpl-notice", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program
is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS
FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public
License along with this program. If not, see <https://www.gnu.org/licenses/>."""),
    ("text:mpl-notice", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""),
    ("text:unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use,
compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or
non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all
copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment
of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to
this software under copyright law."""),
    ("text:zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for
any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial
applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be
misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the
product documentation would be appreciated but is not required. Altered source versions must be plainly marked as such, and must not be
misrepresented as being the original software. This notice may not be removed or altered from any source distribution."""),
    ("notice:mit", "Released under the MIT License"),
    ("notice:apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("notice:gpl-3", "This work is licensed under the GNU General Public License, version 3"),
    ("notice:cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("notice:cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("notice:reserved", "All rights reserved"),
)
#: Least half length of a block. A template's half is the power of two that holds all its words; its blocks are two halves long, one half apart, so that every run of one half lies whole in some block.
HALF = 32
#: Containment that a template's pairs of neighbouring words must reach in a block. Pairs, as the words of one license stand in others too, but in other company.
THRESHOLD = 0.8
#: Between the words of a pair; no word holds it.
JOINT = "_"
#: A word in text whose case is as it was.
ANY_CASE = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    """A template's different pairs of neighbouring words, how many a block must hold, and the half length of its blocks."""

    label: str
    pairs: tuple[str, ...]
    need: int
    half: int


def known_templates(templates=TEMPLATES, threshold: float = THRESHOLD) -> list[Template]:
    """Templates of fewer than two words have no pairs and are left out."""
    out = []
    for label, text in templates:
        every = re.findall(WORD_PATTERN, text.translate(str.maketrans(UPPER, LOWER)))
        pairs = tuple(dict.fromkeys(map(JOINT.join, zip(every, every[1:], strict=False))))
        if pairs:
            out.append(Template(label, pairs, math.ceil(threshold * len(pairs) - 1e-9), max(HALF, 1 << (len(every) - 1).bit_length())))
    return out


def _literal(words: Iterable[str]) -> Column:
    """Words as one array literal, which Catalyst folds; no word holds a space."""
    return F.split(F.lit(" ".join(words)), " ")


def words_col(text: Column) -> Column:
    """Words of a text: A-Z lower-cased, runs of digits, letters and every character beyond ASCII."""
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD_PATTERN), F.lit(0))


def _places(words: Column, phrase: str) -> Column:
    """Where the phrase's words stand consecutively, as starts counted from 0."""
    parts = phrase.split()
    starts = F.sequence(F.lit(0), F.size(words) - F.lit(len(parts)))

    def here(i: Column) -> Column:
        return F.array_join(F.slice(words, i + 1, len(parts)), " ") == phrase

    last = F.filter(starts, lambda i: (F.get(words, i + F.lit(len(parts) - 1)) == parts[-1]) & here(i))
    return F.when(F.size(words) >= len(parts), last).otherwise(F.array().cast("array<int>"))


def pairs_col(words: Column) -> Column:
    """The pairs of neighbouring words, in order."""
    some = F.transform(F.sequence(F.lit(0), F.size(words) - 2), lambda i: F.concat(F.get(words, i), F.lit(JOINT), F.get(words, i + 1)))
    return F.when(F.size(words) > 1, some).otherwise(F.array().cast("array<string>"))


def blocks(paired: DataFrame, halves: list[int]) -> DataFrame:
    """``(row, half, block array<string>)`` of ``paired(row, pairs)``: different pairs of each window of two halves of words, one half apart, for each of the lengths."""
    def starts(half: int) -> Column:
        return F.transform(F.sequence(F.lit(0), F.greatest(F.size("pairs") - 1, F.lit(0)), F.lit(half)), lambda s: F.struct(F.lit(half).alias("half"), s.alias("s")))

    places = paired.select("row", "pairs", F.explode(F.concat(*map(starts, halves))).alias("at"))
    return places.select("row", "at.half", F.array_distinct(F.slice("pairs", F.col("at.s") + 1, 2 * F.col("at.half") - 1)).alias("block"))


def similar(blocks: DataFrame, known: list[Template]) -> DataFrame:
    """``(row, label, score)``: every block and template of one half length with as many common pairs as the template needs.

    Pairs are ordered by their frequency over all blocks, rarest first (ties by the pair). A template of n pairs that
    needs o must share one of its n - o + 1 rarest: the prefix index, joined with
    the blocks' pairs. A block of fewer than o pairs is out by length. Met first at template position i
    and block position j (among the block's pairs that any template knows, in the same order), the two can
    reach 1 + min(n - i - 1, m - j - 1) pairs: out by position if that is too few. Survivors are
    counted exactly. The template side has the size of the given texts and is broadcast.
    """
    spark = blocks.sparkSession
    vocab = sorted({x for t in known for x in t.pairs})
    counted = blocks.select(F.explode(F.array_intersect("block", _literal(vocab))).alias("pair")).groupBy("pair").count()
    ranked = inline_table(spark, [(x,) for x in vocab], "pair string").join(counted, "pair", "left").select("pair", F.coalesce("count", F.lit(0)).alias("n"))
    rank = {r["pair"]: i for i, r in enumerate(ranked.orderBy("n", "pair").collect())}
    index, full = [], []
    for n, t in enumerate(known):
        order = sorted(t.pairs, key=rank.__getitem__)
        full.append((n, t.label, order, t.need))
        index += [(x, t.half, n, i) for i, x in enumerate(order[: len(order) - t.need + 1])]
    prefix = inline_table(spark, index, "pair string, half int, t int, i int")
    whole = inline_table(spark, full, "t int, label string, tokens array<string>, need int")
    ordered, first = _literal(rank), _literal(dict.fromkeys(x for x, *_ in index))
    mine = blocks.where(F.arrays_overlap("block", first)).select("row", "half", F.array_intersect(ordered, F.col("block")).alias("block"))
    keyed = mine.select("row", "half", "block", F.posexplode("block").alias("j", "pair"))
    found = keyed.join(F.broadcast(prefix), ["pair", "half"]).join(F.broadcast(whole), "t")
    found = found.where((F.size("block") >= F.col("need")) & (1 + F.least(F.size("tokens") - F.col("i") - 1, F.size("block") - F.col("j") - 1) >= F.col("need")))
    both = F.size(F.array_intersect("block", "tokens"))
    return found.where(both >= F.col("need")).select("row", "label", (both / F.size("tokens")).alias("score"))


def matches(texts: DataFrame, known: list[Template]) -> DataFrame:
    """``(row, met, best)``: labels and the greatest containment for the rows of ``texts(row, words)`` that meet a template."""
    paired = texts.select("row", pairs_col(F.col("words")).alias("pairs"))
    return similar(blocks(paired, sorted({t.half for t in known})), known).groupBy("row").agg(F.collect_set("label").alias("met"), F.max("score").alias("best"))


def scan(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """``(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score)``, one row for each row of ``docs``.

    Only texts that could hold a phrase or a template are cut into words and blocks (see
    :func:`needles`), each distinct text once. ``score`` is the greatest containment that meets
    the threshold, 1 where a base phrase stands, else 0. A text that a large share of all rows has is no hot key, see
    :func:`join_counted`.

    Null and empty texts have no words and no labels; repeated rows come out alike, as often as
    they came in; a null id is an id like any other; an empty table gives no row; other columns
    are ignored.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    known = known_templates(templates, threshold)
    words = F.when(_worthy(text, known), words_col(text))
    base = docs.select("doc_id", F.regexp_count(text, F.lit(ANY_CASE)).cast("long").alias("n_words"), words.alias("words"), F.xxhash64(text).alias("h"), F.crc32(text).alias("c"))
    base = materialize(base, "licenses-words")
    row = F.when(F.col("words").isNotNull(), F.struct("h", "c", "n_words"))
    texts = base.where(F.col("words").isNotNull()).select(row.alias("row"), "words").groupBy("row").agg(F.first("words").alias("words"), F.count("*").alias("n"))
    texts = materialize(texts, "licenses-texts")
    met = matches(texts, known)
    places = [(_places(F.col("words"), p), label) for p, label in PHRASES]
    held = F.array_compact(F.array(*[F.when(F.size(p) > 0, F.lit(label)) for p, label in places]))
    judged = texts.select("row", "n", F.concat(*[p for p, _ in places]).alias("at"), held.alias("base")).join(met, "row", "left")
    judged = judged.select("row", "n", "at", "base", F.coalesce("met", F.array().cast("array<string>")).alias("met"), "best")
    plain = base.where(F.col("words").isNull()).select("doc_id", "n_words")
    out = join_counted(base.where(F.col("words").isNotNull()).select("doc_id", "n_words", row.alias("row")), materialize(judged, "licenses-judged"), ["row"]).drop("row")
    out = out.unionByName(plain, allowMissingColumns=True)
    listed = lambda c: F.array_join(F.array_sort(c), ",")
    return out.select(
        "doc_id",
        "n_words",
        F.when(F.col("at").isNull(), 0).otherwise(F.size("at")).cast("long").alias("n_base"),
        F.array_min("at").cast("long").alias("first_word"),
        F.array_max("at").cast("long").alias("last_word"),
        F.coalesce(listed("base"), F.lit("")).alias("base_labels"),
        F.coalesce(listed(F.array_union("base", "met")), F.lit("")).alias("labels"),
        F.when(F.size("at") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )


def needles(known: list[Template]) -> list[str]:
    """Words of which a text that holds a phrase or meets a template has one as a substring.

    A template of n pairs that needs o shares at least one of any n - o + 1 of its pairs, and so the longer word of that
    pair; long words are asked for, and of these the ones that many templates hold.
    """
    held = Counter(w for t in known for w in {w for x in t.pairs for w in x.split(JOINT)})
    out = {p.split()[-1] for p, _ in PHRASES}
    for t in known:
        best = sorted((-min(len(w), 8), -held[w], w) for w in (min(x.split(JOINT), key=lambda w: (-min(len(w), 8), -held[w], w)) for x in t.pairs))
        out.update(w for *_, w in best[: len(t.pairs) - t.need + 1])
    return sorted(out)


def _worthy(text: Column, known: list[Template]) -> Column:
    """Whether a text could hold a phrase or reach a template: a test by substrings that lets too many pass, never too few. The text is lower-cased for this test alone."""
    lowered = F.array(F.lower(text))
    return F.transform(lowered, lambda low: F.exists(_literal(needles(known)), lambda w: F.contains(low, w)))[0]


def oracle_sql(templates=TEMPLATES, threshold: float = THRESHOLD) -> str:
    """The same in DuckDB's SQL, every block against every template."""
    low = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    at, base = [], []
    for p, label in PHRASES:
        parts = p.split()
        fits = " AND ".join(f"w[i + {k + 1}] = '{x}'" for k, x in enumerate(parts))
        found = f"list_filter(range(0, greatest(len(w) - {len(parts) - 1}, 0)), lambda i: {fits})"
        at.append(found)
        base.append(f"CASE WHEN len({found}) > 0 THEN '{label}' END")
    known = known_templates(templates, threshold)
    rows = ", ".join(f"('{t.label}', {list(t.pairs)!r}, {t.need}, {t.half})" for t in known)
    vocab = ", ".join(repr(x) for x in sorted({x for t in known for x in t.pairs}))
    halves = ", ".join(f"({h})" for h in sorted({t.half for t in known}))
    return f"""WITH d AS (SELECT row_number() OVER () AS rn, doc_id, {low} AS w FROM documents),
t AS (SELECT * FROM (VALUES {rows}) v(label, ws, need, half)),
e AS (SELECT rn, list_transform(range(1, len(w)), lambda i: w[i] || '{JOINT}' || w[i + 1]) AS p FROM d),
s AS (SELECT rn, p, half, unnest(range(0, greatest(len(p), 1), half)) AS s FROM e, (VALUES {halves}) h(half) WHERE len(list_intersect(p, [{vocab}])) > 0),
b AS (SELECT rn, half, list_distinct(list_slice(p, s + 1, s + 2 * half - 1)) AS b FROM s),
m AS (SELECT rn, label, len(list_intersect(b, ws)) AS o, len(ws) AS n, need FROM b JOIN t ON b.half = t.half),
g AS (SELECT rn, list_distinct(list(label)) AS met, max(o::DOUBLE / n) AS best FROM m WHERE o >= need GROUP BY 1),
p AS (SELECT d.rn, doc_id, len(w) AS n_words, list_concat(list_concat({at[0]}, {at[1]}), {at[2]}) AS places, list_filter([{', '.join(base)}], lambda x: x IS NOT NULL) AS base FROM d)
SELECT doc_id, n_words::BIGINT AS n_words, len(places)::BIGINT AS n_base, list_min(places)::BIGINT AS first_word, list_max(places)::BIGINT AS last_word,
array_to_string(list_sort(base), ',') AS base_labels, array_to_string(list_sort(list_distinct(list_concat(base, coalesce(met, [])))), ',') AS labels,
CASE WHEN len(places) > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0.0) END AS score FROM p LEFT JOIN g ON p.rn = g.rn"""
