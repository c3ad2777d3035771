"""Operator 5: license scan by an exact set-similarity join (DataFrame functions only).

A text block is a run of consecutive words that ignores line breaks, of at most
words / threshold words of the template, or a longer run within one line, of up
to twice the template's words and 16 more (names, years). A template matches
where a block holds at least ``threshold`` of its distinct words.

The join: a template's stride S is the smallest power of two that is no less
than its longest block. Rows are (document, S, number j, the words from j * S on,
2 * S of them), so every block lies in the row in whose first half it begins.
Words are put in one global order, rarest first by the number of documents that
hold them. A row can match a template only if it holds one of the template's
first ``|t| - need + 1`` words (prefix filter), so rows are made only around
such words and meet the templates through an index of them; if it holds
``need`` template words (length filter); and if from the common word on enough
words are left on both sides (positional filter). What passes is compared in
full, block by block, so the join is exact: a best block can be moved on to its
first template word without loss, so only blocks that begin at one are tried.

Only template words are counted and only rare prefix words are joined, so the
common words of a corpus are never exploded with the texts, which never move.
The templates are a fixed list, which bounds the index, what is sent to tasks
and what the driver holds (one document count per template word). A text's
blocks are a few per prefix word in it, each of bounded size.

``matches`` is the same join with given blocks (lines).

``phrases`` finds the places where a license phrase's words stand
consecutively, by whole words.

Edge cases: NULL and empty texts have no words, blocks or places; equal places
of several phrases count each; repeated rows each get their result; an empty
table gives an empty result; other columns are never read.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltaic.llm.common import WORD_PATTERN, stored, words
from voltaic.llm.winnow import let

# FIXED VALUES: phrases of the contract and their labels
PHRASES = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]

# FIXED VALUES: public license notices and their labels
TEMPLATES = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the Software), to deal in the Software without restriction, including without limitation "
            "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the Software), to deal in the Software without restriction, including without limitation "
            "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
            "to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above "
            "copyright notice and this permission notice shall be included in all copies or substantial portions of the "
            "Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT "
            "LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT "
            "SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION "
            "OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER "
            "DEALINGS IN THE SOFTWARE."),
    ("mit", "Released under the MIT License"),
    ("mit", "Licensed under the MIT License"),
    ("mit", "SPDX-License-Identifier: MIT"),
    ("apache-2", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance "
                 "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache-2", "Licensed under the Apache License, Version 2.0"),
    ("apache-2", "SPDX-License-Identifier: Apache-2.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
            "the following conditions are met"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
            "the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this "
            "list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above "
            "copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
            "materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its "
            "contributors may be used to endorse or promote products derived from this software without specific prior "
            "written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR "
            "IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A "
            "PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY "
            "DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
            "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER "
            "CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR "
            "OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
            "Public License as published by the Free Software Foundation"),
    ("lgpl", "Licensed under the GNU Lesser General Public License"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
            "granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
            "granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE "
            "IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED "
            "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
            "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
            "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE "
            "USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("cc-by-nc", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("all-rights-reserved", "Copyright All rights reserved"),
]


def template_words(text: str) -> list[str]:
    """Distinct words of a template, in order."""
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    return list(dict.fromkeys(re.findall(WORD_PATTERN, lower)))


def _literal(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def word_order(docs: DataFrame, vocabulary: list[str], text_col: str = "text") -> list[str]:
    """The vocabulary, rarest first by the documents of the whole corpus that hold a word (ties: by the word)."""
    held = F.array_intersect(_literal(vocabulary), words(F.col(text_col).cast("string")))
    counted = docs.select(F.explode(held).alias("word")).groupBy("word").count().collect()  # a row per template word
    seen = {r["word"]: r["count"] for r in counted}
    return sorted(vocabulary, key=lambda w: (seen.get(w, 0), w))


@dataclass(frozen=True)
class Templates:
    """Templates under one word order: rows (number, label, own words in order, need, stride, reach)."""
    order: list[str]
    rows: list[tuple[int, str, list[str], int, int, tuple[int, int]]]

    def prefixes(self, stride: int | None = None) -> list[str]:
        """Words of the prefixes of all templates (of one stride), in order."""
        own = {w for _, _, words_, need, s, _ in self.rows if stride in (None, s) for w in words_[:len(words_) - need + 1]}
        return [w for w in self.order if w in own]

    def words(self, stride: int) -> list[str]:
        own = {w for _, _, words_, _, s, _ in self.rows if s == stride for w in words_}
        return [w for w in self.order if w in own]


def reach(text: str, threshold: float = 0.9) -> tuple[int, int]:
    """Words that a block of this template may have: across line breaks, within a line."""
    n = len(re.findall(WORD_PATTERN, text.lower()))
    return int(n / threshold + 1e-9), 2 * n + 16


def stride_of(text: str, threshold: float = 0.9) -> int:
    """Smallest power of two that is no less than the template's longest block."""
    return 1 << (max(reach(text, threshold)) - 1).bit_length()


def ordered_templates(order: list[str], templates, threshold: float) -> Templates:
    rank = {w: i for i, w in enumerate(order)}
    rows = []
    for number, (label, text) in enumerate(templates):
        own = sorted(template_words(text), key=rank.get)
        rows.append((number, label, own, max(1, math.ceil(threshold * len(own) - 1e-9)),
                     stride_of(text, threshold), reach(text, threshold)))
    return Templates(order, rows)


def _joined(rows: DataFrame, known: Templates, key: list[str], common, by_stride: bool = True) -> DataFrame:
    """key, template, label, containment of the templates that rows (key, stride, known: template words in order, and
    what ``common`` compares) match: the set-similarity join; ``common`` counts the words in common with ``own``."""
    index = [(word, number, label, at, len(own), need, own, stride if by_stride else 0, *far)
             for number, label, own, need, stride, far in known.rows for at, word in enumerate(own[:len(own) - need + 1])]
    index = rows.sparkSession.createDataFrame(index, "word string, template int, label string, at int, size int, need int, "
                                                     "own array<string>, stride int, across int, within int")
    first = F.filter("known", lambda w: w.isin(known.prefixes()))
    # the index has at most one row per template word: its size is that of the fixed list
    near = rows.withColumn("word", F.explode(first)).join(F.broadcast(index), ["stride", "word"])
    left = F.least(F.col("size") - F.col("at"), F.size("known") - F.array_position("known", F.col("word")) + 1)
    near = near.where((F.size("known") >= F.col("need")) & (left >= F.col("need")))
    near = near.where(F.size(F.array_intersect("known", "own")) >= F.col("need")).withColumn("common", common)
    return (near.where(F.col("common") >= F.col("need"))
            .select(*key, "template", "label", (F.col("common") / F.col("size")).alias("containment")))


def matches(docs: DataFrame, templates=TEMPLATES, threshold: float = 0.9, id_col: str = "doc_id",
            text_col: str = "text") -> DataFrame:
    """doc_id, text_hash, block (line number from 0), template (number in the list), label, containment of every
    line that holds at least ``threshold`` of a template's distinct words."""
    order = word_order(docs, sorted({w for _, t in templates for w in template_words(t)}), text_col)
    known = ordered_templates(order, templates, threshold)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    lines = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"),
                        F.posexplode(F.split(text, "\n", -1)).alias("block", "line"))
    held = let(words(F.col("line")), lambda w: F.array_intersect(_literal(order), w))
    blocks = lines.select("doc_id", "text_hash", "block", F.lit(0).alias("stride"), held.alias("known"))
    return _joined(blocks, known, ["doc_id", "text_hash", "block"], F.size(F.array_intersect("known", "own")), by_stride=False).distinct()


def _rows(known: Templates):
    """words, text -> array of (stride, number, known, words, ends: place behind the last word of each word's line) of the
    stretches that hold a prefix word of a template of their stride and enough template words for any."""
    strides = sorted({row[4] for row in known.rows})
    none = F.array().cast("array<struct<stride:int,number:int,known:array<string>,words:array<string>,ends:array<int>>>")

    def of_stride(w: Column, ends: Column, places: Column, stride: int) -> Column:
        here = F.filter(places, lambda i: F.get(w, i).isin(known.prefixes(stride)))
        own = F.transform(here, lambda i: F.floor(i / stride).cast("int"))
        numbers = F.array_distinct(F.concat(own, F.filter(F.transform(own, lambda j: j - 1), lambda j: j >= 0)))
        rows = F.transform(numbers, lambda j: let(F.slice(w, j * stride + 1, 2 * stride), lambda x: F.struct(
            F.lit(stride).alias("stride"), j.alias("number"), F.array_intersect(_literal(known.words(stride)), x).alias("known"),
            x.alias("words"), F.transform(F.slice(ends, j * stride + 1, 2 * stride), lambda e: e - j * stride).alias("ends"))))
        need = min(row[3] for row in known.rows if row[4] == stride)
        return F.filter(rows, lambda b: F.size(b["known"]) >= need)

    def line_ends(text: Column) -> Column:
        sizes = F.filter(F.transform(F.split(text, "\n", -1), lambda x: F.size(words(x))), lambda n: n > 0)
        lasts = F.aggregate(sizes, F.array().cast("array<int>"),
                            lambda acc, n: F.concat(acc, F.array(F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(0)) + n)))
        return F.flatten(F.zip_with(sizes, lasts, lambda n, e: F.array_repeat(e, n)))

    def of(w: Column, text: Column) -> Column:
        first = known.prefixes()
        places = F.filter(F.sequence(F.lit(0), F.size(w) - 1), lambda i: F.get(w, i).isin(first))
        found = let(line_ends(text), lambda e: let(places, lambda p: F.concat(*[of_stride(w, e, p, s) for s in strides])))
        return F.when(F.arrays_overlap(_literal(first), w), found).otherwise(none)
    return of


def _best_block() -> Column:
    """Most words of ``own`` in a block that begins in the first half of a row."""
    starts = F.filter(F.sequence(F.lit(0), F.least(F.col("stride"), F.size("words")) - 1),
                      lambda i: F.array_contains("own", F.get("words", i)))
    length = lambda i: F.greatest(F.col("across"), F.least(F.col("within"), F.get("ends", i) - i))
    counts = F.transform(starts, lambda i: F.size(F.array_intersect("own", F.slice("words", i + 1, length(i)))))
    return F.coalesce(F.array_max(counts), F.lit(0))


def _places(wanted):
    """words -> struct of n_words and places, array of (label, start, end) of every place of a phrase."""
    def places(w: Column) -> Column:
        out = []
        for phrase, label in wanted:
            tokens = phrase.split(" ")
            rarest = max(tokens, key=len)
            at = F.sequence(F.lit(0), F.size(w) - len(tokens))

            def stands(i: Column, tokens: list[str]) -> Column:
                all_ = F.get(w, i) == tokens[0]
                for j, t in enumerate(tokens[1:], 1):
                    all_ = all_ & (F.get(w, i + j) == t)
                return all_
            hits = F.transform(F.filter(at, lambda i: stands(i, tokens)), lambda i: F.struct(  # noqa: B023
                F.lit(label).alias("label"), i.alias("start"), (i + len(tokens) - 1).alias("end")))  # noqa: B023
            none = F.array().cast("array<struct<label:string,start:int,end:int>>")
            out.append(F.when((F.size(w) >= len(tokens)) & F.array_contains(w, rarest), hits).otherwise(none))
        return F.struct(F.size(w).cast("long").alias("n_words"), F.concat(*out).alias("places"))
    return places


def phrases(docs: DataFrame, wanted=PHRASES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash, n_words, places: array of (label, start, end) in words, of every place of a phrase."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"),
                       let(words(text), _places(wanted)).alias("r")).select("doc_id", "text_hash", "r.n_words", "r.places")


def scan(docs: DataFrame, wanted=PHRASES, templates=TEMPLATES, threshold: float = 0.9, id_col: str = "doc_id",
         text_col: str = "text") -> DataFrame:
    """One row per document: its phrase places, and label and containment of the templates its blocks match."""
    order = word_order(docs, sorted({w for _, text in templates for w in template_words(text)}), text_col)
    known = ordered_templates(order, templates, threshold)
    places, stretches = _places(wanted), _rows(known)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    both = let(words(text), lambda w: F.struct(places(w).alias("p"), stretches(w, text).alias("rows")))
    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), both.alias("r"))
    read = stored(read.select("doc_id", "text_hash", "r.p.n_words", "r.p.places", "r.rows"), "license-documents")
    key = ["doc_id", "text_hash"]
    rows = read.where(F.size("rows") > 0).select(*key, F.explode("rows").alias("b")).select(*key, "b.*")
    found = (_joined(rows, known, key, _best_block()).groupBy(*key)
             .agg(F.collect_set("label").alias("matched"), F.max("containment").alias("containment"))
             .withColumnsRenamed({"doc_id": "key_id", "text_hash": "key_hash"}))
    same = F.col("doc_id").eqNullSafe(F.col("key_id")) & (F.col("text_hash") == F.col("key_hash"))
    # documents without a row have their result already, the others are few and joined without their texts
    near = read.where(F.size("rows") > 0).drop("rows").join(found, same, "left")
    whole = near.unionByName(read.where(F.size("rows") == 0).drop("rows"), allowMissingColumns=True)
    return whole.select("doc_id", "n_words", "places", F.coalesce("matched", F.array().cast("array<string>")).alias("matched"),
                        F.coalesce("containment", F.lit(0.0)).alias("containment"))
