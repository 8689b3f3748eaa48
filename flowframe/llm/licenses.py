"""License scans: fixed phrases, and an exact set-similarity join of text blocks with templates.

All in DataFrame functions. Blocks are a document's lines and windows of consecutive lines, as
notices are often wrapped, or all ranges of consecutive lines. A block meets a template when it
contains at least ``threshold`` of the template's distinct words. Words are ordered by their frequency in all
documents, rare ones first. A block that contains enough of a template must hold one of the words
in the template's prefix (prefix filter, by inverted lists from prefix words to templates), have
enough words itself (length filter), and from the first common word on enough words must be left
in the template and in the block (positional filter). What passes is counted exactly. Words that no
template holds are left out of blocks: they match nothing.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowframe.llm.common import column_name

#: Phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: License notices and texts in lower case, by label. Words only matter as a set.
TEMPLATES = {
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction",
    "mit-warranty": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "apache": "licensed under the apache license version 2 0 you may not use this file except in compliance with the license you may obtain a copy of the license at",
    "gpl": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "mpl": "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "cc-by": "this work is licensed under a creative commons attribution international license",
    "cc0": "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",
    "unlicense": "this is free and unencumbered software released into the public domain",
    "mit-text": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "bsd-2-clause-text": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage",
    "bsd-3-clause-endorsement": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "isc-text": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
    "zlib-text": "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required altered source versions must be plainly marked as such and must not be misrepresented as being the original software this notice may not be removed or altered from any source distribution",
    "apache-notice": "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
    "gpl-notice": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details you should have received a copy of the gnu general public license along with this program if not see http www gnu org licenses",
    "lgpl-notice": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu lesser general public license for more details you should have received a copy of the gnu lesser general public license along with this library",
    "agpl-notice": "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "unlicense-text": "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the public domain we make this dedication for the benefit of the public at large and to the detriment of our heirs and successors we intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law",
    "bsl-1.0": "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following",
    "epl": "this program and the accompanying materials are made available under the terms of the eclipse public license which accompanies this distribution and is available at",
    "cc-by-sa": "this work is licensed under a creative commons attribution sharealike international license",
}
THRESHOLD = 0.75
#: Lines in a window, and from one window's start to the next's.
WINDOW_LINES, WINDOW_STEP = 8, 4
#: What separates words once A-Z are in lower case.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words in lower case. The Kelvin sign would become a k; it is made another letter outside ASCII first.

    Other letters beyond ASCII may change case too, which no ASCII word or phrase can tell.
    """
    return F.filter(F.split(F.lower(F.replace(text, F.lit("K"), F.lit("ÿ"))), SEPARATORS), lambda w: w != "")


def vocabulary_counts(docs: DataFrame, vocabulary: list[str], text_col: str) -> dict[str, int]:
    """In how many rows of docs each word of the vocabulary occurs (all rows are read)."""
    known = _literal(vocabulary, "array<string>")
    held = docs.select(F.explode(F.array_intersect(known, words(F.coalesce(F.col(text_col), F.lit(""))))).alias("word"))
    return {r.word: r["count"] for r in held.groupBy("word").count().collect()}  # no more rows than the vocabulary


def prepared(templates: dict[str, str], counts: dict[str, int], threshold: float) -> list[tuple[str, list[str], int, int]]:
    """(label, words rare first, words needed, prefix length) of each template."""
    out = []
    for label, text in sorted(templates.items()):
        own = sorted(set(text.split()), key=lambda w: (counts.get(w, 0), w))
        need = math.ceil(threshold * len(own) - 1e-9)
        out.append((label, own, need, len(own) - need + 1))
    return out


def find_licenses(docs: DataFrame, text_col: str = "text", phrases: dict[str, str] | None = None, templates: dict[str, str] | None = None, threshold: float = THRESHOLD, all_ranges: bool = False) -> DataFrame:
    """Adds n_words, places (array<struct<start, label>>), blocks (array<struct<line, lines, label, containment>>) to docs.

    places: where a phrase's words stand consecutively, by word number from 0. blocks: lines, and
    windows of WINDOW_LINES lines every WINDOW_STEP lines, that contain ``threshold`` and more of a
    template's distinct words, by the number of the first line from 0 and the number of lines.
    With ``all_ranges`` every range of consecutive lines is a block, of whatever length; listed are
    those that no smaller range inside them equals in a template's words. So a range meets a
    template just when a listed one lies in it, and one that lies in it has the same containment.
    Phrases and templates are of lower-case ASCII words; a few hundred words in all, as they lie in
    the plan. Null and empty texts have no words, places or blocks; repeated rows are rows like
    others; an empty table gives an empty one. Words of one frequency are ordered by their spelling.
    Texts are taken whole, a document at a time, and a line's words are found once. Columns of docs
    named as the results are replaced.
    """
    phrases = PHRASES if phrases is None else phrases
    templates = TEMPLATES if templates is None else templates
    docs = docs.drop("n_words", "places", "blocks")
    text, own = column_name(docs, "license_text"), column_name(docs, "license_words")
    rows = docs.withColumn(text, F.coalesce(F.col(text_col), F.lit(""))).withColumn(own, words(F.col(text)))
    w = F.col(own)
    no_places = F.expr("cast(array() as array<struct<start:int,label:string>>)")
    places = no_places
    for phrase, label in phrases.items():
        places = F.concat(places, F.coalesce(_places(w, phrase.split(), label), no_places))
    blocks = F.expr("cast(array() as array<struct<line:int,lines:int,label:string,containment:double>>)")
    if templates:
        index = _index(docs, text_col, templates, threshold)
        held, found = column_name(docs, "license_held"), column_name(docs, "license_found")
        rows = rows.withColumn(held, index.held(w)).withColumn(found, index.verified(F.col(held)))
        inside = _ranges(F.col(text), index, F.col(found)) if all_ranges else _blocks(F.col(text), index)
        # no block holds more than its document
        blocks = F.when(F.size(found) > 0, inside).otherwise(blocks)
    return rows.select(*docs.columns, F.size(w).cast("bigint").alias("n_words"), F.array_sort(places).alias("places"), blocks.alias("blocks"))


def _places(w: Column, terms: list[str], label: str) -> Column:
    """Where the terms stand in a row among the words; null where one of them is missing."""
    at = F.filter(F.sequence(F.lit(0), F.size(w) - len(terms)), lambda i: _all([F.get(w, i + k) == t for k, t in enumerate(terms)]))
    maybe = (F.size(w) >= len(terms)) & _all([F.array_contains(w, t) for t in terms])
    return F.when(maybe, F.transform(at, lambda i: F.struct(i.alias("start"), F.lit(label).alias("label"))))


def _all(tests: list[Column]) -> Column:
    out = tests[0]
    for test in tests[1:]:
        out = out & test
    return out


def _literal(value, kind: str) -> Column:
    """A constant of the plan; one call whatever its size."""
    return F.from_json(F.lit(json.dumps(value)), kind)


class _Index:
    """Templates as literals of the plan: words in global order, each template's words, and inverted lists of prefix words.

    A block is tested by the inverted lists of the prefix words it holds, so templates that share no
    rare word with it cost nothing.
    """

    def __init__(self, ready: list, counts: dict[str, int]):
        self.labels, self.own, self.need, _ = zip(*ready)
        order = sorted({w for own in self.own for w in own}, key=lambda w: (counts.get(w, 0), w))
        lists: dict[str, list] = {}
        for t, (_, own, need, prefix) in enumerate(ready):
            for i, word in enumerate(own[:prefix]):
                # how many of the template's words can still match from this one on
                lists.setdefault(word, []).append({"t": t, "left": len(own) - i, "need": need, "size": len(own)})
        self.words, self.prefix, self.names = (_literal(x, "array<string>") for x in (order, sorted(lists), list(self.labels)))
        self.lists = _literal(lists, "map<string,array<struct<t:int,left:int,need:int,size:int>>>")
        self.templates = _literal([list(own) for own in self.own], "array<array<string>>")

    def held(self, w: Column) -> Column:
        """The template words among w, in global order."""
        return F.array_intersect(self.words, w)

    def met(self, held: Column) -> Column:
        """Each prefix hit as (t, left, need, size, block_left, enough): block_left words of the block can still match."""
        hits = F.array_intersect(self.prefix, held)
        lists = F.transform(hits, lambda word: F.transform(F.element_at(self.lists, word), lambda e: F.struct(
            e["t"].alias("t"), e["left"].alias("left"), e["need"].alias("need"), e["size"].alias("size"),
            (F.size(held) - F.array_position(held, word).cast("int") + 1).alias("block_left"))))
        return F.flatten(lists)

    def candidates(self, held: Column) -> Column:
        """Templates (t, need) that pass the filters: a prefix word (prefix), words enough (length), and words enough
        from a common one on, in the template and in the block (positional). A template that is contained
        enough passes with its first common word, so none is lost."""
        enough = lambda e: (F.size(held) >= e["need"]) & (F.least(e["left"], e["block_left"]) >= e["need"])
        return F.array_distinct(F.transform(F.filter(self.met(held), enough), lambda e: F.struct(e["t"].alias("t"), e["need"].alias("need"), e["size"].alias("size"))))

    def verified(self, held: Column) -> Column:
        """The candidates that are contained enough, with the count ``n`` of their words."""
        counted = F.transform(self.candidates(held), lambda c: F.struct(c["t"].alias("t"), c["need"].alias("need"), c["size"].alias("size"), F.size(F.array_intersect(F.get(self.templates, c["t"]), held)).alias("n")))
        return F.filter(counted, lambda c: c["n"] >= c["need"])


def filter_counts(docs: DataFrame, text_col: str = "text", templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> dict[str, int]:
    """What the filters do with whole documents as blocks: pairs by prefix, after length, after position, and contained."""
    templates = TEMPLATES if templates is None else templates
    index = _index(docs, text_col, templates, threshold)
    held = index.held(words(F.coalesce(F.col(text_col), F.lit(""))))
    rows = docs.select(held.alias("held")).select("held", index.met(F.col("held")).alias("met"))
    pairs = lambda test: F.sum(F.size(F.array_distinct(F.transform(F.filter("met", test), lambda e: e["t"]))))
    long = lambda e: F.size("held") >= e["need"]
    row = rows.agg(pairs(lambda e: F.lit(True)).alias("prefix"), pairs(long).alias("length"), pairs(lambda e: long(e) & (F.least(e["left"], e["block_left"]) >= e["need"])).alias("position"),
                   F.sum(F.size(index.verified(F.col("held")))).alias("contained")).first()
    return {name: n or 0 for name, n in row.asDict().items()}


def _index(docs: DataFrame, text_col: str, templates: dict[str, str], threshold: float) -> _Index:
    vocabulary = sorted({t for text in templates.values() for t in text.split()})
    counts = vocabulary_counts(docs, vocabulary, text_col)
    return _Index(prepared(templates, counts, threshold), counts)


def _let(value: Column, body) -> Column:
    """body(value), with the value worked out once."""
    return F.transform(F.array(value), body)[0]


def _blocks(text: Column, index: _Index) -> Column:
    """The join of lines and windows with the templates. A line's words are found once, a window's set from its lines'."""
    lines = F.transform(F.split(text, "\n", -1), lambda line: index.held(words(line)))

    def of(held):
        single = F.transform(held, lambda h, n: F.struct(n.alias("line"), F.lit(1).alias("lines"), h.alias("held")))
        starts = F.when(F.size(held) > 1, F.sequence(F.lit(0), F.size(held) - 1, F.lit(WINDOW_STEP))).otherwise(F.expr("cast(array() as array<int>)"))
        wide = F.transform(starts, lambda i: F.struct(i.alias("line"), F.least(F.lit(WINDOW_LINES), F.size(held) - i).alias("lines"), index.held(F.flatten(F.slice(held, i + 1, WINDOW_LINES))).alias("held")))
        return F.flatten(F.transform(F.filter(F.concat(single, wide), lambda b: F.size(b["held"]) > 0), lambda b: F.transform(index.verified(b["held"]), lambda c: F.struct(
            b["line"].alias("line"), b["lines"].alias("lines"), F.get(index.names, c["t"]).alias("label"), (c["n"] / c["size"]).alias("containment")))))

    return _let(lines, of)


def _ranges(text: Column, index: _Index, found: Column) -> Column:
    """The join of all line ranges with the templates. No range holds more than the document, so ``found``, the templates that the document contains, are all there are."""
    none = F.expr("cast(array() as array<array<struct<line:int,lines:int,label:string,containment:double>>>)")
    lines = F.transform(F.split(text, "\n", -1), lambda line, n: F.struct(n.alias("line"), index.held(words(line)).alias("w")))

    def met(hits, c):
        own = F.get(index.templates, c["t"])
        mine = F.filter(F.transform(hits, lambda x: F.struct(x["line"].alias("line"), F.array_intersect(own, x["w"]).alias("w"))), lambda x: F.size(x["w"]) > 0)

        def step(acc, x):
            # where each word stood last before this line, and with it
            last = F.transform(acc["last"], lambda at, k: F.when(F.array_contains(x["w"], F.get(own, k)), x["line"]).otherwise(at))
            before = F.array_min(F.filter(acc["last"], lambda at, k: F.array_contains(x["w"], F.get(own, k))))
            return _let(F.struct(last.alias("last"), before.alias("before")), lambda v: _let(ending(v, x), lambda ends: F.struct(
                v["last"].alias("last"), F.when(F.size(ends) > 0, F.concat(acc["out"], F.array(ends))).otherwise(acc["out"]).alias("out"))))

        def ending(v, x):
            # from a word's last line on, where this line adds a word: its first and last line are both needed
            starts = F.filter(F.array_distinct(v["last"]), lambda at: at > v["before"])
            counted = F.transform(starts, lambda at: F.struct(at.alias("line"), F.size(F.filter(v["last"], lambda y: y >= at)).alias("n")))
            enough = F.filter(counted, lambda e: e["n"] >= c["need"])
            return F.transform(enough, lambda e: F.struct(e["line"].alias("line"), (x["line"] - e["line"] + 1).alias("lines"), F.get(index.names, c["t"]).alias("label"), (e["n"] / c["size"]).alias("containment")))

        begin = F.struct(F.transform(own, lambda _: F.lit(-1)).alias("last"), none.alias("out"))
        return F.flatten(F.aggregate(mine, begin, step)["out"])

    return _let(F.filter(lines, lambda x: F.size(x["w"]) > 0), lambda hits: F.flatten(F.transform(found, lambda c: met(hits, c))))
