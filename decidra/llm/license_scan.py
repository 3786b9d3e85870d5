"""License scans with a positional index of templates' words, looked up by a file's rarest ones.

One pass over all documents counts in how many of them each licence word occurs, so a word's IDF is that of the corpus. The
index has all positions of every template word. In the second pass a document's licence words are ranked by IDF, and the
postings of the highest are fetched, as far down as it takes for every template whose key words the document has: two
words of one of its key phrases, its rarest. A posting says where its template would start. The two words' lists are intersected
by that, and each place is verified: all key phrases must stand within a few words of their places, and most words of
the template too. Key phrases are mandatory, so no place that verifies is left out, however common its words are. Base phrases are searched for
as whole word sequences besides, so a base label never hangs on the index.

Words are runs of digits, letters after lower-casing A-Z, and every character beyond ASCII. Defined results: a null or
empty text has no words, no labels and score 0; overlapping places of base phrases all count; labels are distinct and
sorted; repeated rows are judged alike; an empty table gives no rows; columns other than the two named are ignored.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from decidra.llm._common import byte_texts, lean

#: The phrases every scan reports, each with its label.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


class Template(NamedTuple):
    """A licence's wording; `keys` are the phrases without which a text isn't it."""

    label: str
    words: str
    keys: tuple[str, ...]


#: The standard wording of licences' notices and of the paragraphs by which their full texts are known.
NOTICES = (
    Template("agpl-3.0", "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license", ("gnu affero general public license",)),
    Template("apache-2.0", "licensed under the apache license version 2 0", ("apache license", "version 2 0")),
    Template("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", ("apache org licenses license 2 0",)),
    Template("apache-2.0", "apache license version 2 0 january 2004 http www apache org licenses terms and conditions for use reproduction and distribution", ("apache license version 2 0",)),
    Template("apache-2.0", "subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license to reproduce prepare derivative works of publicly display publicly perform sublicense and distribute the work", ("each contributor hereby grants to you a perpetual", "irrevocable copyright license")),
    Template("artistic-2.0", "the artistic license 2 0 everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed", ("artistic license 2 0",)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("source and binary forms", "with or without modification")),
    Template("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", ("redistributions of source code",)),
    Template("bsd", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", ("redistributions in binary form",)),
    Template("bsd", "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed", ("this software is provided by the copyright holders and contributors", "are disclaimed")),
    Template("bsd-3-clause", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ("neither the name", "endorse or promote products")),
    Template("bsl-1.0", "boost software license version 1 0 august 17th 2003 permission is hereby granted free of charge to any person or organization obtaining a copy of the software", ("boost software license",)),
    Template("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4 0",)),
    Template("cc-by-4.0", "licensed under cc by 4 0", ("cc by 4 0",)),
    Template("cc-by-3.0", "this work is licensed under the creative commons attribution 3 0 license", ("creative commons attribution 3 0",)),
    Template("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    Template("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", ("creative commons attribution noncommercial",)),
    Template("cc-by-nd", "this work is licensed under a creative commons attribution noderivatives 4 0 international license", ("creative commons attribution noderivatives",)),
    Template("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    Template("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license", ("creative commons attribution sharealike",)),
    Template("cc0-1.0", "to the extent possible under law the author has dedicated all copyright and related and neighboring rights to this work to the public domain worldwide", ("to the extent possible under law", "public domain")),
    Template("cc0-1.0", "cc0 1 0 universal public domain dedication", ("cc0 1 0 universal",)),
    Template("cddl-1.0", "the contents of this file are subject to the terms of the common development and distribution license", ("common development and distribution license",)),
    Template("epl-1.0", "all rights reserved this program and the accompanying materials are made available under the terms of the eclipse public license v1 0 which accompanies this distribution", ("eclipse public license v1 0",)),
    Template("epl-2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0", ("eclipse public license 2 0",)),
    Template("epl-2.0", "eclipse public license v 2 0 the accompanying program is provided under the terms of this eclipse public license", ("eclipse public license v 2 0",)),
    Template("gpl-2.0", "this work is licensed under the gnu general public license version 2", ("gnu general public license", "version 2")),
    Template("gpl-2.0", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", ("gnu general public license", "version 2 of the license")),
    Template("gpl-2.0", "gnu general public license version 2 june 1991 copyright c 1989 1991 free software foundation inc", ("version 2 june 1991",)),
    Template("gpl-3.0", "this work is licensed under the gnu general public license version 3", ("gnu general public license", "version 3")),
    Template("gpl-3.0", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", ("gnu general public license", "version 3 of the license")),
    Template("gpl-3.0", "gnu general public license version 3 29 june 2007 copyright c 2007 free software foundation inc", ("version 3 29 june 2007",)),
    Template("gpl-3.0", "the gnu general public license is a free copyleft license for software and other kinds of works", ("is a free copyleft license for software",)),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", ("permission to use copy modify", "with or without fee")),
    Template("lgpl", "you can redistribute it and or modify it under the terms of the gnu lesser general public license", ("gnu lesser general public license",)),
    Template("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license", ("gnu lesser general public license",)),
    Template("mit", "released under the mit license", ("mit license",)),
    Template("mit", "licensed under the mit license", ("mit license",)),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted free of charge", "copy of this software")),
    Template("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", ("copies or substantial portions of the software",)),
    Template("mit", "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so", ("to deal in the software without restriction", "sublicense and or sell copies")),
    Template("mit", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability", ("the software is provided as is", "authors or copyright holders be liable for any claim")),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
    Template("wtfpl", "do what the fuck you want to public license version 2 december 2004", ("do what the fuck you want to",)),
    Template("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", ("in no event will the authors be held liable",)),
)
#: Identifiers of licence tags, and the labels of those that have another here.
IDENTIFIERS = (
    "AGPL-3.0", "Apache-2.0", "Artistic-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC-BY-3.0", "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-ND-4.0", "CC-BY-SA-4.0", "CC0-1.0", "CDDL-1.0", "EPL-1.0", "EPL-2.0",
    "GPL-2.0", "GPL-3.0", "ISC", "LGPL-2.1", "LGPL-3.0", "MIT", "MPL-2.0", "Unlicense", "WTFPL", "Zlib",
)
LABELS = {"BSD-2-Clause": "bsd", "CC-BY-NC-4.0": "cc-by-nc", "CC-BY-ND-4.0": "cc-by-nd", "CC-BY-SA-4.0": "cc-by-sa", "LGPL-2.1": "lgpl", "LGPL-3.0": "lgpl"}


def _tag(identifier: str) -> Template:
    words = "spdx license identifier " + identifier.lower().replace("-", " ").replace(".", " ")
    return Template(LABELS.get(identifier, identifier.lower()), words, (words,))


TEMPLATES = NOTICES + tuple(_tag(i) for i in IDENTIFIERS)
AGREE = 2  # words of a key phrase that must agree on a place, where it has as many
SLACK = 3  # words by which a word or a key phrase may stand beside its place
LEAST_COVER = 0.6  # of a template's words, found in place

_KEEP = bytes(c if chr(c).isdigit() or chr(c).islower() and c < 128 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_KEEP).split()


def _line(words: list[bytes]) -> bytes:
    return b" " + b" ".join(words) + b" "


def phrase_starts(line: bytes, phrase: bytes) -> list[int]:
    """Word numbers at which a phrase stands in a line of single spaced words."""
    found, at, seen, word = [], line.find(b" " + phrase + b" "), 0, 0
    while at >= 0:
        word += line.count(b" ", seen, at)
        seen = at
        found.append(word)
        at = line.find(b" " + phrase + b" ", at + 1)
    return found


def corpus_idf(texts: DataFrame, vocabulary: set[bytes]) -> dict[bytes, float]:
    """IDF of the templates' words over all rows of (text); as many numbers come back as the templates have words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, df = 0, Counter()
        for batch in batches:
            for text in byte_texts(batch.column(0)):
                n += 1
                df.update(vocabulary.intersection(words_of(text)))
        rows = [(w.decode(), c) for w, c in df.items()] + [("", n)]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.int64())], names=["word", "n"])

    df = {r.word.encode(): r.n for r in texts.mapInArrow(lean(count), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()}
    total = df.pop(b"", 0)
    return {w: math.log((1 + total) / (1 + df.get(w, 0))) for w in vocabulary}


def place_of(number: int, start: int, index: Index, words: list[bytes]) -> float:
    """The share of a template's words that stand in place if it starts there, or 0 if a key phrase doesn't."""
    _, wanted, keys = index.templates[number]
    for key in keys:
        at = [start + i + d for i in index.key_places[number, key] for d in range(-SLACK, SLACK + 1)]
        if not any(i >= 0 and tuple(words[i : i + len(key)]) == key for i in at):
            return 0.0
    return sum(w in words[max(0, start + i - SLACK) : max(0, start + i + SLACK + 1)] for i, w in enumerate(wanted)) / len(wanted)


class Index:
    """word -> [(template, position)] over all words of all templates, and the words' IDF."""

    def __init__(self, templates: tuple[Template, ...], idf: dict[bytes, float]):
        self.templates = [(t.label, t.words.encode().split(), [tuple(k.encode().split()) for k in t.keys]) for t in templates]
        self.idf = idf
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        self.key_places: dict[tuple[int, tuple], list[int]] = {}
        self.sought: list[tuple[bytes, ...]] = []  # of each template the words that must agree
        self.key_words: list[frozenset[bytes]] = []
        rarity = lambda w: (-idf.get(w, 0.0), w)
        for number, (_, words, keys) in enumerate(self.templates):
            for position, word in enumerate(words):
                self.postings[word].append((number, position))
            for key in keys:
                self.key_places[number, key] = [i for i in range(len(words)) if tuple(words[i : i + len(key)]) == key]
            pairs = [tuple(sorted(set(key), key=rarity)[:AGREE]) for key in keys]
            self.sought.append(min(pairs, key=lambda p: ([rarity(w) for w in p], -len(p))))
            self.key_words.append(frozenset(w for key in keys for w in key))
        self.vocabulary = frozenset(self.postings)
        #: A text without any of these can hold no template's key phrases: the rarest word that each template is sought by.
        self.anchors = frozenset(s[0] for s in self.sought)

    def looked_up(self, held: set[bytes]) -> tuple[list[bytes], list[int]]:
        """(a text's licence words of highest IDF, as far down as its templates need, and those templates): held are its words."""
        possible = [n for n, keys in enumerate(self.key_words) if self.sought[n][0] in held and keys <= held]
        needed = {w for n in possible for w in self.sought[n]}
        ranked = sorted(self.vocabulary & held, key=lambda w: (-self.idf.get(w, 0.0), w)) if needed else []
        last = max((i for i, w in enumerate(ranked) if w in needed), default=-1)
        return ranked[: last + 1], possible

    def places(self, words: list[bytes]) -> Iterator[tuple[int, int]]:
        """(template, start) on which the sought words of a template agree."""
        look, possible = self.looked_up(set(words))
        if not possible:
            return
        fetched: dict[bytes, list[int]] = {w: [] for w in look}
        for position, word in enumerate(words):
            if word in fetched:
                fetched[word].append(position)
        for number in possible:
            starts = None
            for word in self.sought[number]:
                offsets = [at for n, at in self.postings[word] if n == number]
                proposed = {position - at for position in fetched[word] for at in offsets}
                starts = proposed if starts is None else starts & proposed
            last = -1 << 60
            for start in sorted(starts):
                for near in range(max(start - SLACK, last + 1), start + SLACK + 1):
                    last = near
                    yield number, near

    def match(self, words: list[bytes]) -> dict[str, float]:
        """label -> the best share of a template's words that stand in place, of the templates that verify."""
        best: dict[str, float] = {}
        for number, start in self.places(words):
            cover = place_of(number, start, self, words)
            if cover >= LEAST_COVER:
                label = self.templates[number][0]
                best[label] = max(best.get(label, 0.0), cover)
        return best


def scan_licenses(documents: DataFrame, templates: tuple[Template, ...] = TEMPLATES, base: dict[str, str] = BASE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score (0 to 1: cover of the best match)."""
    texts = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    vocabulary = {w for t in templates for w in t.words.encode().split()}
    index = Index(templates, corpus_idf(texts.select("text"), vocabulary))
    phrases = [(p.encode(), label) for p, label in base.items()]

    def judge(text: bytes) -> tuple:
        words = words_of(text)
        held = set(words)
        licensed = not index.anchors.isdisjoint(held)
        if not licensed and not any(p.split()[0] in held for p, _ in phrases):
            return len(words), 0, None, None, "", "", 0.0
        line = _line(words)
        places = {label: phrase_starts(line, p) for p, label in phrases}
        found = sorted(x for xs in places.values() for x in xs)
        own = {label for label, xs in places.items() if xs}
        matched = index.match(words) if licensed else {}
        score = 1.0 if own else max(matched.values(), default=0.0)
        return len(words), len(found), found[0] if found else None, found[-1] if found else None, ",".join(sorted(own)), ",".join(sorted(own | set(matched))), score

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
        names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
        for batch in batches:
            columns = list(zip(*map(judge, byte_texts(batch.column(1))), strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=["doc_id", *names])

    return texts.mapInArrow(lean(per_batch), "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
