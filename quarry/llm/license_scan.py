"""Licence detection by a positional index of rare licence words.

Base: every place where the words of a known phrase stand consecutively.
Beyond it, templates (notices and short forms) are looked up. Document
frequencies of all licence words are counted over the whole corpus. All
words of the templates have positional postings. Of each file, for each
template whose mandatory phrases it can hold, those of its own words that
have postings are ranked by inverse document frequency; the highest are
looked up, as many as a place that holds half of the template cannot be
without, and each occurrence votes for the place where the template would
begin. Where different words agree on about the same place, the mandatory
phrases are verified, and the template counts if half of its words stand
there in order. Words put in between (line marks, comment signs) take
nothing from that, up to half as many as the template has.

Defined cases: null and empty texts have no words, no labels and score 0.
Very long texts are scanned whole. Overlapping occurrences all count.
Repeated rows give a row each; words of equal frequency are taken in
alphabetical order. Empty input gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator
from math import log

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import as_bytes, slices, small_batches, words_of

#: Phrases that decide alone, with their labels.
BASE = [
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
]
#: Label, text of a notice or short form, phrases that must stand in it (none: all of it).
TEMPLATES = [
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
        "documentation files the software to deal in the software without restriction including without limitation the "
        "rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
        ["permission is hereby granted free of charge", "without restriction"],
    ),
    (
        "apache",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with "
        "the license you may obtain a copy of the license at",
        ["you may not use this file except in compliance with the license"],
    ),
    (
        "gpl",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
        "public license as published by the free software foundation",
        ["redistribute it and or modify it under the terms of the gnu general public license"],
    ),
    (
        "lgpl",
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general "
        "public license as published by the free software foundation",
        ["under the terms of the gnu lesser general public license"],
    ),
    (
        "agpl",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general "
        "public license as published by the free software foundation",
        ["under the terms of the gnu affero general public license"],
    ),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the "
        "following conditions are met",
        ["redistribution and use in source and binary forms"],
    ),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
        "granted provided that the above copyright notice and this permission notice appear in all copies",
        ["for any purpose with or without fee is hereby granted"],
    ),
    (
        "mpl",
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not "
        "distributed with this file you can obtain one at",
        ["subject to the terms of the mozilla public license"],
    ),
    (
        "epl",
        "this program and the accompanying materials are made available under the terms of the eclipse public license "
        "which is available at",
        ["under the terms of the eclipse public license"],
    ),
    (
        "zlib",
        "this software is provided as is without any express or implied warranty in no event will the authors be held "
        "liable for any damages arising from the use of this software permission is granted to anyone to use this software "
        "for any purpose including commercial applications and to alter it and redistribute it freely",
        ["permission is granted to anyone to use this software for any purpose"],
    ),
    (
        "boost",
        "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and "
        "accompanying documentation covered by this license",
        ["any person or organization obtaining a copy of the software"],
    ),
    (
        "cc-by",
        "this work is licensed under the creative commons attribution 4 0 international license to view a copy of this "
        "license visit",
        ["licensed under the creative commons attribution"],
    ),
    (
        "cc0",
        "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",
        ["waived all copyright and related or neighboring rights"],
    ),
    (
        "unlicense",
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish "
        "use compile sell or distribute this software",
        ["free and unencumbered software released into the public domain"],
    ),
    ("gpl-2", "gnu general public license version 2", []),
    ("gpl-3", "gnu general public license version 3", []),
    ("lgpl", "gnu lesser general public license", []),
    ("agpl", "gnu affero general public license", []),
    ("apache-2.0", "apache license version 2 0", []),
    ("bsd", "bsd license", []),
    ("mpl", "mozilla public license", []),
    ("epl", "eclipse public license", []),
    ("cc-by", "creative commons attribution", []),
    ("cc-by-sa", "cc by sa", []),
    ("cc-by-nd", "cc by nd", []),
    ("cc-by-nc", "cc by nc", []),
    ("cc-by-nc-sa", "cc by nc sa", []),
    ("cc-by-nc-nd", "cc by nc nd", []),
    ("cc0", "cc0 1 0", []),
    ("mit", "spdx license identifier mit", []),
    ("apache-2.0", "spdx license identifier apache 2 0", []),
    ("gpl-2", "spdx license identifier gpl 2 0", []),
    ("gpl-3", "spdx license identifier gpl 3 0", []),
    ("lgpl", "spdx license identifier lgpl", []),
    ("agpl", "spdx license identifier agpl", []),
    ("bsd", "spdx license identifier bsd", []),
    ("isc", "spdx license identifier isc", []),
    ("mpl", "spdx license identifier mpl", []),
    ("epl", "spdx license identifier epl", []),
    ("zlib", "spdx license identifier zlib", []),
    ("boost", "spdx license identifier bsl", []),
    ("cc-by", "spdx license identifier cc by", []),
    ("cc0", "spdx license identifier cc0", []),
    ("unlicense", "spdx license identifier unlicense", []),
]
#: Different words that must agree on a place, words put into a notice's mandatory phrase at most, share of a template in order.
VOTES, PUT_IN, COVERED = 2, 2, 0.5


def _places(words: list[bytes], at: dict[bytes, list[int]], phrase: list[bytes]) -> list[int]:
    """All starts of a phrase. at: positions of its first word."""
    return [i for i in at.get(phrase[0], ()) if words[i : i + len(phrase)] == phrase]


def stands(words: list[bytes], start: int, phrase: list[bytes], put_in: int) -> bool:
    """Whether a phrase starts here, with put_in other words between its words at most."""
    if words[start : start + 1] != phrase[:1]:
        return False
    at, last = start, min(len(words), start + len(phrase) + put_in)
    for w in phrase:
        while at < last and words[at] != w:
            at += 1
        if at >= last:
            return False
        at += 1
    return True


def share_in_order(words: list[bytes], template: list[bytes]) -> float:
    """Share of a template that stands among words in its order: their longest common subsequence, by bits of one number."""
    masks: dict[bytes, int] = defaultdict(int)
    for i, w in enumerate(template):
        masks[w] |= 1 << i
    whole = (1 << len(template)) - 1
    row = whole
    for w in words:
        if mask := masks.get(w):
            both = row & mask
            row = ((row + both) | (row & ~mask)) & whole
    return (len(template) - row.bit_count()) / len(template)


class Scanner:
    """base: (phrase, label); templates: (label, text, mandatory phrases); frequency: documents by word."""

    def __init__(self, base: list, templates: list, frequency: dict[bytes, int], documents: int):
        self.base = [(p.encode().split(), label) for p, label in base]
        self.templates = [(label, text.encode().split(), [k.encode().split() for k in keys or [text]], PUT_IN if keys else 0) for label, text, keys in templates]
        self.postings: list[dict[bytes, list[int]]] = []
        self.idf = {w: log((1 + documents) / (1 + frequency.get(w, 0))) for _, words, _, _ in self.templates for w in words}
        self.gates: dict[bytes, list[int]] = defaultdict(list)
        for n, (_, words, keys, _) in enumerate(self.templates):
            at: dict[bytes, list[int]] = defaultdict(list)
            for offset, w in enumerate(words):
                at[w].append(offset)
            self.postings.append(dict(at))
            # no place without the rarest word of its mandatory phrases
            self.gates[min((w for k in keys for w in k), key=self._rank)].append(n)
        self.firsts = {p[0] for p, _ in self.base}
        self.gate_words = frozenset(self.gates)
        self.looked_up = self.gate_words | self.firsts

    def _rank(self, word: bytes) -> tuple[float, bytes]:
        return -self.idf[word], word

    def __call__(self, text: bytes | None) -> tuple[int, list[int], set[str], set[str], float]:
        """Words, sorted starts of base phrases, base labels, the method's labels, score."""
        words = words_of(text)
        if self.looked_up.isdisjoint(words):
            return len(words), [], set(), set(), 0.0
        present = set(words)
        maybe = [n for w in self.gate_words & present for n in self.gates[w]]
        wanted = self.firsts.union(*(self.postings[n] for n in maybe)) & present
        at: dict[bytes, list[int]] = defaultdict(list)
        for i, w in enumerate(words):
            if w in wanted:
                at[w].append(i)
        starts, base = [], set()
        for phrase, label in self.base:
            if found := _places(words, at, phrase):
                starts += found
                base.add(label)
        labels, score = set(), 1.0 if base else 0.0
        for n in sorted(maybe):
            if share := self._best(n, words, at):
                labels.add(self.templates[n][0])
                score = max(score, share)
        return len(words), sorted(starts), base, labels, score

    def _looked_up(self, offsets: dict[bytes, list[int]], at: dict[bytes, list[int]], length: int) -> list[bytes]:
        """The file's rarest words of a template, as many as no place that holds enough of it can be without.

        Such a place misses ``spare`` of the template's words at most, so of looked-up words
        that stand for more, whichever one is left out, two stand there.
        """
        spare = int(length * (1 - COVERED)) - sum(len(o) for w, o in offsets.items() if w not in at)
        found, total, most = [], 0, 0
        if spare >= 0:
            for w in sorted(offsets.keys() & at.keys(), key=self._rank):
                found.append(w)
                total, most = total + len(offsets[w]), max(most, len(offsets[w]))
                if total - most > spare:
                    break
        return found

    def _best(self, n: int, words: list[bytes], at: dict[bytes, list[int]]) -> float:
        """The largest share in order of template n at a place that its postings and phrases agree on, 0 if none has enough."""
        _, template, keys, put_in = self.templates[n]
        offsets, best = self.postings[n], 0.0
        rare = self._looked_up(offsets, at, len(template))
        votes = sorted((i - offset, w) for w in rare for i in at[w] for offset in offsets[w])
        begins = [begin for begin, _ in votes]
        before, reach = first_place(template, keys[0]), len(template) + len(template) // 2 + PUT_IN
        for place in at.get(keys[0][0], ()) if votes else ():
            lo, hi = bisect_left(begins, place - before - reach), bisect_right(begins, place - before + reach)
            agreed = set()
            for _, w in votes[lo:hi]:
                agreed.add(w)
                if len(agreed) >= VOTES:
                    break
            if len(agreed) < min(VOTES, len(rare)) or not stands(words, place, keys[0], put_in):
                continue
            here = around(words, template, before, place)
            if all(any(stands(here, i, k, put_in) for i in range(len(here))) for k in keys):
                best = max(best, share_in_order(here, template))
                if best == 1:
                    break
        return best if best >= COVERED else 0.0


def first_place(template: list[bytes], phrase: list[bytes]) -> int:
    return next(o for o in range(len(template)) if template[o : o + len(phrase)] == phrase)


def around(words: list[bytes], template: list[bytes], before: int, place: int) -> list[bytes]:
    """The words that a template can cover whose first mandatory phrase, the word number before of it, starts at place; half as many may be put in."""
    after = len(template) - before
    return words[max(0, place - before - before // 2) : place + after + after // 2 + PUT_IN]


def frequencies(docs: DataFrame, words: list[bytes]) -> tuple[dict[bytes, int], int]:
    """In how many texts each of the words stands, and the number of texts; counted over all rows."""
    wanted = frozenset(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter[bytes] = Counter({b"": batch.num_rows})
            for part in slices(batch):
                for text in as_bytes(part.column(0)):
                    counts.update(wanted.intersection(words_of(text)))
            yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in counts]), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    rows = small_batches(docs).select("text").mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).collect()
    found = {r["word"].encode(): r["n"] for r in rows}
    return found, found.pop(b"", 0)


def scan(docs: DataFrame, base: list = BASE, templates: list = TEMPLATES) -> DataFrame:
    """doc_id, n_words, base_places (sorted), base_labels, labels (both sorted arrays), score of every row."""
    frequency, documents = frequencies(docs, sorted({w for _, text, _ in templates for w in text.encode().split()}))
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(base, templates, frequency, documents)
        for batch in batches:
            for part in slices(batch):
                found = [scanner(t) for t in as_bytes(part.column(1))]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array([f[0] for f in found], pa.int64()),
                        pa.array([f[1] for f in found], pa.list_(pa.int64())),
                        pa.array([sorted(f[2]) for f in found], pa.list_(pa.string())),
                        pa.array([sorted(f[2] | f[3]) for f in found], pa.list_(pa.string())),
                        pa.array([f[4] for f in found], pa.float64()),
                    ],
                    names=["doc_id", "n_words", "base_places", "base_labels", "labels", "score"],
                )

    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, n_words bigint, base_places array<bigint>, base_labels array<string>, labels array<string>, score double"
    )
