"""License scan by an exact set-similarity join of text blocks with license templates.

A block of template T is any run of |T| + |T| // 4 consecutive words of a text (|T|: the template's words), over line ends
too. It contains T when |words(T) & words(B)| >= ceil(threshold * |words(T)|), counting distinct words. Only words of
templates can count, so the global frequency order is that of the template words over the whole corpus, counted by Spark
(a table bounded by the templates, which are fixed values). With T's words from rare to frequent:

* prefix filter: B must have one of T's first |T| - need + 1 words, so only places around these are looked at;
* length filter: such a place must have `need` distinct words of T;
* positional filter: if the first word that a place has is T's i-th, at most |T| - i words can be shared.

A window over the template words of the places that pass counts distinct ones exactly, in one pass. No block that meets
the threshold can fail a filter. Blocks that overlap are one finding, with the largest containment.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from artifactlink.llm.common import ASCII_LOWER, project, small_batches, text_bytes, tidy

#: Fixed values of the base scan: phrase and label.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: License statements, short ones and the openings of license texts, and their labels.
TEMPLATES: list[tuple[str, str]] = [
    ("released under the mit license", "mit"),
    ("licensed under the apache license version 2.0", "apache"),
    ("this work is licensed under the gnu general public license version 3", "gpl"),
    ("licensed under the gnu lesser general public license version 2.1", "lgpl"),
    ("licensed under the gnu affero general public license version 3", "agpl"),
    ("licensed under cc by nc 4.0", "cc-by-nc"),
    ("licensed under cc by sa 4.0", "cc-by-sa"),
    ("licensed under cc by 4.0", "cc-by"),
    ("licensed under the creative commons attribution license", "cc-by"),
    ("this work is dedicated to the public domain cc0 1.0 universal", "cc0"),
    ("licensed under the mozilla public license version 2.0", "mpl"),
    ("licensed under the eclipse public license version 2.0", "epl"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("licensed under the bsd 3 clause license", "bsd"),
    ("released under the isc license", "isc"),
    ("released into the public domain under the unlicense", "unlicense"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit"),
    ("all rights reserved proprietary and confidential", "proprietary"),
    (
        "permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the software",
        "mit",
    ),
    ("permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies", "isc"),
    (
        "redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
        "redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
        "bsd",
    ),
    ("you may not use this file except in compliance with the license. you may obtain a copy of the license at http://www.apache.org/licenses/LICENSE-2.0", "apache"),
    (
        "unless required by applicable law or agreed to in writing, software distributed under the license is distributed on an as is basis, "
        "without warranties or conditions of any kind, either express or implied",
        "apache",
    ),
    ("this program is free software: you can redistribute it and/or modify it under the terms of the gnu general public license as published by the free software foundation", "gpl"),
    ("this library is free software; you can redistribute it and/or modify it under the terms of the gnu lesser general public license as published by the free software foundation", "lgpl"),
    ("this program is free software: you can redistribute it and/or modify it under the terms of the gnu affero general public license as published by the free software foundation", "agpl"),
    ("this source code form is subject to the terms of the mozilla public license, v. 2.0. if a copy of the mpl was not distributed with this file, you can obtain one at", "mpl"),
    ("this software is provided as-is, without any express or implied warranty. in no event will the authors be held liable for any damages arising from the use of this software", "zlib"),
    ("this is free and unencumbered software released into the public domain. anyone is free to copy, modify, publish, use, compile, sell, or distribute this software", "unlicense"),
    ("distributed under the boost software license, version 1.0", "boost"),
    ("this work is licensed under a creative commons attribution noncommercial 4.0 international license", "cc-by-nc"),
    ("this work is licensed under a creative commons attribution sharealike 4.0 international license", "cc-by-sa"),
    ("this work is licensed under a creative commons attribution 4.0 international license", "cc-by"),
]
#: Bytes of words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing; all others become spaces.
_WORD = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in ASCII_LOWER)


def license_words(text: bytes) -> list[bytes]:
    return text.translate(_WORD).split()


class Index:
    """Templates as prefix lists over words ordered from rare to frequent."""

    def __init__(self, templates: list[tuple[str, str]], order: dict[bytes, int], threshold: float):
        self.entries: dict[bytes, list[tuple[int, int]]] = {}
        self.templates = []
        for k, (text, label) in enumerate(templates):
            words = license_words(text.encode())
            size = len(words) + len(words) // 4
            words = sorted(set(words), key=lambda w: (order.get(w, 0), w))
            need = max(1, ceil(threshold * len(words) - 1e-9))
            self.templates.append((len(words), frozenset(words), need, label, size))
            for i, w in enumerate(words[: len(words) - need + 1]):
                self.entries.setdefault(w, []).append((k, i))
        self.rare = frozenset(self.entries)
        self.words = frozenset(w for _, full, *_ in self.templates for w in full)

    def places(self, hits: list[tuple[int, bytes]]) -> dict[int, list[list[int]]]:
        """Of each template that a prefix word calls for: runs [from, to, least number of such a word] of words around them."""
        out: dict[int, list[list[int]]] = {}
        for at, w in hits:
            for k, i in self.entries.get(w, ()):
                size, runs = self.templates[k][4], out.setdefault(k, [])
                if runs and at - size < runs[-1][1]:
                    runs[-1][1], runs[-1][2] = at + size, min(i, runs[-1][2])
                else:
                    runs.append([at - size + 1, at + size, i])
        return out

    def matches(self, words: list[bytes]) -> Iterator[tuple[int, int, int, float]]:
        """(template, first word, last word, containment) of every finding in a text."""
        hits = [(i, w) for i, w in enumerate(words) if w in self.words]
        at = [i for i, _ in hits]
        for k, runs in self.places(hits).items():
            total, full, need, _, size = self.templates[k]
            for lo, hi, first in runs:
                own = [h for h in hits[bisect_left(at, lo) : bisect_left(at, hi)] if h[1] in full]
                if min(len({w for _, w in own}), total - first) >= need:
                    yield from ((k, a, b, n / total) for a, b, n in _findings(own, size, need))


def _findings(own: list[tuple[int, bytes]], size: int, need: int) -> Iterator[tuple[int, int, int]]:
    """Runs of overlapping windows of `size` words that have `need` distinct ones: first and last word, most distinct words."""
    count: dict[bytes, int] = {}
    left, found = 0, None
    for i, w in own:
        count[w] = count.get(w, 0) + 1
        while i - own[left][0] >= size:
            gone = own[left][1]
            count[gone] -= 1
            if not count[gone]:
                del count[gone]
            left += 1
        if len(count) >= need:
            start = own[left][0]
            if found and start <= found[1]:
                found = (found[0], i, max(found[2], len(count)))
            else:
                if found:
                    yield found
                found = (start, i, len(count))
    if found:
        yield found


def template_order(docs: DataFrame, templates: list[tuple[str, str]]) -> dict[bytes, int]:
    """Occurrences of the templates' words over all texts; the result has a row per such word at most."""
    wanted = frozenset(w for t, _ in templates for w in license_words(t.encode()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c: Counter = Counter()
        for b in batches:
            for t in text_bytes(b):
                words = license_words(t)
                if not wanted.isdisjoint(words):
                    c.update(w for w in words if w in wanted)
        yield pa.record_batch([pa.array(list(c), pa.binary()), pa.array(list(c.values()), pa.int64())], ["word", "n"])

    rows = docs.select("text").mapInArrow(tidy(run), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {bytes(r.word): r.n for r in rows}


def scan_text(text: bytes, index: Index, phrases: list[tuple[list[bytes], str]]) -> tuple:
    """n_words, n_base, first_word, last_word, base labels, labels, score, findings of `Index.matches`."""
    words = license_words(text)
    have, starts, base = set(words), [], set()
    for p, label in phrases:
        if have.issuperset(p):
            at = [i for i, w in enumerate(words) if w == p[0] and words[i : i + len(p)] == p]
            starts += at
            base |= {label} if at else set()
    found = [] if index.rare.isdisjoint(have) else list(index.matches(words))
    labels = base | {index.templates[k][3] for k, *_ in found}
    score = 1.0 if starts else max((c for *_, c in found), default=0.0)
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), base, labels, score, found


def license_scan(
    docs: DataFrame,
    templates: list[tuple[str, str]] = TEMPLATES,
    threshold: float = 0.8,
    phrases: dict[str, str] = PHRASES,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per input row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, blocks.

    `blocks` lists every finding: template number, first and last word, containment. The score is 1 where a base phrase
    stands, else the largest containment of a block that meets the threshold, else 0. A text of any length is scanned in
    time that follows its words. Null and empty
    texts have no words, empty labels and score 0. Null doc_ids and rows that repeat are scanned as any other row. Other
    columns of the input play no part. An empty table gives no rows.
    """
    small_batches(docs)
    rows = project(docs, doc_id=id_col, text=text_col)
    order = template_order(rows, templates)
    block = pa.list_(pa.struct([("template", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("containment", pa.float64())]))
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "blocks"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), block]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, base_phrases = Index(templates, order, threshold), [(p.encode().split(), label) for p, label in phrases.items()]
        for b in batches:
            ids, out = b.column(0).to_pylist(), []
            for i, t in zip(ids, text_bytes(b), strict=True):
                n, k, lo, hi, base, labels, score, found = scan_text(t, index, base_phrases)
                out.append((i, n, k, lo, hi, ",".join(sorted(base)), ",".join(sorted(labels)), score, [{"template": k, "first_word": a, "last_word": b, "containment": c} for k, a, b, c in found]))
            cols = list(zip(*out, strict=True)) if out else [[]] * len(names)
            yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, blocks array<struct<template:long,first_word:long,last_word:long,containment:double>>"
    return rows.mapInArrow(tidy(run), schema)

