"""License scans: an exact set-similarity join of text blocks with license templates, and phrase places.

A block is a line of a text. Blocks and templates are sets of words. Template words are ordered by rarity in the
documents, counted over all of them (ties by the word). A block matches a template if it holds at least
``threshold`` of the template's words. Such a block holds one of the template's ``size - needed + 1`` rarest words (the
prefix), has ``needed`` words itself (length), and, from where in the order the first shared word stands, enough
template words are left (position). What passes is counted exactly. Templates wrapped over lines are found in windows
of as many words as the template has, which cross line ends.

Nulls and empty texts have no words: no label, score 0. Templates are broadcast in blocks of at most TEMPLATE_BYTES;
every block is joined with all documents. Repeated rows are judged each on its own.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, map_slices, map_texts
from .words import lines_and_words, words_of

THRESHOLD = 0.8
#: Text of the templates in one broadcast; a longer template makes a block of its own.
TEMPLATE_BYTES = 4 << 20

PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

TEMPLATES = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
    ],
    "mit": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    ],
    "gpl-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License",
    ],
    "cc-by-nc-4.0": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    ],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted"],
    "all-rights-reserved": ["All rights reserved."],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
}


class Index:
    """Templates with their words in order of rarity, and the prefix words that point to them."""

    def __init__(self, templates: dict[str, list[str]], threshold: float, counts: dict[bytes, int]) -> None:
        self.sets: list[tuple[str, frozenset[bytes], list[bytes], int]] = []
        for label, texts in sorted(templates.items()):
            for text in texts:
                words = frozenset(words_of(text.encode()))
                if words:
                    ordered = sorted(words, key=lambda w: (counts.get(w, 0), w))
                    self.sets.append((label, words, ordered, max(1, math.ceil(threshold * len(words) - 1e-9))))
        self.sizes = [len(words_of(t.encode())) for _, texts in sorted(templates.items()) for t in texts if words_of(t.encode())]
        self.prefix: dict[bytes, list[int]] = {}
        for k, (_, _, ordered, needed) in enumerate(self.sets):
            for word in ordered[: len(ordered) - needed + 1]:
                self.prefix.setdefault(word, []).append(k)
        self.keys = frozenset(self.prefix)

    def matches(self, block: set[bytes]) -> Iterator[tuple[str, float]]:
        for k in {k for word in block & self.keys for k in self.prefix[word]}:
            label, words, ordered, needed = self.sets[k]
            if len(block) < needed:
                continue
            first = next(i for i, word in enumerate(ordered) if word in block)
            if len(ordered) - first < needed:
                continue
            shared = len(block & words)
            if shared >= needed:
                yield label, shared / len(words)

    def windows(self, words: list[bytes]) -> Iterator[tuple[int, str, float]]:
        """For each template that a window of its size matches, the first of its best ones: start, label, containment."""
        every = set(words)
        for k in {k for word in every & self.keys for k in self.prefix[word]}:
            label, own, _, needed = self.sets[k]
            if len(own & every) < needed:
                continue
            places = [i for i, word in enumerate(words) if word in own]
            inside: dict[bytes, int] = {}
            best, start, first = 0, 0, 0
            for i in places:
                inside[words[i]] = inside.get(words[i], 0) + 1
                while places[first] <= i - self.sizes[k]:
                    gone = words[places[first]]
                    inside[gone] -= 1
                    if not inside[gone]:
                        del inside[gone]
                    first += 1
                if len(inside) > best:
                    best, start = len(inside), places[first]
            if best >= needed:
                yield start, label, best / len(own)


Templates = dict[str, list[str]]


def _template_words(templates: Templates) -> frozenset[bytes]:
    return frozenset(w for texts in templates.values() for t in texts for w in words_of(t.encode()))


def _template_blocks(templates: Templates | DataFrame, block_bytes: int) -> Iterator[Templates]:
    """The templates in blocks of at most ``block_bytes`` of text; a longer one makes a block of its own."""
    if isinstance(templates, DataFrame):
        label, text = templates.columns[:2]
        pairs = ((r[0], r[1]) for r in templates.select(label, F.col(text).cast("string")).where(F.col(label).isNotNull() & F.col(text).isNotNull()).toLocalIterator())
    else:
        pairs = ((label, t) for label, texts in templates.items() for t in texts)
    block: Templates = {}
    size = 0
    for label, text in pairs:
        n = len(text.encode())
        if block and size + n > block_bytes:
            yield block
            block, size = {}, 0
        block.setdefault(label, []).append(text)
        size += n
    if block:
        yield block


def count_words(docs: DataFrame, id_col: str, text_col: str, wanted: frozenset[bytes]) -> dict[bytes, int]:
    """How many blocks hold each wanted word, over all documents; as many rows as wanted words."""

    def work(batch: pa.RecordBatch) -> Iterator[dict]:
        total: dict[bytes, int] = {}
        for text in as_bytes(batch.column(1)):
            for line in text.split(b"\n"):
                for word in wanted.intersection(words_of(line)):
                    total[word] = total.get(word, 0) + 1
        yield {"word": list(total), "n": list(total.values())}

    counted = map_texts(docs, id_col, text_col, "word binary, n long", work)
    return {bytes(r[0]): r[1] for r in counted.groupBy("word").agg(F.sum("n").alias("n")).collect()}


FOUND = (
    "n_words long, phrases array<struct<label:string,start:long>>, blocks array<struct<line:long,label:string,containment:double>>, "
    "windows array<struct<start:long,label:string,containment:double>>"
)


def scan_licenses(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    templates: Templates | DataFrame | None = None,
    phrases: dict[str, str] | None = None,
    threshold: float = THRESHOLD,
    block_bytes: int = TEMPLATE_BYTES,
) -> DataFrame:
    """Per row: id, ``n_words``, ``phrases`` (array of label, start word), ``blocks`` (array of line from 0, label,
    containment), in order of place, and ``windows`` (array of start word, label, containment).

    templates: texts by label, or a table whose first two columns are label and text; rows with a null count as none."""
    templates = TEMPLATES if templates is None else templates
    phrases = PHRASES if phrases is None else phrases
    wanted = [(b" ".join(words_of(p.encode())), label) for p, label in phrases.items()]
    spark = docs.sparkSession
    frame = docs.select(F.col(f"`{id_col}`").alias("key"), F.col(f"`{text_col}`").cast("string").alias("text"))
    kind, blocks = dict(frame.dtypes)["key"], _template_blocks(templates, block_bytes)
    block, first = next(blocks, {}), True
    while block is not None:
        following = next(blocks, None)
        index = spark.sparkContext.broadcast(Index(block, threshold, count_words(docs, id_col, text_col, _template_words(block)) if block else {}))
        schema = f"key {kind}, " + ("" if following is None else "text string, ") + FOUND
        frame = map_slices(frame, "text", schema, _scanner(index, wanted, first, following is not None))
        block, first = following, False
    return frame.withColumnRenamed("key", id_col)


def _scanner(index, wanted: list[tuple[bytes, str]], first: bool, more: bool) -> Callable[[pa.RecordBatch], Iterator[list]]:
    """Adds what a block of templates finds to the columns of the blocks before it; the first also adds phrases. The text
    stays if there are more blocks to come."""

    def work(batch: pa.RecordBatch) -> Iterator[list]:
        found = index.value
        n_words, places, blocks, windows = [], [], [], []
        before = [batch.column(k).to_pylist() for k in range(2, 6)] if not first else None
        for k, text in enumerate(as_bytes(batch.column(1))):
            tokens = lines_and_words(text)
            words = [w for w in tokens if w != b"\x01"] if b"\x01" in tokens else tokens
            n_words.append(len(words))
            places.append(phrase_places(words, wanted) if first else before[1][k])
            here, wrapped = ([], []) if first else (before[2][k], before[3][k])
            if not found.keys.isdisjoint(words):
                wrapped = wrapped + [{"start": a, "label": b, "containment": s} for a, b, s in found.windows(words)]
                here = here + [{"line": n, "label": a, "containment": s} for n, line in lines_of(tokens) for a, s in found.matches(line)]
            blocks.append(sorted(here, key=lambda x: tuple(x.values())))
            windows.append(sorted(wrapped, key=lambda x: tuple(x.values())))
        yield [batch.column(0), *([batch.column(1)] if more else []), n_words, places, blocks, windows]

    return work


def lines_of(tokens: list[bytes]) -> Iterator[tuple[int, set[bytes]]]:
    """Number and set of words of each line that has words."""
    line: set[bytes] = set()
    number = 0
    for token in [*tokens, b"\x01"]:
        if token != b"\x01":
            line.add(token)
            continue
        if line:
            yield number, line
        line = set()
        number += 1


def phrase_places(words: list[bytes], wanted: list[tuple[bytes, str]]) -> list[dict]:
    """Every place where a phrase's words stand consecutively."""
    whole, out = b" " + b" ".join(words) + b" ", []
    for phrase, label in wanted:
        at, before, start = whole.find(b" " + phrase + b" "), 0, 0
        while at >= 0:
            start += whole.count(b" ", before, at)
            out.append({"label": label, "start": start})
            before, at = at, whole.find(b" " + phrase + b" ", at + 1)
    return sorted(out, key=lambda x: (x["start"], x["label"]))


def oracle_sql() -> str:
    """DuckDB SQL of the registered query: phrases, and sets of words in lines and in windows as long as a template."""
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    word = "'[0-9a-z\\x{80}-\\x{10FFFF}]+'"
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    templates = ", ".join(f"({k}, {quoted(label)}, {quoted(t.lower())})" for k, (label, t) in enumerate((a, t) for a, texts in TEMPLATES.items() for t in texts))
    phrases = ", ".join(f"({quoted(p)}, {quoted(label)})" for p, label in PHRASES.items())
    return f"""
WITH template AS (
  SELECT k, label, len(w) AS size, list_distinct(w) AS own, CAST(ceil({THRESHOLD} * len(list_distinct(w)) - 1e-9) AS BIGINT) AS needed
  FROM (SELECT k, label, regexp_extract_all(t, {word}) AS w FROM (VALUES {templates}) v(k, label, t))
), own AS (
  SELECT k, label, size, needed, len(own) AS n, unnest(own) AS word FROM template
), phrase AS (
  SELECT ' ' || p || ' ' AS p, label FROM (VALUES {phrases}) v(p, label)
), doc AS (
  SELECT doc_id, regexp_extract_all(s, {word}) AS w, string_split(s, chr(10)) AS lines FROM (SELECT doc_id, {lower} AS s FROM documents)
), placed AS (
  SELECT DISTINCT doc_id, label, k - 1 AS start FROM (
    SELECT doc_id, label, p, w, unnest(range(1, len(w) + 1)) AS k FROM doc, phrase WHERE contains(' ' || array_to_string(w, ' ') || ' ', p)
  ) WHERE array_to_string(w[k : k + len(string_split(trim(p), ' ')) - 1], ' ') = trim(p)
), based AS (
  SELECT doc_id, count(*) AS n_base, min(start) AS first_word, max(start) AS last_word FROM placed GROUP BY doc_id
), line AS (
  SELECT doc_id, l, list_distinct(regexp_extract_all(lines[l], {word})) AS w FROM doc, unnest(range(1, len(lines) + 1)) AS r(l)
), in_line AS (
  SELECT doc_id, l, k, label, count(*) / any_value(n) AS share
  FROM (SELECT doc_id, l, unnest(w) AS word FROM line) JOIN own USING (word) GROUP BY doc_id, l, k, label HAVING count(*) >= any_value(needed)
), place AS (
  SELECT doc_id, i, k, label, size, needed, n, word FROM (SELECT doc_id, i, w[i] AS word FROM doc, unnest(range(1, len(w) + 1)) AS r(i)) JOIN own USING (word)
), enough AS (
  SELECT doc_id, k FROM place GROUP BY doc_id, k HAVING count(DISTINCT word) >= any_value(needed)
), in_window AS (
  SELECT a.doc_id, a.i, a.k, a.label, count(DISTINCT b.word) / any_value(a.n) AS share
  FROM (SELECT * FROM place SEMI JOIN enough USING (doc_id, k)) a JOIN place b ON a.doc_id = b.doc_id AND a.k = b.k AND b.i <= a.i AND b.i > a.i - a.size
  GROUP BY a.doc_id, a.i, a.k, a.label HAVING count(DISTINCT b.word) >= any_value(a.needed)
), named AS (
  SELECT doc_id, label, share, false AS base FROM in_line UNION ALL SELECT doc_id, label, share, false FROM in_window UNION ALL SELECT doc_id, label, 1.0, true FROM placed
), labelled AS (
  SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, max(share) AS score
  FROM named GROUP BY doc_id
)
SELECT doc.doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  coalesce(score, 0.0) AS score
FROM doc LEFT JOIN based USING (doc_id) LEFT JOIN labelled USING (doc_id)
"""
