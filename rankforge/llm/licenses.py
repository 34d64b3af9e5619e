"""License scans: an exact set-similarity join of text blocks with license templates.

A template is a statement; a block is a line or a run of lines that is no longer than the statement wrapped at WRAP characters, so that statements
are found however they are wrapped and whatever comment marks stand before the lines. Both are sets of words (runs of ASCII letters and digits,
lower case). The join finds every block that holds at least `threshold` of a template's words and has no shorter such block inside it.

A block can only meet the threshold if its document does, so the join runs over documents first. Words are ordered by
the number of documents of the whole corpus that hold them, rarest first. With c the overlap a template needs:
length filter: the document has at least c of the templates' words; prefix filter: some word is among the first |T| - c + 1 of the template and
the first |D| - c + 1 of the document; positional filter: the words after the first shared one suffice to reach c. Pairs
that pass are verified by their exact overlap, and their lines are searched for blocks. Words outside all templates cannot match and are left out of the
documents, which keeps every filter exact. The corpus is read once; what is kept of it are the templates' words with the numbers of their lines.

Cases: null and empty texts have no blocks. Lines are numbered from 1 and compared whole, whatever their length; blank lines count as lines.
Repeated rows are reported once each; blocks that tie on several templates are reported for each. An empty table gives
an empty result. Other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankforge.llm.shared import lean, narrow, pick, written
from rankforge.llm.textbytes import PIECE, each_part, hash_word, lowered, pieces, rows_of, word_hashes, word_spans

THRESHOLD, WRAP = 0.8, 20
ASCII_WORD = np.zeros(256, dtype=bool)
ASCII_WORD[[*range(48, 58), *range(97, 123)]] = True
TEMPLATES = {
    "mit": "Released under the MIT License.",
    "mit-notice": "Licensed under the MIT License.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-use": "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-2.0": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "lgpl-2.1": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License",
    "agpl-3.0": "This program is licensed under the GNU Affero General Public License, version 3.",
    "bsd-3-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "cc-by-4.0": "Licensed under CC BY 4.0.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
    "cc-by-text": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "all-rights-reserved": "All rights reserved.",
    "proprietary": "Proprietary and confidential. All rights reserved. Unauthorized copying of this file is strictly prohibited.",
}


def words_of(text: str) -> list[str]:
    return sorted(set(re.findall("[a-z0-9]+", text.lower())))


def needed(size: int, threshold: float) -> int:
    return max(1, math.ceil(threshold * size - 1e-9))


def span(text: str) -> int:
    """The most lines of a block for a statement."""
    return -(-len(text) // WRAP) + 1


def _words(batches: Iterator[pa.RecordBatch], vocabulary: list[str], least: int) -> Iterator[pa.RecordBatch]:
    """The documents with at least `least` distinct words of the vocabulary: the places of these words in it, and their lines."""
    hashes = np.array([hash_word(w) for w in vocabulary], dtype=np.uint64)
    order = np.argsort(hashes)
    hashes = hashes[order]

    def found(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows, places and line breaks before them, of the words in the vocabulary."""
        starts, ends, rows = word_spans(data, offsets, ASCII_WORD)
        h = word_hashes(data, starts, ends)
        k = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
        hit = hashes[k] == h
        breaks = np.concatenate([[0], np.cumsum(data == 10)])
        return rows[hit], order[k[hit]], breaks[starts[hit]] - breaks[offsets[rows[hit]]]

    for batch in batches:
        for a, b, data, offsets in each_part(lowered(batch.column("text"))):
            if b - a > 1 or len(data) <= PIECE:
                rows, words, lines = found(data, offsets)
            else:
                parts, before = [], 0
                for x, y in pieces(data, word=ASCII_WORD):
                    _, w, n = found(data[x:y], np.array([0, y - x]))
                    parts.append((w, n + before))
                    before += int((data[x:y] == 10).sum())
                words, lines = (np.concatenate(x) for x in zip(*parts))
                rows = np.zeros(len(words), dtype=np.int64)
            distinct = np.bincount(np.unique(rows * len(vocabulary) + words) // len(vocabulary), minlength=b - a)
            keep = distinct >= least
            some, cuts = keep[rows], np.flatnonzero(keep)
            at = np.searchsorted(rows[some], cuts[1:])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(a, b - a).take(pa.array(cuts)), *[rows_of(np.split(x[some], at) if len(cuts) else [], pa.int32()) for x in (words, lines + 1)]], names=["doc_id", "words", "lines"]
            )


def blocks(words: np.ndarray, lines: np.ndarray, template: np.ndarray, need: int, most: int) -> Iterator[tuple[int, int, int]]:
    """First and last line and overlap of every block with `need` of the template's words and none such inside; words come in order of lines."""
    mine = np.isin(words, template)
    words, lines = words[mine].tolist(), lines[mine].tolist()
    held: dict[int, int] = {}
    right, n = 0, len(words)
    left = 0
    while left < n:
        while right < n and len(held) < need:
            line = lines[right]
            while right < n and lines[right] == line:
                held[words[right]] = held.get(words[right], 0) + 1
                right += 1
        if len(held) < need:
            return
        first, last, overlap = lines[left], lines[right - 1], len(held)
        while left < n and lines[left] == first:
            held[words[left]] -= 1
            if not held[words[left]]:
                del held[words[left]]
            left += 1
        if len(held) < need and last - first < most:
            yield first, last, overlap


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, first_line, last_line, license, overlap, containment) of every block and template that meet the threshold."""
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType.simpleString()
    sets = {k: words_of(v) for k, v in templates.items() if words_of(v)}
    out = f"doc_id {kind}, first_line int, last_line int, license string, overlap int, containment double"
    if not sets:
        return spark.createDataFrame([], out)
    need = {k: needed(len(w), threshold) for k, w in sets.items()}
    least, vocabulary = min(need.values()), sorted(set().union(*sets.values()))
    rows = pick(docs, doc_id="doc_id", text="text").mapInArrow(lean(lambda it: _words(it, vocabulary, least)), f"doc_id {kind}, words array<int>, lines array<int>")
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "license-words")

    counts = {r.word: r.n for r in rows.select(F.explode(F.array_distinct("words")).alias("word")).groupBy("word").agg(F.count("*").alias("n")).collect()}  # a row for each word of the templates
    rank = {w: i for i, (_, w) in enumerate(sorted((counts.get(i, 0), i) for i in range(len(vocabulary))))}
    order = F.array(*[F.lit(rank[i]) for i in range(len(vocabulary))])
    ranked = rows.select("row", F.array_sort(F.transform(F.array_distinct("words"), lambda w: F.element_at(order, w + 1))).alias("b"))
    prefixed = ranked.select("*", F.posexplode(F.slice("b", 1, F.size("b") - least + 1)).alias("i", "token"))
    place = {w: i for i, w in enumerate(vocabulary)}
    table = []
    for name, words in sets.items():
        t, c = sorted(rank[place[w]] for w in words), need[name]
        table += [(name, t, c, j, t[j]) for j in range(len(t) - c + 1)]
    possible = (
        prefixed.join(F.broadcast(spark.createDataFrame(table, "license string, t array<int>, c int, j int, token int")), "token")
        .where("size(b) >= c and i <= size(b) - c and 1 + least(size(b) - i - 1, size(t) - j - 1) >= c")
        .where("i = 0 or j = 0 or size(array_intersect(slice(b, 1, i), slice(t, 1, j))) = 0")  # only the first shared word counts
        .where("size(array_intersect(b, t)) >= c")
    )
    pairs = written(possible.select("row", "license"), "license-pairs")
    index = {k: np.array([place[w] for w in words]) for k, words in sets.items()}

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, found = [], []
            for i, name in enumerate(batch.column("license").to_pylist()):
                words, lines = (batch.column(c)[i].values.to_numpy() for c in ("words", "lines"))
                for first, last, overlap in blocks(words, lines, index[name], need[name], span(templates[name])):
                    at.append(i)
                    found.append((first, last, name, overlap, overlap / len(index[name])))
            if at:
                kinds = (pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.float64())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(at)), *[pa.array(c, k) for c, k in zip(zip(*found), kinds)]], names=["doc_id", "first_line", "last_line", "license", "overlap", "containment"])

    return rows.join(narrow(pairs), "row").select("doc_id", "words", "lines", "license").mapInArrow(lean(search), out)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _oracle() -> str:
    rows = ", ".join("('{}', [{}], {}, {})".format(k, ", ".join(f"'{w}'" for w in words_of(v)), needed(len(words_of(v)), THRESHOLD), span(v)) for k, v in TEMPLATES.items())
    return f"""
WITH templates(license, t, c, span) AS (VALUES {rows}),
texts AS (SELECT row_number() OVER () AS r, doc_id, string_split(text, chr(10)) AS ls FROM documents),
lines AS (SELECT r, unnest(range(1, len(ls) + 1)) AS line, unnest(ls) AS l FROM texts),
words AS (SELECT r, line, unnest(list_distinct(regexp_extract_all(lower(l), '[a-z0-9]+'))) AS w FROM lines),
known AS (SELECT license, unnest(t) AS w FROM templates),
hits AS MATERIALIZED (SELECT r, license, line, w FROM words JOIN known USING (w)),
pairs AS (SELECT r, license FROM hits GROUP BY r, license HAVING count(DISTINCT w) >= (SELECT any_value(c) FROM templates p WHERE p.license = hits.license)),
kept AS MATERIALIZED (SELECT * FROM hits SEMI JOIN pairs USING (r, license)),
ends AS (SELECT DISTINCT r, license, line FROM kept),
runs AS (SELECT a.r, a.license, a.line AS i, b.line AS j FROM ends a JOIN ends b ON a.r = b.r AND a.license = b.license AND b.line >= a.line JOIN templates p ON p.license = a.license AND b.line - a.line < p.span),
held AS (SELECT x.r, x.license, i, j, count(DISTINCT w) AS overlap FROM runs x JOIN kept k ON k.r = x.r AND k.license = x.license AND k.line BETWEEN i AND j GROUP BY x.r, x.license, i, j),
good AS MATERIALIZED (SELECT held.*, len(t) AS size FROM held JOIN templates p ON p.license = held.license WHERE overlap >= c)
SELECT doc_id, i::INTEGER AS first_line, j::INTEGER AS last_line, license, overlap::INTEGER AS overlap, overlap::DOUBLE / size AS containment FROM good JOIN texts USING (r)
WHERE NOT EXISTS (SELECT 1 FROM good o WHERE o.r = good.r AND o.license = good.license AND o.i >= good.i AND o.j <= good.j AND (o.i > good.i OR o.j < good.j))"""


ORACLE_SQL = _oracle()
