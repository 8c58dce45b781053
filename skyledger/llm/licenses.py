"""License notices in whole texts: phrases, and an exact set-similarity join with templates.

Texts are cut into blocks of words that overlap by half, templates into sets of
words. A block matches a template if it holds at least the threshold's share of
the template's words. The join is exact: words are ordered by the number of
documents that hold them, rarest first; a block that matches must share a word
of the template's prefix (its first size - least + 1 words, least being the words
needed), must hold enough template words at all (length), and from the place of
the first shared word on both sides must have enough words left (position).
What passes is verified word by word.

Null texts count as empty. Repeated rows are rows of their own, whatever their
id; extra columns are left behind; an empty table gives no rows. A notice of at
most half a block of words always lies in one block as a whole.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from skyledger.llm.common import map_texts, slices, texts
from skyledger.session import stage

# Fixed values of the contract: phrases and their labels.
PHRASES = [
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
]
# Sentences of well-known license notices and what they say.
TEMPLATES = [
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
            "License as published by the Free Software Foundation, either version 3 of the License, or any later version"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance "
               "with the License"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files, to deal in the Software without restriction"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
            "following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
            "granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
            "distributed with this file, You can obtain one"),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, "
                  "publish, use, compile, sell, or distribute this software"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
]
THRESHOLD = 0.85
BLOCK = 64

# Bytes of words: ASCII letters, made small, digits, and every byte of other characters.
_WORDS = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256)).lower()


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORDS).split()


def template_words(templates: Sequence[tuple[str, str]]) -> list[list[bytes]]:
    return [sorted(set(words_of(text.encode()))) for _, text in templates]


def needed(size: int, threshold: float) -> int:
    """Words of a template of ``size`` that make up the threshold's share."""
    return max(1, math.ceil(threshold * size - 1e-9))


def word_frequencies(docs: DataFrame, words: Sequence[bytes]) -> dict[bytes, int]:
    """The number of documents that hold each word, over all documents."""
    wanted = frozenset(words)

    def run(batches):
        import pyarrow as pa

        total: dict[bytes, int] = {}
        for part in slices(batches):
            for text in part.column("text").to_pylist():
                for word in wanted.intersection(words_of(text)):
                    total[word] = total.get(word, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64())],
                                         names=["word", "n"])

    counts = _bytes(docs).select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return dict.fromkeys(words, 0) | {bytes(r["word"]): r["n"] for r in counts.collect()}


def scan(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD,
         block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Each document's phrases, and every block that matches a template.

    The first table has a ``row`` for each document row: ``doc_id, n_words, labels``
    of the phrases and the word ``places`` where they start. The second has ``row,
    doc_id, start`` (first word of the block)``, label, template`` (its number) and
    ``containment``, the share of the template's words in the block.
    """
    sets = template_words(templates)
    held = word_frequencies(docs, sorted({w for words in sets for w in words}))
    rank = {w: i for i, w in enumerate(sorted(held, key=lambda w: (held[w], w)))}
    ranked = [sorted(rank[w] for w in words) for words in sets]
    index = [(t, label, i, r, ranks, needed(len(ranks), threshold))
             for t, ((label, _), ranks) in enumerate(zip(templates, ranked))
             for i, r in enumerate(ranks[:len(ranks) - needed(len(ranks), threshold) + 1])]
    prefix = frozenset(w for w in rank if rank[w] in {entry[3] for entry in index})
    least = min((entry[5] for entry in index), default=0)

    def make():
        step = block // 2
        phrases = [(b" " + p.encode() + b" ", label) for p, label in PHRASES]

        def look(text):
            words = words_of(text)
            line = b" ".join([b"", *words, b""])
            places, labels = [], []
            for phrase, label in phrases:
                at = line.find(phrase)
                if at >= 0:
                    labels.append(label)
                while at >= 0:
                    places.append(line.count(b" ", 0, at))
                    at = line.find(phrase, at + 1)
            blocks = []
            if not prefix.isdisjoint(words):
                starts = {k * step for i, w in enumerate(words) if w in prefix for k in (i // step - 1, i // step) if k >= 0}
                for start in sorted(starts):
                    ranks = sorted({rank[w] for w in words[start:start + block] if w in rank})
                    if len(ranks) >= least:
                        blocks.append({"start": start, "ranks": ranks})
            return len(words), labels, sorted(places), blocks

        return lambda ids, bodies: list(zip(*map(look, bodies))) or [[]] * 4

    schema = ("doc_id long, n_words long, labels array<string>, places array<long>, "
              "blocks array<struct<start: long, ranks: array<int>>>")
    # The row numbers are written with the rows, so every later pass sees the same ones.
    rows = stage(map_texts(_bytes(docs), schema, make).select(F.monotonically_increasing_id().alias("row"), "*"))

    blocks = rows.where(F.size("blocks") > 0).select("row", "doc_id", F.explode("blocks").alias("b")).select(
        "row", "doc_id", "b.start", "b.ranks", F.size("b.ranks").alias("held"))
    # A word beyond a block's own prefix cannot be the first that a matching template shares.
    firsts = F.slice("ranks", F.lit(1), F.greatest(F.col("held") - least + 1, F.lit(0)))
    words = blocks.select("*", F.posexplode(firsts).alias("at", "word"))
    table = rows.sparkSession.createDataFrame(
        index, "template int, label string, place int, word int, words array<int>, least int")
    size = F.size("words")
    left = 1 + F.least(size - F.col("place") - 1, F.col("held") - F.col("at") - 1)
    candidates = words.join(table, "word").where((F.col("held") >= F.col("least")) & (left >= F.col("least")))
    once = candidates.groupBy("row", "start", "template").agg(*[
        F.first(c).alias(c) for c in ("doc_id", "ranks", "label", "words", "least")])
    shared = F.size(F.array_intersect("ranks", "words"))
    matches = once.where(shared >= F.col("least")).select(
        "row", "doc_id", "start", "label", "template", (shared / size).alias("containment"))
    return rows.drop("blocks"), matches


def detect(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD,
           block: int = BLOCK) -> DataFrame:
    """Per document row its phrases' ``labels`` and ``places``, all labels, and a score.

    ``all_labels`` adds the matched templates' labels, sorted. ``score`` is 1 with a
    phrase, else the best containment of a match, else 0.
    """
    rows, matches = scan(docs, templates, threshold, block)
    found = matches.groupBy("row").agg(F.collect_set("label").alias("__found"), F.max("containment").alias("__best"))
    both = F.array_sort(F.array_union("labels", F.coalesce("__found", F.array().cast("array<string>"))))
    score = F.when(F.size("labels") > 0, 1.0).otherwise(F.coalesce("__best", F.lit(0.0)))
    return rows.join(found, "row", "left").select(
        "doc_id", "n_words", F.array_sort("labels").alias("labels"), "places", both.alias("all_labels"), score.alias("score"))


def _bytes(docs: DataFrame) -> DataFrame:
    return texts(docs).select("doc_id", F.col("text").cast("binary").alias("text"))


def oracle(templates: Sequence[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD, block: int = BLOCK) -> str:
    """The query in SQL: every block against every template."""
    def literal(words):
        return "[" + ", ".join(f"'{w}'" for w in words) + "]"

    capitals = "".join(map(chr, range(65, 91)))
    places = " UNION ALL ".join(
        f"SELECT row, '{label}' AS label, unnest([i FOR i IN range(len(w)) IF "
        + " AND ".join(f"w[i + {k + 1}] = '{word}'" for k, word in enumerate(phrase.split())) + "]) AS place FROM d"
        for phrase, label in PHRASES)
    values = ", ".join(f"('{label}', {literal(w.decode() for w in words)}, {needed(len(words), threshold)})"
                       for (label, _), words in zip(templates, template_words(templates)))
    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(
        translate(coalesce(text, ''), '{capitals}', '{capitals.lower()}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
places AS ({places}),
base AS (SELECT row, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word,
         string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM places GROUP BY row),
blocks AS (SELECT row, list_distinct(w[s + 1:s + {block}]) AS b FROM (SELECT row, w, unnest(range(0, len(w), {block // 2})) AS s FROM d)),
templates(label, words, least) AS (VALUES {values}),
matches AS (SELECT row, label, len(list_intersect(b, words)) AS shared, len(words) AS size, least FROM blocks, templates),
found AS (SELECT row, label, shared / size AS containment FROM matches WHERE shared >= least),
labels AS (SELECT row, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
           FROM (SELECT row, label FROM places UNION ALL SELECT row, label FROM found) GROUP BY row),
best AS (SELECT row, max(containment) AS best FROM found GROUP BY row)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word,
       last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(best, 0.0) END::DOUBLE AS score
FROM d LEFT JOIN base USING (row) LEFT JOIN labels USING (row) LEFT JOIN best USING (row)"""
