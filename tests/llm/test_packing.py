"""Packing: exact pieces, valid places, few sequences; the rule against its plain form."""

import random

import numpy as np
import pytest
from test_pipeline import check_packing

from skyledger.llm import packing as K
from skyledger.llm.queries import QUERIES, vocabulary

PATH = vocabulary("word_bpe_49k.json")


def plain_rule(lengths, capacity):
    """Try every open gap and a new sequence, summing the squares each time."""
    gaps, out = [], []

    def squares(g):
        count = {}
        for x in g:
            if 0 < x < capacity:
                count[x] = count.get(x, 0) + 1
        return sum(c * c for c in count.values())

    for size in lengths:
        tries = [(squares([h - size if k == i else h for k, h in enumerate(gaps)]), 0, g, i)
                 for i, g in enumerate(gaps) if g >= size]
        tries.append((squares([*gaps, capacity - size]), 1, capacity, len(gaps)))
        best = min(tries, key=lambda t: t[:3])
        if best[1]:
            gaps.append(capacity)
        gaps[best[3]] -= size
        out.append(best[2] - size)
    return out, sorted(gaps)


@pytest.mark.parametrize("seed", range(5))
def test_the_rule(seed):
    rng = random.Random(seed)
    lengths = [rng.randint(1, 20) for _ in range(60)]
    sequence, offset, gaps = K.sum_of_squares(np.array(lengths), 20)
    left, want = plain_rule(lengths, 20)
    assert (20 - offset - np.array(lengths)).tolist() == left
    assert sorted(gaps.tolist()) == want


def test_query_is_exact_and_tight(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    n, total = check_packing(docs, QUERIES["op9_best_fit_packing"](spark, sf).collect(), PATH)
    assert n <= -(-total // 4096) * 1.02 + 1


def test_groups_and_rounds(spark):
    rng = random.Random(1)
    rows = [(i % 300, 0, rng.choice([rng.randint(1, 400), rng.randint(1, 4096), 4096])) for i in range(900)]
    rows += [(7, 0, 1500)] * 450  # a third of all rows are equal
    df = spark.createDataFrame(rows, "doc_id long, piece int, length long")
    out = K.pack(df, group_rows=100).collect()
    assert sorted((r["doc_id"], r["piece"], r["length"]) for r in out) == sorted(rows)
    bins = {}
    for r in out:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 4096
    assert K.pack(df.limit(0)).collect() == []


def test_edges_of_the_table(spark):
    rows = [(1, None, 5), (2, "", 6), (3, "a B", 7), (3, "a B", 7), (None, "A b", 8), (4, "x' ² É é" * 9000, 9), (5, "<|endoftext|> <|ENDOFTEXT|>", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, length int")
    pieces = K.token_pieces(df, PATH)
    from pyspark.sql import functions as F
    out = K.pack(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))).collect()
    check_packing([(i, t) for i, t, _ in rows], out, PATH)
    assert K.token_pieces(df.limit(0), PATH).collect() == []


def test_rare_words_are_encoded_once():
    parts, encoded = K._parts.__wrapped__(PATH), []
    parts.encode = lambda part: encoded.append(part) or b""
    words = [f"w{i}" for i in range(500_000)]
    for _ in range(2):
        parts.join(words)
    assert len(encoded) == len(words)
