"""Encoding by tree concatenation against the tokenizer on whole texts, and exact round trips."""

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from skyledger.llm import bpe as B
from skyledger.llm.queries import QUERIES, vocabulary

PATH = vocabulary("byte_bpe_50k.json")
PIECES = ["the of and ", " '’sldtre", "   \n\t ab", "éàü漢字😀 x", "0123456789 ", "<|endoftext|>", "aaaa", "!?.,;:--=", "　\x1c\x85", "'s'll've"]


def plain(text):
    return B.load(PATH).tokenizer.encode(text, add_special_tokens=False).ids


def joined(text, size):
    t = B.load(PATH)
    leaves = t.leaves(text, size)
    assert "".join(leaves) == text
    return t.tree([(x.encode(), np.frombuffer(t.encode(x), "<u4")) for x in leaves]).tolist()


def random_text(rng):
    return "".join(rng.choice(PIECES) if rng.random() < 0.3 else "".join(rng.choices(rng.choice(PIECES), k=rng.randint(1, 60)))
                   for _ in range(rng.randint(1, 12)))


def test_leaves_join_exactly(monkeypatch):
    rng = random.Random(5)
    for _ in range(600):
        monkeypatch.setattr(B, "FIRST_WINDOW", rng.choice([16, 24, 64]))
        text = random_text(rng)
        assert joined(text, rng.choice([5, 17, 40, 100])) == plain(text)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=200), st.integers(3, 60))
def test_any_text_joins_exactly(text, size):
    text = text.encode("utf-8", "ignore").decode()
    assert joined(text, size) == plain(text)
    ids = np.array(plain(text), "<u4").tobytes()
    assert B.load(PATH).decode(ids) == B.load(PATH).tokenizer.decode(plain(text), skip_special_tokens=False)


def test_long_runs_without_a_space():
    for text in ("a" * 5000, "ab" * 3000, "é" * 2000, " " * 3000 + "x", "'" * 500, "'s" * 700, "thequickbrown" * 400):
        assert joined(text, 300) == plain(text)


def test_query_matches_the_tokenizer(spark, sf):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = QUERIES["op3_bpe"](spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = plain(docs[r["doc_id"]] or "")
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256((docs[r["doc_id"]] or "").encode()).hexdigest()


def test_edges_of_the_table(spark):
    rows = [(1, None, "a"), (2, "", "b"), (3, "x y", "c"), (3, "x y", "c"), (None, "z", "d"), (4, "word's end " * 3000, "e"),
            (5, "q" * 40_000, "f")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    encoded = B.encode(df, PATH, leaf_chars=1000)
    got = sorted((str(r["doc_id"]), bytes(r["ids"])) for r in encoded.collect())
    assert got == sorted((str(i), np.array(plain(t or ""), "<u4").tobytes()) for i, t, _ in rows)
    assert {r["text"] for r in B.decode(encoded, PATH).collect()} == {t or "" for _, t, _ in rows}
    assert B.encode(df.limit(0), PATH).collect() == []
    first = encoded.where("doc_id = 3").select(B.unpack().alias("i")).first()["i"]
    assert first == plain("x y")
