"""Quality: figures against plain counting, EM on known patterns, agreement with the labels."""

import re

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from skyledger.llm import quality as Q
from skyledger.llm.queries import QUERIES


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    where = {}
    for i in range(len(words) - 2):
        where.setdefault(tuple(words[i:i + 3]), []).append(i)
    repeated = {k for at in where.values() if len(at) > 1 for i in at for k in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen, dup = set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    n = len(words)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(repeated),
            n < 50 or 100 * len(repeated) > 50 * n)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab \n\t\r\x0b\x0c#|é \x1c\x85", max_size=120))
def test_figures(text):
    assert Q.measures(text)[:6] == plain(text)


def test_query_on_its_table(spark, sf):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = {r["doc_id"]: r for r in QUERIES["op5_quality_votes"](spark, sf).collect()}
    assert set(got) == set(docs)
    for i, r in got.items():
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == plain(docs[i])
        assert not (r["base_failed"] and r["kept"])
    clean = [got[i]["kept"] for i, q in labels.items() if q == 1 and not got[i]["base_failed"]]
    junk = [got[i]["kept"] for i, q in labels.items() if q == 0]
    assert np.mean(clean) >= 0.95 and np.mean(junk) <= 0.1


def test_em_finds_the_two_kinds():
    rng = np.random.default_rng(1)
    truth = rng.random(20_000) < 0.8
    right = np.linspace(0.75, 0.95, len(Q.RULES))
    vote = np.where(rng.random((20_000, len(Q.RULES))) < right, truth[:, None], ~truth[:, None])
    cast = np.where(rng.random(vote.shape) < 0.3, 0, np.where(vote, 1, 2))
    pattern = (cast * 3 ** np.arange(len(Q.RULES))[::-1]).sum(axis=1)
    known, back, count = np.unique(pattern, return_inverse=True, return_counts=True)
    posterior, accuracy = Q.expectation_maximisation(known, count.astype(float))
    assert ((posterior[back] >= 0.5) == truth).mean() > 0.97
    np.testing.assert_allclose(accuracy, right, atol=0.03)


def fitted(vote):
    pattern = (vote * 3 ** np.arange(len(Q.RULES))[::-1]).sum(axis=1)
    known, back, count = np.unique(pattern, return_inverse=True, return_counts=True)
    posterior, accuracy = Q.expectation_maximisation(known, count.astype(float))
    return posterior[back], accuracy


def test_a_corpus_without_a_bad_vote_loses_nothing():
    vote = np.ones((20_000, len(Q.RULES)), int)
    vote[:8000, [2, 5]] = 0
    posterior, accuracy = fitted(vote)
    assert (posterior >= Q.KEEP_AT).all() and (accuracy > 0.9).all()


def test_one_style_of_writing_is_no_class_of_bad_documents():
    vote = np.ones((20_000, len(Q.RULES)), int)
    names = [r[0] for r in Q.RULES]
    vote[:8000, names.index("capitals")] = 2
    vote[:8000, names.index("marks")] = 0
    assert (fitted(vote)[0] >= Q.KEEP_AT).all()


def test_mostly_bad_corpora_do_not_change_the_classes_over():
    rng = np.random.default_rng(2)
    truth = rng.random(20_000) < 0.25
    vote = np.where(rng.random((20_000, len(Q.RULES))) < 0.85, truth[:, None], ~truth[:, None])
    posterior, _ = fitted(np.where(vote, 1, 2))
    assert ((posterior >= 0.5) == truth).mean() > 0.95


def test_edges_of_the_table(spark):
    good = " ".join(f"some{k} words here" for k in range(60))
    rows = [(1, None, "a"), (2, "", "b"), (3, good, "c"), (3, good, "c"), (None, good, "d"), (4, "same word " * 40_000, "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality string")
    got = Q.judge(df).collect()
    assert sorted((str(r["doc_id"]), r["base_failed"]) for r in got) == sorted(
        (str(i), t is None or t == "" or i == 4) for i, t, _ in rows)
    assert Q.judge(df.limit(0)).collect() == [] and Q.keep_good(df.limit(0)).collect() == []
    kept = Q.keep_good(df)
    assert kept.schema == df.schema and {r["quality"] for r in kept.collect()} <= {"c", "d"}
