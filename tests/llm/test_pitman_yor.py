"""The language model: exact base figures, probabilities that add up, better than the base on held-out text."""

import math
import zlib

import numpy as np
import pytest

from skyledger.llm import pitman_yor as P
from skyledger.llm.queries import QUERIES


def plain_base(docs):
    """{(doc_id, text): (held_out, n_tokens, n_known, train_tokens, base_score)} by counting everything."""
    def toks(t):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        for c in "\t\n\x0b\x0c\r":
            low = low.replace(c, " ")
        return [w for w in low.split(" ") if w] + ["<end>"]

    held = {i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in docs}
    count = {}
    for i, t in docs:
        if not held[i]:
            for w in toks(t):
                count[w] = count.get(w, 0) + 1
    n, v = sum(count.values()), len(count)
    return {(i, t): (held[i], len(toks(t)), sum(w in count for w in toks(t)), n,
                     sum(math.log10((count.get(w, 0) + 0.1) / (n + 0.1 * (v + 1))) for w in toks(t))) for i, t in docs}


@pytest.fixture(scope="module")
def scored(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    return docs, QUERIES["op4_pitman_yor"](spark, sf).collect()


def test_base_figures_are_exact(scored):
    docs, got = scored
    want = {i: v for (i, _), v in plain_base(docs).items()}
    assert len(got) == len(docs)
    for r in got:
        w = want[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == w[:4]
        assert r["base_score"] == pytest.approx(w[4], rel=1e-9)


def test_better_than_the_base_on_held_out_text(scored):
    _, got = scored
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_probabilities_add_up(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("text").limit(40)
    model = P.fit(docs, contexts=8)
    unseen, unknown = model.unseen_in(), model.unknown_roots()
    total = (unknown @ unseen) / len(unseen)
    for r in model.words.collect():
        p = np.frombuffer(r["roots"], "<f8") @ unseen / len(unseen)
        own = np.frombuffer(r["priors"], dtype=P.PRIOR)
        p[own["u"]] = own["p"]
        assert (p > 0).all()
        total += p
    assert total == pytest.approx(np.ones(8), abs=1e-9)


def test_frequent_words_and_others_score_alike(spark):
    docs = [(i, " ".join(f"w{(i * k) % 23}" for k in range(1, 30 + i % 7))) for i in range(120)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    model = P.fit(df.where(~P.held_out()), contexts=4)
    few, many = ({r["doc_id"]: r["score"] for r in P.score(df, model, head=h).collect()} for h in (1, 10_000))
    assert few == pytest.approx(many, rel=1e-5)


def test_seating_bounds():
    rng = np.random.default_rng(0)
    count = np.array([1, 2, 5, 40, 1000, 200_000, 0])
    for pull in (1e-9, 1.0, 1e6):
        t = P.seat(count, np.full(7, pull), 0.5, rng)
        assert ((t >= np.minimum(count, 1)) & (t <= count)).all()


def test_edges_of_the_table(spark):
    rows = [(1, None, 1.0), (2, "", 2.0), (3, "a b A", 3.0), (3, "a b A", 3.0), (None, "zz", 0.0), (4, "word " * 50_000, 1.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score double")
    model = P.fit(P.texts(df).where(~P.held_out()))
    got = P.score(df, model).collect()
    want = plain_base([(i, t) for i, t, _ in rows])
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in got) == sorted(
        (str(i), want[i, t][1], want[i, t][2], round(want[i, t][4], 6)) for i, t, _ in rows)
    assert all(math.isfinite(r["score"]) for r in got)
    nothing = P.fit(P.texts(df).limit(0))
    assert P.score(df.limit(0), nothing).collect() == []
    assert all(math.isfinite(r["score"]) and r["n_known"] == 0 for r in P.score(df, nothing).collect())
