"""Toxicity: held-out accuracy, misspellings, bounded sample, odd rows."""

import random
import zlib

import pytest

from skyledger.llm import toxicity as X
from skyledger.llm.queries import QUERIES


def invented(rng, toxic):
    words = ["".join(rng.choices(["er", "th", "on", "ea", "in", "or", "st", "nd"], k=rng.randint(1, 4))) for _ in range(rng.randint(20, 120))]
    if toxic:
        for _ in range(rng.randint(1, 4)):
            words[rng.randrange(len(words))] = rng.choice(["blockhead", "vermin", "grobian" + rng.choice(["s", "ig", "en", ""])])
    return " ".join(words)


@pytest.fixture(scope="module")
def trained():
    rng = random.Random(3)
    return X.train([(invented(rng, k % 3 == 0), int(k % 3 == 0)) for k in range(600)])


def test_held_out_accuracy(trained):
    rng = random.Random(9)
    toxic = [trained.score(invented(rng, True)) >= X.PREDICT_AT for _ in range(200)]
    clean = [trained.score(invented(rng, False)) >= X.PREDICT_AT for _ in range(400)]
    assert sum(toxic) >= 190 and sum(clean) <= 8


def test_unseen_misspellings_and_long_texts(trained):
    filler = "eron theast ndor instth onea " * 3
    clean = trained.score(filler)
    for word in ("blockheads", "blokhead", "grobianisch", "verminn"):
        assert trained.worst(filler + word + " " + filler) > trained.worst(filler) + 1, word
    assert trained.score(filler * 400 + "blockhead " + filler * 400) >= X.PREDICT_AT > clean


def test_query_on_its_table(spark, sf):
    docs = [r["doc_id"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {r["doc_id"]: r for r in QUERIES["op8_toxicity"](spark, sf).collect()}
    assert set(got) == set(docs)
    for i, r in got.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)


def test_sample_is_bounded_and_leaves_held_out_rows_alone(spark):
    docs = spark.createDataFrame([(i, f"text {i}" if i % 5 else None, i) for i in range(400)] + [(None, "x", 0)], "doc_id long, text string, toxic int")
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(400)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    rows = [(r["text"], r["toxic"]) for r in X.sample_rows(docs, labels, per_class=30, max_chars=7).collect()]
    assert len(rows) <= 60 and {y for _, y in rows} == {0, 1} and all(len(t) <= 7 for t, _ in rows)
    used = {int(t.split()[1]) for t, _ in rows if t}
    assert all(zlib.crc32(str(i).encode()) % 3 != 1 for i in used)


def test_edges(spark, trained):
    rows = [(1, None, 1.0), (2, "", 2.0), (3, "a", 3.0), (3, "a", 3.0), (None, "blockhead", 0.0), (4, "é漢 " * 40_000, 1.0), (5, " \t\n", 0.5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score double")
    got = X.scores(df, trained).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    assert X.scores(df.limit(0), trained).collect() == []
    kept = X.drop_toxic(df, trained)
    assert kept.schema == df.schema and all(r["text"] != "blockhead" for r in kept.collect())
    assert X.fit(df.limit(0), df.selectExpr("doc_id", "1 AS toxic")).score("") == 0.5
    only = X.train([("a b", 0)] * 5)
    assert only.score("anything") < 0.5 and X.train([]).score("") == 0.5


def long_text(rng, toxic):
    words = " ".join(invented(rng, False) for _ in range(rng.randint(12, 30))).split()
    if toxic:
        words[rng.randrange(len(words))] = rng.choice(["blockhead", "vermin", "grobians"])
    return " ".join(words)


@pytest.mark.parametrize("short", [0, 300])
def test_long_texts_are_learnt_from_and_calibrated_on(spark, short):
    rng = random.Random(17)
    rows = [(k, invented(rng, k % 2 == 0) if k < short else long_text(rng, k % 2 == 0), int(k % 2 == 0)) for k in range(600)]
    assert all(len(t) > 3000 for _, t, _ in rows[short:])
    table = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    model = X.fit(table, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))
    for low, high in ((0, 3001), (3001, 10 ** 9)):
        held = [(model.score(t) >= X.PREDICT_AT, y) for i, t, y in rows if zlib.crc32(str(i).encode()) % 3 == 1 and low <= len(t) < high]
        if held:
            hit = sum(p and y for p, y in held)
            assert hit >= 0.9 * sum(y for _, y in held) and hit >= 0.9 * sum(p for p, _ in held)


def test_passages_come_from_all_over_a_text():
    text = " ".join(f"word{k}" for k in range(5000))
    got = X.some_passages(text, None, 3000)
    assert 2500 < len(got) <= 3000 and int(got.split()[-1][4:]) > 4000 and int(got.split()[0][4:]) < 1000
    marks = X.gram_counts([("word4321", 1)])[1] > 0
    marks &= X.gram_counts([("word432 word321 word4320 word4322", 0)])[0] == 0
    assert "word4321" in X.some_passages(text, marks, 3000).split()
    assert X.some_passages("a b c", None) == "a b c" and 2000 < len(X.some_passages("漢" * 50_000, None, 3000)) <= 3000
