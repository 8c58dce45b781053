"""Personal data: base spans against the plain patterns, boosted additions on planted text, odd rows."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyledger.llm import pii as D
from skyledger.llm.queries import QUERIES

PATTERNS = [re.compile(p) for p in (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")]


def plain(text):
    def good(kind, found):
        digits = [int(c) for c in found if c in "0123456789"]
        if kind == 1:
            return all(int(x) <= 255 for x in found.split("."))
        if kind == 2:
            total = sum(sum(divmod(2 * d, 10)) if k % 2 else d for k, d in enumerate(digits[::-1]))
            return 12 <= len(digits) <= 19 and total % 10 == 0
        return kind == 0 or 9 <= len(digits) <= 15

    return sorted((m.start(), k, m.end()) for k, p in enumerate(PATTERNS) for m in p.finditer(text) if good(k, m.group()))


def test_base_spans_on_random_text():
    rng = random.Random(1)
    parts = ["0123456789", "0123456789 .-", "+1 (203) ", "a@b.c@", "@.-a_%+", "1.2.3.4.5.6", "éxyz ٣"]
    for _ in range(6000):
        text = "".join("".join(rng.choices(rng.choice(parts), k=rng.randint(1, 8))) for _ in range(rng.randint(1, 14)))
        assert D.base_spans(text) == plain(text), text


@pytest.mark.parametrize("text", ["9" * 60_000, "a" * 60_000 + "@", "1." * 30_000, "+" * 30_000, "+1" + " " * 60_000, "a@" * 30_000])
def test_long_odd_texts_take_no_time(text):
    D.base_spans(text), D.candidates(text), D.examples(text)


def test_query_matches_the_plain_base(spark, sf):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = QUERIES["op2_pii"](spark, sf).collect()
    assert {r["doc_id"] for r in got} == set(docs)
    for r in got:
        base = plain(docs[r["doc_id"]])
        line = ",".join(f"{D.KINDS[k]}:{s}:{e}" for s, k, e in base)
        assert [r[f"n_{k}"] for k in D.KINDS] == [sum(x[1] == i for x in base) for i in range(4)]
        assert r["base_sha256"] == hashlib.sha256(line.encode()).hexdigest()
        assert set(line.split(",")) <= set(r["spans"].split(","))
        if not r["n_added"]:
            assert r["spans"] == line


def test_boosted_trees_learn_a_rule():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(800, 5))
    y = ((x[:, 1] > 0.3) ^ (x[:, 3] > 0)).astype(float)
    model = D.boost(x[:600], y[:600])
    assert ((model.raw(x[600:]) > 0) == y[600:]).mean() > 0.9


def test_wide_phone_numbers_are_added_and_clean_numbers_are_not():
    rng = random.Random(7)
    rows = []
    for k in range(600):
        a, b, c = rng.randint(200, 999), rng.randint(200, 999), rng.randint(1000, 9999)
        text = f"please call +1 ({a}) {b}-{c} today" if k % 2 else f"part {a}-{b}-{c} of order {rng.randint(10 ** 15, 10 ** 16)}"
        rows += [(kind, label, f, rng.randrange(1000)) for kind, label, f, _ in D.examples(text)]
    model = D.fit(rows)
    assert 3 in model.threshold
    assert model.added("part 555-123-4567 of order 12", []) == []
    text = "please call +1 (555) 123-4567 today"
    assert D.base_spans(text) and model.added(text, D.base_spans(text)) == []
    assert [k for _, k, _ in model.added("please call 001 (555) 123-4567 today", [])] in ([3], [])


def test_redaction():
    text = "mail a.b@c.de or +1 (203) 555-1234, 10.0.0.1"
    assert D.redact(text, D.base_spans(text)) == "mail [email] or [phone], [ip]"
    assert D.redact("abc", []) == "abc" and D.redact("abcdef", [(0, 0, 3), (2, 1, 5)]) == "[email]f"


def test_edges_of_the_table(spark):
    rows = [(1, None, 0), (2, "", 0), (3, "a@b.cd", 6), (3, "a@b.cd", 6), (None, "1.2.3.4", 7), (4, "x 1.2.3.4 " * 9000, 90_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    model = D.train(df)
    got = D.detect(df, model).collect()
    assert sorted((str(r["doc_id"]), len(r["base"])) for r in got) == sorted((str(i), len(D.base_spans(t or ""))) for i, t, _ in rows)
    assert D.detect(df.limit(0), D.train(df.limit(0))).collect() == []
    out = D.redact_documents(df, model)
    assert out.schema == df.schema
    assert {r["text"] for r in out.where("doc_id = 3").collect()} == {"[email]"}
    assert all(r["text"] is None or r["n_chars"] == len(r["text"]) for r in out.collect())


WIDE = ["john (at) example (dot) com", "(203) 555-1234", "001 (555) 123-4567", "10[.]0[.]0[.]1", "4845.1681.1440.7329",
        "mary_k(at)uni(dot)de", "192.168.7[.]12", "+1/203/555/1234"]
CLEAN = ["looked at the dot on it", "4845.1681.1440.7328", "1,234,567,890", "300[.]1[.]2[.]3", "9807915762804490", "met at noon. Then (dot)"]


def test_planted_wide_forms_are_added_after_training_on_a_table(spark, sf):
    docs = spark.read.parquet(sf.replace("sf0.001", "sf0.1") + "/documents.parquet").select("doc_id", "text")
    planted = spark.createDataFrame([(-k, f"thble reh {x} then it went") for k, x in enumerate(WIDE + CLEAN, 1)], docs.schema)
    table = docs.unionByName(planted)
    got = {r["doc_id"]: (r["base"], r["added"]) for r in D.detect(planted, D.train(table)).collect()}
    assert all(not base for base, _ in got.values())
    found = [[(s["start"], s["end"]) for s in got[-k][1]] for k in range(1, len(WIDE + CLEAN) + 1)]
    assert found[:len(WIDE)] == [[(10, 10 + len(x))] for x in WIDE]
    assert found[len(WIDE):] == [[]] * len(CLEAN)


def test_what_can_be_added_is_not_learnt_as_negative():
    for x in WIDE:
        text = f"thble reh {x} then it went"
        assert D.base_spans(text) == [] and D.candidates(text)
        open_kinds = {k for s, k, e in D.candidates(text) if not D.refused(k, text[s:e])}
        assert open_kinds and not any(k in open_kinds for k, _, _, _ in D.examples(text))
    assert {label for _, label, _, _ in D.examples("mail a.b1@c.de or 10.0.0.1 now")} == {0, 1}


def test_every_place_is_learnt_from(spark):
    """Trees of a table are those of all its examples in memory, however many places there are and however they are dealt out."""
    rng = random.Random(3)
    rows = [(k, f"call +1 ({rng.randint(200, 999)}) {rng.randint(200, 999)}-{rng.randint(1000, 9999)} or part {rng.randint(10 ** 8, 10 ** 14)} now, x{k}")
            for k in range(2500)]
    places = {}
    for _, text in rows:
        for kind, label, f, around in D.examples(text):
            places.setdefault((kind, label, around), set()).add(tuple(f))
    size = {}
    for kind, label, _ in places:
        size[kind, label] = size.get((kind, label), 0) + 1
    assert max(size.values()) > D.EVEN
    df = spark.createDataFrame(rows, "doc_id long, text string")
    model = D.train(df.repartition(7))
    around = spark.createDataFrame([(a,) for a in {p[2] for p in places}], "around string")
    pick = {r["around"]: r["h"] for r in around.select("around", F.xxhash64("around").alias("h")).collect()}
    learn = [(k, y, f) for (k, y, a), forms in places.items() for f in forms if (pick[a] >> 7) % 4]
    x, y = np.array([D._row(k, list(f)) for k, _, f in learn]), np.array([float(y) for _, y, _ in learn])
    whole = D.boost(x, y, np.array([min(1.0, D.EVEN / size[k, label]) for k, label, _ in learn]))
    assert model.trees.start == pytest.approx(whole.start) and len(model.trees.nodes) == len(whole.nodes)
    assert model.trees.raw(x) == pytest.approx(whole.raw(x), abs=1e-6)
    assert D.train(df.repartition(2)).threshold == model.threshold
