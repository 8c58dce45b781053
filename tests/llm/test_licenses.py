import random
import re

import duckdb
import pytest

from skyledger.llm import licenses, queries
from tests.llm.plain import frame

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain_places(words):
    out = []
    for phrase, label in licenses.PHRASES:
        p = phrase.split()
        out += [(i, label) for i in range(len(words)) if words[i:i + len(p)] == p]
    return sorted(out)


def plain_matches(words, templates, threshold, block):
    out = set()
    for start in range(0, len(words), block // 2):
        own = set(words[start:start + block])
        for t, (label, text) in enumerate(templates):
            wanted = set(plain_words(text))
            if len(own & wanted) >= threshold * len(wanted) - 1e-9:
                out.add((start, label, t, len(own & wanted) / len(wanted)))
    return out


def notice(rng, text, drop):
    words = [w for w in text.split() if rng.random() > drop]
    at = rng.randint(0, len(words))
    return " ".join(words[:at] + ["added"] * rng.randint(0, 3) + words[at:])


def corpus():
    rng = random.Random(7)
    plain = [f"wörd{i}" for i in range(80)] + ["the", "of", "License", "under", "GNU", "software", "cc", "by", "MIT", "a", "2.0", "public"]
    rows = []
    for i in range(160):
        words = [rng.choice(plain) for _ in range(rng.randint(0, 300))]
        for _ in range(rng.randint(0, 2)):
            words.insert(rng.randint(0, len(words)), notice(rng, rng.choice(licenses.TEMPLATES)[1], rng.choice([0, 0.1, 0.2, 0.3])))
        rows.append((i, rng.choice([" ", "\n", ", "]).join(words)))
    rows += [(500, None), (501, ""), (502, "..."), (503, "Mit License mit license; MIT\tLICENSE"), (503, "CC-BY-NC 4.0"), (None, "gnu general public license"),
             (504, "cc by " * 3000), (505, "the GNU Lesser General Public License"), (505, "the GNU Lesser General Public License")]
    return rows


def test_matches_equal_every_block_against_every_template(spark):
    rows = [r for r in corpus() if r[0] is not None and r[0] < 500]
    for threshold, block in ((0.8, 64), (0.5, 20), (1.0, 64)):
        _, found = licenses.scan(frame(spark, rows), threshold=threshold, block=block)
        got = {(r.doc_id, r.start, r.label, r.template, r.containment) for r in found.collect()}
        want = {(i, *m) for i, t in rows for m in plain_matches(plain_words(t), licenses.TEMPLATES, threshold, block)}
        assert got == want and want, (threshold, block)


def test_query_equals_brute_force_and_sql(spark, tmp_path):
    rows = corpus()
    spark.createDataFrame([(d, t, 5, ["x"]) for d, t in rows], "doc_id long, text string, row int, labels array<string>").write.parquet(
        f"{tmp_path}/documents.parquet")
    out = queries.op13_license_scan(spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    key = lambda r: tuple((v is None, v) for v in r)
    got = sorted(map(tuple, out.collect()), key=key)
    want = []
    for doc, text in rows:
        words = plain_words(text)
        places = plain_places(words)
        found = plain_matches(words, licenses.TEMPLATES, licenses.THRESHOLD, licenses.BLOCK)
        base = sorted({label for _, label in places})
        score = 1.0 if places else max((m[3] for m in found), default=0.0)
        want.append((doc, len(words), len(places), places[0][0] if places else None, places[-1][0] if places else None,
                     ",".join(base), ",".join(sorted({*base, *(m[1] for m in found)})), score))
    assert got == sorted(want, key=key)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(con.execute(queries.ORACLES["op13_license_scan"]).fetchall(), key=key) == got


def test_reworded_notices_are_labelled_and_prose_is_not(spark):
    rows = [(1, "Hereby permission is granted, free of charge, to a person obtaining any copy of this software and its associated "
                "documentation files to deal in software without restriction."),
            (2, "The general public bought a license to fish under the bridge; version 3 of this work is free.")]
    got = {r.doc_id: (r.all_labels, r.labels) for r in licenses.detect(frame(spark, rows)).collect()}
    assert got == {1: (["mit"], []), 2: ([], [])}


def test_empty_table_and_no_templates(spark):
    assert licenses.detect(frame(spark, [])).collect() == []
    assert licenses.detect(frame(spark, [(1, "mit license")]), templates=[]).first().all_labels == ["mit"]


@pytest.mark.parametrize("size, threshold, least", [(10, 0.8, 8), (11, 0.8, 9), (5, 1.0, 5), (3, 0.01, 1), (12, 0.75, 9)])
def test_words_needed(size, threshold, least):
    assert licenses.needed(size, threshold) == least
