import hashlib
import random
import zlib
from fractions import Fraction

import pytest
from hypothesis import given, settings, strategies as st

from skyledger.llm import queries, runs
from tests.llm.plain import frame, words_of


def plain_runs(words, least=24, repeats=3):
    """Every maximal stretch of every period, kept under its smallest one."""
    n, found = len(words), {}
    for q in range(1, n // repeats + 1):
        i = q
        while i < n:
            if words[i] != words[i - q]:
                i += 1
                continue
            first = i
            while i < n and words[i] == words[i - q]:
                i += 1
            start, length = first - q, i - first + q
            if length >= max(least, repeats * q):
                found.setdefault((start, length), q)
    return sorted((s, n, q) for (s, n), q in found.items())


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_row(doc, text):
    words = words_of(text or "")
    n = len(words)
    if doc is not None:
        h = zlib.crc32(str(doc).encode())
        g = h // 10
        if h % 10 == 0 and n > 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = plain_runs(words)
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    drop = {i for s, m, q in found for i in range(s + q, s + m)}
    return (doc, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            sha("".join(f"{s},{m},{q}\n" for s, m, q in found)), sha(" ".join(w for i, w in enumerate(words) if i not in drop)))


def periodic(rng, letters):
    words = []
    while len(words) < 400:
        block = [rng.choice(letters) for _ in range(rng.choice([1, 2, 3, 5, 8, 9, 15, 16, 17, 31, 40]))]
        words += block * rng.randint(1, 7) + block[:rng.randint(0, len(block))]
        words += [rng.choice(letters) for _ in range(rng.randint(0, 6))]
    return words


@pytest.mark.parametrize("letters", ["a", "ab", "abc", "abcdefghijklmnop"])
def test_every_run_of_planted_periods(letters):
    rng = random.Random(len(letters))
    part = [periodic(rng, letters) for _ in range(25)]
    got = runs.runs_of(part, 24, 3)
    for k, words in enumerate(part):
        assert got.get(k, []) == plain_runs(words), k


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from("ab"), max_size=90), max_size=4), st.sampled_from([4, 9, 24, 40]), st.sampled_from([3, 4]))
def test_small_alphabets(part, least, repeats):
    got = runs.runs_of(part, least, repeats)
    assert [got.get(k, []) for k in range(len(part))] == [plain_runs(w, least, repeats) for w in part]


def test_words_of_fibonacci_strings():
    a, b = "a", "ab"
    while len(b) < 600:
        a, b = b, b + a
    for text in (b, b[::-1], b * 3, (b[:55] + "c") * 9):
        assert runs.runs_of([list(text)], 24, 3).get(0, []) == plain_runs(list(text))


def test_one_word_very_often():
    n = 300_000
    assert runs.runs_of([["a"] * n, ["b", "c"]], 24, 3) == {0: [(0, n, 1)]}


def test_a_part_cut_anywhere_gives_the_same(monkeypatch, spark):
    rng = random.Random(5)
    df = frame(spark, [(i, " ".join(periodic(rng, "abcd"))) for i in range(20)])
    whole = sorted(map(str, runs.find_runs(df).collect()))
    monkeypatch.setattr(runs, "WORDS_AT_A_TIME", 500)
    assert sorted(map(str, runs.find_runs(df).collect())) == whole


def test_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(1)
    vocabulary = [f"w{i}" for i in range(60)] + ["É", "ſ", "a b", "x y"]
    rows = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 160)))) for i in range(150)]
    rows += [(200 + i, "\n\t ".join(periodic(rng, "abcd"))) for i in range(20)]
    rows += [(300, None), (301, ""), (302, " \n"), (303, "one"), (304, "a " * 24), (305, "a " * 23), (305, "a " * 30), (None, "b " * 40), (None, None)]
    spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, runs int, n_words string").write.parquet(
        str(tmp_path / "documents.parquet"))
    got = queries.op11_periodic_runs(spark, str(tmp_path))
    assert got.columns[:8] == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    key = lambda r: tuple((v is None, v) for v in r)
    assert sorted((tuple(r)[:8] for r in got.collect()), key=key) == sorted((plain_row(*r) for r in rows), key=key)


def test_empty_table(spark):
    assert runs.find_runs(frame(spark, [])).collect() == []


def test_two_repeats_are_refused(spark):
    with pytest.raises(ValueError):
        runs.find_runs(frame(spark, []), repeats=2)
