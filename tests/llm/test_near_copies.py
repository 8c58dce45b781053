import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skyledger.llm import near_copies as N
from tests.llm.plain import plain_groups


def plain_similarity(a, b, k=5):
    def of(t):
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").split()
        return {" ".join(w[i:i + k]) for i in range(max(1, len(w) - k + 1))}
    return len(of(a) & of(b)) / len(of(a) | of(b))


def corpus(rng, n=60):
    """Originals, copies of them with words changed to a stated similarity, and unrelated texts of the same words."""
    vocabulary = [f"word{i}" for i in range(3000)]
    weight = 1.0 / np.arange(1, 3001)
    weight /= weight.sum()
    rows, pairs = [], []
    for i in range(n):
        words = list(np.random.default_rng(rng.random().__hash__() % 2 ** 32).choice(vocabulary, rng.randint(80, 400), p=weight))
        rows.append((3 * i, " ".join(words)))
        changed = list(words)
        while True:
            trial = list(changed)
            trial[rng.randrange(len(trial))] = f"new{rng.randint(0, 10 ** 6)}"
            if plain_similarity(" ".join(words), " ".join(trial)) < rng.uniform(0.8, 0.97):
                break
            changed = trial
        rows.append((3 * i + 1, " ".join(changed).upper()))
        pairs.append((3 * i, 3 * i + 1))
        rows.append((3 * i + 2, " ".join(rng.sample(words, len(words)))))
    return rows, pairs


def test_planted_near_copies_go_and_shuffled_texts_stay(spark):
    rows, pairs = corpus(random.Random(4))
    kept = {r["doc_id"] for r in N.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(a in kept and a + 2 in kept for a, _ in pairs)
    assert np.mean([b not in kept for _, b in pairs]) >= 0.9


def test_every_row_that_goes_is_like_another_of_its_group(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    text = {r["doc_id"]: r["text"] for r in docs.collect()}
    kept = {r["doc_id"] for r in N.keep_one(docs).collect()}
    low = plain_groups(text, lambda a, b: plain_similarity(a, b) >= 0.8)
    groups = {}
    for i in text:
        groups.setdefault(low[i], set()).add(i)
    # Nothing goes but near copies, and the smallest of each group stays.
    assert all(low[i] in kept for i in text)
    extra = sum(len(g & kept) - 1 for g in groups.values())
    assert extra <= 0.1 * sum(len(g) - 1 for g in groups.values())


def test_similarity_of_hashes_is_that_of_words():
    rng = random.Random(2)
    for _ in range(200):
        a = [rng.choice("abcd") for _ in range(rng.randint(0, 30))]
        b = a[:rng.randint(0, 30)] + [rng.choice("abcd") for _ in range(rng.randint(0, 5))]
        x, y = (N.Words([w.encode() for w in t]).shingles() for t in (a, b))
        assert N.similarity(x, y) == pytest.approx(plain_similarity(" ".join(a), " ".join(b)))
        assert N.estimated(x[:N.SKETCH], y[:N.SKETCH]) == pytest.approx(N.similarity(x, y))


@pytest.mark.parametrize("batch", [1, 7, 1000])
def test_buckets_of_a_stream(batch):
    import pyarrow as pa
    rng = random.Random(3)
    sizes = [1, 1, 2, 5, 1, 12, 3, 9, 1, 30, 2, 11]
    key = np.repeat(np.arange(len(sizes)), sizes)
    fp = np.array([rng.getrandbits(3) | i << 8 for i in range(len(key))], dtype=np.int64)
    table = pa.table({"key": pa.array(key), "fp": pa.array(fp)})
    out = [r for b in N._near_links(12, 10)(table.to_batches(max_chunksize=batch)) for r in b.to_pylist()]
    crowded = {k for k, n in enumerate(sizes) if n > 10}
    assert sorted(r["a"] for r in out if r["b"] is None) == sorted(f for k, f in zip(key, fp) if k in crowded)
    place = dict(zip(fp.tolist(), key.tolist()))
    pairs = [(r["a"], r["b"]) for r in out if r["b"] is not None]
    assert all(place[a] == place[b] and place[a] not in crowded for a, b in pairs)
    want = {f for k in range(len(sizes)) if k not in crowded for f in fp[key == k][1:].tolist()
            if any((int(f) ^ int(g)).bit_count() <= 12 for g in fp[key == k] if g < f)}
    assert {a for a, _ in pairs} == want


def test_masks_cover_the_radius_and_keep_many_bits():
    found = [m % 2 ** 64 for m in N.spread_masks(N.RADIUS)]
    assert len(found) == 127 and min(m.bit_count() for m in found) >= 16
    rng = random.Random(5)
    for _ in range(3000):
        away = sum(1 << b for b in rng.sample(range(64), rng.randint(1, N.RADIUS)))
        assert any(m & away == 0 for m in found)


def test_a_large_group_gives_few_links(spark):
    rng = random.Random(1)
    base = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(300):
        words = list(base)
        words[rng.randrange(300)] = f"x{i}"
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert [r["doc_id"] for r in N.keep_one(df).collect()] == [0]
    fps = spark.createDataFrame([(N.Words(N.words_of(t)).fingerprint(),) for _, t in rows], "fp long").distinct()
    n = fps.count()
    assert N.candidates(fps).count() <= 127 * N.NEAREST * n


def test_edges_of_the_table(spark):
    long = "word " * 60_000
    rows = [(1, None, "a"), (2, "", "b"), (3, "one two", "c"), (3, "ONE two", "d"), (None, "one\ttwo", "e"), (5, long, "f"),
            (6, long, "g"), (7, "\t\n ", "h"), (3, "other", "i"), (None, "alone here", "j")]
    docs = spark.createDataFrame(rows, "doc_id int, text string, key string").withColumn("m", F.create_map(F.lit("x"), F.col("key")))
    kept = N.keep_one(docs)
    assert kept.dtypes == docs.dtypes
    assert sorted(r["key"] for r in kept.collect()) == ["a", "d", "f", "i", "j"]  # "ONE two" sorts before "one two"
    assert N.keep_one(docs.limit(0)).collect() == []


def test_no_partner_within_the_radius_is_left_out(spark):
    """Shuffled texts share a fingerprint, and look-alikes crowd the nearest places; the two real copies still meet."""
    rng = random.Random(8)
    base = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join(rng.sample(base, len(base)))) for i in range(40)]
    for i in (3, 11, 17, 29):
        words = rows[i][1].split()
        words[rng.randrange(20, 100)] = f"other{i}"
        rows.append((100 + i, " ".join(words)))
    text = dict(rows)
    fp = {i: N.Words(N.words_of(t)).fingerprint() for i, t in rows}
    low = plain_groups(text, lambda a, b: plain_similarity(a, b) >= 0.8)
    linked = [i for i in low if low[i] != i and (fp[i] ^ fp[low[i]]).bit_count() <= N.RADIUS]
    assert len(linked) >= 3
    kept = {r["doc_id"] for r in N.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == set(text) - set(linked)


@pytest.mark.parametrize("tile", [3, 1000])
def test_other_candidates_are_all_pairs_of_different_parts(spark, tile):
    rng = random.Random(9)
    centres = [rng.getrandbits(63) for _ in range(4)]
    fps = {c ^ sum(1 << b for b in rng.sample(range(62), rng.randint(0, 4))): rng.choice([1, 2, 3, None]) for c in centres for _ in range(25)}
    df = spark.createDataFrame(list(fps.items()), "fp long, part long")
    got = [tuple(sorted(r)) for r in N.other_candidates(df, 6, tile).collect()]
    want = {(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 6 and (fps[a] is None or fps[b] is None or fps[a] != fps[b])}
    assert len(got) == len(set(got)) and set(got) == want


def test_a_stream_may_end_in_a_bucket_without_a_pair():
    batch = pa.RecordBatch.from_arrays([pa.array([1, 1]), pa.array([0, 2 ** 40 - 1])], names=["key", "fp"])
    assert list(N._near_links(6, 100)(iter([batch]))) == []


def test_look_alikes_are_not_confirmed_pair_by_pair(spark, monkeypatch):
    """A large group within the radius of one another, none of them similar enough, and two that only the second round meets."""
    rng = np.random.default_rng(4)
    base = [f"word{k}" for k in rng.integers(0, 5000, 200)]
    docs = []
    for i in range(250):
        words = list(base)
        for k, at in enumerate(rng.choice(200, 7, replace=False).tolist()):
            words[at] = f"other{i}x{k}"
        docs.append((i, " ".join(words)))
    docs.append((250, docs[17][1].replace(docs[17][1].split()[-1], "end")))
    counted, real = [], N.confirmed

    def confirmed(pairs, *args):
        counted.append(pairs.count())
        return real(pairs, *args)

    monkeypatch.setattr(N, "confirmed", confirmed)
    monkeypatch.setattr(N, "NEAREST", 1)
    kept = {r["doc_id"] for r in N.keep_one(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    sets = {i: N.Words(N.words_of(t)).shingles() for i, t in docs}
    assert kept == {i for i in sets if not any(N.similarity(sets[j], sets[i]) >= N.SIMILARITY for j in range(i))}
    assert sum(counted) < len(docs) * (len(docs) - 1) / 2


@pytest.mark.parametrize("tile", [4, 1000])
def test_joining_links_join_what_all_pairs_join(spark, tile):
    rng = np.random.default_rng(9)
    docs = {}
    for g in range(6):
        base = [f"g{g}w{k}" for k in range(60)]
        for i in range(12):
            words = list(base)
            for at in rng.choice(60, int(rng.integers(0, 4)), replace=False).tolist():
                words[at] = f"n{rng.integers(1000)}"
            text = " ".join(words)
            docs[N.text_key(N.words_of(text))] = text
    held = {k: N.Words(N.words_of(t)) for k, t in docs.items()}
    part = {k: n // 2 for n, k in enumerate(docs)}
    members = spark.createDataFrame([(bytearray(k), w.fingerprint(), part[k]) for k, w in held.items()], "key binary, fp long, part long")
    bodies = spark.createDataFrame([(bytearray(k), t) for k, t in docs.items()], "key binary, text string")
    links = [(bytes(r["a"]), bytes(r["b"])) for r in N.joining_links(members, bodies, 6, N.SHINGLE, N.SIMILARITY, tile).collect()]
    near = {k: w.shingles() for k, w in held.items()}
    pairs = [(x, y) for x in docs for y in docs if x < y and ((held[x].fingerprint() ^ held[y].fingerprint()) % 2 ** 64).bit_count() <= 6
             and N.similarity(near[x], near[y]) >= N.SIMILARITY]

    def groups(found):
        root = {p: p for p in part.values()}
        for x, y in found:
            a, b = root[part[x]], root[part[y]]
            root = {p: a if r == b else r for p, r in root.items()}
        return sorted(sorted(p for p in root if root[p] == r) for r in set(root.values()))

    assert pairs and groups(links) == groups(pairs)
    assert {tuple(sorted(p)) for p in links} <= set(pairs)
