"""The pipeline's stages: what goes, what stays, and how the rest is packed."""

import zlib

import numpy as np
import pytest

import corpus_pipeline as C
from skyledger.llm import pii, quality
from skyledger.llm.queries import vocabulary
from skyledger.session import stage


@pytest.fixture(scope="module")
def steps(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = [docs]
    for _, step in C.STAGES:
        out.append(stage(step(spark, out[-1], sf)))
    return out


def test_columns_stay_until_the_last(steps):
    assert all(s.schema == steps[0].schema for s in steps[:-1])
    assert [n for n, _ in C.STAGES] == ["quality_rules", "toxicity", "simhash_near_dedup", "pii", "best_fit_packing"]


def test_each_stage_keeps_rows_as_they_were(steps):
    for a, b in zip(steps[:3], steps[1:4]):
        before = {r["doc_id"]: tuple(r) for r in a.collect()}
        assert all(before[r["doc_id"]] == tuple(r) for r in b.collect())


def test_quality_drops_junk_and_keeps_clean(spark, sf, steps):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in steps[1].collect()}
    base = {r["doc_id"]: quality.measures(r["text"])[5] for r in steps[0].collect()}
    clean = [i for i, q in labels.items() if q == 1 and not base[i]]
    junk = [i for i, q in labels.items() if q == 0]
    assert sum(i in kept for i in clean) >= 0.95 * len(clean)
    assert sum(i in kept for i in junk) <= 0.1 * len(junk)
    assert not any(base[i] for i in kept)


def test_one_of_each_group_stays(steps):
    """Of texts that are at least 0.8 alike in five-word shingles the first stays; nothing else goes."""
    from plain import plain_groups
    from test_near_copies import plain_similarity
    docs = {r["doc_id"]: r["text"] for r in steps[2].collect()}
    kept = {r["doc_id"] for r in steps[3].collect()}
    low = plain_groups(docs, lambda a, b: plain_similarity(a, b) >= 0.8)
    assert set(low.values()) <= kept
    assert len(kept - set(low.values())) <= 0.1 * (len(docs) - len(set(low.values())))


def test_redaction_leaves_no_base_span(steps):
    before = {r["doc_id"]: r["text"] for r in steps[3].collect()}
    for r in steps[4].collect():
        assert pii.base_spans(r["text"]) == [] and r["n_chars"] == len(r["text"])
        if not pii.base_spans(before[r["doc_id"]]):
            assert r["text"] == before[r["doc_id"]]


def check_packing(docs, rows, path, capacity=4096):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(path)
    want = []
    for i, t in docs:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [1]
        want += [(i, k, at, len(ids[at:at + capacity]), zlib.crc32(np.array(ids[at:at + capacity], "<u4").tobytes()))
                 for k, at in enumerate(range(0, len(ids), capacity))]
    got = [(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows]
    assert sorted(got, key=str) == sorted(want, key=str)
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins), sum(x[3] for x in want)


def test_packing_is_exact_and_tight(steps):
    rows = steps[5].collect()
    n, total = check_packing([(r["doc_id"], r["text"]) for r in steps[4].collect()], rows, vocabulary("word_bpe_49k.json"))
    assert n <= -(-total // 4096) * 1.02 + 1


def test_pipeline_runs_as_registered(spark, sf, steps):
    from __spark_entry__ import queries
    assert queries()["pipeline"] is C.run
    assert C.run(spark, sf).count() == steps[5].count()


def test_odd_rows_pass_through_every_stage(spark, tmp_path):
    text = "The man went to the market and bought some bread, milk and cheese for his family before going home again. "
    many = [(i, " ".join(f"{w}{(i * 7 + k) % 31}" for k, w in enumerate((text * 4).split())), "x", 1) for i in range(30)]
    rows = many + many[:1] + [(None, None, None, None), (100, "", None, 0), (101, "word " * 30_000, "x", 1)]
    sf_dir = f"file://{tmp_path}"
    docs = spark.createDataFrame(rows, "doc_id long, text string, pattern string, n_chars long")
    spark.createDataFrame([(1, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{sf_dir}/labels.parquet")
    for table in (docs, docs.limit(0)):
        now = table
        for _, step in C.STAGES:
            now = stage(step(spark, now, sf_dir))
        assert now.count() >= 0
