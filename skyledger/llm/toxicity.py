"""Toxicity from subword bags: n-gram embeddings averaged into a linear softmax.

A word is the mean of the vectors of its hashed character n-grams, a passage of
``WINDOW`` words the mean of its words, and a softmax on that mean gives the
passage's class. Misspellings share most n-grams with the word they stand for.
Embeddings and softmax are trained jointly in numpy on a bounded sample of
labelled documents; a document is as toxic as its worst passage, so that one
insult in a long text is not averaged away. A last step calibrates the worst
passage's score on documents that took no part in the training.

Documents of all lengths take part. Which n-grams mark toxic documents is counted
over their whole texts; of each text, a bounded number of passages from all over
it is trained on; the calibration sees the worst passage of whole texts.

Scoring needs of each n-gram only its product with the softmax weights, so it is
array work over whole texts.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from skyledger.llm.common import map_texts, slices, texts
from skyledger.session import stage

WINDOW = 4
GRAMS = (3, 4, 5, 6)
BUCKETS = 1 << 17
DIMENSIONS = 4
# Bounds of the training sample: documents per class, and code points of the passages of each of them.
SAMPLE_PER_CLASS = 1_200
SAMPLE_CHARS = 3_000
# Words are taken apart into pieces of so many code points before passages are picked.
PIECE = 256
HELD = 5
LEAST_DOCUMENTS = 4
DECAY = 1e-7
TABLE_RATE = 0.1
# An n-gram marks toxic documents from this likelihood ratio on and if it is so many times as frequent there.
EVIDENCE = 20.0
PURITY = 20.0
PREDICT_AT = 0.7
_SPACE = np.zeros(128, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def _codes(text: str) -> np.ndarray:
    """Lower-cased code points, each word between two blanks."""
    raw = text.lower().encode("utf-32-le", "surrogatepass")
    code = np.frombuffer(raw, dtype="<u4").astype(np.uint64)
    low = code < 128
    code[low & _SPACE[np.where(low, code, 0).astype(np.int64)]] = 32
    return np.concatenate([[np.uint64(32)], code, [np.uint64(32)]])


def words_and_grams(text: str) -> tuple[np.ndarray, np.ndarray, int]:
    """(word number of each n-gram, its bucket, number of words); a word's blanks belong to its n-grams."""
    code = _codes(text)
    blank = code == 32
    starts = np.flatnonzero(blank[:-1] & ~blank[1:])  # the blank before each word
    if not len(starts):
        return np.empty(0, np.int64), np.empty(0, np.int64), 0
    ends = np.flatnonzero(~blank[:-1] & blank[1:]) + 1  # the blank after it
    number = np.cumsum(blank[:-1] & ~blank[1:]) - 1
    number = np.append(number, number[-1])
    limit = ends[np.maximum(number, 0)]
    hashed, owner, rolling = [], [], np.zeros(len(code), dtype=np.uint64)
    for n in range(1, max(GRAMS) + 1):
        size = len(code) - n + 1
        if size <= 0:
            break
        rolling = (rolling[:size] * np.uint64(1_000_003)) ^ code[n - 1:]
        if n not in GRAMS:
            continue
        at = np.flatnonzero((number[:size] >= 0) & (np.arange(size) + n - 1 <= limit[:size])
                            & (np.arange(size) >= starts[np.maximum(number[:size], 0)]))
        mixed = (rolling[at] + np.uint64(n)) * _PRIME
        hashed.append((mixed >> np.uint64(40)).astype(np.int64) % BUCKETS)
        owner.append(number[at])
    return np.concatenate(owner), np.concatenate(hashed), len(starts)


def passages(per_word: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Means over every run of ``window`` words; over all words if there are fewer."""
    n = len(per_word)
    if n <= window:
        return np.array([per_word.mean()])
    total = np.concatenate([[0.0], np.cumsum(per_word)])
    return (total[window:] - total[:-window]) / window


@dataclass
class Model:
    """Per n-gram bucket its product with the softmax weights; bias; calibration of the worst passage."""

    grams: np.ndarray
    bias: float
    slope: float
    shift: float

    def worst(self, text: str) -> float:
        """Log odds of the worst passage; of a text without words the bias alone."""
        owner, bucket, n = words_and_grams(text)
        if n == 0:
            return self.bias
        value = self.grams[bucket]
        count = np.bincount(owner, minlength=n)
        words = np.bincount(owner, weights=value, minlength=n) / np.maximum(count, 1)
        return float(passages(words).max() + self.bias)

    def score(self, text: str) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.worst(text) + self.shift, -500, 500))))


def _softmax_odds(x: np.ndarray, weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    z = x @ weights + bias
    z -= z.max(axis=1, keepdims=True)
    e = np.exp(z)
    return e / e.sum(axis=1, keepdims=True)


def _marking(k1: np.ndarray, k0: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """Which n-grams stand in toxic documents far more than chance allows: k1 of n1 against k0 of n0."""
    rate = (k1 + k0) / (n1 + n0)

    def gain(k, n, at):
        return k * np.log((k / n + 1e-12) / (at + 1e-12)) + (n - k) * np.log((1 - k / n + 1e-12) / (1 - at + 1e-12))

    evidence = 2 * (gain(k1, n1, rate) + gain(k0, n0, rate))
    return (evidence >= EVIDENCE) & (k1 / n1 >= PURITY * k0 / n0)


def gram_counts(rows: list[tuple[str, int]]) -> np.ndarray:
    """Documents that hold each n-gram: clean ones first, toxic ones second."""
    found = np.zeros((2, BUCKETS))
    for text, label in rows:
        found[label, np.unique(words_and_grams(text)[1])] += 1
    return found


def some_passages(text: str, marks: np.ndarray | None, max_chars: int = SAMPLE_CHARS) -> str:
    """The text, or passages from all over it of at most ``max_chars`` code points in their order.

    Passages with an n-gram of ``marks`` come first, others by a hash.
    """
    words = re.findall(rf"\S{{1,{PIECE}}}", text)
    runs = [" ".join(words[k:k + WINDOW]) for k in range(0, len(words), WINDOW)]
    if sum(map(len, runs)) + len(runs) <= max_chars:
        return " ".join(runs)
    marked = np.zeros(len(runs), dtype=bool)
    if marks is not None:
        owner, bucket, _ = words_and_grams(" ".join(words))
        marked[np.unique(owner[marks[bucket]] // WINDOW)] = True
    hashed = [zlib.crc32(f"{k} {r}".encode("utf-8", "surrogatepass")) for k, r in enumerate(runs)]
    picked, room = [], max_chars
    for k in np.lexsort((hashed, ~marked)).tolist():
        if room < len(runs[k]):
            break
        picked.append(k)
        room -= len(runs[k]) + 1
    return " ".join(runs[k] for k in sorted(picked))


def train(rows: list[tuple[str, int]], rounds: int = 50, rate: float = 0.05, seed: int = 11,
          counts: tuple[np.ndarray, np.ndarray] | None = None) -> Model:
    """Fit embeddings and softmax jointly (Adam, full batches) and calibrate on every fifth document.

    With ``counts`` (documents per class and n-gram, documents per class) all rows
    are learnt from, n-grams are judged by these counts, and nothing is calibrated.

    A toxic document differs from a clean one in a few passages: those that hold
    an n-gram which marks toxic documents (a likelihood-ratio test over the sample).
    They are the passages of class 1, all passages of clean documents those of
    class 0. Without both classes the score is the share of class 1.
    """
    labels = np.array([y for _, y in rows], dtype=np.int64)
    if len(set(labels.tolist())) < 2:
        share = (labels.sum() + 0.5) / (len(labels) + 1.0)
        return Model(np.zeros(BUCKETS), 0.0, 1.0, float(np.log(share / (1 - share))))
    rng = np.random.default_rng(seed)
    # Distinct words with their n-grams; passages as runs of word numbers.
    number: dict[str, int] = {}
    runs, run_doc = [], []
    for d, (text, _) in enumerate(rows):
        words = [number.setdefault(w, len(number)) for w in text.lower().split()] or [number.setdefault("", len(number))]
        for at in range(0, len(words), WINDOW):
            run = words[at:at + WINDOW]
            runs.append(run + [-1] * (WINDOW - len(run)))
            run_doc.append(d)
    run = np.array(runs, dtype=np.int32)
    run_doc = np.array(run_doc, dtype=np.int32)
    del runs
    present = run >= 0
    # Many words at a time, as one text; a word's number follows from its place there.
    owner, bucket = [np.empty(0, np.int32)], [np.empty(0, np.int32)]
    named = [(w, k) for w, k in number.items() if w]
    for at in range(0, len(named), 20_000):
        some = named[at:at + 20_000]
        place, grams, _ = words_and_grams(" ".join(w for w, _ in some))
        owner.append(np.array([k for _, k in some], dtype=np.int32)[place])
        bucket.append(grams.astype(np.int32))
    owner, bucket = np.concatenate(owner), np.concatenate(bucket)
    # Documents per n-gram, and how many of them are toxic or clean among those to learn from;
    # counted a few documents at a time, as their n-grams are many.
    held = np.arange(len(rows)) % HELD == HELD - 1 if counts is None else np.zeros(len(rows), dtype=bool)
    order = np.argsort(owner, kind="stable")
    owner, bucket = owner[order], bucket[order]
    begin = np.searchsorted(owner, np.arange(len(number) + 1))
    spread_over, found = np.zeros(BUCKETS, dtype=np.int64), np.zeros((2, BUCKETS))
    first_run = np.searchsorted(run_doc, np.arange(len(rows) + 1))
    for d in range(len(rows) if counts is None else 0):
        words = np.unique(run[first_run[d]:first_run[d + 1]])
        words = words[words >= 0]
        grams = np.unique(np.concatenate([bucket[begin[w]:begin[w + 1]] for w in words.tolist()]))
        spread_over[grams] += 1
        if not held[d]:
            found[labels[d], grams] += 1
    if counts is not None:
        found, spread_over = counts[0], counts[0].sum(axis=0)
    per_word = np.maximum(np.bincount(owner, minlength=len(number)), 1)
    # An n-gram of few documents says nothing of others; its vector stays zero.
    frequent = spread_over[bucket] >= LEAST_DOCUMENTS
    owner, bucket = owner[frequent], bucket[frequent]
    used, local = np.unique(bucket, return_inverse=True)
    local = local.astype(np.int32)
    size = present.sum(axis=1)
    table = rng.normal(0, 0.01, (len(used), DIMENSIONS)).astype(np.float32)
    weights, bias = rng.normal(0, 0.5, (DIMENSIONS, 2)), np.zeros(2)
    learn_run = ~held[run_doc]
    # Which passages make a toxic document toxic: those with an n-gram that marks toxic documents.
    # The other passages of toxic documents are left out; if no n-gram stands out, all are taken.
    learn = np.bincount(labels[~held], minlength=2) if counts is None else counts[1]
    gram_marks = _marking(found[1], found[0], *np.maximum(learn[::-1], 1))
    marking = np.bincount(owner, weights=gram_marks[bucket], minlength=len(number)) > 0
    marked = (marking[run] & present).any(axis=1)
    target = labels[run_doc]
    if not marked[(target == 1) & learn_run].any():
        marked[:] = True
    taking = learn_run & ((target == 0) | marked)
    share = taking / np.maximum(np.bincount(target[taking], minlength=2), 1)[target] / 2
    moments = [np.zeros_like(x) for x in (table, table, weights, weights, bias, bias)]

    def summed(values: np.ndarray, order: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """Sums of rows of ``values`` taken in ``order``, from each begin to the next; empty runs give 0."""
        out = np.zeros((len(begin) - 1, values.shape[1]), dtype=np.float32)
        full = begin[1:] > begin[:-1]
        if full.any():
            out[full] = np.add.reduceat(values[order], begin[:-1][full], axis=0)
        return out

    by_gram = np.argsort(local, kind="stable")
    begin_word = np.searchsorted(owner, np.arange(len(number) + 1))
    begin_gram = np.searchsorted(local[by_gram], np.arange(len(used) + 1))
    rows_of, flat = np.nonzero(present)[0], run[present]
    by_word = np.argsort(flat, kind="stable")
    begin_flat = np.searchsorted(flat[by_word], np.arange(len(number) + 1))

    def passage_means(word_vectors):
        padded = np.vstack([word_vectors, np.zeros((1, DIMENSIONS), dtype=np.float32)])
        return padded[run].sum(axis=1) / size[:, None]

    for step in range(1, rounds + 1):
        word_vectors = summed(table, local, begin_word) / per_word[:, None]
        x = passage_means(word_vectors)
        p = _softmax_odds(x, weights, bias)
        delta = p.copy()
        delta[np.arange(len(run)), target] -= 1
        delta *= share[:, None]
        dx = (delta @ weights.T / size[:, None]).astype(np.float32)
        dword = summed(dx[rows_of], by_word, begin_flat) / per_word[:, None]
        grads = (summed(dword[owner], by_gram, begin_gram) + DECAY * table, x.T @ delta, delta.sum(axis=0))
        for k, (value, grad) in enumerate(zip((table, weights, bias), grads)):
            m, v = moments[2 * k], moments[2 * k + 1]
            m += 0.1 * (grad - m)
            v += 0.01 * (grad * grad - v)
            # One scale for the whole table: n-grams that few passages hold move little.
            size_of = np.sqrt((v.mean() if k == 0 else v) / (1 - 0.99 ** step)) + 1e-12
            pace = (TABLE_RATE if k == 0 else rate) * (1 - 0.9 * step / rounds)
            value -= (pace * (m / (1 - 0.9 ** step)) / size_of).astype(value.dtype)
    lean = weights[:, 1] - weights[:, 0]
    grams = np.zeros(BUCKETS)
    grams[used] = table @ lean
    model = Model(grams, float(bias[1] - bias[0]), 1.0, 0.0)
    return _calibrate(model, [(model.worst(text), label) for (text, label), h in zip(rows, held) if h])


def _calibrate(model: Model, rows: list[tuple[float, int]]) -> Model:
    """Platt's slope and shift of (worst passage, label) by Newton steps, with his smoothed targets."""
    y = np.array([label for _, label in rows], dtype=float)
    if not len(y) or y.min() == y.max():
        return model
    x = np.array([worst for worst, _ in rows])
    n1, n0 = y.sum(), (1 - y).sum()
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    centre, scale = x.mean(), x.std() + 1e-9
    design = np.stack([(x - centre) / scale, np.ones_like(x)], axis=1)
    beta = np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        grad = design.T @ (p - target) + 1e-3 * beta
        hess = (design * (p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        step *= min(1.0, 2.0 / (np.abs(step).max() + 1e-12))
        beta -= step
        if np.abs(step).max() < 1e-9:
            break
    return Model(model.grams, model.bias, float(beta[0] / scale), float(beta[1] - beta[0] * centre / scale))


def in_training(id_col: str = "doc_id"):
    """Rows whose labels may be learnt from."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(3)) != 1


def sample_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                per_class: int = SAMPLE_PER_CLASS, max_chars: int | None = None) -> DataFrame:
    """(doc_id, text, toxic): at most ``per_class`` labelled texts of each class, of any length unless ``max_chars`` is given.

    The ids are picked by a hash from labels that have a document; only those rows
    of the documents are read as text, of repeated ids the smallest text. Rows
    without an id or a label are never picked.
    """
    ids = labels.select(F.col("doc_id").alias("pick_id"), F.col("toxic").cast("int").alias("toxic"))
    ids = ids.where(F.col("pick_id").isNotNull() & F.col("toxic").isin(0, 1) & in_training("pick_id")).dropDuplicates(["pick_id", "toxic"])
    rows = texts(docs, id_col, text_col)
    if max_chars is not None:
        rows = rows.where(F.length("text") <= max_chars)
    there = ids.join(rows.select("doc_id").distinct(), F.col("doc_id") == F.col("pick_id")).select("pick_id", "toxic")
    tops = [there.where(F.col("toxic") == label).orderBy(F.xxhash64("pick_id"), "pick_id").limit(per_class) for label in (0, 1)]
    picked = tops[0].unionByName(tops[1])
    found = rows.join(F.broadcast(picked), F.col("doc_id") == F.col("pick_id"))
    return found.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select("doc_id", "text", "toxic")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Train on passages of the sampled documents, in one task; calibrate on whole texts kept out of that.

    The driver gets counts per n-gram, the model, and one number for each document kept out.
    """
    sample = stage(sample_rows(docs, labels, id_col, text_col))
    order = sorted((r["toxic"], zlib.crc32(str(r["doc_id"]).encode()), r["doc_id"]) for r in sample.select("doc_id", "toxic").collect())
    held = {r[2] for label in (0, 1) for r in [x for x in order if x[0] == label][HELD - 1::HELD]}
    known = [r for r in order if r[2] not in held]
    if len({r[0] for r in known}) < 2:
        return train([("", r[0]) for r in order])  # the share of class 1
    sent_held = docs.sparkSession.sparkContext.broadcast(held)

    def learnt(batches):
        for batch in slices(batches, 16):
            for r in batch.to_pylist():
                if r["doc_id"] not in sent_held.value:
                    yield r

    def count(batches):
        found = np.zeros((2, BUCKETS))
        for r in learnt(batches):
            found += gram_counts([(r["text"], r["toxic"])])
        at = np.flatnonzero(found.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(found[0, at]), pa.array(found[1, at])], names=["gram", "clean", "toxic"])

    # At most BUCKETS rows, whatever the corpus.
    got = sample.mapInArrow(count, StructType.fromDDL("gram long, clean double, toxic double")).groupBy("gram").agg(
        F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).toArrow()
    found, size = np.zeros((2, BUCKETS)), np.bincount([r[0] for r in known], minlength=2)
    found[:, got.column("gram").to_numpy()] = got.column("clean").to_numpy(), got.column("toxic").to_numpy()
    sent = docs.sparkSession.sparkContext.broadcast((found, size))

    def shorten(batches):
        marks = _marking(sent.value[0][1], sent.value[0][0], *np.maximum(sent.value[1][::-1], 1))
        for r in learnt(batches):
            yield pa.RecordBatch.from_pylist([{"doc_id": str(r["doc_id"]), "text": some_passages(r["text"], marks if r["toxic"] else None),
                                             "toxic": r["toxic"]}], schema=short)

    def run(batches):
        rows = sorted((zlib.crc32(r["doc_id"].encode()), r["doc_id"], r["text"], r["toxic"]) for b in batches for r in b.to_pylist())
        shuffled = np.random.default_rng(5).permutation(len(rows))
        model = train([rows[k][2:] for k in shuffled], counts=sent.value)
        yield pa.RecordBatch.from_pylist([{"grams": model.grams.astype("<f8").tobytes(), "bias": model.bias}])

    short = pa.schema([("doc_id", pa.string()), ("text", pa.string()), ("toxic", pa.int32())])
    passage_rows = sample.mapInArrow(shorten, StructType.fromDDL("doc_id string, text string, toxic int")).repartition(1)
    got = passage_rows.mapInArrow(run, StructType.fromDDL("grams binary, bias double")).collect()
    model = Model(np.frombuffer(got[0]["grams"], "<f8"), got[0]["bias"], 1.0, 0.0)
    sent_model = docs.sparkSession.sparkContext.broadcast(model)

    def worst(batches):
        for batch in slices(batches, 16):
            rows = [(sent_model.value.worst(r["text"]), r["toxic"]) for r in batch.to_pylist() if r["doc_id"] in sent_held.value]
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in rows], pa.float64()), pa.array([y for _, y in rows], pa.int32())],
                                             names=["worst", "toxic"])

    kept_out = sample.mapInArrow(worst, StructType.fromDDL("worst double, toxic int")).collect()
    return _calibrate(model, sorted((r["worst"], r["toxic"]) for r in kept_out))


def scores(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, predicted) of every row; null and empty texts get the score of no words."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)  # BUCKETS numbers, whatever the corpus

    def make():
        known = sent.value

        def work(ids, ts):
            got = [known.score(t) for t in ts]
            return [got, [int(s >= PREDICT_AT) for s in got]]
        return work

    return map_texts(texts(docs, id_col, text_col), "doc_id long, score double, predicted int", make)


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, all columns as they were."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        known = sent.value
        for batch in slices(batches):
            keep = [known.score(t or "") < PREDICT_AT for t in batch.column(text_col).to_pylist()]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, StructType.fromJson(docs.schema.jsonValue()))
