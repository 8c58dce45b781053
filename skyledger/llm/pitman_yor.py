"""Language-model scores from a hierarchical Pitman-Yor model.

The previous word, hashed into ``CONTEXTS`` classes, names a restaurant; all
restaurants share the root as their parent, and the root draws from a uniform
base over the training vocabulary and one unseen word. In a restaurant a word's
customers sit at tables; every table is a customer of the root.

Seatings are sampled by Gibbs sweeps in blocks: all customers of one word in one
restaurant get up and sit down again one after another, at a new table with the
odds the process gives, while everyone else stays seated. Beyond ``SINGLE``
customers they sit down in growing parties with a binomial number of new tables.
What a block needs is the word's own state, which one row holds, and totals per
restaurant, which are ``CONTEXTS`` numbers per sweep; so a sweep is one pass over
the words that shuffles nothing. Blocks of one sweep see the totals of the sweep
before. A pass replays earlier sweeps from their totals and seeds instead of
keeping seatings. Scores average the predictive probabilities of the sweeps after
``BURN_IN``.

Counting: tasks count (word, restaurant) pairs of their texts; rows are merged per
word, frequent ones first under a salt. Scoring: the most frequent ``HEAD`` words
have a table of fixed size that every task holds; occurrences of all others go to
their word's row, and sums come back per document.
"""

from __future__ import annotations

import array
import itertools
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from skyledger.llm.common import slices, texts
from skyledger.session import stage

CONTEXTS = 128
SWEEPS = 4
BURN_IN = 1
HEAD = 131_072
STRENGTH = 1.0
SINGLE = 32
# Counted before a task passes its counts on: tokens and distinct words.
FLUSH_TOKENS = 3_000_000
FLUSH_WORDS = 500_000
# Words so frequent in one flush are merged under a salt first.
FREQUENT = 64
SALTS = 64
END = b""  # no word is empty
ENTRY = np.dtype([("u", "<u2"), ("c", "<i8")])
PLACE = np.dtype([("row", "<i8"), ("u", "<u2")])
PRIOR = np.dtype([("u", "<u2"), ("p", "<f8")])


def held_out(id_col: str = "doc_id"):
    """Rows that are not learnt from; a null id is learnt from."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(10)) == 0, F.lit(False))


def tokens(text: str) -> list[bytes]:
    """Words with A-Z in lower case, and one end."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    words.append(END)
    return words


def bucket(word: bytes, contexts: int) -> int:
    return zlib.crc32(word) % contexts


class _Numbers(dict):
    """Numbers of distinct words in the order they came, and each word's restaurant as a context."""

    def __init__(self, contexts: int):
        super().__init__()
        self.contexts, self.buckets = contexts, array.array("H")

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        self.buckets.append(bucket(word, self.contexts))
        return number

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.int64, count=len(words))


def _before(at: np.ndarray, sizes: np.ndarray, contexts: int) -> np.ndarray:
    """Restaurant of each token: that of the token before, or of the end before a text's first."""
    out = np.empty_like(at)
    out[1:] = at[:-1]
    out[np.cumsum(sizes) - sizes] = bucket(END, contexts)
    return out


def _binary(chunks: bytes, offsets: np.ndarray) -> pa.Array:
    """Binary values cut from one buffer."""
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype("<i4").tobytes()), pa.py_buffer(chunks)])


_COUNTED = pa.schema([("word", pa.binary()), ("entries", pa.binary()), ("salt", pa.int32())])


def _count(contexts: int):
    def flush(numbers: _Numbers, codes: list[np.ndarray], salt: int):
        code, count = np.unique(np.concatenate(codes), return_counts=True)
        entries = np.empty(len(code), dtype=ENTRY)
        word = code // contexts
        entries["u"], entries["c"] = code % contexts, count
        starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        total = np.add.reduceat(count, starts)
        names = list(numbers)
        kept = word[starts]
        ends = np.r_[starts[1:], len(code)]
        for at in range(0, len(starts), 65_536):
            part = slice(at, at + 65_536)
            lo, hi = starts[part], ends[part]
            raw = entries[lo[0]:hi[-1]].tobytes()
            offsets = (np.r_[lo, hi[-1]] - lo[0]) * ENTRY.itemsize
            yield pa.RecordBatch.from_arrays([
                pa.array([names[k] for k in kept[part].tolist()], pa.binary()), _binary(raw, offsets),
                pa.array(np.where(total[part] >= FREQUENT, salt, -1).astype(np.int32))], schema=_COUNTED)

    def run(batches):
        from pyspark import TaskContext

        numbers, codes, n, salt = _Numbers(contexts), [], 0, TaskContext.get().partitionId() % SALTS
        for batch in slices(batches):
            lists = [tokens(t) for t in batch.column("text").to_pylist()]
            if not lists:
                continue
            ids = numbers.of(list(itertools.chain.from_iterable(lists)))
            own = np.array(numbers.buckets, dtype=np.int64)[ids]
            codes.append(ids * contexts + _before(own, np.array([len(x) for x in lists]), contexts))
            n += len(ids)
            if n >= FLUSH_TOKENS or len(numbers) >= FLUSH_WORDS:
                yield from flush(numbers, codes, salt)
                numbers, codes, n = _Numbers(contexts), [], 0
        if codes:
            yield from flush(numbers, codes, salt)

    return run


def _by_word(words: list[bytes]) -> np.ndarray:
    """Group number of each of the sorted words."""
    return np.cumsum([0] + [a != b for a, b in zip(words[1:], words)])


def _merge(batches):
    """Add up the entries of equal words in a stream sorted by word."""
    def add(words, raw, salt):
        group = _by_word(words)
        entries = np.frombuffer(b"".join(raw), dtype=ENTRY)
        owner = np.repeat(group, [len(r) // ENTRY.itemsize for r in raw])
        code, back = np.unique(owner * 65_536 + entries["u"], return_inverse=True)
        out = np.empty(len(code), dtype=ENTRY)
        out["u"] = code % 65_536
        out["c"] = np.bincount(back, weights=entries["c"].astype(np.float64)).astype(np.int64)  # exact below 2^53
        size = np.bincount(code // 65_536, minlength=group[-1] + 1)
        first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        return pa.RecordBatch.from_arrays([
            pa.array([words[k] for k in first.tolist()], pa.binary()),
            _binary(out.tobytes(), np.r_[0, np.cumsum(size)] * ENTRY.itemsize),
            pa.array(np.full(len(first), salt, dtype=np.int32))], schema=_COUNTED)

    words, raw, size = [], [], 0
    for batch in batches:
        words += batch.column("word").to_pylist()
        got = batch.column("entries").to_pylist()
        raw += got
        size += sum(map(len, got))
        if words and size >= 8_000_000 and words[-1] != words[0]:
            cut = len(words) - 1
            while words[cut - 1] == words[-1]:
                cut -= 1
            yield add(words[:cut], raw[:cut], -1)
            words, raw = words[cut:], raw[cut:]
            size = sum(map(len, raw))
    if words:
        yield add(words, raw, -1)


def count_words(docs: DataFrame, contexts: int = CONTEXTS) -> DataFrame:
    """(word, entries) of all texts of ``docs`` (text): customers of the word by restaurant, packed."""
    counted_type = StructType.fromDDL("word binary, entries binary, salt int")
    counted = stage(docs.select("text").mapInArrow(_count(contexts), counted_type))
    frequent = counted.where("salt >= 0").repartition("word", "salt").sortWithinPartitions("word").mapInArrow(_merge, counted_type)
    merged = counted.where("salt < 0").unionByName(frequent).repartition("word").sortWithinPartitions("word")
    return stage(merged.mapInArrow(_merge, counted_type).select("word", "entries"))


# ---------------------------------------------------------------- sampling


@dataclass
class Totals:
    """What all restaurants look like after a sweep: tables per restaurant, and tables of the root."""

    tables: np.ndarray
    root_tables: float


@dataclass
class Setting:
    """Fixed parts of the model."""

    contexts: int
    customers: np.ndarray
    discount: float
    root_discount: float
    n_tokens: int
    n_words: int
    strength: float = STRENGTH

    @property
    def uniform(self) -> float:
        return 1.0 / (self.n_words + 1)


def seat(count: np.ndarray, pull: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of each block of ``count`` customers; ``pull`` is a new table's weight (strength and discount times parent)."""
    tables = np.minimum(count, 1).astype(np.float64)
    active = np.flatnonzero(count > 1)
    seated = 1
    while len(active):
        party = 1 if seated < SINGLE else max(1, seated // 8)
        size = np.minimum(party, count[active] - seated)
        new = pull[active] / (pull[active] + seated + (size - 1) / 2 - discount * tables[active])
        tables[active] += rng.random(len(active)) < new if party == 1 else rng.binomial(size, np.clip(new, 0, 1))
        seated += party
        active = active[count[active] > seated]
    return tables


class Words:
    """A batch of words: their entries and, sweep by sweep, their seatings."""

    def __init__(self, words: list[bytes], raw: list[bytes], setting: Setting):
        self.words, self.setting = words, setting
        entries = np.frombuffer(b"".join(raw), dtype=ENTRY)
        self.u, self.c = entries["u"].astype(np.int64), entries["c"].astype(np.int64)
        self.owner = np.repeat(np.arange(len(words)), [len(r) // ENTRY.itemsize for r in raw])
        self.seed = zlib.crc32(words[0]) if words else 0
        # Everyone of a word at one table to begin with.
        self.tables = np.ones(len(self.u))
        self.root_tables = np.ones(len(words))

    def sweep(self, number: int, before: Totals) -> None:
        s, rng = self.setting, np.random.default_rng([number, self.seed])
        root_customers = np.bincount(self.owner, weights=self.tables, minlength=len(self.words))
        all_root = before.tables.sum()
        root_pull = (s.strength + s.root_discount * before.root_tables) * s.uniform
        others = root_customers[self.owner] - self.tables
        others_tables = np.minimum(self.root_tables[self.owner], others)
        parent = (np.maximum(others - s.root_discount * others_tables, 0) + root_pull) / (s.strength + all_root)
        self.tables = seat(self.c, (s.strength + s.discount * before.tables[self.u]) * parent, s.discount, rng)
        root_customers = np.bincount(self.owner, weights=self.tables, minlength=len(self.words)).astype(np.int64)
        self.root_tables = seat(root_customers, np.full(len(self.words), root_pull), s.root_discount, rng)

    def totals(self) -> np.ndarray:
        return np.r_[np.bincount(self.u, weights=self.tables, minlength=self.setting.contexts), self.root_tables.sum()]

    def root_probability(self, now: Totals) -> np.ndarray:
        s = self.setting
        customers = np.bincount(self.owner, weights=self.tables, minlength=len(self.words))
        pull = (s.strength + s.root_discount * now.root_tables) * s.uniform
        return (customers - s.root_discount * self.root_tables + pull) / (s.strength + now.tables.sum())

    def probability(self, now: Totals, root: np.ndarray) -> np.ndarray:
        """Of each entry's word in its restaurant."""
        s = self.setting
        own = self.c - s.discount * self.tables + (s.strength + s.discount * now.tables[self.u]) * root[self.owner]
        return own / (s.strength + s.customers[self.u])


@dataclass
class Model:
    setting: Setting
    history: list[Totals]  # before the first sweep and after each
    words: DataFrame  # word, count, roots (packed doubles per kept sweep), priors (packed restaurant and probability)

    def unseen_in(self) -> np.ndarray:
        """Per kept sweep and restaurant: weight of the root's probability for words without customers there."""
        s = self.setting
        return np.stack([(s.strength + s.discount * t.tables) / (s.strength + s.customers) for t in self.history[1 + BURN_IN:]])

    def unknown_roots(self) -> np.ndarray:
        s = self.setting
        return np.array([(s.strength + s.root_discount * t.root_tables) * s.uniform / (s.strength + t.tables.sum())
                         for t in self.history[1 + BURN_IN:]])


def _summed(found: DataFrame) -> dict[int, float]:
    """Sums of (key, value) rows; keys are fewer than a few hundred."""
    return {r["key"]: r["value"] for r in found.groupBy("key").agg(F.sum("value").alias("value")).collect()}


_KEYED = pa.schema([("key", pa.int32()), ("value", pa.float64())])


def _keyed(values: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.arange(len(values), dtype=np.int32)), pa.array(values.astype(float))], schema=_KEYED)


def fit(docs: DataFrame, contexts: int = CONTEXTS, sweeps: int = SWEEPS) -> Model:
    """Learn from every row of ``docs`` (text); null texts count as empty and still have an end."""
    counted = count_words(docs, contexts)

    def describe(batches):
        for batch in slices(batches, 10_000):
            raw = batch.column("entries").to_pylist()
            entries = np.frombuffer(b"".join(raw), dtype=ENTRY)
            size = np.array([len(r) // ENTRY.itemsize for r in raw])
            u, c = entries["u"].astype(np.int64), entries["c"].astype(float)
            yield _keyed(np.r_[np.bincount(u, weights=c, minlength=contexts), np.bincount(u, minlength=contexts),
                               (c == 1).sum(), (c == 2).sum(), (size == 1).sum(), (size == 2).sum(), len(raw)])

    got = _summed(counted.mapInArrow(describe, StructType.fromDDL("key int, value double")))
    at = [got.get(k, 0.0) for k in range(2 * contexts + 5)]
    ones, twos, root_ones, root_twos, n_words = at[2 * contexts:]

    def discount(n1: float, n2: float) -> float:
        """The share that the counts of words seen once and twice ask for."""
        return float(np.clip(n1 / (n1 + 2 * n2), 0.05, 0.95)) if n1 else 0.5

    customers = np.array(at[:contexts])
    setting = Setting(contexts, customers, discount(ones, twos), discount(root_ones, root_twos), int(customers.sum()), int(n_words))
    history = [Totals(np.array(at[contexts:2 * contexts]), n_words)]

    def replayed(batch: pa.RecordBatch, past: list[Totals]) -> Words:
        words = Words(batch.column("word").to_pylist(), batch.column("entries").to_pylist(), setting)
        for k, totals in enumerate(past):
            words.sweep(k, totals)
        return words

    for _ in range(sweeps):
        def run(batches, past=tuple(history)):
            total = np.zeros(contexts + 1)
            for batch in batches:
                if batch.num_rows:
                    total += replayed(batch, past).totals()
            yield _keyed(total)

        got = _summed(counted.mapInArrow(run, StructType.fromDDL("key int, value double")))
        history.append(Totals(np.array([got.get(k, 0.0) for k in range(contexts)]), got.get(contexts, 0.0)))

    def predict(batches):
        schema = pa.schema([("word", pa.binary()), ("count", pa.int64()), ("roots", pa.binary()), ("priors", pa.binary())])
        for batch in batches:
            if not batch.num_rows:
                continue
            words = Words(batch.column("word").to_pylist(), batch.column("entries").to_pylist(), setting)
            roots, mean = [], np.zeros(len(words.u))
            for k, totals in enumerate(history[:-1]):
                words.sweep(k, totals)
                if k >= BURN_IN:
                    roots.append(words.root_probability(history[k + 1]))
                    mean += words.probability(history[k + 1], roots[-1])
            priors = np.empty(len(words.u), dtype=PRIOR)
            priors["u"], priors["p"] = words.u, mean / len(roots)
            sizes = np.bincount(words.owner, minlength=len(words.words))
            packed = np.ascontiguousarray(np.stack(roots, axis=1), dtype="<f8")
            count = np.bincount(words.owner, weights=words.c, minlength=len(words.words)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([
                batch.column("word"), pa.array(count),
                _binary(packed.tobytes(), np.arange(len(sizes) + 1) * packed.shape[1] * 8),
                _binary(priors.tobytes(), np.r_[0, np.cumsum(sizes)] * PRIOR.itemsize)], schema=schema)

    table = stage(counted.mapInArrow(predict, StructType.fromDDL("word binary, count long, roots binary, priors binary")))
    return Model(setting, history, table)


# ---------------------------------------------------------------- scoring


@dataclass
class _Head:
    """The frequent words: number, log10 probability by restaurant, log10 base probability, own restaurant."""

    number: dict[bytes, int]
    log: np.ndarray
    base: np.ndarray
    bucket: np.ndarray


def _head(model: Model, size: int) -> tuple[_Head, int]:
    """All words of at least some count, at most ``size`` of them, and that count.

    The count is the lowest step of a geometric scale that keeps the bound, found
    from a histogram of at most some hundred steps.
    """
    s, unseen = model.setting, model.unseen_in()
    step = F.floor(F.log2(F.col("count").cast("double")) * 16)
    rows = model.words.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n"), F.min("count").alias("least")).collect()
    least, n = 2 ** 62, 0
    for r in sorted(rows, key=lambda r: -r["step"]):
        n += r["n"]
        if n > size:
            break
        least = r["least"]

    def logs(batches):
        for batch in slices(batches, 4096):
            roots, priors = batch.column("roots").to_pylist(), batch.column("priors").to_pylist()
            p = np.frombuffer(b"".join(roots), "<f8").reshape(len(roots), -1) @ unseen / len(unseen)
            own = np.frombuffer(b"".join(priors), dtype=PRIOR)
            p[np.repeat(np.arange(len(priors)), [len(x) // PRIOR.itemsize for x in priors]), own["u"]] = own["p"]
            raw = np.log10(p).astype("<f4").tobytes()
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("count"), _binary(
                raw, np.arange(len(p) + 1) * 4 * s.contexts)], names=["word", "count", "log"])

    top = model.words.where(F.col("count") >= least).mapInArrow(logs, StructType.fromDDL("word binary, count long, log binary")).toArrow()
    words = top.column("word").to_pylist()
    log = np.frombuffer(b"".join(x.as_buffer() for c in top.column("log").chunks for x in c), "<f4").reshape(len(words), s.contexts)
    return _Head({w: k for k, w in enumerate(words)}, log, _base(top.column("count").to_numpy().astype(float), s),
                 np.array([bucket(w, s.contexts) for w in words], dtype=np.int64)), least


def _base(count: np.ndarray, s: Setting) -> np.ndarray:
    return np.log10((count + 0.1) / (s.n_tokens + 0.1 * (s.n_words + 1)))


_PARTIAL = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", head: int = HEAD) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of ``docs``.

    Null and empty texts consist of the end alone; repeated rows are scored
    each; an empty table gives none. With nothing learnt every word is unknown
    and as likely as any.
    """
    setting, unseen, unknown = model.setting, model.unseen_in(), model.unknown_roots()
    spark = docs.sparkSession
    table, least = _head(model, head)
    sent = spark.sparkContext.broadcast(table)  # at most ``head`` words by ``contexts`` numbers
    contexts = setting.contexts
    rows = texts(docs, id_col, text_col).select("doc_id", "text", held_out().alias("held_out"), F.monotonically_increasing_id().alias("row"))
    first_type = StructType.fromDDL(_PARTIAL + ", word binary, places binary")
    first = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()),
                       ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()),
                       ("word", pa.binary()), ("places", pa.binary())])

    def tail_rows(numbers: _Numbers, held: list):
        ids, row, u = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(ids, kind="stable")
        ids = ids[order]
        places = np.empty(len(ids), dtype=PLACE)
        places["row"], places["u"] = row[order], u[order]
        starts = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
        names, ends = list(numbers), np.r_[starts[1:], len(ids)]
        for at in range(0, len(starts), 65_536):
            lo, hi = starts[at:at + 65_536], ends[at:at + 65_536]
            words = pa.array([names[k] for k in ids[lo].tolist()], pa.binary())
            raw = _binary(places[lo[0]:hi[-1]].tobytes(), (np.r_[lo, hi[-1]] - lo[0]) * PLACE.itemsize)
            yield pa.RecordBatch.from_arrays([*[pa.nulls(len(lo), first.field(k).type) for k in range(7)], words, raw], schema=first)

    def near(batches):
        known = sent.value
        find = known.number.get
        numbers, held, n = _Numbers(contexts), [], 0  # of the words outside the head
        for batch in slices(batches):
            lists = [tokens(t) for t in batch.column("text").to_pylist()]
            sizes = np.array([len(x) for x in lists], dtype=np.int64)
            if not len(sizes):
                continue
            words = list(itertools.chain.from_iterable(lists))
            at = np.fromiter(map(find, words, itertools.repeat(-1)), dtype=np.int64, count=len(words))
            inside = at >= 0
            others = np.flatnonzero(~inside)
            ids = numbers.of([words[k] for k in others.tolist()])
            own = np.empty(len(words), dtype=np.int64)
            own[inside] = known.bucket[at[inside]]
            own[others] = np.array(numbers.buckets, dtype=np.int64)[ids]
            u, doc = _before(own, sizes, contexts), np.repeat(np.arange(len(sizes)), sizes)
            row = batch.column("row").to_numpy()
            here = doc[inside]
            total = [np.bincount(here, minlength=len(sizes)), np.bincount(here, weights=known.base[at[inside]], minlength=len(sizes)),
                     np.bincount(here, weights=known.log[at[inside], u[inside]], minlength=len(sizes))]
            yield pa.RecordBatch.from_arrays([
                batch.column("row"), batch.column("doc_id"), batch.column("held_out"), pa.array(sizes),
                pa.array(total[0].astype(np.int64)), pa.array(total[1].astype(float)), pa.array(total[2].astype(float)),
                pa.nulls(len(sizes), pa.binary()), pa.nulls(len(sizes), pa.binary())], schema=first)
            if len(others):
                held.append((ids, row[doc[others]], u[others]))
                n += len(others)
            if n >= FLUSH_TOKENS or len(numbers) >= FLUSH_WORDS:
                yield from tail_rows(numbers, held)
                numbers, held, n = _Numbers(contexts), [], 0
        if n:
            yield from tail_rows(numbers, held)

    passed = stage(rows.mapInArrow(near, first_type))
    tail = passed.where("word IS NOT NULL").select("word", F.lit(1).alias("kind"), "places", F.lit(None).cast("long").alias("count"),
                                                   F.lit(None).cast("binary").alias("roots"), F.lit(None).cast("binary").alias("priors"))
    known_words = model.words.where(F.col("count") < least).select("word", F.lit(0).alias("kind"), F.lit(None).cast("binary").alias("places"), "count", "roots", "priors")
    meeting = known_words.unionByName(tail).repartition("word").sortWithinPartitions("word", "kind")
    partial = pa.schema([first.field(k) for k in range(7)])

    def far(batches):
        state = None  # the last word's (name, count, roots, priors), for places in the next batch
        for batch in batches:
            names, kind = batch.column("word").to_pylist(), batch.column("kind").to_pylist()
            places, count = batch.column("places").to_pylist(), batch.column("count").to_pylist()
            all_roots, all_priors = batch.column("roots").to_pylist(), batch.column("priors").to_pylist()
            met, raw, owner = [], [], []
            for k, (name, what) in enumerate(zip(names, kind)):
                if what == 0:
                    state = (name, count[k], all_roots[k], all_priors[k])
                    continue
                if state is None or state[0] != name:
                    state = (name, 0, None, b"")
                if not met or met[-1] is not state:
                    met.append(state)
                raw.append(places[k])
                owner.append(len(met) - 1)
            if not raw:
                continue
            at = np.frombuffer(b"".join(raw), dtype=PLACE)
            word = np.repeat(np.array(owner), [len(r) // PLACE.itemsize for r in raw])
            number = np.array([m[1] for m in met], dtype=float)
            root = np.stack([unknown if m[2] is None else np.frombuffer(m[2], "<f8") for m in met])
            own = np.frombuffer(b"".join(m[3] for m in met), dtype=PRIOR)
            code = np.repeat(np.arange(len(met)), [len(m[3]) // PRIOR.itemsize for m in met]) * contexts + own["u"]
            u = at["u"].astype(np.int64)
            want = word * contexts + u
            p = (root[word] * unseen[:, u].T).mean(axis=1)
            if len(code):
                spot = np.minimum(np.searchsorted(code, want), len(code) - 1)
                hit = code[spot] == want
                p[hit] = own["p"][spot[hit]]
            only, back = np.unique(at["row"], return_inverse=True)
            k = len(only)
            yield pa.RecordBatch.from_arrays([
                pa.array(only), pa.nulls(k, pa.int64()), pa.nulls(k, pa.bool_()), pa.nulls(k, pa.int64()),
                pa.array(np.bincount(back, weights=number[word] > 0).astype(np.int64)),
                pa.array(np.bincount(back, weights=_base(number, setting)[word])),
                pa.array(np.bincount(back, weights=np.log10(p)))], schema=partial)

    far_sums = meeting.mapInArrow(far, StructType.fromDDL(_PARTIAL))
    near_sums = passed.where("word IS NULL").select(*[c.split()[0] for c in _PARTIAL.split(", ")])
    both = near_sums.unionByName(far_sums).groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.max("held_out").alias("held_out"), F.max("n_tokens").alias("n_tokens"),
        F.sum("n_known").alias("n_known"), F.sum("base_score").alias("base_score"), F.sum("score").alias("score"))
    return both.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(setting.n_tokens).cast("long").alias("train_tokens"),
                       "base_score", "score")


def perplexity(scored: DataFrame, column: str = "score") -> DataFrame:
    """Perplexity per held_out group: ten to the mean negative score of a token."""
    return scored.groupBy("held_out").agg(F.pow(F.lit(10.0), -F.sum(column) / F.sum("n_tokens")).alias("perplexity"))
