"""A hierarchical Pitman-Yor model with one restaurant for every previous word.

The model and its sampling are those of ``pitman_yor``; here no two previous words
share a restaurant. A word is known by the 64 bits of its XXH64 (that any two of
ten million words share them has odds of 3 in a million).

Pairs (previous word, word) are dealt to a grid of cells, the row by the previous
word and the column by the word, so neither a frequent word nor a frequent
restaurant meets in one task, and a cell holds a bounded number of tokens. Tasks
cut texts into one packed row per cell and flush of texts: distinct pairs and how
often they stand there; for scoring they cut them again, with the places in texts.
A sweep sends each
cell's tables per restaurant and per word to the row's and the column's group,
which add them up, seat the root's customers and answer every cell. A pair seen
once has one table whatever happens, so only the others take part in sweeps; the
groups add the rest as a fixed number. At the end the groups tell every cell what
its restaurants and words look like after each kept sweep, the cells score their
pairs, and sums come back per flush of texts. What is sent to a cell follows the
order of its learnt keys, which counting and scoring find alike.
"""

from __future__ import annotations

import array
import itertools
import math
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from skyledger.llm.common import slices, texts
from skyledger.llm.pitman_yor import BURN_IN, FLUSH_WORDS, STRENGTH, SWEEPS, held_out, seat, tokens
from skyledger.session import free_shuffles, stage

# Text that the pairs of one cell stand for.
CELL_BYTES = 16_000_000
# Tokens of one flush.
FLUSH_TOKENS = 3_500_000

_ROW = pa.schema([("to", pa.int64()), ("kind", pa.int32()), ("source", pa.int64()), ("data", pa.binary()), ("sums", pa.list_(pa.float64()))])
_DDL = "to long, kind int, source long, data binary, sums array<double>"
# Kinds of rows: what a cell or a group is sent.
PAIRS, DOCS, SEATS, CONTEXT, WORD, FIXED_CONTEXT, FIXED_WORD = range(7)


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays in few bytes: whole numbers, none negative, as short as they get; keys and fractions as they are."""
    small = [a if a.dtype.kind == "f" or a.dtype == np.uint64 or (most := int(a.max(initial=0))) >= 2 ** 32 else a.astype(np.min_scalar_type(most))
             for a in arrays]
    raw = pickle.dumps(small, protocol=5)
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(raw, asbytes=True)


def _unpack(data: bytes) -> list[np.ndarray]:
    got = pickle.loads(pa.Codec("zstd").decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True))
    return [a.astype(np.int64) if a.dtype.kind == "u" and a.dtype != np.uint64 else a for a in got]


def _rows(rows: list[tuple]) -> pa.Table:
    """(to, kind, source, data, sums) as a table."""
    return pa.Table.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), _ROW)] if rows
                                else [pa.array([], f.type) for f in _ROW], schema=_ROW)


def _each(table: pa.Table, *kinds: int):
    """(to, source, arrays) of the rows of some kinds, in a fixed order."""
    found = [r for r in zip(table.column("kind").to_pylist(), table.column("source").to_pylist(), table.column("to").to_pylist(),
                            table.column("data").to_pylist()) if r[0] in kinds and r[3] is not None]
    for kind, source, to, data in sorted(found, key=lambda r: r[:3]):
        yield kind, source, to, _unpack(data)


class _Keys(dict):
    """Numbers of distinct words in the order they came, and their 64 bits."""

    def __init__(self):
        super().__init__()
        self.bits = array.array("Q")

    def __missing__(self, word: bytes) -> int:
        import xxhash

        number = self[word] = len(self)
        self.bits.append(xxhash.xxh64_intdigest(word))
        return number


def _cut(grid: tuple[int, int], scoring: bool):
    """Texts to packed rows: per cell the pairs; for scoring also their places, and one row of the texts themselves."""
    height, width = grid

    def flush(keys: _Keys, held: list, docs: list, number: int):
        """Empties what it is given, and lets go of long arrays as soon as it can: two of these may share an executor."""
        word, before, doc = (np.concatenate(x) for x in zip(*held))
        bits, n = np.array(keys.bits, dtype=np.uint64), len(keys)
        held.clear()
        keys.clear()
        row, column = (bits % np.uint64(height)).astype(np.int64), (bits % np.uint64(width)).astype(np.int64)
        rows, out = [], None
        if scoring:
            ids, missing, out, length = (np.concatenate(x) for x in zip(*docs))
            rows.append((-1 - number, DOCS, number, _pack(ids.view(np.uint64), missing, out, length), None))
        # (cell, word, word before) as one number.
        code = row[before]
        code *= width
        code += column[word]
        for part in (word, before):
            code *= n
            code += part
        del word, before, part
        if scoring:
            order = np.argsort(code, kind="stable")
            code, doc = code[order], doc[order]
            del order
        else:
            code.sort()
        starts, n_places = np.flatnonzero(np.r_[True, code[1:] != code[:-1]]), len(code)
        pair = code[starts]
        del code
        places = np.diff(np.r_[starts, n_places])
        learnt = np.add.reduceat((out == 0)[doc], starts, dtype=np.int64) if scoring else places
        pair, u = pair // n, (pair % n).astype(np.int32)
        cell, w = pair // n, (pair % n).astype(np.int32)
        del pair
        bounds = np.r_[np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]]), len(cell)]
        for lo, hi in zip(bounds, bounds[1:]):
            words, at_word = np.unique(w[lo:hi], return_inverse=True)
            contexts, at_context = np.unique(u[lo:hi], return_inverse=True)
            end = starts[hi] if hi < len(starts) else n_places
            more = [places[lo:hi], doc[starts[lo]:end]] if scoring else []
            rows.append((int(cell[lo]), PAIRS, number, _pack(bits[contexts], bits[words], at_context, at_word, learnt[lo:hi], *more), None))
            if len(rows) == 16:
                yield from _rows(rows).to_batches()
                rows = []
        if rows:
            yield from _rows(rows).to_batches()

    def run(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        keys, held, docs, n, n_docs = _Keys(), [], [], 0, 0
        for batch in slices(batches):
            lists = [tokens(t) for t in batch.column("text").to_pylist()]
            if not lists:
                continue
            sizes = np.array([len(x) for x in lists])
            ids = np.fromiter(map(keys.__getitem__, itertools.chain.from_iterable(lists)), dtype=np.int32, count=int(sizes.sum()))
            before = np.empty_like(ids)
            before[1:] = ids[:-1]
            before[np.cumsum(sizes) - sizes] = keys[b""]
            held.append((ids, before, np.repeat(np.arange(n_docs, n_docs + len(sizes), dtype=np.int32), sizes)))
            own = batch.column("doc_id")
            docs.append((own.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), own.is_null().to_numpy(zero_copy_only=False).astype(np.int64),
                         batch.column("held_out").to_numpy(zero_copy_only=False).astype(np.int64), sizes))
            n, n_docs = n + len(ids), n_docs + len(sizes)
            if n >= FLUSH_TOKENS or len(keys) >= FLUSH_WORDS:
                yield from flush(keys, held, docs, number)
                number += 1
                keys, held, docs, n, n_docs = _Keys(), [], [], 0, 0
        if n:
            yield from flush(keys, held, docs, number)

    return run


class _Cell:
    """The pairs of a cell: distinct contexts and words, and per pair its numbers among them, customers and places."""

    def __init__(self, table: pa.Table, places: bool):
        # No flush has 2^31 places.
        parts = [(source, [a if a.dtype == np.uint64 else a.astype(np.int32) for a in got]) for _, source, _, got in _each(table, PAIRS)]
        self.flushes = [source for source, _ in parts]

        def joined(k: int):
            return np.concatenate([got[k] for _, got in parts])

        def numbered(keys: int, at: int):
            distinct, number = np.unique(joined(keys), return_inverse=True)
            starts = np.cumsum([0] + [len(got[keys]) for _, got in parts])
            return distinct, np.concatenate([number[s + got[at]] for s, (_, got) in zip(starts, parts)])

        self.contexts, u = numbered(0, 2)
        self.words, w = numbered(1, 3)
        code, pair = np.unique(w * len(self.contexts) + u, return_inverse=True)
        self.u, self.w = code % len(self.contexts), code // len(self.contexts)
        self.count = np.bincount(pair, weights=joined(4), minlength=len(code)).astype(np.int64)  # exact below 2^53
        if places:
            n = joined(5)
            self.pair, self.doc = np.repeat(pair.astype(np.int32), n), joined(6)
            self.ends = np.cumsum([len(got[6]) for _, got in parts])


def _counted(key, table):
    """What a cell adds to its groups once and for all, and its pairs of two and more customers."""
    cell = key[0].as_py()
    own = _Cell(table, places=False)
    rows, ones, twos = [], own.count == 1, own.count == 2
    for kind, keys, at in ((FIXED_CONTEXT, own.contexts, own.u), (FIXED_WORD, own.words, own.w)):
        customers, single, double = (np.bincount(at, weights=x, minlength=len(keys)).astype(np.int64) for x in (own.count, ones, twos))
        rows.append((cell, kind, cell, _pack(keys, customers, single, double, np.bincount(at)), None))
    more = own.count > 1
    u, at_u = np.unique(own.u[more], return_inverse=True)
    w, at_w = np.unique(own.w[more], return_inverse=True)
    rows.append((cell, PAIRS, cell, _pack(own.contexts[u], own.words[w], at_u, at_w, own.count[more]), None))
    return _rows(rows)


def _gathered(key, table):
    """The fixed part of a group: per key its customers, pairs of one customer, and pairs; and their totals."""
    kind, to = key[0].as_py(), key[1].as_py()
    parts = [got for *_, got in _each(table, FIXED_CONTEXT, FIXED_WORD)]
    keys, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    customers, ones, twos, pairs = (np.bincount(at, weights=np.concatenate([p[k] for p in parts]), minlength=len(keys)).astype(np.int64)
                                    for k in (1, 2, 3, 4))
    sums = [customers.sum(), ones.sum(), twos.sum(), len(keys), (pairs == 1).sum(), (pairs == 2).sum()]
    return _rows([(to, kind, -1, _pack(keys, customers, ones), [float(x) for x in sums])])


def _summed(df: DataFrame, n: int) -> dict[int, list[float]]:
    """Sums of the totals by kind; a few numbers."""
    got = df.where("sums IS NOT NULL").groupBy("kind").agg(*[F.sum(F.col("sums")[k]).alias(f"x{k}") for k in range(n)]).collect()
    return {r["kind"]: [r[f"x{k}"] for k in range(n)] for r in got}


def _discount(n1: float, n2: float) -> float:
    return float(np.clip(n1 / (n1 + 2 * n2), 0.05, 0.95)) if n1 else 0.5


def _tables_by_group(cell: int, width: int, own: list[np.ndarray], tables: np.ndarray) -> list[tuple]:
    u, w, at_u, at_w, _ = own
    return [(cell // width, CONTEXT, cell, _pack(u, np.bincount(at_u, weights=tables, minlength=len(u)).astype(np.int64)), None),
            (cell % width, WORD, cell, _pack(w, np.bincount(at_w, weights=tables, minlength=len(w)).astype(np.int64)), None)]


def fit_and_score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sweeps: int = SWEEPS,
                  cell_bytes: int = CELL_BYTES) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of ``docs``.

    Learns from the rows that are not held out. Null and empty texts consist of the
    end alone; repeated rows are scored each. With nothing learnt every word is
    unknown and as likely as any.
    """
    spark = docs.sparkSession
    rows = texts(docs, id_col, text_col).select(F.col("doc_id").cast("long").alias("doc_id"), "text", held_out().alias("held_out"))
    size = rows.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    power = max(0, math.ceil(math.log2(max(1, size / cell_bytes))))
    height, width = grid = 2 ** (power // 2), 2 ** (power - power // 2)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * height * width)
    counted = stage(rows.where(~F.col("held_out")).mapInArrow(_cut(grid, False), _DDL).groupBy("to").applyInArrow(_counted, _DDL), ["kind"])
    free_shuffles(spark)
    side = F.when(F.col("kind") == FIXED_CONTEXT, F.expr(f"to div {width}")).otherwise(F.col("to") % width)
    keys = counted.where(F.col("kind").isin(FIXED_CONTEXT, FIXED_WORD)).withColumn("to", side)
    fixed = stage(keys.groupBy("kind", "to").applyInArrow(_gathered, _DDL))
    sums = _summed(fixed, 6)
    n_tokens, ones, twos, *_ = sums.get(FIXED_CONTEXT, [0.0] * 6)
    *_, n_words, root_ones, root_twos = sums.get(FIXED_WORD, [0.0] * 6)
    discount, root_discount, uniform = _discount(ones, twos), _discount(root_ones, root_twos), 1.0 / (n_words + 1)

    live = counted.where(F.col("kind") == PAIRS).repartition(parts, "to").persist()

    def start(batches):
        for batch in batches:
            for _, cell, _, own in _each(pa.Table.from_batches([batch]), PAIRS):
                yield from _rows(_tables_by_group(cell, width, own, np.ones(len(own[4])))).to_batches()

    def settle(pull: float, number: int):
        """Groups add up tables and seat the root's customers, then answer the cells."""
        def run(key, table):
            side, to = key[0].as_py(), key[1].as_py()
            (keys, _, total), = (got for *_, got in _each(table, FIXED_CONTEXT, FIXED_WORD))
            asked = [(cell, got) for _, cell, _, got in _each(table, CONTEXT, WORD)]
            spots = [np.searchsorted(keys, got[0]) for _, got in asked]
            for spot, (_, got) in zip(spots, asked):
                total[spot] += got[1]
            found = [total]
            if side == WORD:
                rng = np.random.default_rng([number, 1, to])
                found.append(seat(total, np.full(len(total), pull), root_discount, rng).astype(np.int64))
            rows = [(to, side, -1, _pack(*found), [float(found[0].sum()), float(found[-1].sum())])]
            rows += [(cell, side, to, _pack(*[f[spot] for f in found]), None) for spot, (cell, _) in zip(spots, asked)]
            return _rows(rows)

        return run

    def sweep(number: int, all_tables: float, pull: float):
        """Cells seat the customers of their pairs anew, with everyone's tables as the groups told them."""
        def run(key, pairs, told):
            got = list(_each(pairs, PAIRS))
            if not got:
                return _rows([])
            (_, cell, _, own), = got
            _, _, at_u, at_w, count = own
            answers = {kind: a for kind, _, _, a in _each(told, CONTEXT, WORD, SEATS)}
            tables, kept = answers.get(SEATS, [np.ones(len(count), dtype=np.int64), np.zeros(len(count), dtype=np.int64)])
            (total,), (root, root_tables) = answers[CONTEXT], answers[WORD]
            others = root[at_w] - tables
            parent = (np.maximum(others - root_discount * np.minimum(root_tables[at_w], others), 0) + pull) / (STRENGTH + all_tables)
            rng = np.random.default_rng([number, 0, cell])
            tables = seat(count, (STRENGTH + discount * total[at_u]) * parent, discount, rng).astype(np.int64)
            if number >= BURN_IN:
                kept = kept + tables
            return _rows([(cell, SEATS, cell, _pack(tables, kept), None), *_tables_by_group(cell, width, own, tables)])

        return run

    sides = F.when(F.col("kind").isin(CONTEXT, FIXED_CONTEXT), CONTEXT).otherwise(WORD)
    seats, history, root_total, after = live.mapInArrow(start, _DDL), [], n_words, []
    for number in range(sweeps + 1):
        pull = (STRENGTH + root_discount * root_total) * uniform
        meeting = fixed.withColumn("sums", F.lit(None).cast("array<double>")).unionByName(seats.where(F.col("kind").isin(CONTEXT, WORD)))
        told = stage(meeting.groupBy(sides.alias("side"), F.col("to")).applyInArrow(settle(pull, number), _DDL))
        sums = _summed(told, 2)
        all_tables, root_total = sums.get(CONTEXT, [0.0, 0.0])[0], sums.get(WORD, [0.0, 0.0])[1]
        if number > BURN_IN:
            # Kept with the sweep's number as source.
            after.append(told.where("source = -1").withColumn("source", F.lit(len(after)).cast("long")))
            history.append((all_tables, (STRENGTH + root_discount * root_total) * uniform))
        if number == sweeps:
            break
        answers = told.where("source >= 0")
        if number:
            answers = answers.unionByName(seats.where(F.col("kind") == SEATS))
        pull = (STRENGTH + root_discount * root_total) * uniform
        seats = stage(live.groupBy("to").cogroup(answers.groupBy("to")).applyInArrow(sweep(number, all_tables, pull), _DDL))

    n_kept = len(history)

    def answer(key, table):
        """To every cell, customers of its keys and their totals after each kept sweep."""
        (keys, customers, _), = (got for _, source, _, got in _each(table, FIXED_CONTEXT, FIXED_WORD) if source < 0)
        columns = [customers] + [a for *_, got in _each(table, SEATS) for a in got]
        rows = []
        for kind, cell, _, (asked, *_) in _each(table, FIXED_CONTEXT, FIXED_WORD):
            if cell >= 0:
                spot = np.searchsorted(keys, asked)
                rows.append((cell, CONTEXT if kind == FIXED_CONTEXT else WORD, 0, _pack(*[c[spot] for c in columns]), None))
        return _rows(rows)

    def scored(key, pairs, told):
        cell = key[0].as_py()
        if cell < 0:
            return pairs.select(_ROW.names).cast(_ROW)
        own = _Cell(pairs, places=True)
        got = {kind: a for kind, _, _, a in _each(told, CONTEXT, WORD)}

        def spread(kind: int, at: np.ndarray, n: int, columns: int) -> list[np.ndarray]:
            """Values of the learnt keys, zero for the others."""
            out = np.zeros((columns, n), dtype=np.int64)
            out[:, np.bincount(at, weights=own.count, minlength=n) > 0] = got.get(kind, 0)
            return list(out)

        customers, *totals = spread(CONTEXT, own.u, len(own.contexts), 1 + n_kept)
        count, *roots = spread(WORD, own.w, len(own.words), 1 + 2 * n_kept)
        p = own.count.astype(float) * n_kept
        seated = [a for *_, a in _each(told, SEATS)]
        p[own.count == 1] -= discount * n_kept
        if seated:
            p[own.count > 1] -= discount * seated[0][1]
        for k, (all_tables, pull) in enumerate(history):
            root = (roots[2 * k] - root_discount * roots[2 * k + 1] + pull) / (STRENGTH + all_tables)
            p += (STRENGTH + discount * totals[k])[own.u] * root[own.w]
        log = np.log10(p / (n_kept * (STRENGTH + customers[own.u])))
        base, known = np.log10((count + 0.1) / (n_tokens + 0.1 * (n_words + 1)))[own.w], (count > 0)[own.w]
        rows, lo = [], 0
        for flush, hi in zip(own.flushes, own.ends):
            pair = own.pair[lo:hi]
            doc, at = np.unique(own.doc[lo:hi], return_inverse=True)
            rows.append((-1 - flush, PAIRS, cell, _pack(doc, *[np.bincount(at, weights=x[pair]) for x in (log, base)],
                                                        np.bincount(at, weights=known[pair]).astype(np.int64)), None))
            lo = hi
        return _rows(rows)

    result = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
                        ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def finish(key, table):
        (ids, missing, out, length), = (got for *_, got in _each(table, DOCS))
        score, base, known = np.zeros((3, len(length)))
        for *_, (doc, a, b, c) in _each(table, PAIRS):
            score[doc] += a
            base[doc] += b
            known[doc] += c
        return pa.Table.from_arrays([pa.array(ids.view(np.int64), mask=missing > 0), pa.array(out > 0), pa.array(length), pa.array(known.astype(np.int64)),
                                     pa.array(np.full(len(length), int(n_tokens))), pa.array(base), pa.array(score)], schema=result)

    meeting = fixed.unionByName(keys).withColumn("side", sides)
    for state in after:
        meeting = meeting.unionByName(state.withColumn("side", F.col("kind")).withColumn("kind", F.lit(SEATS)))
    answers = stage(meeting.groupBy("side", "to").applyInArrow(answer, _DDL).unionByName(seats.where(F.col("kind") == SEATS)))
    live.unpersist()
    free_shuffles(spark)
    cells = rows.mapInArrow(_cut(grid, True), _DDL)
    by_flush = cells.groupBy("to").cogroup(answers.groupBy("to")).applyInArrow(scored, _DDL)
    return by_flush.groupBy("to").applyInArrow(
        finish, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
