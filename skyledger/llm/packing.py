"""Packing token sequences of fixed capacity by the sum-of-squares rule.

Every document ends with an end token. Documents over the capacity are cut into
full pieces and a rest. A piece goes where it makes the sum over gaps of the
squared number of open sequences with that gap smallest; a new sequence is one
of the choices.

The rule looks at one piece after another, so pieces are dealt by hash into
groups of about ``group_rows`` that tasks pack on their own, each in descending
length. Sequences that end a group with a gap of more than ``worth`` tokens are
opened again, and their pieces are packed once more over fewer groups, until
one group is left or no round would shrink them further.
"""

from __future__ import annotations

import array
import functools

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from skyledger.llm.common import LETTERS, MARKS, PartIds, PlainWords, slices, texts
from skyledger.session import stage

CAPACITY = 4096
END_ID = 1
GROUP_ROWS = 4_000
# Parts whose ids a Python worker keeps, about 250 bytes each; fewer make it encode rare words again and again.
PARTS_KEPT = 1_000_000
WORTH = 16


@functools.lru_cache(maxsize=4)
def _parts(path: str) -> PartIds:
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return PlainWords(tokenizer, f"[{LETTERS}{MARKS}0-9]+", f"[{LETTERS}]+|[0-9]|[{MARKS}]+", fold=True, limit=PARTS_KEPT).parts


def token_pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
                 capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids) of every document, ids packed as little-endian unsigned 32-bit integers.

    The tokenizer drops white space and splits at it, so a text's ids are those
    of its parts between spaces and line ends. A null or empty text is the end
    token alone; repeated rows give their pieces each; an empty table gives none.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()),
                        ("length", pa.int64()), ("ids", pa.binary())])
    end, step = array.array("I", [end_id]).tobytes(), 4 * capacity

    def run(batches):
        parts = _parts(path)
        for batch in slices(batches):
            rows = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = parts.join(text.replace("\n", " ").split(" ")) + end
                for k, at in enumerate(range(0, len(ids), step)):
                    piece = ids[at:at + step]
                    rows.append((doc, k, at // 4, len(piece) // 4, piece))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return texts(docs, id_col, text_col).mapInArrow(run, StructType.fromDDL(
        "doc_id long, piece int, start long, length long, ids binary"))


def sum_of_squares(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sequence, offset) of each piece in the given order, and the gap each sequence is left with."""
    open_by_gap: list[list[int]] = [[] for _ in range(capacity + 1)]
    count = np.zeros(capacity + 1, dtype=np.int64)
    sequence = np.empty(len(lengths), dtype=np.int64)
    offset = np.empty(len(lengths), dtype=np.int64)
    gaps: list[int] = []
    blocked = np.int64(2) ** 60
    for k, size in enumerate(lengths.tolist()):
        # Change of the sum when a sequence with gap g goes to gap g - size; gap 0 is closed and not counted.
        held = count[size:capacity]
        change = 2 * (count[:capacity - size] - held) + 2
        if len(change):
            change[0] -= 2 * count[0] + 1
            change[held == 0] = blocked
        fresh = 2 * count[capacity - size] + 1 if size < capacity else 0
        best = int(change.argmin()) if len(change) else -1
        if best >= 0 and change[best] < blocked and change[best] <= fresh:
            gap = size + best
            bin_ = open_by_gap[gap].pop()
            count[gap] -= 1
        else:
            gap, bin_ = capacity, len(gaps)
            gaps.append(capacity)
        sequence[k], offset[k] = bin_, capacity - gap
        gaps[bin_] = gap - size
        if gap > size:
            open_by_gap[gap - size].append(bin_)
            count[gap - size] += 1
    return sequence, offset, np.array(gaps, dtype=np.int64)


def _pack_groups(rows: DataFrame, groups: int, capacity: int, first: int) -> DataFrame:
    """Pack each hash group; adds sequence_id (unique from ``first`` on), offset and the sequence's gap."""
    plain = [c for c in rows.columns]
    schema = StructType.fromDDL(", ".join(f"`{c}` {t}" for c, t in rows.dtypes)
                                + ", sequence_id long, offset long, gap long")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "row_hash"], ascending=[False, True], kind="stable")
        sequence, offset, gaps = sum_of_squares(pdf["length"].to_numpy(), capacity)
        group = int(pdf["pack_group"].iloc[0])
        return pdf[plain].assign(sequence_id=first + group * 2 ** 32 + sequence, offset=offset, gap=gaps[sequence])

    dealt = rows.withColumn("pack_group", F.pmod(F.col("row_hash"), F.lit(groups)))
    # A range per group: no two groups share a task while others are idle.
    return dealt.repartitionByRange(groups, "pack_group").groupBy("pack_group").applyInPandas(run, schema)


def pack(pieces: DataFrame, capacity: int = CAPACITY, group_rows: int = GROUP_ROWS, worth: int = WORTH) -> DataFrame:
    """``pieces`` with sequence_id and offset; needs ``length`` from 1 to ``capacity``.

    Offsets in a sequence are gapless from 0 and sequences never exceed the
    capacity. Equal rows are packed as often as they come. An empty table gives
    an empty result. Pieces come from a scan (see ``session.stage``), whose row
    number deals equal rows over all groups.
    """
    names = pieces.columns
    rows = stage(pieces.withColumn("row_hash", F.xxhash64(F.monotonically_increasing_id(), F.lit(7))))
    groups, first, closed = max(1, -(-rows.count() // group_rows)), 0, None
    while True:
        packed = stage(_pack_groups(rows, groups, capacity, first))
        rest = packed.where(F.col("gap") > worth).select(*names, "row_hash")
        first += groups * 2 ** 32
        fewer = -(-rest.count() // group_rows)
        last = fewer == 0 or fewer >= groups
        final = (packed if last else packed.where(F.col("gap") <= worth)).select(*names, "sequence_id", "offset")
        closed = final if closed is None else closed.unionByName(final)
        if last:
            return closed
        rows, groups = rest, fewer
