"""Byte-level BPE encoding and decoding of whole texts, long ones by tree concatenation.

A text of more than ``leaf_chars`` code points is cut into leaves that tasks
encode in parallel. Neighbours are then joined pairwise up a tree: a window
around the join is encoded again and grows until its first token is the left
side's and its last token the right side's at the same places.

Why that is exact: a byte-level BPE sequence is the encoding of its text if and
only if every pair of neighbouring tokens is the encoding of the pair's text.
Pairs left of the window come from the left side, pairs right of it from the
right side, pairs inside from the window, and the two agreeing tokens tie them
together. Leaves and windows start and end only where the pre-tokenizer's cuts
do not depend on what lies beyond: away from apostrophes (contractions) and
never inside a special token.
"""

from __future__ import annotations

import functools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from skyledger.llm.common import LETTERS, MARKS, PlainWords, byte_letters, map_texts, slices, texts

LEAF_CHARS = 16_384
FIRST_WINDOW = 64
# One space between two non-spaces: the pre-tokenizer always cuts before it.
_CUT = re.compile(r"(?<=\S)(?= \S)")
_SPACES = re.compile(r" \s|\s ")
_PART = re.compile(r" ?[^ ]+")


# Words, numbers or marks, with the space before them, and single line ends between those.
_PLAIN = f" ?[{LETTERS}{MARKS}0-9]+(?:\n[{LETTERS}{MARKS}0-9]+)*"
_PRE_TOKEN = f" ?[{LETTERS}]+| ?[0-9]+| ?[{MARKS}]+|\n"


class ByteBpe:
    """A byte-level tokenizer file with its exact joins."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        letters = {stand_in: byte for byte, stand_in in byte_letters().items()}
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.pieces = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.pieces[i] = token.encode() if token in self.special else bytes(letters[c] for c in token)
        self.lengths = np.array([len(p) for p in self.pieces], dtype=np.int64)
        self.parts = PlainWords(self.tokenizer, _PLAIN, _PRE_TOKEN, fold=False).parts

    def encode(self, text: str) -> bytes:
        """Ids of a text of any shape, part by part."""
        if not text:
            return b""
        if text[-1] != " " and not _SPACES.search(text):
            return self.parts.join(_PART.findall(text))
        return self.parts.join(_CUT.split(text))

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.pieces.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")

    def leaves(self, text: str, size: int) -> list[str]:
        """Cut a text after about ``size`` code points each, at allowed places only."""
        cuts, at = [0], size
        while at < len(text):
            if self._allowed(text, at):
                cuts.append(at)
                at += size
            else:
                at += 1
        return [text[a:b] for a, b in zip(cuts, [*cuts[1:], len(text)])]

    def _allowed(self, text: str, at: int) -> bool:
        if "'" in text[max(0, at - 3):at + 3]:
            return False
        return not any(s in text[max(0, at - len(s) + 1):at + len(s) - 1] for s in self.special)

    def concat(self, left: tuple[bytes, np.ndarray], right: tuple[bytes, np.ndarray]) -> tuple[bytes, np.ndarray]:
        """Join two encoded neighbours, given as (UTF-8 bytes, ids)."""
        (lb, lids), (rb, rids) = left, right
        if not lb or not rb:
            return (lb + rb, np.concatenate([lids, rids]))
        lstart = np.cumsum(self.lengths[lids]) - self.lengths[lids]
        rend = np.cumsum(self.lengths[rids])
        window = FIRST_WINDOW
        while True:
            i = self._left_edge(lb, lstart, len(lb) - window)
            j = self._right_edge(rb, rend, window)
            a = int(lstart[i]) if i else 0
            b = int(rend[j]) if j < len(rids) else len(rb)
            middle = np.frombuffer(self.encode((lb[a:] + rb[:b]).decode()), "<u4")
            agree_left = i == 0 or middle[0] == lids[i]
            agree_right = j >= len(rids) or middle[-1] == rids[j]
            if agree_left and agree_right:
                return lb + rb, np.concatenate([lids[:i], middle, rids[j + 1:]])
            window *= 2

    @staticmethod
    def _left_edge(text: bytes, starts: np.ndarray, at: int) -> int:
        """Index of the last token that starts at or before ``at`` in an allowed place; 0: the beginning."""
        i = int(np.searchsorted(starts, at, "right")) - 1
        while i > 0:
            p = int(starts[i])
            if text[p] & 0xC0 != 0x80 and b"'" not in text[max(0, p - 3):p + 3]:
                return i
            i -= 1
        return 0

    @staticmethod
    def _right_edge(text: bytes, ends: np.ndarray, at: int) -> int:
        """Index of the first token that ends at or after ``at`` in an allowed place; all: the end."""
        j = int(np.searchsorted(ends, at, "left"))
        while j < len(ends):
            p = int(ends[j])
            if p >= len(text):
                return len(ends)
            whole = text[p] & 0xC0 != 0x80
            if whole and b"'" not in text[max(0, p - 3):p + 3] and not text[max(0, p - 4):p].decode("utf-8", "ignore")[-1:].isspace():
                return j
            j += 1
        return len(ends)

    def tree(self, parts: list[tuple[bytes, np.ndarray]]) -> np.ndarray:
        """Join all parts, neighbours with neighbours, level by level."""
        while len(parts) > 1:
            parts = [self.concat(*parts[k:k + 2]) if k + 1 < len(parts) else parts[k]
                     for k in range(0, len(parts), 2)]
        return parts[0][1] if parts else np.empty(0, "<u4")


@functools.lru_cache(maxsize=4)
def load(path: str) -> ByteBpe:
    return ByteBpe(path)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
           leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """(doc_id, ids) per row of ``docs``; ids are packed little-endian unsigned 32-bit integers.

    A null or empty text has no ids. Repeated rows give a result each. An empty
    table gives none. Special tokens written out in a text become their ids, as
    the tokenizer does by itself.
    """
    rows = texts(docs, id_col, text_col)
    short = map_texts(rows.where(F.length("text") <= leaf_chars), "doc_id long, ids binary",
                      lambda: (lambda ids, ts, bpe=load(path): [[bpe.encode(t) for t in ts]]))
    # The scan's row number keeps repeated rows apart.
    long = rows.where(F.length("text") > leaf_chars).withColumn("row", F.monotonically_increasing_id())
    leaf_type = "row long, doc_id long, leaf int, text string"

    def cut(batches):
        bpe = load(path)
        for batch in slices(batches, 16):
            for r in batch.to_pylist():
                for k, leaf in enumerate(bpe.leaves(r["text"], leaf_chars)):
                    yield pa.RecordBatch.from_pylist(
                        [{"row": r["row"], "doc_id": r["doc_id"], "leaf": k, "text": leaf}],
                        schema=pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("leaf", pa.int32()),
                                          ("text", pa.string())]))

    def encode_leaves(batches):
        bpe = load(path)
        for batch in slices(batches, 64):
            ids = pa.array([bpe.encode(t) for t in batch.column("text").to_pylist()], pa.binary())
            yield batch.append_column("ids", ids)

    def join(table: pa.Table) -> pa.Table:
        bpe = load(path)
        leaves = sorted(table.select(["leaf", "text", "ids"]).to_pylist(), key=lambda r: r["leaf"])
        ids = bpe.tree([(r["text"].encode(), np.frombuffer(r["ids"], "<u4")) for r in leaves])
        return pa.table({"doc_id": table.column("doc_id").slice(0, 1), "ids": pa.array([ids.astype("<u4").tobytes()], pa.binary())})

    leaves = long.mapInArrow(cut, StructType.fromDDL(leaf_type)).repartition("row", "leaf")
    encoded = leaves.mapInArrow(encode_leaves, StructType.fromDDL(leaf_type + ", ids binary"))
    joined = encoded.groupBy("row").applyInArrow(join, "doc_id long, ids binary")
    return short.unionByName(joined)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``encoded`` (doc_id, ids) with the decoded ``text``; special tokens are kept as their strings.

    Null ids decode to the empty text.
    """
    def run(batches):
        bpe = load(path)
        for batch in slices(batches):
            got = [bpe.decode(x or b"") for x in batch.column("ids").to_pylist()]
            yield batch.append_column("text", pa.array(got, pa.string()))

    rows = encoded.select("doc_id", "ids")
    return rows.mapInArrow(run, StructType.fromDDL("doc_id long, ids binary, text string"))


def unpack(ids: str = "ids"):
    """Column of ids as an array of integers, for callers that want elements rather than bytes."""
    digits = F.hex(F.col(ids))
    return F.transform(F.sequence(F.lit(0), (F.length(digits) / 8).cast("int") - 1),
                       lambda k: F.conv(F.concat(*[F.substring(digits, k * 8 + p, 2) for p in (7, 5, 3, 1)]), 16, 10).cast("long"))
