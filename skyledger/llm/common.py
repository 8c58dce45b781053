"""What the text operators share: reading documents, batches of text, tokens kept by part."""

from __future__ import annotations

import array
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

# Rows that a Python task holds as strings at a time.
ROWS_AT_A_TIME = 512


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id and the whole text as (doc_id, text); a null text counts as empty.

    Other columns are left behind, so none of theirs can clash with a result's.
    """
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def slices(batches: Iterator[pa.RecordBatch], rows: int = ROWS_AT_A_TIME) -> Iterator[pa.RecordBatch]:
    """The batches in shorter slices, so that strings of one slice are held at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def map_texts(df: DataFrame, schema: str, make: Callable[[], Callable[[list, list], list]], carry=()) -> DataFrame:
    """Apply a function of (ids, texts) batch by batch.

    ``make`` runs once per task and returns that function, which gives one list
    per column after ``doc_id``, in the order of ``schema``.
    """
    from pyspark.sql.types import StructType

    types = StructType.fromDDL(schema)
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(types)

    def run(batches):
        work = make()
        for part in slices(batches):
            ids = part.column("doc_id")
            columns = work(ids.to_pylist(), part.column("text").to_pylist())
            arrays = [ids.cast(arrow.field(0).type)]
            arrays += [pa.array(c, type=arrow.field(i + 1).type) for i, c in enumerate(columns)]
            yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    return df.mapInArrow(run, types)


class PartIds(dict):
    """What a text part is worth: ids as packed little-endian unsigned 32-bit integers, or a count.

    The caller cuts texts where the tokenizer surely cuts too, so ids of a text
    are the ids of its parts in a row. Short parts are kept for the next texts
    up to ``limit`` entries; then the store starts afresh. Results do not depend
    on what is kept.
    """

    def __init__(self, encode: Callable[[str], bytes], limit: int = 400_000, longest: int = 40):
        super().__init__()
        self.encode, self.limit, self.longest = encode, limit, longest

    def __missing__(self, part: str) -> bytes:
        ids = self.encode(part)
        if len(part) <= self.longest:
            if len(self) >= self.limit:
                self.clear()
            self[part] = ids
        return ids

    def join(self, parts: list[str]) -> bytes:
        return b"".join(map(self.__getitem__, parts))


# Letters of which every tokenizer rule here is known: ASCII and Latin-1 letters, each one code point.
LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
# Marks and digits of ASCII without the apostrophe, which starts contractions.
MARKS = r"!-&(-/:-@\[-`{-~"


def byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


class PlainWords:
    """Ids of parts whose pre-tokens a simple pattern finds, straight from the BPE model.

    ``plain`` must match a whole part for that, ``pre_token`` then finds its
    pre-tokens; any other part goes through the whole tokenizer.
    """

    def __init__(self, tokenizer, plain: str, pre_token: str, fold: bool, limit: int = 400_000):
        import re

        self.tokenizer, self.model, self.fold = tokenizer, tokenizer.model, fold
        self.plain, self.pre_token = re.compile(plain), re.compile(pre_token)
        letters = byte_letters()
        self.stand_ins = {c: "".join(letters[b] for b in chr(c).encode()) for c in range(256)}
        special = [re.escape(t.content) for t in tokenizer.get_added_tokens_decoder().values()]
        # Without special tokens a pattern that matches nowhere.
        self.special = re.compile("|".join(special) or "(?!)")
        self.parts = PartIds(self.encode, limit)

    def whole(self, part: str) -> bytes:
        return array.array("I", self.tokenizer.encode(part, add_special_tokens=False).ids).tobytes()

    def encode(self, part: str) -> bytes:
        if not self.plain.fullmatch(part) or self.special.search(part):
            return self.whole(part)
        if self.fold and (low := part.lower()) != part:
            return self.parts[low] if not self.special.search(low) else self.whole(part)
        found = self.pre_token.findall(part)
        if len(found) != 1:
            return self.parts.join(found)
        return array.array("I", [t.id for t in self.model.tokenize(part.translate(self.stand_ins))]).tobytes()
