"""One document of each group of near copies: SimHash candidates, confirmed by their shingles.

Texts are compared as words, ASCII capitals made small. Equal texts are one node.
Candidates come from fingerprints over words, each word counted once for every
doubling of its number: a few changed words move few bits, and frequent words do
not make all texts of a language alike. The covering masks of ``simhash`` bring every
pair of fingerprints within the radius into some bucket; there each fingerprint
names its nearest earlier ones, so a group gives a few links for each member and
never all its pairs. Where a fingerprint has more partners than it names, or stands for more
texts than speak for it, its texts take part in a second round: there all that share
one of their smallest shingle hashes are compared as they are, unless they are in one
component by then, and a task gives out no more links than join its components. A candidate is a link only if the two texts share enough of
their five-word shingles, counted in full (as 64-bit hashes), so texts that merely
look alike stay; a sketch of each text rules out most of those beforehand.

Null and empty texts are one group. A component keeps its smallest id, of equal
ids with the same text the smallest row (by its columns that have an order); a
null id stands behind all others. Other columns pass through under any name. An
empty table gives an empty one.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import MapType, StructType, VariantType

from skyledger.llm.common import slices, texts
from skyledger.llm.simhash import BUCKET_ROWS, SEED, _half_way_links, components
from skyledger.session import stage

RADIUS = 6
SHINGLE = 5
SIMILARITY = 0.8
# Earlier fingerprints that one names in a bucket, and links of one text that are confirmed together.
NEAREST = 2
TOGETHER = 256
# Fingerprints of a bucket that one task compares with as many others when all pairs are asked for.
TILE_ROWS = 16_384
# Smallest shingle hashes that a text's sketch keeps, and how far below the similarity an estimate may lie for the texts to
# be compared: six standard deviations.
SKETCH, MARGIN = 64, 0.3
# Smallest shingle hashes under which texts meet in the second round: two texts at the similarity share none of them with odds
# of 0.2 ** LOW, those of the margin. Texts of one hash that a task compares with as many others.
LOW = 13
TILE_TEXTS = 1024
_LAST = 2 ** 63 - 1


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def text_key(words: list[bytes]) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(b" ".join(words), SEED)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Words:
    """The words of a text as 64-bit hashes, each distinct word hashed once."""

    def __init__(self, words: list[bytes]):
        import xxhash

        number: dict[bytes, int] = {}
        self.at = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
        self.hashes = np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in number), np.uint64, len(number))

    def fingerprint(self) -> int:
        """The 64 bits, as a signed long, that most words' hashes have, a word counted once per doubling; 0 without words."""
        if not len(self.at):
            return 0
        times = np.frexp(np.bincount(self.at).astype(float))[1].astype(np.int64)  # binary digits of the count
        ones = np.zeros(64, np.int64)
        for at in range(0, len(self.hashes), 4096):
            block = np.ascontiguousarray(self.hashes[at:at + 4096], dtype="<u8").view(np.uint8).reshape(-1, 8)
            ones += times[at:at + 4096] @ np.unpackbits(block, axis=1, bitorder="little").astype(np.int64)
        return int(np.packbits(2 * ones > times.sum(), bitorder="little").view("<i8")[0])

    def shingles(self, length: int = SHINGLE) -> np.ndarray:
        """Hashes of the distinct shingles, sorted; a text shorter than one is a single shingle, also without words."""
        x = self.hashes[self.at]
        n = max(1, len(x) - length + 1)
        h = np.full(n, len(x) if len(x) < length else length, np.uint64)
        for j in range(min(length, len(x))):
            h = _mixed(h * np.uint64(0x9E3779B97F4A7C15) + x[j:j + n])
        return np.unique(h)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Shared of all shingles of two texts."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def estimated(a: np.ndarray, b: np.ndarray) -> float:
    """The similarity as the smallest shingle hashes of both texts show it; exact for short texts."""
    whole = max(len(a), len(b)) < SKETCH
    smallest = np.union1d(a, b)[:None if whole else SKETCH]
    return len(np.intersect1d(np.intersect1d(a, b, assume_unique=True), smallest, assume_unique=True)) / len(smallest)


def _near_links(radius: int, bucket_rows: int, members: bool = False):
    """Links from each fingerprint to its nearest earlier ones of a bucket, from a stream sorted by key.

    The fingerprints of a bucket with more than ``bucket_rows`` come out alone. With ``members``
    all fingerprints of a bucket in which some have further partners come out too, as (null, b).
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def of(fp: np.ndarray) -> list[tuple[int | None, int]]:
        bits, out, more = fp.view(np.uint64), [], False
        for i in range(1, len(fp)):
            far = np.bitwise_count(bits[:i] ^ bits[i])
            near = np.flatnonzero(far <= radius)
            if len(near) > NEAREST:
                near, more = near[np.argsort(far[near], kind="stable")[:NEAREST]], True
            out += [(int(fp[i]), int(fp[j])) for j in near]
        return out + [(None, f) for f in fp.tolist()] if members and more else out

    def alone(fp: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(fp), pa.nulls(len(fp), pa.int64())], schema=schema)

    def run(batches):
        key, fp, crowded = np.empty(0, np.int64), np.empty(0, np.int64), None
        for batch in batches:
            key = np.concatenate([key, batch.column("key").to_numpy()])
            fp = np.concatenate([fp, batch.column("fp").to_numpy()])
            if crowded is not None:
                upto = int(np.searchsorted(key != crowded, True))
                yield alone(fp[:upto])
                key, fp = key[upto:], fp[upto:]
            if not len(key):
                continue
            crowded = None
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            ends = np.r_[starts[1:], len(key)]
            pairs = []
            for k in np.flatnonzero(ends - starts > 1).tolist():
                if k < len(starts) - 1:
                    pairs += of(fp[starts[k]:ends[k]]) if ends[k] - starts[k] <= bucket_rows else []
            for k in np.flatnonzero(ends - starts > bucket_rows).tolist():
                yield alone(fp[starts[k]:ends[k]])
                if k == len(starts) - 1:
                    crowded = key[-1]
            if pairs:
                yield _pairs(schema, pairs)
            last = len(key) if crowded is not None else starts[-1]
            key, fp = key[last:], fp[last:]
        pairs = of(fp) if len(fp) > 1 else []
        if pairs:
            yield _pairs(schema, pairs)

    return run


def _pairs(schema: pa.Schema, pairs: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*pairs)], schema=schema)


def spread_masks(radius: int, bits: int = 64) -> list[int]:
    """Covering masks as ``simhash.masks`` has them, with the vectors dealt out so that each mask keeps many bits.

    Any non-zero vectors cover; taken in a row, the last ones of a large radius are
    missing, and a mask that sees only those keeps a single bit.
    """
    kinds = 2 ** (radius + 1) - 1

    def made(step: int) -> list[int]:
        vectors = [i * step % kinds + 1 for i in range(bits)]
        return [sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() % 2) for v in range(1, kinds + 1)]

    best = max((made(step) for step in range(1, kinds)), key=lambda found: min(m.bit_count() for m in found))
    return [m - 2 ** 64 if m >= 2 ** 63 else m for m in best]


def _buckets(radius: int):
    # A bucket is one number; two that should share it by chance are told apart by their distance.
    return F.array(*[F.xxhash64(F.lit(t), F.col("fp").bitwiseAND(F.lit(m))) for t, m in enumerate(spread_masks(radius))])


def candidates(fps: DataFrame, radius: int = RADIUS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Pairs (a, b) of distinct ``fp`` within the radius: a few for each, from every bucket that it is in."""
    return _first_candidates(fps, radius, bucket_rows)[0]


def _first_candidates(fps: DataFrame, radius: int, bucket_rows: int) -> tuple[DataFrame, DataFrame]:
    """``candidates``, and as (fp) all fingerprints of the buckets in which partners were left out."""
    dealt = fps.select(F.explode(_buckets(radius)).alias("key"), "fp").repartition("key").sortWithinPartitions("key", "fp")
    found = stage(dealt.mapInArrow(_near_links(radius, bucket_rows, True), StructType.fromDDL("a long, b long")).distinct())
    crowded = found.where("b IS NULL").select(F.col("a").alias("fp"))
    pairs = found.where("a IS NOT NULL AND b IS NOT NULL").unionByName(_half_way_links(crowded, radius)).distinct()
    return pairs, stage(found.where("a IS NULL").select(F.col("b").alias("fp")).unionByName(crowded).distinct())


def other_candidates(fps: DataFrame, radius: int = RADIUS, tile_rows: int = TILE_ROWS) -> DataFrame:
    """All pairs (a, b) of distinct ``fp`` within the radius whose ``part`` differs or is null; each once.

    A bucket of more than ``tile_rows`` is cut into blocks, and a task compares two of
    them, so memory is bounded and a large bucket spreads over many tasks.
    """
    placed = fps.select("fp", "part", F.posexplode(_buckets(radius)).alias("mask", "key"))
    sizes = fps.select(F.explode(_buckets(radius)).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / tile_rows)
    cut = placed.join(sizes, "key").withColumns({"blocks": blocks, "block": F.pmod(F.xxhash64("fp", F.lit(3)), blocks)})
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    tiled = cut.select("key", "mask", "fp", "part", "block", other.alias("other")).select(
        "key", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "mask", "block", "fp", "part")
    keys = ["key", "lo", "hi"]
    return tiled.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_tile_pairs(radius), StructType.fromDDL("a long, b long"))


def _tile_pairs(radius: int):
    """The pairs of each (key, lo, hi) of a stream sorted by them; a pair only under the first mask that brings it together."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    names = ["key", "lo", "hi", "mask", "block", "fp", "part", "loose"]
    masks = np.array(spread_masks(radius), dtype=np.int64)

    def of(tile: dict[str, np.ndarray]):
        fp, block, mask = tile["fp"], tile["block"], int(tile["mask"][0])
        across = tile["lo"][0] != tile["hi"][0]
        for i in range(1, len(fp)):
            apart = fp[:i] ^ fp[i]
            near = np.bitwise_count(apart.view(np.uint64)) <= radius
            near &= (apart != 0) & (tile["loose"][:i] | tile["loose"][i] | (tile["part"][:i] != tile["part"][i]))
            if across:
                near &= block[:i] != block[i]
            at = np.flatnonzero(near)
            if len(at):
                together = (apart[at, None] & masks[:mask + 1]) == 0
                at = at[together[:, mask] & ~together[:, :mask].any(axis=1)]
                yield fp[at], np.full(len(at), fp[i])

    def run(batches):
        held, out, n = None, [], 0
        for batch in batches:
            new = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in names[:6]}
            part = batch.column("part")
            new["part"], new["loose"] = part.fill_null(0).to_numpy(), part.is_null().to_numpy(zero_copy_only=False)
            held = new if held is None else {c: np.concatenate([held[c], new[c]]) for c in names}
            ends = np.flatnonzero(np.any([held[c][1:] != held[c][:-1] for c in names[:3]], axis=0)) + 1
            for a, b in zip(np.r_[0, ends[:-1]], ends) if len(ends) else ():
                for pair in of({c: v[a:b] for c, v in held.items()}):
                    out.append(pair)
                    n += len(pair[0])
                    if n >= 65_536:
                        yield _joined(schema, out)
                        out, n = [], 0
            held = {c: v[ends[-1]:] for c, v in held.items()} if len(ends) else held
        if held is not None and len(held["fp"]):
            for pair in of(held):
                out.append(pair)
                n += len(pair[0])
                if n >= 65_536:
                    yield _joined(schema, out)
                    out, n = [], 0
        if out:
            yield _joined(schema, out)

    return run


def _joined(schema: pa.Schema, parts: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts)], schema=schema)


def likely(pairs: DataFrame, sketches: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) that their sketches do not rule out by a wide margin; ``sketches`` has (key, sketch)."""
    def run(batches):
        for batch in batches:
            keep = [estimated(np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")) >= least - MARGIN
                    for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist())]
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    both = pairs.join(sketches.select(F.col("key").alias("a"), F.col("sketch").alias("x")), "a").join(
        sketches.select(F.col("key").alias("b"), F.col("sketch").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(run, "a binary, b binary")


def confirmed(pairs: DataFrame, bodies: DataFrame, shingle: int, least: float) -> DataFrame:
    """The pairs (a, b) of text keys whose texts are similar enough; ``bodies`` has (key, text)."""
    # Many pairs may name the same b: they are dealt out, and its text is listed once for each part.
    parts = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / TOGETHER).alias("parts"))
    dealt = pairs.join(parts, "b").withColumn("part", F.pmod(F.xxhash64("a"), F.col("parts"))).drop("parts")
    second = parts.join(bodies.withColumnRenamed("key", "b").hint("merge"), "b").select(
        "b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.col("text").alias("other"))
    # Texts are far larger than their compressed files tell, so they are never broadcast.
    both = dealt.join(bodies.withColumnRenamed("key", "a").hint("merge"), "a").join(second.hint("merge"), ["b", "part"])

    def run(batches):
        for batch in batches:
            for rows in slices([batch], 64):
                keep = [similarity(Words(words_of(x)).shingles(shingle), Words(words_of(y)).shingles(shingle)) >= least
                        for x, y in zip(rows.column("text").to_pylist(), rows.column("other").to_pylist())]
                yield rows.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "text", "other").mapInArrow(run, "a binary, b binary")


def joining_links(members: DataFrame, bodies: DataFrame, radius: int, shingle: int, least: float, tile_texts: int = TILE_TEXTS) -> DataFrame:
    """Links (a, b) of similar texts within the radius that join different parts; ``members`` has (key, fp, part), ``bodies`` (key, text).

    Each pair is compared under the smallest hash that it shares, and not at all once links
    of the same task have joined its parts. A hash whose texts are all in one part is left out,
    one of more than ``tile_texts`` texts is cut into blocks, and a task compares two of them.
    """
    def shingles(batches):
        for batch in slices(batches, 64):
            found = [Words(words_of(t)).shingles(shingle) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("key"), pa.array([x.astype("<u8").tobytes() for x in found], pa.binary()),
                 pa.array([x[:LOW].view(np.int64) for x in found], pa.list_(pa.int64()))], names=["key", "shingles", "low"])

    cut = stage(bodies.mapInArrow(shingles, "key binary, shingles binary, low array<long>"))
    met = cut.select("key", F.explode("low").alias("slot")).join(members, "key")
    sizes = met.groupBy("slot").agg(F.count(F.lit(1)).alias("n"), F.min("part").alias("first"), F.max("part").alias("last"))
    blocks = F.ceil(F.col("n") / tile_texts)
    placed = met.join(sizes.where("first <> last").select("slot", blocks.alias("blocks")), "slot").withColumn(
        "block", F.pmod(F.xxhash64("key", F.lit(5)), F.col("blocks")))
    tiled = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).select(
        "slot", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "fp", "part", "key")
    # Shingles are far larger than their files tell next to the rows they meet.
    whole = tiled.join(cut.select("key", "shingles").hint("merge"), "key")
    keys = ["slot", "lo", "hi"]
    return whole.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(
        _tile_links(radius, least), "a binary, b binary").distinct()


def _tile_links(radius: int, least: float):
    """Links that join the parts of each (slot, lo, hi) of a stream sorted by them."""
    names = ["slot", "lo", "hi", "block", "fp", "part"]
    schema = pa.schema([("a", pa.binary()), ("b", pa.binary())])

    def of(tile: dict[str, np.ndarray], texts_: list, keys: list):
        slot, across = tile["slot"][:1].view(np.uint64)[0], tile["lo"][0] != tile["hi"][0]
        fp, block, part = tile["fp"].view(np.uint64), tile["block"], tile["part"].copy()
        sets = [np.frombuffer(x, "<u8") for x in texts_]
        size = np.array([len(x) for x in sets])
        low = np.zeros((len(sets), LOW), np.uint64)
        for k, x in enumerate(sets):
            low[k, :min(LOW, len(x))] = x[:LOW]
            low[k, len(x):] = x[-1]
        for i in range(1, len(sets)):
            near = (part[:i] != part[i]) & (np.bitwise_count(fp[:i] ^ fp[i]) <= radius)
            near &= np.minimum(size[:i], size[i]) >= least * np.maximum(size[:i], size[i])
            if across:
                near &= block[:i] != block[i]
            at = np.flatnonzero(near)
            if not len(at):
                continue
            at = at[~np.isin(low[at], low[i][low[i] < slot]).any(axis=1)]
            for j in at.tolist():
                if part[j] != part[i] and similarity(sets[i], sets[j]) >= least:
                    yield keys[j], keys[i]
                    part[part == part[j]] = part[i]

    def run(batches):
        held, texts_, keys = None, [], []
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                new = {c: batch.column(c).to_numpy() for c in names}
                held = new if held is None else {c: np.concatenate([held[c], new[c]]) for c in names}
                texts_ += batch.column("shingles").to_pylist()
                keys += batch.column("key").to_pylist()
            if held is None or not len(keys):
                continue
            ends = np.flatnonzero(np.any([held[c][1:] != held[c][:-1] for c in names[:3]], axis=0)) + 1
            ends = ends.tolist() if batch is not None else [*ends.tolist(), len(keys)]
            out = [link for a, b in zip([0, *ends], ends) for link in of({c: v[a:b] for c, v in held.items()}, texts_[a:b], keys[a:b])]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*out)], schema=schema)
            if ends:
                held, texts_, keys = {c: v[ends[-1]:] for c, v in held.items()}, texts_[ends[-1]:], keys[ends[-1]:]

    return run


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, shingle: int = SHINGLE,
             least: float = SIMILARITY) -> DataFrame:
    """One row of each group of equal or near copies, with all its columns as they were."""
    names = docs.columns
    key = "key"
    while key.lower() in {c.lower() for c in names}:
        key = f"_{key}"
    schema = StructType.fromJson(docs.schema.jsonValue()).add(key, "binary")

    def with_key(batches):
        for batch in slices(batches):
            keys = [text_key(words_of(t)) for t in batch.column(text_col).to_pylist()]
            yield batch.append_column(key, pa.array(keys, pa.binary()))

    def marks(batches):
        for batch in slices(batches, 64):
            keys, fps, sketches = [], [], []
            for text in batch.column("text").to_pylist():
                words = words_of(text)
                held = Words(words)
                keys.append(text_key(words))
                fps.append(held.fingerprint())
                sketches.append(held.shingles(shingle)[:SKETCH].astype("<u8").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(keys, pa.binary()), pa.array(fps, pa.int64()),
                                              pa.array(sketches, pa.binary())], names=["doc_id", "key", "fp", "sketch"])

    own_id = F.coalesce(F.col(id_col).cast("long"), F.lit(_LAST))
    marked = texts(docs.withColumn(id_col, own_id), id_col, text_col).mapInArrow(marks, "doc_id long, key binary, fp long, sketch binary")
    # Equal texts of one id, then of all: copies collapse on the map side both times.
    copies = marked.groupBy("key", "doc_id").agg(F.count(F.lit(1)).alias("n"), F.first("fp").alias("fp"), F.first("sketch").alias("sketch"))
    nodes = stage(copies.groupBy("key").agg(F.min(F.struct("doc_id", "n")).alias("low"), F.first("fp").alias("fp"), F.first("sketch").alias("sketch"))
                  .select("key", "low.doc_id", "low.n", "fp", "sketch"))
    # Different texts may have one fingerprint, so a few of them stand for it.
    stand_ins = [F.min("key"), F.max("key"), *[F.min_by("key", F.xxhash64("key", F.lit(i))) for i in range(2)]]
    reps = F.array_distinct(F.array(*stand_ins))
    fps = stage(nodes.groupBy("fp").agg(reps.alias("reps"), (F.count(F.lit(1)) > F.size(reps)).alias("many")))
    near, skipped = _first_candidates(fps.select("fp"), radius, BUCKET_ROWS)
    near = stage(near.join(fps.select(F.col("fp").alias("a"), F.col("reps").alias("x"), F.col("many").alias("p")), "a").join(
        fps.select(F.col("fp").alias("b"), F.col("reps").alias("y"), F.col("many").alias("q")), "b"))
    named = near.select(F.explode("x").alias("a"), "y").select("a", F.explode("y").alias("b"))
    alike = nodes.join(fps, "fp").select(F.col("key").alias("a"), F.explode("reps").alias("b")).where("a <> b")
    keyed = docs.select(F.col(text_col).alias("text")).mapInArrow(_keyed, "text string, key binary")
    # A node is its smallest id and its text, so a component's smallest node is the one that stays.
    node = nodes.select("key", F.struct("doc_id", "key").alias("node"))

    def bodies(wanted: DataFrame) -> DataFrame:
        return keyed.join(wanted, "key", "left_semi").groupBy("key").agg(F.first("text").alias("text"))

    def edges(links: DataFrame) -> DataFrame:
        return links.join(node.select(F.col("key").alias("a"), F.col("node").alias("u")), "a").join(
            node.select(F.col("key").alias("b"), F.col("node").alias("v")), "b").select(F.col("u").alias("a"), F.col("v").alias("b"))

    pairs = stage(likely(named.unionByName(alike).distinct(), nodes.select("key", "sketch"), least))
    linked = pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key"))).distinct()
    star = components(edges(confirmed(pairs, stage(bodies(linked)), shingle, least)))
    # Every other pair within the radius, unless its texts are in one component by now.
    many = fps.where("many").select("fp")
    if not (skipped.isEmpty() and many.isEmpty()):
        both = near.where("p OR q")
        again = skipped.unionByName(many).unionByName(both.select(F.col("a").alias("fp"))).unionByName(both.select(F.col("b").alias("fp")))
        members = stage(nodes.join(again.distinct(), "fp", "left_semi").select("key", "fp", F.struct("doc_id", "key").alias("node")).join(
            star, "node", "left").select("key", "fp", F.xxhash64(F.coalesce("root.key", "key")).alias("part")))
        more = edges(joining_links(members, bodies(members.select("key")), radius, shingle, least))
        star = components(star.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))
    gone = star.where("node <> root").select("node.key")
    kept = stage(nodes.join(gone, "key", "left_anti").select(F.col("key").alias("__key"), F.col("doc_id").alias("__id"), "n"))

    whole = docs.mapInArrow(with_key, schema)
    match = (F.col(f"`{key}`") == F.col("__key")) & (F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(_LAST)) == F.col("__id"))
    once = whole.join(kept.where("n = 1"), match, "left_semi")
    repeated = whole.join(kept.where("n > 1"), match, "left_semi")
    ordered = [F.col(f"`{f.name}`") for f in docs.schema.fields if not isinstance(f.dataType, (MapType, VariantType))]
    first = repeated.groupBy(F.col(f"`{key}`"), F.col(f"`{id_col}`")).agg(
        F.min_by(F.struct(*[F.col(f"`{c}`") for c in names]), F.struct(*ordered)).alias("row"))
    columns = [F.col(f"`{c}`") for c in names]
    return once.select(*columns).unionByName(first.select(*[F.col(f"row.`{c}`") for c in names]))


def _keyed(batches):
    for batch in slices(batches):
        keys = [text_key(words_of(t)) for t in batch.column("text").to_pylist()]
        yield batch.append_column("key", pa.array(keys, pa.binary()))
