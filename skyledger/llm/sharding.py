"""Resharding a table of files by minimum-cost flow.

The files of a table are its old shards. Every byte (or row) of an old shard
either stays in the new shard of the same number, at no cost, or moves to
another, at a cost of one. The cheapest flow from old sizes to new capacities
says how much each old shard keeps and gives to whom. Shares of a file are
ranges of its rows: blocks of rows move whole, and only the blocks on a border
between two shares are cut, at a row.

Rows are named by file and row number in the file, so shard and place of a row
are arithmetic on the scan: the rewrite shuffles nothing, and a lost task writes
the same rows again. Only sums per block come to the driver, at most ``blocks``
plus one for each file.
"""

from __future__ import annotations

from collections import Counter, deque
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from skyledger.session import stage, staging_folder

SHARDS = 16
BLOCKS = 4096
LAWS = ("bytes", "rows")
_FILE, _ROW, _SHARD, _SLOT = "__file", "__row", "__shard", "__slot"


def min_cost_flow(nodes: int, edges: list[tuple[int, int, int, int]], source: int, sink: int) -> list[int]:
    """Flow on each (from, to, capacity, cost) edge of a cheapest maximum flow, by shortest augmenting paths."""
    to, left, cost, around = [], [], [], [[] for _ in range(nodes)]
    for a, b, capacity, price in edges:
        for u, v, c, p in ((a, b, capacity, price), (b, a, 0, -price)):
            around[u].append(len(to))
            to.append(v)
            left.append(c)
            cost.append(p)
    while True:
        far, via, waiting, queued = [None] * nodes, [-1] * nodes, deque([source]), {source}
        far[source] = 0
        while waiting:
            u = waiting.popleft()
            queued.discard(u)
            for e in around[u]:
                v = to[e]
                if left[e] and (far[v] is None or far[u] + cost[e] < far[v]):
                    far[v], via[v] = far[u] + cost[e], e
                    if v not in queued:
                        queued.add(v)
                        waiting.append(v)
        if far[sink] is None:
            return [left[2 * k + 1] for k in range(len(edges))]
        path, v = [], sink
        while v != source:
            path.append(via[v])
            v = to[via[v] ^ 1]
        amount = min(left[e] for e in path)
        for e in path:
            left[e] -= amount
            left[e ^ 1] += amount


def transfers(old: list[int], capacity: list[int]) -> list[list[tuple[int, int]]]:
    """For each old shard its shares (new shard, amount) in order, its own first; the fewest amounts move.

    The capacities must add up to the old sizes. A hub stands for "any other
    shard", as every move costs the same. Old shards without a new one of their
    number all move wherever they go, so they take part in the flow as one, whose
    shares they then fill in turn: the flow has no more nodes than there are new shards.
    """
    n, m = len(old), len(capacity)
    if n > m + 1:
        joint = transfers([*old[:m], sum(old[m:])], capacity)
        return joint[:m] + _in_turn(old[m:], joint[m])
    source, sink, hub = n + m, n + m + 1, n + m + 2
    edges = [(source, i, size, 0) for i, size in enumerate(old)] + [(n + j, sink, c, 0) for j, c in enumerate(capacity)]
    stay = len(edges)
    edges += [(i, n + i, min(old[i], capacity[i]), 0) for i in range(min(n, m))]
    leave = len(edges)
    edges += [(i, hub, size, 1) for i, size in enumerate(old)]
    arrive = len(edges)
    edges += [(hub, n + j, c, 0) for j, c in enumerate(capacity)]
    flow = min_cost_flow(n + m + 3, edges, source, sink)
    shares = [[(i, flow[stay + i])] if i < min(n, m) and flow[stay + i] else [] for i in range(n)]
    wanting = [[j, flow[arrive + j]] for j in range(m) if flow[arrive + j]]
    for i in range(n):
        give = flow[leave + i]
        while give:
            j, want = wanting[0]
            amount = min(give, want)
            shares[i].append((j, amount))
            give -= amount
            wanting[0][1] -= amount
            if not wanting[0][1]:
                wanting.pop(0)
    return shares


def _in_turn(sizes: list[int], shares: list[tuple[int, int]]) -> list[list[tuple[int, int]]]:
    """The joint ``shares`` of several old shards, dealt to them one after another."""
    out, waiting = [], deque(shares)
    for size in sizes:
        own = []
        while size:
            shard, amount = waiting.popleft()
            own.append((shard, min(amount, size)))
            if amount > size:
                waiting.appendleft((shard, amount - size))
            size -= own[-1][1]
        out.append(own)
    return out


def even(total: int, shards: int) -> list[int]:
    return [total // shards + (j < total % shards) for j in range(shards)]


@dataclass
class Plan:
    """Ranges of rows (file, first row, end row, shard, first slot) and the shards that stay as they are."""

    path: str
    rows_per_block: int
    ranges: list[tuple[str, int, int, int, int]]
    untouched: list[int]
    moved: int


def _located(spark: SparkSession, path: str) -> DataFrame:
    """File and row number of every row of the table, and the row itself as one column, so that no names clash."""
    rows = spark.read.parquet(path)
    return rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"), F.col("_metadata.file_path").alias(_FILE),
                       F.col("_metadata.row_index").alias(_ROW))


def place_names(columns) -> tuple[str, str]:
    """Names of the shard and slot columns: ``__shard`` and ``__slot``, with more underscores where the table has such."""
    taken, out = {c.lower() for c in columns}, []
    for name in (_SHARD, _SLOT):
        while name in taken:
            name = f"_{name}"
        out.append(name)
    return tuple(out)


def plan(spark: SparkSession, path: str, shards: int = SHARDS, law: str = "bytes", text_col: str = "text",
         blocks: int = BLOCKS) -> Plan:
    """Where every row of the table at ``path`` goes.

    Law ``bytes``: UTF-8 bytes of the text (null: none) plus 1 per row, equal up
    to the row on each border. Law ``rows``: counts at most one apart.
    """
    if law not in LAWS:
        raise ValueError(f"law must be one of {LAWS}")
    weight = F.coalesce(F.octet_length(F.col("row")[text_col]), F.lit(0)).cast("long") + 1 if law == "bytes" else F.lit(1).cast("long")
    sizes = stage(_located(spark, path).select(_FILE, _ROW, weight.alias("weight")))
    total_rows = sizes.count()
    per_block = max(1, -(-total_rows // blocks))
    block = F.floor(F.col(_ROW) / per_block).cast("long")
    sums = sizes.groupBy(_FILE, block.alias("block")).agg(F.sum("weight").alias("weight"), F.count("*").alias("n"))
    by_file: dict[str, list] = {}
    for r in sums.collect():
        by_file.setdefault(r[_FILE], []).append((r["block"], r["weight"], r["n"]))
    files = sorted(by_file)
    for f in files:
        by_file[f].sort()
    old = [sum(b[1] for b in by_file[f]) for f in files]
    shares = transfers(old, even(sum(old), shards))
    # Borders between shares, as amounts from a file's start; which block each falls into.
    borders, inside = {}, []
    for i, f in enumerate(files):
        at, border = 0, []
        for _, amount in shares[i][:-1]:
            at += amount
            border.append(at)
        borders[f] = border
        before = 0
        for b, w, _ in by_file[f]:
            inside += [(f, b, before, x - before) for x in border if before < x < before + w]
            before += w
    cut_rows: dict[tuple[str, int], int] = {}
    if inside:
        # The row a border falls into goes to the side that holds more of it.
        wanted = spark.createDataFrame([(f, b, base, c) for f, b, base, c in inside], f"{_FILE} string, block long, base long, cut long")
        within = sizes.withColumn("block", block).join(wanted.select(_FILE, "block").distinct(), [_FILE, "block"])
        end = F.sum("weight").over(Window.partitionBy(_FILE, "block").orderBy(_ROW))
        placed = within.withColumn("middle", end - F.col("weight") / 2)
        got = placed.join(wanted, [_FILE, "block"]).where("middle < cut")
        for r in got.groupBy(_FILE, "block", "base", "cut").agg(F.max(_ROW).alias("last")).collect():
            cut_rows[(r[_FILE], r["base"] + r["cut"])] = r["last"] + 1
    block_of_border = {(f, base + c): b for f, b, base, c in inside}
    ranges, slot, kept_whole = [], [0] * shards, []
    for i, f in enumerate(files):
        amount, first_row = 0, {}
        for b, w, n in by_file[f]:
            first_row[amount] = b * per_block
            amount += w
        marks = [0]
        for x in borders[f]:
            # Inside a block: after its rows that lie mostly before the border, if any.
            row = first_row[x] if x in first_row else cut_rows.get((f, x), block_of_border.get((f, x), 0) * per_block)
            marks.append(max(row, marks[-1]))
        marks.append(by_file[f][-1][0] * per_block + by_file[f][-1][2])
        first = len(ranges)
        for (shard, _), a, z in zip(shares[i], marks, marks[1:]):
            if z > a:
                ranges.append((f, a, z, shard, slot[shard]))
                slot[shard] += z - a
        if len(ranges) == first + 1 and ranges[first][3] == i:
            kept_whole.append(i)
    parts = Counter(r[3] for r in ranges)
    untouched = [i for i in kept_whole if parts[i] == 1]
    moved = sum(amount for i, s in enumerate(shares) for j, amount in s if j != i)
    return Plan(path, per_block, ranges, untouched, moved)


def assigned(spark: SparkSession, made: Plan) -> DataFrame:
    """The table with shard and slot of every row, by arithmetic on the scan."""
    pieces: dict[tuple[str, int], list] = {}
    for f, a, z, shard, slot in made.ranges:
        for b in range(a // made.rows_per_block, (z - 1) // made.rows_per_block + 1):
            pieces.setdefault((f, b), []).append((z, shard, slot - a))
    # At most the number of blocks, files and borders.
    schema = f"{_FILE} string, block long, pieces array<struct<upto: long, shard: int, shift: long>>"
    table = spark.createDataFrame([(f, b, p) for (f, b), p in pieces.items()], schema)
    rows = _located(spark, made.path).withColumn("block", F.floor(F.col(_ROW) / made.rows_per_block).cast("long"))
    piece = F.filter("pieces", lambda p: F.col(_ROW) < p["upto"])[0]
    joined = rows.join(table, [_FILE, "block"]).withColumn("piece", piece)
    names = rows.schema["row"].dataType.names
    shard, slot = place_names(names)
    return joined.select(*[F.col("row")[c].alias(c) for c in names], F.col("piece.shard").alias(shard),
                         (F.col(_ROW) + F.col("piece.shift")).alias(slot))


def rewrite(spark: SparkSession, made: Plan, out: str) -> DataFrame:
    """Write the shards that change as ``out``/__shard=N and return the whole table with __shard and __slot.

    The two come last, under the names that ``place_names`` gives.

    Shards that keep their old file as it is are read from there.
    """
    rows = assigned(spark, made)
    schema, shard = rows.schema, rows.columns[-2]
    if not made.ranges:
        return rows
    changed = rows if not made.untouched else rows.where(~F.col(shard).isin(made.untouched))
    changed.write.mode("overwrite").partitionBy(shard).parquet(out)
    written = spark.read.schema(schema).parquet(out).select(*[F.col(f"`{c}`") for c in schema.names])
    return written if not made.untouched else written.unionByName(rows.where(F.col(shard).isin(made.untouched)))


def reshard(spark: SparkSession, path: str, shards: int = SHARDS, law: str = "bytes", text_col: str = "text") -> DataFrame:
    """The table at ``path`` in its new shards, written under the staging folder; see ``rewrite``.

    Null texts have size 1, repeated rows a slot each, an empty table no rows.
    """
    import uuid

    made = plan(spark, path, shards, law, text_col)
    return rewrite(spark, made, f"{staging_folder(spark)}/{uuid.uuid4().hex}")
