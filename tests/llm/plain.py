"""Plain versions that tests compare with."""

import re

import xxhash


def frame(spark, rows):
    """(doc_id, text) rows as a table."""
    return spark.createDataFrame(rows, "doc_id long, text string")


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def plain_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text).replace("\t", " ").replace("\n", " ")
             .replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fps, radius=4):
    """fps: {doc_id: fingerprint}; smallest doc_id reachable of every doc."""
    return plain_groups(fps, lambda a, b: (a ^ b).bit_count() <= radius)


def plain_groups(items, alike):
    """items: {doc_id: anything}; smallest doc_id reachable of every doc through pairs that are alike."""
    ids = sorted(items)
    parent = {i: i for i in ids}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for k, a in enumerate(ids):
        for b in ids[:k]:
            if alike(items[a], items[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}
