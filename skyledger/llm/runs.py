"""Periodic runs of words in whole texts, by a sparse dynamic programme over diagonals.

A run of period q is a stretch in which words q apart are identical. Read word by
word, the earlier occurrences of a word name lags; a lag that also matched at the
word before carries its match length on, plus one, and a lag that fails to match
ends its diagonal, which is a run at once if it has become long enough.

The programme is sparse in two exact ways. Only occurrences that agree on a whole
window of words count, as long as a run of that lag must match at least; a match
that never fills its window ends in no run. And of the lags between L and 2L one
is enough at a word: a second one there makes both multiples of a smaller period
whose run has the same ends. So a word has at most one lag per power of two, in
text that repeats a single word a million times, too.

Null texts count as empty: no words, no runs, an empty collapsed text. Repeated
rows are rows of their own; extra columns are left behind. A text of any length
is one document on its own; short ones are worked on many at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame

from skyledger.llm.common import map_texts, texts

WORD = r"[^\x20\x09-\x0D]+"
# Words that a task looks at together; a longer text is looked at alone.
WORDS_AT_A_TIME = 400_000


def find_runs(docs: DataFrame, least: int = 24, repeats: int = 3,
              rewrite: Callable[[int, list], list] | None = None) -> DataFrame:
    """Per document ``doc_id, n_words, runs, collapsed``.

    ``runs`` are (start, length, period) in words, sorted by start and period: the
    stretches of smallest period q and at least ``least`` and ``repeats`` * q words
    that no neighbouring word extends. ``collapsed`` is the text without the words
    that a run repeats, joined by one space. ``rewrite`` may change the list of a
    document's words beforehand; it gets the id (null as None) and the words.
    """
    if repeats < 3:
        raise ValueError("runs must repeat their period three times: shorter ones are not told apart by one lag a scale")

    def make():
        import re

        split = re.compile(WORD).findall

        def work(ids, bodies):
            out = []
            for part in _parts(ids, bodies, split, rewrite):
                out += _collapse(part, least, repeats)
            return list(zip(*out)) or [[], [], []]

        return work

    schema = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    return map_texts(texts(docs), schema, make)


def _parts(ids, bodies, split, rewrite) -> Iterator[list[list[str]]]:
    part, size = [], 0
    for doc, body in zip(ids, bodies):
        words = split(body)
        if rewrite is not None:
            words = rewrite(doc, words)
        if part and size + len(words) > WORDS_AT_A_TIME:
            yield part
            part, size = [], 0
        part.append(words)
        size += len(words)
    if part:
        yield part


def _collapse(part: list[list[str]], least: int, repeats: int) -> list[tuple]:
    """Word count, runs and collapsed text of each document of a part."""
    found = runs_of(part, least, repeats)
    out = []
    for k, words in enumerate(part):
        runs = found.get(k, [])
        kept = words
        if runs:
            keep = np.ones(len(words), bool)
            for start, length, period in runs:
                keep[start + period:start + length] = False
            kept = [w for w, k in zip(words, keep.tolist()) if k]
        out.append((len(words), [{"start": s, "length": n, "period": p} for s, n, p in runs], " ".join(kept)))
    return out


class _Numbers(dict):
    def __missing__(self, word):
        self[word] = number = len(self)
        return number


def runs_of(part: list[list[str]], least: int, repeats: int) -> dict[int, list[tuple[int, int, int]]]:
    """The runs (start, length, period) of each list of words that has any."""
    sizes = np.array([len(words) for words in part], np.int64)
    numbers = _Numbers()
    x = np.fromiter((numbers[w] for words in part for w in words), np.int64, int(sizes.sum()))
    # Texts in which no window is repeated have no run; most end here.
    doc = np.repeat(np.arange(len(part)), sizes)
    repeated = _repeated_windows(x, doc, sizes, _window(1, least))
    if not len(repeated):
        return {}
    inside = np.isin(doc, repeated)
    x, sizes = x[inside], sizes[repeated]
    starts = np.cumsum(sizes) - sizes
    found: dict[int, dict[tuple[int, int], int]] = {}
    for start, end, lag in _ended_diagonals(_sparse_matches(x, sizes, least, repeats), least, repeats):
        k = int(np.searchsorted(starts, start, "right")) - 1
        low, high = int(starts[k]), int(starts[k] + sizes[k])
        if not np.array_equal(x[start + lag:end], x[start:end - lag]):
            continue  # windows that only their hashes made equal
        if (start > low and x[start - 1] == x[start - 1 + lag]) or (end < high and x[end] == x[end - lag]):
            continue  # part of a diagonal that a smaller period covers
        own = found.setdefault(int(repeated[k]), {})
        span = (start - low, end - start)
        own[span] = min(lag, own.get(span, lag))
    return {k: sorted((s, n, p) for (s, n), p in own.items()) for k, own in found.items()}


def _window(scale: int, least: int) -> int:
    """Words, a power of two, that a run must match at every lag from ``scale`` to below twice that.

    A match lasts at least ``least`` - lag and twice the lag, so two thirds of ``least``.
    """
    return max(2 * scale, 1 << (-(-2 * least // 3)).bit_length() - 1)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _hashes(x: np.ndarray) -> np.ndarray:
    return _mixed(x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))


def _doubled(h: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the windows of twice the ``width``, each ending where it did."""
    wide = h.copy()
    wide[width:] = _mixed(h[:-width] * np.uint64(0x9E3779B97F4A7C15) + h[width:]) if len(h) > width else h[width:]
    return wide


def _repeated_windows(x: np.ndarray, doc: np.ndarray, sizes: np.ndarray, window: int) -> np.ndarray:
    """The documents in which some window of that many words comes up twice."""
    h, width = _hashes(x), 1
    while width < window:
        h, width = _doubled(h, width), 2 * width
    place = np.arange(len(x)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    full = place >= window - 1
    key = _mixed(h[full] + doc[full].astype(np.uint64))
    ordered = np.sort(key)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    return np.unique(doc[full][np.isin(key, twice)]) if len(twice) else np.empty(0, np.int64)


def _sparse_matches(x: np.ndarray, sizes: np.ndarray, least: int, repeats: int) -> Iterator[tuple[int, list]]:
    """Every place with the lags of the earlier occurrences that count there, in reading order."""
    doc = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(x)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    h, width = _hashes(x), 1
    order, at, lags, scale = None, [], [], 1
    alive = np.ones(len(x), bool)
    while repeats * scale <= sizes.max():
        while width < _window(scale, least):
            h, width, order = _doubled(h, width), 2 * width, None
        if order is None:
            ends = np.flatnonzero(alive & (place >= width - 1))
            key = _mixed(h[ends] + doc[ends].astype(np.uint64))
            order = np.argsort(key, kind="stable")
            ends, key = ends[order], key[order]
            new = np.r_[True, key[1:] != key[:-1]] if len(key) else np.empty(0, bool)
            group = np.cumsum(new) - 1
            # A window that stands alone stands alone however much longer it gets.
            many = np.bincount(group)[group] > 1 if len(group) else new
            ends, group = ends[many], group[many]
            alive[:] = False
            alive[ends] = True
            line = group * len(x) + ends
        if not len(ends):
            break
        # The nearest earlier occurrence at least ``scale`` words back.
        back = np.searchsorted(line, line - scale, "right") - 1
        lag = np.where((back >= 0) & (group[back] == group), ends - ends[back], 0)
        hit = (lag >= scale) & (lag < 2 * scale)
        at.append(ends[hit])
        lags.append(lag[hit])
        scale *= 2
    if not at:
        return
    at, lags = np.concatenate(at), np.concatenate(lags)
    order = np.lexsort((lags, at))
    at, lags = at[order], lags[order]
    cuts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else []
    lags = lags.tolist()
    for low, high in zip(cuts, [*cuts[1:], len(at)]):
        yield int(at[low]), lags[low:high]


def _ended_diagonals(matches, least: int, repeats: int) -> Iterator[tuple[int, int, int]]:
    """(start, end, lag) of each diagonal that ended long enough for a run."""
    active: dict[int, int] = {}  # lag -> words matched so far
    before = -2

    def ended(lengths: dict[int, int], end: int):
        for lag, length in lengths.items():
            if length + lag >= max(least, repeats * lag):
                yield end - length - lag, end, lag

    for at, lags in matches:
        if at != before + 1:
            yield from ended(active, before + 1)
            active = {}
        # A lag that comes up anew has already matched its whole window.
        carried = {lag: active.pop(lag, _window(1 << (lag.bit_length() - 1), least) - 1) + 1 for lag in lags}
        yield from ended(active, at)
        active, before = carried, at
    yield from ended(active, before + 1)
