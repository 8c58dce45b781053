"""Personal data: base patterns, and more spans chosen by boosted trees.

The base finds emails, IPv4 addresses, card and phone numbers by pattern and
check, and always stays. High-recall generators propose further, overlapping
spans of the same four kinds: spelled-out emails, grouped digits, numbers with
unusual separators. Gradient boosted trees score each candidate by its format and
its context. Positive are the base spans, as they are and rewritten at their
place into the wide forms that the base misses. Negative are spans that the
base's checks reject, as they stand or once their wide form is undone, plain
numbers, and prose put where an address stood. Other wide candidates are what is
looked for, so they take no part in the training. Per kind, a threshold
calibrated on places kept out of the fit selects the redactions. All places of all
documents take part: tasks sum the gradients of their examples by leaf and feature
value, and only these sums reach the driver.

Features never look at a check's outcome (Luhn sum, address parts over 255), so
the trees learn what valid ones look like and where they stand; a candidate that
fails its check once its wide form is undone is never selected.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import StructType

from skyledger.llm.common import slices, texts
from skyledger.session import stage

KINDS = ("email", "ip", "card", "phone")
# Places of one kind and class that weigh fully in the training; more of them weigh as much as these together.
EVEN = 1_500
# Examples, alike ones counted once, that one task adds up at a time.
EXAMPLES = 20_000
# Least share of true ones among the kept-out candidates that a threshold lets through.
PRECISION = 0.98

# Fixed patterns of the base. Possessive repeats change no match: a run of digits is taken whole or not at all.
_EMAIL_RIGHT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_LEFT_CLASS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def _emails(text: str):
    """Leftmost matches, found from each @ outwards, so long words without one cost nothing."""
    taken = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > taken and text[start - 1] in _LEFT_CLASS:
            start -= 1
        if start < at and (m := _EMAIL_RIGHT.match(text, at)):
            yield start, m.end()
            taken = m.end()
            at = text.find("@", taken)
        else:
            at = text.find("@", at + 1)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base, by start and then kind; kinds are numbers in the order of KINDS."""
    found = [(s, 0, e) for s, e in _emails(text)]
    if not _DIGIT.search(text):
        return sorted(found)
    found += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if _good_ip(m.group())]
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
            found.append((m.start(), 3, m.end()))
    return sorted(found)


def _good_ip(text: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in text.split("."))


# Generators: wider than the base on purpose, and overlapping it and each other.
# Every repeat is bounded, so a candidate search is linear in the text.
_WIDE = (
    (0, re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\x20?(?:@|\(at\)|\[at\]|\x20at\x20)\x20?[A-Za-z0-9-]{1,63}"
                   r"(?:\x20?(?:\.|\(dot\)|\[dot\]|\x20dot\x20)\x20?[A-Za-z0-9-]{1,63}){1,6}")),
    (0, re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\x20?(?:@|\(at\)|\[at\]|\x20at\x20)\x20?[A-Za-z0-9-]{1,63}"
                   r"(?:(?:\.|\x20?(?:\(dot\)|\[dot\])\x20?|\x20dot\x20|\x20\.\x20)[A-Za-z0-9-]{1,63}){1,6}")),
    (1, re.compile(r"(?<![0-9.])[0-9]{1,5}(?:[.,][0-9]{1,5}){3}(?![0-9])")),
    (1, re.compile(r"(?<![0-9.])[0-9]{1,3}(?:\[?\.\]?[0-9]{1,3}){3}(?::[0-9]{1,5})?(?![0-9])")),
    (2, re.compile(r"(?<![0-9])[0-9]{4}(?:[\x20./_-]{0,2}[0-9]{3,6}){2,4}(?![0-9])")),
    (2, re.compile(r"(?<![0-9])[0-9]{12,19}(?![0-9])")),
    (3, re.compile(r"(?:\+|(?<![0-9])00)[0-9]{1,3}[\x20./()-]{0,3}[0-9]{1,4}(?:[\x20./()-]{1,3}[0-9]{2,4}){1,4}(?![0-9])")),
    (3, re.compile(r"(?<![0-9])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])")),
)
_HINTS = (re.compile(r"mail|contact|write|@", re.I), re.compile(r"\bip\b|host|server|address|ping", re.I),
          re.compile(r"card|visa|credit|pay|account", re.I), re.compile(r"phone|tel|call|mobile|fax", re.I))
CONTEXT = 24
_AT = re.compile(r"\x20?(?:@|\(at\)|\[at\]|\x20at\x20)\x20?")
_DOT = re.compile(r"\x20?(?:\(dot\)|\[dot\])\x20?|\x20dot\x20|\x20\.\x20")
_TOP = re.compile(r"\b(?:com|org|net|edu|gov|mil|info|biz|io|eu|uk|de|fr|es|it|nl|ch|at|us|ca|jp|cn|ru|br)$", re.I)
_WORD = re.compile(r"[A-Za-z]+")


def features(text: str, start: int, end: int, kind: int) -> list[float]:
    """Format and context of a candidate; nothing that a base check computes."""
    span, before, after = text[start:end], text[max(0, start - CONTEXT):start], text[end:end + CONTEXT]
    digits = sum(c.isdigit() for c in span)
    letters = sum(c.isalpha() for c in span)
    groups = re.findall(r"[0-9]+", span)
    sizes = [len(g) for g in groups] or [0]
    return [float(x) for x in (
        len(span), digits, letters, len(groups), max(sizes), min(sizes), len(set(sizes)),
        span.count("."), span.count("-"), span.count(" "), span.count("(") + span.count(")"), span.count("@"),
        span.count(","), span.startswith("+"), span.startswith("0"), bool(_HINTS[kind].search(before)),
        bool(_HINTS[kind].search(after)), not before or before[-1].isspace(), not after or after[0].isspace(),
        sum(c.isdigit() for c in before), sum(c.isdigit() for c in after), bool(before) and before[-1].isalnum(),
        span.count("["), span.count("/") + span.count("_"), len(_DOT.findall(span)), bool(_TOP.search(span)))]


def candidates(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all generators, without repeats."""
    found = set()
    if "@" in text or "(at)" in text or "[at]" in text or " at " in text and " dot " in text:
        found.update((m.start(), 0, m.end()) for _, pattern in _WIDE[:2] for m in pattern.finditer(text))
    if _DIGIT.search(text):
        for kind, pattern in _WIDE[2:]:
            found.update((m.start(), kind, m.end()) for m in pattern.finditer(text))
    return sorted(found)


def rejected(text: str) -> set[tuple[int, int, int]]:
    """What the base's patterns match and its checks drop: the negatives to learn from."""
    if not _DIGIT.search(text):
        return set()
    out = {(m.start(), 1, m.end()) for m in _IP.finditer(text) if not _good_ip(m.group())}
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if len(digits) >= 8 and not (12 <= len(digits) <= 19 and luhn(digits)):
            out.add((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if not 9 <= sum(c.isdigit() for c in m.group()) <= 15:
            out.add((m.start(), 3, m.end()))
    return out


def refused(kind: int, span: str) -> bool:
    """Whether the base's check drops a wide candidate once its form is undone."""
    if kind == 0:
        plain = _DOT.sub(".", _AT.sub("@", span, count=1))
        at = plain.find("@")
        # A blank after a plain dot is the end of a sentence.
        return at <= 0 or not _EMAIL_RIGHT.fullmatch(plain, at) or not _LEFT_CLASS.issuperset(plain[:at])
    if kind == 1:
        # Commas group the digits of a plain number.
        return "," in span or not _good_ip(span.replace("[", "").replace("]", "").partition(":")[0])
    digits = "".join(_DIGIT.findall(span))
    return not (12 <= len(digits) <= 19 and luhn(digits)) if kind == 2 else not 9 <= len(digits) <= 15


def free(spans, taken) -> list[tuple[int, int, int]]:
    """Those of the sorted (start, kind, end) that overlap none of the sorted ``taken``."""
    out, ends, k, far = [], [(s, e) for s, _, e in taken], 0, -1
    for span in spans:
        while k < len(ends) and ends[k][0] <= span[0]:
            far = max(far, ends[k][1])
            k += 1
        if far <= span[0] and not (k < len(ends) and ends[k][0] < span[2]):
            out.append(span)
    return out


def wide_forms(kind: int, span: str) -> list[str]:
    """A base span as people write it past the base's patterns; its own letters and digits, or fewer of them."""
    if kind == 0:
        name, _, place = span.partition("@")
        # Without digits and subdomains too, so that these are not what is learnt.
        short = (_WORD.findall(name) or [name])[0], ".".join(place.split(".")[-2:])
        return [n + at + p.replace(".", dot) for n, p in dict.fromkeys([(name, place), short]) for at, dot in (
            (" (at) ", " (dot) "), ("(at)", "(dot)"), ("[at]", "[dot]"), (" [at] ", "."), (" at ", " dot "), (" @ ", "."))]
    groups = re.findall(r"[0-9]+", span)
    if kind == 1:
        fewer = [tuple(g[-n(g):] for g in groups) for n in (lambda g: 1, lambda g: 1 + int(g[-1]) % 3)]
        return [f"{a}{x}{b}{y}{c}{x}{d}" for a, b, c, d in dict.fromkeys([tuple(groups), *fewer])
                for x, y in (("[.]", "[.]"), (".", "[.]"), ("[.]", "."))]
    if kind == 2:
        digits = "".join(groups)
        return [mark.join(digits[k:k + 4] for k in range(0, len(digits), 4)) for mark in (".", "/", "_", "  ", " - ")]
    own = "(" + span.partition("(")[2] if "(" in span else " ".join(groups[1:])
    return ["00" + span[1:], own, "/".join(["+" + groups[0], *groups[1:]]), *(mark.join(groups[1:]) for mark in ("-", ".", " "))]


def no_address(before: str, span: str, after: str) -> list[str]:
    """Prose in the place of an email: a sentence's end, a site's name, a word between two others."""
    name, _, place = span.partition("@")
    words = _WORD.findall(after) + _WORD.findall(place)
    first = (_WORD.findall(before) or _WORD.findall(name) or [name])[-1]
    sites = [f"{first} at {place}", f"{first} at {'.'.join(place.split('.')[-2:])}"]
    if len(words) < 2:
        return sites
    return [*sites, f"{first} at {words[0]}. {words[1]}", f"{first} at {words[0]} dot {words[1]}"]


def examples(text: str) -> list[tuple[int, int, list[float], str]]:
    """(kind, label, features, surroundings) of what is learnt from; all forms of one place have its surroundings.

    Wide candidates that pass the check once undone have no label, but for the
    bare groups of digits that the base takes for a card number and drops.
    """
    good, bad, wide = base_spans(text), rejected(text), candidates(text)
    out = []

    def put(s: int, k: int, e: int, label: int, form: str | None = None) -> None:
        before, after = text[max(0, s - CONTEXT):s], text[e:e + CONTEXT]
        span = text[s:e] if form is None else form
        out.append((k, label, features(before + span + after, len(before), len(before) + len(span), k), before + text[s:e] + after))

    for s, k, e in good:
        put(s, k, e, 1)
        before, after = text[max(0, s - CONTEXT):s], text[e:e + CONTEXT]
        for form in wide_forms(k, text[s:e]):
            # Only forms that can be selected: found as wide candidates and missed by the base.
            line, own = before + form + after, (len(before), k, len(before) + len(form))
            if own in candidates(line) and free([own], base_spans(line)):
                put(s, k, e, 1, form)
        if k == 0:
            for form in no_address(before, text[s:e], after):
                put(s, k, e, 0, form)
    for s, k, e in sorted(bad):
        put(s, k, e, 0)
        if k == 2 and text[s:e].isdigit():
            put(s, 3, e, 0)
            put(s, 1, e, 0, f"{int(text[s:e][-18:]):,}")
    for s, k, e in free(wide, good):
        if (s, k, e) not in bad and (refused(k, text[s:e]) or k == 3 and (s, 2, e) in bad):
            put(s, k, e, 0)
    return out


# ---------------------------------------------------------------- boosted trees


@dataclass
class Trees:
    """Depth-limited regression trees on the logistic loss; arrays of (feature, cut, left, right, value)."""

    start: float
    nodes: list[list[tuple]] = field(default_factory=list)

    def raw(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        for tree in self.nodes:
            total += np.array([n[4] for n in tree])[_ends(tree, x)]
        return total


def _ends(tree: list[tuple], x: np.ndarray) -> np.ndarray:
    """The node of a tree in which each row ends."""
    at = np.zeros(len(x), dtype=np.int64)
    feature, left, right = (np.array([n[k] for n in tree]) for k in (0, 2, 3))
    cut = np.array([n[1] for n in tree])
    while True:
        rows = np.flatnonzero(feature[at] >= 0)
        if not len(rows):
            return at
        here = at[rows]
        at[rows] = np.where(x[rows, feature[here]] <= cut[here], left[here], right[here])


# Gradients are summed in whole parts of this size, so sums do not depend on the order of rows or tasks.
_UNIT = 2.0 ** 30


def _cells(trees: Trees, tree: list[tuple], leaves: list[int], x: np.ndarray, y: np.ndarray, weight: np.ndarray,
           n: np.ndarray) -> list[np.ndarray]:
    """(leaf, feature, value, gradient, curvature, rows): sums over the rows of each leaf that have the value.

    A row stands for ``n`` examples alike, each of the given weight.
    """
    p = 1 / (1 + np.exp(-trees.raw(x)))
    sums = np.stack([n * np.rint(weight * (p - y) * _UNIT).astype(np.int64), n * np.rint(weight * p * (1 - p) * _UNIT).astype(np.int64), n])
    at, out = _ends(tree, x), []
    for leaf in leaves:
        rows = np.flatnonzero(at == leaf)
        for f in range(x.shape[1] if len(rows) else 0):
            order = rows[np.argsort(x[rows, f], kind="stable")]
            v = x[order, f]
            first = np.flatnonzero(np.r_[True, v[1:] > v[:-1]])
            out.append((np.full(len(first), leaf), np.full(len(first), f), v[first], *np.add.reduceat(sums[:, order], first, axis=1)))
    return [np.concatenate(c) for c in zip(*out)] if out else [np.empty(0)] * 6


def _boosted(start: float, cells, rounds: int, depth: int, rate: float, ridge: float) -> Trees:
    """Newton boosting with exact splits, level by level; ``cells(trees, tree, leaves)`` gives the sums of ``_cells`` over all rows."""
    model = Trees(start)
    for _ in range(rounds):
        tree: list[tuple] = [(-1, 0.0, -1, -1, 0.0)]
        leaves = [0]
        for level in range(depth):
            leaf, feature, value, g, h, n = cells(model, tree, leaves)
            g, h = g / _UNIT, h / _UNIT
            split = []
            for me in leaves:
                best = (1e-6, -1, 0.0)
                own = np.flatnonzero((leaf == me) & (feature == 0))
                whole, curved, size = g[own].sum(), h[own].sum(), n[own].sum()
                tree[me] = (-1, 0.0, -1, -1, float(-rate * whole / (curved + ridge)))
                for f in np.unique(feature[leaf == me]).astype(int).tolist() if size >= 8 else ():
                    own = np.flatnonzero((leaf == me) & (feature == f))
                    own = own[np.argsort(value[own])]
                    if len(own) < 2:
                        continue
                    gl, hl = np.cumsum(g[own])[:-1], np.cumsum(h[own])[:-1]
                    gr, hr = whole - gl, curved - hl
                    gain = gl ** 2 / (hl + ridge) + gr ** 2 / (hr + ridge) - whole ** 2 / (curved + ridge)
                    k = int(gain.argmax())
                    if gain[k] > best[0]:
                        ends = [float(-rate * a / (b + ridge)) for a, b in ((gl[k], hl[k]), (gr[k], hr[k]))]
                        best = (float(gain[k]), f, float((value[own[k]] + value[own[k + 1]]) / 2), ends)
                if best[1] >= 0:
                    at = len(tree)
                    tree[me] = (best[1], best[2], at, at + 1, 0.0)
                    tree += [(-1, 0.0, -1, -1, v) for v in best[3]]
                    split += [at, at + 1]
            leaves = split
            if not leaves:
                break
        model.nodes.append(tree)
    return model


_BOOST = {"rounds": 40, "depth": 3, "rate": 0.2, "ridge": 1.0}


def _log_odds(share: float) -> float:
    share = min(max(share, 1e-3), 1 - 1e-3)
    return float(np.log(share / (1 - share)))


def boost(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, **options) -> Trees:
    """Trees from rows in memory."""
    weight = np.ones(len(x)) if weight is None else weight
    one = np.ones(len(x), dtype=np.int64)
    return _boosted(_log_odds(float((y * weight).sum() / weight.sum())),
                    lambda trees, tree, leaves: _cells(trees, tree, leaves, x, y, weight, one), **_BOOST | options)


@dataclass
class Model:
    """Trees over all kinds and a threshold of each; a kind without a threshold adds nothing to the base."""

    trees: Trees
    threshold: dict[int, float]

    def added(self, text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """Selected candidates that overlap neither the base nor each other, longest first, then best."""
        own = [(s, k, e) for s, k, e in free(candidates(text), base) if k in self.threshold and not refused(k, text[s:e])]
        if not own:
            return []
        raw = self.trees.raw(np.array([_row(k, features(text, s, e, k)) for s, k, e in own]))
        taken: list[tuple[int, int]] = []
        out = []
        for _, score, s, k, e in sorted((s - e, -r, s, k, e) for r, (s, k, e) in zip(raw.tolist(), own)):
            if -score >= self.threshold[k] and not any(s < b and a < e for a, b in taken):
                taken.append((s, e))
                out.append((s, k, e))
        return sorted(out)


def _row(kind: int, values: list[float]) -> list[float]:
    return [*values, *(float(kind == k) for k in range(len(KINDS)))]


def fit(rows: list[tuple[int, int, list[float], int]]) -> Model:
    """Fit on (kind, label, features, fold) in memory; fold 0 of 4 calibrates the thresholds.

    A kind's threshold is the lowest score above which at least PRECISION of its
    kept-out candidates are true, but not below a log odds of 0 or below the least
    of its true ones. Too few examples of a kind give it none.
    """
    y = np.array([r[1] for r in rows], dtype=float)
    kind = np.array([r[0] for r in rows], dtype=int)
    learn = np.array([r[3] % 4 != 0 for r in rows], dtype=bool)
    if not 5 <= y[learn].sum() <= learn.sum() - 5:
        return Model(Trees(-30.0), {})
    x = np.array([_row(r[0], r[2]) for r in rows])
    trees = boost(x[learn], y[learn])
    threshold = {}
    for k in range(len(KINDS)):
        out = ~learn & (kind == k)
        if y[out].sum() < 3:
            continue
        raw, truth = trees.raw(x[out]), y[out]
        order = np.argsort(-raw, kind="stable")
        true = np.cumsum(truth[order]) / np.arange(1, len(order) + 1)
        last = np.append(raw[order][1:] < raw[order][:-1], True)  # only between different scores
        enough = np.flatnonzero((true >= PRECISION) & last)
        if len(enough):
            threshold[k] = float(max(raw[order][enough[-1]], 0.0, raw[truth > 0].min()))
    return Model(trees, threshold)


# ---------------------------------------------------------------- DataFrames


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", even: int = EVEN) -> Model:
    """Learn from all places of all documents, as ``fit`` does from rows in memory.

    A place brings all its forms, which are either learnt from or kept out together.
    Places with the same surroundings count once, so copies of a document add nothing.
    The places of a kind and class weigh as much as ``even`` of them together if there are more.
    """
    def run(batches):
        schema = pa.schema([("kind", pa.int32()), ("label", pa.int32()), ("features", pa.list_(pa.float64())),
                            ("around", pa.string())])
        for batch in slices(batches):
            rows = [r for t in batch.column("text").to_pylist() for r in examples(t)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else ([],) * 4, schema)], schema=schema)

    found = texts(docs, id_col, text_col).mapInArrow(run, StructType.fromDDL(
        "kind int, label int, features array<double>, around string"))
    places = stage(found.groupBy("kind", "label", F.xxhash64("around").alias("pick")).agg(F.collect_set("features").alias("forms")))
    class_weight = {(r["kind"], r["label"]): min(1.0, even / r["n"])
                    for r in places.groupBy("kind", "label").agg(F.count(F.lit(1)).alias("n")).collect()}
    # Examples alike are one row with their number.
    learn = (F.pmod(F.shiftright("pick", 7), F.lit(4)) != 0).alias("learn")
    rows = stage(places.select("kind", "label", learn, F.explode("forms").alias("features"))
                 .groupBy("kind", "label", "learn", "features").agg(F.count(F.lit(1)).alias("n")))
    # Read once a level, so in no more files than its size asks for.
    rows = stage(rows.coalesce(1 + rows.count() // EXAMPLES))
    totals = {(r["kind"], r["label"]): r["n"] for r in rows.where("learn").groupBy("kind", "label").agg(F.sum("n").alias("n")).collect()}
    true, every = (sum(n for (_, y), n in totals.items() if y >= least) for least in (1, 0))
    if not 5 <= true <= every - 5:
        return Model(Trees(-30.0), {})
    true, every = (sum(n * class_weight[c] for c, n in totals.items() if c[1] >= least) for least in (1, 0))
    trees = _boosted(_log_odds(true / every), _spread_cells(rows.where("learn"), class_weight), **_BOOST)
    return Model(trees, _thresholds(rows.where("NOT learn"), trees, class_weight))


def _matrix(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Features with the kind, the kind alone, label and number of each row."""
    kind, label, n = (batch.column(c).to_numpy() for c in ("kind", "label", "n"))
    x = batch.column("features").flatten().to_numpy().reshape(batch.num_rows, -1)
    return np.hstack([x, kind[:, None] == np.arange(len(KINDS))]), kind, label, n


def _spread_cells(rows: DataFrame, class_weight: dict[tuple[int, int], float]):
    """The sums of ``_cells`` over a table of examples: tasks add up their rows, a shuffle the rest."""
    def cells(trees: Trees, tree: list[tuple], leaves: list[int]):
        def run(batches):
            for batch in batches:
                if batch.num_rows:
                    x, kind, label, n = _matrix(batch)
                    weight = np.array([class_weight[c] for c in zip(kind.tolist(), label.tolist())])
                    got = _cells(trees, tree, leaves, x, label, weight, n)
                    yield pa.RecordBatch.from_arrays([pa.array(c.astype(t)) for c, t in zip(got, types)], names=names)

        names, types = ["leaf", "feature", "value", "g", "h", "n"], ["i4", "i4", "f8", "i8", "i8", "i8"]
        summed = rows.mapInArrow(run, "leaf int, feature int, value double, g long, h long, n long").groupBy(*names[:3]).agg(
            *[F.sum(c).alias(c) for c in names[3:]])
        got = summed.toArrow()  # leaves by features by the few values that a feature takes
        return [got.column(c).to_numpy() for c in names]

    return cells


def _thresholds(rows: DataFrame, trees: Trees, class_weight: dict[tuple[int, int], float]) -> dict[int, float]:
    """As ``fit`` has them. Scores are range-partitioned and added up inside their partition, then shifted by those before."""
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x, kind, label, n = _matrix(batch)
                yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(trees.raw(x)), pa.array(n * (label == 1)), pa.array(n * (label == 0))],
                                                 names=["kind", "raw", "good", "bad"])

    sums = [F.sum("good").alias("good"), F.sum("bad").alias("bad")]
    scored = rows.mapInArrow(run, "kind int, raw double, good long, bad long").groupBy("kind", "raw").agg(*sums)
    # Written once: both sums must see the same partitions.
    placed = stage(scored.repartitionByRange("kind", F.desc("raw")).withColumn("part", F.spark_partition_id()))
    runs = placed.groupBy("kind", "part").agg(*sums)  # a row per partition and kind
    earlier = Window.partitionBy("kind").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = runs.select("kind", "part", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_before") for c in ("good", "bad")])
    inside = Window.partitionBy("kind", "part").orderBy(F.desc("raw"))
    upto = placed.withColumns({f"{c}_upto": F.sum(c).over(inside) for c in ("good", "bad")}).join(shifts, ["kind", "part"])
    weights = F.create_map(*[F.lit(v) for (k, y), w in class_weight.items() for v in (2 * k + y, w)])

    def weighed(name, label):
        return (F.col(f"{name}_before") + F.col(f"{name}_upto")) * F.coalesce(F.try_element_at(weights, 2 * F.col("kind") + label), F.lit(0.0))

    good, bad = weighed("good", 1), weighed("bad", 0)
    last = F.min(F.when(good >= PRECISION * (good + bad), F.col("raw")))
    got = upto.groupBy("kind").agg(last.alias("last"), F.min(F.when(F.col("good") > 0, F.col("raw"))).alias("least"), F.sum("good").alias("true"))
    return {r["kind"]: max(r["last"], 0.0, r["least"]) for r in got.collect() if r["true"] >= 3 and r["last"] is not None}


def detect(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, base, added) per row, both arrays of (kind, start, end) by start, then kind as listed.

    Starts and ends are code points, ends exclusive. Null and empty texts have
    no spans; repeated rows get theirs each; an empty table gives none.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    span = "array<struct<kind: string, start: int, end: int>>"

    def run(batches):
        known = sent.value
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

        def named(spans):
            return [{"kind": KINDS[k], "start": s, "end": e} for s, k, e in spans]

        for batch in slices(batches):
            base, added = [], []
            for text in batch.column("text").to_pylist():
                own = base_spans(text)
                base.append(named(own))
                added.append(named(known.added(text, own)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(base, kind), pa.array(added, kind)],
                                             names=["doc_id", "base", "added"])

    return texts(docs, id_col, text_col).mapInArrow(run, StructType.fromDDL(f"doc_id long, base {span}, added {span}"))


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span replaced by its kind; overlapping spans become one, named after the first."""
    out, at = [], 0
    for start, kind, end in sorted(spans):
        if start >= at:
            out += [text[at:start], f"[{KINDS[kind]}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact_documents(docs: DataFrame, model: Model, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with redacted texts; ``length_col``, where there is one, follows. Null texts stay null."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        known = sent.value
        for batch in slices(batches):
            got = []
            for text in batch.column(text_col).to_pylist():
                if text is not None:
                    base = base_spans(text)
                    text = redact(text, base + known.added(text, base))
                got.append(text)
            at = batch.schema.get_field_index(text_col)
            batch = batch.set_column(at, batch.schema.field(at), pa.array(got, batch.schema.field(at).type))
            at = batch.schema.get_field_index(length_col) if length_col else -1
            if at >= 0:
                count = [None if t is None else len(t) for t in got]
                batch = batch.set_column(at, batch.schema.field(at), pa.array(count, batch.schema.field(at).type))
            yield batch

    return docs.mapInArrow(run, StructType.fromJson(docs.schema.jsonValue()))
