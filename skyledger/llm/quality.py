"""Quality of documents by weak supervision: rules vote, EM weighs them, a posterior decides.

Each rule looks at one ratio of a document's surface and votes good, bad or
abstains. Documents with the same votes are alike to the model, so the corpus is
reduced to counts of vote patterns (at most 3 to the number of rules, whatever
the corpus). Expectation-maximisation on those counts gives each rule's chances
of each vote for good and for bad documents, and the posterior of every pattern.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from skyledger.llm.common import map_texts, slices, texts
from skyledger.session import stage

# Fixed values of the base rules.
SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
KEEP_AT = 0.5

# The rules: name, measure, votes bad at or above (or below), votes good at or below (or above).
# A measure between the two limits abstains.
RULES = [
    ("length", "n_words", "low", 50.0, 80.0),
    ("word_length_low", "mean_word", "low", 2.5, 3.5),
    ("word_length_high", "mean_word", "high", 12.0, 8.0),
    ("symbols", "symbol_ratio", "high", 0.08, 0.02),
    ("repeated_words", "repeat_ratio", "high", 0.30, 0.16),
    ("repeated_lines", "dup_line_ratio", "high", 0.40, 0.34),
    ("capitals", "capital_ratio", "high", 0.40, 0.12),
    ("marks", "mark_ratio", "high", 0.40, 0.10),
    ("marked_starts", "marked_start_ratio", "high", 0.08, 0.02),
]
N_PATTERNS = 3 ** len(RULES)
SCHEMA = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
          "base_failed boolean, pattern int")
_SPACE = b" \t\n\x0b\x0c\r"
# Kinds of bytes: A capital, a small, 0 digit, x beyond ASCII, space, and a dot for every other mark.
_KINDS = bytes(ord("A") if chr(b).isupper() else ord("a") if chr(b).islower() else ord("0") if chr(b).isdigit()
               else ord(" ") if b in _SPACE else ord(".") for b in range(128)) + b"x" * 128


def repeated_words(words: list[bytes]) -> int:
    """Words that stand in a window of three words found at least twice."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[bytes, int] = {}
    code = np.fromiter((number.setdefault(w, len(number)) for w in words), dtype=np.int64, count=n)
    pair, base = code[:-1] * len(number) + code[1:], len(number)
    if base >= 2 ** 20:  # the product of three could overflow: number the pairs afresh
        pair = np.unique(pair, return_inverse=True)[1]
    triple = pair[:-1] * base + code[2:]
    order = np.argsort(triple, kind="stable")
    same = triple[order[1:]] == triple[order[:-1]]
    twice = np.zeros(n - 2, dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(n, dtype=bool)
    for k in range(3):
        covered[k:n - 2 + k] |= twice
    return int(covered.sum())


def measures(text: str) -> tuple[int, int, int, int, int, bool, int]:
    """The figures of one text, the base verdict and the pattern of votes."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n_words = len(words)
    word_chars = len(text) - (len(raw) - len(raw.translate(None, _SPACE)))
    n_symbols = len(raw) - len(raw.translate(None, SYMBOLS.encode()))
    lines = [line for line in raw.split(b"\n") if line.strip()]
    n_dup = len(lines) - len(set(lines))
    n_repeat = repeated_words(words)
    failed = n_words < MIN_WORDS or 100 * n_repeat > MAX_REPEAT_PERCENT * n_words
    kinds = raw.translate(_KINDS)
    upper, lower = kinds.count(b"A"), kinds.count(b"a")
    per_word = max(n_words, 1)
    value = {"n_words": n_words, "mean_word": word_chars / per_word, "symbol_ratio": n_symbols / per_word,
             "repeat_ratio": n_repeat / per_word, "dup_line_ratio": n_dup / max(len(lines), 1),
             "capital_ratio": upper / max(upper + lower, 1), "mark_ratio": kinds.count(b"..") / per_word,
             "marked_start_ratio": kinds.count(b" .") / per_word}
    pattern = 0
    for _, measure, side, bad, good in RULES:
        x = value[measure]
        is_bad = x < bad if side == "low" else x >= bad
        is_good = x >= good if side == "low" else x <= good
        pattern = 3 * pattern + (2 if is_bad else 1 if is_good else 0)
    return n_words, word_chars, n_symbols, n_dup, n_repeat, failed, pattern


def votes(pattern: np.ndarray) -> np.ndarray:
    """One column per rule: 0 abstains, 1 good, 2 bad."""
    out = np.empty((len(pattern), len(RULES)), dtype=np.int64)
    rest = np.asarray(pattern).copy()
    for k in range(len(RULES) - 1, -1, -1):
        rest, out[:, k] = np.divmod(rest, 3)
    return out


def expectation_maximisation(pattern: np.ndarray, count: np.ndarray, rounds: int = 500, tol: float = 1e-9):
    """Posterior of good for every given pattern, and each rule's accuracy among its votes.

    An abstention says nothing: a rule's chances are those among the votes it casts.
    A rule votes bad at least as often on bad documents as on good ones, so the two
    classes cannot change places; a rule that says the same of all says nothing.
    """
    vote = votes(pattern)
    weight = count / count.sum()
    # Start: an even mind, moved by the share of good among the cast votes.
    good, bad = (vote == 1).sum(axis=1), (vote == 2).sum(axis=1)
    posterior = (good + 0.5) / (good + 3 * bad + 1.0)
    chance = np.zeros((2, len(RULES)))  # of a vote for bad, if one is cast, on good and on bad documents
    for _ in range(rounds):
        share = np.array([weight @ posterior, weight @ (1 - posterior)])
        for k in range(len(RULES)):
            cast = np.array([[p[vote[:, k] == 1].sum(), p[vote[:, k] == 2].sum()] for p in (weight * posterior, weight * (1 - posterior))]) + 1e-6
            rate = cast[:, 1] / cast.sum(axis=1)
            chance[:, k] = rate if rate[1] >= rate[0] else cast[:, 1].sum() / cast.sum()
        said_bad, said_good = np.log(chance[1] / chance[0]), np.log((1 - chance[1]) / (1 - chance[0]))
        evidence = np.where(vote == 2, said_bad, np.where(vote == 1, said_good, 0.0))
        against = evidence.sum(axis=1)
        log = np.log(np.maximum(share, 1e-12))
        fresh = 1 / (1 + np.exp(np.clip(log[1] - log[0] + against, -700, 700)))
        moved = np.abs(fresh - posterior).max()
        posterior = fresh
        if moved < tol:
            break
    cast = np.array([[(weight * p)[vote[:, k] == v].sum() for k in range(len(RULES))] for p, v in
                     ((posterior, 1), (1 - posterior, 2), (1 - posterior, 1), (posterior, 2))])
    return posterior, (cast[0] + cast[1]) / np.maximum(cast.sum(axis=0), 1e-300)


def figures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Figures, base verdict and vote pattern per row; a null text counts as empty, which fails the base."""
    def make() -> Callable:
        return lambda ids, ts: list(zip(*map(measures, ts))) if ts else [[]] * 7

    return map_texts(texts(docs, id_col, text_col), SCHEMA, make)


def fit(figured: DataFrame) -> tuple[dict[int, float], dict[str, float]]:
    """Posterior by pattern and accuracy by rule, learnt from all rows; both empty for an empty table."""
    rows = figured.groupBy("pattern").count().collect()  # at most N_PATTERNS rows
    if not rows:
        return {}, {}
    rows.sort(key=lambda r: r["pattern"])
    pattern = np.array([r["pattern"] for r in rows])
    posterior, accuracy = expectation_maximisation(pattern, np.array([r["count"] for r in rows], dtype=float))
    return dict(zip(pattern.tolist(), posterior.tolist())), dict(zip([r[0] for r in RULES], accuracy.tolist()))


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, figures, base_failed, quality, kept): kept if the base passes and the posterior is at least KEEP_AT.

    Every row counts in the fit, repeated rows each. An empty table gives an
    empty result.
    """
    figured = stage(figures(docs, id_col, text_col))
    posterior, _ = fit(figured)
    spark = figured.sparkSession
    table = spark.createDataFrame(sorted(posterior.items()), "pattern int, quality double")
    return figured.join(F.broadcast(table), "pattern").drop("pattern").withColumn(
        "kept", ~F.col("base_failed") & (F.col("quality") >= KEEP_AT))


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are kept, all columns as they were."""
    posterior, _ = fit(figures(docs, id_col, text_col))

    def run(batches):
        for batch in slices(batches):
            keep = []
            for text in batch.column(text_col).to_pylist():
                *_, failed, pattern = measures(text or "")
                keep.append(not failed and posterior[pattern] >= KEEP_AT)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, StructType.fromJson(docs.schema.jsonValue()))
