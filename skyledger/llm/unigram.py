"""Token counts of whole texts under a unigram vocabulary, without building the tokens.

An Aho-Corasick automaton lists every vocabulary piece that ends at each place;
dynamic programming carries the best score and the number of pieces on that
path. The tie rules are the tokenizer's: of equally good paths to a place, the
one whose last piece starts earliest stays; a character that is no piece by
itself may be unknown, at the lowest score less ten, and then counts its UTF-8
bytes (byte fallback) or 1.

Spaces become the mark U+2581 and a text starts with one. No piece of such a
vocabulary has the mark behind another character, so best paths never cross
from one word into the next, and words can be counted one by one. Scores must
add up exactly (whole numbers do) for ties to be the tokenizer's.
"""

from __future__ import annotations

import functools
import itertools
import re

from pyspark.sql import DataFrame

from skyledger.llm.common import PartIds, map_texts, texts

MARK = "▁"
UNKNOWN_PENALTY = 10.0
_WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


class UnigramCounter:
    """Counts tokens; ``pieces`` are (text, score) pairs in id order."""

    def __init__(self, pieces: list[tuple[str, float]], byte_fallback: bool = True):
        import ahocorasick

        if any(MARK in p.lstrip(MARK) for p, _ in pieces):
            raise ValueError("pieces that cross words are not supported")
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min((s for _, s in pieces), default=0.0) - UNKNOWN_PENALTY
        self.byte_fallback = byte_fallback
        # Characters of no piece end every path before and after them.
        self.line_ends_apart = byte_fallback and not any("\n" in p for p, _ in pieces)
        self.words = PartIds(self.count_word, limit=400_000)

    def count_word(self, word: str) -> int:
        none = float("-inf")
        best, count = [0.0], [0]  # of every place whose path is final
        score_here, count_here, known = none, 0, False  # of the next place
        here = 0

        # Matches come by end, longest first, which is the order that ties go by.
        # One more match after the end settles the last places.
        matches = self.automaton.iter(word) if len(self.automaton) else ()
        for last, (size, score) in itertools.chain(matches, ((len(word), (0, none)),)):
            while here < last:
                if not known:
                    unknown = best[here] + self.unknown
                    if unknown > score_here:
                        score_here = unknown
                        count_here = count[here] + (len(word[here].encode()) if self.byte_fallback else 1)
                best.append(score_here)
                count.append(count_here)
                score_here, known = none, False
                here += 1
            if size == 1:
                known = True
            candidate = best[last + 1 - size] + score if size else none
            if candidate > score_here:
                score_here = candidate
                count_here = count[last + 1 - size] + 1
        return count[-1]

    def count(self, text: str) -> int:
        if not text:
            return 0
        marked = MARK + text.replace(" ", MARK)
        if not self.line_ends_apart:
            return sum(map(self.words.__getitem__, _WORD.findall(marked)))
        ends = marked.count("\n")
        # A line end is a word boundary of its own kind: nothing follows it with a mark.
        return ends + sum(sum(map(self.words.__getitem__, _WORD.findall(line))) for line in marked.split("\n"))


@functools.lru_cache(maxsize=2)
def load(path: str) -> UnigramCounter:
    """The vocabulary of a sentencepiece file: its ordinary pieces with the scores written there."""
    import sentencepiece

    file = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(file.vocab_size()) if not (file.is_byte(i) or file.is_control(i) or file.is_unknown(i))]
    return UnigramCounter([(file.id_to_piece(i), float(file.get_score(i))) for i in ids])


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_chars) per row; null and empty texts have 0 tokens, an empty table no rows.

    Repeated rows are counted each; texts of any length are counted whole.
    """
    return map_texts(texts(docs, id_col, text_col), "doc_id long, n_tokens long, n_chars long",
                     lambda: (lambda ids, ts, c=load(path): [[c.count(t) for t in ts], [len(t) for t in ts]]))
