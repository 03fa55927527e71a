"""Token counts under a unigram vocabulary, without making the tokens.

An Aho-Corasick automaton lists the vocabulary pieces that end at each character; the best score
up to a character and the number of pieces on that path are all that is carried along.  Ties go
to the piece that begins first, a character that is no piece costs ten less than the lowest score,
and neighbouring unknown characters are one token, as in the tokenizers library.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import ahocorasick
import pandas as pd
import sentencepiece
from pyspark.sql import DataFrame

PIECES = "/opt/tokenizers/piece_bpe_32k.model"
# The sign of a space, and what an unknown character costs below the lowest score.
SPACE_SIGN, UNKNOWN_COST = "▁", 10.0
#: Words whose counts a worker remembers; it starts anew when it has so many.
REMEMBERED = 200_000


def read_pieces(path: str = PIECES) -> tuple[tuple[str, float], ...]:
    """Pieces and scores of a sentencepiece model, without its control, byte and unknown pieces."""
    m = sentencepiece.SentencePieceProcessor(model_file=path)
    return tuple((m.id_to_piece(i), m.get_score(i)) for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i)))


class Counter:
    """Counts the best path's tokens."""

    def __init__(self, pieces: tuple[tuple[str, float], ...]):
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.single = {piece for piece, _ in pieces if len(piece) == 1}
        self.unknown = min(score for _, score in pieces) - UNKNOWN_COST
        self.known: dict[str, int] = {}

    def word(self, word: str) -> int:
        size, single = len(word), self.single
        best, count, lost = [0.0] + [None] * size, [0] * (size + 1), [False] * (size + 1)
        at = 1

        def close(end: int) -> None:
            """A character that is no piece may be an unknown token."""
            if word[end - 1] in single:
                return
            score = best[end - 1] + self.unknown
            if best[end] is None or score > best[end]:
                best[end], count[end], lost[end] = score, count[end - 1] + (not lost[end - 1]), True

        for last, (length, worth) in self.automaton.iter(word):  # of pieces with one end, the longest first
            end = last + 1
            while at < end:
                close(at)
                at += 1
            score = best[end - length] + worth
            if best[end] is None or score > best[end]:
                best[end], count[end], lost[end] = score, count[end - length] + 1, False
        while at <= size:
            close(at)
            at += 1
        return count[size]

    def text(self, text: str | None) -> int:
        if not text:
            return 0
        marked = text.replace(" ", SPACE_SIGN)
        parts = marked.split(SPACE_SIGN)
        total, known = 0, self.known
        for part in parts[1:] if marked[0] == SPACE_SIGN else parts:
            n = known.get(part)
            if n is None:
                if len(known) >= REMEMBERED:
                    known.clear()
                n = known[part] = self.word(SPACE_SIGN + part)
            total += n
        return total


@cache
def counter(pieces: tuple[tuple[str, float], ...]) -> Counter:
    return Counter(pieces)


def token_counts(docs: DataFrame, path: str = PIECES) -> DataFrame:
    """Tokens of every whole text: doc_id, n_tokens.

    ``docs`` needs doc_id and text; other columns are ignored.  Null and empty texts have no tokens.
    Texts are split at spaces only, each with the word behind it; other white space is text.  The
    vocabulary (below a megabyte) is read once on the driver and sent along with the tasks.
    """
    pieces = read_pieces(path)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = counter(pieces)
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "n_tokens": [count.text(t) for t in batch["text"]]})

    return docs.select("doc_id", "text").mapInPandas(work, f"doc_id {dict(docs.dtypes)['doc_id']}, n_tokens long")
