"""Token counts of a unigram tokenizer without building tokens.

An Aho-Corasick automaton lists the vocabulary's matches by their end; dynamic programming
carries the best score and its number of pieces. Ties go as in the tokenizer: of equal scores
the piece that starts first stays, and a character without a piece of its own is unknown, at
ten below the lowest score. Unknown stretches count as their UTF-8 bytes where the vocabulary
has byte pieces, else a whole stretch is one token.
"""

from __future__ import annotations

from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import batch, id_text, slices
from .words import PIECES, WordCache

SPACE = "▁"
UNKNOWN_BELOW = 10.0


class UnigramCounter:
    def __init__(self, pieces: list[tuple[str, float]], byte_pieces: bool):
        self.byte_pieces = byte_pieces
        self.unknown = min(s for _, s in pieces) - UNKNOWN_BELOW
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()

    def count(self, word: str) -> int:
        n = len(word)
        best, pieces, stretch = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        done = 0

        def unmatched(stop: int):
            """Ends that no match reached: their last character is unknown."""
            nonlocal done
            for e in range(done + 1, stop + 1):
                self._unknown(word, e, best, pieces, stretch)
            done = stop

        at, matched, single = -1, False, False
        for last, (length, score) in self.automaton.iter(word):
            end = last + 1
            if end != at:
                if at > 0 and not single:
                    self._unknown(word, at, best, pieces, stretch, matched)
                if at > 0:
                    done = at
                unmatched(last)
                at, matched, single = end, False, False
            candidate = best[end - length] + score
            if not matched or candidate > best[end]:
                best[end], pieces[end], stretch[end], matched = candidate, pieces[end - length] + 1, False, True
            single |= length == 1
        if at > 0:
            if not single:
                self._unknown(word, at, best, pieces, stretch, matched)
            done = at
        unmatched(n)
        return pieces[n]

    def _unknown(self, word, end, best, pieces, stretch, matched=False):
        candidate = best[end - 1] + self.unknown
        if not matched or candidate > best[end]:
            more = len(word[end - 1].encode("utf-8", "replace")) if self.byte_pieces else int(not stretch[end - 1])
            best[end], pieces[end], stretch[end] = candidate, pieces[end - 1] + more, True


def cut(text: str) -> list[str]:
    """Words, without the mark that precedes each: cut at every space (or mark), with one before the text unless it begins so."""
    if not text:
        return []
    words = text.replace(SPACE, " ").split(" ")
    return words[1:] if not words[0] else words


@lru_cache(maxsize=2)
def load(path: str) -> UnigramCounter:
    """The vocabulary of a sentencepiece model file, with its scores."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [(p.id_to_piece(i), p.get_score(i)) for i in range(p.get_piece_size())]
    return UnigramCounter(pieces, any(p.is_byte(i) for i in range(p.get_piece_size())))


_COUNTS = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64())])


@lru_cache(maxsize=2)
def _known(path: str) -> WordCache:
    count = load(path).count
    return WordCache(lambda word: count(SPACE + word), PIECES)


def _counter(path: str):
    def run(batches):
        known = _known(path)
        for whole in batches:
            for b in slices(whole, "text"):
                out = []
                for text in b.column("text").to_pylist():
                    out.append(sum(map(known.__getitem__, cut(text or ""))))
                    known.turn()
                yield batch(_COUNTS, b.column("doc_id"), out)

    return run


def token_counts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and n_tokens of every whole text. Null and empty texts have none; repeated rows count alike; a null id stays null.

    Texts of any length are counted whole, a row at a time at most;
    other columns are not read, whatever their names; an empty table gives an empty result.
    """
    return id_text(docs, id_col, text_col).mapInArrow(_counter(vocabulary), "doc_id long, n_tokens long")
