"""Hierarchical multi-length packing of token streams.

Documents (or what is left of them after cutting off whole longest windows) are routed to the
smallest context size that holds them. Tiers are packed from the longest to the shortest; gaps
are filled with the longest fitting whole pieces of shorter tiers, and at last with a cut one, so
every sequence is exactly as long as its tier. Sequences of one tier are dealt into step groups
of equal token count whose attention cost (the sum of squared piece lengths) is balanced.

Each task packs its own rows, so nothing is shuffled; what a buffer leaves over, pieces as well as
sequences that make no whole group, is carried to the next one, and a task's tail is cut along the
binary digits of its length. No sequence is padded.
"""

from __future__ import annotations

import os
import string
import unicodedata
import zlib
from bisect import bisect_right, insort
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import load
from .common import batch, id_text, slices, task_id, tidy
from .words import LONGEST, register, token_ids

TIERS = (256, 512, 1024, 2048)
STEP_TOKENS = 32_768
BUFFER_DOCS, BUFFER_TOKENS = 4096, 4_000_000
SEQUENCES_PER_TASK = 1 << 36
#: Words kept in a worker's memory, in each of two generations.
JOINED_WORDS = 250_000

_PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("tier", pa.int32()), ("step_group", pa.int64())])


class Packer:
    """One task's state. A piece is (length, number, doc_id, ids as bytes, start)."""

    def __init__(self, task: int, tiers: tuple[int, ...] = TIERS, step_tokens: int = STEP_TOKENS):
        self.tiers, self.step_tokens, self.task = tiers, step_tokens, task
        self.pool: list[tuple] = []
        self.full: list[list[tuple]] = []  # closed sequences not yet dealt into steps
        self.numbered = self.sequences = self.steps = self.tokens = self.docs = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        total, longest, start = len(ids) // 4, self.tiers[-1], 0
        self.docs, self.tokens = self.docs + 1, self.tokens + total
        while total - start >= longest:
            self.full.append([self._piece(doc_id, ids, start, longest)])
            start += longest
        if start < total:
            insort(self.pool, self._piece(doc_id, ids, start, total - start))

    def _piece(self, doc_id, ids, start, length):
        self.numbered += 1
        return length, self.numbered, doc_id, ids, start

    def _take(self, most: int, cut: bool) -> tuple | None:
        """The longest pooled piece of at most ``most`` tokens; with ``cut``, the front of the shortest longer one."""
        at = bisect_right(self.pool, most, key=lambda p: p[0])
        if at:
            return self.pool.pop(at - 1)
        if not cut or at == len(self.pool):
            return None
        length, _, doc_id, ids, start = self.pool.pop(at)
        insort(self.pool, self._piece(doc_id, ids, start + most, length - most))
        return self._piece(doc_id, ids, start, most)

    def pack(self, last: bool = False) -> None:
        """Fill sequences while the pool can fill them; with ``last``, everything goes."""
        held = sum(p[0] for p in self.pool)
        for tier in reversed(self.tiers):
            below = tier // 2 if tier > self.tiers[0] else 0
            while held >= tier and self.pool and self.pool[-1][0] > below:
                room, sequence = tier, []
                while room:
                    piece = self._take(room, cut=True)
                    sequence.append(piece)
                    room -= piece[0]
                held -= tier
                self.full.append(sequence)
        while last and held:  # the tail: one sequence for each binary digit of what is left
            room, sequence = min(self.tiers[-1], 1 << (held.bit_length() - 1)), []
            held -= room
            while room:
                piece = self._take(room, cut=True)
                sequence.append(piece)
                room -= piece[0]
            self.full.append(sequence)
        self.docs = self.tokens = 0

    def rows(self, last: bool = False) -> pa.RecordBatch | None:
        """The pieces of whole step groups. A tier's sequences of falling cost are dealt to its groups back and forth.

        What makes no whole group waits for the next buffer; with ``last``, what all tiers have left is
        put together from the longest sequence to the shortest, so that only the last group is short.
        """
        out = []
        by_tier: dict[int, list] = {}
        for s in self.full:
            by_tier.setdefault(sum(p[0] for p in s), []).append(s)
        self.full = []
        for tier, sequences in sorted(by_tier.items()):
            groups = len(sequences) * tier // self.step_tokens
            dealt = groups * self.step_tokens // tier
            self.full += sequences[dealt:]
            for i, s in enumerate(sorted(sequences[:dealt], key=lambda s: -sum(p[0] ** 2 for p in s))):
                turn, place = divmod(i, groups)
                self._emit(out, s, tier, self.steps + (groups - 1 - place if turn % 2 else place))
            self.steps += groups
        if last:
            held = 0
            for s in sorted(self.full, key=lambda s: -sum(p[0] for p in s)):  # powers of two, so groups fill exactly
                size = sum(p[0] for p in s)
                self._emit(out, s, size, self.steps + held // self.step_tokens)
                held += size
            self.full = []
        return batch(_PIECES, *zip(*out, strict=True)) if out else None

    def _emit(self, out: list, sequence: list[tuple], tier: int, step: int) -> None:
        offset, number = 0, self.task * SEQUENCES_PER_TASK + self.sequences
        self.sequences += 1
        for length, _, doc_id, ids, start in sequence:
            out.append((doc_id, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), len(ids) // 4, number, offset, tier, self.task * SEQUENCES_PER_TASK + step))
            offset += length


@lru_cache(maxsize=2)
def tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


class WordIds:
    """Ids of texts as bytes, by the tokenizers library, each distinct word once.

    Words new to the cache are encoded many at a time, joined by spaces: every piece of a word ends
    in a token with the end mark, so plain words (letters, perhaps one mark after them) can be told
    apart in the result. Other words are encoded one by one.
    """

    def __init__(self, path: str, words: int = JOINED_WORDS):
        self.library, split = tokenizer(path), load(path)
        self.specials, self.words = split.specials, words
        self.ends = np.array([n.endswith(split.end) for n in split.names]) if split.end else None
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def clear(self) -> None:
        self.young, self.old = {}, {}

    def __call__(self, distinct: list[str]) -> list[bytes]:
        young = self.young
        missing = []
        for w in distinct:
            if w not in young:
                known = self.old.get(w)
                if known is None:
                    missing.append(w)
                else:
                    young[w] = known
        self._learn(missing)
        out = [young[w] for w in distinct]
        for w in missing:
            if len(w) > LONGEST:
                del young[w]
        if len(young) > self.words:
            self.young, self.old = {}, young
        return out

    def _one(self, word: str) -> bytes:
        return np.array(self.library.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, missing: list[str]) -> None:
        plain, pieces, young = [], [], self.young
        for w in missing:
            n = self._pieces(w)
            if n:
                plain.append(w)
                pieces.append(n)
            else:
                young[w] = self._one(w)
        for i in range(0, len(plain), 4096):
            part, expected = plain[i : i + 4096], np.cumsum(pieces[i : i + 4096])
            ids = np.array(self.library.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) != expected[-1]:  # not as plain as they looked
                young.update((w, self._one(w)) for w in part)
                continue
            stops, data = (4 * stops[expected - 1]).tolist(), ids.tobytes()
            at = 0
            for w, stop in zip(part, stops, strict=True):
                young[w] = data[at:stop]
                at = stop

    def _pieces(self, w: str) -> int:
        """Into how many pieces a plain word falls; 0 for others."""
        if self.ends is None:
            return 0
        if not w.isascii():
            if not unicodedata.is_normalized("NFC", w):
                return 0
            w = w.lower()
        if w.isalpha():
            return 1
        return 2 if w[:-1].isalpha() and w[-1] in string.punctuation else 0


@lru_cache(maxsize=2)
def _known(path: str) -> WordIds:
    known = WordIds(path)
    register(known)
    return known


def _packer(vocabulary: str, end_id: int, tiers: tuple[int, ...], step_tokens: int):
    def run(batches):
        known, end = _known(vocabulary), np.array([end_id], "<u4").tobytes()
        packer = Packer(task_id(), tiers, step_tokens)
        for whole in batches:
            for b in slices(whole, "text", 3 << 20):
                ids, starts = token_ids(b.column("text"), known)
                for doc_id, start, stop in zip(b.column("doc_id").to_pylist(), starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                    packer.add(doc_id, ids[start:stop].tobytes() + end)
                    if packer.docs >= BUFFER_DOCS or packer.tokens >= BUFFER_TOKENS:
                        packer.pack()
                        if (out := packer.rows()) is not None:
                            yield out
        packer.pack(last=True)
        if (out := packer.rows(last=True)) is not None:
            yield out
        del packer
        tidy()

    return run


def pack_documents(docs: DataFrame, vocabulary: str, end_id: int = 1, tiers: tuple[int, ...] = TIERS, step_tokens: int = STEP_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, tier, step_group.

    ``tiers`` are powers of two, rising, and so is ``step_tokens``. A null or empty text is the end id
    alone; a null doc_id is kept; repeated rows are packed as often as they occur; a text longer than
    the longest tier is cut into windows of it, all from one array of its ids. Pieces of equal length
    go in the order of the rows. Other columns are not read, whatever their names; an empty table
    gives no pieces. Every step group of a task but its last holds exactly ``step_tokens``.
    """
    if any(t & (t - 1) for t in (*tiers, step_tokens)) or list(tiers) != sorted(set(tiers)) or step_tokens < tiers[-1]:
        raise ValueError("tiers must be rising powers of two, and steps one that is no less")
    kinds = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, tier int, step_group long"
    return id_text(docs, id_col, text_col).mapInArrow(_packer(vocabulary, end_id, tuple(tiers), step_tokens), kinds)
