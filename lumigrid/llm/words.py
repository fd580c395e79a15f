"""Words of a text, and a cache of what they are worth to a tokenizer."""

from __future__ import annotations

import weakref
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Words, and pieces of words, kept in a Python worker's memory, in each of two generations; longer ones than LONGEST are not kept.
WORDS, PIECES, LONGEST = 200_000, 300_000, 64


def token_ids(texts: pa.Array, lookup: Callable[[list[str]], list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """All texts' token ids in one array, and where each text's begin (and the last one's end).

    Texts are cut at ASCII white space, which separates tokens wherever it stands. ``lookup`` gives
    the ids (4 bytes each) of distinct words; everything per word happens in Arrow and numpy.
    """
    cut = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    coded = cut.flatten().dictionary_encode()
    codes = coded.indices.to_numpy()
    values = lookup(coded.dictionary.to_pylist())
    sizes = np.fromiter(map(len, values), np.int64, len(values)) // 4
    table = np.frombuffer(b"".join(values), "<u4")
    counts = sizes[codes]
    ends = np.cumsum(counts)
    total = int(ends[-1]) if len(ends) else 0
    place = np.repeat((np.cumsum(sizes) - sizes)[codes] - (ends - counts), counts)
    place += np.arange(total)
    words = np.concatenate([[0], np.cumsum(pc.list_value_length(cut).to_numpy())])
    return table[place], np.concatenate([[0], ends])[words]


_caches: weakref.WeakSet = weakref.WeakSet()


def forget() -> None:
    """Empty all caches of this worker; operators without tokens call it, to have the memory."""
    for cache in list(_caches):
        cache.clear()


def register(cache) -> None:
    """Let forget empty a cache."""
    _caches.add(cache)


class WordCache(dict):
    """word -> make(word). When a generation is full it becomes the old one, and the one before goes. Lives as long as the worker, so tasks share it."""

    def __init__(self, make: Callable, words: int = WORDS):
        super().__init__()
        self.make, self.words, self.old = make, words, {}
        register(self)

    __hash__ = object.__hash__  # for the weak set

    def __missing__(self, word):
        value = self.old.get(word)
        if value is None:
            value = self.make(word)
            if len(word) > LONGEST:
                return value
        self[word] = value
        return value

    def clear(self) -> None:
        super().clear()
        self.old = {}

    def turn(self) -> None:
        """To be called between texts."""
        if len(self) > self.words:
            self.old = dict(self)
            super().clear()
