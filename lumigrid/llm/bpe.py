"""Byte-pair encoding without merge queues, and decoding by an offset table.

A piece of text is encoded left to right. An Aho-Corasick automaton over the vocabulary gives
the longest token at each place; a token may follow another only if the pair is compatible,
that is, if the merge rules, applied to the two tokens' joined text, end in just these two.
Where no token fits, the encoder steps back and shortens its last token. Compatible
neighbours all the way are exactly what the merge order yields, and a place once left is never
entered again, so the work is linear.
"""

from __future__ import annotations

import hashlib
import json
import string
import unicodedata
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import batch, id_text, slices
from .words import PIECES, WordCache, token_ids

def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies: itself where printable, else the next free letter from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


def split_pieces(text: str, pattern: regex.Pattern) -> list[str]:
    """Normalise and cut: NFC, white space to a space, lower case letter by letter, the pattern's matches. Plain words, perhaps with one mark after them, need no pattern."""
    if "Σ" not in text and (text.isascii() or unicodedata.is_normalized("NFC", text)):
        low = text.lower()
        if low.isalpha():
            return [low]
        if low[:-1].isalpha() and low[-1] in string.punctuation:
            return [low[:-1], low[-1]]
    text = regex.sub(r"\s+", " ", unicodedata.normalize("NFC", text))
    return pattern.findall("".join(map(str.lower, text)))  # no rule here looks at neighbours


class BpeModel:
    """Read from a tokenizer's JSON file: normaliser NFC, white space to a space, lower case; pieces by pattern; byte letters with an end-of-word mark."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.vocab: dict[str, int] = spec["model"]["vocab"]
        self.end = spec["model"]["end_of_word_suffix"] or ""
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.names = [""] * (max([*self.vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1)
        for name, i in self.vocab.items():
            self.names[i] = name
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        for name, i in self.added.items():
            self.names[i] = name
        self.rank = {(self.vocab[a], self.vocab[b]): (r, self.vocab[a + b]) for r, (a, b) in enumerate(merges)}
        self.parts = {}
        for (a, b), (_, whole) in self.rank.items():
            self.parts.setdefault(whole, (a, b))
        self.letters = byte_letters()
        self.split = regex.compile(next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"))
        self.specials = regex.compile("|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True))) if self.added else None
        self.compatible_cache: dict[tuple[int, int], bool] = {}
        # The end mark is one character of its own inside the automaton, so that text can't be mistaken for it.
        self.mark = "\ue000"
        inner = lambda name: name[: -len(self.end)] + self.mark if self.end and name.endswith(self.end) else name
        reachable = {i for i in self.parts} | {i for n, i in self.vocab.items() if len(inner(n).rstrip(self.mark)) == 1}
        forms = {i: inner(self.names[i]) for i in reachable if i not in self.added.values()}
        self.width = {i: len(f) for i, f in forms.items()}
        by_form = {f: i for i, f in forms.items()}
        # Reversed text turns "longest token that starts here" into "longest token that ends here", which the automaton reports.
        self.automaton = ahocorasick.Automaton()
        for i, f in forms.items():
            self.automaton.add_word(f[::-1], i)
        self.automaton.make_automaton()
        # The next shorter token that starts at the same place: the longest proper prefix in the vocabulary.
        self.shorter = {i: next((by_form[f[:n]] for n in range(len(f) - 1, 0, -1) if f[:n] in by_form), -1) for i, f in forms.items()}
        self.inner = forms
        self.bytes, self.offsets, self.lengths = _offset_table([n.encode() for n in self.names])
        self.digits = _offset_table([str(i).encode() for i in range(len(self.names))])

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the joined text of two tokens leaves just these two. Only merges across the seam can break them, so both tokens are taken apart along their own merges, latest first."""
        key = (left, right)
        verdict = self.compatible_cache.get(key)
        if verdict is None:
            verdict = self.compatible_cache[key] = not self.inner[left].endswith(self.mark) and self._seam_holds(left, right)
        return verdict

    def _seam_holds(self, a: int, b: int) -> bool:
        limit = len(self.rank)
        while True:
            merge = self.rank.get((a, b))
            if merge is not None and merge[0] < limit:
                return False  # this merge comes before the one that hid the seam
            last_a = self.rank[self.parts[a]][0] if a in self.parts else -1
            last_b = self.rank[self.parts[b]][0] if b in self.parts else -1
            if last_a > last_b:  # of equal merges the left one is done first, so on this side only earlier ones count
                limit, a = last_a, self.parts[a][1]
            elif last_b >= 0:
                limit, b = last_b + 1, self.parts[b][0]
            else:
                return True

    def encode_piece(self, piece: str) -> list[int]:
        """Token ids of one piece (a match of the pattern, already normalised)."""
        text = "".join([self.letters[b] for b in piece.encode()]) + (self.mark if self.end else "")
        n = len(text)
        last = n - 1 if self.end else -1  # the end mark belongs to the last letter, so no token may start with it
        longest = [-1] * n
        for at, i in self.automaton.iter(text[::-1]):
            if longest[n - 1 - at] < 0:  # of the reports for one place the first is the longest
                longest[n - 1 - at] = i
        out: list[int] = []
        blocked = bytearray(n + 1)
        at, token = 0, longest[0] if n else -1
        while at < n:
            width = self.width
            while True:
                if token < 0:
                    # Step back: the last token must be shorter.
                    if not out:
                        raise ValueError(f"no tokens cover {piece!r}")
                    blocked[at] = 1
                    token = out.pop()
                    at -= width[token]
                    token = self.shorter[token]
                    continue
                stop = at + width[token]
                if blocked[stop] or stop == last or (out and not self.compatible(out[-1], token)):
                    token = self.shorter[token]
                    continue
                break
            out.append(token)
            at = stop
            token = longest[at] if at < n else -1
        return out

    def pieces(self, text: str):
        """Ids of added tokens, and normalised pieces in between, in order."""
        at = 0
        for m in self.specials.finditer(text) if self.specials else ():
            yield from self._plain(text[at : m.start()])
            yield self.added[m[0]]
            at = m.end()
        yield from self._plain(text[at:])

    def _plain(self, text: str):
        return split_pieces(text, self.split)

    def encode(self, text: str, piece_ids=None) -> list[int]:
        """Ids of a whole text; ``piece_ids`` may be a cached form of encode_piece."""
        piece_ids = piece_ids or self.encode_piece
        out: list[int] = []
        for p in self.pieces(text):
            if isinstance(p, int):
                out.append(p)
            else:
                out += piece_ids(p)
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        """Token names joined by a space, gathered through the offset table."""
        return _gather(ids, self.bytes, self.offsets, self.lengths)

    def decimals(self, ids: np.ndarray) -> bytes:
        """The ids in decimal, joined by a space."""
        return _gather(ids, *self.digits)


def _offset_table(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts' bytes, each text followed by a space, and where each begins and how long it is with that space."""
    lengths = np.array([len(t) + 1 for t in texts], np.int64)
    return np.frombuffer(b" ".join(texts) + b" ", np.uint8), np.cumsum(lengths) - lengths, lengths


def _gather(ids: np.ndarray, data: np.ndarray, offsets: np.ndarray, lengths: np.ndarray) -> bytes:
    if not len(ids):
        return b""
    n = lengths[ids]
    ends = np.cumsum(n)
    return data[np.repeat(offsets[ids] - (ends - n), n) + np.arange(ends[-1])].tobytes()[:-1]


@lru_cache(maxsize=4)
def load(path: str) -> BpeModel:
    return BpeModel(path)


_CODED = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


class WordIds:
    """Per distinct word its ids as bytes."""

    def __init__(self, path: str):
        model = load(path)
        pieces = WordCache(model.encode_piece, PIECES)

        def make(word):
            return np.array(model.encode(word, pieces.__getitem__), "<u4").tobytes()

        self.pieces, self.known = pieces, WordCache(make)

    def __call__(self, distinct: list[str]) -> list[bytes]:
        out = list(map(self.known.__getitem__, distinct))
        self.known.turn()
        self.pieces.turn()
        return out


@lru_cache(maxsize=4)
def _known(path: str) -> WordIds:
    return WordIds(path)


def _encoder(path: str):
    def run(batches):
        model, known = load(path), _known(path)
        for whole in batches:
            for b in slices(whole, "text", 3 << 20):
                ids, starts = token_ids(b.column("text"), known)
                out = []
                for start, stop in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                    own = ids[start:stop]
                    out.append((len(own), hashlib.sha256(model.decimals(own)).hexdigest(), hashlib.sha256(model.decode(own)).hexdigest()))
                yield batch(_CODED, b.column("doc_id"), *zip(*out, strict=True))

    return run


def bpe_digests(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every whole text. Null and empty texts have no tokens; repeated rows give equal values, a null id stays null.

    Texts of any length are encoded whole, a row at a time at most;
    other columns are not read, whatever their names; an empty table gives an empty result.
    """
    return id_text(docs, id_col, text_col).mapInArrow(_encoder(vocabulary), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


_IDS = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])


def _id_lister(path: str):
    def run(batches):
        known = _known(path)
        for whole in batches:
            for b in slices(whole, "text", 3 << 20):
                ids, starts = token_ids(b.column("text"), known)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(ids.astype(np.int32)))], schema=_IDS)

    return run


def bpe_encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids, the whole text's token ids as an array."""
    return id_text(docs, id_col, text_col).mapInArrow(_id_lister(vocabulary), "doc_id long, ids array<int>")


def _decoder(path: str):
    def run(batches):
        model = load(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([None if i is None else model.decode(np.array(i, np.int64)).decode() for i in b.column("ids").to_pylist()], pa.string())], names=["doc_id", "decoded"])

    return run


def bpe_decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id and decoded from bpe_encode's columns: token names joined by a space, special tokens kept. Null ids give null."""
    return encoded.select("doc_id", "ids").mapInArrow(_decoder(vocabulary), "doc_id long, decoded string")
