"""A gated recurrent language model with a class-factored softmax, and whole-document scores.

Every word of the training documents belongs to a slot of the model's output: the most frequent
words have one each, the others share slots by their spelling (their last letters). Slots are
grouped into classes. A word's probability is that of its class, times that of its slot within
the class (both softmaxes over the hidden state of a GRU that has read every word before it),
times its share of the slot's count, which is 1 for frequent words. Words that training lacks
are one unknown word, whose probability is the share of words seen once; so all sums to 1.

1. A chunk of documents sends each owner (a range of word hashes) its distinct words' hashes and
   counts once, and gets the totals back in the same order.
2. The owners' most frequent words, ranked together, take the slots.
3. The GRU trains on every training document, in ROUNDS passes, each over its own share of the
   chunks: a task runs truncated backpropagation in numpy over its chunks, its state carried from
   window to window, and the tasks' weights are averaged in a tree.
4. The documents travel once, as compressed word codes, to meet their chunk's totals, and are
   scored with the state carried to each one's end.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER_BYTES, materialize, slices, task_id
from .exact import owner_of
from .words import forget

#: The model's size: slots in all, and those that words share by spelling. One slot is the end's.
CLASSES, WITHIN, SHARED = 32, 64, 512
OWN = CLASSES * WITHIN - SHARED - 1
HIDDEN, EMBED = 24, 16
#: Training: parallel parts of a chunk's words, words in a window, passes with averaging, and the first pace.
STREAMS, WINDOW, ROUNDS, PACE = 192, 16, 4, 0.04
CHUNK_WORDS, CHUNK_BYTES = 1_000_000, 24 << 20
CHUNKS_PER_TASK = 1 << 24
#: Weights that are moved at a time.
BLOCK = 16_384
#: Input partitions to an owner, and weights that one task averages.
PARTS_PER_OWNER, FAN_IN = 16, 16
SEED = 7


def hash_words(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def spelling(words: list[bytes]) -> np.ndarray:
    """The shared slot of each word, by its last four bytes."""
    tails = np.frombuffer(b"".join([w[-4:].rjust(4, b"\0") for w in words]), "<u4")
    return ((tails * np.uint32(2_654_435_761)) >> np.uint32(12) & np.uint32(SHARED - 1)).astype("<u2")


@dataclass
class Slots:
    """Where words are in the output, ranked by their mass: place // WITHIN is the class."""

    top: np.ndarray  # sorted hashes of the words with a slot of their own
    place: np.ndarray  # theirs
    shared: np.ndarray  # places of the spelling slots
    end: int
    mass: np.ndarray  # training tokens by place

    def of(self, hashes: np.ndarray, spelled: np.ndarray) -> np.ndarray:
        out = self.shared[spelled]
        if len(self.top) and len(hashes):
            at = np.minimum(np.searchsorted(self.top, hashes), len(self.top) - 1)
            known = self.top[at] == hashes
            out[known] = self.place[at[known]]
        return out


def arrange(top: list[tuple[int, int, int]], shared: np.ndarray, ends: int) -> Slots:
    """Slots from (hash, count, spelling) of the most frequent words, the tokens by spelling of all words, and the ends."""
    hashes = np.array([h for h, _, _ in top], np.uint64)
    counts = np.array([c for _, c, _ in top], np.int64)
    rest = shared.astype(np.int64) - np.bincount(np.array([s for _, _, s in top], np.int64), weights=counts, minlength=SHARED).astype(np.int64)
    mass = np.concatenate([[ends], counts, np.zeros(OWN - len(top), np.int64), rest])
    rank = np.empty(len(mass), np.int64)
    order = np.argsort(-mass, kind="stable")
    rank[order] = np.arange(len(mass))
    by_hash = np.argsort(hashes)
    return Slots(hashes[by_hash], rank[1 : 1 + len(top)][by_hash], rank[1 + OWN :], int(rank[0]), mass[order])


def _softmax(logits: np.ndarray) -> np.ndarray:
    """Their exponentials in place, and the sum of each row. Logits are bounded, which exp in single precision takes."""
    if logits.max() > 80:
        np.minimum(logits, 80, out=logits)
    np.exp(logits, out=logits)
    return logits @ np.ones(logits.shape[1], logits.dtype)


def _sigmoid(x: np.ndarray) -> None:
    """1 / (1 + exp(x)) in place: numpy's exp takes half the time of its tanh. It falls, so weights come negated. Infinity gives 0."""
    np.exp(x, out=x)
    x += 1
    np.reciprocal(x, out=x)


def _step(x, h, turned, inner, new, out) -> None:
    """One step from state ``h``, a row for each unit and a column for each lane. ``inner`` gets the gates and, below them, the recurrent share of the new state (-2 times); ``new`` that state, ``out`` the mixed one. x and the weights are as ``falling`` makes them."""
    np.matmul(turned, h, out=inner)
    gates = inner[: 2 * HIDDEN]
    gates += x[: 2 * HIDDEN]
    _sigmoid(gates)
    np.multiply(gates[HIDDEN:], inner[2 * HIDDEN :], out=new)
    new += x[2 * HIDDEN :]
    _sigmoid(new)  # tanh(x) = 2 / (1 + exp(-2 x)) - 1
    new *= 2
    new -= 1
    np.subtract(h, new, out=out)
    out *= gates[:HIDDEN]
    out += new


def falling(weights: np.ndarray) -> np.ndarray:
    """Weights a row for each output, those of the gates negated, those of the new state times -2."""
    turned = np.negative(weights.T, order="C")
    turned[2 * HIDDEN :] *= 2
    return turned


def _rows(states: np.ndarray) -> np.ndarray:
    """(steps, units, lanes) as a row for each step and lane, with a 1 for the biases."""
    steps, units, lanes = states.shape
    out = np.empty((steps, lanes, units + 1), states.dtype)
    out[..., :units] = states.transpose(0, 2, 1)
    out[..., units] = 1
    return out.reshape(-1, units + 1)


class Gru:
    """Word embeddings, one gated layer, a softmax over classes and one over the slots of each class. Single precision."""

    def __init__(self, mass: np.ndarray | None = None, seed: int = SEED):
        rng = np.random.default_rng(seed)
        draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[-2])).astype(np.float32)
        self.p = {
            "E": draw(CLASSES * WITHIN, EMBED) * np.float32(np.sqrt(CLASSES * WITHIN) / 4), "W": draw(EMBED, 3 * HIDDEN), "U": draw(HIDDEN, 3 * HIDDEN), "b": np.zeros(3 * HIDDEN, np.float32),
            "O": draw(HIDDEN, CLASSES) * np.float32(0.1), "o": np.zeros(CLASSES, np.float32), "V": draw(CLASSES, HIDDEN, WITHIN) * np.float32(0.1), "v": np.zeros((CLASSES, WITHIN), np.float32),
        }
        if mass is not None:  # the biases start at the unigram model; slots without words are out
            cells = np.maximum(mass.reshape(CLASSES, WITHIN), 1e-9)
            self.p["o"] = np.log(cells.sum(axis=1) / cells.sum()).astype(np.float32)
            self.p["v"] = np.log(cells / cells.sum(axis=1, keepdims=True)).astype(np.float32)

    def flat(self) -> np.ndarray:
        return np.concatenate([w.ravel() for w in self.p.values()])

    def load(self, flat: np.ndarray) -> Gru:
        at = 0
        for k, w in self.p.items():
            self.p[k] = flat[at : at + w.size].reshape(w.shape).astype(np.float32)
            at += w.size
        return self

    def inputs(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Embeddings of (steps, lanes), each with a 1 for the bias, and what they give to the gates and the new state, a row for each."""
        p = self.p
        read = np.empty((*codes.shape, EMBED + 1), p["E"].dtype)
        read[..., :EMBED] = p["E"].take(codes, axis=0)
        read[..., EMBED] = 1
        return read, np.matmul(falling(np.concatenate([p["W"], p["b"][None]])), read.transpose(0, 2, 1))

    def train(self, stream: np.ndarray, end: int, adam: Adam) -> None:
        """Truncated backpropagation over STREAMS parallel parts of a stream of slots, WINDOW steps at a time, state carried over."""
        streams = max(1, min(STREAMS, len(stream) // (2 * WINDOW)))
        length = -(-len(stream) // streams)
        if not length:
            return
        lanes = np.resize(stream, streams * length).reshape(streams, length)  # the last part ends with the first one's words
        lanes = np.concatenate([np.append(end, lanes[:-1, -1])[:, None], lanes], axis=1)
        h = np.zeros((streams, HIDDEN), np.float32)
        for start in range(0, length, WINDOW):
            window = lanes[:, start : start + WINDOW + 1]
            grads, h = self.gradients(window[:, :-1], window[:, 1:], h)
            adam.move(self.p, grads)

    def _output(self, states: np.ndarray, aims: np.ndarray, g: dict | None, at: np.ndarray | None = None):
        """log probabilities of slots given _rows of states (or the rows ``at`` of them); with ``g``, the gradients of their mean loss go there and to the states."""
        p, n = self.p, len(aims)
        order = np.argsort(aims.astype(np.uint16), kind="stable")  # by class
        aims, rows = aims[order], np.arange(n)
        classes, member = np.divmod(aims, WITHIN)
        read = states.take(order if at is None else at[order], axis=0)
        outer, inner = np.concatenate([p["O"], p["o"][None]]), np.concatenate([p["V"], p["v"][:, None]], axis=1)
        share, part = read @ outer, np.empty((n, WITHIN), states.dtype)
        cuts = np.searchsorted(classes, np.arange(CLASSES + 1)).tolist()
        present = [(c, slice(a, b)) for c, (a, b) in enumerate(pairwise(cuts)) if a < b]
        for c, own in present:
            np.matmul(read[own], inner[c], out=part[own])
        if g is None:
            got = share[rows, classes].astype(np.float64) + part[rows, member]
            got -= np.log(_softmax(share)) + np.log(_softmax(part))
            out = np.empty(n)
            out[order] = got
            return out, None
        for wrong, aim in ((share, classes), (part, member)):
            wrong *= (1 / (n * _softmax(wrong)))[:, None]
            wrong[rows, aim] -= 1 / n
        whole, cells = read.T @ share, np.zeros_like(inner)
        down, more = share @ p["O"].T, np.empty((n, HIDDEN), states.dtype)
        for c, own in present:
            np.matmul(read[own].T, part[own], out=cells[c])
            np.matmul(part[own], p["V"][c].T, out=more[own])
        g["O"], g["o"], g["V"], g["v"] = whole[:HIDDEN], whole[HIDDEN], cells[:, :HIDDEN].copy(), cells[:, HIDDEN].copy()
        down += more
        back = np.empty_like(order)
        back[order] = rows
        return None, down.take(back, axis=0)

    def gradients(self, x: np.ndarray, y: np.ndarray, h: np.ndarray):
        p, (lanes, steps) = self.p, x.shape
        codes = np.ascontiguousarray(x.T)
        read, table = self.inputs(codes)
        states = np.empty((steps + 1, HIDDEN, lanes), h.dtype)
        inner, new = (np.empty((steps, k * HIDDEN, lanes), h.dtype) for k in (3, 1))
        states[0] = h.T
        turned = falling(p["U"])
        with np.errstate(over="ignore"):
            for t in range(steps):
                _step(table[t], states[t], turned, inner[t], new[t], states[t + 1])
        g: dict[str, np.ndarray] = {}
        _, down = self._output(_rows(states[1:]), y.T.ravel(), g)
        down = np.ascontiguousarray(down.reshape(steps, lanes, HIDDEN).transpose(0, 2, 1))
        z, r, own = (inner[:, k * HIDDEN : (k + 1) * HIDDEN] for k in range(3))
        rest = 1 - z
        to_z = (states[:-1] - new) * z * rest
        to_n = rest * (1 - new * new)
        to_r = own * r * (r - 1) * 0.5
        both = np.empty((steps, 4 * HIDDEN, lanes), h.dtype)  # of the new state, the gates, and the new state's recurrent share
        dn, dz, dr, ds = (both[:, k * HIDDEN : (k + 1) * HIDDEN] for k in range(4))
        dx, du = both[:, : 3 * HIDDEN], both[:, HIDDEN:]
        dh = np.zeros((HIDDEN, lanes), h.dtype)
        for t in reversed(range(steps)):
            dh += down[t]
            np.multiply(dh, to_n[t], out=dn[t])
            np.multiply(dh, to_z[t], out=dz[t])
            np.multiply(dn[t], to_r[t], out=dr[t])
            np.multiply(dn[t], r[t], out=ds[t])
            dh *= z[t]
            dh += p["U"] @ du[t]
        g["U"] = np.matmul(states[:-1], du.transpose(0, 2, 1)).sum(axis=0)
        whole = np.roll(np.matmul(dx, read).sum(axis=0).T, -HIDDEN, axis=1)
        g["W"], g["b"] = whole[:EMBED], whole[EMBED]
        back, codes = np.matmul(np.roll(p["W"], HIDDEN, axis=1), dx), codes.ravel()
        g["E"] = np.empty_like(p["E"])
        for k in range(EMBED):
            g["E"][:, k] = np.bincount(codes, weights=back[:, k].ravel(), minlength=len(p["E"]))
        return g, states[-1].T

    def log10(self, slots: np.ndarray, starts: np.ndarray, lengths: np.ndarray, end: int, counted: np.ndarray) -> np.ndarray:
        """log10 probability of the ``counted`` slots of each sequence (a slice of ``slots``), which follows an end. All go in step, the longest first; the state runs through each to its end."""
        order = np.argsort(-lengths, kind="stable")
        total, turned = np.zeros(len(lengths)), falling(self.p["U"])
        begin, size = starts[order], lengths[order]
        h = np.zeros((HIDDEN, len(order)), np.float32)
        at, last = 0, int(size[0]) if len(size) else 0
        while at < last:
            alive = int(np.searchsorted(-size, -at, side="left"))
            span = min(max(1, 8_192 // alive), 256, last - at)
            where = begin[:alive] + at + np.arange(-1, span)[:, None]
            codes = slots[np.clip(where[:-1], 0, len(slots) - 1)]
            if at == 0:
                codes[0] = end
            table = self.inputs(codes)[1]
            states = np.empty((span, HIDDEN, alive), np.float32)
            inner, new = (np.empty((k * HIDDEN, alive), np.float32) for k in (3, 1))
            h = np.ascontiguousarray(h[:, :alive])
            with np.errstate(over="ignore"):
                for t in range(span):
                    _step(table[t], h, turned, inner, new, states[t])
                    h = states[t]
            inside = np.flatnonzero(np.arange(at, at + span)[:, None] < size[:alive])
            aims = where[1:].ravel()[inside]
            got = np.zeros(span * alive)
            got[inside] = self._output(_rows(states), slots[aims], None, inside)[0] * counted[aims]
            total[order[:alive]] += got.reshape(span, alive).sum(axis=0)
            at += span
        return total / np.log(10)


class Adam:
    """Adam with clipped gradients; its moments last for one pass of one task. Weights go in blocks that caches hold."""

    def __init__(self, pace: float):
        self.pace, self.steps, self.m, self.v = pace, 0, {}, {}

    def move(self, p: dict[str, np.ndarray], grads: dict[str, np.ndarray]) -> None:
        norm = np.sqrt(sum(float(np.vdot(g, g)) for g in grads.values()))
        shrink = np.float32(0.1 * min(1.0, 1.0 / (norm + 1e-9)))
        self.steps += 1
        pace = np.float32(self.pace * np.sqrt(1 - 0.998**self.steps) / (1 - 0.9**self.steps))
        for k, whole in grads.items():
            if k not in self.m:
                self.m[k], self.v[k] = (np.zeros(whole.size, np.float32) for _ in range(2))
            weights, whole = p[k].reshape(-1), whole.reshape(-1)
            for at in range(0, whole.size, BLOCK):
                g, m, v, w = (a[at : at + BLOCK] for a in (whole, self.m[k], self.v[k], weights))
                g *= shrink
                m *= np.float32(0.9)
                m += g
                np.square(g, out=g)
                g *= np.float32(0.2)  # 0.002 of the square before it went down to a tenth
                v *= np.float32(0.998)
                v += g
                np.sqrt(v, out=g)
                g += np.float32(1e-7)
                np.divide(m, g, out=g)
                g *= pace
                w -= g


def _tokens(text: bytes) -> list[bytes]:
    """A text's words, as _cut has them."""
    return text.translate(LOWER_BYTES).split()


_SENT = "chunk long, owner int, hashes binary, counts binary, spelled binary, words binary, docs binary"
_KINDS = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
_WEIGHTS = "part long, tokens long, weights binary"


def _pack(rows: list[tuple], coded: list[np.ndarray]) -> bytes:
    """Ids, folds and lengths of documents, then their words' codes."""
    docs = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.bool_()), pa.array([len(c) for c in coded], pa.int64())], names=["doc_id", "held_out", "words"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, docs.schema) as w:
        w.write_batch(docs)
    head = sink.getvalue().to_pybytes()
    body = np.concatenate(coded).astype("<u4") if coded else np.zeros(0, "<u4")
    planes = body.view(np.uint8).reshape(-1, 4).T.tobytes()  # byte planes compress better
    return len(head).to_bytes(8, "little") + zlib.compress(head + planes, 1)


def _unpack(packed: bytes) -> tuple[pa.RecordBatch, np.ndarray]:
    raw, cut = zlib.decompress(packed[8:]), int.from_bytes(packed[:8], "little")
    return pa.ipc.open_stream(raw[:cut]).read_next_batch(), np.ascontiguousarray(np.frombuffer(raw[cut:], np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _places(words: bytes, slots: Slots) -> np.ndarray:
    """The places of a chunk's distinct words."""
    n = len(words) // 10
    return slots.of(np.frombuffer(words, "<u8", n), np.frombuffer(words, "<u2", n, 8 * n))


def _sequences(docs: pa.RecordBatch, codes: np.ndarray, places: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All documents' places, each followed by an end; the row of every word; where each document stops."""
    words = np.asarray(docs.column("words"))
    rows = np.repeat(np.arange(len(words)), words)
    stops = np.cumsum(words + 1)
    stream = np.full(int(stops[-1]), end, np.int64)
    stream[np.arange(len(codes)) + rows] = places[codes]
    return stream, rows, stops


def _cut(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All texts' words in one array, A-Z lower-cased, and the number of each text's."""
    cut = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words, per = cut.flatten(), pc.list_value_length(cut).to_numpy()
    full = np.not_equal(pc.binary_length(words), 0)  # white space at a text's ends gives empty words
    if not full.all():
        per = np.bincount(np.repeat(np.arange(len(per)), per)[full], minlength=len(per))
        words = words.filter(pa.array(full))
    return words.cast(pa.binary()), per


def _chunker(owners: int):
    def close(chunk, rows, words):
        coded = pa.chunked_array(words, pa.binary()).combine_chunks().dictionary_encode()
        distinct, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        hashes = hash_words(distinct)
        order = np.argsort(hashes, kind="stable")
        place = np.empty(len(order), np.uint32)
        place[order] = np.arange(len(order), dtype=np.uint32)
        codes = place[codes]
        sizes = [n for *_, n in rows]
        learned = np.repeat([not held for _, held, _ in rows], sizes)
        counts = np.bincount(codes[learned], minlength=len(distinct))
        coded = np.split(codes, np.cumsum(sizes)[:-1])
        spelled = spelling(distinct)[order]
        hashes = hashes[order]
        cuts = np.searchsorted(owner_of(hashes, owners), np.arange(owners + 1))
        out = [(chunk, -1, None, None, None, hashes.astype("<u8").tobytes() + spelled.tobytes(), _pack(rows, coded))]
        for o in range(owners):
            a, b = cuts[o], cuts[o + 1]
            if a < b:
                out.append((chunk, o, hashes[a:b].astype("<u8").tobytes(), counts[a:b].astype("<u4").tobytes(), spelled[a:b].tobytes(), None, None))
        out.append((chunk, -2, None, np.array([sum(not r[1] for r in rows)], "<u8").tobytes(), None, None, None))
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), _KINDS, strict=True)], names=["chunk", "owner", "hashes", "counts", "spelled", "words", "docs"])

    def run(batches):
        forget()
        chunk, rows, words, many, size = task_id() * CHUNKS_PER_TASK, [], [], 0, 0
        for whole in batches:
            for b in slices(whole, "text", 4 << 20):
                cut, per = _cut(b.column("text"))
                bytes_of = pc.fill_null(pc.binary_length(b.column("text")), 0).to_pylist()
                first = last = 0  # of the words that are not in a chunk yet
                for doc_id, held, n, long in zip(b.column("doc_id").to_pylist(), b.column("held_out").to_pylist(), per.tolist(), bytes_of, strict=True):
                    rows.append((doc_id, held, n))
                    last, many, size = last + n, many + n, size + long
                    if many >= CHUNK_WORDS or size >= CHUNK_BYTES or len(rows) >= CHUNK_WORDS // 10:
                        yield close(chunk, rows, [*words, cut.slice(first, last - first)])
                        chunk, rows, words, many, size, first = chunk + 1, [], [], 0, 0, last
                words.append(cut.slice(first))
        if rows:
            yield close(chunk, rows, words)

    return run


_ANSWERS = "chunk long, owner int, totals binary, tokens array<long>, top array<struct<hash:long,count:long,spelled:int>>, seen long, once long"
_TOP = pa.list_(pa.struct([("hash", pa.int64()), ("count", pa.int64()), ("spelled", pa.int32())]))


def _totals(table: pa.Table) -> pa.Table:
    """An owner's answers, chunk by chunk, and (at chunk -1) what the model needs: tokens by spelling, its most frequent words, distinct words, words seen once."""
    hashes = [np.frombuffer(x, "<u8") for x in table.column("hashes").to_pylist()]
    counts = np.concatenate([np.frombuffer(x, "<u4") for x in table.column("counts").to_pylist()]).astype(np.float64)
    spelled = np.concatenate([np.frombuffer(x, "<u2") for x in table.column("spelled").to_pylist()])
    every, first, where = np.unique(np.concatenate(hashes), return_index=True, return_inverse=True)
    total = np.bincount(where, weights=counts, minlength=len(every)).astype(np.int64)
    spelled = spelled[first]
    tokens = np.bincount(spelled, weights=total, minlength=SHARED).astype(np.int64)
    order = np.lexsort((every, -total))[:OWN]
    top = [{"hash": h, "count": c, "spelled": s} for h, c, s in zip(every[order].view(np.int64).tolist(), total[order].tolist(), spelled[order].tolist(), strict=True) if c]
    answers = np.split(total[where].astype("<u8"), np.cumsum([len(h) for h in hashes])[:-1])
    chunks, owner, no = table.column("chunk").to_pylist(), table.column("owner")[0].as_py(), [None] * table.num_rows
    columns = [
        pa.array([*chunks, -1], pa.int64()), pa.array([owner] * (len(chunks) + 1), pa.int32()), pa.array([*(zlib.compress(a.tobytes(), 1) for a in answers), None], pa.binary()),
        pa.array([*no, tokens.tolist()], pa.list_(pa.int64())), pa.array([*no, top], _TOP), pa.array([*no, int((total > 0).sum())], pa.int64()), pa.array([*no, int((total == 1).sum())], pa.int64()),
    ]
    return pa.Table.from_arrays(columns, names=["chunk", "owner", "totals", "tokens", "top", "seen", "once"])


def turn_of(chunk: str):
    """The pass in which a chunk is learned: its task's number and its own there, round and round."""
    return F.pmod(F.shiftright(chunk, 24) + F.col(chunk), F.lit(ROUNDS))


def _trainer(flat: bytes, slots: Slots, pace: float):
    """A pass over a task's chunks, from the common weights."""

    def run(batches):
        gru, adam, tokens = Gru().load(np.frombuffer(flat, "<f4")), Adam(pace), 0
        for b in batches:
            for words, packed in zip(b.column("words").to_pylist(), b.column("docs").to_pylist(), strict=True):
                docs, codes = _unpack(packed)
                stream, rows, stops = _sequences(docs, codes, _places(words, slots), slots.end)
                learned = ~np.asarray(docs.column("held_out").to_numpy(zero_copy_only=False))
                stream = stream[np.repeat(learned, np.diff(stops, prepend=0))]
                gru.train(stream, slots.end, adam)
                tokens += len(stream)
        if tokens:
            yield pa.RecordBatch.from_arrays([pa.array([task_id()], pa.int64()), pa.array([tokens], pa.int64()), pa.array([gru.flat().astype("<f4").tobytes()], pa.binary())], names=["part", "tokens", "weights"])

    return run


def _average(batches):
    """One row for all of a task's: weights averaged by tokens, one row in memory at a time."""
    part, tokens, total = None, 0, 0.0
    for b in batches:
        for p, n, w in zip(*(b.column(c).to_pylist() for c in ("part", "tokens", "weights")), strict=True):
            part, tokens, total = p if part is None else part, tokens + n, total + n * np.frombuffer(w, "<f4").astype(np.float64)
    if tokens:
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([tokens], pa.int64()), pa.array([(total / tokens).astype("<f4").tobytes()], pa.binary())], names=["part", "tokens", "weights"])


def train(documents: DataFrame, slots: Slots) -> Gru:
    """The GRU after ROUNDS passes, each over its share of the chunks (chunk, words, docs); tasks' weights meet FAN_IN at a time, and one row reaches the driver a pass."""
    gru = Gru(slots.mass)
    for turn in range(ROUNDS):
        run = _trainer(gru.flat().astype("<f4").tobytes(), slots, PACE * (1 - turn / ROUNDS))
        due = documents.filter(turn_of("chunk") == turn).select("words", "docs")
        parts, rows = due.rdd.getNumPartitions(), due.mapInArrow(run, _WEIGHTS)
        while True:
            parts = -(-parts // FAN_IN)
            rows = rows.repartition(max(1, parts)).sortWithinPartitions("part").mapInArrow(_average, _WEIGHTS)
            if parts <= 1:
                break
        for row in rows.collect():  # one, or none without training documents
            gru.load(np.frombuffer(row["weights"], "<f4"))
    return gru


def _scorer(gru: Gru, slots: Slots, ends: int, train_tokens: int, seen: int, once: int):
    """Rows sorted by chunk: totals in the owners' order, then the documents (owner after all others)."""
    kinds = seen + (ends > 0)
    bottom = np.log10(train_tokens + kinds + 1)
    unknown = (once + 1) / (train_tokens + kinds + 1)
    new, old = np.log10(unknown), np.log10(max(1 - unknown, 1e-300))
    mass = np.log10(np.maximum(slots.mass, 1))

    def run(batches):
        totals: list[np.ndarray] = []
        for b in batches:
            for answer, words, packed in zip(*(b.column(c).to_pylist() for c in ("totals", "words", "docs")), strict=True):
                if packed is None:
                    totals.append(np.frombuffer(zlib.decompress(answer), "<u8"))
                    continue
                count = np.concatenate(totals) if totals else np.zeros(0, "<u8")
                totals = []
                docs, codes = _unpack(packed)
                places = _places(words, slots)
                stream, rows, stops = _sequences(docs, codes, places, slots.end)
                n = len(stops)
                lengths = np.diff(stops, prepend=0)
                per = lambda values: np.bincount(rows, weights=values[codes], minlength=n)
                base = per(np.log10(count + 1.0)) + np.log10(ends + 1.0) - lengths * bottom
                met = count > 0
                known = per(met.astype(np.float64)).astype(np.int64) + (ends > 0)
                within = per(np.where(met, np.log10(np.maximum(count, 1)) - mass[places], 0.0)) if len(places) else np.zeros(n)
                counted = np.full(len(stream), ends > 0)
                counted[np.arange(len(codes)) + rows] = met[codes]
                score = gru.log10(stream, stops - lengths, lengths, slots.end, counted) + within + known * old + (lengths - known) * new
                yield pa.RecordBatch.from_arrays([docs.column("doc_id"), docs.column("held_out"), pa.array(lengths), pa.array(known), pa.array(np.full(n, train_tokens)), pa.array(base), pa.array(score)], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held: int = 2) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Held out are documents with crc32(id as text) mod ``folds`` equal to ``held``; a null id counts as
    the empty text there. Tokens are the text's words (A-Z lower-cased, cut at ASCII white space) and
    one end; null and empty texts are the end alone. Every other document trains the model. Words
    that training lacks are one unknown word each time. A text longer than a chunk is a chunk of its
    own and is held in one task's memory, as words of four bytes. Without training documents
    base_score and score are 0 for each token. Words with equal counts take slots in the order of
    their hashes. Repeated rows are scored alike, other columns are not read whatever their names,
    and an empty table gives an empty result.
    """
    held_out = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds == held
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), held_out.alias("held_out"))
    owners = max(12, rows.rdd.getNumPartitions() // PARTS_PER_OWNER)
    sent = materialize(rows.mapInArrow(_chunker(owners), _SENT), "word-counts")
    answered = sent.filter("owner >= 0").select("chunk", "owner", "hashes", "counts", "spelled").groupBy("owner").applyInArrow(_totals, _ANSWERS)
    answered = materialize(answered, "word-totals")
    stats = answered.filter("chunk = -1")
    top = stats.select(F.explode("top").alias("t")).select("t.*").orderBy(F.desc("count"), "hash").limit(OWN).collect()
    shared = np.zeros(SHARED, np.int64)
    for r in stats.select(F.posexplode("tokens").alias("s", "n")).groupBy("s").agg(F.sum("n").alias("n")).collect():
        shared[r["s"]] = r["n"]
    seen, once = (int(x or 0) for x in stats.agg(F.sum("seen"), F.sum("once")).first())
    ends = int(sent.filter("owner = -2").select(_little_endian("counts").alias("n")).agg(F.sum("n")).first()[0] or 0)
    slots = arrange([(r["hash"] % (1 << 64), r["count"], r["spelled"]) for r in top], shared, ends)
    documents = sent.filter("owner = -1")
    gru = train(documents.select("chunk", "words", "docs"), slots)
    last, no = F.lit((1 << 31) - 1), F.lit(None).cast("binary")
    asked = documents.select("chunk", last.alias("owner"), no.alias("totals"), "words", "docs")
    replies = answered.filter("chunk >= 0").select("chunk", "owner", "totals", no.alias("words"), no.alias("docs"))
    ordered = replies.unionByName(asked).repartition("chunk").sortWithinPartitions("chunk", "owner")
    scorer = _scorer(gru, slots, ends, int(shared.sum()) + ends, seen, once)
    return ordered.mapInArrow(scorer, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def _little_endian(column: str):
    """Eight bytes, lowest first, as a long."""
    h = F.hex(column)
    return F.conv(F.concat(*(F.substring(h, 2 * i + 1, 2) for i in reversed(range(8)))), 16, 10).cast("long")
