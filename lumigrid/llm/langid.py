"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A letter n-gram is bound by multiplying its
letters' vectors, each permuted (rotated) by its place; a document is the bundle (sum) of its
n-grams' vectors. A language's prototype bundles the unit vectors of all its labelled documents.
Documents and prototypes are compared by cosine after taking away the languages' common mean.
The best of those is never negative, so it can't tell that a text is in no learned language: for
that the plain cosine is held against what the language's own labelled texts reach.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, slices, tidy
from .words import forget

DIMENSIONS, GRAM, SEED = 512, 3, 20_240
#: Letter codes: 0 is a word's edge, letters share LETTERS codes by code point.
LETTERS = 251
#: n-grams whose vectors a task keeps at once (places are 16-bit numbers).
KEPT_GRAMS = 24_000
UNKNOWN = "und"
#: How much a difference in cosine weighs in the score.
SHARPNESS = 12.0
#: At fewer n-grams than this a document counts only in part towards its prototype.
FULL_GRAMS = 200
#: Bins for cosines from -1 to 1, and bands (powers of two) for the variety of n-grams.
BINS, BANDS = 400, 24
#: Labelled texts that a limit needs.
LEAST_TEXTS = 20


class Encoder:
    def __init__(self, dimensions: int = DIMENSIONS, seed: int = SEED):
        self.base = np.random.default_rng(seed).choice(np.array([-1.0, 1.0], np.float32), size=(LETTERS + 1, dimensions))
        self.turned = [np.roll(self.base, GRAM - 1 - place, axis=1) for place in range(GRAM)]
        self.code = np.full(0x110000, -1, np.int16)
        self.vectors = np.empty((KEPT_GRAMS, dimensions), np.float32)
        self._forget()

    def _forget(self):
        self.known = np.full((LETTERS + 1) ** GRAM, -1, np.int16)
        self.kept = 0

    def _codes(self, text: str) -> np.ndarray:
        points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
        codes = self.code[points]
        if len(codes) and codes.min() < 0:
            for p in np.unique(points[codes < 0]).tolist():
                self.code[p] = 1 + p % LETTERS if chr(p).isalpha() else 0
            codes = self.code[points]
        return codes

    def _ids(self, keys: np.ndarray) -> np.ndarray:
        ids = self.known[keys]
        if ids.min() < 0:
            new = np.unique(keys[ids < 0])
            if self.kept + len(new) > KEPT_GRAMS:
                self._forget()
                new = np.unique(keys)
            vectors = np.ones((len(new), self.base.shape[1]), np.float32)
            for place in range(GRAM):
                vectors *= self.turned[place][new // (LETTERS + 1) ** (GRAM - 1 - place) % (LETTERS + 1)]
            self.known[new] = np.arange(self.kept, self.kept + len(new))
            self.vectors[self.kept : self.kept + len(new)] = vectors
            self.kept += len(new)
            ids = self.known[keys]
        return ids

    def __call__(self, text: str) -> tuple[np.ndarray, int]:
        """The bundle of a whole text, and its number of n-grams; 0 if it has no letter."""
        return self.profile(text)[:2]

    def profile(self, text: str) -> tuple[np.ndarray, int, float]:
        """Also how many equally frequent n-grams would be as varied: repeating a text adds none."""
        codes = self._codes(text)
        keep = codes > 0
        if not keep.any():
            return np.zeros(self.base.shape[1], np.float32), 0, 0.0
        keep[1:] |= codes[:-1] > 0  # one edge after each word
        codes = np.concatenate([[0], codes[keep], [0]]).astype(np.int64)
        keys = (codes[:-2] * (LETTERS + 1) + codes[1:-1]) * (LETTERS + 1) + codes[2:]
        if len(keys) > KEPT_GRAMS // 2:  # a long text may have more n-grams than are kept: in parts
            found, counts = np.unique(keys, return_counts=True)
            out = np.zeros(self.base.shape[1], np.float32)
            for i in range(0, len(found), KEPT_GRAMS // 2):
                part = self._ids(found[i : i + KEPT_GRAMS // 2])
                out += counts[i : i + KEPT_GRAMS // 2].astype(np.float32) @ self.vectors[part]
            return out, len(keys), _variety(counts)
        ids, counts = np.unique(self._ids(keys), return_counts=True)
        return counts.astype(np.float32) @ self.vectors[ids], len(keys), _variety(counts)


def _variety(counts: np.ndarray) -> float:
    c = counts.astype(np.float64)
    return float(c.sum() ** 2 / (c * c).sum())


def _band(variety: np.ndarray) -> np.ndarray:
    return np.log2(np.maximum(variety, 1)).astype(np.int64).clip(0, BANDS - 1)


def _unit(v: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(v, axis=-1, keepdims=True)
    return np.divide(v, n, out=np.zeros_like(v), where=n > 0)


def _bundler(dimensions: int):
    def run(batches):
        forget()
        encoder, sums = Encoder(dimensions), {}
        for whole in batches:
            for b in slices(whole, "text"):
                for text, lang in zip(b.column("text").to_pylist(), b.column("lang").to_pylist(), strict=True):
                    vector, grams = encoder(text or "")
                    if grams:
                        sums.setdefault(lang, np.zeros(dimensions))
                        sums[lang] += _unit(vector) * min(1.0, grams / FULL_GRAMS)
        if sums:
            del encoder
            tidy()
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([v.round(6).tolist() for v in sums.values()], pa.list_(pa.float64()))], names=["lang", "bundle"])

    return run


def learn_prototypes(labelled: DataFrame, dimensions: int = DIMENSIONS) -> tuple[list[str], np.ndarray]:
    """Languages and their prototypes from every row of (text, lang) with a non-null lang. What reaches the driver is one vector per language."""
    bundles = labelled.filter("lang is not null").mapInArrow(_bundler(dimensions), "lang string, bundle array<double>")
    places = bundles.select("lang", F.posexplode("bundle").alias("place", "value"))
    # decimal sums do not depend on the order in which tasks finish
    sums = places.groupBy("lang", "place").agg(F.sum(F.col("value").cast("decimal(28,6)")).cast("double").alias("value"))
    rows = sums.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("place", "value"))).alias("bundle")).orderBy("lang").collect()
    return [r["lang"] for r in rows], np.array([[x["value"] for x in r["bundle"]] for r in rows]).reshape(len(rows), dimensions)


_PREDICTED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64()), ("cosine", pa.float64()), ("grams", pa.int64())])


def _predictor(langs: list[str], prototypes: np.ndarray, dimensions: int):
    units = _unit(prototypes)
    mean = units.mean(axis=0) if len(langs) > 1 else np.zeros(dimensions)
    aims = _unit(units - mean)

    def run(batches):
        forget()
        encoder = Encoder(dimensions)
        for whole in batches:
            for b in slices(whole, "text"):
                texts = b.column("text").to_pylist()
                bundles = [encoder(t or "") for t in texts]
                grams = np.array([g for _, g in bundles])
                units = _unit(np.stack([v for v, _ in bundles]).astype(np.float64))
                plain = _unit(units - mean) @ aims.T
                if langs:
                    weight = np.exp(SHARPNESS * (plain - plain.max(axis=1, keepdims=True)))
                    best = plain.argmax(axis=1)
                    score = 1.0 / weight.sum(axis=1)
                    cosine = np.take_along_axis(plain, best[:, None], axis=1)[:, 0]
                else:
                    best, score, cosine = np.zeros(len(texts), int), np.zeros(len(texts)), np.zeros(len(texts))
                found = (grams > 0) & (len(langs) > 0)
                yield batch(_PREDICTED, b.column("doc_id"), b.column("held_out"), [langs[i] if f else UNKNOWN for i, f in zip(best, found, strict=True)], np.where(found, score, 0.0), np.where(found, cosine, 0.0), grams)
        del encoder
        tidy()

    return run


def _measurer(langs: list[str], prototypes: np.ndarray, dimensions: int):
    """Labelled texts' cosines to each prototype as histograms. A text's own share of its language's prototype is taken out first."""
    place, aims = {x: i for i, x in enumerate(langs)}, _unit(prototypes)

    def run(batches):
        forget()
        encoder, found = Encoder(dimensions), np.zeros((len(langs), BANDS, 2, BINS), np.int64)
        for whole in batches:
            for b in slices(whole, "text"):
                rows = [(*encoder.profile(t or ""), place[x]) for t, x in zip(b.column("text").to_pylist(), b.column("lang").to_pylist(), strict=True) if x in place]
                rows = [r for r in rows if r[1]]
                if not rows:
                    continue
                units, own = _unit(np.stack([r[0] for r in rows]).astype(np.float64)), np.array([r[3] for r in rows])
                share = np.minimum(1.0, np.array([r[1] for r in rows]) / FULL_GRAMS)
                cosines = units @ aims.T
                others = _unit(prototypes[own] - units * share[:, None])
                cosines[np.arange(len(rows)), own] = (units * others).sum(axis=1)
                bands, bins = _band(np.array([r[2] for r in rows])), _bin(cosines)
                for i in range(len(langs)):
                    np.add.at(found[i], (bands, (own == i).astype(int), bins[:, i]), 1)
        del encoder
        tidy()
        at = np.nonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (*at, found[at])], names=["lang", "band", "own", "bin", "n"])

    return run


def _bin(cosines: np.ndarray) -> np.ndarray:
    return ((cosines + 1) * (BINS / 2)).astype(np.int64).clip(0, BINS - 1)


def _median(histogram: np.ndarray) -> float:
    return (int(np.searchsorted(histogram.cumsum(), histogram.sum() / 2)) + 0.5) * 2 / BINS - 1


def learn_limits(labelled: DataFrame, langs: list[str], prototypes: np.ndarray, least_texts: int = LEAST_TEXTS, dimensions: int = DIMENSIONS) -> np.ndarray:
    """The least plain cosine of a text by language and band of variety, from every row of (text, lang).

    It lies midway between the medians of the language's own texts and of all others'. A band of fewer
    than ``least_texts`` own texts takes in the bands below it, whose cosines are lower; where even
    those don't suffice, nothing is known and the limit is -1. What reaches the driver is counts.
    """
    counted = labelled.filter("lang is not null").mapInArrow(_measurer(langs, prototypes, dimensions), "lang long, band long, own long, bin long, n long")
    found = np.zeros((len(langs), BANDS, 2, BINS), np.int64)
    for r in counted.groupBy("lang", "band", "own", "bin").agg(F.sum("n").alias("n")).collect():
        found[r["lang"], r["band"], r["own"], r["bin"]] = r["n"]
    limits = np.full((len(langs), BANDS), -1.0)
    for i in range(len(langs)):
        for band in range(BANDS):
            for low in range(band, -1, -1):
                others, own = found[i, low : band + 1].sum(axis=0)
                if own.sum() >= least_texts:
                    limits[i, band] = (_median(own) + (max(0.0, _median(others)) if others.any() else 0.0)) / 2
                    break
    return limits


def _keeper(langs: list[str], prototypes: np.ndarray, limits: np.ndarray, dimensions: int, text: int):
    """Keeps a text if it reaches any language's limit."""
    aims = _unit(prototypes)

    def run(batches):
        forget()
        encoder = Encoder(dimensions)
        for whole in batches:
            for b in slices(whole, whole.schema.names[text]):
                vectors, grams, variety = zip(*(encoder.profile(t or "") for t in b.column(text).to_pylist()), strict=True)
                cosines = _unit(np.stack(vectors).astype(np.float64)) @ aims.T
                near = (cosines >= limits[:, _band(np.array(variety))].T).any(axis=1)
                yield b.filter(pa.array((np.array(grams) > 0) & near))
        del encoder
        tidy()

    return run


def drop_unidentified(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least_texts: int = LEAST_TEXTS, dimensions: int = DIMENSIONS) -> DataFrame:
    """``docs`` without what is in no learned language, columns unchanged.

    Prototypes and limits come from all rows with a non-null lang. Rejected are texts without a letter
    (null and empty ones too), and texts of any length whose plain cosine is below every language's
    limit for texts as varied (see ``learn_limits``). If no row has a lang, nothing can be learned and
    only the first rule holds. Null ids and repeated rows are judged like others, by their text; an
    empty table stays empty.
    """
    text, lang = docs.columns.index(text_col), docs.columns.index(lang_col)
    flat = docs.toDF(*(f"c{i}" for i in range(len(docs.columns)))).withColumn(f"c{text}", F.col(f"c{text}").cast("string"))
    labelled = flat.select(F.col(f"c{text}").alias("text"), F.col(f"c{lang}").cast("string").alias("lang"))
    langs, prototypes = learn_prototypes(labelled, dimensions)
    if not langs:
        kept = flat.filter(F.col(f"c{text}").rlike(r"\p{L}"))
    else:
        limits = learn_limits(labelled, langs, prototypes, least_texts, dimensions)
        kept = flat.mapInArrow(_keeper(langs, prototypes, limits, dimensions, text), flat.schema)
    return kept.toDF(*docs.columns)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 3, held: int = 1, dimensions: int = DIMENSIONS) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, cosine, grams.

    Documents with crc32(id as text) mod ``folds`` equal to ``held`` are held out; the prototypes come
    from all others with a non-null lang. ``folds`` 1 with ``held`` -1 learns from all. The prediction
    is ``und`` with score 0 if the text is null or has no letter, or nothing could be learned. A null
    id counts as empty text in the checksum. Equal cosines go to the language that sorts first, and
    repeated rows are predicted alike. Whole texts are read, however long, in pieces; other columns are not,
    whatever their names. An empty table gives an empty result.
    """
    held_out = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds == held
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"), held_out.alias("held_out"))
    langs, prototypes = learn_prototypes(rows.filter("not held_out").select("text", "lang"), dimensions)
    return rows.select("doc_id", "text", "held_out").mapInArrow(_predictor(langs, prototypes, dimensions), "doc_id long, held_out boolean, lang_pred string, score double, cosine double, grams long")
