"""Near deduplication with bottom-k sketches from one hash function.

1. A document's set of word shingles is hashed once; its k smallest values are its sketch.
   Documents with the same set become one node.
2. Two sets at the threshold share at least ``need`` of k sketch values but for a chance of
   MISS. So a node is listed only under its rarest shared values, as many as leave fewer than
   ``need`` (the prefix principle); values that many documents share are hardly ever used.
3. Nodes that lists connect form clusters: linked nodes are always in one cluster. A cluster is
   cut into blocks, and every two blocks meet in one place. There the estimate from the union's
   sketch filters, exact Jaccard on the full sets confirms, and only a spanning forest of the
   links leaves, so no pairs are ever written out.
4. Links make the components.
"""

from __future__ import annotations

import hashlib
from fractions import Fraction
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, LOWER_BYTES, batch, materialize, slices, task_id, tidy, utf8
from .graph import components
from .words import forget

SKETCH = 48
#: Chance at most that a link just at the threshold stays unseen.
MISS = 1e-6
#: Nodes, and shingles, that make up a block. A cluster's texts are sent once for each of its blocks, so small blocks cost disk.
BLOCK_NODES, BLOCK_SHINGLES = 1_024, 1_500_000
#: Candidates, for each node of two blocks, that are confirmed one by one before the rest go by matrix products over so many cells at a time.
DIRECT, SLICE_CELLS = 8, 8 << 20
ROWS_PER_TASK = 1 << 36
_ODD = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def _mix(z: np.ndarray) -> np.ndarray:
    z = (z ^ (z >> np.uint64(30))) * _ODD[1]
    z = (z ^ (z >> np.uint64(27))) * _ODD[2]
    return z ^ (z >> np.uint64(31))


def shingles(text: bytes, words: int) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's word shingles; of all its words if they are fewer; none without words."""
    found = text.translate(LOWER_BYTES).split()
    if not found:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    width = min(words, len(h))
    out = np.full(len(h) - width + 1, width, np.uint64)
    for i in range(width):
        out = _mix(out * _ODD[0] + h[i : len(h) - width + 1 + i])
    return np.unique(out)


def needed(k: int, at_least: Fraction, miss: float = MISS) -> int:
    """The largest count that fewer sketch values than that are shared at the threshold with a chance of ``miss`` at most."""
    p, chance = float(at_least), 0.0
    for n in range(k + 1):
        chance += comb(k, n) * p**n * (1 - p) ** (k - n)
        if chance > miss:
            return n
    return k


_SETS = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("rid", pa.int64()), ("n", pa.int64()), ("same", pa.binary()), ("sketch", pa.list_(pa.int64()))])


def _sketcher(words: int, k: int):
    def run(batches):
        forget()
        rid = task_id() * ROWS_PER_TASK
        for whole in batches:
            for b in slices(whole, "text"):
                sets = [shingles(t, words) for t in utf8(b.column("text"))]
                same = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                # the hashes are even already, so their smallest as signed numbers serve as well as any
                sketch = [np.sort(s.view(np.int64))[:k] for s in sets]
                yield batch(_SETS, b.column("doc_id"), b.column("text"), np.arange(rid, rid + len(sets)), [len(s) for s in sets], same, sketch)
                rid += len(sets)

    return run


def _fits(df: DataFrame, row_bytes: int) -> DataFrame:
    """Marked for broadcasting if its counted rows are within the bound; else the join shuffles."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def _common(sets: list[np.ndarray], pairs: np.ndarray) -> np.ndarray:
    """Sizes of intersections: pair by pair if they are few, else by matrix products over slices of the values."""
    if len(pairs) <= len(sets):
        return np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in pairs])
    values, where, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    place = np.full(len(values), -1)
    place[counts > 1] = np.arange((counts > 1).sum())  # only values of several sets are common to any
    column, owner = place[where], owner[place[where] >= 0]
    column = column[column >= 0]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    total, columns = np.zeros((len(sets), len(sets)), np.float32), max(1, SLICE_CELLS // len(sets))
    for start in range(0, int((counts > 1).sum()), columns):
        a, b = np.searchsorted(column, [start, start + columns])
        part = np.zeros((len(sets), columns), np.float32)
        part[owner[a:b], column[a:b] - start] = 1
        total += part @ part.T
    return total[pairs[:, 0], pairs[:, 1]].astype(np.int64)


def _overlaps(one: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Sizes of one sorted set's intersections with others, none of them empty."""
    values = np.concatenate(others)
    hits = one[np.minimum(np.searchsorted(one, values), len(one) - 1)] == values
    return np.add.reduceat(hits, np.cumsum([0] + [len(s) for s in others[:-1]]), dtype=np.int64)


def block_links(sets: list[np.ndarray], sides: np.ndarray, two: bool, k: int, need: int, at_least: Fraction) -> list[tuple[int, int]]:
    """A spanning forest of the links inside a block, or between two blocks if ``two``. Nodes that links found so far connect are not compared again."""
    sizes = np.array([len(s) for s in sets])
    above, below = at_least.numerator, at_least.denominator
    sketches = [np.sort(s.view(np.int64))[:k] for s in sets]
    values, where = np.unique(np.concatenate(sketches), return_inverse=True)
    lengths = np.array([len(s) for s in sketches])
    ranks = np.full((len(sets), k), len(values))  # a row's sketch as ranks among all values
    ranks[np.arange(k) < lengths[:, None]] = where
    comp, out, later, direct = np.arange(len(sets)), [], [], DIRECT * len(sets)

    def join(i, j):
        if comp[i] != comp[j]:
            comp[comp == comp[j]] = comp[i]
            out.append((int(i), int(j)))

    def enough(i, j, both):
        return below * both >= above * (sizes[i] + sizes[j] - both)

    for i in range(len(sets) - 1):
        rest = slice(i + 1, len(sets))
        fit = (comp[rest] != comp[i]) & (sizes[rest] * below >= sizes[i] * above) & (sizes[i] * below >= sizes[rest] * above)
        if two:
            fit &= sides[rest] != sides[i]
        others = np.flatnonzero(fit) + i + 1
        if not len(others):
            continue
        mine = np.zeros(len(values) + 1, np.int16)
        mine[ranks[i, : lengths[i]]] = 1
        shared = mine[ranks[others]]
        held = np.minimum(lengths[others] + lengths[i] - shared.sum(axis=1), k)
        least = np.minimum(need, -(-held * above // below))
        can = shared.sum(axis=1) >= least
        others, shared, least = others[can], shared[can], least[can]
        place = np.cumsum(mine)[ranks[others]] + np.arange(1, k + 1) - np.cumsum(shared, axis=1)  # among the union's values
        others = others[(shared * (place <= k)).sum(axis=1) >= least]  # by the union's sketch
        if not len(others):
            continue
        if direct <= 0:
            later.append(np.column_stack([np.full(len(others), i), others]))
            continue
        direct -= len(others)
        for j in others[enough(i, others, _overlaps(sets[i], [sets[j] for j in others]))]:
            join(i, j)
    pairs = np.concatenate(later) if later else np.zeros((0, 2), int)
    pairs = pairs[comp[pairs[:, 0]] != comp[pairs[:, 1]]]
    if len(pairs):
        for i, j in pairs[enough(pairs[:, 0], pairs[:, 1], _common(sets, pairs))]:
            join(i, j)
    return out


def _verifier(words: int, k: int, need: int, at_least: Fraction):
    """Rows sorted by (cluster, lo, hi): the links of each two blocks."""

    def run(batches):
        key, rids, sides, sets = None, [], [], []

        def close():
            links = block_links(sets, np.array(sides), key[1] != key[2], k, need, at_least) if len(sets) > 1 else []
            if links:
                yield pa.RecordBatch.from_arrays([pa.array([rids[i] for i, _ in links], pa.int64()), pa.array([rids[j] for _, j in links], pa.int64())], names=["a", "b"])

        for whole in batches:
            for b in slices(whole, "text"):
                for cluster, lo, hi, side, rid, text in zip(*(b.column(c).to_pylist() for c in ("cluster", "lo", "hi", "side", "rid")), utf8(b.column("text")), strict=True):
                    if key != (cluster, lo, hi):
                        yield from close() if key else ()
                        key, rids, sides, sets = (cluster, lo, hi), [], [], []
                    rids.append(rid)
                    sides.append(side)
                    sets.append(shingles(text, words))
        yield from close() if key else ()
        tidy()

    return run


def _lists(sketches: DataFrame, k: int, need: int, at_least: Fraction) -> DataFrame:
    """(value, rid): each node under its rarest shared values. Sets that fit a sketch whole, and whose partners do, need their exact overlap."""
    each = sketches.select("rid", "n", F.explode("sketch").alias("value"))
    shared = each.groupBy("value").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    rows = each.join(shared, "value").groupBy("rid", "n").agg(F.sort_array(F.collect_list(F.struct("df", "value"))).alias("held"))
    exact = F.ceil(F.col("n") * at_least.numerator / F.lit(at_least.denominator) - F.lit(1e-9)).cast("int")
    least = F.when(F.col("n") <= int(k * at_least), exact).otherwise(F.least(exact, F.lit(need)))
    over = F.size("held") - least + 1
    return rows.filter(over >= 1).select("rid", F.explode(F.slice("held", 1, over)).alias("h")).select(F.col("h.value").alias("value"), "rid")


def near_groups(docs: DataFrame, words: int = 5, at_least: Fraction = Fraction(4, 5), k: int = SKETCH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Linked are documents whose sets of distinct ``words``-word shingles (A-Z lower-cased, cut at
    ASCII white space) have a Jaccard similarity of ``at_least`` or more; component_id is the
    smallest doc_id reachable over links. With fewer words all of them are one shingle; null, empty
    or blank texts have none and link with nothing. Repeated rows link with each other. A row with
    a null doc_id takes part in links but never names a component; alone, its component is null and
    it is kept. Every shingle of a text counts, however long it is; a block holds BLOCK_SHINGLES or one
    text. Other columns are not read, whatever their names. An empty table gives an empty result.
    """
    need = needed(k, at_least)
    flat = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sets = materialize(flat.mapInArrow(_sketcher(words, k), "doc_id long, text string, rid long, n long, same binary, sketch array<long>"), "sets")
    nodes = materialize(sets.filter("n > 0").groupBy("same").agg(F.min("rid").alias("rid"), F.min("doc_id").alias("first_id")), "nodes")
    small = sets.select("rid", "n", "sketch").join(_fits(nodes.select("rid"), 8), "rid", "left_semi")
    lists = materialize(_lists(small, k, need, at_least), "lists")

    heads = lists.groupBy("value").agg(F.min("rid").alias("a"))
    clusters = components(materialize(lists.join(heads, "value").where("rid > a").select("a", F.col("rid").alias("b")).distinct(), "listed"))
    members = clusters.select(F.col("node").alias("rid"), F.col("comp").alias("cluster")).join(sets.select("rid", "n"), "rid")
    blocks = members.groupBy("cluster").agg(F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK_NODES, F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    placed = materialize(members.join(blocks, "cluster").select("rid", "cluster", "blocks", F.pmod(F.xxhash64("rid"), F.col("blocks")).cast("int").alias("side")), "blocks")
    texts = sets.select("rid", "text").join(_fits(placed, 24), "rid")
    met = texts.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("cluster", F.least("side", "other").alias("lo"), F.greatest("side", "other").alias("hi"), "side", "rid", "text")
    met = met.repartition("cluster", "lo", "hi").sortWithinPartitions("cluster", "lo", "hi")
    links = materialize(met.mapInArrow(_verifier(words, k, need, at_least), "a long, b long"), "links")
    comps = components(links)

    smallest = nodes.join(comps, nodes.rid == comps.node).groupBy("comp").agg(F.min("first_id").alias("component_id"))
    named = comps.join(smallest, "comp").select(F.col("node").alias("rid"), "component_id")
    named = nodes.join(named, "rid", "left").select("same", F.coalesce("component_id", "first_id").alias("component_id"))
    out = sets.select("doc_id", "n", "same").join(named, "same", "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, component.isNull()).alias("kept"))


def drop_near_copies(docs: DataFrame, words: int = 5, at_least: Fraction = Fraction(4, 5), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each group, columns unchanged. Rows with a null id stay."""
    gone = near_groups(docs, words, at_least, id_col=id_col, text_col=text_col).filter("not kept and doc_id is not null").select(F.col("doc_id").alias("lg_gone")).distinct()
    return docs.join(gone, F.col(id_col).cast("long") == F.col("lg_gone"), "left_anti")
