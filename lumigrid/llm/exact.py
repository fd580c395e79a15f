"""Exact deduplication by a Golomb-coded fingerprint exchange.

1. Each task cuts its rows into chunks, hashes every normalised text, and codes each chunk's
   sorted distinct 64-bit fingerprints as Golomb-Rice differences, one row per chunk and owner
   (a range of fingerprints).
2. Each owner decodes what it was sent and answers every chunk with a bitmap over that chunk's
   fingerprints: which of them exist elsewhere too.
3. Rows whose bit is clear are unique and go no further. Only suspects are shuffled: their texts
   are compared byte for byte, after combining inside each task, so that a text that a third of
   all rows hold arrives once per task.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, LOWER, LOWER_BYTES, UPPER, materialize, task_id, tidy, utf8
from .words import forget

CHUNK_ROWS, CHUNK_BYTES = 32_768, 32 << 20
#: A chunk's id is its task's number times this plus its number there.
CHUNKS_PER_TASK = 1 << 24


def golomb_encode(values: np.ndarray) -> bytes:
    """Sorted distinct uint64 as Golomb-Rice coded differences: a head, all unary quotients, all remainders."""
    n = len(values)
    if not n:
        return b""
    gaps = np.diff(values, prepend=np.uint64(0))
    mean = float(values[-1]) / n
    rest = int(min(63, max(0, np.floor(np.log2(max(1.0, mean * 0.6931471805599453))))))
    high = gaps >> np.uint64(rest)
    unary = np.zeros(int(high.sum()) + n, np.uint8)
    unary[np.cumsum(high.astype(np.int64) + 1) - 1] = 1
    low = ((gaps[:, None] >> np.arange(rest, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
    return np.array([n, len(unary)], "<u4").tobytes() + bytes([rest]) + np.packbits(unary).tobytes() + np.packbits(low).tobytes()


def golomb_decode(data: bytes) -> np.ndarray:
    if not data:
        return np.zeros(0, np.uint64)
    n, bits = (int(x) for x in np.frombuffer(data, "<u4", 2))
    rest, at = data[8], 9 + -(-bits // 8)
    high = np.diff(np.flatnonzero(np.unpackbits(np.frombuffer(data[9:at], np.uint8), count=bits)), prepend=-1).astype(np.uint64) - np.uint64(1)
    low = np.unpackbits(np.frombuffer(data[at:], np.uint8), count=n * rest).reshape(n, rest).astype(np.uint64)
    return np.cumsum((high << np.uint64(rest)) + (low << np.arange(rest, dtype=np.uint64)).sum(axis=1, dtype=np.uint64), dtype=np.uint64)


def owner_of(prints: np.ndarray, owners: int) -> np.ndarray:
    """Owners hold consecutive ranges, so sorted fingerprints have sorted owners."""
    return ((prints >> np.uint64(32)) * np.uint64(owners) >> np.uint64(32)).astype(np.int32)


def _words(flags: np.ndarray) -> list[int]:
    """Bits as signed 64-bit words, lowest bit first."""
    full = np.zeros(-(-len(flags) // 64) * 64, np.uint8)
    full[: len(flags)] = flags
    return np.packbits(full, bitorder="little").view("<i8").tolist()


def _fingerprinter(text: int, owners: int, schema: pa.Schema):
    """Adds digest, chunk, owner, rank and rid to every row and a row of codes for each chunk and owner. text: the position of the text column."""

    def close(parts, chunk):
        table = pa.Table.from_batches(parts).combine_chunks()
        rows = table.num_rows
        digests = [hashlib.sha256(t.translate(LOWER_BYTES)).digest() for t in utf8(table.column(text))]
        prints = np.frombuffer(b"".join(d[:8] for d in digests), ">u8").astype(np.uint64)
        sorted_, where, counts = np.unique(prints, return_inverse=True, return_counts=True)
        owner = owner_of(sorted_, owners)
        present, first, held = np.unique(owner, return_index=True, return_counts=True)
        rank = np.arange(len(sorted_)) - np.repeat(first, held)
        no = lambda k, n: pa.nulls(n, schema.field(k).type)
        out = list(table.columns) + [pa.array(digests, pa.binary()), pa.array(np.full(rows, chunk)), pa.array(owner[where]), pa.array(rank[where].astype(np.int32)), pa.array(chunk * CHUNK_ROWS + np.arange(rows)), no("lg_codes", rows), no("lg_again", rows)]
        yield from pa.Table.from_arrays(out, schema=schema).to_batches()
        n = len(present)
        codes = [golomb_encode(sorted_[a : a + m]) for a, m in zip(first, held, strict=True)]
        again = [np.packbits(counts[a : a + m] > 1).tobytes() for a, m in zip(first, held, strict=True)]
        out = [no(i, n) for i in range(len(table.columns))] + [no("lg_digest", n), pa.array(np.full(n, chunk)), pa.array(present), no("lg_rank", n), no("lg_rid", n), pa.array(codes, pa.binary()), pa.array(again, pa.binary())]
        yield from pa.Table.from_arrays(out, schema=schema).to_batches()

    def run(batches):
        forget()
        chunk, parts, rows, size = task_id() * CHUNKS_PER_TASK, [], 0, 0
        for whole in batches:
            at = 0
            while at < whole.num_rows:
                b = whole.slice(at, min(CHUNK_ROWS - rows, 2048))
                at += b.num_rows
                parts.append(b)
                rows += b.num_rows
                size += b.get_total_buffer_size() * b.num_rows // max(1, whole.num_rows)
                if rows >= CHUNK_ROWS or size >= CHUNK_BYTES:
                    yield from close(parts, chunk)
                    chunk, parts, rows, size = chunk + 1, [], 0, 0
        if parts:
            yield from close(parts, chunk)
            parts.clear()
        tidy()

    return run


def _answer(table: pa.Table) -> pa.Table:
    """An owner's bitmaps: for every chunk that sent fingerprints, which of them occur more than once anywhere."""
    sent = [golomb_decode(x) for x in table.column("lg_codes").to_pylist()]
    every, where = np.unique(np.concatenate(sent), return_inverse=True)
    counts = np.bincount(where, minlength=len(every))
    again = np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=len(s)) for x, s in zip(table.column("lg_again").to_pylist(), sent, strict=True)])
    counts += np.bincount(where, weights=again, minlength=len(every)).astype(counts.dtype)
    flags = np.split(counts[where] > 1, np.cumsum([len(s) for s in sent])[:-1])
    keep = pa.array([i for i, f in enumerate(flags) if f.any()], pa.int64())
    return pa.table({"lg_chunk": table.column("lg_chunk").take(keep), "lg_owner": table.column("lg_owner").take(keep), "lg_bits": pa.array([_words(flags[i]) for i in keep.to_pylist()], pa.list_(pa.int64()))})


def _suspect_parts(rows: DataFrame, bitmaps: DataFrame, most_bytes: int) -> DataFrame:
    """The rows with their bit. Bitmaps are broadcast in blocks of at most ``most_bytes`` (or one task's own), each against its own tasks' rows."""
    sizes = bitmaps.groupBy(F.shiftright("lg_chunk", 24).alias("task")).agg((F.sum(F.size("lg_bits") + 4) * 8).alias("size")).orderBy("task").collect()  # a row per task, like the scheduler's own table
    cuts, held = [], 0
    for r in sizes:
        if held and held + r["size"] > most_bytes:
            cuts.append(r["task"] * CHUNKS_PER_TASK)
            held = 0
        held += r["size"]
    out = None
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):
        a, b = rows, bitmaps
        for bound, over in ((low, True), (high, False)):
            if bound is not None:
                a, b = (x.filter(F.col("lg_chunk") >= bound if over else F.col("lg_chunk") < bound) for x in (a, b))
        word = F.element_at("lg_bits", F.expr("cast(shiftright(lg_rank, 6) + 1 as int)"))
        bit = F.coalesce(F.expr("lg_word >> (lg_rank & 63) & 1") == 1, F.lit(False))
        part = a.join(F.broadcast(b), ["lg_chunk", "lg_owner"], "left").withColumn("lg_word", word).withColumn("lg_suspect", bit).drop("lg_bits", "lg_word")
        out = part if out is None else out.unionByName(part)
    return out


def mark_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owners: int | None = None, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Every row of ``docs``, its columns named c0, c1, ... in their order, with lg_id, lg_keep_id, lg_group_size, lg_kept and lg_digest.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. The row with the
    largest id stays (null ids sort lowest; among repeated rows with that id exactly one stays).
    Renaming keeps any column names from clashing. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    names = [f"c{i}" for i in range(len(docs.columns))]
    text, key = (names[docs.columns.index(c)] for c in (text_col, id_col))
    flat = docs.toDF(*names).withColumn(text, F.col(text).cast("string"))
    owners = owners or max(16, min(4096, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    extra = "lg_digest binary, lg_chunk long, lg_owner int, lg_rank int, lg_rid long, lg_codes binary, lg_again binary"
    schema = ", ".join(f"{n} {t}" for n, t in flat.dtypes) + ", " + extra
    arrow = pa.schema([*_arrow_schema(flat), ("lg_digest", pa.binary()), ("lg_chunk", pa.int64()), ("lg_owner", pa.int32()), ("lg_rank", pa.int32()), ("lg_rid", pa.int64()), ("lg_codes", pa.binary()), ("lg_again", pa.binary())])
    stored = materialize(flat.mapInArrow(_fingerprinter(names.index(text), owners, arrow), schema), "fingerprints")
    codes = stored.filter("lg_codes is not null").select("lg_chunk", "lg_owner", "lg_codes", "lg_again")
    bitmaps = materialize(codes.groupBy("lg_owner").applyInArrow(_answer, "lg_chunk long, lg_owner int, lg_bits array<long>"), "bitmaps")
    rows = stored.filter("lg_rid is not null").drop("lg_codes", "lg_again")
    marked = _suspect_parts(rows, bitmaps, broadcast_bytes).withColumn("lg_id", F.col(key).cast("long"))
    plain = F.translate(F.coalesce(F.col(text), F.lit("")), UPPER, LOWER)
    top = F.max(F.struct("lg_id", "lg_rid"))
    suspects = marked.filter("lg_suspect").withColumn("lg_text", plain)
    groups = materialize(suspects.groupBy("lg_digest", "lg_text").agg(top.alias("lg_top"), F.count(F.lit(1)).alias("lg_n"), F.max(F.octet_length("lg_text")).alias("lg_len")).withColumn("lg_group", F.monotonically_increasing_id()), "copies")
    on = ["lg_digest"]
    if groups.groupBy("lg_digest").count().filter("count > 1").limit(1).count():  # texts that differ under one digest: then the bytes decide the join as well
        on.append("lg_text")
    else:
        groups, suspects = groups.drop("lg_text"), suspects.drop("lg_text")
    done = suspects.join(groups, on).select(*names, "lg_id", F.col("lg_top.lg_id").alias("lg_keep_id"), F.col("lg_n").alias("lg_group_size"), (F.col("lg_top.lg_rid") == F.col("lg_rid")).alias("lg_kept"), "lg_digest")
    alone = marked.filter("not lg_suspect").select(*names, "lg_id", F.col("lg_id").alias("lg_keep_id"), F.lit(1).cast("long").alias("lg_group_size"), F.lit(True).alias("lg_kept"), "lg_digest")
    return alone.unionByName(done)


def _arrow_schema(df: DataFrame) -> list[pa.Field]:
    from pyspark.sql.pandas.types import to_arrow_type

    return [pa.field(f.name, to_arrow_type(f.dataType)) for f in df.schema]


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256 (of the normalised text). See mark_copies for the rules."""
    from .common import id_text

    marked = mark_copies(id_text(docs, id_col, text_col), **options)
    return marked.select(F.col("lg_id").alias("doc_id"), F.col("lg_keep_id").alias("keep_id"), F.col("lg_group_size").alias("group_size"), F.col("lg_kept").alias("kept"), F.lower(F.hex("lg_digest")).alias("text_sha256"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one row of every group of equal texts, columns unchanged."""
    marked = mark_copies(docs, id_col, text_col, **options)
    return marked.filter("lg_kept").select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)))
