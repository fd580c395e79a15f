"""Corpus operators against brute force, with nulls, ties, repeats, clashing names and empty tables."""

import collections
import hashlib
import math
import random
import zlib
from fractions import Fraction
from html.parser import HTMLParser

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from lumigrid.llm import bpe, counts, exact, graph, html, langid, lm, media, near, packing, pages, sharding

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, lang string, shard string, sha string, rid long"


def documents():
    """Small and odd: what every operator must take."""
    r = random.Random(4)
    word = lambda: "".join(r.choice("ae io nrtsl dmh".split()) for _ in range(3))
    base = [" ".join(word() for _ in range(r.randint(1, 60))) for _ in range(12)]
    texts = base + [base[0], base[0].upper(), base[1] + " extra", "", None, " \n\t ", "A", "a", "É é ﬀ ²ß", "x" * 5000, "It's 'LL 12,5 <|endoftext|> #*&", "日本 \x1c語\x85ok\xa0x", "Ünḯ ſ İ"]
    words = base[2].split() * 8
    for i in range(30):
        w = list(words)
        for _ in range(i % 5):
            w[r.randrange(len(w))] = word()
        texts.append(" ".join(w))
    texts.append(" ".join(word() for _ in range(30_000)))
    rows = [(i, t, r.choice(["en", "fr", None]), "clash", "clash", -i) for i, t in enumerate(texts)]
    return rows + [rows[3], rows[3], (None, base[4], "en", None, None, None), (None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(documents(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def lower(t):
    return (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def key(row):
    return tuple("" if v is None else str(v) for v in row)


def test_golomb_round_trip():
    r = np.random.default_rng(1)
    for n in (0, 1, 2, 1000):
        v = np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1))
        assert np.array_equal(exact.golomb_decode(exact.golomb_encode(v)), v)
    v = np.array([0, (1 << 64) - 1], np.uint64)
    assert np.array_equal(exact.golomb_decode(exact.golomb_encode(v)), v)


@pytest.mark.parametrize("broadcast", [16 << 20, 1])
def test_exact_dedup(docs, broadcast):
    rows = documents()
    groups = collections.defaultdict(list)
    for row in rows:
        groups[lower(row[1])].append(row[0])
    got = exact.exact_dedup(docs, broadcast_bytes=broadcast).collect()
    assert len(got) == len(rows)
    want = collections.Counter()
    for t, ids in groups.items():
        top = max((i for i in ids if i is not None), default=None)
        for i in ids:
            want[(i, top, len(ids), hashlib.sha256(t.encode()).hexdigest())] += 1
    assert collections.Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    assert collections.Counter(r.text_sha256 for r in got if r.kept) == collections.Counter({hashlib.sha256(t.encode()).hexdigest(): 1 for t in groups})
    assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_exact_dedup_keeps_columns(docs, empty):
    kept = exact.drop_copies(docs)
    assert kept.schema == docs.schema and kept.count() == len({lower(r[1]) for r in documents()})
    assert exact.exact_dedup(empty).count() == 0 and exact.drop_copies(empty).columns == empty.columns


def test_media(docs, empty):
    rows = {key((r[0],)): (r[1] or "").encode() for r in documents()}
    got = media.media_features(media.store_media(docs)).collect()
    assert len(got) == len(documents())
    features = collections.defaultdict(set)
    for r in got:
        if r.doc_id is None:
            continue
        t = rows[key((r.doc_id,))]
        p = t + b"\xff" * ((-len(t)) % 576 if t else 576)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(t), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
        features[t].add((r.feature, r.media_sha256, r.media_bytes))
    assert all(len(v) == 1 for v in features.values())
    assert media.media_features(media.store_media(empty)).count() == 0


def test_png_filters_and_damage():
    r = np.random.default_rng(2)
    image = r.integers(0, 256, (9, 14), dtype=np.uint8)
    for kind in range(5):
        rows, up = [], np.zeros(14, int)
        for line in image.astype(int):
            left = np.concatenate([[0], line[:-1]])
            corner = np.concatenate([[0], up[:-1]])
            p = left + up - corner
            paeth = [min((abs(q - a), 0, a), (abs(q - b), 1, b), (abs(q - c), 2, c))[2] for q, a, b, c in zip(p, left, up, corner)]
            rows.append((line - [np.zeros(14, int), left, up, (left + up) // 2, np.array(paeth)][kind]) % 256)
            up = line
        assert np.array_equal(media.unfilter(np.array(rows, np.uint8), np.full(9, kind, np.uint8)), image)
    png = media.encode_png(image)
    assert np.array_equal(media.decode_png(png)[:, :, 0], image)
    for at in (3, 20, len(png) // 2, len(png) - 5):
        broken = bytearray(png)
        broken[at] ^= 1
        with pytest.raises(ValueError):
            media.decode_png(bytes(broken))
    with pytest.raises(ValueError):
        media.decode_png(png[:-12])


def test_cosine_hash_is_robust():
    y, x = np.arange(96) + 0.5, np.arange(48) + 0.5
    waves = np.random.default_rng(4).normal(0, 6, (8, 8))  # every low frequency takes part
    a = sum(w * np.outer(np.cos(np.pi * u * y / 96), np.cos(np.pi * v * x / 48)) for (u, v), w in np.ndenumerate(waves))
    a = np.clip(128 + a, 0, 255).astype(np.uint8)
    b = np.clip(a.astype(int) + np.random.default_rng(0).integers(-3, 4, a.shape), 0, 255).astype(np.uint8)
    d = sum(bin(p ^ q).count("1") for p, q in zip(media.cosine_hash(a), media.cosine_hash(b)))
    assert d <= 10


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(WORD_BPE)


def test_bpe(docs, empty, tokenizer):
    want = {}
    for r in documents():
        e = tokenizer.encode(r[1] or "", add_special_tokens=False).ids
        want[key((r[0],)) if r[0] is not None else ("", r[1])] = (len(e), hashlib.sha256(" ".join(map(str, e)).encode()).hexdigest(), hashlib.sha256(tokenizer.decode(e, skip_special_tokens=False).encode()).hexdigest())
    got = bpe.bpe_digests(docs, WORD_BPE).collect()
    assert len(got) == len(documents())
    for r in got:
        if r.doc_id is not None:
            assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == want[key((r.doc_id,))]
    assert bpe.bpe_digests(empty, WORD_BPE).count() == 0
    lists = bpe.bpe_encode(docs, WORD_BPE)
    assert {r.doc_id: r.decoded for r in bpe.bpe_decode(lists, WORD_BPE).collect()}[0] == tokenizer.decode(tokenizer.encode(documents()[0][1], add_special_tokens=False).ids, skip_special_tokens=False)


def test_bpe_on_random_words(tokenizer):
    r = random.Random(3)
    letters = "abcdeèéßäöüñthinranesot'’.,!*#&0123456789ÀÉ日本́ſKÅİΣς\x1c "
    words = ["".join(r.choice(letters) for _ in range(r.randint(1, 14))) for _ in range(4000)] + ["a" * 300, "ΟΔΥΣΣΕΥΣ"]
    model = bpe.load(WORD_BPE)
    for w, e in zip(words, tokenizer.encode_batch(words, add_special_tokens=False), strict=True):
        assert model.encode(w) == e.ids, w


def check_packing(got, ids, longest=2048):
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        by_sequence[r.sequence_id].append(r)
        by_doc[r.doc_id].append(r)
    for rows in by_sequence.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= longest and at & (at - 1) == 0
    for i, t in ids.items():
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(t) and r.ids_crc32 == zlib.crc32(t[at : at + r.length].tobytes())
            at += r.length
        assert at == len(t)


def test_packing(docs, empty, tokenizer):
    rows = {r[0]: r[1] for r in documents() if r[0] is not None}
    once = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    ids = {i: np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [1], "<u4") for i, t in rows.items()}
    got = packing.pack_documents(once, WORD_BPE).collect()
    check_packing(got, ids)
    per_step = collections.defaultdict(set)
    for r in got:
        per_step[(r.tier, r.step_group)].add(r.sequence_id)
    assert all(len(s) * t <= packing.STEP_TOKENS for (t, _), s in per_step.items())
    assert packing.pack_documents(empty, WORD_BPE).count() == 0
    assert packing.pack_documents(docs, WORD_BPE).count() >= len(documents())
    with pytest.raises(ValueError):
        packing.pack_documents(docs, WORD_BPE, tiers=(100, 200))


def test_step_groups_are_equal_and_even():
    """Over many buffers all groups but the last hold the same tokens, and groups of a tier cost nearly the same."""
    r, packer, rows = np.random.default_rng(5), packing.Packer(0), []
    sizes = np.minimum(r.lognormal(5.5, 1.1, 6000).astype(int) + 1, 30_000)
    for i, n in enumerate(sizes):
        packer.add(i, bytes(4 * int(n)))
        if i % 700 == 699:
            packer.pack()
            rows += (b := packer.rows()) and b.to_pylist() or []
    packer.pack(last=True)
    rows += packer.rows(last=True).to_pylist()
    assert sum(x["length"] for x in rows) == sizes.sum()
    tokens, cost, tiers = collections.Counter(), collections.Counter(), collections.defaultdict(set)
    for x in rows:
        tokens[x["step_group"]] += x["length"]
        cost[x["step_group"]] += x["length"] ** 2
        tiers[x["step_group"]].add(x["tier"])
    *whole, tail = sorted(tokens)
    assert all(tokens[g] == packing.STEP_TOKENS for g in whole) and 0 < tokens[tail] <= packing.STEP_TOKENS
    for tier in packing.TIERS:
        costs = [cost[g] for g in whole if tiers[g] == {tier}]
        assert len(costs) < 2 or max(costs) < 1.35 * min(costs), (tier, min(costs), max(costs))


def test_token_counts(docs, empty):
    import sentencepiece
    from tokenizers import Tokenizer, models, pre_tokenizers

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    vocab = [(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size())]
    t = Tokenizer(models.Unigram(vocab, 0, True))
    t.pre_tokenizer = pre_tokenizers.Metaspace("▁", "always", True)
    want = {r[0]: len(t.encode(r[1] or "", add_special_tokens=False).ids) for r in documents()}
    got = counts.token_counts(docs, PIECES).collect()
    assert len(got) == len(documents()) and all(r.n_tokens == want[r.doc_id] for r in got if r.doc_id is not None)
    assert counts.token_counts(empty, PIECES).count() == 0
    small = [("<unk>", 0.0), ("▁", -2.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("▁a", -3.0), ("▁ab", -4.0), ("the", -5.0), ("th", -2.0), ("e", -3.0)]
    t = Tokenizer(models.Unigram(small, 0, False))
    t.pre_tokenizer = pre_tokenizers.Metaspace("▁", "always", True)
    c, r = counts.UnigramCounter(small, False), random.Random(5)
    for _ in range(2000):
        text = "".join(r.choice("ab the zé▁") for _ in range(r.randint(0, 14)))
        assert len(t.encode(text).ids) == sum(c.count("▁" + w) for w in counts.cut(text)), text


def jump(k, n):
    k = int(sharding.mix(np.array([k % (1 << 64)], np.uint64))[0])
    b, j = -1, 0
    while j < n:
        b = j
        k = (k * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * (float(1 << 31) / float((k >> 33) + 1)))
    return b


def test_sharding(docs, empty):
    got = sharding.shard_documents(docs, 16).collect()
    rows = {r[0]: (r[1] or "").encode() for r in documents() if r[0] is not None}
    assert len(got) == len(documents())
    slots = collections.defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.law == "key" and r.grown_shard in (r.shard, 16)
        if r.doc_id is not None:
            assert (r.size, r.text_crc32, r.shard, r.grown_shard) == (len(rows[r.doc_id]) + 1, zlib.crc32(rows[r.doc_id]), jump(r.doc_id, 16), jump(r.doc_id, 17))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard_documents(empty).count() == 0
    many = sharding.jump_hash(np.arange(100_000, dtype=np.uint64), 16)
    assert np.bincount(many).min() > 5800 and abs((sharding.jump_hash(np.arange(100_000, dtype=np.uint64), 17) == 16).mean() - 1 / 17) < 0.005


def brute_groups(rows, words, at_least):
    sets = []
    for i, t, *_ in rows:
        w = lower(t).encode().split()
        sets.append(frozenset(tuple(w[j : j + words]) for j in range(len(w) - words + 1)) if len(w) >= words else frozenset([tuple(w)] if w else []))
    root = list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and at_least.denominator * both >= at_least.numerator * len(sets[i] | sets[j]):
                root[top(i)] = top(j)
    least = {}
    for i, row in enumerate(rows):
        if row[0] is not None:
            least[top(i)] = min(least.get(top(i), row[0]), row[0])
    return collections.Counter((row[0], len(sets[i]), least.get(top(i)) if sets[i] else row[0]) for i, row in enumerate(rows))


@pytest.mark.parametrize(("words", "at_least"), [(3, Fraction(85, 100)), (5, Fraction(4, 5))])
def test_near_dedup(docs, empty, words, at_least):
    got = near.near_groups(docs, words, at_least).collect()
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_groups(documents(), words, at_least)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got if r.doc_id is not None)
    assert near.near_groups(empty).count() == 0


def test_near_dedup_on_a_drifting_cluster(spark):
    """Copies of copies: far members are linked only through others, over several blocks."""
    r, rows = random.Random(8), []
    w = [f"w{r.randrange(500)}" for _ in range(60)]
    for i in range(220):
        w = list(w)
        for _ in range(r.choice([0, 0, 1, 1, 2, 5])):
            w[r.randrange(len(w))] = f"n{r.randrange(9000)}"
        rows.append((i, " ".join(w)))
    r.shuffle(rows)
    got = near.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), 3, Fraction(85, 100)).collect()
    assert collections.Counter((x.doc_id, x.n_shingles, x.component_id) for x in got) == brute_groups(rows, 3, Fraction(85, 100))


def test_near_dedup_sends_texts_of_a_large_cluster_few_times(spark, monkeypatch):
    """A hot group of 600 near copies: disk must not grow with the square of its blocks of a few nodes."""
    r = np.random.default_rng(3)
    base, rows = [f"w{i}" for i in range(120)], []
    for i in range(600):
        words = list(base)
        for at in r.integers(0, 120, r.integers(1, 6)):
            words[at] = f"x{r.integers(1 << 40)}"
        rows.append((i, " ".join(words)))
    sent = []

    def spy(df, name):
        out = materialize(df, name)
        if name == "blocks":
            sent.append(out.agg(F.count("rid"), F.sum("blocks")).first())
        return out

    materialize = near.materialize
    monkeypatch.setattr(near, "materialize", spy)
    got = {r.doc_id: r.component_id for r in near.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), 3, Fraction(85, 100)).collect()}
    assert sent[0][0] == 600 and sent[0][1] <= 2 * 600  # texts that meet
    sets = [near.shingles(t.encode(), 3) for _, t in rows]
    root = list(range(600))
    for a in range(600):
        for b in range(a):
            both = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
            if root[a] != root[b] and 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                low, high = sorted((root[a], root[b]))
                root = [low if x == high else x for x in root]
    assert got == dict(enumerate(root))


@pytest.mark.parametrize("direct", [0, 8])
def test_block_links_one_by_one_and_by_products(monkeypatch, direct):
    """Confirmed either way, within a block and between two, the links span what all pairs would."""
    monkeypatch.setattr(near, "DIRECT", direct)
    monkeypatch.setattr(near, "SLICE_CELLS", 1000)
    r = np.random.default_rng(5)
    base = [np.unique(r.integers(0, 1 << 62, 300).astype(np.uint64)) for _ in range(3)]
    sets = [np.unique(np.concatenate([base[i % 3][r.random(len(base[i % 3])) < r.choice([0.9, 0.96])], r.integers(0, 1 << 62, 8).astype(np.uint64)])) for i in range(90)] + [np.array([7], np.uint64)] * 2
    for two in (False, True):
        sides = np.arange(len(sets)) // 2 % 2
        linked = lambda a, b: 100 * len(np.intersect1d(sets[a], sets[b])) >= 85 * len(np.union1d(sets[a], sets[b]))  # noqa: B023, E731
        found = near.block_links(sets, sides, two, 48, near.needed(48, Fraction(85, 100)), Fraction(85, 100))
        assert all(linked(a, b) and (not two or sides[a] != sides[b]) for a, b in found)

        def groups(pairs):
            root = list(range(len(sets)))
            for a, b in pairs:
                low, high = sorted((root[a], root[b]))
                root = [low if x == high else x for x in root]
            return root

        every = [(a, b) for a in range(len(sets)) for b in range(a) if (not two or sides[a] != sides[b]) and linked(a, b)]
        assert groups(found) == groups(every) and len(found) == len(sets) - len(set(groups(every)))


def test_needed_is_a_safe_bound():
    assert near.needed(48, Fraction(85, 100)) < 48 * 0.85
    assert near.needed(48, Fraction(1, 1)) == 48


def test_components(spark):
    r = random.Random(6)
    edges = [(i, i + 1) for i in range(40)] + [(100 + r.randrange(60), 100 + r.randrange(60)) for _ in range(40)] + [(7, 7)]
    root = {n: n for e in edges for n in e}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    linked = {n for a, b in edges if a != b for n in (a, b)}
    got = {x.node: x.comp for x in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: top(n) for n in linked}


def test_language_id(spark, docs, empty):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(table).collect()
    lang = {r.doc_id: r.lang for r in table.collect()}
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) / len(held) > 0.98
    assert all(0 <= r.score <= 1 for r in got)
    odd = langid.identify(docs).collect()
    texts = {r[0]: r[1] for r in documents()}
    assert len(odd) == len(documents())
    for r in odd:
        if r.doc_id is not None:
            assert (r.lang_pred == "und") == (not any(c.isalpha() for c in texts[r.doc_id] or ""))
    assert langid.identify(empty).count() == 0
    kept = langid.drop_unidentified(docs)
    assert kept.schema == docs.schema
    assert {r.doc_id for r in kept.collect()} >= {i for i, t in texts.items() if i is not None and t and any(c.isalpha() for c in t) and len(t) < 100}


def test_language_model(spark, docs, empty):
    rows = documents()
    tokens = [lower(r[1]).encode().split() for r in rows]
    held = [zlib.crc32(str("" if r[0] is None else r[0]).encode()) % 7 == 2 for r in rows]
    c = collections.Counter(w for t, h in zip(tokens, held) if not h for w in t)
    ends = held.count(False)
    n, v = sum(c.values()) + ends, len(c) + 1
    want = collections.Counter()
    for r, t, h in zip(rows, tokens, held):
        base = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t) + math.log10((ends + 1) / (n + v + 1))
        want[(r[0], h, len(t) + 1, sum(c[w] > 0 for w in t) + 1, n, round(base, 5))] += 1
    got = lm.score_documents(docs).collect()
    assert collections.Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in got) == want
    assert all(r.score < 0 for r in got)
    assert lm.score_documents(empty).count() == 0


def test_language_model_beats_its_base(spark):
    got = lm.score_documents(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out").collect()
    tokens = sum(r.n_tokens for r in got)
    assert sum(r.score for r in got) / tokens > sum(r.base_score for r in got) / tokens + 0.3


def brute_slots(counts, ends):
    """Place of every word by its count, hash and spelling, and the mass of every place."""
    import xxhash

    signed = lambda w: (xxhash.xxh3_64_intdigest(w) + (1 << 63)) % (1 << 64) - (1 << 63)
    spelled = lambda w: (int.from_bytes(w[-4:].rjust(4, b"\0"), "little") * 2_654_435_761 % (1 << 32) >> 12) % lm.SHARED
    top = sorted(counts, key=lambda w: (-counts[w], signed(w)))[: lm.OWN]
    mass = [ends] + [counts[w] for w in top] + [0] * (lm.OWN - len(top)) + [0] * lm.SHARED
    for w in set(counts) - set(top):
        mass[1 + lm.OWN + spelled(w)] += counts[w]
    place = {slot: i for i, slot in enumerate(sorted(range(len(mass)), key=lambda i: (-mass[i], i)))}
    own = {w: place[1 + i] for i, w in enumerate(top)}
    return place[0], lambda w: own.get(w, place[1 + lm.OWN + spelled(w)]), {place[i]: m for i, m in enumerate(mass)}


def brute_states(p, places, end):
    """The hidden state before every place, a word at a time in double precision."""
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    p, h, n = {k: v.astype(np.float64) for k, v in p.items()}, np.zeros(lm.HIDDEN), lm.HIDDEN
    for read in [end, *places[:-1]]:
        x, hu = p["E"][read] @ p["W"] + p["b"], h @ p["U"]
        z, r = sigmoid(x[:n] + hu[:n]), sigmoid(x[n : 2 * n] + hu[n : 2 * n])
        h = z * h + (1 - z) * np.tanh(x[2 * n :] + r * hu[2 * n :])
        yield h


def brute_slot(p, h):
    """The distribution over all places."""
    softmax = lambda x: np.exp(x - x.max()) / np.exp(x - x.max()).sum()
    classes = softmax(h @ p["O"] + p["o"])
    return np.concatenate([classes[c] * softmax(h @ p["V"][c] + p["v"][c]) for c in range(lm.CLASSES)])


@pytest.mark.parametrize("many", [False, True])
def test_language_model_scores(spark, monkeypatch, many):
    """Every score, from the trained weights, word by word; all known words and the unknown one sum to 1."""
    table = documents()
    if many:  # more words than slots
        r = random.Random(2)
        table += [(1000 + i, " ".join(f"{chr(97 + w % 26)}{w}{'xyz'[w % 3]}" for w in (int(r.paretovariate(0.2)) % 6000 if i % 2 else r.randrange(6000) for _ in range(150))), None, None, None, None) for i in range(60)]
    docs = spark.createDataFrame(table, SCHEMA).repartition(3)
    held, make = {}, lm._scorer
    monkeypatch.setattr(lm, "_scorer", lambda gru, *rest: held.setdefault("gru", gru) and make(gru, *rest))
    got = collections.defaultdict(list)
    for r in lm.score_documents(docs).collect():
        got[r.doc_id].append(r.score)
    rows = [(r[0], lower(r[1]).encode().split(), zlib.crc32(str("" if r[0] is None else r[0]).encode()) % 7 == 2) for r in table]
    counts = collections.Counter(w for _, t, h in rows if not h for w in t)
    ends = sum(not h for *_, h in rows)
    assert (len(counts) > lm.OWN) == many
    end, place, mass = brute_slots(counts, ends)
    unknown = (sum(c == 1 for c in counts.values()) + 1) / (sum(counts.values()) + ends + len(counts) + 2)
    p = held["gru"].p
    for i, tokens, _ in rows:
        if i is None or len(tokens) > 2000:
            continue
        places, score = [*map(place, tokens), end], 0.0
        for t, at, h in zip([*tokens, None], places, brute_states(p, places, end)):
            count = ends if t is None else counts[t]
            score += math.log10((1 - unknown) * brute_slot(p, h)[at] * count / mass[at]) if count else math.log10(unknown)
        assert got[i] == pytest.approx([score] * len(got[i]), rel=1e-4, abs=1e-3)
    state = list(brute_states(p, [3, 5, 9], end))[-1]
    slots = brute_slot(p, state)
    every = unknown + (1 - unknown) * (slots[end] + sum(slots[place(w)] * c / mass[place(w)] for w, c in counts.items()))
    assert every == pytest.approx(1, abs=1e-6)


def test_words_are_cut_in_arrow():
    """The chunks' words, codes and counts are those of a loop over words, for less CPU time than the loop's."""
    import time

    import pyarrow as pa

    r = random.Random(4)
    odd = [None, "", " ", "\t\n\v\f\r ", " A b\vC\fd ", "\x1c\x1f\x85\xa0", "\0 \0", "É İß é"]
    texts = odd + ["".join(r.choice("aB é\n\x1c") for _ in range(r.randrange(50))) for _ in range(500)]
    texts += [" ".join(f"Word{int(r.paretovariate(0.5)) % 20_000}" for _ in range(200)) for _ in range(1500)]
    rows = [(i, i % 7 == 2, t) for i, t in enumerate(texts)]
    batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.bool_(), pa.string()))], names=["doc_id", "held_out", "text"])

    def plain():
        words = [lm._tokens((t or "").encode()) for t in texts]
        code = {w: i for i, w in enumerate(dict.fromkeys(w for t in words for w in t))}
        return words, [np.fromiter(map(code.__getitem__, t), np.uint32, len(t)) for t in words], lm.hash_words(list(code)), lm.spelling(list(code))

    def timed(f):
        began = time.process_time()
        f()
        return time.process_time() - began

    cut = lambda: list(lm._chunker(1)([batch]))
    words, _, hashes, _ = plain()
    (sent,) = cut()
    sent = {x["owner"]: x for x in sent.to_pylist()}
    docs, codes = lm._unpack(sent[-1]["docs"])
    assert docs.column("words").to_pylist() == [len(t) for t in words]
    assert sent[0]["hashes"] == np.sort(hashes).astype("<u8").tobytes()
    own = np.frombuffer(sent[0]["hashes"], "<u8")
    assert (own[codes] == lm.hash_words([w for t in words for w in t])).all()
    learned = collections.Counter(w for (_, held, _), t in zip(rows, words) if not held for w in t)
    assert dict(zip(own.tolist(), np.frombuffer(sent[0]["counts"], "<u4").tolist())) == {h: learned[w] for w, h in zip(dict.fromkeys(w for t in words for w in t), hashes.tolist())}
    pairs = [(timed(cut), timed(plain)) for _ in range(7)]
    assert min(a for a, _ in pairs) < 0.95 * min(b for _, b in pairs)


def test_training_reads_every_training_document(docs, monkeypatch):
    """Each word of each training document, and its end, is trained on, and no other; every chunk has its turn."""
    seen = collections.Counter()
    rows = docs.toPandas()
    rows = [(None if r.doc_id != r.doc_id else int(r.doc_id), zlib.crc32(("" if r.doc_id != r.doc_id else str(int(r.doc_id))).encode()) % 7 == 2, lm._tokens((r.text or "").encode())) for r in rows.itertuples()]
    words = sorted({w for *_, t in rows for w in t}, key=lambda w: int(lm.hash_words([w])[0]))
    packed = lm._pack(rows, [np.array([words.index(w) for w in t], np.uint32) for *_, t in rows])
    import pyarrow as pa

    monkeypatch.setattr(lm.Gru, "train", lambda self, stream, end, adam: seen.update(stream.tolist()))
    counts = collections.Counter(w for _, h, t in rows if not h for w in t)
    hashes, spelled = lm.hash_words(words), lm.spelling(words)
    top = [(int(h), counts[w], int(s)) for w, h, s in zip(words, hashes, spelled) if counts[w]][: lm.OWN]
    slots = lm.arrange(top, np.bincount(spelled, weights=[counts[w] for w in words], minlength=lm.SHARED), sum(not h for _, h, _ in rows))
    batch = pa.RecordBatch.from_arrays([pa.array([hashes.astype("<u8").tobytes() + spelled.tobytes()]), pa.array([packed])], names=["words", "docs"])
    list(lm._trainer(lm.Gru().flat().tobytes(), slots, 0.01)([batch]))
    chunks = [t * lm.CHUNKS_PER_TASK + i for t in range(9) for i in range(3)]
    turns = docs.sparkSession.createDataFrame([(c,) for c in chunks], "chunk long").select(lm.turn_of("chunk").alias("t")).collect()
    assert {r.t for r in turns} == set(range(lm.ROUNDS)) and max(collections.Counter(r.t for r in turns).values()) <= 8
    assert seen == collections.Counter({i: int(m) for i, m in enumerate(slots.mass) if m})


def test_gru_gradients_and_state():
    g = lm.Gru(seed=3)
    r = np.random.default_rng(3)
    every = lm.CLASSES * lm.WITHIN
    x, y = r.integers(0, every, (2, 5)), r.integers(0, every, (2, 5))
    y[0, 1] = y[0, 0] // lm.WITHIN * lm.WITHIN  # two of one class
    h = r.standard_normal((2, lm.HIDDEN))

    def loss():
        return -sum(math.log(brute_slot(g.p, s)[at]) for lane in range(2) for at, s in zip(y[lane], states(lane))) / 10

    def states(lane):
        now, n, sigmoid = h[lane], lm.HIDDEN, lambda v: 1 / (1 + np.exp(-v))
        for t in range(5):
            a, b = g.p["E"][x[lane, t]] @ g.p["W"] + g.p["b"], now @ g.p["U"]
            z, r_ = sigmoid(a[:n] + b[:n]), sigmoid(a[n : 2 * n] + b[n : 2 * n])
            now = z * now + (1 - z) * np.tanh(a[2 * n :] + r_ * b[2 * n :])
            yield now

    for k in g.p:
        g.p[k] = g.p[k].astype(np.float64)
    grads, _ = g.gradients(x, y, h)
    used = {"E": lambda: (r.choice(x.ravel()), r.integers(lm.EMBED)), "V": lambda: (r.choice(y.ravel()) // lm.WITHIN, r.integers(lm.HIDDEN), r.integers(lm.WITHIN)), "v": lambda: (r.choice(y.ravel()) // lm.WITHIN, r.integers(lm.WITHIN))}
    for k, v in grads.items():
        for _ in range(4):
            at = used[k]() if k in used else tuple(r.integers(0, s) for s in v.shape)
            keep = g.p[k][at]
            g.p[k][at] = keep + 1e-5
            up = loss()
            g.p[k][at] = keep - 1e-5
            down = loss()
            g.p[k][at] = keep
            assert v[at] == pytest.approx((up - down) / 2e-5, abs=1e-6), k
    g = lm.Gru(seed=3)
    flat = r.integers(0, every, 700)
    lengths, starts = np.array([600, 1, 99]), np.array([0, 600, 601])
    counted = r.random(700) < 0.9
    one = np.concatenate([g.log10(flat, starts[i : i + 1], lengths[i : i + 1], 5, counted) for i in range(3)])
    assert np.allclose(g.log10(flat, starts, lengths, 5, counted), one, rtol=1e-4)


def test_pages_that_the_model_never_saw():
    r, trees, good = random.Random(77), html.model(), 0
    for _ in range(120):
        page = pages.page(r)
        nodes, blocks = html.parse(page)

        def marked(n):
            while n >= 0:
                if nodes[n].key:
                    return True
                n = nodes[n].parent
            return False

        good += html.extract([page], trees)[0] == "\n\n".join(t for n, t in blocks if marked(n))
    assert good >= 112


class Article(HTMLParser):
    """The blocks of the first <article>, by the standard library's parser: every start or end of a block ends one."""

    def __init__(self, page):
        super().__init__()
        self.inside, self.done, self.run, self.blocks = False, False, "", []
        self.feed(page)
        self.close()
        self.end()

    def end(self):
        if text := " ".join(self.run.split()):
            self.blocks.append(text)
        self.run = ""

    def handle_starttag(self, tag, attrs):
        if tag in ("p", "h1", "h2", "div", "article", "ul", "li", "footer", "aside", "section"):
            self.end()
        self.run += "\n" * (tag == "br")
        self.inside |= tag == "article"

    def handle_endtag(self, tag):
        if tag in ("p", "h1", "h2", "div", "article", "ul", "li", "footer", "aside", "section"):
            self.end()
        if tag == "article":
            self.inside, self.done = False, True

    def handle_data(self, data):
        if self.inside and not self.done:
            self.run += data


def test_pages_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r for r in html.extract_pages(table).collect()}
    for r in table.collect():
        want = "\n\n".join(Article(r.html).blocks)
        assert got[r.page_id].text == want and got[r.page_id].n_chars == len(want) and got[r.page_id].url == r.url


PROSE = [
    "The harbour was quiet when the first boats came in, and nobody on the quay said a word about the storm.",
    "Prices had risen for a third year; still, most of the traders we asked expected a calmer season ahead.",
    "She closed the ledger, thanked the clerk, and walked back along the river to the small house by the bridge.",
    "Engineers measured the wall twice. It had moved by four millimetres, less than the model had predicted.",
    "What remains is a question of patience: the seeds need two winters, and the gardeners only have one.",
]
#: Pages by hand, as (html, blocks of main text); {0}.. stand for prose.
BY_HAND = {
    "table layout": ("<html><body><table><tr><td><a href=/1>One</a><br><a href=/2>Two</a><br><a href=/3>Three</a></td><td><h1>Harbour news</h1><p>{0}</p><p>{1}</p></td></tr></table></body></html>", ["Harbour news", 0, 1]),
    "header inside the article": ("<html><head><title>x</title></head><body><article><header><h1>Harbour news</h1></header><p>{0}</p><p>{2}</p></article><footer><p>&copy; 2020 Somebody</p></footer></body></html>", ["Harbour news", 0, 2]),
    "no classes": ("<html><body><div><ul><li><a href=/a>Start</a></li><li><a href=/b>Contact</a></li><li><a href=/c>About</a></li></ul></div><div><h1>Harbour news</h1><p>{0}</p><p>{1}</p><p>{3}</p></div></body></html>", ["Harbour news", 0, 1, 3]),
    "foreign classes": ('<html><body><div class="seitenleiste"><ul><li><a href=/a>Anfang</a></li><li><a href=/b>Kontakt</a></li></ul></div><div class="inhalt"><h1>Nachrichten</h1><p>{1}</p><p>{4}</p><p>{2}</p></div></body></html>', ["Nachrichten", 1, 4, 2]),
    "article and aside": ("<body><nav><a href=/>Home</a> <a href=/n>News</a></nav><main><article><h1>Walls</h1><p>{3}</p><p>{4}</p></article><aside><h3>Related</h3><ul><li><a href=/q>Bridges</a></li><li><a href=/r>Roads</a></li></ul></aside></main>", ["Walls", 3, 4]),
    "comments": ('<body><div id="content"><h1>Seeds</h1><p>{4}</p><p>{0}</p><p>{2}</p></div><div id="comments"><h3>2 comments</h3><div class="comment"><b>Ann</b><p>Nice, thank you!</p></div><div class="comment"><b>Bo</b><p>I do not agree with a word of it.</p></div></div></body>', ["Seeds", 4, 0, 2]),
    "open head, formula": ("<html><head><title>t</title><p>{0}</p><p>{1} <math><mi>x</mi><mo>=</mo><mn>1</mn></math></p>", [0, PROSE[1] + " x=1"]),
    "cookie notice and advert": ('<body><div class="cookie-banner"><p>We use cookies to make this site better for you.</p><button>OK</button></div><article><h1>Trade</h1><p>{1}</p><div class="ad">Buy two, pay one!</div><p>{2}</p></article></body>', ["Trade", 1, 2]),
}


@pytest.mark.parametrize("name", BY_HAND)
def test_pages_by_hand(name):
    """Pages that no generator of this repository made."""
    page, blocks = BY_HAND[name]
    want = [b if isinstance(b, str) else PROSE[b] for b in blocks]
    assert html.extract([page.format(*PROSE)], html.model())[0].split("\n\n") == want


def test_deep_pages_in_linear_time():
    import time

    for part in ("<div>", "<p><button><div>", "<li>", "<table><tr><td>", "<b><i>"):
        began = time.process_time()
        nodes, _ = html.parse(part * 40_000 + "deep")
        assert time.process_time() - began < 15, part
    assert len(html.features(html.parse("<div>" * 100_000)[0])) == 100_001


def test_odd_pages(spark):
    odd = [None, "", "<", "<p", "plain text", "<p>a &amp b &#x41; &nbsp; c", "<script>x", "<div>" * 2000 + "deep", "<!-- <p>no</p> --><p>yes", "<table><tr><td>1<td>2</table>", "</p></div></b>", '<p class="a>b">q</p>', "<p>" + "long text. " * 50_000, "<p>same</p>", "<p>same</p>", "<div>" * 30_000 + "x"]
    rows = spark.createDataFrame([(i, None, h, "clash") for i, h in enumerate(odd)] + [(None, "u", "<p>x</p>", None)], "page_id long, url string, html string, text string")
    got = html.extract_pages(rows).collect()
    assert len(got) == len(odd) + 1 and all(r.n_chars == len(r.text) for r in got)
    by_id = {r.page_id: r.text for r in got}
    assert by_id[len(odd) - 3] == by_id[len(odd) - 2] and not by_id[0] and html.parse("<p>a &amp b &#x41; &nbsp; c")[1] == [(1, "a & b A c")]
    assert html.extract_pages(rows.limit(0)).count() == 0


def test_decoding_never_contradicts_itself():
    nodes, _ = html.parse("<div><div><p>a</p></div><p>b</p></div>")
    r = np.random.default_rng(0)
    for _ in range(50):
        odds = r.normal(0, 3, len(nodes))
        kept = html.decode(nodes, odds)
        assert all(kept[n.parent] or not kept[i] for i, n in enumerate(nodes) if i)
        score = lambda k: sum(-np.logaddexp(0, -o) if x else -np.logaddexp(0, o) for o, x in list(zip(odds, k))[1:])
        best = max(score((True, *(bool(m >> i & 1) for i in range(len(nodes) - 1)))) for m in range(1 << (len(nodes) - 1)) if all((True, *(bool(m >> i & 1) for i in range(len(nodes) - 1)))[n.parent] or not (m >> (i - 1) & 1) for i, n in enumerate(nodes) if i))
        assert score(kept) == pytest.approx(best)
