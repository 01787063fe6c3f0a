"""Near copies by SimHash: texts with an exact Jaccard similarity of 0.8 or more over five-word shingles.

Each text gets a SimHash fingerprint of 1024 bits over its distinct five-word shingles. At a similarity of 0.8 two fingerprints differ
in about 155 bits, so texts fall into buckets by each of 64 bands of 16 bits: one pair in 120 at just 0.8 agrees in no band, fewer
above. Within a bucket texts link whose first 128 bits differ in RADIUS or fewer; each task sends a spanning forest of its links, so
rows grow with the texts and not with pairs, and what the first bands join counts as one text in the others. The components of these links are classes, and every class is decided exactly: its texts
come together, pairs that sizes and whole fingerprints leave open are held against each other by their sets of shingles until they
are in one component, and a spanning forest of the true links goes on. A class of more than CLASS texts is cut in parts, and each pair of parts
is a unit of its own, so no task holds a large class. No pair is listed as a row before it is known to be a link.

Recall is below 1 and measured (README). exact_near_links is a join by prefix filters, which misses no pair but lists them.

Defined cases: words are those of op3 (A-Z lowered, ASCII white space); a text of fewer words than a shingle is one
shingle, and one without words is the empty shingle; equal texts stay or go together (exact dedup comes first); texts are told apart by XXH64, and where two
unequal ones have the same both stay; the smallest doc_id of a component stays, null ones only where there is no other.
Limits: a task holds a bucket, 24 bytes a text; within a class every pair of fingerprints is compared, in parallel over the units. Of a class of n texts more than CLASS,
n * n / CLASS rows go to the units.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import small_batches, stage

WORDS, LEAST, SLOT_BITS, PARTS, PAIRS = 5, 0.8, 18, 64, 1 << 16
#: Counters of a sketch, and bits of the table that tells most rows that are not asked for, so that they don't move.
SKETCH, BITS = 128, 1 << 25
SLOTS = 1 << SLOT_BITS
MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]
#: Words of 64 bits in a fingerprint, its bands of 16 bits, those that go first, and the words that travel with a band.
WIDE, BANDS, FIRST, HEAD = 16, 64, 8, 2
#: Bits of 128 in which texts of a bucket may differ, and of 1024 in which texts of a class may that hold more than TINY shingles (in
#: smaller ones the bits say less).
RADIUS, NEAR, TINY = 36, 200, 16
#: Rows handled at once, rows of a bucket that are compared pair by pair along its diagonals, a tile, and texts in a part of a class.
ROWS, FEW, TILE, CLASS = 1 << 16, 8, 512, 1024


def shingles(text: str, seen: dict[bytes, int]) -> np.ndarray:
    """Sorted hashes of the distinct shingles of a text. seen: hashes of words, kept from text to text."""
    import xxhash

    w = text.encode().lower().split()
    if len(w) < WORDS:
        return np.array([xxhash.xxh64_intdigest(b" ".join(w))], np.uint64)
    if len(seen) > 1 << 20:
        seen.clear()
    for x in set(w).difference(seen):
        seen[x] = xxhash.xxh64_intdigest(x)
    h = np.fromiter(map(seen.__getitem__, w), np.uint64, len(w))
    n = len(w) - WORDS + 1
    s = sum(h[i : i + n] * MIX[i] for i in range(WORDS))
    s ^= s >> np.uint64(32)
    s *= MIX[0]
    s ^= s >> np.uint64(29)
    return np.unique(s)


def odd_numbers() -> np.ndarray:
    import xxhash

    return np.array([xxhash.xxh64_intdigest(bytes([i])) | 1 for i in range(WIDE)], np.uint64)


def fingerprint(s: np.ndarray, odd: np.ndarray) -> np.ndarray:
    """SimHash of a set of shingles: a bit is 1 if it is set in over half of their hashes."""
    ones = np.zeros(64 * WIDE, np.int64)
    for at in range(0, len(s), 255):  # so many fit in bytes
        h = s[at : at + 255, None]
        h = (h ^ h >> np.uint64(31)) * odd
        h ^= h >> np.uint64(32)
        h *= MIX[0]
        h ^= h >> np.uint64(29)
        ones += np.add.reduce(np.unpackbits(h.view(np.uint8), axis=1, bitorder="little"), axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(s), bitorder="little").view(np.uint64)


def apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """In how many bits fingerprints differ; their words are the first axis."""
    return sum((np.bitwise_count(a ^ b) for a, b in zip(x, y, strict=True)), start=np.int16(0))


def whole_groups(batches, columns: list[str], rows: int) -> Iterator[list[np.ndarray]]:
    """The columns of sorted batches, about `rows` rows at a time, so that the groups of the first column are whole."""
    held, n = [], 0
    for b in batches:
        x = [b.column(c).to_numpy(zero_copy_only=False) for c in columns]
        if not len(x[0]):
            continue
        last = int(np.flatnonzero(np.r_[True, x[0][1:] != x[0][:-1]])[-1])  # the last group may go on in the next batch
        if held and n + last >= rows and (last or x[0][0] != held[-1][0][-1]):
            yield [np.concatenate(c) for c in zip(*held, [c[:last] for c in x], strict=True)]
            held, n, x = [], 0, [c[last:] for c in x]
        held.append(x)
        n += len(x[0])
    if held:
        yield [np.concatenate(c) for c in zip(*held, strict=True)]


def forest(f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links of fingerprints, as index pairs."""
    left, a, b = np.arange(f.shape[1]), [], []
    while len(left):
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            i = todo.pop()
            near = apart(f[:, left], f[:, i : i + 1]) <= RADIUS
            if near.any():
                a.append(np.full(int(near.sum()), i))
                b.append(left[near])
                todo += left[near].tolist()
                left = left[~near]
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def tiled_links(f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of one bucket, as index pairs; a spanning forest where there are more links than twice the rows."""
    n, a, b, found = f.shape[1], [], [], 0
    for i in range(0, n, TILE):
        for j in range(i, n, TILE):
            x, y = np.nonzero(apart(f[:, i : i + TILE, None], f[:, None, j : j + TILE]) <= RADIUS)
            keep = x + i < y + j
            a.append(x[keep] + i)
            b.append(y[keep] + j)
            found += len(a[-1])
            if found > 2 * n:
                return forest(f)
    return np.concatenate(a), np.concatenate(b)


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links (a, b): every node with the smallest node that it reaches."""
    node, at = np.unique(np.r_[a, b], return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label, before = np.arange(len(node)), None
    while before is None or (label != before).any():
        before, label = label, label.copy()
        low = np.minimum(before[x], before[y])
        for end in (x, y):
            np.minimum.at(label, end, low)
            np.minimum.at(label, before[end], low)
        label = label[label]
    far = np.flatnonzero(label != np.arange(len(node)))
    return node[label[far]], node[far]


def bucket_links(bucket: np.ndarray, node: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of many whole buckets (rows of a bucket stand together), as stars: buckets of other bands that hold the same texts mostly
    send the same ones, so that few are left when repeated pairs go."""
    start = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    end = np.r_[start[1:], len(bucket)]
    size, a, b = end - start, [], []
    after = np.repeat(end, size) - np.arange(len(bucket)) - 1
    at = np.flatnonzero(np.repeat(size <= FEW, size) & (after > 0))
    for d in range(1, FEW):
        at = at[after[at] >= d]
        hit = at[apart(f[:, at], f[:, at + d]) <= RADIUS]
        a.append(hit)
        b.append(hit + d)
    for s, e in zip(start[size > FEW].tolist(), end[size > FEW].tolist(), strict=True):
        if (node[s:e] == node[s]).all():
            continue
        x, y = tiled_links(f[:, s:e])
        a.append(x + s)
        b.append(y + s)
    return stars(node[np.concatenate(a)], node[np.concatenate(b)])


def fingerprints(texts: DataFrame) -> DataFrame:
    """node, print: the whole fingerprint of each of texts(node long, text string)."""

    def run(batches):
        seen, odd = {}, odd_numbers()
        for b in batches:
            f = [fingerprint(shingles(t, seen), odd).tobytes() for t in b.column("text").to_pylist()]
            yield pa.record_batch([b.column("node"), pa.array(f, pa.binary())], ["node", "print"])

    return texts.mapInArrow(run, "node long, print binary")


def band_links(prints: DataFrame, bands: range) -> DataFrame:
    """a, b: forests of the links of prints(node long, print binary) by these bands; a pair may come more than once. Prints may share a
    node: then their links are its links."""

    def send(batches):
        for b in batches:
            if not b.num_rows:
                continue
            f = np.frombuffer(b"".join(b.column("print").to_pylist()), np.uint64).reshape(-1, WIDE)
            bucket = f.view(np.uint16)[:, bands.start : bands.stop].astype(np.int32) + (np.array(bands, np.int32) << 16)
            head = [pa.array(np.repeat(f[:, i].view(np.int64), len(bands))) for i in range(HEAD)]
            yield pa.record_batch([pa.array(bucket.ravel()), pa.array(np.repeat(b.column("node").to_numpy(), len(bands))), *head], ["bucket", "node", "f0", "f1"])

    def meet(batches):
        for bucket, node, *f in whole_groups(batches, ["bucket", "node", "f0", "f1"], ROWS):
            a, b = bucket_links(bucket, node, np.stack(f).view(np.uint64))
            yield pa.record_batch([pa.array(a), pa.array(b)], ["a", "b"])

    sent = prints.mapInArrow(send, "bucket int, node long, f0 long, f1 long")
    return sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(meet, "a long, b long")


def simhash_links(texts: DataFrame) -> DataFrame:
    """a, b: links whose components are those of all links of texts(node long, text string) by bands of their fingerprints; a pair may
    come more than once. The FIRST bands join most texts of a group, which then count as one in the other bands: so a group sends
    about as many links as it has texts for each of the first bands, not for all."""
    prints = stage(fingerprints(texts), "prints")
    first = stage(components(band_links(prints, range(FIRST))), "first")
    told = prints.join(first, "node", "left").select(F.coalesce("component", "node").alias("node"), "print")
    return first.select(F.col("component").alias("a"), F.col("node").alias("b")).union(band_links(told, range(FIRST, BANDS)))


def alike(x: np.ndarray, y: np.ndarray) -> bool:
    both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
    return both >= LEAST * (len(x) + len(y) - both) - 1e-9


def class_links(part: np.ndarray, sets: list[np.ndarray], odd: np.ndarray) -> Iterator[tuple[int, int]]:
    """A spanning forest of the similar pairs among sets; of those between parts alone, where there are two parts."""
    size, f = np.array([len(s) for s in sets]), np.stack([fingerprint(s, odd) for s in sets], axis=1)
    one, label = (part == part[0]).all(), np.arange(len(sets))
    for i in range(len(sets) - 1):
        j = np.flatnonzero(fits(size[i + 1 :], size[i]) & (label[i + 1 :] != label[i]) & (one | (part[i + 1 :] != part[i]))) + i + 1
        bits = apart(f[:, j], f[:, i : i + 1])
        open_ = (bits <= NEAR) | (np.minimum(size[j], size[i]) <= TINY)
        for k in j[open_][np.argsort(bits[open_], kind="stable")].tolist():
            if label[k] != label[i] and alike(sets[i], sets[k]):
                yield i, k
                label[label == label[k]] = label[i]


def decided(classes: DataFrame, texts: DataFrame) -> DataFrame:
    """a, b: a spanning forest of the similar pairs of texts within classes(node, component)."""
    large = classes.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / CLASS).cast("int").alias("parts")).where("parts > 1")
    dealt = classes.join(large, "component", "left").withColumn("part", F.expr("cast(pmod(node, coalesce(parts, 1)) as int)"))
    dealt = dealt.withColumn("other", F.explode(F.expr("sequence(0, coalesce(parts, 1) - 1)")))
    dealt = dealt.select("node", "part", F.concat_ws("/", "component", F.least("part", "other"), F.greatest("part", "other")).alias("unit"))
    spread = texts.where(among(classes.select("node"))("node")).join(dealt, "node").select("unit", "part", "node", "text").repartition("unit").sortWithinPartitions("unit")

    def run(batches):
        seen, odd = {}, odd_numbers()
        for unit, part, node, text in whole_groups(batches, ["unit", "part", "node", "text"], 1):
            cuts = [0, *(np.flatnonzero(unit[1:] != unit[:-1]) + 1).tolist(), len(unit)]
            pairs = [(node[s + i], node[s + j]) for s, e in zip(cuts, cuts[1:], strict=False) for i, j in class_links(part[s:e], [shingles(t, seen) for t in text[s:e]], odd)]
            yield pa.record_batch([pa.array([x[k] for x in pairs], pa.int64()) for k in (0, 1)], ["a", "b"])

    return spread.mapInArrow(run, "a long, b long")


def prefix(s: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The rarest shingles, rarest first, of which similar texts share one: in any one order of all shingles, two texts with a similarity
    of t share one of the first n - ceil(t n) + 1 of the larger and one of the first n - ceil(2 t n / (1 + t)) + 1 of the smaller.
    The order is that of a table of SLOTS counters, which decides how many candidates there are, never the result."""
    order = np.lexsort((s, counts[s >> np.uint64(64 - SLOT_BITS)]))
    return s[order[: len(s) - math.ceil(LEAST * len(s) - 1e-9) + 1]]


def short(size: np.ndarray) -> np.ndarray:
    """How many of the rarest shingles a text of a size shares one of with any similar text that is no smaller."""
    return size - np.ceil(2 * LEAST / (1 + LEAST) * size - 1e-9).astype(size.dtype) + 1


def slot_counts(texts: DataFrame) -> np.ndarray:
    def run(batches):
        total, seen = np.zeros(SLOTS, np.int64), {}
        for b in batches:
            for t in b.column("text").to_pylist():
                np.add.at(total, shingles(t, seen) >> np.uint64(64 - SLOT_BITS), 1)
        if total.any():
            yield pa.record_batch([pa.array(range(PARTS), pa.int32()), pa.array([x.tobytes() for x in np.split(total, PARTS)])], ["part", "n"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, np.int64) for x in table.column("n").to_pylist())
        return pa.table({"part": table.column("part")[:1], "n": pa.array([total.tobytes()])})

    got = texts.mapInArrow(run, "part int, n binary").groupBy("part").applyInArrow(add, "part int, n binary").collect()  # SLOTS numbers
    out = np.zeros(SLOTS, np.int64)
    for r in got:
        out.reshape(PARTS, -1)[r["part"]] = np.frombuffer(r["n"], np.int64)
    return out


def fits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.minimum(a, b) >= LEAST * np.maximum(a, b) - 1e-9


def shared_shingles(texts: DataFrame) -> DataFrame:
    """h, node, size, place, first, before: prefix shingles of rows that have an earlier text to be held against, or are such a text, with
    the first and the last of these."""
    counts = texts.sparkSession.sparkContext.broadcast(slot_counts(texts))
    names = ["h", "node", "size", "place"]

    def send(batches):
        seen: dict = {}
        for b in batches:
            h, size, node = [], [], b.column("node").to_numpy()
            for t in b.column("text").to_pylist():
                s = shingles(t, seen)
                h.append(prefix(s, counts.value))
                size.append(len(s))
            if h:
                n = [len(x) for x in h]
                yield pa.record_batch([pa.array(np.concatenate(h).view(np.int64)), pa.array(np.repeat(node, n)), pa.array(np.repeat(np.array(size, np.int32), n)), pa.array(np.concatenate([np.arange(k, dtype=np.int32) for k in n]))], names)

    def meet(batches):
        # of the bucket that may go on: its shingle, and (node, size) of the first and last text that is held against; the last row waits for the next
        bucket, first, last, waits = None, None, None, None
        kinds = [np.int64, np.int64, np.int32, np.int32, np.int64, np.int64]

        def out(rows):
            return pa.record_batch([pa.array(np.asarray(x, k)) for x, k in zip(rows, kinds, strict=True)], [*names, "first", "before"])

        for b in batches:
            h, node, size, place = (b.column(c).to_numpy() for c in names)
            if not len(h):
                continue
            if waits:
                h, node, size, place = (np.r_[np.asarray(x, y.dtype), y] for x, y in zip(waits, (h, node, size, place), strict=True))
            own = place < short(size)  # others are held against it
            begin = np.maximum.accumulate(np.where(np.r_[True, h[1:] != h[:-1]], np.arange(len(h)), 0))
            at = np.arange(len(h))
            so_far = np.maximum.accumulate(np.where(own, at, -1))
            before = np.r_[-1, so_far[:-1]]
            before = np.where(before >= begin, before, -1)
            opens = np.where(own & (before < 0), at, -1)  # the first of its bucket in this batch
            first_at = np.maximum.accumulate(opens)
            first_at = np.where((first_at >= begin) & (first_at < at), first_at, -1)
            f_node, f_size = np.where(first_at >= 0, node[first_at], node), np.where(first_at >= 0, size[first_at], 0)
            l_node, l_size = np.where(before >= 0, node[before], node), np.where(before >= 0, size[before], 0)
            if bucket is not None and bucket == h[0] and first:  # the bucket began in an earlier batch
                old = begin == 0
                f_node, f_size = np.where(old, first[0], f_node), np.where(old, first[1], f_size)
                none = old & (before < 0)
                l_node, l_size = np.where(none, last[0], l_node), np.where(none, last[1], l_size)
            f_node, l_node = np.where(fits(f_size, size), f_node, node), np.where(fits(l_size, size), l_node, node)
            follows = np.r_[h[1:] == h[:-1], False]
            done = ((l_size > 0) | own & follows)
            done[-1] = False
            if done.any():
                yield out([x[done] for x in (h, node, size, place, f_node, l_node)])
            # what came before the last row, which waits
            i = len(h) - 1
            if bucket != h[i] or begin[i] > 0:
                bucket, first, last = h[i], None, None
            if before[i] >= 0:
                first = first or (node[opens[begin[i] : i].max()], size[opens[begin[i] : i].max()])
                last = (node[before[i]], size[before[i]])
            waits = [[x[i]] for x in (h, node, size, place)]
        if waits and first:
            h, node, size, place = (x[0] for x in waits)
            yield out([[h], [node], [size], [place], [first[0] if fits(first[1], size) else node], [last[0] if fits(last[1], size) else node]])

    sent = texts.mapInArrow(send, "h long, node long, size int, place int").repartition("h").sortWithinPartitions("h", "size", "node")
    return stage(sent.mapInArrow(meet, "h long, node long, size int, place int, first long, before long"), "shared")


def in_order(pairs: DataFrame) -> DataFrame:
    return pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def other_pairs(shared: DataFrame, linked: DataFrame) -> DataFrame:
    """Pairs of a bucket that are in different components so far."""
    told = shared.select("h", "node", "size", "place").join(linked, "node", "left").select("h", "node", "size", "place", F.coalesce("component", "node").alias("part"))
    mixed = told.groupBy("h").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo <> hi").select("h")
    spread = told.join(mixed, "h", "left_semi").repartition("h").sortWithinPartitions("h", "size", "node")

    def listed(node, size, place, part):
        a, b, n = [], [], 0
        for i in np.flatnonzero(place[:-1] < short(size[:-1])).tolist():
            j = slice(i + 1, np.searchsorted(size, size[i] / LEAST + 1e-6, "right"))
            most = np.minimum(place[i], place[j]) + np.minimum(size[i] - place[i], size[j] - place[j])  # shingles that they can share
            near = np.flatnonzero((part[j] != part[i]) & (most >= LEAST / (1 + LEAST) * (size[i] + size[j]) - 1e-6)) + i + 1
            a.append(np.full(len(near), node[i]))
            b.append(node[near])
            n += len(near)
            if n > PAIRS:
                yield pa.record_batch([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])
                a, b, n = [], [], 0
        if a:
            yield pa.record_batch([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    def run(batches):
        held = None
        for batch in batches:
            rows = [batch.column(c).to_numpy() for c in ("h", "node", "size", "place", "part")]
            held = [np.r_[x, y] for x, y in zip(held, rows, strict=True)] if held else rows
            if not len(held[0]):
                continue
            cuts = np.flatnonzero(held[0][1:] != held[0][:-1]) + 1
            for s, e in zip([0, *cuts[:-1].tolist()], cuts.tolist(), strict=False):
                yield from listed(*(x[s:e] for x in held[1:]))
            if len(cuts):
                held = [x[cuts[-1] :] for x in held]
        if held and len(held[0]):
            yield from listed(*held[1:])

    return in_order(spread.mapInArrow(run, "a long, b long"))


def sketch(s: np.ndarray) -> np.ndarray:
    """How many shingles fall to each counter: two texts share no more than the sum of the smaller counts."""
    return np.minimum(np.bincount((s & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH), 255).astype(np.uint8)


def among(nodes: DataFrame):
    """A test for columns of nodes: false where a node is surely not in nodes(node long)."""
    at = nodes.select(F.pmod("node", F.lit(BITS)).alias("p"))
    word = at.groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("bits")).toPandas()  # BITS / 64 rows at most
    table = np.zeros(BITS // 64, np.int64)
    table[word["w"].to_numpy(np.int64)] = word["bits"].to_numpy(np.int64)
    held = nodes.sparkSession.sparkContext.broadcast(table)

    @F.pandas_udf("boolean")
    def test(node: pd.Series) -> pd.Series:
        p = node.to_numpy() % BITS
        return pd.Series(held.value[p >> 6] >> (p & 63) & 1 == 1)

    return test


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs whose texts are similar, by their whole sets of shingles."""
    asked = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    asked = stage(asked, "asked")

    def sets(batches):
        seen: dict = {}
        for b in batches:
            s = [shingles(t, seen) for t in b.column("text").to_pylist()]
            yield pa.record_batch([b.column("node"), pa.array([x.tobytes() for x in s], pa.binary()), pa.array([sketch(x).tobytes() for x in s], pa.binary()), pa.array([len(x) for x in s], pa.int32())], ["node", "s", "sketch", "size"])

    near = texts.where(among(asked)("node")).join(asked, "node", "left_semi").dropDuplicates(["node"])
    s = stage(near.mapInArrow(sets, "node long, s binary, sketch binary, size int"), "sets")

    def likely(batches):
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint8).reshape(-1, SKETCH) for c in ("x", "y"))
            n = b.column("n").to_numpy().astype(np.int64) + b.column("m").to_numpy()
            both = np.minimum(x, y).sum(axis=1, dtype=np.int64)
            keep = (both >= LEAST * (n - both) - 1e-9) | (x == 255).any(axis=1) | (y == 255).any(axis=1)
            yield pa.record_batch([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(keep))

    small = s.select("node", "sketch", "size")
    pairs = pairs.join(small.toDF("a", "x", "n"), "a").join(small.toDF("b", "y", "m"), "b").mapInArrow(likely, "a long, b long")
    pairs = stage(pairs, "likely")
    s = s.select("node", "s")

    def hold(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column("s"), b.column("t"), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                keep.append(alike(x, y))
            yield pa.record_batch([b.column("a"), b.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    two = pairs.join(s.withColumnRenamed("node", "a"), "a").join(s.toDF("b", "t"), "b")
    return stage(two.select("a", "b", "s", "t").mapInArrow(hold, "a long, b long"), "links")


def near_links(texts: DataFrame) -> DataFrame:
    """node, component of texts(node long, text string) that have a near copy."""
    classes = stage(components(simhash_links(texts)), "classes")
    return components(decided(classes, texts))


def exact_near_links(texts: DataFrame) -> DataFrame:
    """As near_links, by prefix filters (see shared_shingles, other_pairs), which miss no pair."""
    shared = shared_shingles(texts)
    first = stage(in_order(shared.select(F.explode(F.array("first", "before")).alias("a"), F.col("node").alias("b"))), "first")
    links = verified(first, texts)
    rest = stage(other_pairs(shared, components(links)).join(first, ["a", "b"], "left_anti"), "rest")
    return components(links.union(verified(rest, texts)))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with their own columns."""
    small_batches(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.xxhash64(text).alias("node"), F.xxhash64(F.lit(1), text).alias("check"), text.alias("text"))
    linked = near_links(rows.select("node", "text"))
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("node"))
    clash = rows.groupBy("node").agg(F.min("check").alias("lo"), F.max("check").alias("hi")).where("lo <> hi").select("node")
    told = stage(rows.select("doc_id", "node").join(linked, "node").select("node", "component", order.alias("o")), "told")
    best = told.groupBy("component").agg(F.min("o").getField("node").alias("best"))
    lost = told.select("node", "component").distinct().join(best, "component").where("node <> best").select(F.col("node").alias("_lost"))
    lost = stage(lost.toDF("node").join(clash, "node", "left_anti"), "lost")
    node = F.xxhash64(F.coalesce(docs["text"], F.lit("")))
    maybe = among(lost)(node)
    asked = docs.where(maybe)
    return docs.where(~maybe).union(asked.join(lost.toDF("_lost"), node == F.col("_lost"), "left_anti"))
