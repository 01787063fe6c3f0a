"""SimHash near-dedup: 64-bit fingerprints, and an exact search for all links within a radius.

Fingerprints that differ in at most `radius` bits agree in one of radius + 1 blocks of bits, so the search
falls into buckets of equal block. In a bucket, fingerprints stand in order of population count and are
compared in tiles with numpy: exclusive-or and bit counts, leaving out tile pairs whose population counts
differ beyond the radius. A bucket too large for a task is cut in tiles by population count, and each
tile pair within the radius is a unit of its own. Only distinct fingerprints are compared, and a unit with
many links sends a spanning forest of them, not all pairs.

Defined cases: a null or blank text has fingerprint zero, which is linked like any other; a text of fewer
words than a shingle is one shingle; repeated rows have the same result; rows with a null doc_id get a
fingerprint, and a component only from others; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import documents_of, small_batches, stage

WORDS, RADIUS, SEED = 3, 3, 42
#: Fingerprints in a tile; in a bucket that is one unit; in a unit that is compared pair by pair along its diagonals.
TILE, UNIT, FEW = 1024, 16_384, 8


def fingerprint(text: str, words: int = WORDS, seed: int = SEED) -> int:
    import xxhash

    w = text.encode().lower().split()  # bytes: A-Z and ASCII white space alone
    if not w:
        return 0
    if len(w) < words:
        shingles, n = [b" ".join(w)], 1
    else:
        shingles, n = map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False)), len(w) - words + 1
    h = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(seed)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        ones += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, fp (the 64 bits as a long)."""
    small_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(t, words, seed) for t in b.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.record_batch([b.column("doc_id"), pa.array(fp)], ["doc_id", "fp"])

    return documents_of(docs).mapInArrow(run, "doc_id long, fp long")


def tiled_links(fp: np.ndarray, radius: int, tile: int = TILE) -> tuple[np.ndarray, np.ndarray]:
    """Links within one unit, as index pairs; a spanning forest where there are more links than twice the rows."""
    order = np.argsort(pop := np.bitwise_count(fp), kind="stable")
    f, p = fp[order], pop[order].astype(np.int64)
    a, b, found = [], [], 0
    for i in range(0, len(f), tile):
        for j in range(i, len(f), tile):
            if p[j] - p[min(i + tile, len(f)) - 1] > radius:
                break  # and so for all tiles further on
            x, y = np.nonzero(np.bitwise_count(f[i : i + tile, None] ^ f[None, j : j + tile]) <= radius)
            keep = x + i < y + j
            a.append(x[keep] + i)
            b.append(y[keep] + j)
            found += len(a[-1])
            if found > 2 * len(f):
                x, y = forest(f, p, radius)
                return order[x], order[y]
    return order[np.concatenate(a)], order[np.concatenate(b)]


def forest(f: np.ndarray, p: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links of fingerprints f in order of population count p."""
    left, a, b = np.arange(len(f)), [], []
    while len(left):
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            i = todo.pop()
            lo, hi = np.searchsorted(p[left], (p[i] - radius, p[i] + radius + 1))
            near = np.bitwise_count(f[left[lo:hi]] ^ f[i]) <= radius
            if near.any():
                new = left[lo:hi][near]
                a.append(np.full(len(new), i))
                b.append(new)
                todo += new.tolist()
                left = np.concatenate([left[:lo], left[lo:hi][~near], left[hi:]])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def unit_links(unit: np.ndarray, fp: np.ndarray, node: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of many whole units (rows of a unit stand together), as node pairs."""
    start = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1]])
    end = np.r_[start[1:], len(unit)]
    size, a, b = end - start, [], []
    few = np.repeat(size <= FEW, size)
    after = np.repeat(end, size) - np.arange(len(unit)) - 1
    at = np.flatnonzero(few & (after > 0))
    for d in range(1, FEW):
        at = at[after[at] >= d]
        hit = at[np.bitwise_count(fp[at] ^ fp[at + d]) <= radius]
        a.append(node[hit])
        b.append(node[hit + d])
    for s, e in zip(start[size > FEW].tolist(), end[size > FEW].tolist(), strict=True):
        x, y = tiled_links(fp[s:e], radius)
        a.append(node[s:e][x])
        b.append(node[s:e][y])
    return np.concatenate(a), np.concatenate(b)


def links(nodes: DataFrame, radius: int = RADIUS, unit: int = UNIT) -> DataFrame:
    """a, b: links (or forests of links) of nodes(node long, fp long), fp distinct."""
    n = radius + 1
    cut = [64 * i // n for i in range(n + 1)]
    block = [F.struct(F.lit(i).alias("block"), F.shiftrightunsigned("fp", cut[i]).bitwiseAND(F.lit((1 << (cut[i + 1] - cut[i])) - 1)).alias("bits")) for i in range(n)]
    keyed = nodes.withColumn("pop", F.bit_count("fp")).withColumn("at", F.explode(F.array(*block))).select("node", "fp", "pop", "at.block", "at.bits")
    sizes = keyed.groupBy("block", "bits", "pop").count().groupBy("block", "bits")
    large = sizes.agg(F.sum("count").alias("rows"), F.map_from_entries(F.collect_list(F.struct("pop", F.ceil(F.col("count") * 2 / unit).cast("int")))).alias("tiles")).where(F.col("rows") > unit).drop("rows")
    large = stage(large, "large")
    own = "named_struct('pop', pop, 'part', cast(pmod(xxhash64(fp), tiles[pop]) as int))"
    others = f"flatten(transform(filter(sequence(pop - {radius}, pop + {radius}), p -> map_contains_key(tiles, p)), p -> transform(sequence(0, tiles[p] - 1), s -> named_struct('pop', p, 'part', s))))"
    cut_up = keyed.join(large, ["block", "bits"], "left").withColumn(
        "pair", F.expr(f"explode(if(tiles is null, array(cast(null as struct<one:struct<pop:int,part:int>,two:struct<pop:int,part:int>>)), transform({others}, o -> named_struct('one', least({own}, o), 'two', greatest({own}, o)))))")
    )
    dealt = cut_up.select("node", "fp", F.xxhash64("block", "bits", "pair").alias("unit"))
    spread = dealt.repartition("unit").sortWithinPartitions("unit")

    def run(batches):
        held: list[tuple] = []
        rows = 0

        def done(parts):
            u, f, m = (np.concatenate(x) for x in zip(*parts, strict=True))
            a, b = unit_links(u, f.view(np.uint64), m, radius)
            return pa.record_batch([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            u, f, m = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("unit", "fp", "node"))
            if not len(u):
                continue
            last = int(np.flatnonzero(np.r_[True, u[1:] != u[:-1]])[-1])  # the last unit may go on in the next batch
            if rows + last > 2 * UNIT and (last or u[0] != held[-1][0][-1]):
                yield done([*held, (u[:last], f[:last], m[:last])] if held else [(u[:last], f[:last], m[:last])])
                held, rows, u, f, m = [], 0, u[last:], f[last:], m[last:]
            held.append((u, f, m))
            rows += len(u)
        if held:
            yield done(held)

    return spread.mapInArrow(run, "a long, b long")


def simhash_components(docs: DataFrame, words: int = WORDS, radius: int = RADIUS, seed: int = SEED) -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable)."""
    rows = stage(fingerprints(docs, words, seed), "fingerprints")
    nodes = stage(rows.groupBy("fp").agg(F.min("doc_id").alias("node")), "nodes")
    linked = components(links(nodes.where("node is not null"), radius))
    told = stage(nodes.join(linked, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id")), "told")
    return rows.join(told, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """The rows of docs that stay (the smallest doc_id of each component, and null ones), with their own columns."""
    kept = simhash_components(docs, **how).where("doc_id is null or doc_id = component_id").select(F.col("doc_id").alias("_keep")).distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["_keep"]), "left_semi")
