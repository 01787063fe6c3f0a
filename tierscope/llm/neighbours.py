"""Exact nearest neighbours by a block matrix join.

Vectors lie in blocks of a table. In each pass a bounded group of queries (QUERY_BLOCKS of BLOCK vectors, and PASS_BYTES) goes to all
tasks; queries are dealt evenly to as few passes as that allows, however many partitions they come from. Every candidate block is read where it lies, so candidates are never shuffled. In a task each pair of blocks is one
tile: int8 codes (with a scale for each vector) are multiplied as a matrix, which gives the distances of the decoded
vectors; with the norms of the two decoding errors that is a lower and an upper bound of each true distance. Pairs whose
lower bound is within the k-th smallest upper bound of their query, or its k-th smallest distance so far, are recomputed
in double precision from the original vectors and go through a heap; Spark merges the heaps of the tasks.

Defined cases: vectors that are null, all zero or hold null or non-finite components, and rows with a null
vec_id, take no part; where components are so large or small that a bound isn't finite, the exact distance decides, and it is
scaled so that squares neither overflow nor vanish; vectors of another length than the query's are no candidates; a query never meets rows of its own
vec_id; repeated rows are candidates each; ties go to the smaller vec_id; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import rows_of, stage

K, EVERY = 10, 100
#: Vectors in a block, and blocks of queries in a pass.
BLOCK, QUERY_BLOCKS = 2048, 8
#: Bytes of the queries of a pass, as 64-bit components.
PASS_BYTES = 32 << 20


def matrices(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors that take part, for each length of vector."""
    ids, lists = batch.column("vec_id"), batch.column("embedding")
    rows = [(i, v) for i, v in zip(ids.to_pylist(), lists.to_pylist(), strict=True) if i is not None and v and None not in v]
    for size in sorted({len(v) for _, v in rows}):
        own = [(i, v) for i, v in rows if len(v) == size]
        x = np.array([v for _, v in own], np.float64)
        ok = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
        if ok.any():
            yield np.array([i for i, _ in own], np.int64)[ok], x[ok]


def blocks(vectors: DataFrame, block: int = BLOCK) -> DataFrame:
    """block, size, ids, vectors (binary: 64-bit ids, 32-bit components where the table has 32-bit ones)."""
    kind = "<f4" if vectors.schema["embedding"].dataType.elementType.typeName() == "float" else "<f8"

    def run(batches):
        held: dict[int, list] = {}

        def row(size, ids, x):
            return pa.record_batch([pa.array([size], pa.int32()), pa.array([ids.astype("<i8").tobytes()], pa.binary()), pa.array([x.astype(kind).tobytes()], pa.binary())], ["size", "ids", "vectors"])

        for b in batches:
            for ids, x in matrices(b):
                size = x.shape[1]
                have = held.pop(size, None)
                ids, x = (ids, x) if have is None else (np.concatenate([have[0], ids]), np.concatenate([have[1], x]))
                while len(ids) >= block:
                    yield row(size, ids[:block], x[:block])
                    ids, x = ids[block:], x[block:]
                held[size] = [ids, x]
        for size, (ids, x) in held.items():
            if len(ids):
                yield row(size, ids, x)

    made = vectors.select("vec_id", "embedding").mapInArrow(run, "size int, ids binary, vectors binary")
    return made.withColumn("kind", F.lit(kind)).withColumn("block", F.xxhash64("ids"))


class Codes:
    """int8 codes of vectors: x = scale * code + error, with the norm of the error (infinite where there is no finite code)."""

    def __init__(self, x: np.ndarray):
        self.x = x
        with np.errstate(all="ignore"):
            self.scale = np.abs(x).max(axis=1) / 127
            code = np.rint(x / self.scale[:, None])
            self.error = np.sqrt(((x - code * self.scale[:, None]) ** 2).sum(axis=1))
            self.norm = (code**2).sum(axis=1) * self.scale**2
        odd = ~(np.isfinite(self.error) & np.isfinite(self.norm) & (self.norm > 1e-290))
        code[odd], self.scale[odd], self.norm[odd], self.error[odd] = 0, 0, 0, np.inf
        # products of int8 codes are whole numbers, exact in 32-bit floats up to 2**24
        self.code = code.astype(np.int8).astype(np.float32 if x.shape[1] * 127**2 < 2**24 else np.float64)


def bounds(q: Codes, c: Codes) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the distances of one tile; the slack is for rounding, which grows with the norms."""
    with np.errstate(over="ignore"):
        product = (q.code @ c.code.T).astype(np.float64) * q.scale[:, None] * c.scale
        norms = q.norm[:, None] + c.norm
        near = np.sqrt(np.maximum(norms - 2 * product, 0))
        slack = q.error[:, None] + c.error + 1e-7 * (near + np.sqrt(norms))
    near[~np.isfinite(near)], slack[~np.isfinite(slack)] = 0, np.inf
    return near - slack, near + slack


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        d = x - y
        out = np.sqrt(np.cumsum(d**2, axis=1)[:, -1])
        odd = np.flatnonzero(~np.isfinite(out) | (out < 1e-140))
        if len(odd):
            most = np.abs(d[odd]).max(axis=1)
            unit = np.where((most > 0) & np.isfinite(most), most, 1)
            out[odd] = unit * np.sqrt(((d[odd] / unit[:, None]) ** 2).sum(axis=1))
    return out


class Heaps:
    """The k nearest so far of each query of a block."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int):
        self.ids, self.codes, self.k = ids, Codes(x), k
        self.heap: list[list[tuple[float, int]]] = [[] for _ in ids]  # negated, so the farthest is on top
        self.far = np.full(len(ids), np.inf)

    def meet(self, ids: np.ndarray, c: Codes) -> None:
        low, high = bounds(self.codes, c)
        own = self.ids[:, None] == ids
        low[own] = high[own] = np.inf
        limit = self.far
        if len(ids) >= self.k:
            limit = np.minimum(limit, np.partition(high, self.k - 1, axis=1)[:, self.k - 1])
        rows, columns = np.nonzero((low <= limit[:, None]) & ~own)
        exact = distances(self.codes.x[rows], c.x[columns])
        for i, d, v in zip(rows.tolist(), exact.tolist(), ids[columns].tolist(), strict=True):
            h = self.heap[i]
            if len(h) < self.k:
                heapq.heappush(h, (-d, -v))
            elif (-d, -v) > h[0]:
                heapq.heapreplace(h, (-d, -v))
        for i in np.unique(rows).tolist():
            if len(self.heap[i]) == self.k:
                self.far[i] = -self.heap[i][0][0]


def nearest(vectors: DataFrame, k: int = K, every: int = EVERY, block: int = BLOCK, query_blocks: int = QUERY_BLOCKS) -> DataFrame:
    """query_id, rank (from 1), vec_id, score (Euclidean distance), for queries whose vec_id is divisible by `every`."""
    held = stage(blocks(vectors, block), "candidates", "none")
    asked, passes = in_passes(vectors.where(F.pmod("vec_id", F.lit(every)) == 0), block, query_blocks)
    found = [in_pass(held, asked.where(F.col("pass") == i), k) for i in range(passes)]
    if passes > 1:  # each pass is done before the next one's queries go out
        found = [stage(f, "found") for f in found]
    rows = found[0]
    for f in found[1:]:
        rows = rows.union(f)
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def in_passes(queries: DataFrame, block: int = BLOCK, query_blocks: int = QUERY_BLOCKS, most: int = PASS_BYTES) -> tuple[DataFrame, int]:
    """The blocks of queries with the number of their pass, and how many passes there are: by number and bytes of the queries alone."""
    n, size = queries.agg(F.count(F.lit(1)), F.sum(8 * F.size("embedding").cast("long"))).first()
    passes = max(1, -(-n // (block * query_blocks)), -(-(size or 0) // most))
    even = queries.select("vec_id", "embedding").repartition(passes)
    return stage(blocks(even, block).withColumn("pass", F.spark_partition_id()), "queries", "none"), passes


def in_pass(held: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id, score: the k nearest of each task, for the queries of one pass."""
    matrix = lambda r: (np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["vectors"], r["kind"]).reshape(-1, r["size"]).astype(np.float64))
    columns = ["size", "ids", "vectors", "kind"]
    sent = held.sparkSession.sparkContext.broadcast([r.asDict() for r in asked.select(*columns).collect()])  # one pass of queries

    def run(batches):
        heaps = [(r["size"], Heaps(*matrix(r), k)) for r in sent.value]
        for b in batches:
            for row in rows_of(b):
                ids, x = matrix(row)
                codes = Codes(x)
                for size, h in heaps:
                    if size == row["size"]:
                        h.meet(ids, codes)
        for _, h in heaps:
            out = [(q, -v, -d) for q, heap in zip(h.ids.tolist(), h.heap, strict=True) for d, v in heap]
            if out:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["query_id", "vec_id", "score"])

    return held.select(*columns).mapInArrow(run, "query_id long, vec_id long, score double")
