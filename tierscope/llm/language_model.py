"""Scores of texts by a unigram base and by a log-bilinear neural model trained with noise-contrastive estimation.

Words. Texts are tokenised once, in units of about a megabyte, and kept as word numbers with the hashes (XXH64) of a unit's words.
Each unit sends the hashes of its distinct words with their counts in training documents, and with a profile: the sum of its
documents' signatures (a sign vector of each word, summed over the document, at 8 bits). A range of hashes adds them up. All
words of all training documents are counted, none is cut; counts and profiles are whole numbers, so they don't depend on partitions.

Classes. The OWN most frequent words are classes of their own. Every other word belongs to a class by the group of its profile (k-means
over the MARKERS most frequent words, so a group is a language or a topic) and by its frequency, so all words take part, as
context and as target: log p(word) = log p(class | context) + log of the word's share of its class. Words that no training
text has are one class more, with the base probability; what is left is shared by the others. So the probabilities sum to one.

Model (log_bilinear.py). Training is synchronous: documents fall in SLICES by a hash of doc_id, in each round Spark adds up the
gradients of one slice under the same parameters and noise, and the driver moves them once (Adam). The order of documents,
units and partitions changes nothing but the last digits of sums. Scoring is batched matrix products, normalised over all classes.

Defined cases: a null text is empty (one token: the end); rows with a null doc_id count as held out; repeated rows
each count and are each returned; with no training document the counts are 0 and the model is as it starts; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import log_bilinear as lb
from .shared import documents_of, rows_of, small_batches, stage
from .suffix_dedup import planes, steps, unplanes

#: Words with a class of their own, groups of the others and the counts at which a group's next class begins, and the words that groups come from.
OWN, GROUPS, BANDS, MARKERS = 160, 24, (2, 8, 64), 4096
#: The end, own words, groups, unknown words.
CLASSES = 1 + OWN + GROUPS * (len(BANDS) + 1) + 1
#: Slices of the training documents, each one step of training, and how fast parameters move.
SLICES, RATE = 32, 0.1
#: Numbers in a profile; bytes of text in a unit and behind one range of hashes, and groups in the first level of adding gradients up.
PROFILE, UNIT, RANGE, ADDED = 8, 1 << 20, 8 << 20, 64
END_WORD = 0


def crc(doc: int | None) -> int:
    return zlib.crc32(b"" if doc is None else str(doc).encode())


def squeezed(a: np.ndarray, kind: str, planed: bool = False) -> bytes:
    """Compressed numbers; planed: byte by byte, so that the many small ones take little."""
    import zstandard

    raw = np.ascontiguousarray(a.astype(kind)).ravel()
    if planed:
        raw = np.ascontiguousarray(raw.view(np.uint8).reshape(len(raw), -1).T)
    return zstandard.ZstdCompressor(level=1).compress(raw.tobytes())


def unsqueezed(b: bytes, kind: str, planed: bool = False) -> np.ndarray:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(b) if b else b""
    if planed:
        raw = np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).tobytes()
    return np.frombuffer(raw, kind)


TOKENS = "unit long, n_bytes long, n_tokens long, ids binary, slices binary, counts binary, hashes binary, words binary"


def tokenised(docs: DataFrame, size: int = UNIT) -> DataFrame:
    """Units of texts as tokens. ids: doc_id or 0; slices: the slice of a document, SLICES where it is held out, and SLICES + 1 where
    it has no id; counts: tokens of each document, its end included; hashes: of the unit's words in order; words: place of each token's."""
    small_batches(docs.sparkSession)

    def run(batches):
        import xxhash

        def packed():
            known = {w: i for i, w in enumerate(dict.fromkeys(words))}
            place = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
            hashes = np.array([END_WORD if w == b" " else xxhash.xxh64_intdigest(w) or 1 for w in known], np.uint64)
            order = np.argsort(hashes)
            rank = np.empty_like(order)
            rank[order] = np.arange(len(order))
            cells = [uuid.uuid4().int >> 66, n_bytes, len(words), np.array(ids, "<i8").tobytes(), np.array(slices, np.uint8).tobytes(), np.array(counts, "<i8").tobytes(), hashes[order].astype("<u8").tobytes(), squeezed(rank[place], "<u4")]
            return pa.record_batch([pa.array([c]) for c in cells], ["unit", "n_bytes", "n_tokens", "ids", "slices", "counts", "hashes", "words"])

        ids, slices, counts, words, n_bytes = [], [], [], [], 0
        for b in batches:
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                raw = text.encode().lower()  # bytes: A-Z and ASCII white space alone
                own = raw.split()
                words += own
                words.append(b" ")  # no word: the end
                counts.append(len(own) + 1)
                ids.append(doc or 0)
                slices.append(SLICES + 1 if doc is None else SLICES if crc(doc) % 10 == 0 else crc(doc) // 10 % SLICES)
                n_bytes += len(raw)
                if n_bytes >= size:
                    yield packed()
                    ids, slices, counts, words, n_bytes = [], [], [], [], 0
        if ids:
            yield packed()

    return documents_of(docs).mapInArrow(run, TOKENS)


class Texts:
    """The tokens of a unit."""

    def __init__(self, row: dict):
        self.ids, self.slices = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["slices"], np.uint8)
        self.counts, self.hashes = np.frombuffer(row["counts"], "<i8"), np.frombuffer(row["hashes"], "<u8")
        self.word = unsqueezed(row["words"], "<u4").astype(np.int64)
        self.doc = np.repeat(np.arange(len(self.counts)), self.counts)
        self.train = (self.slices < SLICES)[self.doc]

    def profiles(self) -> np.ndarray:
        """For each word the sum of the signatures of training documents, once for each time it is there."""
        signs = np.unpackbits(np.ascontiguousarray(self.hashes).view(np.uint8).reshape(-1, 8)[:, :1], axis=1)[:, :PROFILE] * 2.0 - 1
        signs[self.hashes == END_WORD] = 0
        whole = np.stack([np.bincount(self.doc, signs[self.word, k], len(self.counts)) for k in range(PROFILE)], axis=1)
        sign = np.rint(127 * lb.unit_rows(whole))
        word, doc = self.word[self.train], self.doc[self.train]
        return np.stack([np.bincount(word, sign[doc, k], len(self.hashes)) for k in range(PROFILE)], axis=1).astype(np.int64)


def cuts_of(hashes: np.ndarray, ranges: int) -> list[int]:
    return np.searchsorted(hashes, np.array([-(-(i << 64) // ranges) for i in range(ranges)], np.uint64)).tolist() + [len(hashes)]


SENT = "range int, unit long, first long, hashes binary, counts binary, profiles binary"
ADDED_UP = "hashes binary, totals binary, profiles binary, units array<struct<unit:long,first:long,places:binary>>, words long, tokens long, ends long, top array<struct<n:long,hash:long,profile:binary>>"


def added(table: pa.Table) -> pa.Table:
    """One range: its words with totals and profiles, where each unit's words are among them, and the most frequent ones."""
    unit, first = table.column("unit").to_pylist(), table.column("first").to_pylist()
    hashes = [np.cumsum(unplanes(b, 8)) for b in table.column("hashes").to_pylist()]
    counts = np.concatenate([unplanes(b, 5).astype(np.int64) for b in table.column("counts").to_pylist()])
    profile = np.concatenate([unsqueezed(b, "<i4", planed=True).reshape(PROFILE, -1).T for b in table.column("profiles").to_pylist()])
    own, place = np.unique(np.concatenate(hashes), return_inverse=True)
    total = np.bincount(place, counts, len(own)).astype(np.int64)
    profiles = np.stack([np.bincount(place, profile[:, k], len(own)) for k in range(PROFILE)], axis=1).astype("<i8")
    ends = int(total[own == END_WORD].sum())
    top = np.lexsort((own, -total))[: MARKERS + 1]
    top = top[(total[top] > 0) & (own[top] != END_WORD)]
    cuts = np.cumsum([0, *map(len, hashes)])
    units = [{"unit": u, "first": f, "places": squeezed(place[a:b], "<u4")} for u, f, a, b in zip(unit, first, cuts, cuts[1:], strict=False)]
    tops = [{"n": int(total[i]), "hash": int(own[i].astype(np.int64)), "profile": profiles[i].tobytes()} for i in top]
    row = {"hashes": own.astype("<u8").tobytes(), "totals": squeezed(total, "<i8"), "profiles": squeezed(profiles, "<i8", planed=True), "units": units, "words": int((total > 0).sum()), "tokens": int(total.sum()), "ends": ends, "top": tops}
    kinds = {"units": pa.list_(pa.struct([("unit", pa.int64()), ("first", pa.int64()), ("places", pa.binary())])), "top": pa.list_(pa.struct([("n", pa.int64()), ("hash", pa.int64()), ("profile", pa.binary())]))}
    return pa.table({k: pa.array([v], kinds.get(k)) for k, v in row.items()})


def counted(tokens: DataFrame, ranges: int) -> DataFrame:
    def send(batches):
        for b in batches:
            for row in rows_of(b):
                t = Texts(row)
                n, profile = np.bincount(t.word[t.train], minlength=len(t.hashes)).astype(np.uint64), t.profiles()
                cuts = cuts_of(t.hashes, ranges)
                for i in range(ranges):
                    if (s := slice(cuts[i], cuts[i + 1])).start < s.stop:
                        cells = [row["unit"], s.start, planes(steps(t.hashes[s]), 8), planes(n[s], 5), squeezed(profile[s].T, "<i4", planed=True)]
                        yield pa.record_batch([pa.array([i], pa.int32()), *(pa.array([c]) for c in cells)], ["range", "unit", "first", "hashes", "counts", "profiles"])

    return tokens.select("unit", "ids", "slices", "counts", "hashes", "words").mapInArrow(send, SENT).groupBy("range").applyInArrow(added, ADDED_UP)


class Classes:
    """What class a word is, from its hash, count and profile."""

    def __init__(self, top: list[tuple[int, int, bytes]]):
        """top: (count, hash, profile) of the most frequent words, in order."""
        own = sorted(h for _, h, _ in top[:OWN])
        self.own = np.array(own, np.uint64)
        x = lb.unit_rows(np.array([np.frombuffer(p, "<i8") for *_, p in top]).reshape(-1, PROFILE))
        self.centroids = lb.centroids(x, np.sqrt([float(n) for n, *_ in top]), GROUPS) if top else np.zeros((1, PROFILE))

    def of(self, hashes: np.ndarray, totals: np.ndarray, profiles: np.ndarray) -> np.ndarray:
        group = lb.nearest(lb.unit_rows(profiles), self.centroids)
        out = 1 + OWN + group * (len(BANDS) + 1) + np.searchsorted(BANDS, totals, "right")
        if len(self.own):
            at = np.minimum(np.searchsorted(self.own, hashes), len(self.own) - 1)
            out = np.where(self.own[at] == hashes, 1 + at, out)
        return np.where(hashes == END_WORD, 0, np.where(totals == 0, CLASSES - 1, out))


def most_frequent(words: DataFrame) -> DataFrame:
    """n, hash, profile of the MARKERS most frequent words: first of each of ADDED groups of partitions, then of all."""
    rows = words.select(F.inline("top"), F.pmod(F.spark_partition_id(), F.lit(ADDED)).alias("part"))
    order = Window.partitionBy("part").orderBy(F.desc("n"), "hash")
    rows = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= MARKERS)
    return stage(rows.orderBy(F.desc("n"), "hash").limit(MARKERS).select("n", "hash", "profile"), "markers").orderBy(F.desc("n"), "hash")


def masses(words: DataFrame, classes: Classes) -> np.ndarray:
    """Sum of (count + 0.1) of each class."""

    def run(batches):
        total, n = np.zeros(CLASSES, np.int64), np.zeros(CLASSES, np.int64)
        for b in batches:
            for row in rows_of(b):
                t = unsqueezed(row["totals"], "<i8")
                c = classes.of(np.frombuffer(row["hashes"], "<u8"), t, unsqueezed(row["profiles"], "<i8", planed=True).reshape(-1, PROFILE))
                np.add.at(total, c, t)
                np.add.at(n, c, t > 0)
        yield pa.record_batch([pa.array(np.arange(CLASSES)), pa.array(total), pa.array(n)], ["c", "total", "n"])

    rows = words.select("hashes", "totals", "profiles").mapInArrow(run, "c long, total long, n long").groupBy("c").agg(F.sum("total"), F.sum("n")).collect()  # CLASSES rows
    out = np.zeros(CLASSES)
    for c, total, n in rows:
        out[c] = total + 0.1 * n
    return out


CLASSED = "slice int, ids binary, held binary, counts binary, classes binary, known binary, base binary, share binary"


def classed(tokens: DataFrame, words: DataFrame, classes: Classes, mass: np.ndarray, smooth: float) -> DataFrame:
    """For each unit and slice: its documents, their classes, and sums that need a word's own count."""

    def tell(batches):
        for b in batches:
            for row in rows_of(b):
                total = unsqueezed(row["totals"], "<i8")
                c = classes.of(np.frombuffer(row["hashes"], "<u8"), total, unsqueezed(row["profiles"], "<i8", planed=True).reshape(-1, PROFILE))
                for u in row["units"]:
                    at = unsqueezed(u["places"], "<u4").astype(np.int64)
                    cells = [u["unit"], u["first"], planes(total[at].astype(np.uint64), 5), c[at].astype("<u2").tobytes()]
                    yield pa.record_batch([pa.array([x]) for x in cells], ["unit", "first", "totals", "classes"])

    told = words.select("hashes", "totals", "profiles", "units").mapInArrow(tell, "unit long, first long, totals binary, classes binary")
    told = told.groupBy("unit").agg(F.collect_list(F.struct("first", "totals", "classes")).alias("told"))
    log_mass = np.log(np.maximum(mass, 1e-300))

    def run(batches):
        for b in batches:
            for row in rows_of(b):
                t = Texts(row)
                total, c = np.zeros(len(t.hashes), np.int64), np.full(len(t.hashes), CLASSES - 1)
                for part in row["told"]:
                    got = unplanes(part["totals"], 5)
                    s = slice(part["first"], part["first"] + len(got))
                    total[s], c[s] = got, np.frombuffer(part["classes"], "<u2")
                log = np.log(total + 0.1)
                share = np.where(total > 0, log - log_mass[c], 0)
                n = len(t.counts)
                sums = [np.bincount(t.doc, x[t.word], n) for x in ((total > 0).astype(float), log - math.log(smooth), share)]
                token_class, bucket = c[t.word], np.minimum(t.slices, SLICES)
                for k in np.unique(bucket).tolist():
                    d = bucket == k
                    cells = [t.ids[d].tobytes(), t.slices[d].tobytes(), t.counts[d].tobytes(), squeezed(token_class[d[t.doc]], "<u2"), sums[0][d].astype("<i8").tobytes(), sums[1][d].tobytes(), sums[2][d].tobytes()]
                    yield pa.record_batch([pa.array([k], pa.int32()), *(pa.array([x]) for x in cells)], ["slice", "ids", "held", "counts", "classes", "known", "base", "share"])

    return tokens.select("unit", "ids", "slices", "counts", "hashes", "words").join(told, "unit").mapInArrow(run, CLASSED)


KINDS = {"ids": "<i8", "held": "u1", "counts": "<i8", "classes": "<u2", "known": "<i8", "base": "<f8", "share": "<f8"}


def together(batches, tokens: int = 1 << 17):
    """Columns of rows of `classed`, so many rows at a time that they have about so many tokens."""
    held, n = [], 0
    for b in batches:
        for row in rows_of(b):
            held.append({k: unsqueezed(v, KINDS[k]).astype(np.int64) if k == "classes" else np.frombuffer(v, KINDS[k]) for k, v in row.items()})
            n += len(held[-1]["classes"])
            if n >= tokens:
                yield {k: np.concatenate([r[k] for r in held]) for k in held[0]}
                held, n = [], 0
    if held:
        yield {k: np.concatenate([r[k] for r in held]) for k in held[0]}


def train(texts: DataFrame, unigram: np.ndarray) -> lb.Params:
    """Parameters after a step for each slice of texts(slice, counts, classes)."""
    adam = lb.Adam(lb.start(unigram), RATE, SLICES)
    for k in range(SLICES):
        p, noise = adam.p, lb.noise_of(unigram, k)

        def run(batches, p=p, noise=noise):
            total, n = None, 0
            for row in together(batches):
                g = lb.gradient(p, row["classes"], row["counts"], *noise)
                total = g if total is None else {key: total[key] + g[key] for key in g}
                n += len(row["classes"])
            if total is not None:
                yield pa.record_batch([pa.array([n]), pa.array([lb.packed(total)])], ["n", "g"])

        def add(table: pa.Table) -> pa.Table:
            total = sum(np.frombuffer(g, "<f8") for g in table.column("g").to_pylist())
            return pa.table({"n": pa.array([sum(table.column("n").to_pylist())]), "g": pa.array([total.tobytes()])})

        parts = texts.where(F.col("slice") == k).select("counts", "classes").mapInArrow(run, "n long, g binary")
        sums = parts.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(ADDED))).groupBy("part").applyInArrow(add, "n long, g binary").collect()  # ADDED rows
        if sums:
            adam.move(lb.unpacked(sum(np.frombuffer(r["g"], "<f8") for r in sums).tobytes(), CLASSES), sum(r["n"] for r in sums))
    return adam.p


def score(docs: DataFrame, span: int = RANGE, unit: int = UNIT) -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    tokens = stage(tokenised(docs, unit), "tokens", "none")
    ranges = max(1, int(tokens.agg(F.sum("n_bytes")).first()[0] or 0) // span)
    words = stage(counted(tokens, ranges), "words", "none")
    types, n, ends = (int(x or 0) for x in words.agg(F.sum("words"), F.sum("tokens"), F.sum("ends")).first())
    smooth = n + 0.1 * (types + 1)
    top = most_frequent(words).collect()
    classes = Classes([(r["n"], r["hash"] % 2**64, r["profile"]) for r in top])
    mass = masses(words, classes)
    texts = stage(classed(tokens, words, classes, mass, smooth), "classed", "none")
    unigram = mass / smooth
    p = train(texts, unigram) if ends else lb.start(unigram)
    log_known, log_unknown = math.log1p(-0.1 / smooth) if n else -math.inf, math.log(0.1 / smooth)

    def run(batches):
        for row in together(batches):
            ids, held, counts, c = row["ids"], row["held"], row["counts"], row["classes"]
            # an unknown word has its base probability; without any training token all words are unknown
            own = np.where(c < CLASSES - 1, lb.log_probabilities(p, c, counts) + log_known if n else 0, log_unknown)
            own = np.where((c == 0) & (n == 0), log_unknown, own)
            total = np.bincount(np.repeat(np.arange(len(counts)), counts), own, len(counts)) + row["share"]
            out = [pa.array(ids, mask=held == SLICES + 1), pa.array(held >= SLICES), pa.array(counts), pa.array(row["known"]), pa.array(np.full(len(ids), n, np.int64)), pa.array(row["base"] / math.log(10)), pa.array(total / math.log(10))]
            yield pa.record_batch(out, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return texts.drop("slice").mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
