"""Packing tokenised documents into sequences of bounded length.

Documents are tokenised and cut in pieces of at most `capacity` tokens. The histogram of piece lengths
(at most `capacity` numbers, whatever the corpus) goes to the driver, where the configuration linear
program over it is solved by multiplicative weights (see Program): each configuration (multiset of lengths that fit
in one sequence) is weighted by what its pieces are worth, prices of lengths are multiplied by how far they are
covered, and a knapsack dynamic program prices: it finds for each length the most valuable configuration that holds it,
and a dual bound. The fractional solution is rounded to whole sequences in several orders, what is left over is put by
best fit, and the least plan is kept; it is never worse than best fit alone. All rounds run at every size, unless a plan
meets the dual bound. The plan has one block of places for each length of a configuration, so its size depends on capacity
and rounds alone; each piece finds its place from its rank among those of its length.

Ranks are counted in salted groups with offsets, so a length that most pieces share is not one task.

Defined cases: a null text is empty, and an empty document is its end token; repeated rows are packed
each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import SPACE, byte_letters
from .shared import documents_of, small_batches, stage, vocabulary_path

CAPACITY, END = 4096, 1
#: Width of the weights in each round of multiplicative weights (a knapsack program prices the lengths after each), the steps in
#: a round, and the gap between the fractional solution and the dual bound at which a solution is rounded at once.
ROUNDS, STEPS, GAP = (0.1, 0.1, 0.05, 0.05, 0.02, 0.02, 0.02, 0.01, 0.01, 0.005, 0.005, 0.0025), 160, 0.0002
#: Words a worker remembers, and pieces ranked in one group.
MOST_WORDS, GROUP = 900_000, 2000
#: What a vocabulary does before its model, if texts of PLAIN characters are to be cut in PARTS (once lowered) here: these are unchanged
#: by NFC, have one lower case alone, and are letters, digits, white space or others by any edition of Unicode.
BEFORE = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}
PLAIN = re.compile(r"[\t-\r -~\xc0-\xd6\xd8-\xf6\xf8-\xff]+")
PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|[^\t-\r a-z\xdf-\xf6\xf8-\xff0-9]+")

Config = tuple[tuple[int, int], ...]  # (place of a length, copies), ...
Plan = tuple[int, dict[int, int]]  # sequences alike, place of a length (or the length) to copies


class PartIds(dict):
    """Token ids (little-endian 32-bit) of the parts of plain texts, which the vocabulary's model encodes one by one.

    There are far fewer parts than words with their marks and capitals."""

    def __init__(self, model):
        self.model, self.letters = model, {b: c for c, b in byte_letters().items()}

    def __missing__(self, part: str) -> bytes:
        tokens = self.model.tokenize(part.encode().decode("latin-1").translate(self.letters))  # a letter for each byte
        ids = b"".join([t.id.to_bytes(4, "little") for t in tokens])
        if len(part) < 48:
            self[part] = ids
        return ids

    def of(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, PARTS.findall(text.lower())))


class WordIds(dict):
    """Token ids (little-endian 32-bit) of a text that has no white space inside, kept for each worker.

    The vocabulary drops white space and never merges over it, so a text's ids are those of its words; plain texts and words go by parts."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokens = Tokenizer.from_file(path)
        self.tokens.no_truncation()
        self.tokens.no_padding()
        self.parts = PartIds(self.tokens.model)
        self.cut = all(spec[k] == v for k, v in BEFORE.items())
        self.special = [x["content"] for x in spec["added_tokens"]]
        self.odd = re.compile("[\x1c-\x1f]")
        self.space = re.compile(f"[{SPACE}]+")

    def plain(self, text: str) -> bool:
        return self.cut and PLAIN.fullmatch(text) is not None and not any(s in text for s in self.special)

    def __missing__(self, word: str) -> bytes:
        if self.plain(word):
            ids = self.parts.of(word)
        else:
            ids = np.array(self.tokens.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
        if len(word) < 48:
            self[word] = ids
        return ids

    def of(self, text: str) -> bytes:
        if len(self) + len(self.parts) > MOST_WORDS:
            self.clear()
            self.parts.clear()
        if self.plain(text):
            return self.parts.of(text)
        # str.split() takes four control characters for white space that the vocabulary keeps
        words = [w for w in self.space.split(text) if w] if self.odd.search(text) else text.split()
        return b"".join(map(self.__getitem__, words))


_loaded: dict[str, WordIds] = {}


def loaded(path: str) -> WordIds:
    if path not in _loaded:
        _loaded[path] = WordIds(path)
    return _loaded[path]


PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None, ids: bool = False) -> DataFrame:
    """The pieces of each document; with ids, also their tokens (binary, little-endian 32-bit)."""
    path, end = vocabulary or vocabulary_path("word_bpe_49k.json"), np.array([END], "<u4").tobytes()
    small_batches(docs.sparkSession)

    def run(batches):
        words = loaded(path)
        for b in batches:
            out: list[list] = [[], [], [], [], [], []]
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                all_ids = words.of(text) + end
                for k, at in enumerate(range(0, len(all_ids), 4 * capacity)):
                    own = all_ids[at : at + 4 * capacity]
                    for column, v in zip(out, (doc, k, at // 4, len(own) // 4, zlib.crc32(own), own if ids else None), strict=True):
                        column.append(v)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            columns = [pa.array(c, t) for c, t in zip(out, kinds, strict=True)][: 6 if ids else 5]
            yield pa.record_batch(columns, ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(columns)])

    return documents_of(docs).mapInArrow(run, PIECE + (", ids binary" if ids else ""))


def priced(sizes: np.ndarray, values: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Knapsack with repeats: the best value in each space from 0 to capacity, and the size to take there (-1: leave one free)."""
    best, take = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for space in range(1, capacity + 1):
        best[space] = best[space - 1]
        if n := np.searchsorted(sizes, space, "right"):
            worth = best[space - sizes[:n]] + values[:n]
            if worth[k := worth.argmax()] > best[space] + 1e-15:
                best[space], take[space] = worth[k], k
    return best, take


def configurations(sizes: np.ndarray, values: np.ndarray, capacity: int, least: float) -> tuple[float, list[Config]]:
    """The best value of any configuration, and for each length the most valuable one that holds it, where it is worth `least`."""
    best, take = priced(sizes, values, capacity)
    found = []
    for j in np.flatnonzero(values + best[capacity - sizes] >= least).tolist():
        used, space = {j: 1}, capacity - int(sizes[j])
        while space > 0:
            if (k := int(take[space])) < 0:
                space -= 1
            else:
                used[k] = used.get(k, 0) + 1
                space -= int(sizes[k])
        found.append(tuple(sorted(used.items())))
    return float(best[capacity]), found


class Program:
    """The configuration program of a histogram: min sum(x) where the configurations, x times each, cover the counts.

    y prices the lengths; a configuration's weight is x = exp((its value - 1) / mu), so it is used where its pieces are worth
    a sequence. Prices are multiplied up where a length is covered too little, down where too much. A dual bound comes from
    any prices: what all pieces are worth, over the worth of the best configuration, by the knapsack program."""

    def __init__(self, sizes: np.ndarray, counts: np.ndarray, capacity: int, first: list[Config]):
        self.sizes, self.counts, self.capacity = sizes, counts.astype(float), capacity
        self.alike = [((j, capacity // s),) for j, s in enumerate(sizes.tolist())]  # these bound every price
        self.pool = dict.fromkeys([*self.alike, *first])
        self.y = sizes / capacity
        self.bound = float(self.counts @ sizes) / capacity
        self.price(0.0)

    def price(self, least: float) -> int:
        """Adds the configurations that are worth `least` at the prices as they are; how many are new."""
        most, found = configurations(self.sizes, self.y, self.capacity, least)
        self.bound = max(self.bound, float(self.counts @ self.y) / most)
        before = len(self.pool)
        self.pool.update(dict.fromkeys(found))
        self.keys = list(self.pool)
        self.column = np.repeat(np.arange(len(self.keys)), [len(k) for k in self.keys])
        self.row, copies = np.array([pair for k in self.keys for pair in k], np.int64).T
        self.copies = copies.astype(float)
        return len(self.pool) - before

    def settle(self, mu: float, steps: int) -> None:
        """Steps of multiplicative weights; x and y are means over the later half."""
        x, y = np.zeros(len(self.keys)), np.zeros(len(self.sizes))
        for step in range(steps):
            value = np.bincount(self.column, self.copies * self.y[self.row], len(self.keys))
            now = np.exp(np.minimum((value - 1) / mu, 30))
            cover = np.bincount(self.row, self.copies * now[self.column], len(self.sizes))
            self.y = self.y * np.exp(mu / 4 * np.clip(1 - cover / self.counts, -1, 1))
            if 2 * step >= steps:
                x += now
                y += self.y
        self.x, self.y = x / (steps - steps // 2), y / (steps - steps // 2)

    def total(self) -> float:
        """Sequences of the fractional solution, with the volume of what it leaves uncovered."""
        cover = np.bincount(self.row, self.copies * self.x[self.column], len(self.sizes))
        return float(self.x.sum() + np.maximum(self.counts - cover, 0) @ self.sizes / self.capacity)

    def prune(self) -> None:
        """Leaves out configurations that are hardly used (pricing finds them again if they come to be worth it)."""
        self.pool = dict.fromkeys([*self.alike, *(k for k, x in zip(self.keys, self.x.tolist(), strict=True) if x > 1e-4)])


def best_fit(sizes: np.ndarray, left: np.ndarray, capacity: int) -> list[Plan]:
    """Best fit of the left pieces, largest first, in bulk: (sequences alike, size index to copies)."""
    bins: dict[int, list[list]] = {}  # by free space: [how many, used]
    done: list[Plan] = []
    for j in range(len(sizes) - 1, -1, -1):
        size, n = int(sizes[j]), int(left[j])
        for free in sorted(k for k in bins if k >= size) if n else ():
            groups, each = bins.pop(free), free // size
            for many, used in groups:
                full, some = min(many, n // each), 0
                n -= full * each
                if full < many and n:
                    some, n = n, 0
                for m, copies in ((full, each), (1 if some else 0, some), (many - full - bool(some), 0)):
                    if m:
                        bins.setdefault(free - copies * size, []).append([m, used | ({j: used.get(j, 0) + copies} if copies else {})])
        if n:
            each = capacity // size
            for m, copies in ((n // each, each), (1 if n % each else 0, n % each)):
                if m:
                    bins.setdefault(capacity - copies * size, []).append([m, {j: copies}])
    for groups in bins.values():
        done += [(m, used) for m, used in groups]
    return done


def rounded(program: Program, order: np.ndarray, up: bool) -> list[Plan]:
    """Whole sequences of the solution in this order, as far as there are pieces, and the rest by best fit.

    up: amounts are rounded up; else down, and then configurations with the larger half of a fraction once more."""
    left, out = program.counts.astype(np.int64), []
    whole = np.ceil(program.x - 1e-6) if up else np.floor(program.x + 1e-6)
    passes = [(order, whole)] if up else [(order, whole), (order[(program.x - whole)[order] > 0.5], np.ones(len(order)))]
    for which, amount in passes:
        for c in which[amount[which] > 0].tolist():
            if many := min(int(amount[c]), *(int(left[k]) // n for k, n in program.keys[c])):
                out.append((many, dict(program.keys[c])))
                for k, n in program.keys[c]:
                    left[k] -= many * n
    return out + best_fit(program.sizes, left, program.capacity)


def solved(histogram: dict[int, int], capacity: int = CAPACITY, rounds: tuple[float, ...] = ROUNDS) -> tuple[list[Plan], float]:
    """(number of sequences, length to copies) of every configuration used, covering the histogram exactly; and a bound that no
    plan can go below."""
    sizes = np.array(sorted(histogram), dtype=np.int64)
    counts = np.array([histogram[s] for s in sizes.tolist()], dtype=np.int64)
    if len(sizes) == 0:
        return [], 0.0
    many = lambda p: sum(n for n, _ in p)
    best = best_fit(sizes, counts, capacity)
    program = Program(sizes, counts, capacity, [tuple(sorted(used.items())) for _, used in best])
    for i, mu in enumerate(rounds):
        program.settle(mu, STEPS)
        if last := i >= len(rounds) - 2 or program.total() <= (1 + GAP) * program.bound:
            free = capacity - np.bincount(program.column, program.copies * sizes[program.row], len(program.keys))
            orders = np.argsort(-program.x, kind="stable"), np.lexsort((-program.x, free))
            best = min([best, *(rounded(program, o, up) for o in orders for up in (True, False))], key=many)
        if many(best) <= np.ceil(program.bound - 1e-6) and last:
            break
        program.prune()
        program.price(1 - 2 * mu)
    return [(n, {int(sizes[k]): copies for k, copies in used.items()}) for n, used in best], program.bound


def plan(histogram: dict[int, int], capacity: int = CAPACITY, rounds: tuple[float, ...] = ROUNDS) -> list[Plan]:
    return solved(histogram, capacity, rounds)[0]


def blocks(made: list[Plan]) -> dict[str, np.ndarray]:
    """Places by (length, first rank): sequence of the first one, copies in a sequence, offset of the first copy."""
    rows, used, sequence = [], {}, 0
    for many, copies_of in made:
        at = 0
        for length, copies in sorted(copies_of.items(), reverse=True):
            rank = used.get(length, 0)
            rows.append((length, rank, sequence, copies, at))
            used[length] = rank + many * copies
            at += length * copies
        sequence += many
    table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)
    return {"key": (table[:, 0] << 40) + table[:, 1], "rank": table[:, 1], "sequence": table[:, 2], "copies": table[:, 3], "offset": table[:, 4]}


def place(rows: DataFrame, capacity: int = CAPACITY, rounds: tuple[float, ...] = ROUNDS) -> DataFrame:
    """rows (with doc_id, piece, length) and sequence_id, offset. rows must read the same each time: a staged table."""
    spark = rows.sparkSession
    histogram = {r[0]: r[1] for r in rows.groupBy("length").count().collect()}  # capacity rows at most
    salts = F.from_json(F.lit(json.dumps([1 + histogram.get(n, 0) // GROUP for n in range(capacity + 1)])), "array<int>")
    where = spark.sparkContext.broadcast(blocks(plan(histogram, capacity, rounds)))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.get(salts, F.col("length").cast("int"))))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    firsts = salted.groupBy("length", "salt").count().select("length", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    own = Window.partitionBy("length", "salt").orderBy("doc_id", "piece")
    ranked = salted.join(firsts, ["length", "salt"]).withColumn("rank", F.col("first") + F.row_number().over(own) - 1)
    columns = rows.columns

    def run(batches):
        w = where.value
        for b in batches:
            length, rank = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "rank"))
            k = np.searchsorted(w["key"], (length << 40) + rank, "right") - 1
            nth = rank - w["rank"][k]
            sequence = w["sequence"][k] + nth // w["copies"][k]
            offset = w["offset"][k] + nth % w["copies"][k] * length
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in columns), pa.array(sequence), pa.array(offset)], [*columns, "sequence_id", "offset"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return ranked.select(*columns, "rank").mapInArrow(run, f"{kinds}, sequence_id long, offset long")


def pack(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None, rounds: tuple[float, ...] = ROUNDS) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return place(stage(pieces(docs, capacity, vocabulary), "pieces"), capacity, rounds)


def sequences(docs: DataFrame, capacity: int = CAPACITY, vocabulary: str | None = None) -> DataFrame:
    """The packed sequences themselves: sequence_id, ids (array of int). Needs unique doc_id."""
    told = pack(docs, capacity, vocabulary).select("doc_id", "piece", "sequence_id", "offset")
    rows = pieces(docs, capacity, vocabulary, ids=True).join(told, ["doc_id", "piece"])
    packed = rows.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))

    def run(batches):
        for b in batches:
            ids = [np.frombuffer(b"".join(p["ids"] for p in parts), "<u4").astype(np.int32).tolist() for parts in b.column("parts").to_pylist()]
            yield pa.record_batch([b.column("sequence_id"), pa.array(ids, pa.list_(pa.int32()))], ["sequence_id", "ids"])

    return packed.mapInArrow(run, "sequence_id long, ids array<int>")
