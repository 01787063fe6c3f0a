"""Removal of repeated byte strings across documents, by distributed prefix doubling over sampled positions.

The rank of a position is a fingerprint of the bytes that follow it, made by doubling (1, 2, 4, 8, 16 bytes,
then HALF = threshold / 2). Every window of `threshold` bytes holds, at its smallest HALF-byte rank, a
position that is picked wherever the same window occurs, so ranks are exchanged for these alone (about
one in fourteen). Then, with Spark dealing out ranges of ranks and sorting each:

1. Positions are sorted by rank pair: the HALF-byte rank, and the rank of the context, which reaches
   HALF bytes back and a threshold on. A rank that one document alone has is unique and dropped. A
   position whose pair also stands in a smaller document is past the threshold on both sides: its
   whole context is removed. For each other pair of a shared rank one position goes on.
2. Those positions bring their contexts, and are reranked at each offset 0..HALF by the full threshold
   window there; the windows that a smaller document has too are removed.

The texts are kept in compressed units of about UNIT bytes; what comes back to a unit are places in its own
sorted list. A string that very many documents share counts once for each unit. Ranks are 64-bit hashes of which 48 bits
travel for a rank and 48 for a context within its rank, so a false match takes 96 bits; a window's hash has 64 within a rank's run.

Positions travel packed, a unit's share of a range in one row: as plain rows that Spark sorts by rank pair (the same steps and
results) they took more disk than the check allows (README). A range is sorted in numpy.

Defined cases: a null text is empty; texts shorter than the threshold lose nothing; repeated rows
are the same document, so neither takes from the other; a null doc_id neither gives nor loses; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import documents_of, rows_of, small_batches, stage

THRESHOLD = 50
#: Bytes of text in a unit, looked at in one go, and behind one range of ranks.
UNIT, SLICE, RANGE = 2 << 20, 1 << 18, 5 << 20
#: Bits of a rank and of a context that travel.
BITS = 48
MIX, LARGE = np.uint64(0x9E3779B97F4A7C15), np.uint64(2**64 - 1)
NONE = np.iinfo(np.int64).min


def units(docs: DataFrame, unit: int = UNIT, rest: bool = False) -> DataFrame:
    """unit (any unique number), n_bytes, ids, lengths (binary), blob (the texts, one after the other, compressed).

    With rest, also the other columns of the rows (binary, an Arrow stream), of a docs that has them."""
    small_batches(docs.sparkSession)

    def run(batches):
        import zstandard

        def packed():
            raw = b"".join(texts)
            columns = [pa.array([uuid.uuid4().int >> 66]), pa.array([len(raw)]), pa.array([np.array(ids, "<i8").tobytes()]), pa.array([np.array([*map(len, texts)], "<i8").tobytes()]), pa.array([zstandard.ZstdCompressor(level=3).compress(raw)])]
            if rest:
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, others[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                    for o in others:
                        out.write_batch(o)
                columns.append(pa.array([sink.getvalue().to_pybytes()]))
            return pa.record_batch(columns, ["unit", "n_bytes", "ids", "lengths", "blob", "rest"][: len(columns)])

        ids, texts, others, size = [], [], [], 0
        for b in batches:
            other, first = b.drop_columns(["text"]), 0
            for k, (doc, text) in enumerate(zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True)):
                ids.append(NONE if doc is None else doc)
                texts.append((text or "").encode())
                size += len(texts[-1])
                if size >= unit:
                    others.append(other.slice(first, k + 1 - first))
                    yield packed()
                    ids, texts, others, size, first = [], [], [], 0, k + 1
            if first < b.num_rows:
                others.append(other.slice(first))
        if ids:
            yield packed()

    rows = docs if rest else documents_of(docs)
    return rows.mapInArrow(run, "unit long, n_bytes long, ids binary, lengths binary, blob binary" + (", rest binary" if rest else ""))


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def doubled(x: np.ndarray, size: int) -> np.ndarray:
    """Rank of the `size` bytes at each place of x: the rank of twice a length is that of the pair at that offset."""
    one = x.astype(np.uint64) + np.uint64(1)
    out, at, length, power = None, 0, 1, MIX
    while True:
        if size & length:
            part = one[at : at + len(x) - size + 1]
            out = part if out is None else out * power + part
            at += length
        length *= 2
        if length > size:
            return mixed(out)
        half = length // 2
        one = one[: len(one) - half] * power + one[half:]
        power = np.uint64(int(power) ** 2 % 2**64)


def sliding(a: np.ndarray, width: int, pick) -> np.ndarray:
    """pick (np.minimum or np.maximum) over every `width` neighbours."""
    have = 1
    while have < width:
        step = min(have, width - have)
        a = pick(a[: len(a) - step], a[step:])
        have += step
    return a


class Unit:
    """The texts of a unit and the positions picked in them."""

    def __init__(self, ids: bytes, lengths: bytes, blob: bytes, threshold: int):
        import zstandard

        self.ids, self.lengths = np.frombuffer(ids, "<i8"), np.frombuffer(lengths, "<i8")
        self.raw = zstandard.ZstdDecompressor().decompress(blob) if self.lengths.sum() else b""
        self.x = np.frombuffer(self.raw, np.uint8)
        self.t, self.half = threshold, threshold // 2
        self.ends = np.cumsum(self.lengths)
        self.begins = self.ends - self.lengths
        parts = [p for lo in range(0, len(self.x), SLICE) if (p := self._picked(lo, min(lo + SLICE, len(self.x)))) is not None]
        none = np.zeros(0, np.uint64)
        self.at = np.concatenate([np.zeros(0, np.int64), *(p[0] for p in parts)])
        self.rank = np.concatenate([none, *(p[1] for p in parts)]) >> np.uint64(64 - BITS)
        self.context = np.concatenate([none, *(p[2] for p in parts)]) >> np.uint64(64 - BITS)
        self.row = np.searchsorted(self.ends, self.at, "right")
        self.doc = self.ids[self.row]
        keep = self.doc != NONE
        self.at, self.rank, self.context, self.row, self.doc = (v[keep] for v in (self.at, self.rank, self.context, self.row, self.doc))
        # one entry for each pair of rank and context, with the smallest document that has it
        order = np.lexsort((self.doc, self.context, self.rank))
        r, c = self.rank[order], self.context[order]
        new = np.r_[True, (r[1:] != r[:-1]) | (c[1:] != c[:-1])] if len(order) else np.zeros(0, bool)
        self.entry = np.empty(len(order), np.int64)
        self.entry[order] = np.cumsum(new) - 1
        self.first = order[new]  # the position that stands for an entry

    def _picked(self, lo: int, hi: int):
        """Place, rank and context rank of the positions picked in [lo, hi)."""
        t, k = self.t, self.half
        a, b = max(0, lo - t - k), min(len(self.x), hi + t + k)
        if b - a < t:
            return None
        x = self.x[a:b]
        row = np.searchsorted(self.ends, np.arange(a, b, 4096), "right")
        first, last = int(row[0]), int(np.searchsorted(self.ends, b - 1, "right"))
        room = np.minimum(np.repeat(self.ends[first : last + 1], self.lengths[first : last + 1])[a - self.begins[first] :][: b - a], b) - np.arange(a, b)
        h = doubled(x, k)
        n = b - a - t + 1
        whole = room[:n] >= t
        least = sliding(np.where(room[: len(h)] >= k, h, LARGE), t - k + 1, np.minimum)[:n]
        least[~whole] = 0
        back = sliding(np.concatenate([np.zeros(t - k, np.uint64), least, np.zeros(len(h) - n, np.uint64)]), t - k + 1, np.maximum)
        at = np.flatnonzero((back == h) & (back > 0))
        at = at[(at >= lo - a) & (at < hi - a)]
        if not len(at):
            return None
        begin = self.begins[np.searchsorted(self.ends, at + a, "right")] - a
        left, right = np.minimum(at - begin, k), np.minimum(room[at], t)
        full = (left == k) & (right == t)
        context = np.zeros(len(at), np.uint64)
        f = at[full]
        context[full] = mixed(mixed(h[f - k] * MIX + h[f]) * MIX + h[f + k])
        context[~full] = self._clipped(at[~full] + a, left[~full], right[~full])
        return at + a, h[at], context

    def _clipped(self, at, left, right) -> np.ndarray:
        h = np.zeros(len(at), np.uint64)
        for j in range(-self.half, self.t):
            inside = (j >= -left) & (j < right)
            c = self.x[np.clip(at + j, 0, len(self.x) - 1)].astype(np.uint64)
            h = h * MIX + np.where(inside, c + np.uint64(1), np.uint64(0))
        return mixed(h ^ MIX)

    def around(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Begin and end of the context of positions."""
        at, row = self.at[which], self.row[which]
        return np.maximum(at - self.half, self.begins[row]), np.minimum(at + self.t, self.ends[row]), at

    def contexts(self, which: np.ndarray) -> np.ndarray:
        """The context bytes of positions, in rows of half + threshold."""
        at = self.at[which]
        return self.x[np.clip(at[:, None] + np.arange(-self.half, self.t), 0, len(self.x) - 1)]


def planes(v: np.ndarray, width: int) -> bytes:
    """The low `width` bytes of unsigned numbers, byte by byte, so that even bytes compress."""
    return v.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def unplanes(b: bytes, width: int) -> np.ndarray:
    out = np.zeros((len(b) // width, 8), np.uint8)
    out[:, :width] = np.frombuffer(b, np.uint8).reshape(width, -1).T
    return out.view("<u8").ravel()


def steps(v: np.ndarray) -> np.ndarray:
    """A sorted list as its first number and the steps after it."""
    return np.diff(v, prepend=np.zeros(1, v.dtype))


def doc_numbers(docs: np.ndarray) -> tuple[bytes, bytes]:
    """Documents as places in their own sorted list, and that list."""
    import zstandard

    own, place = np.unique(docs, return_inverse=True)
    return planes(place.astype(np.uint64), 2 if len(own) <= 1 << 16 else 4), zstandard.ZstdCompressor(level=3).compress(np.diff(own, prepend=0).astype("<i8").tobytes())


def doc_ids(places: bytes, own: bytes) -> np.ndarray:
    import zstandard

    ids = np.cumsum(np.frombuffer(zstandard.ZstdDecompressor().decompress(own), "<i8"))
    return ids[unplanes(places, 2 if len(ids) <= 1 << 16 else 4).astype(np.int64)]


def ranges_of(rank: np.ndarray, ranges: int) -> np.ndarray:
    """Where each range begins in a sorted list of ranks."""
    return np.searchsorted(rank, np.array([-(-(i << BITS) // ranges) for i in range(ranges + 1)], np.uint64))


PAIRS = "range int, unit long, first long, ranks binary, contexts binary, docs binary, own binary"


def exchanged_pairs(table: pa.Table) -> pa.Table:
    """Of one range: entries to go on with (False) and entries that a smaller document has (True), back to their units."""
    unit, first = table.column("unit").to_numpy(), table.column("first").to_numpy()
    rank = [np.cumsum(unplanes(b, BITS // 8)) for b in table.column("ranks").to_pylist()]
    context = [unplanes(b, BITS // 8) for b in table.column("contexts").to_pylist()]
    doc = [doc_ids(a, b) for a, b in zip(table.column("docs").to_pylist(), table.column("own").to_pylist(), strict=True)]
    sizes = [len(r) for r in rank]
    rank, context, doc = np.concatenate(rank), np.concatenate(context), np.concatenate(doc)
    place = np.concatenate([np.arange(n) + f for n, f in zip(sizes, first.tolist(), strict=True)])
    source = np.repeat(np.arange(len(sizes)), sizes)
    order = np.argsort(rank, kind="stable")
    same = rank[order][1:] == rank[order][:-1]
    order = order[np.r_[False, same] | np.r_[same, False]]  # entries whose rank stands more than once
    order = order[np.lexsort((doc[order], context[order], rank[order]))]
    r, c, d = rank[order], context[order], doc[order]
    out: list[tuple] = []
    if len(order):
        new_rank = np.r_[True, r[1:] != r[:-1]]
        new_pair = new_rank | np.r_[True, c[1:] != c[:-1]]
        group = np.cumsum(new_rank) - 1
        least, most = np.minimum.reduceat(d, np.flatnonzero(new_rank)), np.maximum.reduceat(d, np.flatnonzero(new_rank))
        pairs = np.add.reduceat(new_pair.astype(np.int64), np.flatnonzero(new_rank))
        past = d > d[new_pair][np.cumsum(new_pair) - 1]
        on = ~past & (pairs > 1)[group] & (least < most)[group]
        by = np.argsort(source[order], kind="stable")
        cuts = np.searchsorted(source[order][by], np.arange(len(sizes) + 1))
        out = []
        for s in range(len(sizes)):
            own = by[cuts[s] : cuts[s + 1]]
            own = own[past[own] | on[own]]
            if len(own):
                out.append((unit[s], place[order[own]].astype("<i8").tobytes(), past[own].tobytes()))
    u, p, f = zip(*out, strict=True) if out else ((), (), ())
    return pa.table({"unit": pa.array(u, pa.int64()), "places": pa.array(p, pa.binary()), "past": pa.array(f, pa.binary())})


def exchanged_windows(table: pa.Table, threshold: int) -> pa.Table:
    """Of one range: for each context brought, at which offsets a smaller document has the same window (bits)."""
    import zstandard

    half = threshold // 2
    unit, place = table.column("unit").to_pylist(), table.column("places").to_pylist()
    rows = [np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8).reshape(-1, half + threshold) for b in table.column("contexts").to_pylist()]
    sizes = [len(r) for r in rows]
    x = np.concatenate(rows)
    left, right = (np.concatenate([np.frombuffer(b, np.uint8) for b in table.column(c).to_pylist()]) for c in ("left", "right"))
    doc = np.concatenate([np.frombuffer(b, "<i8") for b in table.column("docs").to_pylist()])
    bits = np.zeros(len(x), np.uint64)
    for offset in range(half + 1):  # the window begins `offset` before the position
        has = np.flatnonzero((left >= offset) & (right >= threshold - offset))
        if len(has) < 2:
            continue
        h = np.zeros(len(has), np.uint64)
        for j in range(half - offset, half - offset + threshold):
            h = h * MIX + (x[has, j] + np.uint64(1))
        h, d = mixed(h), doc[has]
        order = np.argsort(h, kind="stable")
        begins = np.flatnonzero(np.r_[True, h[order][1:] != h[order][:-1]])
        least = np.repeat(np.minimum.reduceat(d[order], begins), np.diff(np.r_[begins, len(order)]))
        bits[has[order[least < d[order]]]] |= np.uint64(1) << np.uint64(offset)
    cuts = np.cumsum([0, *sizes])
    return pa.table({"unit": pa.array(unit, pa.int64()), "places": pa.array(place, pa.binary()), "bits": pa.array([bits[a:b].astype("<u8").tobytes() for a, b in zip(cuts, cuts[1:], strict=False)], pa.binary())})


def joined(told) -> tuple[np.ndarray, np.ndarray]:
    """Places and what is told of them, from all ranges."""
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *(np.frombuffer(a, "<i8") for a, _ in told)]), np.concatenate([np.zeros(0, np.uint8), *(np.frombuffer(b, np.uint8) for _, b in told)])


def removed_runs(u: Unit, past: np.ndarray, on: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, begin and end of the maximal removed runs. past, on: entries; bits: of the entries `on`."""
    gone = np.zeros(len(u.first), bool)
    gone[past] = True
    rep = u.doc[u.first][u.entry]
    whole = np.flatnonzero((gone[u.entry] | (u.doc > rep)))  # or a smaller document of the same unit
    b, e, _ = u.around(whole)
    keep = e - b >= u.t
    rows, begins, ends = [u.row[whole][keep]], [b[keep]], [e[keep]]
    told = np.zeros(len(u.first), np.uint64)
    told[on] = bits
    some = np.flatnonzero(told[u.entry] > 0)
    for offset in range(u.half + 1) if len(some) else ():
        hit = some[(told[u.entry[some]] >> np.uint64(offset)) & np.uint64(1) > 0]
        rows.append(u.row[hit])
        begins.append(u.at[hit] - offset)
        ends.append(u.at[hit] - offset + u.t)
    row, b, e = np.concatenate(rows), np.concatenate(begins), np.concatenate(ends)
    order = np.argsort(b, kind="stable")
    row, b, e = row[order], b[order], e[order]
    if not len(b):
        return row, b, e
    far = np.maximum.accumulate(e)  # rows stand in order, so a row's runs never reach the next row's
    new = np.r_[True, (b[1:] > far[:-1]) | (row[1:] != row[:-1])]
    return row[new], b[new], far[np.r_[np.flatnonzero(new)[1:] - 1, len(far) - 1]]


def kept_parts(u: Unit, rows: np.ndarray, begins: np.ndarray, ends: np.ndarray):
    """For each text: its id, the number of its removed runs, and the parts that stay."""
    cuts = np.searchsorted(rows, np.arange(len(u.ids) + 1))
    for i, (doc, lo, hi) in enumerate(zip(u.ids.tolist(), u.begins.tolist(), u.ends.tolist(), strict=True)):
        at, parts = lo, []
        for s, e in zip(begins[cuts[i] : cuts[i + 1]].tolist(), ends[cuts[i] : cuts[i + 1]].tolist(), strict=True):
            parts.append(u.raw[at:s])
            at = e
        yield doc, len(parts), [*parts, u.raw[at:hi]]


def digests(u: Unit, row: dict, runs) -> pa.RecordBatch:
    out: list[list] = [[] for _ in range(5)]
    sizes = u.lengths.tolist()
    for n, (doc, spans, parts) in zip(sizes, kept_parts(u, *runs), strict=True):
        kept = b"".join(parts)
        for column, v in zip(out, (None if doc == NONE else doc, n, n - len(kept), spans, hashlib.sha256(kept).hexdigest()), strict=True):
            column.append(v)
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
    return pa.record_batch([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def suffix_dedup(docs: DataFrame, threshold: int = THRESHOLD, unit: int = UNIT, span: int = RANGE) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return _each_unit(docs, threshold, unit, span, False, digests, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def _each_unit(docs: DataFrame, threshold: int, unit: int, span: int, rest: bool, made, schema) -> DataFrame:
    """made(unit, row, removed runs) for every unit, as a table of schema."""
    held = stage(units(docs, unit, rest), "units", "none")
    ranges = max(1, int(held.agg(F.sum("n_bytes")).first()[0] or 0) // span)

    def send_pairs(batches):
        for b in batches:
            for row in rows_of(b):
                u = Unit(row["ids"], row["lengths"], row["blob"], threshold)
                rank, context, doc = u.rank[u.first], u.context[u.first], u.doc[u.first]
                cuts = ranges_of(rank, ranges).tolist()
                has = [i for i in range(ranges) if cuts[i] < cuts[i + 1]]
                part = [slice(cuts[i], cuts[i + 1]) for i in has]
                docs_of = [doc_numbers(doc[s]) for s in part]
                yield pa.record_batch(
                    [pa.array(has, pa.int32()), pa.array([row["unit"]] * len(has), pa.int64()), pa.array([s.start for s in part], pa.int64()), pa.array([planes(steps(rank[s]), BITS // 8) for s in part], pa.binary()), pa.array([planes(context[s], BITS // 8) for s in part], pa.binary()), pa.array([a for a, _ in docs_of], pa.binary()), pa.array([b for _, b in docs_of], pa.binary())],
                    ["range", "unit", "first", "ranks", "contexts", "docs", "own"],
                )

    pairs = held.select("unit", "ids", "lengths", "blob").mapInArrow(send_pairs, PAIRS)
    told = stage(pairs.groupBy("range").applyInArrow(exchanged_pairs, "unit long, places binary, past binary"), "pairs")
    told = told.groupBy("unit").agg(F.collect_list(F.struct("places", "past")).alias("told"))

    def send_windows(batches):
        import zstandard

        for b in batches:
            for row in rows_of(b):
                place, past = joined([(t["places"], t["past"]) for t in row["told"]])
                on = np.sort(place[past == 0])
                if not len(on):
                    continue
                u = Unit(row["ids"], row["lengths"], row["blob"], threshold)
                which = u.first[on]
                begin, end, at = u.around(which)
                cuts = ranges_of(u.rank[which], ranges).tolist()
                for i in range(ranges):
                    if (s := slice(cuts[i], cuts[i + 1])).start < s.stop:
                        yield pa.record_batch(
                            [pa.array([i], pa.int32()), pa.array([row["unit"]], pa.int64()), pa.array([on[s].astype("<i8").tobytes()], pa.binary()), pa.array([zstandard.ZstdCompressor(level=3).compress(u.contexts(which[s]).tobytes())], pa.binary()), pa.array([(at - begin)[s].astype(np.uint8).tobytes()], pa.binary()), pa.array([(end - at)[s].astype(np.uint8).tobytes()], pa.binary()), pa.array([u.doc[which[s]].astype("<i8").tobytes()], pa.binary())],
                            ["range", "unit", "places", "contexts", "left", "right", "docs"],
                        )

    shared = held.join(told, "unit").select("unit", "ids", "lengths", "blob", "told")
    windows = shared.mapInArrow(send_windows, "range int, unit long, places binary, contexts binary, left binary, right binary, docs binary")
    seen = windows.groupBy("range").applyInArrow(lambda t: exchanged_windows(t, threshold), "unit long, places binary, bits binary")
    seen = stage(seen, "windows").groupBy("unit").agg(F.collect_list(F.struct("places", "bits")).alias("seen"))

    def result(batches):
        for b in batches:
            for row in rows_of(b):
                u = Unit(row["ids"], row["lengths"], row["blob"], threshold)
                place, past = joined([(t["places"], t["past"]) for t in row["told"] or ()])
                on, raw = joined([(t["places"], t["bits"]) for t in row["seen"] or ()])
                rows, begins, ends = removed_runs(u, place[past == 1], on, np.frombuffer(raw.tobytes(), "<u8"))
                yield made(u, row, (rows, begins, ends))

    own = ["unit", "ids", "lengths", "blob", *(["rest"] if rest else [])]
    return held.join(told, "unit", "left").join(seen, "unit", "left").select(*own, "told", "seen").mapInArrow(result, schema)


def drop_repeats(docs: DataFrame, threshold: int = THRESHOLD, unit: int = UNIT, span: int = RANGE) -> DataFrame:
    """docs with repeated strings removed from text; every row stays, a null text as an empty one.

    Bytes of a character that a run cuts in two go with the run. n_chars, where it is a column, is counted anew."""
    names = docs.columns

    def made(u: Unit, row: dict, runs) -> pa.RecordBatch:
        rest = pa.ipc.open_stream(row["rest"]).read_all().combine_chunks()
        text = ["".join(p.decode("utf-8", "ignore") for p in parts) for _, _, parts in kept_parts(u, *runs)]
        columns = {c: rest.column(c).combine_chunks() for c in rest.column_names} | {"text": pa.array(text, pa.string())}
        if "n_chars" in columns:
            columns["n_chars"] = pa.array([len(t) for t in text], columns["n_chars"].type)
        return pa.RecordBatch.from_arrays([c.combine_chunks() if isinstance(c := columns[n], pa.ChunkedArray) else c for n in names], names)

    return _each_unit(docs, threshold, unit, span, True, made, docs.schema)
