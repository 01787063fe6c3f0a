"""Fill-in-the-middle: texts cut at line ends in prefix, middle and suffix and put in another order, by big-integer bit-parallelism.

A text's bytes are classed by one bytes.translate and read as one integer, bit i for byte i. Lines begin at bit 0 and one bit above
each newline, so a shift marks them and bit_count gives their number n; the byte at which line k begins is the bit of rank k, selected by halving the
integer again and again. Sentinels are found by and-ing the shifted masks of their bytes, and code points counted in the mask of bytes that begin one.

The cuts are drawn from the first four 8-digit groups h1 to h4 of the hexadecimal SHA-256 of `seed:doc_id`: the prefix ends after the
smaller of h1 and h2 modulo n + 1 lines, the middle after the larger; h3 modulo 100 decides whether a text is transformed, h4 modulo 100 for which form.

Defined cases: a null text is empty; an empty text, or one that holds a sentinel, stays plain, with null lengths; a null doc_id counts as empty in the hash;
rows with one doc_id are cut by the same numbers; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import documents_of, small_batches

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Bytes that begin a code point: all but the continuation bytes of UTF-8.
BEGINS = bytes(b for b in range(256) if b & 0xC0 != 0x80)


@lru_cache(512)
def class_table(members: bytes) -> bytes:
    return bytes(b"01"[b in members] for b in range(256))


def mask(data: bytes, members: bytes) -> int:
    """An integer whose bit i tells whether byte i is one of members."""
    return int(data.translate(class_table(members))[::-1] or b"0", 2)


def line_starts(data: bytes) -> int:
    return (mask(data, b"\n") << 1 | 1) & ((1 << len(data)) - 1)


def select(bits: int, rank: int) -> int:
    """The position of the set bit of a rank, from 0: the half that holds it is taken until one bit is left."""
    at, width = 0, bits.bit_length()
    while width > 1:
        half = width // 2
        low = bits & ((1 << half) - 1)
        ones = low.bit_count()
        if rank < ones:
            bits, width = low, half
        else:
            bits, rank, at, width = bits >> half, rank - ones, at + half, width - half
    return at


def occurrences(data: bytes, word: bytes) -> int:
    """An integer whose bit i tells whether word begins at byte i."""
    found = -1
    for j, byte in enumerate(word):
        found &= mask(data, bytes([byte])) >> j
        if not found:
            break
    return found


def check_sentinels(words: tuple[str, ...]) -> None:
    """A sentinel next to any text without sentinels has to be found at its own place alone."""
    for a in words:
        for b in words:
            if not a or len(set(words)) < len(words) or (a != b and a in b) or any(a.endswith(b[:n]) for n in range(1, min(len(a), len(b)) + (a is not b))):
                raise ValueError(f"sentinels overlap: {a!r}, {b!r}")


def cut(data: bytes, doc_id: str, seed: int, rate: int, spm: int, words: tuple[bytes, bytes, bytes]) -> tuple:
    """n, form, code points of prefix and middle, output of one text."""
    starts = line_starts(data)
    n = starts.bit_count()
    digits = hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()
    h = [int(digits[i : i + 8], 16) for i in (0, 8, 16, 24)]
    if not data or h[2] % 100 >= rate or any(occurrences(data, w) for w in words):
        return n, "plain", None, None, data
    a, b = (select(starts, k) if k < n else len(data) for k in sorted((h[0] % (n + 1), h[1] % (n + 1))))
    begins = mask(data, BEGINS)
    to_a, to_b = ((begins & ((1 << x) - 1)).bit_count() for x in (a, b))
    p, s, m = words
    prefix, middle, suffix = data[:a], data[a:b], data[b:]
    if h[3] % 100 < spm:
        return n, "spm", to_a, to_b - to_a, b"".join((s, suffix, p, prefix, m, middle))
    return n, "psm", to_a, to_b - to_a, b"".join((p, prefix, s, suffix, m, middle))


def transform(docs: DataFrame, seed: int = 7, rate: int = 100, spm: int = 50, sentinels: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> DataFrame:
    """doc_id, n (lines), form (plain, psm, spm), prefix_chars, middle_chars, output of every row of docs.

    rate: per cent of texts that are transformed; spm: per cent of those with the suffix first; sentinels: of prefix, suffix and middle."""
    check_sentinels(sentinels)
    small_batches(docs.sparkSession)
    words = tuple(w.encode() for w in sentinels)
    kinds = {"n": pa.int64(), "form": pa.string(), "prefix_chars": pa.int64(), "middle_chars": pa.int64(), "output": pa.binary()}

    def run(batches):
        for b in batches:
            rows = [cut(t.as_py(), "" if i is None else str(i), seed, rate, spm, words) for i, t in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True)]
            columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
            yield pa.record_batch([b.column("doc_id"), *(pa.array(x, k) for x, k in zip(columns, kinds.values(), strict=True))], ["doc_id", *kinds])

    cast = documents_of(docs).select("doc_id", F.col("text").cast("binary").alias("text"))
    made = cast.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output binary")
    return made.withColumn("output", F.col("output").cast("string"))


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> Column:
    """The text that an output was made from."""

    def part(word: str) -> Column:
        rest = F.split_part(output, F.lit(word), F.lit(2))
        for w in sentinels:
            rest = F.split_part(rest, F.lit(w), F.lit(1))
        return rest

    prefix, suffix, middle = map(part, sentinels)
    return F.when(form == "plain", output).otherwise(F.concat(prefix, middle, suffix))
