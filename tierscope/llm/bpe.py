"""Byte-level BPE encoding and decoding by a merge automaton (see automaton.py).

Texts are pre-split by the vocabulary's word pattern; every distinct word is encoded once for a worker
by table-driven transitions and then kept (the table of words is emptied when it is full). Texts are
cut at single spaces first, where the pattern always has a boundary.

Defined cases: a null text is empty (no tokens); the vocabulary's special token is matched as it stands in a
text; repeated rows are each returned; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from .automaton import Automaton
from .shared import documents_of, small_batches, vocabulary_path

#: The white space of the word pattern, and the pattern itself.
SPACE = r"\t\n\x0b\x0c\r \x85\xa0  -     　"
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Words that a worker remembers.
MOST_WORDS = 600_000


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones for themselves, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBpe:
    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        of, vocab = byte_letters(), spec["model"]["vocab"]
        raw = lambda s: bytes(of[c] for c in s)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.automaton = Automaton(
            {raw(c): vocab[c] for c in of if c in vocab},
            [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs],
            {t: raw(s) for s, t in vocab.items()},
        )
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.label = self.automaton.label | {t: s.encode() for s, t in self.special.items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.words = regex.compile(WORDS.replace(r"\s", f"[{SPACE}]").replace(r"[^[", "[^").replace(r"]\p{L}\p{N}]", r"\p{L}\p{N}]").replace(r"\S", f"[^{SPACE}]"))
        #: A space in a run of white space, but for its first or last place before a word, is not a boundary.
        self.tangled = re.compile(f"[{SPACE}] (?:[{SPACE}]|\\Z)")
        self.known: dict[str, tuple[str, bytes]] = {}

    def path(self, text: str) -> list[int]:
        """Tokens of a text without special tokens."""
        encode, out = self.automaton.encode, []
        for w in self.words.findall(text):
            out += encode(w.encode())
        return out

    def piece(self, text: str) -> tuple[str, bytes]:
        """Decimal ids joined by commas, and the labels that decoding emits for them."""
        ids = self.path(text)
        return ",".join(map(str, ids)), b"".join(map(self.label.__getitem__, ids))

    def encode(self, text: str) -> tuple[str, bytes]:
        """The same for a whole text, special tokens included."""
        parts = self.cut.split(text) if self.cut and any(s in text for s in self.special) else [text]
        if len(parts) > 1:
            done = [(str(self.special[p]), p.encode()) if p in self.special else self.encode_plain(p) for p in parts if p]
            return ",".join(a for a, _ in done), b"".join(b for _, b in done)
        return self.encode_plain(text)

    def encode_plain(self, text: str) -> tuple[str, bytes]:
        if self.tangled.search(text):
            return self.piece(text)
        first, *rest = text.split(" ")
        known, out = self.known, [self.piece(first)] if first else []
        if len(known) > MOST_WORDS:
            known.clear()
        for w in rest:
            if (got := known.get(w)) is None:
                got = self.piece(" " + w)
                if len(w) < 64:
                    known[w] = got
            out.append(got)
        if not out:
            return "", b""
        ids, labels = zip(*out, strict=True)
        return ",".join(ids), b"".join(labels)

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.label.__getitem__, ids)).decode("utf-8", "replace")


_loaded: dict[str, ByteBpe] = {}


def loaded(path: str) -> ByteBpe:
    """One automaton for a worker process."""
    if path not in _loaded:
        _loaded[path] = ByteBpe(path)
    return _loaded[path]


def encode(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, ids (array of int) and decoded (text): for use, not for digests."""
    path = vocabulary or vocabulary_path("byte_bpe_50k.json")
    small_batches(docs.sparkSession)

    def run(batches):
        bpe = loaded(path)
        for b in batches:
            done = [bpe.encode(t) for t in b.column("text").to_pylist()]
            yield pa.record_batch([b.column("doc_id"), pa.array([[int(x) for x in i.split(",")] if i else [] for i, _ in done], pa.list_(pa.int32())), pa.array([x.decode("utf-8", "replace") for _, x in done], pa.string())], ["doc_id", "ids", "decoded"])

    return documents_of(docs).mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def digest(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of decimal ids joined by commas), decoded_sha256."""
    path = vocabulary or vocabulary_path("byte_bpe_50k.json")
    small_batches(docs.sparkSession)

    def run(batches):
        bpe = loaded(path)
        for b in batches:
            n, ids_sha, text_sha = [], [], []
            for t in b.column("text").to_pylist():
                ids, labels = bpe.encode(t)
                n.append(ids.count(",") + 1 if ids else 0)
                ids_sha.append(hashlib.sha256(ids.encode()).hexdigest())
                text_sha.append(hashlib.sha256(labels.decode("utf-8", "replace").encode()).hexdigest())
            yield pa.record_batch([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return documents_of(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
