"""WARC archives of pages: writing, reading back, and a globally ordered capture index.

Writing. Of records with equal payloads the one with the smallest page_id is a response, the others are revisits
without a payload of their own. Records go through Spark's text writer, whose line separator is the two CRLF that end a
WARC record, as gzip files.

Files hold about FILE bytes (records of more than LARGE go to files of FEW); a file is one gzip stream, so offsets and lengths are
places in the archive as it is when inflated.

Reading. A file is inflated piece by piece and parsed by Content-Length, one record in memory at a time; payload digests
of responses are computed anew and held against their headers.

Index. Each archive gives a run of captures sorted by URL key and time. Spark deals the runs out by ranges of
(URL key, time, page) with about RANGE captures each, so a range has a piece of every run, and merges the pieces with a
k-way loser tree; the ranges in order are the capture histories of the whole corpus. A URL key that very many captures
share is cut by time and page.

Defined cases: a null html is empty, a null url is the empty URL; rows with a null page_id are never what others refer
to unless all of a payload are; repeated rows are each written and each returned; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import stage, stage_path

CRLF = "\r\n"
#: Records in a file at most, its bytes on average, what is a large record, such records in a file, and captures in a range of the index.
PER_FILE, FILE, LARGE, FEW, RANGE = 4000, 32 << 20, 4 << 20, 4, 250_000
#: Fixed value: the letters of base32.
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Captures have no time of their own: they are a second apart from here by page_id, over and over within SPAN seconds, so any id has a time.
FIRST, SPAN = "2024-01-01 00:00:00", 315_360_000


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1, 32 letters, in SQL functions."""
    hexed = F.sha1(payload.cast("binary"))
    fives = [F.conv(F.substring(hexed, 10 * i + 1, 10), 16, 10).cast("long") for i in range(4)]
    return F.concat(*(F.substring(F.lit(LETTERS), F.shiftright(fives[i // 8], 35 - 5 * (i % 8)).bitwiseAND(F.lit(31)).cast("int") + 1, F.lit(1)) for i in range(32)))


def prepared(pages: DataFrame) -> DataFrame:
    html = F.coalesce("html", F.lit(""))
    when = F.timestamp_seconds(F.unix_timestamp(F.lit(FIRST)) + F.pmod(F.coalesce(F.col("page_id"), F.lit(0)), F.lit(SPAN)))
    return pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), html.alias("html"), F.date_format(when, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("date"), F.sha2(html.cast("binary"), 256).alias("sha"))


def payloads(rows: DataFrame) -> DataFrame:
    return stage(rows.select("page_id", "sha", F.octet_length("html").cast("long").alias("n_bytes")), "payloads")


def revisits(ids: DataFrame) -> DataFrame:
    """page_id, sha, refers_to of records whose payload a smaller page has; no join key repeats but for repeated rows."""
    firsts = ids.groupBy("sha").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1 and refers_to is not null").drop("n")
    later = ids.join(stage(firsts, "firsts"), "sha").where("page_id is null or page_id > refers_to")
    return stage(later.select("page_id", "sha", "refers_to").distinct(), "revisits")


def records(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """value: the text of each record, without the separator that ends it; n_bytes: of its payload."""
    told = revisits(ids).toDF("_page", "_sha", "refers_to")
    rows = rows.join(told, rows["page_id"].eqNullSafe(told["_page"]) & (rows["sha"] == told["_sha"]), "left")
    size = F.octet_length("html").cast("string")
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("none")), F.lit(">"))
    revisit = F.col("refers_to").isNotNull()
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), size, F.lit(CRLF + CRLF))
    block = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("html")))
    target = F.regexp_replace("url", r"[\x00-\x20\x7f]", "%20")
    head = [
        F.lit("WARC/1.1" + CRLF + "WARC-Type: "), F.when(revisit, F.lit("revisit")).otherwise(F.lit("response")),
        F.lit(CRLF + "WARC-Record-ID: "), name("page_id"), F.lit(CRLF + "WARC-Target-URI: "), target, F.lit(CRLF + "WARC-Date: "), F.col("date"),
        F.lit(CRLF + "WARC-Payload-Digest: sha1:"), base32_sha1(F.col("html")),
        F.when(revisit, F.concat(F.lit(CRLF + "WARC-Refers-To: "), name("refers_to"), F.lit(CRLF + "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))).otherwise(F.lit("")),
        F.lit(CRLF + "Content-Type: application/http; msgtype=response" + CRLF + "Content-Length: "), F.octet_length(block).cast("string"), F.lit(CRLF + CRLF),
    ]
    return rows.select(F.octet_length("html").alias("n_bytes"), F.concat(*head, block).alias("value"))


def write(pages: DataFrame, path: str, per_file: int = PER_FILE, large: int = LARGE) -> str:
    rows = prepared(pages)
    ids = payloads(rows)
    n, size, most = ids.agg(F.count(F.lit(1)), F.sum("n_bytes"), F.max("n_bytes")).first()
    made = records(rows, ids)
    parts = [(made.where(F.col("n_bytes") <= large) if (most or 0) > large else made, max(1, min(per_file, FILE * (n or 1) // ((size or 0) + 1))))]
    if (most or 0) > large:
        parts.append((made.where(F.col("n_bytes") > large), FEW))
    for part, many in parts:
        part.select("value").write.mode("append").option("lineSep", CRLF * 2).option("compression", "gzip").option("maxRecordsPerFile", many).text(path)
    return path


HEADER = re.compile(rb"([^:\r\n]+):[ \t]*([^\r\n]*)\r\n")
CAPTURE = "urlkey string, captured_at timestamp, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, file string, offset long, length long"
NAMES = [c.split()[0] for c in CAPTURE.split(", ")]


def inflated(content: bytes, step: int = 1 << 20):
    """A gzip file's content in pieces."""
    work, at = zlib.decompressobj(31), 0
    while at < len(content) or work.unconsumed_tail:
        data = work.unconsumed_tail or content[at : (at := at + step)]
        yield work.decompress(data, step)
        if work.eof:
            if rest := work.unused_data + content[at:]:
                yield from inflated(rest, step)
            return
    yield work.flush()


def parsed(pieces):
    """Headers (lower-case names), HTTP headers, payload, and place of each record of an archive that comes in pieces."""
    pieces, held, begin = iter(pieces), bytearray(), 0  # held: what is not parsed yet, from `begin` on

    def more() -> bool:
        piece = next(pieces, None)
        held.extend(piece or b"")
        return piece is not None

    while True:
        while (cut := held.find(b"\r\n\r\n")) < 0:
            if not more():
                if held.strip():
                    raise ValueError(f"no record at {begin}")
                return
        end = cut + 4
        head = {k.lower(): v for k, v in HEADER.findall(bytes(held[:end]))}
        whole = end + int(head[b"content-length"]) + 4
        while len(held) < whole:
            if not more():
                raise ValueError(f"the record at {begin} is cut short")
        block = bytes(held[end : whole - 4])
        cut = block.index(b"\r\n\r\n") + 4
        yield head, {k.lower(): v for k, v in HEADER.findall(block, 0, cut)}, block[cut:], begin, whole
        del held[:whole]
        begin += whole


def url_key(url: str) -> str:
    """Sort-friendly form: host labels reversed, lower case, without scheme, port and a leading www."""
    m = re.match(r"(?:[a-z][a-z0-9+.-]*:)?(?://)?([^/?#:]*)(?::\d+)?([^#]*)", url.lower())
    host = re.sub(r"^www\d*\.", "", m[1])
    return ",".join(reversed(host.split("."))) + ")" + (m[2] or "/")


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row per record, in a sorted run for each archive."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("path", "content")

    def number(v: bytes) -> int | None:
        v = v.removeprefix(b"<urn:page:").removesuffix(b">")
        return None if v == b"none" else int(v)

    def run(batches):
        for b in batches:
            for name, content in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                out = []
                for head, http, payload, at, length in parsed(inflated(content.as_py())):
                    digest = head[b"warc-payload-digest"].removeprefix(b"sha1:").decode()
                    kind = head[b"warc-type"].decode()
                    size = int(http[b"content-length"])
                    if kind == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
                        raise ValueError(f"{name}: the payload at {at} is not what its header says")
                    url = head[b"warc-target-uri"].decode()
                    refers = head.get(b"warc-refers-to")
                    out.append((url_key(url), head[b"warc-date"].decode(), number(head[b"warc-record-id"]), size, digest, kind, None if refers is None else number(refers), url, name, at, length))
                out.sort(key=lambda r: (r[0], r[1], -(1 << 63) - 1 if r[2] is None else r[2]))
                if out:
                    columns = [list(c) for c in zip(*out, strict=True)]
                    columns[1] = pa.array(columns[1]).cast(pa.timestamp("us", "UTC"))
                    kinds = [pa.string(), None, pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
                    yield pa.record_batch([c if t is None else pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], NAMES)

    return files.mapInArrow(run, CAPTURE)


class LoserTree:
    """k-way merge of sorted runs (any iterables): each inner node keeps the loser of its match, so a new head meets only its path."""

    def __init__(self, runs: list):
        self.runs = [iter(r) for r in runs]
        self.k = len(runs)
        self.head = [next(r, None) for r in self.runs]
        self.loser = [-1] * max(self.k, 1)
        for i in range(self.k):
            self._play(i)

    def _beats(self, a: int, b: int) -> bool:
        """Whether run a goes before run b; runs at their end go last, ties to the earlier run."""
        if self.head[a] is None or self.head[b] is None:
            return self.head[b] is None and (self.head[a] is not None or a < b)
        return (self.head[a][0], a) < (self.head[b][0], b)

    def _play(self, i: int) -> None:
        at = (i + self.k) // 2
        while at > 0:
            if self.loser[at] == -1:
                self.loser[at] = i
                return
            if self._beats(self.loser[at], i):
                self.loser[at], i = i, self.loser[at]
            at //= 2
        self.loser[0] = i

    def __iter__(self):
        while self.k and self.head[winner := self.loser[0]] is not None:
            yield self.head[winner]
            self.head[winner] = next(self.runs[winner], None)
            self._play(winner)


def merged(runs: DataFrame, captures: int = RANGE) -> DataFrame:
    """Captures in global order of (urlkey, captured_at, page_id): the ranges in order are the index. runs: a staged table."""
    order = ["urlkey", "captured_at", F.col("page_id").asc_nulls_first()]

    def run(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        rows = pa.Table.from_batches(held).combine_chunks()
        keys = [(u, t, -(1 << 63) - 1 if p is None else p) for u, t, p in zip(rows.column("urlkey").to_pylist(), rows.column("captured_at").cast(pa.int64()).to_pylist(), rows.column("page_id").to_pylist(), strict=True)]
        files = rows.column("file").to_pylist()
        # pieces of sorted runs: one begins wherever the archive changes or the order falls back
        cuts = [0, *(i for i in range(1, len(keys)) if files[i] != files[i - 1] or keys[i] < keys[i - 1]), len(keys)]
        tree = LoserTree([((keys[i], i) for i in range(a, b)) for a, b in zip(cuts, cuts[1:], strict=False)])
        at = [i for _, i in tree]
        for k in range(0, len(at), 10_000):
            yield from rows.take(pa.array(at[k : k + 10_000])).combine_chunks().to_batches()

    n = max(int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-runs.count() // captures))
    return runs.repartitionByRange(n, *order).mapInArrow(run, CAPTURE)


def archive(pages: DataFrame, path: str | None = None, per_file: int = PER_FILE) -> DataFrame:
    """Writes pages (page_id, url, html) as WARC under path (a folder of its own in the shared one), reads them back, and returns the index."""
    spark = pages.sparkSession
    path = write(pages, path or stage_path(spark, "warc"), per_file)
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "urlkey", "captured_at", "file", "offset", "length"]
    return merged(stage(read(spark, path), "captures")).select(*columns)
