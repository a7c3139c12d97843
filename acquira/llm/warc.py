"""WARC archives of pages, read back into an index whose sorted runs are merged by a loser tree."""

from __future__ import annotations

import base64
import gzip
import hashlib
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from acquira.llm.shared import Scratch, batch_rows, scratched, shared_folder, shuffle_partitions

#: Bytes of records, before compression, after which a task begins another archive.
ARCHIVE_BYTES = 64 << 20
#: Entries of a range of the index that one task merges, and lists that one loser tree takes; more are merged in passes.
RANGE_ROWS, FAN_IN = 200_000, 256
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ENTRY = T.StructType([
    T.StructField("run", T.StringType()), T.StructField("seq", T.IntegerType()), T.StructField("urlkey", T.StringType()), T.StructField("timestamp", T.StringType()),
    T.StructField("page_id", T.LongType()), T.StructField("payload_bytes", T.LongType()), T.StructField("payload_digest", T.StringType()),
    T.StructField("record_type", T.StringType()), T.StructField("refers_to", T.LongType()), T.StructField("offset", T.LongType()), T.StructField("length", T.LongType()),
])


def sha1_base32(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _name(page_id: int | None, digest: str) -> str:
    """A record's id: the page and its payload, so that rows that share an id have records of their own."""
    return f"<urn:page:{'' if page_id is None else page_id}:{digest}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, first: int | None) -> bytes:
    """A WARC/1.1 record; first: the page that it revisits, or None."""
    safe = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    when = datetime.fromtimestamp((page_id or 0) % 4102444800, timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if first is None else b"")
    head = ["WARC/1.1", f"WARC-Type: {'response' if first is None else 'revisit'}", f"WARC-Record-ID: {_name(page_id, digest)}", f"WARC-Date: {when}", f"WARC-Target-URI: {safe}", f"WARC-Payload-Digest: sha1:{digest}"]
    if first is not None:
        head += [f"WARC-Refers-To: {_name(first, digest)}", f"WARC-Profile: {REVISIT_PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


_EMPTY = gzip.compress(b"", mtime=0)


def member(data: bytes) -> bytes:
    """data as a gzip member that ends in a zero byte: the size's last byte, or, from 16 MB on, that of an empty member after it."""
    out = gzip.compress(data, 6, mtime=0)
    return out if not out[-1] else out + _EMPTY


@scratched
def write(df: DataFrame, folder: str, *, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", scratch: Scratch) -> None:
    """One record for each row, a gzip member a record, in archives of about ARCHIVE_BYTES bytes.

    Of rows with equal payloads of at least ``min_bytes`` bytes the one with the smallest id is a response and the others revisit
    it; smaller payloads are responses. A null payload is empty; a null id is above all ids, and alone it is a response. Rows that
    share an id make a record each. Only payloads that occur again are looked up, by page and digest, so no payload is a hot key.
    """
    p = df.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(payload_col), F.lit("")).alias("payload"))
    p = p.withColumns({"size": F.octet_length("payload").cast("long"), "sha": F.unhex(F.sha1("payload"))})
    seen = scratch.write(p.where(F.col("size") >= min_bytes).select("page_id", "size", "sha"))
    again = seen.groupBy("sha", "size").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 AND first IS NOT NULL").drop("n")
    rest = seen.join(again, ["sha", "size"]).where("page_id IS NULL OR page_id <> first").select(F.coalesce(F.col("page_id"), F.lit(-1)).alias("_id"), F.col("page_id").isNull().alias("_no"), "sha", "size", "first").distinct()
    p = p.withColumns({"_id": F.coalesce(F.col("page_id"), F.lit(-1)), "_no": F.col("page_id").isNull()}).join(rest, ["_id", "_no", "sha", "size"], "left")

    def pack(batches):
        filled, archive_no = 0, 0
        for b in batches:
            values, numbers = [], []
            for page_id, url, payload, sha, first in zip(*(c.to_pylist() for c in b.columns), strict=True):
                data = record(page_id, url, payload.encode(), base64.b32encode(sha).decode(), first)
                filled += len(data)
                if filled > ARCHIVE_BYTES:
                    filled, archive_no = len(data), archive_no + 1
                values.append(member(data)[:-1])  # the writer of lines ends each with a zero byte
                numbers.append(archive_no)
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), pa.array(values, pa.binary())], ["archive", "value"])

    with batch_rows(df.sparkSession, 1000):
        out = p.select("page_id", "url", "payload", "sha", "first").mapInArrow(pack, "archive int, value binary")
        out.select("archive", F.col("value").cast("string")).write.partitionBy("archive").option("lineSep", "\0").text(folder)


def members(data: bytes | memoryview, step: int = 1 << 13) -> Iterator[tuple[int, int, bytes]]:
    """Offset, length and content of each gzip member that isn't empty; an empty one belongs to the member before it."""
    at, size, held = 0, len(data), None
    while at < size:
        d, begin, parts = zlib.decompressobj(31), at, []
        while not d.eof:
            if at >= size:
                raise ValueError(f"the member at byte {begin} is cut")
            parts.append(d.decompress(data[at:at + step]))
            at = min(size, at + step)
        at -= len(d.unused_data)
        content = b"".join(parts)
        if content:
            if held:
                yield held
            held = begin, at - begin, content
        elif held:
            held = held[0], at - held[0], held[2]
    if held:
        yield held


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and block of one record."""
    end = data.find(b"\r\n\r\n")
    top, *lines = data[:max(end, 0)].decode().split("\r\n")
    if not top.startswith("WARC/"):
        raise ValueError("no WARC record")
    head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    block = data[end + 4:end + 4 + int(head["content-length"])]
    if len(block) != int(head["content-length"]) or data[end + 4 + len(block):] != b"\r\n\r\n":
        raise ValueError("the record is cut")
    return head, block


def url_key(url: str) -> str:
    """Host labels from the last to the first, then the rest in lower case: captures of a host stand together."""
    try:
        s = urlsplit(url.strip().lower())
    except ValueError:
        return url.lower()
    host = s.hostname or ""
    host = host.removeprefix("www.")
    return ",".join(reversed(host.split("."))) + ")" + (s.path or "/") + (f"?{s.query}" if s.query else "")


def _page(name: str) -> int | None:
    digits = name.removeprefix("<urn:page:").partition(":")[0]
    return int(digits) if digits else None


def runs(spark: SparkSession, folder: str) -> DataFrame:
    """Index entries of every archive: each archive's are a run, sorted by URL key, time and page.

    offset and length are those of the record's member in the archive, so that it can be read alone. A response's digest is taken
    from its payload and has to be the one that its header states; a damaged archive raises. Records are unpacked one at a time.
    """

    def read(batches):
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                entries = []
                for offset, length, data in members(memoryview(content.as_buffer())):
                    head, block = parse(data)
                    http, _, payload = block.partition(b"\r\n\r\n")
                    size = int(next(x for x in http.decode().split("\r\n") if x.startswith("Content-Length: "))[16:])
                    digest = head["warc-payload-digest"].removeprefix("sha1:")
                    if head["warc-type"] == "response" and (len(payload) != size or sha1_base32(payload) != digest):
                        raise ValueError(f"{path}: the payload at byte {offset} isn't what its header states")
                    stamp = "".join(c for c in head["warc-date"] if c.isdigit())
                    entries.append((url_key(head["warc-target-uri"]), stamp, _page(head["warc-record-id"]), size, digest, head["warc-type"], _page(head["warc-refers-to"]) if "warc-refers-to" in head else None, offset, length))
                entries.sort(key=lambda e: _order(e[0], e[1], e[2]))
                rows = [[path] * len(entries), list(range(len(entries))), *(list(c) for c in zip(*entries, strict=True))] if entries else [[] for _ in ENTRY]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, _ARROW, strict=True)], ENTRY.names)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select("path", "content").mapInArrow(read, ENTRY)


_ARROW = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]


def _order(key: str, stamp: str, page: int | None) -> tuple:
    return key.encode(), stamp, page is None, page or 0


class LoserTree:
    """Merges sorted lists; inner nodes keep the loser of their match, so each next item takes one climb from a leaf."""

    def __init__(self, lists: list[list], key):
        self.lists, self.key, self.k = lists, key, max(1, len(lists))
        self.at = [0] * len(lists)
        self.heads = [key(x[0]) if x else None for x in lists]
        self.losers = [-1] * self.k
        self.winner = self._build(1) if lists else -1

    def _before(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or (x is not None and (x, a) <= (y, b))

    def _build(self, node: int) -> int:
        if node >= self.k:
            return node - self.k
        a, b = self._build(2 * node), self._build(2 * node + 1)
        if self._before(a, b):
            a, b = b, a
        self.losers[node] = a
        return b

    def __iter__(self):
        while self.winner >= 0 and self.heads[self.winner] is not None:
            w = self.winner
            yield self.lists[w][self.at[w]]
            self.at[w] += 1
            self.heads[w] = self.key(self.lists[w][self.at[w]]) if self.at[w] < len(self.lists[w]) else None
            node = (w + self.k) // 2
            while node >= 1:
                if self._before(self.losers[node], w):
                    self.losers[node], w = w, self.losers[node]
                node //= 2
            self.winner = w


def merged(lists: list[list], key, fan_in: int = FAN_IN) -> Iterator:
    """Sorted lists as one, by loser trees of ``fan_in`` lists at most: more lists take several passes."""
    while len(lists) > fan_in:
        lists = [list(LoserTree(lists[i:i + fan_in], key)) for i in range(0, len(lists), fan_in)]
    return iter(LoserTree(lists, key))


def merge(entries: DataFrame) -> DataFrame:
    """All runs as one index: range number ``part`` and ``place`` in it give the order by URL key, time and page.

    entries are sorted runs in the shared folder. Ranges of all three keys are dealt out, as many as hold RANGE_ROWS entries, so a
    host or URL with most of the captures is spread; a task reads the pieces of the runs in their order and merges them.
    """
    n = max(shuffle_partitions(entries.sparkSession), -(-entries.count() // RANGE_ROWS))
    schema = T.StructType([*ENTRY.fields, T.StructField("part", T.IntegerType()), T.StructField("place", T.IntegerType())])

    def run(batches):
        from pyspark import TaskContext

        lists: list[list[tuple]] = []
        last = None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[0] != last:
                    lists.append([])
                    last = row[0]
                lists[-1].append(row)
        part, place, rows = TaskContext.get().partitionId(), 0, []

        def out():
            columns = [*(list(c) for c in zip(*rows, strict=True)), [part] * len(rows), list(range(place, place + len(rows)))]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, [*_ARROW, pa.int32(), pa.int32()], strict=True)], schema.names)

        for row in merged(lists, lambda r: _order(r[2], r[3], r[4])):
            rows.append(row)
            if len(rows) == 10_000:
                yield out()
                place, rows = place + len(rows), []
        if rows:
            yield out()

    ranged = entries.repartitionByRange(n, "urlkey", "timestamp", F.col("page_id").asc_nulls_last()).sortWithinPartitions("run", "seq")
    return ranged.mapInArrow(run, schema)


@scratched
def archive(df: DataFrame, *, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", folder: str | None = None, scratch: Scratch) -> DataFrame:
    """Writes the pages' archives, reads them back and returns the merged index, one row for each page.

    The archives are the result's files: they stay in ``folder``, or in a new one of the shared folder.
    """
    folder = folder or shared_folder(df.sparkSession)
    write(df, folder, min_bytes=min_bytes, id_col=id_col, url_col=url_col, payload_col=payload_col)
    return merge(scratch.write(runs(df.sparkSession, folder)))


def oracle() -> str:
    """What the archives say of each page, in DuckDB's SQL: sizes, base32 digests, and which page a copy revisits."""
    five = "CAST('0x' || substr(h, 5 * CAST(i AS INT) + 1, 5) AS BIGINT)"
    digit = lambda shift: f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(({five} >> {shift}) & 31 AS INT) + 1, 1)"
    return f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS h FROM pages),
 f AS (SELECT *, CAST(octet_length(encode(t)) AS BIGINT) AS payload_bytes, min(page_id) OVER (PARTITION BY t) AS first FROM p)
SELECT page_id, payload_bytes, array_to_string(list_transform(range(8), lambda i: {digit(15)} || {digit(10)} || {digit(5)} || {digit(0)}), '') AS payload_digest,
 CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM f"""
