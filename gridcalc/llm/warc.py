"""WARC archives of pages, and a two-level capture index over them.

Each page is a record in a gzip member of its own: a response, or, where an earlier page has the same payload, a revisit
that names it. The index holds a line a record, sorted by reversed-host URL key, in compressed blocks of BLOCK_LINES; a
sparse directory has each block's first key and place. A lookup searches the directory and then one block by bisection,
and reads the record by its range of bytes.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridcalc.llm.common import fresh_path, open_fs, partitions, put_file, text_slices, written

BLOCK_LINES = 3000
#: Payloads of fewer bytes are always responses.
LEAST_REVISIT = 100
#: Bytes of records that are read at once.
READ_BYTES = 8_000_000
_DATE = "2000-01-01T00:00:00Z"  # pages have no capture time


def url_key(url: str | None) -> str:
    """The host's labels reversed, then path and query in lower case; an unreadable URL is its own key."""
    try:
        parts = urlsplit((url or "").strip())
        host = (parts.hostname or "").removeprefix("www.")
        port = parts.port
    except ValueError:
        return (url or "").lower()
    if not host:
        return (url or "").lower()
    port = f":{port}" if port and port not in (80, 443) else ""
    return f"{','.join(reversed(host.split('.')))}{port})".lower() + (parts.path or "/").lower() + (f"?{parts.query.lower()}" if parts.query else "")


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def _clean(value: str) -> str:
    """A header's value on one line."""
    return "".join(c if c >= " " and c != "\x7f" else "%{:02X}".format(ord(c)) for c in value)


def make_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, is_revisit: bool) -> bytes:
    """One record, compressed. A revisit keeps the HTTP head, whose Content-Length is the payload's, and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if is_revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if is_revisit else 'response'}", f"WARC-Target-URI: {_clean(url or '')}", f"WARC-Date: {_DATE}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Page-ID: {'' if page_id is None else page_id}"]
    if is_revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}", f"WARC-Refers-To-Page-ID: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 6, mtime=0)


def parse_record(data: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Headers, HTTP head and payload of one uncompressed record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    block = rest[: int(headers["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return headers, http, payload


def roles(pages: DataFrame) -> DataFrame:
    """(page_id, digest, refers_to) of pages (page_id, html): the smallest page with the same payload, null for itself."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    light = pages.select("page_id", F.sha2(payload, 256).alias("digest"), F.octet_length(payload).alias("size"))
    firsts = light.where(F.col("size") >= LEAST_REVISIT).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first")
    return light.join(firsts, "digest", "left").select("page_id", "digest", F.when(F.col("page_id") != F.col("first"), F.col("first")).alias("refers_to"))


def write_archives(spark: SparkSession, pages: DataFrame, folder: str) -> DataFrame:
    """Writes the archives; the captures: (key, page_id, file, offset, length). Each page is moved once, to its archive's task."""
    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    revisits = written(spark, roles(own).where("refers_to is not null").groupBy("page_id", "digest").agg(F.min("refers_to").alias("refers_to")), "revisits")
    digest = F.sha2(F.coalesce("html", F.lit("")).cast("binary"), 256)
    records = own.withColumn("digest", digest).join(revisits, ["page_id", "digest"], "left")
    schema = pa.schema([("key", pa.string()), ("page_id", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uri = f"{folder}/archive-{TaskContext.get().partitionId():06d}.warc.gz"
        rows: list[tuple] = []

        def fill(out) -> None:
            at = 0
            for batch in text_slices(batches, 2):
                for page_id, url, html, digest, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    payload = (html or "").encode()
                    data = make_record(page_id, url, payload, digest, refers_to, refers_to is not None)
                    out.write(data)
                    rows.append((url_key(url), page_id, uri, at, len(data)))
                    at += len(data)

        put_file(uri, fill)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    return written(spark, records.select("page_id", "url", "html", "digest", "refers_to").mapInArrow(run, "key string, page_id long, file string, offset long, length long"), "captures")


def write_index(spark: SparkSession, captures: DataFrame, folder: str, block_lines: int = BLOCK_LINES) -> DataFrame:
    """Writes shards of compressed blocks in key order; the directory: (first_key, shard, offset, length, lines), written too."""
    dealt = captures.repartitionByRange(partitions(spark), "key", "page_id").sortWithinPartitions("key", "page_id")
    schema = pa.schema([("first_key", pa.string()), ("shard", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("lines", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uri = f"{folder}/shard-{TaskContext.get().partitionId():06d}.cdx.gz"
        blocks: list[tuple] = []

        def fill(out) -> None:
            held: list[tuple[str, str]] = []
            at = 0

            def flush() -> None:
                nonlocal at
                data = gzip.compress("\n".join(line for _, line in held).encode(), 6, mtime=0)
                out.write(data)
                blocks.append((held[0][0], uri, at, len(data), len(held)))
                at += len(data)
                held.clear()

            for batch in batches:
                for key, page_id, file, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    held.append((key, json.dumps([key, page_id, file, offset, length])))
                    if len(held) == block_lines:
                        flush()
            if held:
                flush()
            # the shard's part of the directory, and its length
            data = gzip.compress(json.dumps([[b[0], *b[2:4]] for b in blocks]).encode(), 6, mtime=0)
            out.write(data)
            out.write(len(data).to_bytes(8, "little"))

        put_file(uri, fill)
        if blocks:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*blocks, strict=True), schema.types, strict=True)], schema=schema)

    return written(spark, dealt.select("key", "page_id", "file", "offset", "length").mapInArrow(run, "first_key string, shard string, offset long, length long, lines long"), "directory")


def _range(uri: str, offset: int, length: int) -> bytes:
    file_system, path = open_fs(uri)
    with file_system.open_input_file(path) as f:
        return f.read_at(length, offset)


def _lines(shard: str, offset: int, length: int) -> tuple[list[str], list[list]]:
    """The keys and captures of one index block."""
    lines = [json.loads(x) for x in gzip.decompress(_range(shard, offset, length)).decode().split("\n")]
    return [x[0] for x in lines], lines


def _directory(shard: str) -> tuple[list[str], list[list]]:
    """A shard's part of the directory: first keys, and (first key, offset, length) of its blocks."""
    file_system, path = open_fs(shard)
    with file_system.open_input_file(path) as f:
        size = f.size()
        n = int.from_bytes(f.read_at(8, size - 8), "little")
        entries = json.loads(gzip.decompress(f.read_at(n, size - 8 - n)))
    return [e[0] for e in entries], entries


def _open(firsts: list[str], key: str) -> range:
    """Which of the sorted blocks (or shards) with these first keys may hold a key, by bisection; it may begin in the one before."""
    return range(max(0, bisect.bisect_left(firsts, key) - 1), bisect.bisect_right(firsts, key))


class Index:
    """Looks captures up by URL. The directory is one entry for BLOCK_LINES captures."""

    def __init__(self, directory: DataFrame):
        self.entries = sorted(tuple(r) for r in directory.select("first_key", "shard", "offset", "length").collect())
        self.keys = [e[0] for e in self.entries]

    def captures(self, url: str) -> list[tuple]:
        """(key, page_id, file, offset, length) of every capture of the URL."""
        key, out = url_key(url), []
        for k in _open(self.keys, key):
            keys, lines = _lines(*self.entries[k][1:])
            out += map(tuple, lines[bisect.bisect_left(keys, key) : bisect.bisect_right(keys, key)])
        return out

    def records(self, url: str) -> list[tuple[dict[str, str], bytes, bytes]]:
        return [parse_record(gzip.decompress(_range(*c[2:]))) for c in self.captures(url)]


def located(spark: SparkSession, urls: DataFrame, directory: DataFrame) -> DataFrame:
    """(file, offset, length) of every capture of the URLs of a table (url), looked up in the index; each capture once.

    Keys, each once, are dealt by ranges; a task bisects the shards' first keys (a row a shard), reads the directories of
    those it needs and bisects these. The blocks found are dealt singly, so that a key with very many captures is many
    tasks, and bisected for the keys that led to them.
    """
    key_schema = pa.schema([("key", pa.string())])
    block_schema = pa.schema([("shard", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("key", pa.string())])
    lines_schema = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
    shards = sorted(tuple(r) for r in directory.groupBy("shard").agg(F.min("first_key").alias("first")).select("first", "shard").collect())  # a row a shard
    firsts = [f for f, _ in shards]

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, 0):
            yield pa.RecordBatch.from_arrays([pa.array(sorted({url_key(u) for u in batch.column(0).to_pylist()}), pa.string())], schema=key_schema)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, tuple[list[str], list[list]]] = {}
        for batch in batches:
            rows = []
            for key in batch.column(0).to_pylist():
                for s in _open(firsts, key):
                    if s not in known:
                        for old in [k for k in known if k < s - 1]:  # keys ascend
                            del known[old]
                        known[s] = _directory(shards[s][1])
                    own, entries = known[s]
                    rows += [(shards[s][1], entries[k][1], entries[k][2], key) for k in _open(own, key)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), block_schema.types, strict=True)], schema=block_schema)

    def captures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = None
        for batch in batches:
            found = []
            for shard, offset, length, key in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at != (shard, offset):
                    at, (keys, lines) = (shard, offset), _lines(shard, offset, length)
                found += lines[bisect.bisect_left(keys, key) : bisect.bisect_right(keys, key)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], t) for k, t in zip((2, 3, 4), lines_schema.types, strict=True)], schema=lines_schema)

    n = partitions(spark)
    keys = urls.select(F.col("url").cast("string")).mapInArrow(keyed, "key string").distinct().repartitionByRange(n, "key").sortWithinPartitions("key")
    found = keys.mapInArrow(blocks, "shard string, offset long, length long, key string")
    return found.repartition(n, "shard", "offset").sortWithinPartitions("shard", "offset", "key").mapInArrow(captures, "file string, offset long, length long")


def read_archives(spark: SparkSession, captures: DataFrame) -> DataFrame:
    """Per capture (file, offset, length), from the archives: page_id, payload_bytes, payload_digest, record_type, refers_to.

    An archive's records are read in ranges by the order of their places. A response's digest is that of the payload
    read, which must be the one in its head.
    """
    captures = captures.repartition(partitions(spark), "file").sortWithinPartitions("file", "offset")
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])

    def one(data: bytes) -> tuple:
        headers, http, payload = parse_record(data)
        number = lambda x: int(x) if x else None
        digest = headers["WARC-Payload-Digest"].removeprefix("sha256:")
        if headers["WARC-Type"] == "revisit":
            size = next(int(line[16:]) for line in http.decode().split("\r\n") if line.startswith("Content-Length: "))
            return number(headers["WARC-Page-ID"]), size, digest, "revisit", number(headers["WARC-Refers-To-Page-ID"])
        if hashlib.sha256(payload).hexdigest() != digest:
            raise ValueError(f"payload of {headers['WARC-Record-ID']} differs from its digest")
        return number(headers["WARC-Page-ID"]), len(payload), digest, "response", None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            group: list[tuple[int, int]] = []
            name = None

            def flush() -> None:
                if not group:
                    return
                low, high = group[0][0], group[-1][0] + group[-1][1]
                data = _range(name, low, high - low)  # noqa: B023
                rows.extend(one(zlib.decompress(data[o - low : o - low + n], 31)) for o, n in group)  # noqa: B023
                group.clear()  # noqa: B023

            for file, offset, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if group and (file != name or offset != group[-1][0] + group[-1][1] or offset - group[0][0] > READ_BYTES):
                    flush()
                name = file
                group.append((offset, length))
            flush()
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    return captures.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Writes archives and index for ``pages`` (page_id, url, html) and reads every record back by way of the index.

    Null html is an empty payload, a null url an empty one. A page without a page_id is always a response. Rows that
    repeat a page_id are records of their own, equal payloads among them too. An empty table gives an empty result.
    """
    folder = fresh_path(spark, "warc")
    directory = write_index(spark, write_archives(spark, pages, folder), folder)
    return read_archives(spark, located(spark, pages, directory))
