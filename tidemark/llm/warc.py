"""Web archives (WARC 1.1) with a two-level capture index.

write() makes a record of each page, a gzip member of its own: the first page (smallest id) of those with equal payloads of
REVISIT_BYTES or more is a response, the others are revisits, which keep the HTTP headers and name the response. Files hold
FILE_BYTES or thereabouts.

The index has the captures in order of their keys, the URLs with reversed hosts (com,example,m)/path?query). BLOCK_LINES of
them are a block, compressed; blocks follow each other in one file for each part of the key space, and beside it lies the
sparse directory of the part, the first key of each block with its offset and size. A lookup deals each key to the parts
that may hold it, searches their directory by bisection, reads the range of one block, searches that by bisection, and gives
the captures' files, offsets and sizes; read() reads those ranges of the archives and checks each payload's digest.

Scale: pages are written by the tasks that read them; only (digest, id) pairs meet, combined before they are shuffled. Digests
of several pages are broadcast up to MAX_BROADCAST, beyond that pages meet them in a plain join that AQE can split where one
payload is in a third of the pages. Parts are ranges of (key, id), so a host or URL with any share of the captures is cut;
what the driver holds of the index is a line for each part. A task reads a directory once, a block once, as its keys are
sorted, and the archives in order of offsets, ranges that lie close together in one read. Files have names of their own for
each attempt: those of lost attempts are named by no entry.

Files are written and read by pyarrow's file systems (local or mounted folders, S3, GCS, HDFS), in a folder that all
executors share.

Edge cases: a null html is an empty payload, a null URL has an empty key and no Target-URI; control characters, spaces and
quotes of URLs are percent-encoded; rows that repeat the smallest id are all responses; a null id is the smallest only where
no other has the payload; empty tables make no files; only page_id, url and html are read, so others cannot clash.
"""

from __future__ import annotations

import hashlib
import itertools
import re
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from datetime import UTC, datetime
from typing import NamedTuple
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import materialise, remove_path, scratch

REVISIT_BYTES = 100
FILE_BYTES = 256 << 20
BLOCK_LINES = 3_000
#: Captures in one part of the index.
PART_LINES = 300_000
MAX_BROADCAST = 200_000
#: Ranges of a file no further apart than GAP are read at once, up to READ_BYTES.
GAP, READ_BYTES = 64 << 10, 8 << 20
LEVEL = 6
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
VERSION = b"WARC/1.1\r\n"
#: Of one batch out of a task.
ROWS, BYTES = 4_096, 16 << 20

CAPTURE = "key binary, page_id long, type string, file string, offset long, size long"


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    """pyarrow's file system of a folder, and the path in it."""
    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = uri[5:]
    return fs.FileSystem.from_uri(uri if "://" in uri else f"file://{uri}")


def escaped(url: str) -> str:
    return quote(url, safe="!#$%&'()*+,-./:;=?@[]^_`{|}~\\<>", errors="replace")


def surt(url: str | None) -> bytes:
    """Sort key of a URL: the host reversed, lower case, without www, user and default port; path and query as they are; no
    scheme and no fragment. What has no host is its own key."""
    found = re.match(r"([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]*)(?::([0-9]*))?([^#]*)", text := escaped(url or ""))
    if not found or not found[2]:
        return text.partition("#")[0].encode()
    scheme, host, port, rest = found[1].lower(), found[2].lower().rstrip("."), found[3], found[4]
    if not re.fullmatch(r"[0-9.]+|\[.*", host):
        host = ",".join(reversed(re.sub(r"^www[0-9]*\.(?=[^.]+\.)", "", host).split(".")))
    if port and port != {"http": "80", "https": "443"}.get(scheme):
        host += f":{port}"
    return f"{host}){rest if rest.startswith('/') else '/' + rest}".encode()


def record(kind: str, page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """A whole record. A revisit has the HTTP headers of its payload, not the payload."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if kind == "response":
        block += payload
    fields = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"), ("WARC-Date", date)]
    fields += [("WARC-Target-URI", escaped(url))] if url is not None else []
    fields += [("WARC-Payload-Digest", f"sha256:{digest}")]
    fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:page:{'' if refers_to is None else refers_to}>")] if kind == "revisit" else []
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return VERSION + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def info(date: str) -> bytes:
    """The record that opens a file."""
    block = b"software: tidemark\r\nformat: WARC File Format 1.1\r\n"
    head = f"WARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid4()}>\r\nWARC-Date: {date}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(block)}\r\n\r\n"
    return VERSION + head.encode() + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _fields(data: bytes) -> dict[str, str]:
    lines = data.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}


def _page(uri: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?[0-9]+)>", uri or "")
    return int(found[1]) if found else None


class Record(NamedTuple):
    page_id: int | None
    type: str
    url: str | None
    payload: bytes
    payload_bytes: int
    payload_digest: str
    refers_to: int | None


def parsed(data: bytes) -> Record:
    """A record from its bytes; ValueError if it's cut short or its payload isn't that of its digest."""
    head, _, rest = data.partition(b"\r\n\r\n")
    if not head.startswith(b"WARC/1."):
        raise ValueError("no WARC record")
    fields = _fields(head)
    size = int(fields["content-length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("a record is cut short")
    kind, digest = fields["warc-type"], fields.get("warc-payload-digest", "").removeprefix("sha256:")
    http, _, payload = rest[:size].partition(b"\r\n\r\n")
    length = int(_fields(http).get("content-length", len(payload)))
    if kind == "response" and (len(payload) != length or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError("a payload differs from its digest")
    return Record(_page(fields.get("warc-record-id")), kind, fields.get("warc-target-uri"), payload, length, digest, _page(fields.get("warc-refers-to")))


def members(data: Iterable[bytes]) -> Iterator[tuple[int, int, bytes]]:
    """(offset, size, content) of the gzip members in a stream of pieces."""
    at, size, out, unpacker = 0, 0, [], None
    for piece in data:
        while piece:
            unpacker = unpacker or zlib.decompressobj(31)
            out.append(unpacker.decompress(piece))
            rest = unpacker.unused_data if unpacker.eof else b""
            size += len(piece) - len(rest)
            if unpacker.eof:
                yield at, size, b"".join(out)
                at, size, out, unpacker = at + size, 0, [], None
            piece = rest
    if unpacker:
        raise ValueError("an archive is cut short")


def _batches(rows: Iterable[tuple], schema: pa.Schema, weigh=lambda row: 0) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += weigh(row)
        if len(held) == ROWS or size >= BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


_CAPTURE = pa.schema([("key", pa.binary()), ("page_id", pa.int64()), ("type", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("size", pa.int64())])


def marked(pages: DataFrame) -> DataFrame:
    """(page_id, url, html, digest, refers_to, revisit) of every page."""
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", html.alias("html"), F.sha2(html.cast("binary"), 256).alias("digest"))
    long = F.octet_length("html") >= REVISIT_BYTES
    shared = materialise(rows.where(long).groupBy("digest").agg(F.count("*").alias("n"), F.min("page_id").alias("first")).where("n > 1").select(F.col("digest").alias("of"), "first"), "payloads")
    known = F.broadcast(shared) if shared.count() <= MAX_BROADCAST else shared.hint("merge")
    joined = rows.join(known, long & (F.col("digest") == F.col("of")), "left")
    revisit = F.col("of").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.select("page_id", "url", "html", "digest", F.when(revisit, F.col("first")).alias("refers_to"), revisit.alias("revisit"))


def write(pages: DataFrame, path: str, date: datetime | None = None, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Archives of all pages in the folder `path`; gives their captures, a table of its own."""
    when = (date or datetime.now(UTC)).strftime("%Y-%m-%dT%H:%M:%SZ")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = filesystem(path)
        out, name, at = None, "", 0

        def captures():
            nonlocal out, name, at
            for batch in batches:
                for i in range(batch.num_rows):
                    page_id, url, html, digest, refers_to, revisit = (batch.column(c)[i].as_py() for c in range(6))
                    if out is None:
                        name = f"{uuid.uuid4().hex}.warc.gz"
                        store.create_dir(folder)
                        out, opening = store.open_output_stream(f"{folder}/{name}", compression=None), member(info(when))
                        out.write(opening)
                        at = len(opening)
                    kind = "revisit" if revisit else "response"
                    data = member(record(kind, page_id, url, html.encode("utf-8", "surrogatepass"), digest, refers_to, when))
                    out.write(data)
                    yield surt(url), page_id, kind, name, at, len(data)
                    at += len(data)
                    if at >= file_bytes:
                        out.close()
                        out = None
            if out is not None:
                out.close()

        yield from _batches(captures(), _CAPTURE)

    return materialise(marked(pages).mapInArrow(run, CAPTURE), "captures")


def scan(spark: SparkSession, path: str, files: Iterable[str]) -> DataFrame:
    """Captures of archives that exist already, file by file; warcinfo records are none."""
    names = spark.createDataFrame([(f,) for f in files], "file string")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = filesystem(path)

        def captures():
            for name in itertools.chain.from_iterable(b.column(0).to_pylist() for b in batches):
                with store.open_input_stream(f"{folder}/{name}", compression=None) as stream:
                    for at, size, data in members(iter(lambda: stream.read(1 << 20), b"")):
                        if (found := parsed(data)).type in ("response", "revisit"):
                            yield surt(found.url), found.page_id, found.type, name, at, size

        yield from _batches(captures(), _CAPTURE)

    return names.mapInArrow(run, CAPTURE)


class Part(NamedTuple):
    """A file of the index: its name, first and last key, blocks and captures."""

    file: str
    first: bytes
    last: bytes
    blocks: int
    captures: int


def _line(row: tuple) -> bytes:
    key, page_id, kind, file, offset, size = row
    return b"\t".join([key, *(str("" if x is None else x).encode() for x in (page_id, kind, file, offset, size))])


def _capture(line: bytes) -> tuple:
    key, page_id, kind, file, offset, size = line.split(b"\t")
    return key, int(page_id) if page_id else None, kind.decode(), file.decode(), int(offset), int(size)


class CaptureIndex(NamedTuple):
    """Of the archives in the folder `path`, in files beside them; parts are in order of their keys."""

    spark: SparkSession
    path: str
    parts: list[Part]

    def deal(self, keys: DataFrame) -> DataFrame:
        """(part, key) of the parts that may hold the keys, from a column key."""
        firsts, lasts = [p.first for p in self.parts], [p.last for p in self.parts]

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = ((part, key) for b in batches for key in b.column(0).to_pylist() for part in range(bisect_left(lasts, key), bisect_right(firsts, key)))
            yield from _batches(rows, pa.schema([("part", pa.int32()), ("key", pa.binary())]))

        return keys.select("key").mapInArrow(run, "part int, key binary")

    def lookup(self, keys: DataFrame) -> DataFrame:
        """All captures of the keys in a binary column key; a key that is asked for twice is answered once."""
        names, path = [p.file for p in self.parts], self.path
        dealt = self.deal(keys.select("key").where("key IS NOT NULL").distinct()).repartition(max(1, len(names)), "part").sortWithinPartitions("part", "key")

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            store, folder = filesystem(path)

            def found():
                asked = ((p, k) for b in batches for p, k in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
                for part, of_part in itertools.groupby(asked, lambda x: x[0]):
                    with store.open_input_file(f"{folder}/{names[part]}") as blocks, store.open_input_stream(f"{folder}/{names[part]}.dir", compression=None) as directory:
                        entries = [(k, int(o), int(s)) for k, o, s in (x.split(b"\t") for x in directory.read().splitlines())]
                        firsts, held, lines, line_keys = [e[0] for e in entries], -1, [], []
                        for _, key in of_part:
                            # captures of the key may begin in the block before the first that starts with it
                            for i in range(max(0, bisect_left(firsts, key) - 1), bisect_right(firsts, key)):
                                if i != held:
                                    lines = zlib.decompress(blocks.read_at(entries[i][2], entries[i][1]), 31).split(b"\n")
                                    held, line_keys = i, [x.partition(b"\t")[0] for x in lines]
                                yield from map(_capture, lines[bisect_left(line_keys, key) : bisect_right(line_keys, key)])

            yield from _batches(found(), _CAPTURE)

        return dealt.mapInArrow(run, CAPTURE)

    def lookup_urls(self, urls: DataFrame, url_col: str = "url") -> DataFrame:
        return self.lookup(keys_of(urls, url_col))


def keys_of(urls: DataFrame, url_col: str = "url") -> DataFrame:
    """key of each row; a null URL has the empty key."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([surt(u) for u in batch.column(0).to_pylist()], pa.binary())], ["key"])

    return urls.select(F.col(url_col).alias("url")).mapInArrow(run, "key binary")


def build_index(captures: DataFrame, path: str, block_lines: int = BLOCK_LINES, part_lines: int = PART_LINES) -> CaptureIndex:
    """Sorted, compressed blocks and their directories, beside the archives in `path`."""
    spark = captures.sparkSession
    n = captures.count()
    wanted = max(-(-n // part_lines), min(-(-n // block_lines), spark.sparkContext.defaultParallelism))
    order = ["key", "page_id", "file", "offset"]
    ordered = captures.repartitionByRange(max(1, wanted), *order).sortWithinPartitions(*order)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = filesystem(path)
        rows = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns)))
        blocks = iter(lambda: list(itertools.islice(rows, block_lines)), [])
        name, at, directory, last, lines = f"{uuid.uuid4().hex}.index.gz", 0, [], b"", 0
        if first := next(blocks, None):
            with store.open_output_stream(f"{folder}/{name}", compression=None) as out:
                for block in itertools.chain([first], blocks):
                    out.write(data := member(b"\n".join(map(_line, block))))
                    directory.append(b"%s\t%d\t%d" % (block[0][0], at, len(data)))
                    at, last, lines = at + len(data), block[-1][0], lines + len(block)
            with store.open_output_stream(f"{folder}/{name}.dir") as out:
                out.write(b"\n".join(directory))
            yield pa.RecordBatch.from_pylist([{"file": name, "first": first[0][0], "last": last, "blocks": len(directory), "captures": lines}])

    # a row for each part
    made = materialise(ordered.mapInArrow(run, "file string, first binary, last binary, blocks long, captures long"), "index-parts").collect()
    parts = sorted((Part(r.file, bytes(r["first"]), bytes(r["last"]), r.blocks, r.captures) for r in made), key=lambda p: (p.first, p.last))
    return CaptureIndex(spark, path, parts)


READ = "page_id long, url string, type string, payload binary, payload_bytes long, payload_digest string, refers_to long"


def read(captures: DataFrame, path: str, payloads: bool = True) -> DataFrame:
    """The records of captures, by range reads; a revisit's payload is null. payloads: whether to return them."""
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("type", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = filesystem(path)

        def records():
            wanted = (x for b in batches for x in zip(*(c.to_pylist() for c in b.columns)))
            for name, ranges in itertools.groupby(wanted, lambda x: x[0]):
                with store.open_input_file(f"{folder}/{name}") as file:
                    for run_of in _close(ranges):
                        start = run_of[0][0]
                        data = file.read_at(run_of[-1][0] + run_of[-1][1] - start, start)
                        for offset, size in run_of:
                            r = parsed(zlib.decompress(data[offset - start : offset - start + size], 31))
                            yield r.page_id, r.url, r.type, r.payload if payloads and r.type == "response" else None, r.payload_bytes, r.payload_digest, r.refers_to

        yield from _batches(records(), schema, lambda row: len(row[3] or b""))

    return captures.select("file", "offset", "size").repartition("file").sortWithinPartitions("file", "offset").mapInArrow(run, READ)


def _close(ranges: Iterable[tuple[str, int, int]]) -> Iterator[list[tuple[int, int]]]:
    """Ranges in order of offsets, in groups that one read takes."""
    group: list[tuple[int, int]] = []
    for _, offset, size in ranges:
        if group and (offset > group[-1][0] + group[-1][1] + GAP or offset + size > group[0][0] + READ_BYTES):
            yield group
            group = []
        group.append((offset, size))
    if group:
        yield group


def archived_pages(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, as read back from archives of all pages through the
    index of their URLs. The archives are removed when the rows are read."""
    spark = pages.sparkSession
    path = scratch(spark, "warc")
    index = build_index(write(pages, path), path)
    found = read(index.lookup_urls(pages), path, payloads=False)
    rows = materialise(found.select("page_id", "payload_bytes", "payload_digest", F.col("type").alias("record_type"), "refers_to"), "records")
    remove_path(spark, path)
    return rows


ORACLE = """
WITH payloads AS (
  SELECT page_id, strlen(coalesce(html, '')) AS size, sha256(coalesce(html, '')) AS digest FROM pages
), firsts AS (
  SELECT *, CASE WHEN size >= 100 THEN min(page_id) OVER (PARTITION BY digest) ELSE page_id END AS first FROM payloads
)
SELECT page_id, size AS payload_bytes, digest AS payload_digest, CASE WHEN first IS DISTINCT FROM page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first IS DISTINCT FROM page_id THEN first END AS refers_to
FROM firsts
"""
