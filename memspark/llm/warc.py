"""WARC archives with a two-level capture index (operator 4).

Captures are written as WARC/1.1 records, each its own gzip member, so an archive is its members one after another and a
record is read by archive, offset and length. Each task writes one .warc.gz file to the shared folder, through whatever file system that
is in, and gives back where its records are; only these narrow rows are moved. A record is read by a range read of its file.

The index sorts the captures by their reversed-host URL key and id, and cuts them into compressed blocks of many lines.
The first key of each block makes a sparse directory of at most ``DIRECTORY`` entries. A lookup searches the directory by
bisection, reads one block, searches its lines by bisection, and reads the records' ranges.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from urllib.parse import urlsplit

import pandas as pd
import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, parts, shared_folder

#: Lines in a block at least, and entries in the directory at most.
LINES, DIRECTORY = 3000, 1 << 16
#: Bytes that are read of a file at once where records lie next to each other.
READ = 8 << 20
#: The time that records carry; the tables have none.
DATE = "2024-01-01T00:00:00Z"
_NONE = -(1 << 63)
_URN = "urn:x-page:"


def url_key(url: str | None) -> str:
    """The URL with its host's labels reversed, without scheme, credentials, default port and fragment: com,example,www)/path?query."""
    if not url:
        return "-"
    try:
        parts = urlsplit(url.strip())
        host, port = (parts.hostname or "").lower(), parts.port
    except ValueError:
        parts, host, port = urlsplit(""), "", None
    if not host:
        key = "-" + url
    else:
        key = ",".join(reversed(host.split("."))) + (f":{port}" if port not in (None, 80, 443) else "") + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    return key.replace("\n", "%0A").replace("\t", "%09")


def record(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as a gzip member."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in headers), f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """Headers, by lower-case name, and block of a gzip member."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if first != "WARC/1.1":
        raise ValueError(f"not a WARC record: {first[:40]!r}")
    headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines)}
    return headers, rest[: int(headers["content-length"])]


def capture(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    headers = [("WARC-Record-ID", f"<{_URN}{'' if page_id is None else page_id}>"), ("WARC-Date", DATE), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http;msgtype=response")]
    if url:
        headers.append(("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")))
    if not revisit:
        return record("response", headers, http + payload)
    headers.append(("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
    if refers_to is not None:
        headers.append(("WARC-Refers-To", f"<{_URN}{refers_to}>"))
    return record("revisit", headers, http)


def write(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Writes the archives of pages to the shared folder, and gives a row for each record: archive (the file), offset, length, url_key and capture.

    Of pages with equal payloads of at least least_bytes bytes, that with the largest page_id is a response and the others
    revisit it; smaller payloads are all responses. Each attempt of a task writes a file of its own, and the rows tell which files count;
    a file holds one warcinfo record and those of its task's pages. Defined results are those of round_trip; no pages, no archives.
    """
    folder = f"{shared_folder(pages.sparkSession)}/memspark-{uuid.uuid4().hex}/warc"
    each = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    each = each.withColumn("sha1", F.sha1(F.col("html").cast("binary")))
    same = each.where(F.octet_length("html") >= least_bytes).groupBy("sha1").agg(F.max("page_id").alias("kept"), F.count(F.lit(1)).alias("n")).where("n > 1")
    same = cut(same.select(F.col("sha1").alias("__same"), "kept"), "same-payloads")
    rows = each.join(same, F.col("sha1") == F.col("__same"), "left")
    rows = rows.withColumn("revisit", F.col("kept").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("kept")))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, out, at = TaskContext.get(), None, 0
        name = f"captures-{context.partitionId():06d}-{context.taskAttemptId()}.warc.gz"
        for batch in (x for whole in batches for x in parts(iter([whole]), 2, READ)):
            found: list[tuple] = []
            for page_id, url, html, sha1, kept, revisit in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    files, path = FileSystem.from_uri(folder)
                    files.create_dir(path, recursive=True)
                    out = files.open_output_stream(f"{path}/{name}", compression=None)
                    out.write(info := record("warcinfo", [("WARC-Record-ID", f"<urn:x-archive:{name}>"), ("WARC-Date", DATE), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))
                    at = len(info)
                member = capture(page_id, url, html.encode(), base64.b32encode(bytes.fromhex(sha1)).decode(), kept, revisit)
                out.write(member)
                found.append((f"{folder}/{name}", at, len(member), url_key(url), _NONE if page_id is None else page_id))
                at += len(member)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found) if found else [()] * 5, _ARCHIVE)], names=_NAMES)
        if out is not None:
            out.close()

    schema = "archive string, offset long, length long, url_key string, capture long"
    return cut(rows.select("page_id", "url", "html", "sha1", "kept", "revisit").mapInArrow(apply, schema), "records")


_ARCHIVE = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64()]
_NAMES = ["archive", "offset", "length", "url_key", "capture"]


def build_index(archives: DataFrame, lines: int = LINES) -> tuple[DataFrame, list[tuple[str, int, int]]]:
    """Blocks (block, data) in the shared folder, and the directory: (first url_key, first capture, block), in order."""
    entries = archives.select("url_key", "capture", "archive", "offset", "length")
    lines = max(lines, -(-entries.count() // DIRECTORY))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, kept = TaskContext.get().partitionId(), 0, []

        def block(rows: list) -> pa.RecordBatch:
            data = zlib.compress("\n".join("\t".join(map(str, r)) for r in rows).encode(), 6)
            return pa.RecordBatch.from_arrays([pa.array([(part << 32) + number]), pa.array([rows[0][0]]), pa.array([rows[0][1]]), pa.array([data], pa.binary())], names=["block", "first_key", "first_capture", "data"])

        for batch in batches:
            kept += zip(*(c.to_pylist() for c in batch.columns))
            while len(kept) >= lines:
                yield block(kept[:lines])
                kept, number = kept[lines:], number + 1
        if kept:
            yield block(kept)

    schema = "block long, first_key string, first_capture long, data binary"
    blocks = cut(entries.repartitionByRange("url_key", "capture").sortWithinPartitions("url_key", "capture").mapInArrow(apply, schema), "index")
    directory = sorted((r.first_key, r.first_capture, r.block) for r in blocks.select("first_key", "first_capture", "block").collect())
    return blocks.select("block", "data"), directory


def locate(blocks: DataFrame, directory: list[tuple[str, int, int]], wanted: DataFrame) -> DataFrame:
    """archive, offset, length of the captures that wanted asks for by url_key and capture; with a null capture, all of that key."""
    spark = wanted.sparkSession
    shared = spark.sparkContext.broadcast(([(k, c) for k, c, _ in directory], [b for _, _, b in directory]))
    wanted = wanted.select("url_key", "capture").distinct()

    @F.pandas_udf("array<long>")
    def block_of(keys: pd.Series, captures: pd.Series) -> pd.Series:
        firsts, numbers = shared.value
        out = []
        for k, c in zip(keys, captures):
            low, high = ((k, _NONE), (k, 1 << 63)) if pd.isna(c) else ((k, int(c)), (k, int(c)))
            out.append(numbers[max(0, bisect_left(firsts, low) - 1) : bisect_right(firsts, high)])
        return pd.Series(out)

    def find(asked: pd.DataFrame, data: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for packed in data["data"]:
            lines = [x.split("\t") for x in zlib.decompress(packed).decode().split("\n")]
            keys = [(x[0], int(x[1])) for x in lines]
            for k, c in zip(asked["url_key"], asked["capture"]):
                low, high = ((k, _NONE), (k, 1 << 63)) if c is None or c != c else ((k, int(c)), (k, int(c)))
                rows += [(x[2], int(x[3]), int(x[4])) for x in lines[bisect_left(keys, low) : bisect_right(keys, high)]]
        return pd.DataFrame(rows, columns=["archive", "offset", "length"])

    # a capture id is text on its way through pandas: a nullable long would turn into a float there
    asked = wanted.select("url_key", F.col("capture").cast("string").alias("capture"), F.explode(block_of("url_key", F.col("capture").cast("string"))).alias("block"))
    return asked.groupBy("block").cogroup(blocks.groupBy("block")).applyInPandas(find, "archive string, offset long, length long")


def ranges(rows: Iterator[tuple[str, int, int]]) -> Iterator[bytes]:
    """The bytes at (archive, offset, length), by range reads. Records that follow one another in a file are read together, READ bytes or one record at a time."""
    name, file, have, start = None, None, b"", 0
    for archive, offset, length in rows:
        if archive != name:
            if file is not None:
                file.close()
            files, path = FileSystem.from_uri(archive)
            name, file, have, start = archive, files.open_input_file(path), b"", 0
            size = file.size()
        if not start <= offset <= offset + length <= start + len(have):
            start, have = offset, file.read_at(min(max(length, READ), size - offset), offset)
        yield have[offset - start : offset - start + length]
    if file is not None:
        file.close()


def read(located: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of the records at the located ranges (archive, offset, length), all from the archived bytes.

    Ranges are sorted by file and offset and dealt evenly, so a task reads few files from one place on. A record that is damaged is an error.
    """

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for member in ranges(zip(*(c.to_pylist() for c in batch.columns))):
                headers, block = parse(member)
                http, _, payload = block.partition(b"\r\n\r\n")
                size = int(next(x for x in http.decode().split("\r\n") if x.startswith("Content-Length: "))[16:])
                digest = headers["warc-payload-digest"].removeprefix("sha1:")
                if headers["warc-type"] == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
                    raise ValueError(f"damaged record {headers['warc-record-id']}")
                ids = [int(x) if (x := headers.get(name, "").removeprefix(f"<{_URN}").rstrip(">")) else None for name in ("warc-record-id", "warc-refers-to")]
                for to, x in zip(out, (ids[0], size, digest, headers["warc-type"], ids[1])):
                    to.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()))], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    sorted_ = located.select("archive", "offset", "length").repartitionByRange("archive", "offset").sortWithinPartitions("archive", "offset")
    return sorted_.mapInArrow(apply, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """What the archives of pages hold, looked up by every capture's key in the index, a row a page.

    Defined results: null html is an empty payload; a null url gets the key "-"; a null page_id is smaller than any other,
    and its record has no id; repeated rows have records of their own, all responses if theirs is the largest page_id;
    an empty table gives an empty result; other columns aren't looked at.
    """
    archives = write(pages, least_bytes)
    blocks, directory = build_index(archives)
    return read(locate(blocks, directory, archives.select("url_key", "capture")))


#: The same rows from the table itself. A base32 digit is five bits: those of two hex digits, shifted.
SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
d AS (SELECT hex, string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((
        (strpos('0123456789abcdef', substr(hex, (5 * i) // 4 + 1, 1)) - 1) * 16 + strpos('0123456789abcdef', substr(hex, (5 * i) // 4 + 2, 1)) - 1)
        >> (3 - (i % 4))::INT) % 32, 1), '' ORDER BY i) AS digest
      FROM (SELECT DISTINCT hex FROM p) x, range(32) r(i) GROUP BY hex),
w AS (SELECT hex, max(page_id) AS kept FROM p GROUP BY hex)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes, digest AS payload_digest,
  CASE WHEN page_id = kept THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = kept THEN NULL ELSE kept END AS refers_to
FROM p JOIN d USING (hex) JOIN w USING (hex)
"""
