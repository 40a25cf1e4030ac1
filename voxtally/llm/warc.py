"""WARC archives with a two-level capture index.

Writing is a map over the pages: every task writes archives of bounded size into the
shared folder, one gzip member per record, and returns where each record lies. A task
that runs again writes archives under new names, so the index never points into a
half-written one. Pages whose payload another page has as well become revisits.

The index holds one line per capture, sorted by the key: the URL with its host
reversed, and the page id. Lines are cut into compressed blocks. Above them lies a
sparse directory with the first key of each block (of every n-th block, if there are
so many that the directory would outgrow its bound). A lookup searches the directory
by bisection, brings keys and blocks together on the directory entry, bisects inside
the block, and then reads the byte range of the record, archive by archive.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import uuid
import zlib
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxtally.llm.common import MAX_BROADCAST_IDS, keys_repeat, numbered_rows, scratch, written

ARCHIVE_BYTES = 64 << 20
BLOCK_LINES = 1000
DIRECTORY_ENTRIES = 65_536
# Bytes of archives that one task reads.
TASK_BYTES = 16 << 20
# Lines that one task sorts into blocks.
PART_LINES = 200_000
CAPTURED = "1970-01-01T00:00:00Z"


def search_key(url: str | None) -> str:
    """A URL with its host reversed: ``com,example,www)/path?query``; without scheme and fragment.

    What cannot be split is taken as it is. NULL is the empty key.
    """
    text = (url or "").strip()
    try:
        parts = urlsplit(text if "//" in text else f"//{text}")
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return text.replace(" ", "%20").replace("\n", "%0A")
    name = ",".join(reversed(host.split(".")))
    name += f":{port}" if port and port not in (80, 443) else ""
    path = parts.path or "/"
    key = f"{name}){path}" + (f"?{parts.query}" if parts.query else "")
    return "".join(c if c > " " else f"%{ord(c):02X}" for c in key)


def capture_key(url: str | None, page: int) -> str:
    """The search key and the page id, such that ids sort as numbers."""
    return f"{search_key(url)} {page + (1 << 63):020d}"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page: int, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response record, or a revisit that names the page it repeats."""
    clean = "".join(c if c > " " else f"%{ord(c):02X}" for c in (url or ""))
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{page}>",
        f"WARC-Date: {CAPTURED}",
        f"WARC-Target-URI: {clean}",
        f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}",
    ]
    if refers_to is not None:
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        lines.append(f"WARC-Refers-To: <urn:page:{refers_to}>")
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    else:
        block = (
            f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
        ).encode() + payload
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers of a record and the payload after the HTTP header."""
    head, _, rest = data.partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(headers["Content-Length"])]
    return headers, block.partition(b"\r\n\r\n")[2]


def _opened(root: str) -> tuple[pafs.FileSystem, str]:
    if "://" in root or root.startswith("file:"):
        return pafs.FileSystem.from_uri(root)
    return pafs.LocalFileSystem(), root


def _writer(root: str, limit: int):
    def write(batches):
        files, folder = _opened(root)
        out, name, size = None, "", 0
        for batch in batches:
            rows: dict[str, list] = {"page_id": [], "key": [], "archive": [], "at": [], "length": []}
            for page, url, html, first in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "first"))):
                if out is None or size >= limit:
                    if out is not None:
                        out.close()
                    name, size = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = files.open_output_stream(f"{folder}/{name}", compression=None)
                member = gzip.compress(record(page, url, (html or "").encode(), first), 6, mtime=0)
                out.write(member)
                for column, value in zip(rows, (page, capture_key(url, page), name, size, len(member))):
                    rows[column].append(value)
                size += len(member)
            yield pa.RecordBatch.from_pydict(rows)
        if out is not None:
            out.close()

    return write


class Archive:
    """Archives in ``root`` with their bytes, blocks of the index, and how many directory entries apart they are."""

    def __init__(self, root: str, blocks: DataFrame, size: int):
        self.root = root
        self.blocks = blocks
        self.size = size
        total = blocks.count()
        self.stride = max(1, -(-total // DIRECTORY_ENTRIES))
        heads = blocks.filter(F.col("number") % self.stride == 0).orderBy("number").select("first")
        # At most DIRECTORY_ENTRIES keys.
        self.directory = heads.toArrow().column("first").to_pylist()


def write_archive(
    pages: DataFrame,
    root: str | None = None,
    least_bytes: int = 0,
    archive_bytes: int = ARCHIVE_BYTES,
    block_lines: int = BLOCK_LINES,
) -> Archive:
    """Write the pages (page_id, url, html) as WARC archives below ``root`` and index them.

    ``root`` is a new folder in ``spark.checkpoint.dir`` unless given; every executor must
    reach it by that path. A NULL html is an empty payload, a NULL url an empty URI.
    Of equal payloads of at least ``least_bytes`` bytes, the smallest page id is the
    response and the others are revisits. Page ids are unique here (see
    :func:`archived_pages`); rows without one are left out. Other columns are not read.
    """
    spark = pages.sparkSession
    root = root or scratch(spark, "warc")
    files, folder = _opened(root)
    files.create_dir(folder, recursive=True)
    source = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"),
    ).filter(F.col("page_id").isNotNull())
    # Payloads are compared by two digests and their length; only these are shuffled.
    prints = source.select(
        "page_id",
        F.unhex(F.sha1("html")).alias("a"),
        F.xxhash64("html").alias("b"),
        F.octet_length("html").alias("n"),
    ).filter(F.col("n") >= least_bytes)
    prints = written(prints, "warc-prints")
    firsts = prints.groupBy("a", "b", "n").agg(F.min("page_id").alias("first"), F.count("*").alias("m"))
    # Written, so that the join of a frequent payload can be split.
    firsts = written(firsts.filter("m > 1"), "warc-firsts")
    again = prints.join(firsts, ["a", "b", "n"]).filter("page_id <> first")
    again = written(again.select("page_id", "first"), "warc-revisits")
    if again.count() <= MAX_BROADCAST_IDS:
        again = F.broadcast(again)
    captures = written(
        source.join(again, "page_id", "left").mapInArrow(
            _writer(root, archive_bytes), "page_id long, key string, archive string, at long, length long"
        ),
        "warc-captures",
    )
    parts = max(1, -(-captures.count() // PART_LINES))
    ordered = captures.repartitionByRange(parts, "key").sortWithinPartitions("key")
    blocks = ordered.select("key", "archive", "at", "length").mapInArrow(
        _blocks(block_lines), "first string, lines int, data binary, task int, place long"
    )
    blocks = written(blocks, "warc-blocks")
    # Numbers in the order of the keys, from the counts of the tasks that cut the index.
    counts = blocks.groupBy("task").agg(F.count("*").alias("n"))
    before = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    index = blocks.join(F.broadcast(counts), "task")
    index = index.select("first", "lines", "data", (F.col("before") + F.col("place")).cast("long").alias("number"))
    size = captures.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    return Archive(root, written(index, "warc-index"), size)


def _blocks(size: int):
    def cut(batches):
        lines: list[tuple] = []
        task, place = TaskContext.get().partitionId(), 0

        def block(some):
            nonlocal place
            text = "\n".join(" ".join(map(str, line)) for line in some)
            place += 1
            return pa.RecordBatch.from_pydict(
                {
                    "first": [some[0][0]],
                    "lines": pa.array([len(some)], pa.int32()),
                    "data": [zlib.compress(text.encode())],
                    "task": pa.array([task], pa.int32()),
                    "place": pa.array([place - 1], pa.int64()),
                }
            )

        for batch in batches:
            lines += zip(*(c.to_pylist() for c in batch.columns))
            while len(lines) >= size:
                yield block(lines[:size])
                lines = lines[size:]
        if lines:
            yield block(lines)

    return cut


def lookup(archive: Archive, wanted: DataFrame) -> DataFrame:
    """Rows (page_id, archive, at, length) for the captures that ``wanted`` (page_id, url) names.

    Repeated rows are looked up once; rows that were never captured give nothing.
    """
    directory, stride = archive.directory, archive.stride

    def locate(batches):
        for batch in batches:
            ids, urls = batch.column("page_id").to_pylist(), batch.column("url").to_pylist()
            keys = [capture_key(u, p) for p, u in zip(ids, urls)]
            entry = [bisect.bisect_right(directory, k) - 1 for k in keys]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), pa.array(keys, pa.string()), pa.array(entry, pa.int64())],
                ["page_id", "key", "entry"],
            )

    def search(keys: pa.Table, blocks: pa.Table) -> pa.Table:
        found: dict[str, list] = {"page_id": [], "archive": [], "at": [], "length": []}
        blocks = blocks.sort_by("first")
        heads, data = blocks.column("first").to_pylist(), blocks.column("data")
        opened: dict[int, list[list[str]]] = {}
        for page, key in zip(keys.column("page_id").to_pylist(), keys.column("key").to_pylist()):
            b = bisect.bisect_right(heads, key) - 1
            if b < 0:
                continue
            if b not in opened:
                text = zlib.decompress(data[b].as_py()).decode()
                opened[b] = [line.rsplit(" ", 3) for line in text.split("\n")]
            lines = opened[b]
            i = bisect.bisect_left(lines, key, key=lambda line: line[0])
            if i < len(lines) and lines[i][0] == key:
                for column, value in zip(found, (page, lines[i][1], int(lines[i][2]), int(lines[i][3]))):
                    found[column].append(value)
        return pa.table(
            {
                "page_id": pa.array(found["page_id"], pa.int64()),
                "archive": pa.array(found["archive"], pa.string()),
                "at": pa.array(found["at"], pa.int64()),
                "length": pa.array(found["length"], pa.int64()),
            }
        )

    asked = wanted.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    asked = asked.filter(F.col("page_id").isNotNull()).distinct()
    keys = asked.mapInArrow(locate, "page_id long, key string, entry long").filter("entry >= 0")
    blocks = archive.blocks.select("first", "data", F.floor(F.col("number") / stride).cast("long").alias("entry"))
    return (
        keys.groupBy("entry")
        .cogroup(blocks.groupBy("entry"))
        .applyInArrow(search, "page_id long, archive string, at long, length long")
    )


def read_records(archive: Archive, places: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records at ``places`` (archive, at, length), read by byte range.

    Rows (page_id, url, record_type, refers_to, payload_digest, payload_bytes, payload).
    A revisit has no payload of its own: its bytes are NULL, its digest is that of the
    header. The digest of a response is computed from the payload that was read.
    """
    root = archive.root

    def read(batches):
        files, folder = _opened(root)
        name, source = None, None
        for batch in batches:
            rows: dict[str, list] = {
                c: [] for c in ("page_id", "url", "record_type", "refers_to", "payload_digest", "payload_bytes", "payload")
            }
            for where, at, length in zip(*(batch.column(c).to_pylist() for c in ("archive", "at", "length"))):
                if where != name:
                    if source is not None:
                        source.close()
                    name, source = where, files.open_input_file(f"{folder}/{where}")
                source.seek(at)
                headers, payload = parse_record(gzip.decompress(source.read(length)))
                response = headers["WARC-Type"] == "response"
                refers = headers.get("WARC-Refers-To")
                values = (
                    int(headers["WARC-Record-ID"][10:-1]),
                    headers["WARC-Target-URI"],
                    headers["WARC-Type"],
                    int(refers[10:-1]) if refers else None,
                    base32_sha1(payload) if response else headers["WARC-Payload-Digest"].removeprefix("sha1:"),
                    len(payload) if response else None,
                    payload if response and with_payload else None,
                )
                for column, value in zip(rows, values):
                    rows[column].append(value)
            kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(rows.values(), kinds)], list(rows))
        if source is not None:
            source.close()

    # Archives have a bounded size, so that the rows of one do not make a task too large. The
    # rows are narrow and tell nothing of what is read, so the number of tasks is given.
    tasks = max(1, -(-archive.size // TASK_BYTES))
    dealt = places.repartition(tasks, "archive").sortWithinPartitions("archive", "at")
    return dealt.select("archive", "at", "length").mapInArrow(
        read,
        "page_id long, url string, record_type string, refers_to long, payload_digest string,"
        " payload_bytes long, payload binary",
    )


def archived_pages(spark: SparkSession, pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write the pages, look every one of them up, and read it back.

    Rows (page_id, payload_bytes, payload_digest, record_type, refers_to). The bytes of a
    revisit are those of the response it refers to. Rows that share a page id are records
    of their own: they are numbered in the order of the ids, the archives hold the
    numbers, and the rows that come out the ids. An empty table gives no rows.
    """
    if keys_repeat(pages, "page_id"):
        rows, number = numbered_rows(pages.select("page_id", "url", "html"), "page_id", "url", "html")
        out = archived_pages(spark, rows.select(F.col(number).alias("page_id"), "url", "html"), least_bytes)
        names = rows.select(F.col(number).alias("_row"), F.col("page_id").cast("long").alias("_name"))
        own = out.withColumnRenamed("page_id", "_row").join(names, "_row").withColumnRenamed("_name", "page_id").drop("_row")
        named = own.withColumnRenamed("refers_to", "_row").join(names, "_row", "left").withColumnRenamed("_name", "refers_to")
        return named.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    archive = write_archive(pages, least_bytes=least_bytes)
    records = written(read_records(archive, lookup(archive, pages), with_payload=False), "warc-read")
    bytes_of = records.filter("record_type = 'response'").select(
        F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("whole")
    )
    return records.join(bytes_of, "refers_to", "left").select(
        "page_id",
        F.coalesce("payload_bytes", "whole").alias("payload_bytes"),
        "payload_digest",
        "record_type",
        "refers_to",
    )
