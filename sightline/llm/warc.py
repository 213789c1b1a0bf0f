"""WARC archives with a two-level capture index.

Writing: tasks write gzip-per-record archives to shared storage and report where each record is.  The
captures are then range-sorted by reversed-host URL key; every task of that sort writes one index shard of
compressed blocks and reports a sparse directory, one entry per block with its first key.

Reading: a key finds its shard by binary search over the shards' first keys, its block by binary search
in that shard's directory, and its line in the decompressed block; the record itself is one range read.

Files get unused names and count only once the task's report is saved, so a lost executor or a second
attempt leaves an orphan file behind but never a double record.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightline.llm.common import saved, small_side
from sightline.session import work_folder

FILE_BYTES = 1 << 30
BLOCK_LINES = 3_000
SHARD_LINES = 250_000
#: Records of one stretch of an archive are read by one task.
STRETCH = 16 << 20
LEVEL = 6
_DATE = "2024-01-01T00:00:00Z"
_ID = "urn:sightline:page:"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def url_key(url: str | None) -> str:
    """Reversed host, then path and query: ``com,example,www)/a?b``; empty for null.  Control characters become spaces."""
    if not url:
        return ""
    rest = re.sub(r"[\x00-\x20\x7f]", "%20", url.split("://", 1)[-1]).split("#", 1)[0]
    host = re.match(r"[^/?]*", rest)[0]
    name, _, port = host.rpartition("@")[2].partition(":")
    labels = ",".join(reversed(name.lower().split(".")))
    return f"{labels}{':' + port if port and port not in ('80', '443') else ''}){rest[len(host) :] or '/'}"


def digest_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record; a revisit keeps the HTTP head, with the length, and leaves out the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{_ID}{'' if page_id is None else page_id}>", f"WARC-Date: {_DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", "%20", url))
    head.append(f"WARC-Payload-Digest: sha1:{digest_base32(payload)}")
    if revisit:
        head += [f"WARC-Refers-To: <{_ID}{refers_to}>", f"WARC-Profile: {_PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """The fields of a record; of a response the digest is computed from the payload and must agree with the head."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    named = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(named["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = named["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = named["WARC-Type"]
    if kind == "response" and (len(payload) != size or digest_base32(payload) != digest):
        raise ValueError(f"damaged record {named['WARC-Record-ID']}")
    number = lambda name: int(n) if (n := named.get(name, "").removeprefix(f"<{_ID}").rstrip(">")) else None
    return {
        "page_id": number("WARC-Record-ID"), "url": named.get("WARC-Target-URI"), "payload_bytes": size, "payload_digest": digest,
        "record_type": kind, "refers_to": number("WARC-Refers-To"), "payload": payload if kind == "response" else None,
    }


def _store(folder: str) -> tuple[fs.FileSystem, str]:
    if folder.startswith("file:/") and not folder.startswith("file://"):
        folder = "file://" + folder[5:]
    return fs.FileSystem.from_uri(folder)


# --- writing -----------------------------------------------------------------------------------------


def classed(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Add ``revisit`` and ``refers_to``: of equal payloads of at least ``least_bytes`` the smallest page_id is the response.

    The payloads do not move unless there are very many groups of copies: their digests are counted, and
    only groups of two and more meet the pages again.
    """
    html = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html"), F.sha1(html.cast("binary")).alias("sha1"), F.octet_length(html).alias("size"))
    seen = rows.filter(F.col("size") >= least_bytes).groupBy("sha1").agg(F.count("*").alias("n"), F.min("page_id").alias("first"))
    copies = saved(seen.filter("n > 1 and first is not null").select("sha1", "first"))
    met = rows.join(small_side(copies), "sha1", "left")
    revisit = F.coalesce((F.col("size") >= least_bytes) & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.lit(False))
    return met.select("page_id", "url", "html", revisit.alias("revisit"), F.when(revisit, F.col("first")).alias("refers_to"))


_CAPTURE = pa.schema([("url_key", pa.string()), ("page_id", pa.int64()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])


def _writer(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = _store(folder)
        store.create_dir(path, recursive=True)
        name, out, at = "", None, 0
        try:
            for batch in batches:
                rows = []
                for page_id, url, html, revisit, refers_to in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                    if out is None or at >= FILE_BYTES:
                        if out is not None:
                            out.close()
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = store.open_output_stream(f"{path}/{name}", compression=None)
                    gz = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                    data = gz.compress(record(page_id, url, html.encode(), refers_to, revisit)) + gz.flush()
                    out.write(data)
                    rows.append((url_key(url), page_id, name, at, len(data)))
                    at += len(data)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * 5, _CAPTURE, strict=True)], schema=_CAPTURE)
        finally:
            if out is not None:
                out.close()

    return run


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0) -> DataFrame:
    """Write a record per row of ``pages`` (``page_id, url, html``); the saved captures ``url_key, page_id, file, offset, length``.

    Null html is an empty payload, null url a record without a target.
    """
    return saved(classed(pages, least_bytes).mapInArrow(_writer(folder), "url_key string, page_id long, file string, offset long, length long"))


_BLOCK = "shard string, first_key string, first_id long, offset long, length long, lines long"


def _line_key(url: str, page_id: int | None) -> tuple[str, int]:
    return url, -(1 << 63) if page_id is None else page_id


def _indexer(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = _store(folder)
        name, out, at = f"{uuid.uuid4().hex}.cdx.gz", None, 0
        held: list[tuple] = []

        def close_block() -> pa.RecordBatch:
            nonlocal out, at, held
            if out is None:
                store.create_dir(path, recursive=True)
                out = store.open_output_stream(f"{path}/{name}", compression=None)
            text = "".join("\t".join("" if x is None else str(x) for x in row) + "\n" for row in held)
            gz = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
            data = gz.compress(text.encode()) + gz.flush()
            out.write(data)
            row = {"shard": name, "first_key": held[0][0], "first_id": _line_key(*held[0][:2])[1], "offset": at, "length": len(data), "lines": len(held)}
            at, held = at + len(data), []
            return pa.RecordBatch.from_pylist([row])

        try:
            for batch in batches:
                for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                    held.append(row)
                    if len(held) == BLOCK_LINES:
                        yield close_block()
            if held:
                yield close_block()
        finally:
            if out is not None:
                out.close()

    return run


def build_index(captures: DataFrame, folder: str) -> DataFrame:
    """Write the index shards of the captures; the saved directory, one row per compressed block."""
    n = captures.count()
    shards = max(int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions")) if n > BLOCK_LINES else 1, -(-n // SHARD_LINES))
    # a URL captured any number of times is split by its page ids
    order = ["url_key", "page_id", "file", "offset"]
    sorted_ = captures.select(*_CAPTURE.names).repartitionByRange(shards, *order).sortWithinPartitions(*order)
    return saved(sorted_.mapInArrow(_indexer(folder), _BLOCK))


# --- reading -----------------------------------------------------------------------------------------


def _to_shard(firsts: list[tuple[tuple[str, int], str]]):
    keys, names = [k for k, _ in firsts], [n for _, n in firsts]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted = [_line_key(*row) for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            at = [bisect_right(keys, k) - 1 for k in wanted]
            # lines of one key may begin in the shard before
            rows = {(names[i], *w) for i, w in zip(at, wanted, strict=True) if i >= 0}
            for i, w in zip(at, wanted, strict=True):
                while i > 0 and keys[i] == w:
                    i -= 1
                    rows.add((names[i], *w))
            found = sorted(rows)
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in found], t) for c, t in enumerate((pa.string(), pa.string(), pa.int64()))], names=["shard", "url_key", "wanted"])

    return run


def _locate(folder: str):
    def run(wanted: pa.Table, directory: pa.Table) -> pa.Table:
        store, path = _store(folder)
        blocks = sorted(directory.to_pylist(), key=lambda b: b["offset"])
        firsts = [(b["first_key"], b["first_id"]) for b in blocks]
        by_block: dict[int, set] = {}
        for key in zip(wanted.column("url_key").to_pylist(), wanted.column("wanted").to_pylist(), strict=True):
            i = bisect_right(firsts, key) - 1
            while i >= 0:
                by_block.setdefault(i, set()).add(key)
                if firsts[i] != key:
                    break
                i -= 1
        rows = []
        if by_block:
            with store.open_input_file(f"{path}/{blocks[0]['shard']}") as file:
                for i, keys in sorted(by_block.items()):
                    text = zlib.decompress(file.read_at(blocks[i]["length"], blocks[i]["offset"]), 31).decode()
                    for line in text.split("\n")[:-1]:
                        url, page, name, offset, length = line.split("\t")
                        page_id = int(page) if page else None
                        if _line_key(url, page_id) in keys:
                            rows.append((url, page_id, name, int(offset), int(length)))
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * 5, _CAPTURE, strict=True)], schema=_CAPTURE)

    return run


def lookup(keys: DataFrame, directory: DataFrame, folder: str) -> DataFrame:
    """Captures of ``keys`` (``url_key, page_id``) by the index: ``url_key, page_id, file, offset, length``.

    Only the first key of each shard (one per ``SHARD_LINES`` captures) is held by all tasks.
    """
    first = directory.groupBy("shard").agg(F.min(F.struct("first_key", "first_id")).alias("k")).collect()
    firsts = sorted(((r["k"]["first_key"], r["k"]["first_id"]), r["shard"]) for r in first)
    wanted = keys.select("url_key", "page_id").distinct().mapInArrow(_to_shard(firsts), "shard string, url_key string, wanted long")
    schema = "url_key string, page_id long, file string, offset long, length long"
    return wanted.groupBy("shard").cogroup(directory.groupBy("shard")).applyInArrow(_locate(folder), schema)


_RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _reader(folder: str, payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = _store(folder)
        name, file = "", None
        try:
            for batch in batches:
                rows = []
                for target, offset, length in zip(*[batch.column(c).to_pylist() for c in ("file", "offset", "length")], strict=True):
                    if target != name:
                        if file is not None:
                            file.close()
                        name, file = target, store.open_input_file(f"{path}/{target}")
                    row = parse_record(zlib.decompress(file.read_at(length, offset), 31))
                    rows.append(row if payload else {k: v for k, v in row.items() if k != "payload"})
                kinds = [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())]
                yield pa.RecordBatch.from_pylist(rows, pa.schema(kinds + [("payload", pa.binary())] * payload))
        finally:
            if file is not None:
                file.close()

    return run


def read_records(captures: DataFrame, folder: str, payload: bool = False) -> DataFrame:
    """Range-read the records of ``captures``, those of a stretch of an archive by one task in file order."""
    stretch: Column = F.floor(F.col("offset") / STRETCH)
    tasks = int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # small rows stand for large reads: not to be merged
    dealt = captures.select("file", "offset", "length").repartition(tasks, "file", stretch).sortWithinPartitions("file", "offset")
    return dealt.mapInArrow(_reader(folder, payload), _RECORD + ", payload binary" * payload)


def archive_round_trip(pages: DataFrame, folder: str | None = None, least_bytes: int = 0) -> DataFrame:
    """Write ``pages``, index them, and read every record back through the index.

    Returns one row per row of ``pages``.  Rows without an id are responses unless a row with an id has the
    same payload; of rows that repeat the smallest id of a payload each is a response.  Empty table: no rows.
    """
    folder = folder or work_folder(pages.sparkSession)
    captures = write_archives(pages, folder, least_bytes)
    directory = build_index(captures, folder)
    return read_records(lookup(captures, directory, folder), folder)
