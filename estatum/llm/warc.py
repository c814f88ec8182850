"""WARC archives of Zstandard frames.

Layout of an archive: a leading skippable frame that holds the compression
dictionary, then one frame a record.  ``pack_archives`` turns rows into archives
of bounded size; ``read_archives`` decodes any table of (name, content), such as
Spark's ``binaryFile`` source gives, one row a record, and validates record
headers, block lengths and payload digests.  A broken record gives a row with
its ``error``; a broken frame ends its archive with such a row.
"""

from __future__ import annotations

import base64
import hashlib
import struct

import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from estatum.llm.common import materialize, table

SKIPPABLE = 0x184D2A5D
FRAME = 0xFD2FB528
ARCHIVE_BYTES = 8 << 20
#: The dictionary of an archive is learned from its first records, up to this size.
SAMPLE_BYTES = 1 << 20
RECORD = "archive string, record_id string, record_type string, target_uri string, payload_bytes long, payload_digest string, refers_to string, payload binary, error string"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id, url: str | None, payload: bytes, refers_to) -> bytes:
    """A response, or a revisit (no payload) when ``refers_to`` is given."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head if refers_to is not None else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{page_id}>", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {' '.join((url or '').split())}", f"WARC-Payload-Digest: sha1:{digest(payload)}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def archive(records: list[bytes], level: int = 3) -> bytes:
    sample, size = [], 0
    for r in records:
        if size >= SAMPLE_BYTES:
            break
        sample.append(r[: SAMPLE_BYTES - size])
        size += len(sample[-1])
    try:
        trained = zstd.train_dictionary(16 << 10, sample) if len(sample) >= 16 else None
    except zstd.ZstdError:
        trained = None
    if trained is None:
        trained = zstd.ZstdCompressionDict(b"".join(sample)[: 16 << 10].ljust(8, b" "), dict_type=zstd.DICT_TYPE_RAWCONTENT)
    raw = trained.as_bytes()
    press = zstd.ZstdCompressor(level=level, dict_data=trained, write_checksum=True)
    return struct.pack("<II", SKIPPABLE, len(raw)) + raw + b"".join(press.compress(r) for r in records)


def _headers(block: bytes) -> tuple[dict[str, str], int]:
    end = block.find(b"\r\n\r\n")
    if end < 0:
        raise ValueError("header has no end")
    first, *lines = block[:end].decode("utf-8", "replace").split("\r\n")
    out = {"": first}
    for line in lines:
        name, sep, value = line.partition(":")
        if not sep or not name.strip():
            raise ValueError(f"bad header line {line[:40]!r}")
        out[name.strip().lower()] = value.strip()
    return out, end + 4


def parse(raw: bytes) -> tuple:
    """(id, type, uri, payload length, digest, refers to, payload) of a record."""
    head, at = _headers(raw)
    if not head[""].startswith("WARC/1."):
        raise ValueError("not a WARC record")
    for need in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if need not in head:
            raise ValueError(f"{need} is missing")
    length = int(head["content-length"])
    if length < 0 or at + length + 4 != len(raw) or raw[-4:] != b"\r\n\r\n":
        raise ValueError(f"Content-Length {length} doesn't fit a record of {len(raw) - at - 4}")
    block = raw[at : at + length]
    http, start = _headers(block)
    size, payload = int(http.get("content-length", len(block) - start)), block[start:]
    named = head.get("warc-payload-digest", "").removeprefix("sha1:")
    if head["warc-type"] == "response":
        if size != len(payload):
            raise ValueError(f"payload of {len(payload)} bytes, {size} announced")
        if named and named != digest(payload):
            raise ValueError("payload digest differs")
    elif head["warc-type"] == "revisit" and payload:
        raise ValueError("revisit with a payload")
    ident = lambda x: x.removeprefix("<").removesuffix(">").rpartition(":")[2] if x else None
    return ident(head["warc-record-id"]), head["warc-type"], head.get("warc-target-uri"), size, named, ident(head.get("warc-refers-to")), payload


def frames(content: bytes):
    """The decompressed frames of an archive, by its leading dictionary."""
    trained, at = None, 0
    if len(content) >= 8 and struct.unpack_from("<I", content)[0] & 0xFFFFFFF0 == 0x184D2A50:
        magic, size = struct.unpack_from("<II", content)
        if magic == SKIPPABLE:
            raw = content[8 : 8 + size]
            if raw[:4] == struct.pack("<I", FRAME):
                raw = zstd.ZstdDecompressor().decompress(raw)
            trained = zstd.ZstdCompressionDict(raw, dict_type=zstd.DICT_TYPE_AUTO)
        at = 8 + size
    press, view = zstd.ZstdDecompressor(**({"dict_data": trained} if trained else {})), memoryview(content)
    while at < len(content):
        one = press.decompressobj()
        out = [one.decompress(view[at : at + 65536])]
        to = at + 65536
        while not one.eof:
            if to >= len(content):
                raise ValueError("last frame is cut off")
            out.append(one.decompress(view[to : to + 65536]))
            to += 65536
        at = min(to, len(content)) - len(one.unused_data)
        yield b"".join(out)


def pack_archives(pages: DataFrame, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """(page_id, url, html, refers_to) to (name, content), archives of about
    ``archive_bytes`` before compression, whatever the partitions hold."""

    def run(batches):
        from pyspark import TaskContext

        part, n, held, size = TaskContext.get().partitionId(), 0, [], 0
        row = lambda: pa.RecordBatch.from_arrays([pa.array([f"part-{part:05d}-{n:05d}.warc.zst"]), pa.array([archive(held)], pa.binary())], names=["name", "content"])
        for b in batches:
            for page, url, html, to in zip(*(b.column(i) for i in range(4)), strict=True):
                held.append(record(page.as_py(), url.as_py(), (html.as_py() or "").encode(), to.as_py()))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield row()
                    n, held, size = n + 1, [], 0
        if held:
            yield row()

    return pages.select("page_id", "url", "html", "refers_to").mapInArrow(run, "name string, content binary")


def read_archives(files: DataFrame, name: str = "name", content: str = "content", payloads: bool = True) -> DataFrame:
    kinds = [pa.string()] * 4 + [pa.int64(), pa.string(), pa.string(), pa.binary(), pa.string()]
    names = [x.split(" ")[0] for x in RECORD.split(", ")]

    def run(batches):
        def out(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

        for b in batches:
            for label, data in zip(b.column(0), b.column(1), strict=True):
                label, rows = label.as_py(), []
                try:
                    for raw in frames(data.as_py() or b""):
                        try:
                            x = parse(raw)
                            rows.append((label, *x[:6], x[6] if payloads else None, None))
                        except ValueError as e:
                            rows.append((label, *[None] * 7, str(e)))
                        if len(rows) >= 256:
                            yield out(rows)
                            rows = []
                except (ValueError, zstd.ZstdError) as e:
                    rows.append((label, *[None] * 7, f"broken frame: {e}"))
                if rows:
                    yield out(rows)

    return files.select(name, content).mapInArrow(run, RECORD)


def link_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Add ``refers_to``: of equal payloads of at least ``min_bytes`` bytes, the
    smallest page_id, null for that page itself and for shorter payloads.

    Only digests are grouped; the payload is shuffled once, by page and digest, so
    pages of one id and different payloads are told apart.  Rows equal in both are all
    what the first is.  A null page_id is no page's first and refers to none.  An empty
    table gives no rows."""
    html = F.coalesce("html", F.lit(""))
    named = pages.withColumn("_h", F.sha2(html, 256))
    keyed = named.select("page_id", "_h").filter(F.octet_length(html) >= min_bytes) if min_bytes else named.select("page_id", "_h")
    first = keyed.groupBy("_h").agg(F.min("page_id").alias("_first"), F.count(F.lit(1)).alias("_c")).filter("_c > 1").select(F.col("_h").alias("_g"), "_first")
    later = keyed.join(first, F.col("_h") == F.col("_g")).filter("page_id > _first").select(F.col("page_id").alias("_p"), "_g", F.col("_first").alias("refers_to")).distinct()
    return named.join(later, (F.col("page_id") == F.col("_p")) & (F.col("_h") == F.col("_g")), "left").drop("_p", "_g", "_h")


def op5_warc(spark, sf_dir: str) -> DataFrame:
    """Write the pages as WARC archives, read these back, one row a record.

    Null html counts as empty; all empty pages but the first are revisits."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    files = materialize(pack_archives(link_revisits(pages)), "warc")
    out = read_archives(files, payloads=False)
    return out.select(F.col("record_id").try_cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").try_cast("long").alias("refers_to"), "error")
