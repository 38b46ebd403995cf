"""WARC archives compressed with Zstandard (.warc.zst): writer and reader.

An archive starts with a skippable frame (magic 0x184D2A5D) that holds the dictionary, itself
perhaps a Zstandard frame. One frame for each record follows, so a reader can start at any record.

``write`` gives archives as rows (path, content), the columns of Spark's ``binaryFile`` source, so
``read`` takes either a written table of them or ``spark.read.format("binaryFile").load("*.warc.zst")``.
An archive holds about ``archive_bytes`` of payload; the dictionary is trained on its first
``SAMPLES`` records, whose number and length are bounded, and left out where they are too few.

Equal payloads of at least ``min_revisit`` bytes: the smallest page id is the response, the others are revisits of
it. The counts for that are a grouped aggregate by digest; only groups of two and more are joined back, by a join that
Spark may split when one payload makes up much of the table.

Cases: a null html is an empty payload; a null url gives no target line; control characters of a url are
percent-encoded; a null page id is never the target of a revisit (a group without any id is all response); rows that
repeat the smallest page id of their group are all response; an empty table gives no archive and no rows;
other columns are not read. ``read`` raises ValueError on a damaged archive or, with ``strict=False``, gives a
row with the message in ``error`` and goes on with the next archive.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DICT_MAGIC, FRAME_MAGIC = 0x184D2A5D, 0xFD2FB528
SAMPLES, SAMPLE_BYTES, DICT_BYTES = 200, 8192, 65536
MIN_REVISIT = 100
DATE = "2024-01-01T00:00:00Z"
URN = "<urn:brevilog:page:%s>"
FEED = 1 << 14

_ARCHIVE = "path string, content binary"
_ARCHIVE_ARROW = pa.schema([("path", pa.string()), ("content", pa.binary())])
_RECORD = ("path string, page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, "
           "refers_to long, error string")
_RECORD_ARROW = pa.schema([("path", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()),
                           ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()),
                           ("refers_to", pa.int64()), ("error", pa.string())])


# --- records -----------------------------------------------------------------------

def _clean(url: str) -> str:
    return "".join(c if c >= " " and c != "\x7f" else "".join("%%%02X" % b for b in c.encode()) for c in url)


def record(kind: str, fields: dict[str, str | None], block: bytes) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Date: {DATE}",
             *[f"{k}: {v}" for k, v in fields.items() if v is not None], f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def page_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    fields = {"WARC-Record-ID": URN % ("none" if page_id is None else page_id),
              "WARC-Target-URI": None if url is None else _clean(url),
              "Content-Type": "application/http;msgtype=response", "WARC-Payload-Digest": f"sha256:{digest}"}
    if refers_to is None:
        return record("response", fields, http + payload)
    return record("revisit", fields | {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                                       "WARC-Refers-To": URN % refers_to}, http)


def archive(records: list[bytes], name: str) -> bytes:
    """Dictionary frame and one frame for each record, a warcinfo record first."""
    records = [record("warcinfo", {"WARC-Record-ID": URN % "info", "WARC-Filename": name,
                                   "Content-Type": "application/warc-fields"}, b"format: WARC File Format 1.1\r\n"), *records]
    try:
        dictionary = zstandard.train_dictionary(DICT_BYTES, [r[:SAMPLE_BYTES] for r in records[:SAMPLES]])
    except zstandard.ZstdError:  # too few or too short samples to train on
        dictionary = None
    press = zstandard.ZstdCompressor(level=3, dict_data=dictionary, write_content_size=True, write_checksum=True)
    parts = []
    if dictionary is not None:
        held = zstandard.ZstdCompressor(level=3).compress(dictionary.as_bytes())
        parts.append(struct.pack("<II", DICT_MAGIC, len(held)) + held)
    return b"".join(parts + [press.compress(r) for r in records])


def frames(content: bytes) -> Iterator[bytes]:
    """The records of an archive. Raises ValueError where a frame is damaged or cut off."""
    view, at, dictionary = memoryview(content), 0, None
    if len(view) >= 8 and struct.unpack_from("<I", view)[0] == DICT_MAGIC:
        size = struct.unpack_from("<I", view, 4)[0]
        held = bytes(view[8 : 8 + size])
        if len(held) != size:
            raise ValueError("dictionary frame is cut off")
        if len(held) >= 4 and struct.unpack_from("<I", held)[0] == FRAME_MAGIC:
            frame = zstandard.ZstdDecompressor().decompressobj()
            try:
                held = frame.decompress(held)
            except zstandard.ZstdError as why:
                raise ValueError(f"damaged dictionary frame: {why}") from why
            if not frame.eof:
                raise ValueError("dictionary frame is cut off")
        dictionary, at = zstandard.ZstdCompressionDict(held), 8 + size
    unpress = zstandard.ZstdDecompressor(dict_data=dictionary)
    while at < len(view):
        magic = struct.unpack_from("<I", view, at)[0] if at + 8 <= len(view) else 0
        if magic & 0xFFFFFFF0 == 0x184D2A50:  # another skippable frame
            at += 8 + struct.unpack_from("<I", view, at + 4)[0]
            if at > len(view):
                raise ValueError("frame is cut off")
            continue
        if magic != FRAME_MAGIC:
            raise ValueError(f"no frame at byte {at}")
        frame, out = unpress.decompressobj(), []
        try:
            while not frame.eof:
                if at >= len(view):
                    raise ValueError("frame is cut off")
                out.append(frame.decompress(view[at : at + FEED]))
                at += len(view[at : at + FEED])
        except zstandard.ZstdError as why:
            raise ValueError(f"damaged frame: {why}") from why
        at -= len(frame.unused_data)
        yield b"".join(out)


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (names in lower case) and block of one record, checked."""
    head, mark, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not mark or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise ValueError(f"no WARC header: {lines[0][:40]!r}")
    fields: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name.strip():
            raise ValueError(f"bad header line: {line[:60]!r}")
        fields[name.strip().lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in fields:
            raise ValueError(f"{name} is missing")
    if not fields["content-length"].isdigit():
        raise ValueError(f"bad length: {fields['content-length'][:40]!r}")
    size = int(fields["content-length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ValueError(f"the block has {len(rest) - 4} bytes, its header says {size}")
    return fields, rest[:size]


def _id(urn: str | None) -> int | None:
    tail = (urn or "").rstrip(">").rpartition(":")[2]
    return int(tail) if tail.lstrip("-").isdigit() else None


def page_of(fields: dict[str, str], block: bytes) -> tuple:
    """(page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to) of a response or revisit."""
    head, mark, payload = block.partition(b"\r\n\r\n")
    http = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("latin-1").split("\r\n")[1:])}
    if not mark or not head.startswith(b"HTTP/") or not http.get("content-length", "").isdigit():
        raise ValueError("no HTTP header with a length")
    size, kind = int(http["content-length"]), fields["warc-type"]
    digest = fields.get("warc-payload-digest", "").removeprefix("sha256:")
    if kind == "response":
        if len(payload) != size or hashlib.sha256(payload).hexdigest() != digest:
            raise ValueError("the payload is not what its length and digest say")
    elif payload or "warc-refers-to" not in fields:
        raise ValueError("a revisit has a payload or refers to nothing")
    return (_id(fields["warc-record-id"]), fields.get("warc-target-uri"), payload if kind == "response" else None, size, digest,
            kind, _id(fields.get("warc-refers-to")))


# --- Spark -------------------------------------------------------------------------

def with_revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                  min_revisit: int = MIN_REVISIT) -> DataFrame:
    """(page_id, url, html, digest, refers_to): refers_to is null for responses."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"),
                        F.coalesce(F.col(html_col), F.lit("")).alias("html")).withColumn("digest", F.sha2("html", 256))
    first = (rows.where(F.octet_length("html") >= min_revisit).groupBy("digest")
             .agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null"))
    return rows.join(first, "digest", "left").select(
        "page_id", "url", "html", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))


def write(pages: DataFrame, archive_bytes: int = 8 << 20, **options) -> DataFrame:
    """Archives (path, content) of the pages."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, ""

        def flush() -> pa.RecordBatch:
            name = f"pages-{hashlib.sha256(held[0] + last.encode()).hexdigest()[:24]}.warc.zst"
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([archive(held, name)], pa.binary())],
                                              schema=_ARCHIVE_ARROW)
        for b in batches:
            ids, urls, digests, refers = (b.column(c).to_pylist() for c in ("page_id", "url", "digest", "refers_to"))
            html = b.column("html").cast(pa.binary())
            for i, payload in enumerate(html):
                held.append(page_record(ids[i], urls[i], payload.as_py(), digests[i], refers[i]))
                size, last = size + len(held[-1]), digests[i]
                if size >= archive_bytes:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()
    return with_revisits(pages, **options).mapInArrow(run, _ARCHIVE)


def read(archives: DataFrame, payloads: bool = True, strict: bool = True) -> DataFrame:
    """One row per response or revisit of the archives (path, content)."""
    def rows(path: str, content: bytes) -> Iterator[tuple]:
        try:
            for data in frames(content):
                fields, block = parse(data)
                if fields["warc-type"] in ("response", "revisit"):
                    page = page_of(fields, block)
                    yield (path, *(page if payloads else (*page[:2], None, *page[3:])), None)
        except ValueError as why:
            if strict:
                raise ValueError(f"{path}: {why}") from why
            yield (path, *[None] * 7, str(why))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column("path"), b.column("content"), strict=True):
                found, size = [], 0
                for row in rows(path.as_py(), content.as_py()):
                    found.append(row)
                    size += len(row[3] or b"")
                    if size > 1 << 23 or len(found) >= 5000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), _RECORD_ARROW)], schema=_RECORD_ARROW)
                        found, size = [], 0
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), _RECORD_ARROW)], schema=_RECORD_ARROW)
    return archives.select("path", "content").mapInArrow(run, _RECORD)
