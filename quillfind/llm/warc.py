"""WARC archives as seekable Zstandard bundles.

Records are grouped into frames of bounded size; every frame is compressed on its own, and a skippable frame at the
file's end holds the seek table (compressed and decompressed size of each frame), so that a reader can jump to any
frame. The index maps a record's id to (bundle, frame, offset within the decompressed frame, length).

A page whose payload equals that of a page with a smaller id is written as a revisit record that refers to it, if the
payload has at least MIN_REVISIT bytes. Digests are grouped with a minimum (pre-aggregated, so a payload that a third
of all pages share is no burden) and only repeated digests are joined back: the few that many rows have by a broadcast
of bounded size, the others by a shuffle. A row is known by its page id and digest together, never by its id alone.

A bundle is written by one task under a name that its first task attempt and any later one share, and moved into
place when whole; frames never span tasks. Bundles hold whole pages in any order.

Defined results: null html is an empty payload; null urls are written as `urn:page:<id>`; an empty table gives no
bundle and no rows; rows with one id each give a record of their own: with different payloads by the rules above, with
equal ones as records alike (a third number in their record ids tells them apart). A row without an id is written and
read back with a null id; it can revisit others, and is never referred to. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import filesystem, fresh_folder, join_hot, session, stored, write_file

MIN_REVISIT = 100
FRAME_BYTES, BUNDLE_BYTES = 1 << 20, 64 << 20
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
INDEX = "page_id long, record_id string, bundle string, frame int, offset long, length long"


def with_types(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", url_col: str = "url") -> DataFrame:
    """page_id, url, payload (binary), digest, record_type and refers_to of every page, with rows of one page id and
    digest next to each other (column `row key`)."""
    url = F.col(url_col).cast("string") if url_col in pages.columns else F.lit(None).cast("string")
    p = pages.select(F.col(id_col).cast("long").alias("page_id"), url.alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary").alias("payload"))
    p = p.withColumn("digest", F.unhex(F.sha2("payload", 256))).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    p = p.withColumn("row key", F.concat_ws(":", F.coalesce(F.col("page_id").cast("string"), F.lit("none")), F.hex("digest")))
    long = p.filter(F.col("payload_bytes") >= MIN_REVISIT).select("page_id", "digest", "row key")
    first = long.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1 and first is not null")
    # Small rows only take part in the join by digest; payloads move by row key, which is not skewed.
    later = join_hot(long, first, "digest", "n").filter(~F.col("page_id").eqNullSafe(F.col("first"))).select("row key", F.col("first").alias("refers_to")).distinct()
    out = p.repartition("row key").join(later.hint("merge"), "row key", "left").sortWithinPartitions("row key")
    return out.withColumn("record_type", F.when(F.col("refers_to").isNull(), "response").otherwise("revisit"))


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, copy: int = 0, url_of: str = "urn:page:") -> bytes:
    """One WARC/1.1 record; `copy` numbers rows with one id and one payload. A revisit carries no payload; it names the record that has it, the digest and the size."""
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{record_id(page_id, digest, copy)}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {' '.join((url or f'{url_of}{none_or(page_id)}').split())}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Payload-Length: {len(payload)}",
        f"X-Page-ID: {none_or(page_id)}",
        "Content-Type: application/http;msgtype=response",
    ]
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    if refers_to is None:
        body += payload
    else:
        head += [f"WARC-Refers-To: <{record_id(refers_to, digest)}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head.append(f"Content-Length: {len(body)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def none_or(page_id: int | None) -> str:
    return "none" if page_id is None else str(page_id)


def record_id(page_id: int | None, digest: str, copy: int = 0) -> str:
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{none_or(page_id)}:{digest}:{copy}')}"


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """The skippable footer frame: (compressed, decompressed) sizes, their number, a descriptor byte and the magic."""
    body = b"".join(struct.pack("<II", *f) for f in frames) + struct.pack("<IBI", len(frames), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def read_seek_table(data: bytes) -> list[tuple[int, int, int]]:
    """(offset, compressed size, decompressed size) of every frame, from a bundle's last bytes or the whole bundle."""
    n, flags, magic = struct.unpack("<IBI", data[-9:])
    if magic != SEEKABLE:
        raise ValueError("no seek table at the end")
    width = 12 if flags & 0x80 else 8
    at, out = len(data) - 9 - n * width, []
    offset = 0
    for k in range(n):
        c, d = struct.unpack_from("<II", data, at + k * width)
        out.append((offset, c, d))
        offset += c
    return out


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """(headers, body, end) of the record that starts at `at`."""
    stop = data.index(b"\r\n\r\n", at)
    lines = data[at:stop].decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    head = dict(x.split(": ", 1) for x in lines[1:])
    body = stop + 4
    end = body + int(head["Content-Length"])
    return head, data[body:end], end + 4


class _Bundle:
    """Collects records into frames; hands out the finished file's bytes and the index rows."""

    def __init__(self, uri: str):
        import zstandard

        self.uri, self.compressor = uri, zstandard.ZstdCompressor(level=3)
        self.open, self.open_bytes, self.frames, self.parts, self.rows, self.bytes = [], 0, [], [], [], 0

    def add(self, page_id: int | None, name: str, data: bytes) -> None:
        self.rows.append((page_id, name, self.uri, len(self.frames), self.open_bytes, len(data)))
        self.open.append(data)
        self.open_bytes += len(data)
        if self.open_bytes >= FRAME_BYTES:
            self.flush()

    def flush(self) -> None:
        if self.open:
            frame = self.compressor.compress(b"".join(self.open))
            self.frames.append((len(frame), self.open_bytes))
            self.parts.append(frame)
            self.bytes += len(frame)
            self.open, self.open_bytes = [], 0

    def close(self) -> pa.RecordBatch:
        self.flush()
        write_file(self.uri, [*self.parts, seek_table(self.frames)])
        columns = list(zip(*self.rows))
        kinds = (pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64())
        return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], [x.split()[0] for x in INDEX.split(", ")])


def write(typed: DataFrame, folder: str) -> DataFrame:
    """Write all records to bundles below `folder` and return the index (stored, so nothing is written twice). Rows of
    one page id and digest have to stand next to each other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, k, bundle, last, copy = TaskContext.get().partitionId(), 0, None, None, 0
        for batch in batches:
            cols = [batch.column(i) for i in range(5)]
            for i in range(batch.num_rows):
                page_id, url, payload, digest, refers_to = (c[i].as_py() for c in cols)
                copy = copy + 1 if (page_id, digest) == last else 0
                last = page_id, digest
                bundle = bundle or _Bundle(f"{folder}/bundle-{part:05d}-{k:04d}.warc.zst")
                bundle.add(page_id, record_id(page_id, digest.hex(), copy), record(page_id, url, payload, digest.hex(), refers_to, copy))
                if bundle.bytes >= BUNDLE_BYTES:
                    yield bundle.close()
                    bundle, k = None, k + 1
        if bundle:
            yield bundle.close()

    return stored(typed.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(run, INDEX), "warc-index")


def read(index: DataFrame) -> DataFrame:
    """Read every bundle of the index back, frame by frame through its seek table, and parse its records: page_id,
    record_type, payload (null for revisits), the headers' digest, payload length and refers_to (page_id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        for batch in batches:
            for uri in batch.column(0).to_pylist():
                system, path = filesystem(uri)
                with system.open_input_file(path) as f:
                    size = f.size()
                    f.seek(size - 9)
                    n = struct.unpack("<I", f.read(4))[0]
                    f.seek(size - 17 - 8 * n)
                    table = read_seek_table(f.read(17 + 8 * n))
                    for offset, compressed, _ in table:
                        f.seek(offset)
                        data = zstandard.ZstdDecompressor().decompress(f.read(compressed))
                        yield _parsed(data)

    return index.select("bundle").distinct().mapInArrow(run, "page_id long, record_type string, payload binary, header_digest string, header_bytes long, refers_id string, record_id string")


def _parsed(data: bytes) -> pa.RecordBatch:
    rows, at = [], 0
    while at < len(data):
        head, body, at = parse(data, at)
        kind = head["WARC-Type"]
        payload = body[body.index(b"\r\n\r\n") + 4 :] if kind == "response" else None
        rows.append((None if head["X-Page-ID"] == "none" else int(head["X-Page-ID"]), kind, payload, head["WARC-Payload-Digest"].removeprefix("sha256:"), int(head["X-Payload-Length"]), head.get("WARC-Refers-To", "").strip("<>") or None, head["WARC-Record-ID"].strip("<>")))
    kinds = (pa.int64(), pa.string(), pa.binary(), pa.string(), pa.int64(), pa.string(), pa.string())
    names = ["page_id", "record_type", "payload", "header_digest", "header_bytes", "refers_id", "record_id"]
    return pa.record_batch([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


def read_record(row: dict) -> bytes:
    """Random access: the bytes of one record from its index row, by reading its one frame."""
    import zstandard

    system, path = filesystem(row["bundle"])
    with system.open_input_file(path) as f:
        size = f.size()
        f.seek(size - 9)
        n = struct.unpack("<I", f.read(4))[0]
        f.seek(size - 17 - 8 * n)
        offset, compressed, _ = read_seek_table(f.read(17 + 8 * n))[row["frame"]]
        f.seek(offset)
        data = zstandard.ZstdDecompressor().decompress(f.read(compressed))
    return data[row["offset"] : row["offset"] + row["length"]]


def archive(pages: DataFrame, folder: str | None = None, **columns) -> tuple[DataFrame, str]:
    """(index, folder) of the archive written from all pages."""
    spark = session(pages)
    folder = folder or fresh_folder(spark, "warc")
    return write(with_types(pages, **columns), folder), folder


def read_back(index: DataFrame) -> DataFrame:
    """One row per record as read from the archive. A response's digest and size are taken from its payload; a
    revisit's are those of the record that it names, found by its id."""
    got = stored(read(index).select("page_id", "record_id", "record_type", "refers_id", F.when(F.col("payload").isNotNull(), F.octet_length("payload").cast("long")).alias("payload_bytes"), F.when(F.col("payload").isNotNull(), F.sha2("payload", 256)).alias("payload_digest")), "warc-read")
    revisits = got.filter("record_type = 'revisit'").select("page_id", "record_type", "refers_id")
    wanted = revisits.groupBy("refers_id").agg(F.count("*").alias("n"))
    originals = got.filter("record_type = 'response'").dropDuplicates(["record_id"]).select(F.col("record_id").alias("refers_id"), F.col("page_id").alias("refers_to"), "payload_bytes", "payload_digest").join(wanted, "refers_id")
    out = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return got.filter("record_type = 'response'").withColumn("refers_to", F.lit(None).cast("long")).select(*out).unionByName(join_hot(revisits, originals, "refers_id", "n").select(*out))


def digest_of(html: str | None) -> str:
    return hashlib.sha256((html or "").encode()).hexdigest()
