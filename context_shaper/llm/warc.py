"""WARC archives in seekable Zstandard bundles.

Method: records are grouped into frames that can be decompressed on their own, each bundle ends with
a seek table in a skippable frame, and an index maps every record to its frame and to its offset in
the decompressed frame.  One record is read by fetching one frame.

A bundle has a name of its own for every task attempt, and the index is the output of those same
attempts: once it is committed, it names only bundles that were written whole.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, functions as F

from context_shaper.llm.tokens import small_batches
from context_shaper.session import new_shared_path, stage

# The published seekable format's numbers, and the revisit profile.
SKIPPABLE_MAGIC, SEEKABLE_MAGIC = 0x184D2A5E, 0x8F92EAB1
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

INDEX = (
    "page_id bigint, bundle string, frame int, frame_offset bigint, frame_bytes bigint, "
    "record_offset bigint, record_bytes bigint"
)
RECORD = (
    "page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, "
    "payload_digest string, payload binary"
)


@dataclass(frozen=True)
class Bundles:
    """Payloads of ``least_shared`` bytes and more are stored once.  A frame is closed at
    ``frame_bytes`` and a bundle at ``bundle_bytes``, both of uncompressed records."""

    least_shared: int = 1000
    frame_bytes: int = 1 << 20
    bundle_bytes: int = 1 << 28
    level: int = 3
    date: str = "1970-01-01T00:00:00Z"


class _Writer:
    """One bundle: frames, then the seek table."""

    def __init__(self, folder: str, options: Bundles):
        self.system, path = fs.FileSystem.from_uri(folder)
        self.system.create_dir(path, recursive=True)
        self.name = f"bundle-{uuid.uuid4().hex}.warc.zst"
        self.out = self.system.open_output_stream(f"{path}/{self.name}", compression=None)
        self.compressor = zstandard.ZstdCompressor(level=options.level)
        self.offset, self.frames = 0, []

    def frame(self, content: bytes) -> tuple[int, int, int]:
        packed = self.compressor.compress(content)
        self.out.write(packed)
        place = (len(self.frames), self.offset, len(packed))
        self.frames.append((len(packed), len(content)))
        self.offset += len(packed)
        return place

    def close(self) -> None:
        table = b"".join(struct.pack("<II", packed, plain) for packed, plain in self.frames)
        table += struct.pack("<IBI", len(self.frames), 0, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(table)) + table)
        self.out.close()


def seek_table(content: bytes) -> list[tuple[int, int]]:
    """(compressed, decompressed) bytes of each frame, from the end of a bundle."""
    count, _, magic = struct.unpack("<IBI", content[-9:])
    if magic != SEEKABLE_MAGIC:
        raise ValueError("not a seekable bundle")
    table = content[-9 - 8 * count : -9]
    return [struct.unpack_from("<II", table, 8 * i) for i in range(count)]


def _name(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _page(name: str | None) -> int | None:
    number = name[len("<urn:page:") : -1] if name else ""
    return int(number) if number else None


def _header_value(text: str) -> str:
    return "".join(f"%{ord(c):02X}" if ord(c) < 33 or ord(c) == 127 else c for c in text)


def warc_record(page_id, url, payload: bytes | None, size: int, digest: str, refers_to, date: str) -> bytes:
    """A response record with its payload, or a revisit record without."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload or b"") if refers_to is None else http
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_name(page_id)}",
             f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{digest}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_header_value(url)}")
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {_name(refers_to)}", f"WARC-Profile: {REVISIT_PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(record: bytes) -> dict:
    """The fields of RECORD; a response's size and digest are computed from its payload."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    revisit = fields["WARC-Type"] == "revisit"
    stated = dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])
    return {
        "page_id": _page(fields["WARC-Record-ID"]), "url": fields.get("WARC-Target-URI"), "record_type": fields["WARC-Type"],
        "refers_to": _page(fields.get("WARC-Refers-To")),
        "payload_bytes": int(stated["Content-Length"]) if revisit else len(payload),
        "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha1:") if revisit else hashlib.sha1(payload).hexdigest(),
        "payload": None if revisit else payload,
    }


def _write(folder: str, options: Bundles):
    names = [part.split()[0] for part in INDEX.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, held, size, total = None, [], 0, 0

        def flush() -> pa.RecordBatch:
            frame, offset, packed = writer.frame(b"".join(record for _, record in held))
            rows, at = [], 0
            for page_id, record in held:
                rows.append((page_id, writer.name, frame, offset, packed, at, len(record)))
                at += len(record)
            held.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(column, kind) for column, kind in zip(
                    zip(*rows), (pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()))],
                names=names,
            )

        for batch in batches:
            columns = batch.to_pydict()
            for page_id, url, html, bytes_, digest, refers_to in zip(*columns.values()):
                payload = None if html is None else html.encode()
                record = warc_record(page_id, url, payload, bytes_, digest, refers_to, options.date)
                writer = writer or _Writer(folder, options)
                held.append((page_id, record))
                size, total = size + len(record), total + len(record)
                if size >= options.frame_bytes:
                    yield flush()
                    size = 0
                if total >= options.bundle_bytes:
                    if held:
                        yield flush()
                    writer.close()
                    writer, size, total = None, 0, 0
        if writer:
            if held:
                yield flush()
            writer.close()

    return run


def write_archives(pages: DataFrame, folder: str, options: Bundles = Bundles()) -> DataFrame:
    """Write a record for every row of pages(page_id, url, html, ...) into bundles under ``folder``,
    and return the index (see INDEX), which the caller keeps as a table.

    A null html is an empty payload, a null url leaves its header out.  Of equal payloads of at
    least ``least_shared`` bytes the largest page_id holds the response and the others revisit it;
    rows that repeat that page_id, and payloads whose rows all lack a page_id, are all responses.
    Other columns are ignored; an empty table writes no bundle.  Payloads are not shuffled unless
    very many are shared.
    """
    small_batches(pages.sparkSession)
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"),
        F.octet_length(html).cast("bigint").alias("bytes"), F.sha1(html).alias("digest"),
    )
    shared = stage(
        rows.filter(F.col("bytes") >= options.least_shared).groupBy("digest", "bytes")
        .agg(F.max("page_id").alias("holder"), F.min("page_id").alias("least"), F.count("page_id").alias("n"), F.count("*").alias("all"))
        .filter("least < holder OR (n > 0 AND n < all)").select("digest", "bytes", "holder"), "shared",
    )
    decided = rows.join(shared, ["digest", "bytes"], "left").withColumn(
        "refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("holder")), F.col("holder"))
    )
    records = decided.select(
        "page_id", "url", F.when(F.col("refers_to").isNull(), F.col("html")).alias("html"), "bytes", "digest", "refers_to"
    )
    return stage(records.mapInArrow(_write(folder, options), INDEX), "warc-index")


def _read(folder: str):
    kinds = {"page_id": pa.int64(), "url": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(),
             "payload_bytes": pa.int64(), "payload_digest": pa.string(), "payload": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = fs.FileSystem.from_uri(folder)
        plain, at = zstandard.ZstdDecompressor(), None
        content = b""
        for batch in batches:
            records = []
            for row in batch.to_pylist():
                place = (row["bundle"], row["frame_offset"])
                if place != at:
                    with system.open_input_file(f"{path}/{row['bundle']}") as source:
                        source.seek(row["frame_offset"])
                        content, at = plain.decompress(source.read(row["frame_bytes"])), place
                records.append(parse_record(content[row["record_offset"] : row["record_offset"] + row["record_bytes"]]))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[name] for r in records], kind) for name, kind in kinds.items()], names=list(kinds)
            )

    return run


def read_archives(index: DataFrame, folder: str) -> DataFrame:
    """The records (see RECORD) that rows of an index name: all of them, or any that a filter picks."""
    small_batches(index.sparkSession)
    return index.mapInArrow(_read(folder), RECORD)


def archive_round_trip(pages: DataFrame, options: Bundles = Bundles()) -> DataFrame:
    """Write pages into a new shared folder and read every record back."""
    folder = new_shared_path(pages.sparkSession, "warc")
    return read_archives(write_archives(pages, folder, options), folder)
