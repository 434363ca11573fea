"""Operator 7, WARC records in seekable Zstandard bundles.

Records fill frames that decompress on their own. A bundle is a run of frames and, as a
skippable frame at its end, the seek table of the public seekable format: compressed and
plain size of every frame, their number, a descriptor byte and a magic number. The index
maps a record's identifier to its frame and its offset in that frame's plain bytes.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard as zstd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ._common import in_slices, type_of

SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
SPACE = uuid.UUID("8d0f6c52-6a3c-5c7e-9c1e-3f0d1f6f2a10")


@dataclass(frozen=True)
class WarcParams:
    #: Plain bytes after which a frame, and a bundle, closes. A longer record fills a frame of its own.
    frame_bytes: int = 128 * 1024
    bundle_bytes: int = 8 * 1024 * 1024
    level: int = 3
    #: Date of records whose table has no column of dates, and the software named in ``warcinfo``.
    date: str = "2024-01-01T00:00:00Z"
    software: str = "pagewright"


def record_id(page_id: int | None, url: str | None, html: str | None) -> str:
    """Equal rows have equal identifiers, whatever task writes them."""
    return f"urn:uuid:{uuid.uuid5(SPACE, repr((page_id, url, html)))}"


def record(identifier: str, url: str | None, html: str | None, date: str) -> bytes:
    """A ``resource`` record; null texts give no target line and an empty block."""
    block = (html or "").encode("utf-8", "replace")
    digest = base64.b32encode(hashlib.sha1(block).digest()).decode()
    lines = ["WARC/1.1", "WARC-Type: resource", f"WARC-Record-ID: <{identifier}>", f"WARC-Date: {date}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + " ".join(url.split()))
    lines += [f"WARC-Block-Digest: sha1:{digest}", "Content-Type: text/html; charset=utf-8", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n"


def info(bundle_id: str, params: WarcParams) -> bytes:
    """The ``warcinfo`` record that opens a bundle."""
    block = f"software: {params.software}\r\nformat: WARC File Format 1.1\r\n".encode()
    lines = ["WARC/1.1", "WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(SPACE, bundle_id)}>", f"WARC-Date: {params.date}", f"WARC-Filename: {bundle_id}.warc.zst", "Content-Type: application/warc-fields", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    body = b"".join(struct.pack("<II", c, d) for c, d in frames) + struct.pack("<IBI", len(frames), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def read_seek_table(bundle: bytes) -> list[tuple[int, int, int]]:
    """(offset, compressed size, plain size) of each frame, from the footer alone."""
    count, descriptor, magic = struct.unpack("<IBI", bundle[-9:])
    if magic != SEEKABLE or descriptor & 0x80:
        raise ValueError("no seek table without checksums at the end")
    out, at = [], 0
    for c, d in struct.iter_unpack("<II", bundle[-9 - 8 * count : -9]):
        out.append((at, c, d))
        at += c
    return out


def read_record(bundle: bytes, frame: int, offset: int, length: int) -> bytes:
    """One record; only its own frame is decompressed."""
    at, compressed, plain = read_seek_table(bundle)[frame]
    return zstd.ZstdDecompressor().decompress(bundle[at : at + compressed], max_output_size=plain)[offset : offset + length]


def bundles(pages: DataFrame, params: WarcParams = WarcParams(), page_id: str = "page_id", url: str = "url", html: str = "html", date: str | None = None) -> DataFrame:
    """One row a bundle: its bytes and the index of its records.

    Every task bundles what it reads, so nothing is shuffled; a task that runs again
    gives the same bundles. A bundle opens with a ``warcinfo`` record, which the index
    leaves out. Repeated rows keep a record each, under one identifier. Nulls are allowed
    in every column; a null ``date`` becomes the parameters' one. A record longer than a
    frame fills one alone. An empty table gives no bundle. Other columns are ignored, so
    their names can't clash; the id keeps its type.
    """
    id_ddl = type_of(pages, page_id)
    id_kind = to_arrow_type(pages.select(F.col(page_id)).schema[0].dataType)
    entry = pa.struct([("record_id", pa.string()), ("page_id", id_kind), ("frame", pa.int32()), ("offset", pa.int64()), ("length", pa.int64())])
    names = ["bundle_id", "n_frames", "n_records", "plain_bytes", "data", "records"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstd.ZstdCompressor(level=params.level, write_content_size=True)
        part, made = TaskContext.get().partitionId(), 0
        data, frames, index, plain = bytearray(), [], [], 0
        open_frame = bytearray(info(f"{part:06d}-{made:06d}", params))

        def close_frame() -> None:
            nonlocal open_frame, plain
            if open_frame:
                packed = packer.compress(bytes(open_frame))
                data.extend(packed)
                frames.append((len(packed), len(open_frame)))
                plain += len(open_frame)
                open_frame = bytearray()

        def close_bundle() -> pa.RecordBatch:
            nonlocal data, frames, index, plain, made, open_frame
            row = [f"{part:06d}-{made:06d}", len(frames), len(index), plain, bytes(data) + seek_table(frames), index]
            made += 1
            data, frames, index, plain = bytearray(), [], [], 0
            open_frame.extend(info(f"{part:06d}-{made:06d}", params))
            kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.list_(entry)]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names=names)

        for batch in in_slices(batches, 500):
            for p, u, h, d in zip(*(batch.column(k).to_pylist() for k in range(4))):
                identifier = record_id(p, u, h)
                raw = record(identifier, u, h, d or params.date)
                if open_frame and len(open_frame) + len(raw) > params.frame_bytes:
                    close_frame()
                    if plain >= params.bundle_bytes:
                        yield close_bundle()
                index.append({"record_id": identifier, "page_id": p, "frame": len(frames), "offset": len(open_frame), "length": len(raw)})
                open_frame.extend(raw)
        if index:
            close_frame()
            yield close_bundle()

    narrow = pages.select(F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html"), (F.col(date) if date else F.lit(None)).cast("string").alias("date"))
    return narrow.mapInArrow(run, f"bundle_id string, n_frames int, n_records long, plain_bytes long, data binary, records array<struct<record_id:string,page_id:{id_ddl},frame:int,offset:long,length:long>>")


def index(bundled: DataFrame) -> DataFrame:
    """(record_id, page_id, bundle_id, frame, offset, length) of every record."""
    return bundled.select("bundle_id", F.explode("records").alias("r")).select("r.record_id", "r.page_id", "bundle_id", "r.frame", "r.offset", "r.length")


def lookup(bundled: DataFrame, wanted: DataFrame) -> DataFrame:
    """(record_id, page_id, record) of each wanted ``record_id`` that a bundle holds.

    Identifiers meet the index by a join; then only bundles with hits are read, and of
    these only the frames with hits are decompressed, on the executors. Repeated and null
    identifiers in ``wanted`` count once and not at all; repeated records are all given.
    """
    hits = index(bundled).join(wanted.select("record_id").distinct(), "record_id").groupBy("bundle_id").agg(F.collect_list(F.struct("record_id", "page_id", "frame", "offset", "length")).alias("hits"))
    id_ddl = hits.schema["hits"].dataType.elementType["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches, 16):
            kind = batch.column(1).type.value_type.field("page_id").type
            for data, found in zip(batch.column(0), batch.column(1).to_pylist()):
                raw, frames, opened = data.as_py(), read_seek_table(data.as_py()), {}
                out = []
                for h in sorted(found, key=lambda h: (h["frame"], h["offset"])):
                    if h["frame"] not in opened:
                        at, compressed, plain = frames[h["frame"]]
                        opened = {h["frame"]: zstd.ZstdDecompressor().decompress(raw[at : at + compressed], max_output_size=plain)}
                    out.append(opened[h["frame"]][h["offset"] : h["offset"] + h["length"]])
                order = sorted(range(len(found)), key=lambda k: (found[k]["frame"], found[k]["offset"]))
                yield pa.RecordBatch.from_arrays([pa.array([found[k]["record_id"] for k in order], pa.string()), pa.array([found[k]["page_id"] for k in order], kind), pa.array(out, pa.binary())], names=["record_id", "page_id", "record"])

    return bundled.select("bundle_id", "data").join(hits, "bundle_id").select("data", "hits").mapInArrow(run, f"record_id string, page_id {id_ddl}, record binary")
