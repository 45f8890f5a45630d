"""WARC archives in seekable Zstandard bundles.

Records of a bundle are grouped into independent Zstandard frames; a skippable frame at the end holds the
seek table of the public seekable format (compressed and decompressed size of every frame, then its
footer). The index maps a record's identifier to (bundle, frame, offset in the decompressed frame, length),
so one record is read by decompressing one frame.

A bundle is an archive file of bounded size. It travels as a row (bundle, data, records), so that Spark's own writers
and readers carry it to and from any store, and their commit protocol covers lost executors; ``export`` writes the
rows' data as files of a folder that all executors share. Every reader starts from the footer: it finds a frame by
the seek table and a record by the index, see ``SeekableReader``.

A revisit has no payload. It names the response's record and digest, and its size comes from that response
(``resolved``). Pages have no time of capture, so WARC-Date is the time of writing unless it is given.

Defined results: a null html is an empty payload; of equal payloads every row with the smallest page_id is
a response and the others revisit it; a null page_id comes after all others, and is a response only where
its payload has no other page; repeated rows each get a record, whose identifiers are told apart by a number within
a bundle; extra columns are ignored; an empty table gives no bundle.
"""

from __future__ import annotations

import base64
import hashlib
import io
import os
import struct
from collections import Counter
from datetime import datetime, timezone

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, materialize

FRAME_BYTES = 256 << 10
BUNDLE_BYTES = 8 << 20
LEVEL = 3

# Fixed values of the public Zstandard seekable format: skippable frame's magic number, footer's magic number.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1

BUNDLES = "bundle string, data binary, records array<struct<id:string,page_id:bigint,frame:int,start:bigint,length:bigint>>"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """frames: compressed and decompressed size of each."""
    body = b"".join(struct.pack("<II", *x) for x in frames) + struct.pack("<IBI", len(frames), 0, SEEKABLE_MAGIC)
    return struct.pack("<II", SKIPPABLE_MAGIC, len(body)) + body


class SeekableReader:
    """Random access to a bundle by its seek table; ``file`` is any seekable binary file."""

    def __init__(self, file):
        self.file = file
        file.seek(-9, io.SEEK_END)
        n, flags, magic = struct.unpack("<IBI", file.read(9))
        if magic != SEEKABLE_MAGIC:
            raise ValueError("no seek table")
        width = 12 if flags & 128 else 8
        file.seek(-9 - n * width, io.SEEK_END)
        self.at, self.sizes = [0], []
        for _ in range(n):
            packed, size = struct.unpack_from("<II", file.read(width))
            self.at.append(self.at[-1] + packed)
            self.sizes.append(size)

    def frame(self, k: int) -> bytes:
        self.file.seek(self.at[k])
        data = zstandard.ZstdDecompressor().decompress(self.file.read(self.at[k + 1] - self.at[k]), max_output_size=self.sizes[k])
        if len(data) != self.sizes[k]:
            raise ValueError(f"frame {k} has {len(data)} bytes, not {self.sizes[k]}")
        return data

    def record(self, frame: int, start: int, length: int) -> bytes:
        return self.frame(frame)[start : start + length]


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_name(page_id, again: int = 0) -> str:
    return f"urn:page:{'null' if page_id is None else page_id}" + (f":{again}" if again else "")


def record_bytes(name: str, url, payload: bytes, digest: str, refers_to, date: str) -> bytes:
    """One WARC/1.1 record; a revisit has an empty block and names the record it revisits."""
    block = b""
    if refers_to is None:
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    fields = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{name}>", f"WARC-Date: {date}"]
    if url is not None:
        fields.append("WARC-Target-URI: " + " ".join(url.split()))
    if refers_to is not None:
        fields += [f"WARC-Refers-To: <{record_name(refers_to)}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    fields += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(fields).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_records(data: bytes):
    """Header fields and block of every record in a decompressed frame."""
    at = 0
    while at < len(data):
        stop = data.index(b"\r\n\r\n", at)
        lines = data[at:stop].decode().split("\r\n")
        fields = dict(x.split(": ", 1) for x in lines[1:])
        size = int(fields["Content-Length"])
        yield fields, data[stop + 4 : stop + 4 + size]
        at = stop + 4 + size + 4


def link_revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """pages with ``refers_to``: for equal payloads of at least ``least_bytes`` bytes the smallest page_id, null on responses.

    Only digests and ids are grouped; the partial aggregate keeps one row of a payload for each task. The
    page texts move once, to meet ``refers_to``.
    """
    bound_batches(pages.sparkSession)
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    thin = pages.select("page_id", F.sha1(F.encode("html", "UTF-8")).alias("sha"), F.octet_length("html").alias("size"))
    groups = thin.where(F.col("size") >= least_bytes).groupBy("sha").agg(F.min("page_id").alias("leader"), F.count(F.lit(1)).alias("n")).where("n > 1 and leader is not null")
    revisits = (
        thin.where(F.col("size") >= least_bytes)
        .join(groups.select("sha", "leader"), "sha")
        .where("page_id is null or page_id <> leader")
        .select(F.col("page_id").alias("of"), F.col("sha").alias("of_sha"), "leader")
        .distinct()
    )
    joined = pages.withColumn("sha", F.sha1(F.encode("html", "UTF-8"))).join(revisits, F.col("page_id").eqNullSafe(F.col("of")) & (F.col("sha") == F.col("of_sha")), "left")
    return joined.select("page_id", "url", "html", F.col("leader").alias("refers_to"))


def write_bundles(linked: DataFrame, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES, level: int = LEVEL, date: str | None = None) -> DataFrame:
    """linked: page_id, url, html, refers_to. One row for each bundle, see BUNDLES; a task starts a bundle anew at ``bundle_bytes``."""
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")

    def write(batches):
        from pyspark import TaskContext

        pack = zstandard.ZstdCompressor(level=level, write_checksum=True)
        part, serial = TaskContext.get().partitionId(), 0
        frames, sizes, records, names = [], [], [], Counter()
        frame, size = [], 0

        def flush():
            nonlocal frame, size
            frames.append(pack.compress(b"".join(frame)))
            sizes.append((len(frames[-1]), size))
            frame, size = [], 0

        def bundle():
            nonlocal frames, sizes, records, names, serial
            out = pa.RecordBatch.from_pylist([{"bundle": f"part-{part:06d}-{serial:06d}", "data": b"".join([*frames, seek_table(sizes)]), "records": records}], schema)
            frames, sizes, records, names, serial = [], [], [], Counter(), serial + 1
            return out

        for batch in batches:
            for x in batch.to_pylist():
                payload = x["html"].encode()
                name = record_name(x["page_id"], names[x["page_id"]])
                names[x["page_id"]] += 1
                data = record_bytes(name, x["url"], payload, digest32(payload), x["refers_to"], date)
                records.append({"id": name, "page_id": x["page_id"], "frame": len(sizes), "start": size, "length": len(data)})
                frame.append(data)
                size += len(data)
                if size >= frame_bytes:
                    flush()
                    if sum(a for a, _ in sizes) >= bundle_bytes:
                        yield bundle()
        if frame:
            flush()
        if frames:
            yield bundle()

    schema = pa.schema([("bundle", pa.string()), ("data", pa.binary()), ("records", pa.list_(pa.struct([("id", pa.string()), ("page_id", pa.int64()), ("frame", pa.int32()), ("start", pa.int64()), ("length", pa.int64())])))])
    return linked.mapInArrow(write, BUNDLES)


def record_index(bundles: DataFrame) -> DataFrame:
    """id, page_id, bundle, frame, start, length of every record."""
    return bundles.select("bundle", F.explode("records").alias("r")).select("r.id", "r.page_id", "bundle", "r.frame", "r.start", "r.length")


def assemble(bundles: DataFrame, bundle: str) -> bytes:
    """The archive file of one bundle, whose size the writer bounds."""
    return bytes(bundles.where(F.col("bundle") == bundle).select("data").first().data)


def export(bundles: DataFrame, folder: str) -> DataFrame:
    """Writes every bundle as ``bundle.warc.zst`` in a folder that all executors have; bundle, bytes of each. A task that runs again writes the same files."""

    def run(batches):
        os.makedirs(folder, exist_ok=True)
        for batch in batches:
            sizes = []
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                path = os.path.join(folder, f"{name}.warc.zst")
                with open(f"{path}.{os.getpid()}", "wb") as f:
                    sizes.append(f.write(data.as_py()))
                os.replace(f.name, path)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], ["bundle", "bytes"])

    return bundles.select("bundle", "data").mapInArrow(run, "bundle string, bytes long")


def _row(piece: bytes, name: str, with_payload: bool) -> dict:
    """What a record says; its payload's size and digest come from its bytes on responses."""
    found = list(parse_records(piece)) if piece[:5] == b"WARC/" else []
    if len(found) != 1 or found[0][0]["WARC-Record-ID"] != f"<{name}>":
        raise ValueError(f"no record {name} where the index has it")
    fields, block = found[0]
    page = lambda x: None if x == "null" else int(x)
    out = {"page_id": page(name.split(":")[2]), "url": fields.get("WARC-Target-URI"), "payload_bytes": None, "payload_digest": fields["WARC-Payload-Digest"][5:], "record_type": fields["WARC-Type"], "refers_to": None, "payload": None}
    if out["record_type"] == "revisit":
        return out | {"refers_to": page(fields["WARC-Refers-To"][1:-1].split(":")[2])}
    payload = block[block.index(b"\r\n\r\n") + 4 :]
    if digest32(payload) != out["payload_digest"]:
        raise ValueError(f"the payload of {name} is not the one that was written")
    return out | {"payload_bytes": len(payload), "payload": payload if with_payload else None}


def read_bundles(bundles: DataFrame, with_payload: bool = False, only: list[str] | None = None) -> DataFrame:
    """The records read back, one row each: a frame by the bundle's seek table, a record by the place that the index names.

    One that is not the record named there, bytes of a frame that the index doesn't cover, and frames without records
    are errors. With ``only``, just the records of these identifiers are read, and no frames without one.
    """
    wanted = None if only is None else frozenset(only)

    def read(batches):
        for batch in batches:
            for data, index in zip(batch.column(0), batch.column(1), strict=True):
                reader, by_frame = SeekableReader(io.BytesIO(data.as_py())), {}
                for place in index.as_py():
                    if wanted is None or place["id"] in wanted:
                        by_frame.setdefault(place["frame"], []).append(place)
                if wanted is None and sorted(by_frame) != list(range(len(reader.sizes))):
                    raise ValueError("frames that are not in the index")
                for k, places in by_frame.items():
                    frame, rows, at = reader.frame(k), [], 0
                    for place in places:
                        if wanted is None and place["start"] != at:
                            raise ValueError(f"no record {place['id']} at {place['start']}")
                        piece = frame[place["start"] : place["start"] + place["length"]]
                        at = place["start"] + len(piece)
                        rows.append(_row(piece, place["id"], with_payload))
                    if wanted is None and at != len(frame):
                        raise ValueError(f"{len(frame) - at} bytes of a frame are not in the index")
                    yield pa.RecordBatch.from_pylist(rows, schema)

    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
    if only is not None:
        bundles = bundles.where(F.exists("records", lambda r: r["id"].isin(*only)))
    out = bundles.select("data", "records").mapInArrow(read, RECORDS)
    return out if with_payload else out.drop("payload")


def resolved(records: DataFrame) -> DataFrame:
    """records with the size of a revisit's payload, which the response that it names has; a revisit without one is an error."""
    responses = records.where("record_type = 'response'").groupBy(F.col("page_id").alias("__of"), F.col("payload_digest").alias("__digest")).agg(F.max("payload_bytes").alias("__bytes"))
    joined = records.join(responses, (F.col("refers_to") == F.col("__of")) & (F.col("payload_digest") == F.col("__digest")), "left")
    lost = F.raise_error(F.concat(F.lit("no response "), F.col("refers_to").cast("string"))).cast("long")
    return joined.withColumn("payload_bytes", F.coalesce("payload_bytes", "__bytes", lost)).drop("__of", "__digest", "__bytes")


def archive_round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Writes the archives to the shared folder and returns their records as read back."""
    bundles = materialize(write_bundles(link_revisits(pages, least_bytes)), "warc")
    return resolved(materialize(read_bundles(bundles), "records"))
