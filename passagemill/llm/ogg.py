"""Media columns: Ogg containers written and read inside a column."""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_left
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .arrays import tidy_batches
from .common import read

# Payloads are padded to whole units of this many 8-bit samples.
UNIT = 576
# A packet holds up to four units; its lacing values do not divide 255, so packets run on over page ends.
PACKET = 4 * UNIT
RATE = 8000
HEAD, HEAD_SIZE = "<4sBBqIIIB", 27
CONTINUED, FIRST, LAST = 1, 2, 4
SOUND, NOTE = b"\x01pcm8", b"\x02note"
# Bytes with their bits in reverse: the container's checksum is the usual one over reversed bits.
MIRROR = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))
# Bytes of media that one output batch holds at most, one row at least.
BATCH_BYTES = 8 << 20


def checksum(page: bytes) -> int:
    """CRC-32 of a page whose checksum field is 0: polynomial 0x04c11db7, start 0, bits not mirrored."""
    mirrored = zlib.crc32(page.translate(MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(mirrored.to_bytes(4, "little").translate(MIRROR), "big")


def page(kind: int, granule: int, serial: int, number: int, lacing: bytes, body: bytes) -> bytes:
    """One page with its checksum."""
    rest = lacing + body
    blank = struct.pack(HEAD, b"OggS", 0, kind, granule, serial, number, 0, len(lacing)) + rest
    return blank[:22] + struct.pack("<I", checksum(blank)) + blank[26:]


def pages_of(packets: list[bytes], granules: list[int], serial: int, number: int) -> list[bytes]:
    """Pages of up to 255 lacing values; a page's granule position is that of the last packet that ends on it, or
    -1. The last page is marked."""
    lacing, ends = bytearray(), {}
    for packet, granule in zip(packets, granules):
        lacing += b"\xff" * (len(packet) // 255) + bytes([len(packet) % 255])
        ends[len(lacing) - 1] = granule
    body, found, at, last = b"".join(packets), [], 0, sorted(ends)
    for start in range(0, len(lacing), 255):
        part = bytes(lacing[start:start + 255])
        size = sum(part)
        newest = bisect_left(last, start + 255) - 1
        granule = ends[last[newest]] if newest >= 0 and last[newest] >= start else -1
        kind = (CONTINUED if start and lacing[start - 1] == 255 else 0) | (LAST if start + 255 >= len(lacing) else 0)
        found.append(page(kind, granule, serial, number, part, body[at:at + size]))
        at, number = at + size, number + 1
    return found


def encode(data: bytes) -> bytes:
    """Two interleaved logical streams: the padded bytes as 8-bit samples, and the length without padding."""
    padded = data + b"\xff" * (-len(data) % UNIT if data else UNIT)
    serial = zlib.crc32(padded) & 0xFFFFFFFE
    packets = [padded[i:i + PACKET] for i in range(0, len(padded), PACKET)]
    granules = [min(i + PACKET, len(padded)) for i in range(0, len(padded), PACKET)]
    sound = pages_of(packets, granules, serial, 1)
    note = pages_of([struct.pack("<Q", len(data))], [0], serial + 1, 1)
    heads = [page(FIRST, 0, s, 0, bytes([len(h)]), h)
             for s, h in ((serial, SOUND + struct.pack("<I", RATE)), (serial + 1, NOTE))]
    return b"".join([*heads, sound[0], *note, *sound[1:]])


def demultiplex(media: bytes) -> dict[int, dict]:
    """Logical streams by serial: packets, (packets so far, granule) at page ends, pages, and whether it is whole.

    Raises ValueError for a wrong capture pattern, checksum, page number, continuation or length.
    """
    streams: dict[int, dict] = {}
    at = 0
    while at < len(media):
        if len(media) - at < HEAD_SIZE:
            raise ValueError("a page header is cut")
        mark, version, kind, granule, serial, number, crc, count = struct.unpack_from(HEAD, media, at)
        if mark != b"OggS" or version:
            raise ValueError("no page begins here")
        lacing = media[at + HEAD_SIZE:at + HEAD_SIZE + count]
        end = at + HEAD_SIZE + count + sum(lacing)
        if len(lacing) < count or end > len(media):
            raise ValueError("a page is cut")
        if checksum(media[at:at + 22] + bytes(4) + media[at + 26:end]) != crc:
            raise ValueError("a page has a wrong checksum")
        stream = streams.get(serial)
        if stream is None:
            if not kind & FIRST:
                raise ValueError("a stream has no first page")
            stream = streams[serial] = {"packets": [], "open": None, "times": [], "pages": 0, "ended": False}
        if stream["ended"] or number != stream["pages"] or bool(kind & CONTINUED) != (stream["open"] is not None):
            raise ValueError("pages of a stream are missing or out of order")
        body, parts = at + HEAD_SIZE + count, stream["open"] or []
        for value in lacing:
            parts.append(media[body:body + value])
            body += value
            if value < 255:
                stream["packets"].append(b"".join(parts))
                parts = []
        stream["open"] = parts if count and lacing[-1] == 255 else None
        if granule != -1:
            stream["times"].append((len(stream["packets"]), granule))
        stream["pages"] += 1
        stream["ended"] = bool(kind & LAST)
        at = end
    if any(s["open"] is not None or not s["ended"] for s in streams.values()):
        raise ValueError("a stream has no last page")
    return streams


def decode(media: bytes) -> dict:
    """Payload, unpadded length and timing of a container that ``encode`` wrote."""
    kinds = defaultdict(list)
    for stream in demultiplex(media).values():
        kinds[stream["packets"][0][:5]].append(stream)
    (sound,), (note,) = kinds[SOUND], kinds[NOTE]
    rate = struct.unpack("<I", sound["packets"][0][5:9])[0]
    payload = b"".join(sound["packets"][1:])
    samples = sound["times"][-1][1]
    if samples != len(payload):
        raise ValueError("granule positions and packets disagree")
    return {"payload": payload, "n_bytes": struct.unpack("<Q", note["packets"][1])[0], "rate": rate,
            "streams": 2, "pages": sound["pages"] + note["pages"], "packets": len(sound["packets"]) - 1,
            "seconds": samples / rate, "page_seconds": [g / rate for _, g in sound["times"][1:]]}


def _batched(names: list[str], rows) -> pa.RecordBatch:
    held, size = [], 0
    for row, weight in rows:
        held.append(row)
        size += weight
        if size >= BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in held], t) for i, (_, t) in enumerate(names)],
                                             names=[n for n, _ in names])
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in held], t) for i, (_, t) in enumerate(names)],
                                         names=[n for n, _ in names])


def write_media(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, media): every row's text, null as empty, as an Ogg container in a binary column.

    Works row by row where the rows are; equal texts give equal bytes. Null keys and repeated rows stay.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            rows = ((k.as_py(), encode((t.as_py() or "").encode())) for k, t in zip(batch.column(0), batch.column(1)))
            arrow = [("key", batch.column(0).type), ("media", pa.binary())]
            yield from _batched(arrow, (((k, m), len(m)) for k, m in rows))

    return docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")).mapInArrow(
        tidy_batches(run), f"key {kind}, media binary").withColumnRenamed("key", key)


def read_media(media: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, media, n_bytes, payload, rate, streams, pages, packets, seconds, page_seconds) of every container.

    Checksums, page order and lengths are verified; a broken container fails the job. A null container gives nulls.
    """
    fields = [("n_bytes", pa.int64(), "long"), ("payload", pa.binary(), "binary"), ("rate", pa.int32(), "int"),
              ("streams", pa.int32(), "int"), ("pages", pa.int32(), "int"), ("packets", pa.int32(), "int"),
              ("seconds", pa.float64(), "double"), ("page_seconds", pa.list_(pa.float64()), "array<double>")]
    kind = media.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            arrow = [("key", batch.column(0).type), ("media", pa.binary())] + [(n, t) for n, t, _ in fields]

            def rows():
                for k, m in zip(batch.column(0), batch.column(1)):
                    data = m.as_py()
                    found = {} if data is None else decode(data)
                    yield (k.as_py(), data, *[found.get(n) for n, _, _ in fields]), 2 * len(data or b"")

            yield from _batched(arrow, rows())

    schema = f"key {kind}, media binary, " + ", ".join(f"{n} {s}" for n, _, s in fields)
    return media.select(F.col(f"`{key}`").alias("key"), F.col("media")).mapInArrow(tidy_batches(run), schema).withColumnRenamed(
        "key", key)


def stored_documents(spark, directory: str) -> DataFrame:
    """op6: digests of every document's container and of what is read back from it."""
    found = read_media(write_media(read(spark, directory, "documents", "doc_id", "text")))
    return found.select(
        "doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -32)")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"),
        F.format_string("streams=%d pages=%d packets=%d seconds=%.3f", "streams", "pages", "packets", "seconds")
        .alias("feature"))
