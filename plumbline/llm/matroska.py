"""Media columns: bytes to Matroska and back, and the packet table between.

``mux`` stores a payload as an 8-bit PCM track: clusters of blocks, each block lacing up to LACED frames, and cues. ``demux``
reads any Matroska file into a packet table: variable-length EBML elements, known and unknown sizes, clusters, simple
blocks and block groups, all four kinds of lacing, cues. Nothing in a file depends on anything but the payload.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Element identifiers of the Matroska specification.
EBML, SEGMENT, INFO, TRACKS, CUES, CLUSTER = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1C53BB6B, 0x1F43B675
DOCTYPE, DOCTYPE_VERSION, DOCTYPE_READ = 0x4282, 0x4287, 0x4285
TIMESTAMP_SCALE, DURATION, MUXING_APP, WRITING_APP = 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, FLAG_LACING, CODEC_ID, DEFAULT_DURATION, AUDIO = 0xAE, 0xD7, 0x73C5, 0x83, 0x9C, 0x86, 0x23E383, 0xE1
SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH = 0xB5, 0x9F, 0x6264
CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, BLOCK_DURATION, REFERENCE_BLOCK = 0xE7, 0xA3, 0xA0, 0xA1, 0x9B, 0xFB
#: What can stand directly in a segment; such an element ends a cluster of unknown size.
LEVEL_1 = {INFO, TRACKS, CUES, CLUSTER, 0x114D9B74, 0x1941A469, 0x1043A770, 0x1254C367}

RATE, FRAME, LACED, BLOCKS = 8000, 512, 8, 64  # samples a second, bytes a frame, frames a block, blocks a cluster
STEP = 1_000_000  # nanoseconds a tick
NO_LACING, XIPH, FIXED, EBML_LACING = range(4)


class Packet(NamedTuple):
    track: int
    timestamp: int
    offset: int
    size: int
    keyframe: bool
    lacing: int
    lace: int


class Media(NamedTuple):
    packets: list[Packet]
    tracks: dict[int, dict]
    cues: list[tuple[int, int, int]]  # timestamp, track, byte offset of the cluster
    scale: int


def vint(n: int, length: int = 0) -> bytes:
    """n as an EBML number of the given length, or the shortest; all ones is kept for an unknown size."""
    size = length or next(k for k in range(1, 9) if n < (1 << 7 * k) - 1)
    return (n | 1 << 7 * size).to_bytes(size, "big")


def ident(n: int) -> bytes:
    return n.to_bytes((n.bit_length() + 7) // 8, "big")


def element(which: int, body: bytes) -> bytes:
    return ident(which) + vint(len(body)) + body


def uint(which: int, n: int) -> bytes:
    return element(which, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def laced(sizes: list[int], kind: int) -> bytes:
    """The lace header of frames of these sizes; the last size is left to the reader."""
    out = bytes([len(sizes) - 1])
    if kind == XIPH:
        return out + b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    if kind == EBML_LACING:
        out += vint(sizes[0])
        for a, b in zip(sizes, sizes[1:-1]):
            n = b - a
            size = next(k for k in range(1, 9) if -(1 << 7 * k - 1) < n < (1 << 7 * k - 1))
            out += vint(n + (1 << 7 * size - 1) - 1, size)
    return out


_HEAD = element(EBML, element(DOCTYPE, b"matroska") + uint(DOCTYPE_VERSION, 4) + uint(DOCTYPE_READ, 2))
_TRACKS = element(
    TRACKS,
    element(
        TRACK_ENTRY,
        uint(TRACK_NUMBER, 1) + uint(TRACK_UID, 1) + uint(TRACK_TYPE, 2) + uint(FLAG_LACING, 1) + element(CODEC_ID, b"A_PCM/INT/LIT")
        + uint(DEFAULT_DURATION, FRAME * 1_000_000_000 // RATE)
        + element(AUDIO, element(SAMPLING_FREQUENCY, struct.pack(">d", RATE)) + uint(CHANNELS, 1) + uint(BIT_DEPTH, 8)),
    ),
)


def mux(payload: bytes) -> bytes:
    """A Matroska file of the payload's bytes as 8-bit samples."""
    info = element(INFO, uint(TIMESTAMP_SCALE, STEP) + element(DURATION, struct.pack(">d", len(payload) * 1000 / RATE)) + element(MUXING_APP, b"plumbline") + element(WRITING_APP, b"plumbline"))
    parts, cues, at = [info, _TRACKS], [], len(info) + len(_TRACKS)
    span = FRAME * LACED
    for lo in range(0, len(payload), span * BLOCKS):
        start = lo * 1000 // RATE
        inner = [uint(TIMESTAMP, start)]
        for b in range(lo, min(lo + span * BLOCKS, len(payload)), span):
            body = payload[b : b + span]
            sizes = [FRAME] * (len(body) // FRAME) + ([len(body) % FRAME] if len(body) % FRAME else [])
            kind = NO_LACING if len(sizes) == 1 else FIXED if sizes[-1] == FRAME else EBML_LACING
            head = b"\x81" + struct.pack(">hB", b * 1000 // RATE - start, 0x80 | kind << 1)
            inner.append(element(SIMPLE_BLOCK, head + (laced(sizes, kind) if kind else b"") + body))
        cluster = element(CLUSTER, b"".join(inner))
        cues.append(element(CUE_POINT, uint(CUE_TIME, start) + element(CUE_TRACK_POSITIONS, uint(CUE_TRACK, 1) + uint(CUE_CLUSTER_POSITION, at))))
        parts.append(cluster)
        at += len(cluster)
    parts.append(element(CUES, b"".join(cues)))
    return _HEAD + element(SEGMENT, b"".join(parts))


class Bad(ValueError):
    """The bytes are not a Matroska file, or one that is cut off."""


def _number(buf: bytes, at: int, keep: bool = False, end: int | None = None) -> tuple[int, int, int]:
    """(value, next position, length) of the EBML number at a position, before end; the value is -1 for an unknown size."""
    end = len(buf) if end is None else end
    if at >= end or not buf[at]:
        raise Bad(f"no number at {at}")
    size = 9 - buf[at].bit_length()
    if at + size > end:
        raise Bad(f"cut off at {at}")
    n = int.from_bytes(buf[at : at + size], "big")
    if keep:
        return n, at + size, size
    n ^= 1 << 7 * size
    return (-1 if n == (1 << 7 * size) - 1 else n), at + size, size


def elements(buf: bytes, at: int, end: int, stop: set[int] = frozenset()) -> Iterator[tuple[int, int, int]]:
    """(identifier, start and end of the body) of the elements from at to end. One of unknown size goes on to end; one in stop ends the walk."""
    while at < end:
        which, body, _ = _number(buf, at, keep=True)
        if which in stop:
            return
        n, body, _ = _number(buf, body)
        to = end if n < 0 else body + n
        if to > end:
            raise Bad(f"element {which:X} at {at} goes past {end}")
        yield which, body, (to if n >= 0 else -to)
        if n < 0:
            return
        at = to


def _int(buf: bytes, lo: int, hi: int) -> int:
    return int.from_bytes(buf[lo:hi], "big")


def frames(buf: bytes, lo: int, hi: int) -> tuple[int, int, int, int, list[tuple[int, int]]]:
    """(track, relative timestamp, flags, kind of lacing, (offset, size) of each frame) of a block's body."""
    track, at, _ = _number(buf, lo, end=hi)
    if at + 3 > hi:
        raise Bad(f"block at {lo} is cut off")
    relative, flags = struct.unpack_from(">hB", buf, at)
    at += 3
    kind = flags >> 1 & 3
    if kind == NO_LACING:
        return track, relative, flags, kind, [(at, hi - at)]
    if at >= hi:
        raise Bad(f"block at {lo} is cut off")
    count = buf[at] + 1
    at += 1
    sizes: list[int] = []
    if kind == FIXED:
        if (hi - at) % count:
            raise Bad(f"block at {lo}: frames of unequal size")
        sizes = [(hi - at) // count] * (count - 1)
    elif kind == XIPH:
        for _ in range(count - 1):
            n = next((i for i in range(at, hi) if buf[i] != 255), None)
            if n is None:
                raise Bad(f"block at {lo}: sizes go past its end")
            sizes.append((n - at) * 255 + buf[n])
            at = n + 1
    else:
        for k in range(count - 1):
            n, at, length = _number(buf, at, end=hi)
            if n < 0 and k:
                n = (1 << 7 * length) - 1  # all ones is a difference like any other
            sizes.append(n if not k else sizes[-1] + n - (1 << 7 * length - 1) + 1)
    sizes.append(hi - at - sum(sizes))
    if min(sizes) < 0:
        raise Bad(f"block at {lo}: frames go past its end")
    out = []
    for n in sizes:
        out.append((at, n))
        at += n
    return track, relative, flags, kind, out


def _track(buf: bytes, lo: int, hi: int) -> tuple[int, dict]:
    number, out = 0, {"codec": "", "type": 0, "rate": 0.0, "channels": 1, "bits": 0, "frame_ns": 0}
    for which, a, b in elements(buf, lo, hi):
        if which == TRACK_NUMBER:
            number = _int(buf, a, b)
        elif which == TRACK_TYPE:
            out["type"] = _int(buf, a, b)
        elif which == CODEC_ID:
            out["codec"] = buf[a:b].decode("ascii", "replace")
        elif which == DEFAULT_DURATION:
            out["frame_ns"] = _int(buf, a, b)
        elif which == AUDIO:
            for sub, x, y in elements(buf, a, b):
                if sub == SAMPLING_FREQUENCY:
                    out["rate"] = struct.unpack(">d" if y - x == 8 else ">f", buf[x:y])[0] if y - x in (4, 8) else 0.0
                elif sub == CHANNELS:
                    out["channels"] = _int(buf, x, y)
                elif sub == BIT_DEPTH:
                    out["bits"] = _int(buf, x, y)
    return number, out


def demux(buf: bytes) -> Media:
    """The packets of a file in the order they are stored. Unknown elements are passed over; bytes that aren't Matroska raise Bad."""
    packets: list[Packet] = []
    tracks: dict[int, dict] = {}
    cues: list[tuple[int, int, int]] = []
    scale = 1_000_000

    def block(lo: int, hi: int, base: int, simple: bool, key: bool) -> None:
        track, relative, flags, kind, found = frames(buf, lo, hi)
        step = tracks.get(track, {}).get("frame_ns", 0)
        for k, (at, n) in enumerate(found):
            packets.append(Packet(track, base + relative + k * step // scale, at, n, bool(flags & 0x80) if simple else key, kind, k))

    def cluster(lo: int, hi: int, open_end: bool) -> int:
        base, at = 0, lo
        for which, a, b in elements(buf, lo, hi, LEVEL_1 if open_end else frozenset()):
            at = abs(b)
            if which == TIMESTAMP:
                base = _int(buf, a, b)
            elif which == SIMPLE_BLOCK:
                block(a, b, base, True, True)
            elif which == BLOCK_GROUP:
                inner = list(elements(buf, a, b))
                key = all(x[0] != REFERENCE_BLOCK for x in inner)
                for sub, x, y in inner:
                    if sub == BLOCK:
                        block(x, y, base, False, key)
        return at

    def segment(lo: int, hi: int) -> None:
        nonlocal scale
        at = lo
        while at < hi:
            for which, a, b in elements(buf, at, hi):
                at = abs(b)
                if which == CLUSTER:
                    at = cluster(a, abs(b), b < 0)
                elif which == INFO:
                    for sub, x, y in elements(buf, a, b):
                        if sub == TIMESTAMP_SCALE:
                            scale = _int(buf, x, y) or scale
                elif which == TRACKS:
                    tracks.update(_track(buf, x, y) for sub, x, y in elements(buf, a, b) if sub == TRACK_ENTRY)
                elif which == CUES:
                    for sub, x, y in elements(buf, a, b):
                        if sub == CUE_POINT:
                            found = {s: (p, q) for s, p, q in elements(buf, x, y)}
                            time = _int(buf, *found[CUE_TIME]) if CUE_TIME in found else 0
                            spots = {s: _int(buf, p, q) for s, p, q in elements(buf, *found[CUE_TRACK_POSITIONS])} if CUE_TRACK_POSITIONS in found else {}
                            cues.append((time, spots.get(CUE_TRACK, 0), lo + spots.get(CUE_CLUSTER_POSITION, 0)))
                if b < 0:
                    break

    top = list(elements(buf, 0, len(buf)))
    if not top or top[0][0] != EBML:
        raise Bad("no EBML header")
    for which, a, b in top:
        if which == SEGMENT:
            segment(a, abs(b))
    return Media(packets, tracks, cues, scale)


def seek(media: Media, timestamp: int, track: int = 1) -> int:
    """Byte offset of the cluster from which playing at a timestamp starts, by the cues; -1 if there is none."""
    return max(((t, at) for t, n, at in media.cues if n == track and t <= timestamp), default=(0, -1))[1]


def padded(raw: bytes, unit: int = 64) -> bytes:
    """raw and zero bytes up to a positive multiple of unit."""
    return raw + bytes(-len(raw) % unit or (0 if raw else unit))


def feature(payload: np.ndarray, media: Media) -> str:
    """Packets, ticks played, mean, root mean square and sign changes about the middle of the 8-bit samples."""
    x = payload.astype(np.int16) - 128
    last = media.packets[-1] if media.packets else None
    ticks = last.timestamp + last.size * 1000 // RATE if last else 0
    wave = x.astype(np.float64)
    return f"{len(media.packets)} {ticks} {wave.mean():.4f} {np.sqrt((wave * wave).mean()):.4f} {int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))}"


def encode_texts(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, media): each whole text as UTF-8, padded and muxed. A null text is an empty one, of 64 zero bytes.

    Row by row: repeated rows give repeated rows, an empty table an empty one, and other columns aren't read.
    A file is one value, so a text has to stay under 2 GB.
    """
    kind = df.schema[key].dataType

    def run(batches):
        for batch in batches:
            raw = [x or b"" for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in raw], pa.int64()), pa.array([mux(padded(x)) for x in raw], pa.binary())], ["id", "n_bytes", "media"])

    source = df.select(F.col(key).alias("id"), F.encode(F.col(text), "UTF-8").alias("raw"))
    out = source.mapInArrow(run, f"id {kind.simpleString()}, n_bytes long, media binary")
    return out.withColumnRenamed("id", key)


def _packets(buf: bytes | None) -> list[tuple]:
    """The packets of a file with None for the error, or one row with the error alone."""
    try:
        return [(*p, None) for p in demux(buf).packets] if buf is not None else []
    except Bad as e:
        return [(*[None] * len(Packet._fields), str(e))]


def packet_table(df: DataFrame, key: str = "doc_id", media: str = "media") -> DataFrame:
    """(key, track, timestamp, offset, size, keyframe, lacing, lace, error): a row for each packet of each file, with no error.

    A file that isn't Matroska, or is cut off, has one row, with the error and nothing else. A null file has none. Files that repeat have their rows as often; an empty table gives
    an empty one; other columns aren't read.
    """
    kind = df.schema[key].dataType
    names = ["id", *Packet._fields, "error"]
    types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int32(), pa.string()]

    def run(batches):
        for batch in batches:
            for lo in range(0, len(batch), 256):
                part = batch.slice(lo, 256)
                found = [_packets(x) for x in part.column(1).to_pylist()]
                at = pa.array([i for i, x in enumerate(found) for _ in x], pa.int32())
                flat = [p for x in found for p in x]
                yield pa.RecordBatch.from_arrays([part.column(0).take(at), *[pa.array([p[k] for p in flat], t) for k, t in enumerate(types)]], names)

    out = df.select(F.col(key).alias("id"), F.col(media).alias("media")).mapInArrow(run, f"id {kind.simpleString()}, track int, timestamp long, offset long, size long, keyframe boolean, lacing int, lace int, error string")
    return out.withColumnRenamed("id", key)


def read_back(df: DataFrame, key: str = "doc_id") -> DataFrame:
    """What the packets of each file of encode_texts hold, put together again: digests, and a feature of the samples."""
    kind = df.schema[key].dataType

    def run(batches):
        for batch in batches:
            rows = []
            for n, buf in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                media = demux(buf)
                data = b"".join([buf[p.offset : p.offset + p.size] for p in media.packets])
                rows.append((n, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]), len(buf), hashlib.sha256(buf).hexdigest(), feature(np.frombuffer(data, np.uint8), media)))
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array([r[k] for r in rows], t) for k, t in enumerate(types)]],
                ["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
            )

    schema = f"id {kind.simpleString()}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return df.select(F.col(key).alias("id"), "n_bytes", "media").mapInArrow(run, schema).withColumnRenamed("id", key)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_back(encode_texts(spark.read.parquet(f"{sf_dir}/documents.parquet")))
