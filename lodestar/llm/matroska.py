"""Media columns in Matroska: texts as 8-bit audio, containers as packet tables.

The parser reads variable-length EBML elements (of unknown size too), clusters, simple blocks and block groups with all four
kinds of lacing, and cues, into packets: track, timestamp, key frame flag, cluster, and the byte range in the container. The
writer stores a payload as frames of 8-bit samples: blocks of equally long frames with fixed lacing, the last block with EBML
lacing, a cue for each cluster. Nothing in a container depends on anything but its payload.

Defined results: a null text counts as empty; every row of the input gives one row. parse() raises ValueError for a container
that ends within an element, lacks one that it needs, or whose sizes contradict each other; packet_table() gives such a container
one row with the error.
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

from lodestar.llm.common import documents, released

#: Element ids of the format.
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
SCALE, TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, REFERENCE = 0x2AD7B1, 0xE7, 0xA3, 0xA0, 0xA1, 0xFB
TRACK_ENTRY, TRACK_NUMBER, CODEC, AUDIO, RATE, DEFAULT_DURATION = 0xAE, 0xD7, 0x86, 0xE1, 0xB5, 0x23E383
CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
TOP = {INFO, TRACKS, CLUSTER, CUES, 0x114D9B74, 0x1941A469, 0x1043A770, 0x1254C367}

FRAME = 192
RATE_HZ = 8000
FRAME_MS = FRAME * 1000 // RATE_HZ
FRAMES_IN_BLOCK, BLOCKS_IN_CLUSTER = 8, 40


class Packet(NamedTuple):
    track: int
    timestamp_ns: int
    keyframe: bool
    cluster: int
    start: int
    stop: int


class Media(NamedTuple):
    packets: list[Packet]
    tracks: dict[int, str]
    cues: list[tuple[int, int, int]]
    clusters: int


def number(buf: bytes, at: int, marked: bool = False) -> tuple[int, int]:
    """The variable-length number at a place and where it ends; -1 is the unknown size. marked: with its length marker, as ids have it."""
    if at >= len(buf) or not buf[at]:
        raise ValueError(f"no variable-length number at byte {at}")
    n = 9 - buf[at].bit_length()
    if at + n > len(buf):
        raise ValueError(f"the number at byte {at} is cut off")
    value = int.from_bytes(buf[at : at + n], "big")
    if not marked:
        value &= (1 << 7 * n) - 1
        if value == (1 << 7 * n) - 1:
            value = -1
    return value, at + n


def elements(buf: bytes, at: int, stop: int, ends: frozenset[int] | set[int] = frozenset()) -> Iterator[tuple[int, int, int]]:
    """(id, start, stop) of the elements in a byte range. One of unknown size goes on to the range's end or an id in ends."""
    while at < stop:
        kind, data = number(buf, at, marked=True)
        size, data = number(buf, data)
        if size < 0:
            end = stop
            if kind == CLUSTER:
                end = next((at for at, inner in _starts(buf, data, stop) if inner in ends), stop)
        elif (end := data + size) > stop:
            raise ValueError(f"the element at byte {at} is cut off")
        yield kind, data, end
        at = end


def _starts(buf: bytes, at: int, stop: int) -> Iterator[tuple[int, int]]:
    while at < stop:
        kind, data = number(buf, at, marked=True)
        yield at, kind
        size, data = number(buf, data)
        if size < 0:
            return
        at = data + size


def laces(buf: bytes, at: int, stop: int, lacing: int) -> list[tuple[int, int]]:
    """Byte ranges of a block's frames; lacing: 0 none, 1 Xiph, 2 fixed, 3 EBML."""
    if not lacing:
        return [(at, stop)]
    n, at = buf[at] + 1, at + 1
    if lacing == 2:
        if (stop - at) % n:
            raise ValueError(f"{stop - at} bytes can't be cut into {n} frames")
        size = (stop - at) // n
        return [(at + i * size, at + (i + 1) * size) for i in range(n)]
    sizes: list[int] = []
    for i in range(n - 1):
        if lacing == 1:
            size = 0
            while buf[at] == 255:
                size, at = size + 255, at + 1
            size, at = size + buf[at], at + 1
        else:
            was = at
            size, at = number(buf, at)
            if size < 0:
                size = (1 << 7 * (at - was)) - 1
            if i:  # differences are signed: half of the range is zero
                size += sizes[-1] - ((1 << 7 * (at - was) - 1) - 1)
        sizes.append(size)
    sizes.append(stop - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError("laced frames are longer than their block")
    out = []
    for size in sizes:
        out.append((at, at + size))
        at += size
    return out


def _unsigned(buf: bytes, a: int, b: int) -> int:
    return int.from_bytes(buf[a:b], "big")


def parse(buf: bytes) -> Media:
    """A container's packets, tracks (codec by number), cues and number of clusters; ValueError if it is damaged."""
    try:
        return _parse(buf)
    except (KeyError, IndexError, struct.error, UnicodeDecodeError) as e:
        raise ValueError(f"the container is damaged: {e!r}") from e


def _parse(buf: bytes) -> Media:
    packets: list[Packet] = []
    tracks: dict[int, str] = {}
    durations: dict[int, int] = {}
    cues: list[tuple[int, int, int]] = []
    scale, clusters = 1_000_000, 0

    def block(a: int, b: int, base: int, key: bool | None) -> None:
        track, a = number(buf, a)
        if a + 3 > b:
            raise ValueError(f"the block that ends at byte {b} has no header")
        relative, flags = struct.unpack_from(">hB", buf, a)
        time = (base + relative) * scale
        for i, (x, y) in enumerate(laces(buf, a + 3, b, flags >> 1 & 3)):
            packets.append(Packet(track, time + i * durations.get(track, 0), bool(flags & 0x80) if key is None else key, clusters, x, y))

    for top, a, b in elements(buf, 0, len(buf)):
        if top != SEGMENT:
            continue
        for kind, c, d in elements(buf, a, b, TOP):
            if kind == INFO:
                scale = next((_unsigned(buf, x, y) for k, x, y in elements(buf, c, d) if k == SCALE), scale)
            elif kind == TRACKS:
                for k, x, y in elements(buf, c, d):
                    if k == TRACK_ENTRY:
                        inner = {i: (e, f) for i, e, f in elements(buf, x, y)}
                        n = _unsigned(buf, *inner[TRACK_NUMBER])
                        tracks[n] = buf[slice(*inner[CODEC])].decode("ascii")
                        if DEFAULT_DURATION in inner:
                            durations[n] = _unsigned(buf, *inner[DEFAULT_DURATION])
            elif kind == CLUSTER:
                base = 0
                for k, x, y in elements(buf, c, d):
                    if k == TIMESTAMP:
                        base = _unsigned(buf, x, y)
                    elif k == SIMPLE_BLOCK:
                        block(x, y, base, None)
                    elif k == BLOCK_GROUP:
                        inner = {i: (e, f) for i, e, f in elements(buf, x, y)}
                        block(*inner[BLOCK], base, REFERENCE not in inner)
                clusters += 1
            elif kind == CUES:
                for k, x, y in elements(buf, c, d):
                    if k == CUE_POINT:
                        inner = {i: (e, f) for i, e, f in elements(buf, x, y)}
                        for i, e, f in elements(buf, x, y):
                            if i == CUE_POSITIONS:  # one for each track
                                at = {j: (g, h) for j, g, h in elements(buf, e, f)}
                                cues.append((_unsigned(buf, *inner[CUE_TIME]) * scale, _unsigned(buf, *at[CUE_TRACK]), a + _unsigned(buf, *at[CUE_CLUSTER])))
    return Media(packets, tracks, cues, clusters)


def vint(value: int, width: int = 0) -> bytes:
    n = width or next(n for n in range(1, 9) if value < (1 << 7 * n) - 1)
    return (value | 1 << 7 * n).to_bytes(n, "big")


def element(kind: int, data: bytes) -> bytes:
    return kind.to_bytes((kind.bit_length() + 7) // 8, "big") + vint(len(data)) + data


def uint(kind: int, value: int) -> bytes:
    return element(kind, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def laced(frames: list[bytes], lacing: int) -> bytes:
    """The part of a block after its header; lacing as in laces()."""
    if not lacing:
        return frames[0]
    sizes, head = [len(f) for f in frames], bytes([len(frames) - 1])
    if lacing == 1:
        head += b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    elif lacing == 3:
        head += vint(sizes[0])
        for a, b in zip(sizes, sizes[1:-1], strict=False):
            n = next(n for n in range(1, 9) if abs(b - a) < (1 << 7 * n - 1) - 1)
            head += vint(b - a + (1 << 7 * n - 1) - 1, n)
    return head + b"".join(frames)


def mux(payload: bytes) -> bytes:
    """Frames of FRAME samples of 8 bits at RATE_HZ; the payload's length must be a multiple of FRAME."""
    info = element(INFO, uint(SCALE, 1_000_000) + element(0x4D80, b"lodestar") + element(0x5741, b"lodestar"))
    audio = element(AUDIO, element(RATE, struct.pack(">f", RATE_HZ)) + uint(0x9F, 1) + uint(0x6264, 8))
    track = uint(TRACK_NUMBER, 1) + uint(0x73C5, 1) + uint(0x83, 2) + uint(0x9C, 1) + uint(DEFAULT_DURATION, FRAME_MS * 1_000_000) + element(CODEC, b"A_PCM/INT/LIT") + audio
    body = [info, element(TRACKS, element(TRACK_ENTRY, track))]
    at, points = sum(map(len, body)), []
    block_size, cluster_size = FRAME * FRAMES_IN_BLOCK, FRAME * FRAMES_IN_BLOCK * BLOCKS_IN_CLUSTER
    for begin in range(0, len(payload), cluster_size):
        base = begin // FRAME * FRAME_MS
        parts = [uint(TIMESTAMP, base)]
        for b in range(begin, min(begin + cluster_size, len(payload)), block_size):
            held = payload[b : b + block_size]
            n = len(held) // FRAME
            lacing = 2 if n == FRAMES_IN_BLOCK else 3 if n > 1 else 0
            inner = bytes([n - 1]) + held if lacing == 2 else laced([held[i : i + FRAME] for i in range(0, len(held), FRAME)], lacing)
            parts.append(element(SIMPLE_BLOCK, b"\x81" + struct.pack(">hB", b // FRAME * FRAME_MS - base, 0x80 | lacing << 1) + inner))
        points.append(element(CUE_POINT, uint(CUE_TIME, base) + element(CUE_POSITIONS, uint(CUE_TRACK, 1) + uint(CUE_CLUSTER, at))))
        body.append(element(CLUSTER, b"".join(parts)))
        at += len(body[-1])
    body.append(element(CUES, b"".join(points)))
    head = uint(0x4286, 1) + uint(0x42F7, 1) + uint(0x42F2, 4) + uint(0x42F3, 8) + element(0x4282, b"matroska") + uint(0x4287, 4) + uint(0x4285, 2)
    return element(EBML, head) + element(SEGMENT, b"".join(body))


def payload_of(text: str) -> tuple[bytes, int]:
    """A text's UTF-8 with spaces up to a positive multiple of FRAME, and its own length."""
    data = text.encode("utf-8", "surrogatepass")
    return data + b" " * (max(1, -(-len(data) // FRAME)) * FRAME - len(data)), len(data)


PACKETS = "id long, track int, timestamp_ns long, keyframe boolean, cluster int, start long, stop long, error string"


def packet_table(media: DataFrame, column: str = "media", key: str = "id") -> DataFrame:
    """One row for each packet of each container in a binary column, null ones aside; a damaged one gives one row with its error alone."""
    names, types = ["track", "timestamp_ns", "keyframe", "cluster", "start", "stop"], (pa.int32(), pa.int64(), pa.bool_(), pa.int32(), pa.int64(), pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, held in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if not held.is_valid:
                    continue
                try:
                    found, error = parse(held.as_py()).packets, None
                    cols = [pa.array(c, t) for c, t in zip(zip(*found, strict=True), types, strict=False)]
                except (ValueError, OverflowError) as e:  # Arrow's errors are ValueErrors too
                    found, error, cols = [None], str(e), [pa.array([None], t) for t in types]
                if found:
                    yield pa.record_batch([pa.array([i] * len(found), pa.int64()), *cols, pa.array([error] * len(found), pa.string())], ["id", *names, "error"])

    return media.select(F.col(key).cast("long"), F.col(column)).mapInArrow(released(run), PACKETS)


STORED = "doc_id long, n_bytes long, media binary"


def to_media(docs: DataFrame) -> DataFrame:
    """Texts as containers: doc_id, n_bytes, media."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 64):
                texts = batch.column("text").slice(a, 64).to_pylist()
                payloads = [payload_of(t or "") for t in texts]
                yield pa.record_batch([batch.column("doc_id").slice(a, 64), pa.array([n for _, n in payloads], pa.int64()), pa.array([mux(p) for p, _ in payloads], pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(released(run), STORED)


FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def features(stored: DataFrame) -> DataFrame:
    """What the packets of each container hold, read back by their byte ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for media in batch.column("media"):
                buf = media.as_py()
                found = parse(buf)
                data = b"".join(buf[p.start : p.stop] for p in found.packets)
                samples = np.frombuffer(data, np.uint8).astype(np.int32)
                last = found.packets[-1].timestamp_ns // 1_000_000
                feature = f"packets={len(found.packets)};clusters={found.clusters};cues={len(found.cues)};last_ms={last};mean={samples.mean():.6f};step={np.abs(np.diff(samples)).mean():.6f}"
                rows.append((len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:]), len(buf), hashlib.sha256(buf).hexdigest(), feature))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.record_batch([batch.column("doc_id"), batch.column("n_bytes"), *[pa.array(c, t) for c, t in zip(cols, types, strict=True)]], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return stored.mapInArrow(released(run), FEATURES)


def op6_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(to_media(documents(spark, sf_dir)))
