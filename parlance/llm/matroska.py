"""Media columns: Matroska files in a binary column, and the packet tables that are parsed from them.

An element is an identifier and a size, both variable-length numbers, and its data. Clusters hold blocks, a block holds one
frame or several laced ones, cues point to clusters.
"""

from __future__ import annotations

import math
import struct
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Element identifiers of the Matroska specification (RFC 9559).
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES, VOID = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B, 0xEC
TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID, DEFAULT_DURATION, AUDIO, RATE, CHANNELS, BIT_DEPTH = 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0x23E383, 0xE1, 0xB5, 0x9F, 0x6264
TIMESTAMP_SCALE, DURATION, MUXER, WRITER = 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, REFERENCE = 0xE7, 0xA3, 0xA0, 0xA1, 0xFB
CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
DOC_TYPE, EBML_NUMBERS = 0x4282, {0x4286: 1, 0x42F7: 1, 0x42F2: 4, 0x42F3: 8, 0x4287: 4, 0x4285: 2}
NO_LACING, XIPH, FIXED, EBML_LACING = 0, 1, 2, 3
#: Elements that hold elements which are read.
MASTERS = {SEGMENT, INFO, TRACKS, TRACK_ENTRY, CLUSTER, BLOCK_GROUP, CUES, CUE_POINT, CUE_POSITIONS}

SAMPLE_RATE = 8000
#: Samples of a frame, which is one packet of the audio track: 72 ms.
FRAME = 576
FRAMES_A_BLOCK, BLOCKS_A_CLUSTER = 8, 8
#: Byte that fills the last frame.
FILL = b"\xff"


def vint(value: int, width: int = 0) -> bytes:
    """A number with its length marked by leading zero bits; all ones are kept for "unknown"."""
    width = width or next(w for w in range(1, 9) if value < (1 << 7 * w) - 1)
    return (value | 1 << 7 * width).to_bytes(width, "big")


def read_vint(data: bytes, at: int, marked: bool = False) -> tuple[int | None, int]:
    """The number at a place (with its mark for identifiers) and the place after it; None: unknown."""
    width = 9 - data[at].bit_length()
    if width > 8 or at + width > len(data):
        raise ValueError("no variable-length number here")
    value = int.from_bytes(data[at : at + width], "big")
    if not marked:
        value &= (1 << 7 * width) - 1
        if value == (1 << 7 * width) - 1:
            return None, at + width
    return value, at + width


def element(ident: int, data: bytes) -> bytes:
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + vint(len(data)) + data


def number(ident: int, value: int) -> bytes:
    return element(ident, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def laced(frames: list[bytes], lacing: int) -> bytes:
    """The part of a block after its flags."""
    if lacing == NO_LACING:
        return frames[0]
    head = bytes([len(frames) - 1])
    sizes = [len(f) for f in frames]
    if lacing == XIPH:
        head += b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    elif lacing == EBML_LACING:
        head += vint(sizes[0])
        for before, n in zip(sizes, sizes[1:-1], strict=False):
            width = next(w for w in range(1, 9) if abs(n - before) < 1 << (7 * w - 1))
            head += vint(n - before + (1 << (7 * width - 1)) - 1, width)
    return head + b"".join(frames)


def unlaced(data: bytes, at: int, end: int, lacing: int) -> list[tuple[int, int]]:
    """Byte ranges of the frames of a block whose frames begin (with their sizes) at a place."""
    if lacing == NO_LACING:
        return [(at, end)]
    n, at, sizes = data[at] + 1, at + 1, []
    if lacing == FIXED:
        if (end - at) % n:
            raise ValueError("frames of a fixed lace differ in size")
        sizes = [(end - at) // n] * n
    elif lacing == XIPH:
        for _ in range(n - 1):
            size = 0
            while data[at] == 255:
                size, at = size + 255, at + 1
            sizes.append(size + data[at])
            at += 1
        sizes.append(end - at - sum(sizes))
    else:
        for i in range(n - 1):
            value, after = read_vint(data, at)
            if value is None:
                raise ValueError("a frame of a lace has no size")
            sizes.append(value if i == 0 else sizes[-1] + value - (1 << (7 * (after - at) - 1)) + 1)
            at = after
        sizes.append(end - at - sum(sizes))
    out = []
    for size in sizes:
        if size < 0 or at + size > end:
            raise ValueError("a lace is longer than its block")
        out.append((at, at + size))
        at += size
    return out


def mux(payload: bytes, lacing: int = FIXED, frame: int = FRAME) -> bytes:
    """A file with one audio track of unsigned 8-bit samples, whose packets are frames of the payload."""
    ms = frame * 1000 // SAMPLE_RATE
    frames = [payload[i : i + frame] for i in range(0, len(payload), frame)]
    head = element(EBML, b"".join(number(i, n) for i, n in EBML_NUMBERS.items()) + element(DOC_TYPE, b"matroska"))
    info = element(INFO, number(TIMESTAMP_SCALE, 1_000_000) + element(DURATION, struct.pack(">d", float(ms * len(frames)))) + element(MUXER, b"parlance") + element(WRITER, b"parlance"))
    audio = element(AUDIO, element(RATE, struct.pack(">d", float(SAMPLE_RATE))) + number(CHANNELS, 1) + number(BIT_DEPTH, 8))
    track = number(TRACK_NUMBER, 1) + number(TRACK_UID, 1) + number(TRACK_TYPE, 2) + element(CODEC_ID, b"A_PCM/INT/LIT") + number(DEFAULT_DURATION, ms * 1_000_000) + audio
    parts = [info, element(TRACKS, element(TRACK_ENTRY, track))]
    place, cues = sum(map(len, parts)), []
    for c in range(0, len(frames), FRAMES_A_BLOCK * BLOCKS_A_CLUSTER):
        blocks = [number(TIMESTAMP, ms * c)]
        for b in range(c, min(len(frames), c + FRAMES_A_BLOCK * BLOCKS_A_CLUSTER), FRAMES_A_BLOCK):
            own = frames[b : b + FRAMES_A_BLOCK]
            kind = lacing if len(own) > 1 else NO_LACING
            blocks.append(element(SIMPLE_BLOCK, vint(1) + struct.pack(">hB", ms * (b - c), 0x80 | kind << 1) + laced(own, kind)))
        cluster = element(CLUSTER, b"".join(blocks))
        cues.append(element(CUE_POINT, number(CUE_TIME, ms * c) + element(CUE_POSITIONS, number(CUE_TRACK, 1) + number(CUE_CLUSTER, place))))
        parts.append(cluster)
        place += len(cluster)
    return head + element(SEGMENT, b"".join([*parts, element(CUES, b"".join(cues))]))


@dataclass
class Parsed:
    """Packets as (track, timestamp in ms, start, end, keyframe), cues as (time, track, place in the file)."""

    packets: list[tuple[int, int, int, int, bool]] = field(default_factory=list)
    cues: list[tuple[int, int, int]] = field(default_factory=list)
    tracks: dict[int, tuple[str, int]] = field(default_factory=dict)
    clusters: list[int] = field(default_factory=list)
    blocks: int = 0
    duration: float = 0.0


def demux(data: bytes) -> Parsed:
    """Walks the elements; unknown sizes reach to the end of what holds them, or to the next cluster. A block of a group is a
    keyframe if it refers to no other. A broken or cut file is a ValueError."""
    try:
        out = _walked(data)
    except (IndexError, struct.error, UnicodeDecodeError) as e:
        raise ValueError("the file is cut or broken") from e
    if not math.isfinite(out.duration) or not 0 <= out.duration < 1 << 62:
        raise ValueError("the duration is no length of time")
    if any(not -(1 << 62) < p[1] < 1 << 62 or p[0] >= 1 << 31 for p in out.packets):
        raise ValueError("a timestamp or a track is beyond any file")
    return out


def _walked(data: bytes) -> Parsed:
    out, scale, base, segment, group, refers = Parsed(), 1_000_000, 0, 0, 0, False
    track, cue = {}, {}
    ends: list[tuple[int, int]] = [(0, len(data))]  # identifiers and ends of the open elements
    at = 0

    def close(ident: int) -> None:
        if ident == TRACK_ENTRY:
            out.tracks[track.get(TRACK_NUMBER, 0)] = (track.get(CODEC_ID, ""), track.get(DEFAULT_DURATION, 0))
        elif ident == CUE_POSITIONS:
            out.cues.append((cue.get(CUE_TIME, 0), cue.get(CUE_TRACK, 0), segment + cue.get(CUE_CLUSTER, 0)))
        elif ident == BLOCK_GROUP and refers:
            out.packets[group:] = [(*p[:4], False) for p in out.packets[group:]]

    while True:
        while at >= ends[-1][1]:
            ident, _ = ends.pop()
            close(ident)
            if not ends:
                return out
        start = at
        ident, at = read_vint(data, at, marked=True)
        size, at = read_vint(data, at)
        if ident in (CLUSTER, CUES):  # ends a cluster of unknown size
            while len(ends) > 1 and ends[-1][0] != SEGMENT:
                close(ends.pop()[0])
        end = ends[-1][1] if size is None else at + size
        if end > ends[-1][1]:
            raise ValueError("an element is longer than what holds it")
        if ident in MASTERS:
            ends.append((ident, end))
            if ident == SEGMENT:
                segment = at
            elif ident == CLUSTER:
                out.clusters.append(start)
            elif ident == TRACK_ENTRY:
                track = {}
            elif ident == BLOCK_GROUP:
                group, refers = len(out.packets), False
            continue
        if ident in (SIMPLE_BLOCK, BLOCK):
            number_, place = read_vint(data, at)
            if number_ is None:
                raise ValueError("a block has no track")
            offset, flags = struct.unpack_from(">hB", data, place)
            out.blocks += 1
            each = out.tracks.get(number_, ("", 0))[1]
            for i, (a, b) in enumerate(unlaced(data, place + 3, end, flags >> 1 & 3)):
                out.packets.append((number_, ((base + offset) * scale + i * each) // 1_000_000, a, b, bool(flags & 0x80) or ident == BLOCK))
        elif ident == REFERENCE:  # before or behind the block of its group
            refers = True
        elif ident == TIMESTAMP:
            base = int.from_bytes(data[at:end], "big")
        elif ident == TIMESTAMP_SCALE:
            scale = int.from_bytes(data[at:end], "big")
        elif ident == DURATION and end - at not in (4, 8):
            raise ValueError("the duration is no number")
        elif ident == DURATION:
            out.duration = struct.unpack(">d" if end - at == 8 else ">f", data[at:end])[0]
        elif ident in (TRACK_NUMBER, DEFAULT_DURATION):
            track[ident] = int.from_bytes(data[at:end], "big")
        elif ident == CODEC_ID:
            track[ident] = data[at:end].decode()
        elif ident in (CUE_TIME, CUE_TRACK, CUE_CLUSTER):
            cue[ident] = int.from_bytes(data[at:end], "big")
        at = end


def padded(raw: bytes, frame: int = FRAME) -> bytes:
    """raw, filled up to a positive multiple of a frame."""
    return raw + FILL * (frame * max(1, -(-len(raw) // frame)) - len(raw))


@F.arrow_udf(T.BinaryType())
def _muxed(texts: pa.Array) -> pa.Array:
    return pa.array([mux(padded((t.as_py() or "").encode())) for t in texts], pa.binary())


def mux_text(text: Column) -> Column:
    """The text's UTF-8 bytes as samples of a Matroska file; a null or empty text is one frame of filling."""
    return _muxed(text)


PARSED = T.StructType().add("payload", "binary").add("packets", T.ArrayType(T.StructType().add("track", "integer").add("timestamp", "long").add("start", "long").add("end", "long").add("keyframe", "boolean")))
PARSED = PARSED.add("tracks", "integer").add("clusters", "integer").add("blocks", "integer").add("cues", "integer").add("cues_hit", "integer").add("duration_ms", "long").add("mean_sample", "double").add("error", "string")
_PACKET = pa.struct([("track", pa.int32()), ("timestamp", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("keyframe", pa.bool_())])


@F.arrow_udf(PARSED)
def _parsed(media: pa.Array) -> pa.Array:
    return parsed_table(media)


def parsed_table(media: pa.Array) -> pa.Array:
    """The column of parse() for a column of files."""
    payloads, packets, offsets, rest = [], [], [0], []
    for m in media:
        data, error = m.as_py() or b"", None
        try:
            p = demux(data)
        except ValueError as e:
            p, error = Parsed(), str(e)
        payload = None if error else b"".join([data[a:b] for _, _, a, b, _ in p.packets])
        payloads.append(payload)
        packets += p.packets
        offsets.append(len(packets))
        mean = float(np.frombuffer(payload, np.uint8).mean()) if payload else None
        clusters = set(p.clusters)
        rest.append((len(p.tracks), len(clusters), p.blocks, len(p.cues), sum(c[2] in clusters for c in p.cues), int(p.duration), mean, error))
    columns = list(zip(*packets, strict=True)) or [[]] * 5
    table = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _PACKET, strict=True)], fields=list(_PACKET))
    more = [pa.array(c, t) for c, t in zip(list(zip(*rest, strict=True)) or [[]] * 8, [pa.int32()] * 5 + [pa.int64(), pa.float64(), pa.string()], strict=True)]
    return pa.StructArray.from_arrays([pa.array(payloads, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), table), *more], names=PARSED.names)


def parse(media: Column) -> Column:
    """The packet table of a Matroska file (track, timestamp in ms, byte range, keyframe), its payload, and what it has of
    tracks, clusters, blocks and cues. A null or empty file has none; a broken one has a null payload, no packets and says why
    in `error`. A file of any length is parsed whole."""
    return _parsed(media)
