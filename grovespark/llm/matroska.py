"""Media columns: Matroska files in a binary column, written, and parsed into packet tables.

The parser reads variable-length EBML elements, clusters (known or unknown size), simple blocks and block groups, all
lacing kinds, and cues. Packets carry timestamps, track, and byte ranges of the file, so that samples are read back from stored bytes.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

#: Element numbers of the Matroska format.
EBML, SEGMENT, INFO, SCALE, TRACKS, TRACK, NUMBER, UID, KIND, CODEC, AUDIO, RATE, CHANNELS, DEPTH = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x2AD7B1, 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, TIME, SIMPLE, GROUP, BLOCK, REFERENCE, LASTS, CUES, POINT, CUE_TIME, POSITIONS, CUE_TRACK, CUE_CLUSTER, DOCTYPE = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0xFB, 0x9B, 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1, 0x4282
PARENTS = {SEGMENT, INFO, TRACKS, TRACK, AUDIO, CLUSTER, GROUP, CUES, POINT, POSITIONS}
TOP = {CLUSTER, CUES, INFO, TRACKS, 0x114D9B74, 0x1043A770, 0x1254C367, 0x1941A469, EBML, SEGMENT}
NO_LACE, XIPH, FIXED, EBML_LACE = 0, 1, 2, 3

SAMPLE_RATE = 8000
#: Samples of a frame (64 ms), frames of a laced block, blocks of a cluster.
FRAME, LACED, BLOCKS = 512, 8, 16
ALIGN = 64


def vint(value: int, width: int = 0) -> bytes:
    """A variable-length size: the count of leading zeros gives its bytes; all ones are kept for 'unknown'."""
    width = width or next(w for w in range(1, 9) if value < (1 << 7 * w) - 1)
    return (value | 1 << 7 * width).to_bytes(width, "big")


def element(number: int, body: bytes) -> bytes:
    return number.to_bytes((number.bit_length() + 7) // 8, "big") + vint(len(body)) + body


def uint(number: int, value: int) -> bytes:
    return element(number, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def block(track: int, relative: int, frames: list[bytes], lacing: int) -> bytes:
    """A simple block's body: track, signed 16-bit time, flags (key frame), lace sizes, frames."""
    out = vint(track) + struct.pack(">hB", relative, 0x80 | lacing << 1)
    if lacing:
        out += bytes([len(frames) - 1])
    sizes = [len(f) for f in frames]
    if lacing == XIPH:
        out += b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    elif lacing == EBML_LACE:
        out += vint(sizes[0])
        for a, b in zip(sizes, sizes[1:-1]):
            width = next(w for w in range(1, 9) if abs(b - a) < (1 << 7 * w - 1) - 1)
            out += vint(b - a + (1 << 7 * width - 1) - 1, width)
    return out + b"".join(frames)


def write(samples: bytes, rate: int = SAMPLE_RATE, frame: int = FRAME) -> bytes:
    """A Matroska file with one track of unsigned 8-bit samples. Blocks hold up to eight frames, laced by equal size or, with a short last frame, by EBML or Xiph."""
    head = element(EBML, element(DOCTYPE, b"matroska"))
    audio = element(RATE, struct.pack(">d", rate)) + uint(CHANNELS, 1) + uint(DEPTH, 8)
    body = element(INFO, uint(SCALE, 1_000_000)) + element(TRACKS, element(TRACK, uint(NUMBER, 1) + uint(UID, 1) + uint(KIND, 2) + element(CODEC, b"A_PCM/INT/LIT") + element(AUDIO, audio)))
    parts, cues, at = [body], [], len(body)
    span = frame * LACED * BLOCKS
    for begin in range(0, len(samples), span):
        ms, blocks = begin * 1000 // rate, []
        for k, s in enumerate(range(begin, min(begin + span, len(samples)), frame * LACED)):
            frames = [samples[i : i + frame] for i in range(s, min(s + frame * LACED, len(samples)), frame)]
            even = len(frames[0]) == len(frames[-1])
            lacing = NO_LACE if len(frames) == 1 else FIXED if even else XIPH if k % 2 else EBML_LACE
            blocks.append(element(SIMPLE, block(1, s * 1000 // rate - ms, frames, lacing)))
        cues.append(element(POINT, uint(CUE_TIME, ms) + element(POSITIONS, uint(CUE_TRACK, 1) + uint(CUE_CLUSTER, at))))
        parts.append(element(CLUSTER, uint(TIME, ms) + b"".join(blocks)))
        at += len(parts[-1])
    return head + element(SEGMENT, b"".join([*parts, element(CUES, b"".join(cues))]))


@dataclass
class Media:
    """What a file holds. packets: (track, timestamp ms, frame in its block, offset, length, key frame, lacing, cluster, duration ms or None); cues: (time, track, cluster's place)."""

    packets: list[tuple[int, float, int, int, int, bool, int, int, float | None]] = field(default_factory=list)
    tracks: dict[int, dict] = field(default_factory=dict)
    cues: list[tuple[int, int, int]] = field(default_factory=list)
    clusters: list[int] = field(default_factory=list)
    scale: int = 1_000_000
    origin: int = 0


def read_vint(data: bytes, at: int, keep: bool = False) -> tuple[int, int, int]:
    """(value, width, next place); keep leaves the length marker in, as element numbers have it."""
    first = data[at]
    width = 9 - first.bit_length()
    if width > 8:
        raise ValueError(f"no length marker at byte {at}")
    value = int.from_bytes(data[at : at + width], "big")
    return (value if keep else value & (1 << 7 * width) - 1), width, at + width


def parse(data: bytes) -> Media:
    """Reads a whole file. Broken or cut files raise ValueError, IndexError or struct.error. In a block group, the block stands first, as the format's writers have it."""
    out, origin, cluster_time, track, cue = Media(), 0, 0, {}, {}
    stack: list[tuple[int, int, bool]] = []
    at, group = 0, 0
    while at < len(data):
        while stack and not stack[-1][2] and at >= stack[-1][1]:
            stack.pop()
        start = at
        number, _, at = read_vint(data, at, keep=True)
        size, width, at = read_vint(data, at)
        unknown = size == (1 << 7 * width) - 1
        if number in TOP:  # ends an element of unknown size
            while stack and stack[-1][2] and (stack[-1][0] != SEGMENT or number in (EBML, SEGMENT)):
                stack.pop()
        end = len(data) if unknown else at + size
        if end > len(data):
            raise ValueError(f"element {number:x} at byte {start} ends beyond the file")
        body = data[at:end]
        if number in PARENTS:
            if number == SEGMENT:
                origin = out.origin = at
            elif number == GROUP:
                group = len(out.packets)
            elif number == CLUSTER:
                cluster_time = 0
                out.clusters.append(start - origin)
            elif number == TRACK:
                track = {}
            elif number == POINT:
                cue = {}
            stack.append((number, end, unknown))
            continue
        if number == SCALE:
            out.scale = int.from_bytes(body, "big")
        elif number == TIME:
            cluster_time = int.from_bytes(body, "big")
        elif number == NUMBER:
            out.tracks[int.from_bytes(body, "big")] = track
        elif number in (KIND, CHANNELS, DEPTH):
            track[{KIND: "kind", CHANNELS: "channels", DEPTH: "depth"}[number]] = int.from_bytes(body, "big")
        elif number == CODEC:
            track["codec"] = body.decode()
        elif number == RATE:
            track["rate"] = struct.unpack(">d" if len(body) == 8 else ">f", body)[0]
        elif number in (CUE_TIME, CUE_TRACK):
            cue[number] = int.from_bytes(body, "big")
        elif number == CUE_CLUSTER:
            out.cues.append((cue.get(CUE_TIME, 0), cue.get(CUE_TRACK, 0), int.from_bytes(body, "big")))
        elif number in (SIMPLE, BLOCK):
            read_block(data, at, end, number == SIMPLE, cluster_time, out)
        elif number == REFERENCE:  # a block that refers to others is no key frame
            out.packets[group:] = [(*p[:5], False, *p[6:]) for p in out.packets[group:]]
        elif number == LASTS:
            each = int.from_bytes(body, "big") * out.scale / 1e6 / max(1, len(out.packets) - group)
            out.packets[group:] = [(*p[:8], each) for p in out.packets[group:]]
        at = end
    return out


def read_block(data: bytes, at: int, end: int, simple: bool, cluster_time: int, out: Media) -> None:
    track, _, at = read_vint(data, at)
    relative, flags = struct.unpack_from(">hB", data, at)
    at += 3
    lacing, sizes = flags >> 1 & 3, []
    if lacing:
        more, at = data[at], at + 1
        if lacing == XIPH:
            for _ in range(more):
                n = 0
                while data[at] == 255:
                    n, at = n + 255, at + 1
                sizes.append(n + data[at])
                at += 1
        elif lacing == EBML_LACE:
            n, _, at = read_vint(data, at)
            sizes.append(n)
            for _ in range(more - 1):
                step, width, at = read_vint(data, at)
                n += step - (1 << 7 * width - 1) + 1
                sizes.append(n)
        else:
            sizes = [(end - at) // (more + 1)] * more
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError("lace sizes exceed their block")
    depth = out.tracks.get(track, {})
    rate = depth.get("rate", 0) * depth.get("channels", 1) * depth.get("depth", 0) / 8
    time = (cluster_time + relative) * out.scale / 1e6
    for k, n in enumerate(sizes):
        lasts = n / rate * 1000 if rate else None
        out.packets.append((track, time, k, at, n, not simple or bool(flags & 0x80), lacing, len(out.clusters) - 1, lasts))
        time += lasts or 0
        at += n


def read_samples(data: bytes, media: Media, track: int = 1) -> bytes:
    return b"".join([data[p[3] : p[3] + p[4]] for p in media.packets if p[0] == track])


def seek(data: bytes, media: Media, ms: float, track: int = 1) -> list[tuple]:
    """The packets of a track from the last cue at or before a time on, found by cutting the file at that cue's cluster; without such a cue, all."""
    due = [c for c in media.cues if c[1] == track and c[0] * media.scale / 1e6 <= ms]
    begin = media.origin + max(due)[2] if due else 0
    return [p for p in media.packets if p[0] == track and p[3] >= begin]


def feature(media: Media, samples: bytes) -> str:
    """Packets, clusters, cues, duration in ms, mean, root mean square and zero crossings of the samples about 128."""
    x = np.frombuffer(samples, np.uint8).astype(np.int64) - 128
    rate = next((t.get("rate", SAMPLE_RATE) for t in media.tracks.values()), SAMPLE_RATE)
    root = float(np.sqrt((x * x).mean())) if len(x) else 0.0
    crossings = int(((x[1:] < 0) != (x[:-1] < 0)).sum())
    return f"packets={len(media.packets)};clusters={len(media.clusters)};cues={len(media.cues)};ms={len(x) / rate * 1000:.3f};mean={x.mean() if len(x) else 0:.4f};rms={root:.4f};crossings={crossings}"


BROKEN = (ValueError, IndexError, struct.error)


def table(files: DataFrame, key: str, media: str, names: dict[str, tuple[str, pa.DataType]], rows_of: Callable[[bytes], list[tuple]]) -> DataFrame:
    """The rows of each file of a binary column under its key. Null and empty files have none; broken ones raise no error, but have none either."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in C.chunks(batches, media):
            keys, rows = [], []
            for k, data in zip(b[key].to_pylist(), b[media].to_pylist()):
                try:
                    own = rows_of(data) if data else []
                except BROKEN:
                    own = []
                keys += [k] * len(own)
                rows += own
            columns = list(zip(*rows)) or [[]] * len(names)
            yield pa.record_batch([pa.array(keys, b[key].type), *(pa.array(x, t) for x, (_, t) in zip(columns, names.values()))], [key, *names])

    kind = files.schema[key].dataType.simpleString()
    return files.select(key, media).mapInArrow(run, f"{key} {kind}, " + ", ".join(f"{n} {t}" for n, (t, _) in names.items()))


def packets(files: DataFrame, key: str = "doc_id", media: str = "media") -> DataFrame:
    """A row for each packet of each file: key, track, timestamp, frame, byte range, key frame, lacing, cluster, duration. Files that can't be read are in broken()."""
    names = {"track": ("int", pa.int32()), "timestamp_ms": ("double", pa.float64()), "frame": ("int", pa.int32()), "byte_offset": ("long", pa.int64()), "byte_length": ("long", pa.int64()), "key_frame": ("boolean", pa.bool_()), "lacing": ("int", pa.int32()), "cluster": ("int", pa.int32()), "duration_ms": ("double", pa.float64())}
    return table(files, key, media, names, lambda data: parse(data).packets)


def cue_points(files: DataFrame, key: str = "doc_id", media: str = "media") -> DataFrame:
    """A row for each cue of each file: key, time, track, and the byte that its cluster begins at."""
    names = {"timestamp_ms": ("double", pa.float64()), "track": ("int", pa.int32()), "byte_offset": ("long", pa.int64())}

    def rows_of(data: bytes) -> list[tuple]:
        own = parse(data)
        return [(t * own.scale / 1e6, track, own.origin + at) for t, track, at in own.cues]

    return table(files, key, media, names, rows_of)


def broken(files: DataFrame, key: str = "doc_id", media: str = "media") -> DataFrame:
    """(key, reason) of each file that can't be read; null and empty files aren't among them."""

    def rows_of(data: bytes) -> list[tuple]:
        try:
            parse(data)
        except BROKEN as e:
            return [(f"{type(e).__name__}: {e}",)]
        return []

    return table(files, key, media, {"reason": ("string", pa.string())}, rows_of)


def store(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each text's UTF-8 bytes, padded with zeros to a positive multiple of 64, as the samples of a Matroska file. A null text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in C.chunks(batches):
            data = [(t or "").encode() for t in b["text"].to_pylist()]
            files = [write(d + bytes(-len(d) % ALIGN if d else ALIGN)) for d in data]
            yield pa.record_batch([b["doc_id"], pa.array(map(len, data), pa.int64()), pa.array(files, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def digests(files: DataFrame) -> DataFrame:
    """Reads the stored bytes back and returns the digest columns, a row for each row of files; of a null or broken file, payload and feature are null."""
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in C.chunks(batches, "media"):
            rows = []
            for data in b["media"].to_pylist():
                try:
                    media = parse(data or b"\0")
                except BROKEN:
                    rows.append((None, None, None, None if data is None else len(data), None if data is None else hashlib.sha256(data).hexdigest(), None))
                    continue
                samples = read_samples(data, media)
                rows.append((len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-ALIGN:]), len(data), hashlib.sha256(data).hexdigest(), feature(media, samples)))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.record_batch([b["doc_id"], b["n_bytes"], *(pa.array(x, t) for x, t in zip(zip(*rows), kinds))], ["doc_id", "n_bytes", *names])

    return files.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op9_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated rows stay, ids may be null, null texts are empty ones, very long ones are stored whole, other columns are ignored, an empty table gives an empty one."""
    return digests(store(spark.read.parquet(f"{sf_dir}/documents.parquet")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op9_matroska": op9_matroska}
SQL: dict[str, str] = {}
