"""LAS point files as a Spark data source whose tasks read ranges of point records, and a writer of such files.

    spark.dataSource.register(Las)
    spark.read.format("las").schema("path string, point_id long, x double, y double, z double, treeID long").load("file:///plots")

The schema names what is read: path, point_id (the record's number in its file), crs, coordinates and the fields of the
point format, or an extra dimension that the file's own descriptors name. A range belongs to the task in which a record
begins, so that files of any size span tasks, and small files share one. Files that aren't whole LAS files give no points;
`rejects` lists them with the reason. A file without a requested dimension is an error, as is one without a coordinate
system where crs is asked for.

Point formats 0 to 3 and 6 to 8 are read, uncompressed, from file systems that Arrow reaches by URI.
"""

from __future__ import annotations

import io
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Bytes of records that a task reads at most, and records that it decodes at once.
SPLIT_BYTES, BATCH_POINTS = 64 << 20, 65_536
#: Points of a written file at most.
FILE_POINTS = 5_000_000

# Fixed values of the LAS 1.2 and 1.4 formats: fields of the point formats, their sizes, and the types of extra dimensions.
OLD = [("X", "<i4", 0), ("Y", "<i4", 4), ("Z", "<i4", 8), ("intensity", "<u2", 12), ("flags", "u1", 14), ("classification", "u1", 15), ("scan_angle", "i1", 16), ("user_data", "u1", 17), ("point_source_id", "<u2", 18)]
NEW = [("X", "<i4", 0), ("Y", "<i4", 4), ("Z", "<i4", 8), ("intensity", "<u2", 12), ("flags", "<u2", 14), ("classification", "u1", 16), ("user_data", "u1", 17), ("scan_angle", "<i2", 18), ("point_source_id", "<u2", 20), ("gps_time", "<f8", 22)]
FORMATS = {
    0: (20, OLD),
    1: (28, [*OLD, ("gps_time", "<f8", 20)]),
    2: (26, [*OLD, ("red", "<u2", 20), ("green", "<u2", 22), ("blue", "<u2", 24)]),
    3: (34, [*OLD, ("gps_time", "<f8", 20), ("red", "<u2", 28), ("green", "<u2", 30), ("blue", "<u2", 32)]),
    6: (30, NEW),
    7: (36, [*NEW, ("red", "<u2", 30), ("green", "<u2", 32), ("blue", "<u2", 34)]),
    8: (38, [*NEW, ("red", "<u2", 30), ("green", "<u2", 32), ("blue", "<u2", 34), ("nir", "<u2", 36)]),
}
EXTRA_TYPES = {1: "u1", 2: "i1", 3: "<u2", 4: "<i2", 5: "<u4", 6: "<i4", 7: "<u8", 8: "<i8", 9: "<f4", 10: "<f8"}
HEADER_BYTES = {2: 227, 4: 375}
EXTRA_RECORD, WKT_RECORD, KEYS_RECORD = ("LASF_Spec", 4), ("LASF_Projection", 2112), ("LASF_Projection", 34735)
PROJECTED_KEY, GEOGRAPHIC_KEY = 3072, 2048


@dataclass
class Header:
    """What a file says of its records: `fields` by name as (type, place, scale, offset)."""

    point_format: int
    points: int
    begin: int
    record: int
    scale: tuple[float, ...]
    offset: tuple[float, ...]
    fields: dict[str, tuple[str, int, float, float]] = field(default_factory=dict)
    crs: str | None = None

    def dtype(self, names: list[str]) -> np.dtype:
        return np.dtype({"names": names, "formats": [self.fields[n][0] for n in names], "offsets": [self.fields[n][1] for n in names], "itemsize": self.record})


def extra_fields(data: bytes, place: int, end: int) -> dict[str, tuple[str, int, float, float]]:
    """The extra dimensions of descriptors of 192 bytes, whose values follow each other from `place`."""
    out = {}
    for at in range(0, len(data) - 191, 192):
        kind, options = data[at + 2], data[at + 3]
        name = data[at + 4 : at + 36].split(b"\0")[0].decode("utf-8", "replace")
        if kind == 0:  # undocumented bytes, as many as the options say
            place += options
            continue
        if kind not in EXTRA_TYPES:
            raise ValueError(f"extra dimension {name} has type {kind}")
        size = np.dtype(EXTRA_TYPES[kind]).itemsize
        if place + size > end:
            raise ValueError(f"extra dimension {name} lies outside the records")
        scale, offset = struct.unpack_from("<d", data, at + 112)[0] if options & 8 else 1.0, struct.unpack_from("<d", data, at + 136)[0] if options & 16 else 0.0
        out[name] = EXTRA_TYPES[kind], place, scale, offset
        place += size
    return out


def crs_of_keys(data: bytes) -> str | None:
    """The EPSG code of a key directory, that of a projected system first."""
    keys = {struct.unpack_from("<H", data, at)[0]: struct.unpack_from("<4H", data, at) for at in range(8, len(data) - 7, 8)}
    for key in (PROJECTED_KEY, GEOGRAPHIC_KEY):
        if key in keys and keys[key][1] == 0 and 0 < keys[key][3] < 32767:
            return f"EPSG:{keys[key][3]}"
    return None


def header_of(f, size: int) -> Header:
    """Parses a file's header and variable-length records; a ValueError says what is wrong with it."""
    f.seek(0)
    head = f.read(375)
    if len(head) < 227 or head[:4] != b"LASF":
        raise ValueError("no LAS signature")
    minor, header_bytes, begin, records, point_format, record = head[25], *struct.unpack_from("<HIIBH", head, 94)
    if point_format & 0xC0:
        raise ValueError("compressed points")
    if point_format not in FORMATS:
        raise ValueError(f"point format {point_format}")
    base, fields = FORMATS[point_format]
    if record < base:
        raise ValueError(f"records of {record} bytes, format {point_format} needs {base}")
    points = struct.unpack_from("<I", head, 107)[0]
    if minor >= 4:
        if header_bytes < 375 or len(head) < 375:
            raise ValueError("header cut short")
        points = struct.unpack_from("<Q", head, 247)[0] or points
    if begin < header_bytes or begin + points * record > size:
        raise ValueError(f"{size} bytes, {points} points need {begin + points * record}")
    out = Header(point_format, points, begin, record, struct.unpack_from("<3d", head, 131), struct.unpack_from("<3d", head, 155))
    out.fields = {n: (t, at, 1.0, 0.0) for n, t, at in fields}
    f.seek(header_bytes)
    data, at, wkt, keys = f.read(begin - header_bytes), 0, None, None
    for _ in range(records):
        if at + 54 > len(data):
            raise ValueError("variable-length records cut short")
        user, number, length = data[at + 2 : at + 18].split(b"\0")[0].decode("latin-1"), *struct.unpack_from("<HH", data, at + 18)
        content, at = data[at + 54 : at + 54 + length], at + 54 + length
        if len(content) < length:
            raise ValueError("variable-length records cut short")
        if (user, number) == EXTRA_RECORD:
            out.fields |= extra_fields(content, base, record)
        elif (user, number) == WKT_RECORD:
            wkt = content.split(b"\0")[0].decode("utf-8", "replace") or None
        elif (user, number) == KEYS_RECORD:
            keys = crs_of_keys(content)
    out.crs = wkt or keys
    return out


def store_of(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def listed(folder: str, suffix: str) -> list[tuple[str, int]]:
    """(path, bytes) of the files below a folder, or of the file that it is; in order of path."""
    from pyarrow import fs

    store, base = store_of(folder)
    here = store.get_file_info(base)
    if here.type == fs.FileType.NotFound:
        raise FileNotFoundError(folder)
    infos = [here] if here.type == fs.FileType.File else store.get_file_info(fs.FileSelector(base, recursive=True))
    return sorted((i.path, i.size) for i in infos if i.type == fs.FileType.File and i.path.lower().endswith(suffix))


class Ranges(InputPartition):
    """Byte ranges (path, size of the file, begin, end) of one task."""

    def __init__(self, number: int, ranges: list[tuple[str, int, int, int]]):
        super().__init__(number)
        self.ranges = ranges


def ranges_of(files: list[tuple[str, int]], split: int) -> list[list[tuple[str, int, int, int]]]:
    """Ranges of `split` bytes at most, with small files together. An empty file has a range of its own, so that it is looked at."""
    out: list[list] = []
    room = 0
    for path, size in files:
        for lo in range(0, max(size, 1), split):
            n = min(split, size - lo)
            if n > room or not out:
                out.append([])
                room = split
            out[-1].append((path, size, lo, lo + n))
            room -= n
    return out


class PointReader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: StructType):
        self.folder, self.schema = options["path"], schema
        self.split, self.suffix = int(options.get("splitbytes", SPLIT_BYTES)), options.get("suffix", ".las")

    def partitions(self) -> list[Ranges]:
        return [Ranges(i, r) for i, r in enumerate(ranges_of(listed(self.folder, self.suffix), self.split))]

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        store, _ = store_of(self.folder)
        target = to_arrow_schema(self.schema)
        for path, size, begin, end in partition.ranges:
            with store.open_input_file(path) as f:
                try:
                    header = header_of(f, size)
                except (ValueError, OSError, struct.error):
                    continue  # rejects() lists it
                first, last = (min(header.points, max(0, -(-(at - header.begin) // header.record))) for at in (begin, end))
                for lo in range(first, last, BATCH_POINTS):
                    n = min(BATCH_POINTS, last - lo)
                    f.seek(header.begin + lo * header.record)
                    yield self.batch(path, header, lo, f.read(n * header.record), target)

    def batch(self, path: str, header: Header, first: int, data: bytes, target: pa.Schema) -> pa.RecordBatch:
        n = len(data) // header.record
        place = {"x": ("X", 0), "y": ("Y", 1), "z": ("Z", 2)}
        own = [place[c][0] if c in place else c for c in target.names if c not in ("path", "point_id", "crs")]
        if missing := [c for c in own if c not in header.fields]:
            raise ValueError(f"{path} has no dimension {', '.join(missing)}; it has {', '.join(header.fields)}")
        points = np.frombuffer(data, header.dtype(list(dict.fromkeys(own))))
        columns = []
        for c in target:
            if c.name == "path":
                values = pa.array([path], pa.string()).take(pa.array(np.zeros(n, np.int32)))
            elif c.name == "crs":
                if header.crs is None:
                    raise ValueError(f"{path} has no coordinate system")
                values = pa.array([header.crs], pa.string()).take(pa.array(np.zeros(n, np.int32)))
            elif c.name == "point_id":
                values = pa.array(np.arange(first, first + n))
            elif c.name in place:
                name, k = place[c.name]
                values = pa.array(points[name] * header.scale[k] + header.offset[k])
            else:
                _, _, scale, offset = header.fields[c.name]
                values = pa.array(np.ascontiguousarray(points[c.name])) if (scale, offset) == (1.0, 0.0) else pa.array(points[c.name] * scale + offset)
            columns.append(values.cast(c.type))
        return pa.record_batch(columns, schema=target)


class RejectReader(PointReader):
    """(path, reason) of files that can't be read; a file is looked at where its first byte lies."""

    def read(self, partition: Ranges) -> Iterator[tuple]:
        store, _ = store_of(self.folder)
        for path, size, begin, _ in partition.ranges:
            if begin == 0:
                try:
                    with store.open_input_file(path) as f:
                        header_of(f, size)
                except (ValueError, OSError, struct.error) as e:
                    yield path, str(e)


class HeaderReader(PointReader):
    """(path, point_format, points, crs, dimensions) of each whole file."""

    def read(self, partition: Ranges) -> Iterator[tuple]:
        store, _ = store_of(self.folder)
        for path, size, begin, _ in partition.ranges:
            if begin == 0:
                try:
                    with store.open_input_file(path) as f:
                        h = header_of(f, size)
                except (ValueError, OSError, struct.error):
                    continue
                yield path, h.point_format, h.points, h.crs, list(h.fields)


KINDS = {"points": PointReader, "rejects": RejectReader, "headers": HeaderReader}


class Las(DataSource):
    """Options: path, splitBytes, suffix, and kind: points, rejects or headers."""

    @classmethod
    def name(cls) -> str:
        return "las"

    def schema(self) -> str:
        return {"points": "path string, point_id long, x double, y double, z double", "rejects": "path string, reason string", "headers": "path string, point_format int, points long, crs string, dimensions array<string>"}[self.options.get("kind", "points")]

    def reader(self, schema: StructType) -> PointReader:
        return KINDS[self.options.get("kind", "points")]({k.lower(): v for k, v in self.options.items()}, schema)


def read(spark: SparkSession, folder: str, schema: str | None = None, split_bytes: int = SPLIT_BYTES, kind: str = "points") -> DataFrame:
    """The points of all LAS files below a folder, in the columns of the schema; kind may be rejects or headers."""
    spark.dataSource.register(Las)
    reader = spark.read.format("las").option("splitBytes", split_bytes).option("kind", kind)
    return (reader.schema(schema) if schema else reader).load(folder)


def rejects(spark: SparkSession, folder: str) -> DataFrame:
    """(path, reason) of each file that isn't a whole LAS file of a known point format."""
    return read(spark, folder, kind="rejects")


def descriptor(name: str, kind: int) -> bytes:
    return struct.pack("<2xBB32s4x24s24s24s24s24s32s", kind, 0, name.encode(), *[b""] * 6)


def variable_record(user: str, number: int, content: bytes) -> bytes:
    return struct.pack("<2x16sHH32s", user.encode(), number, len(content), b"") + content


def encoded(xyz: np.ndarray, extras: dict[str, np.ndarray], scale: float = 0.001, point_format: int = 6, crs: str | None = None) -> bytes:
    """A LAS file: version 1.4 for formats from 6 on, else 1.2. Coordinates are rounded to the scale, from the floored least ones on; extra dimensions keep their type. crs: WKT, or EPSG:n."""
    base, fields = FORMATS[point_format]
    minor, at = (4 if point_format >= 6 else 2), base
    types = {np.dtype(t): k for k, t in EXTRA_TYPES.items()}
    layout = {n: (t, o) for n, t, o in fields}
    for name, values in extras.items():
        layout[name] = values.dtype.newbyteorder("<").str, at
        at += values.dtype.itemsize
    offset = np.floor(xyz.min(axis=0)) if len(xyz) else np.zeros(3)
    grid = np.round((xyz - offset) / scale)
    if len(xyz) and grid.max() >= 1 << 31:
        raise ValueError(f"coordinates span more than a scale of {scale} can hold")
    records = np.zeros(len(xyz), np.dtype({"names": list(layout), "formats": [t for t, _ in layout.values()], "offsets": [o for _, o in layout.values()], "itemsize": at}))
    for k, name in enumerate("XYZ"):
        records[name] = grid[:, k]
    for name, values in extras.items():
        records[name] = values
    more = [variable_record(*EXTRA_RECORD, b"".join(descriptor(n, types[v.dtype]) for n, v in extras.items()))] if extras else []
    if crs and crs.startswith("EPSG:"):
        more.append(variable_record(*KEYS_RECORD, struct.pack("<4H4H", 1, 1, 0, 1, PROJECTED_KEY, 0, 1, int(crs[5:]))))
    elif crs:
        more.append(variable_record(*WKT_RECORD, crs.encode() + b"\0"))
    begin, old = HEADER_BYTES[minor] + sum(map(len, more)), len(xyz) if minor < 4 else 0
    low, high = (grid.min(axis=0) * scale + offset, grid.max(axis=0) * scale + offset) if len(xyz) else (offset, offset)
    head = struct.pack("<4s4x16sBB32s32s4xHIIBH", b"LASF", b"", 1, minor, b"", b"grovespark", HEADER_BYTES[minor], begin, len(more), point_format, at)
    head += struct.pack("<I5I", old, *[0] * 5) + struct.pack("<6d", *[scale] * 3, *offset) + struct.pack("<6d", *(v for pair in zip(high, low) for v in pair))
    if minor == 4:
        head += struct.pack("<QQIQ15Q", 0, 0, 0, len(xyz), *[0] * 15)
    return head + b"".join(more) + records.tobytes()


def write(points: DataFrame, folder: str, key: str, extras: dict[str, str], most: int = FILE_POINTS, scale: float = 0.001, point_format: int = 6, crs: str | None = None) -> int:
    """Writes points (key, x, y, z and the columns of extras, name to NumPy type) as <key>-<part>-<piece>.las into the folder; the number of files.

    The points of a key are dealt to parts by their hash where they are more than `most`, and are in order of all their columns within a file, so that a task
    that runs again writes the same files. Files appear whole: they are written under another name and moved. Null keys are `None`; null values are an error.
    """
    names = ["x", "y", "z", *extras]
    rows = points.select(F.coalesce(F.col(key).cast("string"), F.lit("None")).alias("key"), *(F.col(c).cast("double").alias(c) for c in "xyz"), *(F.col(c).alias(c) for c in extras))
    sizes = rows.groupBy("key").agg(F.ceil(F.count("*") * 2 / most).cast("int").alias("parts"))
    part = F.when(F.col("parts") <= 2, 0).otherwise(F.pmod(F.xxhash64(*names), F.col("parts"))).cast("int").alias("part")
    dealt = rows.join(sizes, "key").select("key", part, *names)
    dealt = dealt.repartition("key", "part").sortWithinPartitions("key", "part", *list(extras), *"xyz")

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[pa.RecordBatch]]]:
        now, held, size, piece = None, [], 0, 0
        for b in batches:
            keys = list(zip(b["key"].to_pylist(), b["part"].to_pylist()))
            at = 0
            while at < len(keys):
                if keys[at] != now or size == most:
                    if held:
                        yield f"{now[0]}-{now[1]}-{piece}", held
                    piece = piece + 1 if keys[at] == now else 0
                    now, held, size = keys[at], [], 0
                end = at
                while end < len(keys) and keys[end] == now and size + end - at < most:
                    end += 1
                held.append(b.slice(at, end - at))
                size, at = size + end - at, end
        if held:
            yield f"{now[0]}-{now[1]}-{piece}", held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = store_of(folder)
        store.create_dir(base, recursive=True)
        for name, held in files(batches):
            table = pa.Table.from_batches(held)
            column = lambda c: table[c].to_numpy()
            if any(table[c].null_count for c in names):
                raise ValueError(f"nulls in {name}")
            data = encoded(np.stack([column(c) for c in "xyz"], axis=1), {c: column(c).astype(t) for c, t in extras.items()}, scale, point_format, crs)
            with store.open_output_stream(temporary := f"{base}/.{name}.{uuid.uuid4().hex}") as f:
                f.write(io.BytesIO(data).getbuffer())
            store.move(temporary, f"{base}/{name}.las")
            yield pa.record_batch([pa.array([1], pa.int64())], ["files"])

    return dealt.mapInArrow(run, "files long").agg(F.coalesce(F.sum("files"), F.lit(0))).first()[0]
