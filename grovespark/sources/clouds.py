"""Cloud files: one array a file, the label after the last underscore of its name.

Folders are listed and files read by tasks, where Arrow reaches the store, so that no list of files is on the driver; elsewhere
Spark's binary source does both. Any codec that turns bytes into an (n, 3) array will do. Files are written by the tasks
themselves, in parts of bounded size, under names that depend on the data alone, so that a rerun task writes the same files
again.
"""

from __future__ import annotations

import io
import re
from collections.abc import Callable, Iterator
from fnmatch import fnmatchcase
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import removed, written

#: Points of a file at most, and of an Arrow batch that a decoded file is sent in.
FILE_POINTS = 1_000_000
BATCH_POINTS = 65_536
#: Files of a written folder, about; a write of more goes to folders below.
FOLDER_FILES = 10_000
#: Bytes of files that a task reads, about, and bytes that opening one counts as; tasks that list the folders of a level at most.
TASK_BYTES, OPEN_BYTES, LIST_TASKS = 64 << 20, 64 << 10, 200
AXES = ("x", "y", "z")


def npy_points(content: bytes) -> np.ndarray:
    return np.load(io.BytesIO(content), allow_pickle=False)


def points_of(content: bytes, decode: Callable[[bytes], np.ndarray]) -> np.ndarray:
    """The (n, 3 or more) array of a file; a ValueError says why it has none."""
    try:
        points = np.asarray(decode(content), float)
    except (ValueError, EOFError, OSError, TypeError) as e:
        raise ValueError(str(e) or type(e).__name__) from e
    if points.ndim != 2 or points.shape[1] < 3:
        raise ValueError(f"an array of shape {points.shape}")
    return points


Files = Iterator[tuple[str, bytes | None]]
POINTS, REASONS = "path string, point_id long, x double, y double, z double", "path string, reason string"


def point_rows(files: Files, decode: Callable[[bytes], np.ndarray]) -> Iterator[pa.RecordBatch]:
    for path, content in files:
        try:
            points = points_of(content, decode)
        except ValueError:
            continue
        for lo in range(0, len(points), BATCH_POINTS):
            part = points[lo : lo + BATCH_POINTS]
            columns = [pa.array([path] * len(part)), pa.array(np.arange(lo, lo + len(part))), *(pa.array(np.ascontiguousarray(part[:, k])) for k in range(3))]
            yield pa.record_batch(columns, ["path", "point_id", *AXES])


def reason_rows(files: Files, decode: Callable[[bytes], np.ndarray]) -> Iterator[pa.RecordBatch]:
    for path, content in files:
        try:
            points_of(content, decode)
        except ValueError as e:
            yield pa.record_batch([pa.array([path]), pa.array([str(e)])], ["path", "reason"])


def given(batches: Iterator[pa.RecordBatch]) -> Files:
    for b in batches:
        for path, content in zip(b["path"].to_pylist(), b["content"]):
            yield path, content.as_py()


def decoded(files: DataFrame, decode: Callable[[bytes], np.ndarray] = npy_points) -> DataFrame:
    """(path, point_id, x, y, z) of each point of files (path, content). A file that can't be decoded, or holds no (n, 3 or more) array, gives no rows; rejected() has it."""
    return files.select("path", "content").mapInArrow(lambda batches: point_rows(given(batches), decode), POINTS)


def rejected(files: DataFrame, decode: Callable[[bytes], np.ndarray] = npy_points) -> DataFrame:
    """(path, reason) of each of files (path, content) that decoded() gives no rows for because it can't be read."""
    return files.select("path", "content").mapInArrow(lambda batches: reason_rows(given(batches), decode), REASONS)


def files_of(spark: SparkSession, folder: str, pattern: str = "*.npy") -> DataFrame:
    """(path, content, ...) of all files of the pattern below the folder, by Spark's binary source, which lists them on the driver."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)


def reachable(spark: SparkSession, folder: str) -> str | None:
    """The folder's URI, if it is one that Arrow reaches."""
    from pyarrow import fs

    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        uri = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
        store, base = fs.FileSystem.from_uri(uri)
        return uri if store.get_file_info(base).type == fs.FileType.Directory else None
    except Exception:  # noqa: BLE001  whatever it is, Spark's source tries it and says what is wrong
        return None


def hidden(name: str) -> bool:
    """Whether Spark's sources pass over a name."""
    return (name[:1] == "_" and "=" not in name and not name.startswith(("_metadata", "_common_metadata"))) or name[:1] == "." or name.endswith("._COPYING_")


def listed(spark: SparkSession, uri: str, pattern: str) -> DataFrame:
    """(place, size) of all files of the pattern below the folder, level by level: a row is a folder, and a task holds the list of one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(uri)
        for b in batches:
            for place in b["place"].to_pylist():
                infos = store.get_file_info(fs.FileSelector(f"{base}/{place}"))
                for lo in range(0, len(infos), BATCH_POINTS):
                    kept = [i for i in infos[lo : lo + BATCH_POINTS] if not hidden(i.base_name) and (i.type == fs.FileType.Directory or fnmatchcase(i.base_name, pattern))]
                    columns = [pa.array([f"{place}{i.base_name}" for i in kept], pa.string()), pa.array([i.size or 0 for i in kept], pa.int64()), pa.array([i.type == fs.FileType.Directory for i in kept], pa.bool_())]
                    yield pa.record_batch(columns, ["place", "size", "folder"])

    level, files = spark.range(1).select(F.lit("").alias("place")), None
    while True:
        found = written(level.mapInArrow(run, "place string, size long, folder boolean"))
        own = found.where("not folder").select("place", "size")
        files = own if files is None else files.unionByName(own)
        folders = found.where("folder").select(F.concat("place", F.lit("/")).alias("place"))
        if not (n := folders.count()):
            return files
        level = folders.repartition(min(n, LIST_TASKS))


def by_files(spark: SparkSession, folder: str, pattern: str, decode: Callable[[bytes], np.ndarray], rows: Callable[[Files, Callable], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """What `rows` makes of the files of the pattern below the folder. A pattern of more than * and ? is left to Spark's source, and so is a folder that Arrow doesn't reach."""
    uri = reachable(spark, folder) if not re.search(r"[\[\]{}\\]", pattern) else None
    if uri is None:
        return files_of(spark, folder, pattern).select("path", "content").mapInArrow(lambda batches: rows(given(batches), decode), schema)
    files = listed(spark, uri, pattern)
    weight = files.agg(F.coalesce(F.sum(F.col("size") + OPEN_BYTES), F.lit(0))).first()[0]

    def contents(batches: Iterator[pa.RecordBatch]) -> Files:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(uri)
        for b in batches:
            for place in b["place"].to_pylist():
                with store.open_input_stream(f"{base}/{place}") as f:
                    yield f"{uri}/{place}", f.read()

    return files.select("place").repartition(-(-weight // TASK_BYTES) or 1, "place").mapInArrow(lambda batches: rows(contents(batches), decode), schema)


def read(spark: SparkSession, folder: str, pattern: str = "*.npy", decode: Callable[[bytes], np.ndarray] = npy_points) -> DataFrame:
    """The points of all files of the pattern below the folder."""
    return by_files(spark, folder, pattern, decode, point_rows, POINTS)


def rejects(spark: SparkSession, folder: str, pattern: str = "*.npy", decode: Callable[[bytes], np.ndarray] = npy_points) -> DataFrame:
    """(path, reason) of the files that can't be read."""
    return by_files(spark, folder, pattern, decode, reason_rows, REASONS)


def write(points: DataFrame, folder: str, most: int = FILE_POINTS) -> int:
    """Writes points (cloud_id, label, x, y, z) as <cloud>-<part>-<piece>_<label>.npy into the folder; the number of files.

    More than FOLDER_FILES go to numbered folders below it, by cloud, so that no task lists them all; another set of clouds needs
    a folder of its own. A cloud with more than `most` points is dealt to parts by its points' hash, so that no task holds a whole large cloud; a
    part with many equal points goes on in a further piece. Null labels become 15. The folder's file system must be one that
    executors reach.
    """
    rows = points.select("cloud_id", F.coalesce(F.col("label").cast("int"), F.lit(15)).alias("label"), *(F.col(a).cast("double").alias(a) for a in AXES))
    sizes = written(rows.groupBy("cloud_id", "label").agg(F.ceil(F.count("*") * 2 / most).cast("int").alias("parts")))
    folders = -(-(sizes.agg(F.sum("parts")).first()[0] or 0) // FOLDER_FILES)
    part = F.when(F.col("parts") <= 2, 0).otherwise(F.expr("pmod(xxhash64(x, y, z), parts)")).cast("int").alias("part")
    # the sizes of many clouds are a small file, but too many rows for the driver to broadcast
    dealt = rows.join(sizes.hint("merge"), ["cloud_id", "label"]).select("cloud_id", "label", part, *AXES)
    dealt = dealt.repartition("cloud_id", "label", "part").sortWithinPartitions("cloud_id", "label", "part", *AXES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        there = {base}
        for key, piece, array in pieces(batches, most):
            out = io.BytesIO()
            np.save(out, array, allow_pickle=False)
            place = f"{base}/{crc32(str(key[0]).encode()) % folders}" if folders > 1 else base
            if place not in there:
                store.create_dir(place)
                there.add(place)
            with store.open_output_stream(f"{place}/{key[0]}-{key[2]}-{piece}_{key[1]}.npy") as f:
                f.write(out.getvalue())
            yield pa.record_batch([pa.array([1], pa.int64())], ["files"])

    n = dealt.mapInArrow(run, "files long").agg(F.coalesce(F.sum("files"), F.lit(0))).first()[0]
    removed(sizes)
    return n


def pieces(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[tuple, int, np.ndarray]]:
    """(key, number, array) from rows that come sorted by key: cloud_id, label, part; arrays of `most` points and a rest."""
    key, number, held, size = None, 0, [], 0
    for b in batches:
        if not b.num_rows:
            continue
        keys = list(zip(*(b[c].to_pylist() for c in ("cloud_id", "label", "part"))))
        values = np.stack([b[a].to_numpy(zero_copy_only=False) for a in AXES], axis=1)
        cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
        for lo, hi in zip(cuts, cuts[1:]):
            if keys[lo] != key:
                if size:
                    yield key, number, np.concatenate(held)
                key, number, held, size = keys[lo], 0, [], 0
            while lo < hi:
                some = values[lo : min(hi, lo + most - size)]
                held.append(some)
                size, lo = size + len(some), lo + len(some)
                if size == most:
                    yield key, number, np.concatenate(held)
                    number, held, size = number + 1, [], 0
    if size:
        yield key, number, np.concatenate(held)
