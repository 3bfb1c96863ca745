"""Chunks of clouds as arrays: a Spark data source that writes them, visible all at once or not at all, and their reader.

    write(points, folder, n_points)
    read(spark, folder)

A chunk is an .npz file of `size` clouds at most: `points` (clouds, n_points, 3). Tasks write files under names of their own
and a list of their entries (file, row, split, chunk_id, cloud_id, label); the commit makes one version of the manifest from
the lists of the tasks that succeeded. A task that fails leaves nothing that a reader sees, and an aborted write removes its files;
what a task that still runs adds after that, and what a lost executor has left, goes with manifest.collect().
"""

from __future__ import annotations

import io
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from ..operators.voxels import chunk_ids
from . import manifest

CHUNK_CLOUDS = 30
AXES = "xyz"
ENTRY = pa.schema([("file", pa.string()), ("row", pa.int32()), ("split", pa.string()), ("chunk_id", pa.int64()), ("cloud_id", pa.int64()), ("label", pa.int32())])
ROWS = "split string, chunk_id long, cloud_id long, label int, point_id long, x double, y double, z double"


@dataclass
class Written(WriterCommitMessage):
    entries: str | None


class Chunk:
    """The clouds of one chunk as their points come, cloud by cloud."""

    def __init__(self, split: str, number: int, n_points: int):
        self.split, self.number, self.n_points = split, number, n_points
        self.arrays: list[np.ndarray] = []
        self.clouds: list[tuple[int, int]] = []
        self.parts: list[np.ndarray] = []

    def close(self) -> None:
        if self.parts:
            whole = np.concatenate(self.parts)
            if whole.shape != (self.n_points, len(AXES)):
                raise ValueError(f"cloud {self.clouds[-1][0]} has {len(whole)} points of {self.n_points}")
            self.arrays.append(whole)
            self.parts = []

    def add(self, cloud: int, label: int, points: np.ndarray) -> None:
        if not self.clouds or self.clouds[-1][0] != cloud:
            self.close()
            self.clouds.append((cloud, label))
        self.parts.append(points)

    def data(self) -> bytes:
        self.close()
        out = io.BytesIO()
        np.savez_compressed(out, points=np.stack(self.arrays))
        return out.getvalue()


class ChunkWriter(DataSourceArrowWriter):
    """Rows come sorted by split, chunk_id, cloud_id and point_id, with all of a chunk in one task; memory is a chunk."""

    def __init__(self, options: dict[str, str]):
        self.folder, self.n_points, self.parent = options["path"], int(options["npoints"]), int(options.get("parent", -1))
        self.tag = uuid.uuid4().hex  # of the names of all files of this write

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, base = manifest.store_of(self.folder)
        store.create_dir(f"{base}/data", recursive=True)
        rows: list[dict] = []
        chunk: Chunk | None = None

        def flush() -> None:
            data = chunk.data()
            file = f"data/{self.tag}-{uuid.uuid4().hex}.npz"
            with store.open_output_stream(f"{base}/{file}") as f:
                f.write(data)
            rows.extend({"file": file, "row": k, "split": chunk.split, "chunk_id": chunk.number, "cloud_id": c, "label": y} for k, (c, y) in enumerate(chunk.clouds))

        for b in iterator:
            keys = list(zip(*(b[c].to_pylist() for c in ("split", "chunk_id", "cloud_id", "label"))))
            xyz = np.stack([b[a].to_numpy(zero_copy_only=False) for a in AXES], axis=1)
            cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            for lo, hi in zip(cuts, cuts[1:]):
                if hi == lo:
                    continue
                split, number, cloud, label = keys[lo]
                if chunk is None or (chunk.split, chunk.number) != (split, number):
                    if chunk is not None:
                        flush()
                    chunk = Chunk(split, number, self.n_points)
                chunk.add(cloud, label, xyz[lo:hi])
        if chunk is not None:
            flush()
        if not rows:
            return Written(None)
        named = f"_entries/{self.tag}-{uuid.uuid4().hex}"
        store.create_dir(f"{base}/{named}", recursive=True)
        with store.open_output_stream(f"{base}/{named}/part.parquet") as f:
            pq.write_table(pa.Table.from_pylist(rows, ENTRY), f)
        return Written(named)

    def commit(self, messages: list[Written | None]) -> None:
        """One version with the entries of all tasks, after the parent's; a Conflict leaves no files."""
        done = [m for m in messages if m is not None and m.entries]
        parent = self.parent if self.parent >= 0 else max(manifest.versions(self.folder), default=0)
        before = manifest.described(self.folder, parent)["entries"] if parent else []
        try:
            manifest.create(self.folder, parent, before + [m.entries for m in done])
        except manifest.Conflict:
            self.abort(messages)
            raise

    def abort(self, messages: list[Written | None]) -> None:  # noqa: ARG002
        from pyarrow import fs

        store, base = manifest.store_of(self.folder)
        for place, remove in (("data", store.delete_file), ("_entries", store.delete_dir)):
            for info in store.get_file_info(fs.FileSelector(f"{base}/{place}", allow_not_found=True)):
                if info.base_name.startswith(self.tag):
                    remove(info.path)


class Chunks(DataSource):
    """Options: path, nPoints, and parent: the version that the write adds to, by default the last."""

    @classmethod
    def name(cls) -> str:
        return "chunks"

    def schema(self) -> str:
        return ROWS

    def writer(self, schema: StructType, overwrite: bool) -> ChunkWriter:  # noqa: ARG002
        return ChunkWriter({k.lower(): v for k, v in self.options.items()})


def write(points: DataFrame, folder: str, n_points: int, size: int = CHUNK_CLOUDS, parent: int | None = None) -> DataFrame:
    """Writes points (split, cloud_id, label, point_id, x, y, z) as chunks and commits them as a version; returns (cloud_id, split, n) of the clouds of another number of points, which are left out.

    Clouds are numbered by cloud_id within their split; only those that are written take a place. Null labels become 15. An empty table commits a version without new entries.
    """
    spark = points.sparkSession
    spark.dataSource.register(Chunks)
    p = points.select("split", "cloud_id", F.coalesce(F.col("label").cast("int"), F.lit(15)).alias("label"), "point_id", *(F.col(a).cast("double").alias(a) for a in AXES))
    clouds = p.groupBy("cloud_id", "split").agg(F.count("*").alias("n"), F.min("label").alias("label"))
    numbered = chunk_ids(clouds.where(F.col("n") == n_points), ["cloud_id"], size).select("cloud_id", "split", "chunk_id", F.col("label").alias("_label"))
    rows = p.join(numbered, ["cloud_id", "split"]).select("split", "chunk_id", "cloud_id", F.col("_label").alias("label"), "point_id", *AXES)
    dealt = rows.repartition("split", "chunk_id").sortWithinPartitions("split", "chunk_id", "cloud_id", "point_id")
    out = dealt.write.format("chunks").mode("append").option("nPoints", n_points)
    (out if parent is None else out.option("parent", parent)).save(folder)
    return clouds.where(F.col("n") != n_points).select("cloud_id", "split", "n")


def read(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """(cloud_id, split, label, place, x, y, z) of a version: what its entries name, in the splits and under the labels that they give. place: the point's number in its cloud."""
    named = manifest.entries(spark, folder, version)
    files = named.groupBy("file").agg(F.collect_list(F.struct("row", "cloud_id", "split", "label")).alias("clouds"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = manifest.store_of(folder)
        for b in batches:
            for file, clouds in zip(b["file"].to_pylist(), b["clouds"].to_pylist()):
                with store.open_input_file(f"{base}/{file}") as f:
                    points = np.load(io.BytesIO(f.read()), allow_pickle=False)["points"]
                for c in clouds:
                    own = points[c["row"]]
                    n = len(own)
                    columns = [pa.array([c["cloud_id"]] * n, pa.int64()), pa.array([c["split"]] * n, pa.string()), pa.array([c["label"]] * n, pa.int32()), pa.array(np.arange(n)), *(pa.array(np.ascontiguousarray(own[:, k])) for k in range(3))]
                    yield pa.record_batch(columns, ["cloud_id", "split", "label", "place", *AXES])

    return files.mapInArrow(run, "cloud_id long, split string, label int, place long, x double, y double, z double")
