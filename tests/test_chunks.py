"""Chunks and their manifest: all at once or not at all, moves as versions, one of two writers."""

import threading
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from grovespark.operators import labels
from grovespark.sources import chunks, manifest

N = 5


def cloud_rows(ids, n=N):
    return [("train" if c % 3 else "test", c, c % 17, i, float(c), float(i), c * 0.5 + i) for c in ids for i in range(n + (c % 10 == 7))]


def points(spark, rows):
    return spark.createDataFrame(rows, "split string, cloud_id long, label int, point_id long, x double, y double, z double").repartition(4)


@pytest.fixture
def folder(tmp_path):
    return tmp_path / "c", f"file://{tmp_path}/c"


def stored(spark, uri, version=None):
    return {(r["cloud_id"], r["split"], r["label"], r["place"], r["x"], r["y"], r["z"]) for r in chunks.read(spark, uri, version).collect()}


def as_stored(rows):
    return {(c, s, y, i, *xyz) for s, c, y, i, *xyz in rows if c % 10 != 7}


def test_chunks_round_trip_and_rejects(spark, folder):
    path, uri = folder
    rows = cloud_rows(range(100))
    left = chunks.write(points(spark, rows), uri, N, size=7)
    assert {(r["cloud_id"], r["n"]) for r in left.collect()} == {(c, N + 1) for c in range(7, 100, 10)}
    assert stored(spark, uri) == as_stored(rows) and manifest.versions(uri) == [1]
    sizes = {(r["split"], r["chunk_id"]): r["n"] for r in manifest.entries(spark, uri).groupBy("split", "chunk_id").agg(F.count("*").alias("n")).collect()}
    for split in ("train", "test"):
        own = [sizes[k] for k in sorted(sizes) if k[0] == split]
        assert own[:-1] == [7] * (len(own) - 1) and 0 < own[-1] <= 7
    assert len(list((path / "data").iterdir())) == len(sizes)
    more = cloud_rows(range(200, 220))
    chunks.write(points(spark, more), uri, N)
    assert stored(spark, uri) == as_stored(rows + more) and stored(spark, uri, 1) == as_stored(rows)


def test_a_failing_task_leaves_nothing(spark, folder):
    path, uri = folder
    rows = cloud_rows(range(6))
    chunks.write(points(spark, rows), uri, N)
    before = {f.name for f in (path / "data").iterdir()}
    bad = points(spark, [("train", 900 + k, 1, i, 0.0, 0.0, 0.0) for k in range(3) for i in range(N)]).withColumn("chunk_id", F.col("cloud_id"))
    bad = bad.where("not (cloud_id = 902 and point_id = 0)").repartitionByRange(3, "cloud_id").sortWithinPartitions("cloud_id", "point_id")
    with pytest.raises(Exception, match="has 4 points of 5"):
        bad.select("split", "chunk_id", "cloud_id", "label", "point_id", "x", "y", "z").write.format("chunks").mode("append").option("nPoints", N).save(uri)
    assert manifest.versions(uri) == [1] and stored(spark, uri) == as_stored(rows)
    manifest.collect(spark, uri)  # a task that was under way as the write was aborted may have added a file
    assert {f.name for f in (path / "data").iterdir()} == before


def test_moves_are_versions(spark, folder):
    path, uri = folder
    rows = cloud_rows(range(40))
    chunks.write(points(spark, rows), uri, N)
    swap = lambda e: e.withColumn("label", F.when(F.col("label") == 3, 4).when(F.col("label") == 4, 3).otherwise(F.col("label")).cast("int"))
    assert manifest.change(spark, uri, swap) == 2
    moves = lambda e: labels.rebalanced(e.select("cloud_id", "split"), (0.5, 0.25, 0.25)).select("cloud_id", F.col("new_split").alias("split"))
    assert manifest.change(spark, uri, lambda e: manifest.moved(e, moves(e), "cloud_id", "split")) == 3
    gone = spark.createDataFrame([(5, None), (6, None), (777, "test")], "cloud_id long, split string")
    assert manifest.change(spark, uri, lambda e: manifest.moved(e, gone, "cloud_id", "split")) == 4
    at = lambda v: {r[0]: (r[1], r[2]) for r in stored(spark, uri, v)}
    swapped = {3: 4, 4: 3}
    assert at(1) == {c: (s, y) for c, s, y, *_ in as_stored(rows)}
    assert at(2) == {c: (s, swapped.get(y, y)) for c, (s, y) in at(1).items()}
    shares = [sum(s == k for s, _ in at(3).values()) / len(at(3)) for k in ("train", "test", "val")]
    assert max(abs(a - b) for a, b in zip(shares, (0.5, 0.25, 0.25))) < 0.03 and at(3).keys() == at(2).keys()
    assert at(4) == {c: v for c, v in at(3).items() if c not in (5, 6)}


def test_one_of_two_writers_wins(spark, folder):
    path, uri = folder
    chunks.write(points(spark, cloud_rows(range(12))), uri, N)
    out = []

    def relabel(k):
        try:
            out.append(manifest.change(spark, uri, lambda e: e.withColumn("label", F.lit(k).cast("int")), parent=1))
        except manifest.Conflict:
            out.append("conflict")

    both = [threading.Thread(target=relabel, args=(k,)) for k in (50, 60)]
    for t in both:
        t.start()
    for t in both:
        t.join()
    assert sorted(map(str, out)) == ["2", "conflict"] and manifest.versions(uri) == [1, 2]
    assert {r[2] for r in stored(spark, uri)} in ({50}, {60}) and len(list((path / "_entries").iterdir())) == len(manifest.described(uri, 1)["entries"]) + 1
    before = {f.name for f in (path / "data").iterdir()}
    with pytest.raises(Exception, match="version 2"):
        chunks.write(points(spark, cloud_rows(range(50, 60))), uri, N, parent=1)
    assert manifest.versions(uri) == [1, 2] and {f.name for f in (path / "data").iterdir()} == before


def test_collecting_old_files(spark, folder):
    path, uri = folder
    chunks.write(points(spark, cloud_rows(range(12))), uri, N, size=3)
    manifest.change(spark, uri, lambda e: e.where("split = 'test'"))
    files = len(list((path / "data").iterdir()))
    assert manifest.collect(spark, uri, keep=2) == []
    gone = manifest.collect(spark, uri)
    assert gone and len(list((path / "data").iterdir())) == files - len(gone) and manifest.versions(uri) == [2]
    assert {r[1] for r in stored(spark, uri)} == {"test"}
    with pytest.raises(FileNotFoundError):
        manifest.entries(spark, f"{uri}-none")
    assert len(list(Path(path / "_entries").iterdir())) == 1
