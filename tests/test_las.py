"""LAS files: made by hand and by the writer, whole and broken."""

import struct
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from grovespark.sources import las


def by_hand(points, minor=2, point_format=3, extra=b"", descriptors=b"", wkt=None, base=34):
    """A file of (x, y, z) integers at scale 0.5 and offset (10, 20, 30), with classes 0, 1, ..., put together field by field."""
    more = b""
    for user, number, content in [(b"LASF_Spec", 4, descriptors), (b"LASF_Projection", 2112, wkt)]:
        if content:
            more += b"\0\0" + user.ljust(16, b"\0") + struct.pack("<HH", number, len(content)) + b"\0" * 32 + content
    size = 375 if minor == 4 else 227
    head = bytearray(size)
    head[0:4], head[24], head[25] = b"LASF", 1, minor
    struct.pack_into("<HIIBH", head, 94, size, size + len(more), bool(descriptors) + bool(wkt), point_format, base + len(extra))
    struct.pack_into("<I", head, 107, 0 if minor == 4 else len(points))
    struct.pack_into("<6d", head, 131, 0.5, 0.5, 0.5, 10, 20, 30)
    if minor == 4:
        struct.pack_into("<Q", head, 247, len(points))
    body = b""
    for k, p in enumerate(points):
        record = bytearray(base)
        struct.pack_into("<3iH", record, 0, *p, 7 * k)
        record[16 if point_format >= 6 else 15] = k
        body += bytes(record) + extra
    return bytes(head) + more + body


def described(kind, name, options=0, scale=0.0, offset=0.0):
    d = bytearray(192)
    d[2], d[3] = kind, options
    d[4 : 4 + len(name)] = name
    struct.pack_into("<d", d, 112, scale)
    struct.pack_into("<d", d, 136, offset)
    return bytes(d)


@pytest.fixture
def folder(tmp_path):
    return tmp_path, f"file://{tmp_path}"


@pytest.mark.parametrize("point_format", sorted(las.FORMATS))
def test_formats_by_hand(spark, folder, point_format):
    path, uri = folder
    extra = struct.pack("<3xhI", -4, 77)
    descriptors = described(0, b"", 3) + described(4, b"girth", 8 | 16, 0.25, 100.0) + described(5, b"treeID")
    data = by_hand([(2, -4, 6), (0, 0, 1), (5, 5, 5)], 4 if point_format > 5 else 2, point_format, extra, descriptors, b'PROJCS["x"]\0', las.FORMATS[point_format][0])
    (path / "a.las").write_bytes(data)
    rows = las.read(spark, uri, "point_id long, x double, y double, z double, classification int, intensity int, treeID long, girth double, crs string").orderBy("point_id").collect()
    assert [tuple(r) for r in rows] == [(k, *xyz, k, 7 * k, 77, 99.0, 'PROJCS["x"]') for k, xyz in enumerate([(11.0, 18.0, 33.0), (10.0, 20.0, 30.5), (12.5, 22.5, 32.5)])]


def test_broken_files_are_listed(spark, folder):
    path, uri = folder
    good = by_hand([(1, 2, 3)] * 5)
    for name, data in {"good": good, "empty": b"", "text": b"no points here" * 40, "cut": good[:-1], "packed": good[:104] + bytes([good[104] | 0x80]) + good[105:], "odd": good[:104] + bytes([9]) + good[105:], "head": good[:100]}.items():
        (path / f"{name}.las").write_bytes(data)
    (path / "other.txt").write_bytes(b"x")
    assert las.read(spark, uri).groupBy().agg(F.count("*"), F.countDistinct("path")).first() == (5, 1)
    why = {r["path"].rsplit("/", 1)[1]: r["reason"] for r in las.rejects(spark, uri).collect()}
    assert set(why) == {"empty.las", "text.las", "cut.las", "packed.las", "odd.las", "head.las"} and why["packed.las"] == "compressed points"
    heads = las.read(spark, uri, kind="headers").collect()
    assert [(r["points"], r["point_format"], r["crs"]) for r in heads] == [(5, 3, None)]


def test_missing_dimensions_and_systems_are_errors(spark, folder):
    path, uri = folder
    (path / "a.las").write_bytes(by_hand([(1, 2, 3)]))
    with pytest.raises(Exception, match="has no dimension treeID"):
        las.read(spark, uri, "x double, treeID long").collect()
    with pytest.raises(Exception, match="has no coordinate system"):
        las.read(spark, uri, "x double, crs string").collect()
    with pytest.raises(Exception, match="nowhere"):
        las.read(spark, f"{uri}/nowhere").collect()


def test_ranges_take_each_record_once(spark, folder):
    path, uri = folder
    draw = np.random.default_rng(0)
    xyz = draw.uniform(-900, 900, (20_000, 3))
    (path / "big.las").write_bytes(las.encoded(xyz, {"treeID": np.arange(20_000, dtype="u4")}, crs="EPSG:2180"))
    (path / "none.las").write_bytes(las.encoded(np.zeros((0, 3)), {}))
    for k in range(5):
        (path / f"s{k}.las").write_bytes(las.encoded(xyz[:3], {"treeID": np.arange(3, dtype="u4")}))
    df = las.read(spark, uri, "path string, point_id long, x double, y double, z double, treeID long", split_bytes=10_007)
    assert df.rdd.getNumPartitions() > 60
    big = df.where("path like '%big.las'")
    assert big.select(F.spark_partition_id()).distinct().count() > 60
    rows = sorted(map(tuple, big.drop("path").collect()))
    assert [r[0] for r in rows] == list(range(20_000)) == [r[4] for r in rows]
    assert np.abs(np.array([r[1:4] for r in rows]) - xyz).max() <= 0.0005 + 1e-9
    assert df.where("path not like '%big.las'").count() == 15
    assert las.rejects(spark, uri).count() == 0
    assert [sum(e - b for _, _, b, e in r) <= 10 for r in las.ranges_of([("a", 25), ("b", 3), ("c", 0), ("d", 2)], 10)] == [True] * 3


def test_writer_deals_large_plots_to_files(spark, folder):
    path, uri = folder
    rows = [(None if i % 7 == 0 else f"p{i % 2}", float(i % 100), float(-i), 0.25 * i, i) for i in range(3000)]
    df = spark.createDataFrame(rows, "plot string, x double, y double, z double, treeID long").repartition(5)
    n = las.write(df, uri, "plot", {"treeID": "u4"}, most=500)
    files = list(path.glob("*.las"))
    assert len(files) == n >= 6 and not list(path.glob(".*.las.*"))
    got = las.read(spark, uri, "path string, x double, y double, z double, treeID long")
    key = F.regexp_extract("path", "/([^/-]*)-[^/]*$", 1)
    assert Counter((r[0], *r[1:]) for r in got.select(key, "x", "y", "z", "treeID").collect()) == Counter((str(p), x, y, z, t) for p, x, y, z, t in rows)
    assert max(r["points"] for r in las.read(spark, uri, kind="headers").collect()) <= 500
    before = {f.name: f.read_bytes() for f in files}
    las.write(df.repartition(2), uri, "plot", {"treeID": "u4"}, most=500)
    assert before == {f.name: f.read_bytes() for f in path.glob("*.las")}
