"""Cloud files, sinks and the paged source."""

import http.server
import io
import json
import threading
import urllib.parse

import numpy as np
import pytest

from grovespark.operators import evaluate, views
from grovespark.session import new_path
from grovespark.sources import clouds, sinks
from grovespark.sources.features import Features

SCHEMA = "cloud_id long, label int, x double, y double, z double, other string"


def test_large_clouds_are_written_in_parts(spark, tmp_path):
    rows = [(1, 3, float(i), 0.0, 0.0, "") for i in range(95)] + [(1, 3, 5.0, 5.0, 5.0, "")] * 40 + [(2, None, 1.0, 2.0, 3.0, "")]
    folder = f"file://{tmp_path}/out"
    n = clouds.write(spark.createDataFrame(rows, SCHEMA), folder, 20)
    files = list((tmp_path / "out").glob("*.npy"))
    assert len(files) == n and all(len(np.load(f)) <= 20 for f in files) and (tmp_path / "out" / "2-0-0_15.npy").exists()
    back = clouds.read(spark, folder).collect()
    assert sorted((r["x"], r["y"], r["z"]) for r in back) == sorted(r[2:5] for r in rows)


def test_no_rows_and_bad_files(spark, tmp_path):
    assert clouds.write(spark.createDataFrame([], SCHEMA), f"file://{tmp_path}/none") == 0
    good, flat = io.BytesIO(), io.BytesIO()
    np.save(good, np.ones((2, 4)))
    np.save(flat, np.ones(5))
    files = [("a_1.npy", good.getvalue()), ("b_1.npy", b"junk"), ("c_1.npy", flat.getvalue()), ("d_1.npy", None), ("e_1.npy", b"")]
    got = clouds.decoded(spark.createDataFrame(files, "path string, content binary")).collect()
    assert [(r["path"], r["point_id"], r["z"]) for r in got] == [("a_1.npy", 0, 1.0), ("a_1.npy", 1, 1.0)]
    why = {r["path"]: r["reason"] for r in clouds.rejected(spark.createDataFrame(files, "path string, content binary")).collect()}
    assert set(why) == {"b_1.npy", "c_1.npy", "d_1.npy", "e_1.npy"} and why["c_1.npy"] == "an array of shape (5,)"


def test_folders_are_listed_by_tasks(spark, tmp_path):
    """As by Spark's binary source, whose list is on the driver: deep folders, hidden names, patterns, paths."""
    for place in ("1_2.npy", "a b/2_2.npy", "a b/c%20d/3_2.npy", "k=1/4_2.npy", "_k=1/5_2.npy", "_no/6_2.npy", ".no/7_2.npy", "_8_2.npy", "9_2.NPY", "10_2.txt"):
        (tmp_path / "out" / place).parent.mkdir(parents=True, exist_ok=True)
        np.save(f := io.BytesIO(), np.full((2, 3), float(len(place))))
        (tmp_path / "out" / place).write_bytes(b"junk" if place == "k=1/4_2.npy" else f.getvalue())
    (tmp_path / "out" / "none").mkdir()
    folder = f"file://{tmp_path}/out"
    for pattern in ("*.npy", "?_2.npy", "{1,3}_2.npy", "x*"):
        got, files = clouds.read(spark, folder, pattern), clouds.files_of(spark, folder, pattern)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, clouds.decoded(files).collect()))
        assert sorted(map(tuple, clouds.rejects(spark, folder, pattern).collect())) == sorted(map(tuple, clouds.rejected(files).collect()))
        assert ("binaryFile" in got._jdf.queryExecution().executedPlan().toString()) == ("{" in pattern)
    assert clouds.read(spark, folder).count() == 8 and clouds.rejects(spark, folder).count() == 1
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        clouds.read(spark, f"{folder}/absent").collect()


def test_many_files_go_to_folders(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(clouds, "FOLDER_FILES", 5)
    rows = [(c, c % 3, float(c), float(i), 0.0, "") for c in range(40) for i in range(3)]
    folder = f"file://{tmp_path}/out"
    assert clouds.write(spark.createDataFrame(rows, SCHEMA), folder, 20) == 40 and not list((tmp_path / "out").glob("*.npy"))
    assert 1 < len(list((tmp_path / "out").iterdir())) <= 8 and all(len(list(d.iterdir())) < 20 for d in (tmp_path / "out").iterdir())
    assert sorted((r["x"], r["y"], r["z"]) for r in clouds.read(spark, folder).collect()) == sorted(r[2:5] for r in rows)


def test_lines(spark, tmp_path):
    (tmp_path / "species.txt").write_text("Abies\n\nPinus\n")
    assert [r["species"] for r in sinks.lines(spark, f"file://{tmp_path}/species.txt").collect()] == ["Abies", "Pinus"]


def test_csv_keeps_types(spark):
    path = new_path(spark, "csv")
    sinks.write_csv(spark.createDataFrame([(1, "a,b"), (2, None)], "n int, s string"), path)
    assert sorted(map(tuple, sinks.read_csv(spark, path, "n int, s string").collect())) == [(1, "a,b"), (2, None)]


class Pages(http.server.BaseHTTPRequestHandler):
    def do_GET(self):  # noqa: N802
        url = urllib.parse.urlsplit(self.path)
        asked = dict(urllib.parse.parse_qsl(url.query))
        if asked.get("bbox") == "bad":
            return self.send_error(500)
        if asked.get("bbox") == "busy":
            self.server.seen = getattr(self.server, "seen", 0) + 1
            if self.server.seen < 3:
                return self.send_error(429 if self.server.seen == 1 else 503)
        if asked.get("bbox") == "gone":
            self.server.gone = getattr(self.server, "gone", 0) + 1
            return self.send_error(404)
        page = int(asked.get("page", 0))
        box = asked.get("bbox") or asked["of"]
        links = [{"rel": "next", "href": f"/items?page={page + 1}&of={box}"}] if page < 2 else [{"rel": "self", "href": "x"}]
        body = json.dumps({"features": [{"properties": {"species_cd": f"{box}-{page}", "region_name": "r"}}], "links": links}).encode()
        self.send_response(200)
        self.end_headers()
        self.wfile.write(body)

    def log_message(self, *_):
        pass


def test_paged_features(spark):
    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Pages)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    spark.dataSource.register(Features)
    read = spark.read.format("features").option("url", f"http://127.0.0.1:{server.server_port}/items")
    got = sorted(map(tuple, read.option("boxes", "p;q").load().collect()))
    assert got == [(t, k, f"{b}-{k}", "r") for t, b in enumerate("pq") for k in range(3)]
    read = read.option("pause", "0.01")
    assert len(read.option("boxes", "busy").load().collect()) == 3 and server.seen == 3
    with pytest.raises(Exception, match="500"):
        read.option("boxes", "bad").load().collect()
    with pytest.raises(Exception, match="404"):
        read.option("boxes", "gone").load().collect()
    assert server.gone == 1
    server.shutdown()


def test_clouds_without_pixels_are_bad(spark):
    points = spark.createDataFrame([(1, 0.0, 0.0, 0.0), (1, 1.0, 2.0, 3.0)], "cloud_id long, x double, y double, z double")
    names = spark.createDataFrame([(1,), (2,)], "cloud_id long")
    got = {r["cloud_id"]: r for r in evaluate.classified(names, views.project(points, 8), 8, evaluate.view_means).collect()}
    assert got[2]["pred"] == 15 and got[2]["logits"] is None and len(got[1]["logits"]) == 5
