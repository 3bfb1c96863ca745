"""A Spark data source of inventory features behind a paged HTTP interface: a partition for each box, pages by their `next` link.

    spark.dataSource.register(Features)
    spark.read.format("features").option("url", ...).option("boxes", "0,0,10,10;10,0,20,10").load()
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class Box(InputPartition):
    def __init__(self, number: int, box: str):
        super().__init__(number)
        self.number, self.box = number, box


class Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.url, self.limit, self.timeout = options["url"], int(options.get("limit", 1000)), float(options.get("timeout", 60))
        self.retries, self.pause = int(options.get("retries", 3)), float(options.get("pause", 0.5))
        self.boxes = [b for b in options.get("boxes", "").split(";") if b]

    def partitions(self) -> list[Box]:
        return [Box(i, b) for i, b in enumerate(self.boxes)] or [Box(0, "")]

    def page(self, url: str) -> dict:
        """A page; asked again, after longer and longer pauses, if the server is busy, fails or can't be reached."""
        for left in range(self.retries, -1, -1):
            try:
                with urllib.request.urlopen(url, timeout=self.timeout) as answer:
                    return json.load(answer)
            except urllib.error.HTTPError as e:
                if not left or e.code < 500 and e.code != 429:
                    raise
            except (urllib.error.URLError, TimeoutError, ConnectionError):
                if not left:
                    raise
            time.sleep(self.pause * 2 ** (self.retries - left))
        raise AssertionError

    def read(self, partition: Box) -> Iterator[tuple]:
        """An answer of status 400 or more fails the task, one of 429 or 500 or more after all retries. Only the first page's request has parameters: links hold theirs."""
        asked = {"limit": self.limit} | ({"bbox": partition.box} if partition.box else {})
        url: str | None = f"{self.url}?{urllib.parse.urlencode(asked)}"
        place = 0
        while url:
            page = self.page(url)
            for feature in page.get("features") or []:
                properties = feature.get("properties") or {}
                yield partition.number, place, properties.get("species_cd"), properties.get("region_name")
                place += 1
            after = next((k["href"] for k in page.get("links") or [] if k.get("rel") == "next"), None)
            url = urllib.parse.urljoin(url, after) if after else None


class Features(DataSource):
    """(tile, place, species_cd, region_name): tile is the box's number; place orders its features."""

    @classmethod
    def name(cls) -> str:
        return "features"

    def schema(self) -> str:
        return "tile int, place long, species_cd string, region_name string"

    def reader(self, schema) -> Reader:  # noqa: ARG002
        return Reader(dict(self.options))
