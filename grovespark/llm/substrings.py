"""Exact substring deduplication with a log-structured fingerprint index.

The index is a set of immutable runs of historical window hashes, each bucketed and sorted by anchor: the least 24-word gram of a window, which
equal windows share. A run's row has the hashes of the consecutive windows of one anchor (13 on average), and the first place that
they were met at; so all windows of all documents are in it, at some five bytes each. A batch becomes a run, which is merge-joined with the
history's, bucket by bucket, without moving history: a window repeats if it starts in an earlier document of the batch or of history. Runs are compacted into
one as soon as there are several of a level.

What matches by hash (64 bits of the anchor, 32 of the window) is verified by SHA-256 of the words at both places before it counts.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import new_path
from . import common as C

WINDOW = 50
GRAM = 24
#: Batches of the query; runs of a level that are compacted into one of the next.
BATCHES = 3
FANOUT = 2
NULL_ID = (1 << 63) - 1
CACHE_WORDS = 400_000
#: Odd multipliers of the two polynomial hashes.
BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)


class Hashes(dict):
    """64-bit hashes of words, kept; a worker starts anew when there are too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        p = np.full(n, b, np.uint64)
        p[0] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return out[0], out[1]


class Words:
    """The words of some documents in a row: hashes, and each document's first place."""

    def __init__(self, texts: list[str | None], hashes: Hashes):
        lists = [(t or "").encode().split() for t in texts]
        self.lists, self.sizes = lists, np.fromiter(map(len, lists), np.int64, len(lists))
        self.starts = np.cumsum(self.sizes) - self.sizes
        total = int(self.sizes.sum())
        self.words = np.fromiter((hashes[w] for words in lists for w in words), np.uint64, total)
        self.doc = np.repeat(np.arange(len(lists)), self.sizes)

    def rolled(self, length: int, base: int) -> np.ndarray:
        """The hash of the `length` words from each place on; places too near the end are left out."""
        n = len(self.words)
        if n < length:
            return np.zeros(0, np.uint64)
        up, down = powers(base, n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(self.words * up[:n], out=sums[1:])
        return C.mix64((sums[length:] - sums[:-length]) * down[: n - length + 1])

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(window starts, place of each one's anchor, all gram hashes): all windows that lie within one document."""
        grams = self.rolled(GRAM, BASES[0])
        span = WINDOW - GRAM + 1
        if len(grams) < span:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), grams
        bits = np.uint64(32)  # a chunk has fewer words than 2^32
        least = (C.mix64(grams) >> bits << bits) | np.arange(len(grams), dtype=np.uint64)
        width = 1
        while width * 2 <= span:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < span:
            least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
        starts = np.flatnonzero(self.doc[: len(least)] == self.doc[WINDOW - 1 :])
        return starts, (least[starts] & np.uint64((1 << 32) - 1)).astype(np.int64), grams


def prepared(docs: DataFrame) -> DataFrame:
    """(at, th, doc_id, text): at is the doc_id, or a number after all for null; th the text's hash. Both name a row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("at"), F.xxhash64(text).alias("th"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))


def occurrences(rows: DataFrame, hash_bits: int = 32) -> DataFrame:
    """(a, k, hs, at, th, start, hi): a row for the consecutive windows of each anchor of each row.

    a: the anchor's hash; k: a hash of all; start: the first window's. Within a chunk of texts, the first place of each k has the windows' hashes hs, and hi, the largest
    `at` of that k; others have none. So a passage that many documents share goes to the index once a chunk.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes()
        for b in C.chunks(batches):
            words = Words(b["text"].to_pylist(), hashes)
            starts, place, grams = words.anchors()
            if not len(starts):
                continue
            h = words.rolled(WINDOW, BASES[1])[starts]
            new = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (starts[1:] != starts[:-1] + 1)])
            size = np.diff(np.r_[new, len(starts)])
            a = grams[place[new]]
            inside = np.arange(len(starts)) - np.repeat(new, size)
            k = C.mix64(np.add.reduceat(C.mix64(h + inside.astype(np.uint64) * np.uint64(BASES[0])), new) ^ a)
            doc = words.doc[starts[new]]
            at, th, start = b["at"].to_numpy()[doc], b["th"].to_numpy()[doc], starts[new] - words.starts[doc]
            order = np.lexsort((start, th, at, k))
            lead = np.flatnonzero(np.r_[True, k[order][1:] != k[order][:-1]])
            hi = np.maximum.reduceat(at[order], lead)
            first, top = np.zeros(len(k), bool), np.zeros(len(k), np.int64)
            first[order[lead]], top[order[lead]] = True, hi
            values = (h >> np.uint64(64 - hash_bits)).astype(np.uint32).view(np.int32)[np.repeat(first, size)]
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.where(first, size, 0))].astype(np.int32)), pa.array(values))
            yield pa.record_batch([pa.array(a.view(np.int64)), pa.array(k.view(np.int64)), lists, pa.array(at), pa.array(th), pa.array(start.astype(np.int32)), pa.array(top, mask=~first)], ["a", "k", "hs", "at", "th", "start", "hi"])

    return rows.select("at", "th", "text").mapInArrow(run, "a long, k long, hs array<int>, at long, th long, start int, hi long")


class FingerprintIndex:
    """Runs of (a, k, hs, first, hi), bucketed and sorted by a. first: (at, th, start) of the least document. Levels hold runs; a full level is compacted."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT, hash_bits: int = 32):
        self.spark, self.fanout, self.hash_bits, self.levels = spark, fanout, hash_bits, [[]]
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def write(self, run: DataFrame) -> str:
        """A run as a bucketed table in the shared folder; run is dealt by a already."""
        name = f"run_{uuid.uuid4().hex}"
        run.write.bucketBy(self.buckets, "a").sortBy("a").option("compression", "lz4").option("path", new_path(self.spark, "run")).saveAsTable(name)
        return name

    def drop(self, name: str) -> None:
        files = self.spark.table(name)
        C.remove(files)
        self.spark.sql(f"drop table {name}")

    @staticmethod
    def least(lists: DataFrame) -> DataFrame:
        return lists.groupBy("a", "k").agg(F.first("hs").alias("hs"), F.min("first").alias("first"), F.max("hi").alias("hi"))

    def compact(self) -> None:
        for n, level in enumerate(self.levels):
            if len(level) >= self.fanout:
                merged = self.spark.table(level[0])
                for name in level[1:]:
                    merged = merged.unionByName(self.spark.table(name))
                made = self.write(self.least(merged))
                for name in level:
                    self.drop(name)
                if n + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[n] = []
                self.levels[n + 1].append(made)

    def close(self) -> None:
        for level in self.levels:
            for name in level:
                self.drop(name)
        self.levels = [[]]

    def match(self, rows: DataFrame) -> DataFrame:
        """(at, th, parts) of the rows of prepared() with windows that an earlier document has; then the batch joins the index.

        parts: (s, n, fat, fth, fs), where the n windows from s on equal, by their hashes, those from fs on of the earlier document (fat, fth).
        """
        own = C.materialise(occurrences(rows, self.hash_bits), "occurrences")
        lists = own.where("hi is not null").select("a", "k", "hs", F.struct("at", "th", "start").alias("first"), "hi").repartition(self.buckets, "a")
        batch = self.write(self.least(lists))
        found = self.repeats(batch)
        places = own.select("k", "at", "th", "start").join(found, "k").select("at", "th", "start", F.explode("parts").alias("p")).where("p.fat < at")
        part = F.struct((F.col("start") + F.col("p.i")).alias("s"), F.col("p.n").alias("n"), F.col("p.fat").alias("fat"), F.col("p.fth").alias("fth"), F.col("p.fs").alias("fs"))
        out = C.materialise(places.groupBy("at", "th").agg(F.collect_list(part).alias("parts")), "matches")
        C.remove(own)
        C.remove(found)
        self.levels[0].append(batch)
        self.compact()
        return out

    def repeats(self, batch: str) -> DataFrame:
        """(k, parts): for windows of the batch that start in an earlier document too; parts: (i, n, fat, fth, fs), consecutive windows that go on in one document.

        Runs are joined by anchor where their buckets lie; only what shares its anchor with an earlier document is exploded into windows.
        """
        history = [self.spark.table(r) for level in self.levels for r in level]
        own, anchor = self.spark.table(batch), Window.partitionBy("a")
        own = own.withColumn("lo", F.min("first.at").over(anchor)).withColumn("top", F.max("hi").over(anchor))
        for run in history:
            own = own.join(run.groupBy("a").agg(F.min("first.at").alias("before")), "a", "left").withColumn("lo", F.least("lo", "before")).drop("before")
        own = C.materialise(own.where("lo < top").select("a", "k", "hs", "first", "hi"), "shared")

        def windows(lists: DataFrame, *columns: str) -> DataFrame:
            each = lists.select("a", "first", *columns, F.posexplode("hs").alias("i", "h"))
            return each.withColumn("f", F.struct(F.col("first.at").alias("fat"), F.col("first.th").alias("fth"), (F.col("first.start") + F.col("i")).alias("fs"))).drop("first")

        each = windows(own, "k", "hi").withColumn("f", F.min("f").over(Window.partitionBy("a", "h")))
        anchors = own.select("a").distinct()
        for run in history:
            theirs = windows(run.join(anchors, "a", "left_semi")).groupBy("a", "h").agg(F.min("f").alias("g"))
            each = each.join(theirs, ["a", "h"], "left").withColumn("f", F.least("f", "g")).drop("g")
        each = each.where("f.fat < hi").select("k", "i", "f.fat", "f.fth", (F.col("f.fs") - F.col("i")).alias("shift"))
        keys = ["k", "fat", "fth", "shift"]
        each = each.withColumn("island", F.col("i") - F.row_number().over(Window.partitionBy(*keys).orderBy("i")))
        parts = each.groupBy(*keys, "island").agg(F.min("i").alias("i"), F.count("*").cast("int").alias("n"))
        parts = parts.groupBy("k").agg(F.collect_list(F.struct("i", "n", "fat", "fth", (F.col("shift") + F.col("i")).alias("fs"))).alias("parts"))
        out = C.materialise(parts, "found")
        C.remove(own)
        return out


PART = "struct<s:int,n:int,fat:bigint,fth:bigint,fs:int>"


def cut(rows: DataFrame, parts: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of each row, without the words that verified windows cover.

    parts: what FingerprintIndex.match() found; the earlier documents are among the rows. The words of both places go into a SHA-256; where two differ, the part is taken
    window by window, and single windows that differ are dropped.
    """
    asked = parts.select(F.explode("parts").alias("p")).select(F.col("p.fat").alias("at"), F.col("p.fth").alias("th"), "p.fs", "p.n").distinct().groupBy("at", "th").agg(F.collect_list(F.struct("fs", "n")).alias("asked"))
    work = C.materialise(parts.join(asked, ["at", "th"], "full"), "work")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def digest(words: list[bytes], s: int, n: int) -> bytes:
            return hashlib.sha256(b" ".join(words[s : s + n + WINDOW - 1])).digest()

        for b in C.chunks(batches):
            out = []
            for text, own, wanted in zip(b["text"].to_pylist(), b["parts"].to_pylist(), b["asked"].to_pylist()):
                words = text.encode().split()
                mine = [p | {"sha": digest(words, p["s"], p["n"])} for p in own or []]
                told = [w | {"sha": digest(words, w["fs"], w["n"])} for w in wanted or []]
                n = len(words)
                if mine:
                    marks = np.zeros(n + 1, np.int64)
                    np.add.at(marks, [p["s"] for p in mine], 1)
                    np.add.at(marks, [p["s"] + p["n"] + WINDOW - 1 for p in mine], -1)
                    words = [w for w, m in zip(words, np.cumsum(marks[:n]).tolist()) if m == 0]
                out.append((n, n - len(words), hashlib.sha256(b" ".join(words)).hexdigest(), mine, told))
            columns = [pa.array(x, t) for x, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.string(), MINE, TOLD))]
            yield pa.record_batch([*(b[c] for c in ("doc_id", "at", "th")), *columns], ["doc_id", "at", "th", "n_words", "n_removed", "kept_sha256", "mine", "told"])

    both = rows.join(work, ["at", "th"], "left").select("doc_id", "at", "th", "text", "parts", "asked")
    done = C.materialise(both.mapInArrow(run, f"doc_id long, at long, th long, n_words long, n_removed long, kept_sha256 string, mine array<{PART[:-1]},sha:binary>>, told array<struct<fs:int,n:int,sha:binary>>"), "cut")
    C.remove(work)
    key = ["fat", "fth", "fs", "n", "sha"]
    mine = done.select(F.explode("mine").alias("p")).select(*(f"p.{c}" for c in key)).distinct()
    told = done.select(F.col("at").alias("fat"), F.col("th").alias("fth"), F.explode("told").alias("p")).select("fat", "fth", "p.fs", "p.n", "p.sha").distinct()
    wrong = C.materialise(mine.join(told, key, "left_anti"), "wrong")
    if wrong.isEmpty():
        return done.select("doc_id", "n_words", "n_removed", "kept_sha256")
    again = done.select("at", "th", F.explode("mine").alias("p")).select("at", "th", "p.*").distinct()
    bad = again.join(wrong, key, "left_semi").where("n > 1").select("at", "th", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"), "s", "fat", "fth", "fs")
    singles = bad.select("at", "th", (F.col("s") + F.col("i")).alias("s"), F.lit(1).alias("n"), "fat", "fth", (F.col("fs") + F.col("i")).alias("fs"))
    good = again.join(wrong, key, "left_anti").select("at", "th", "s", "n", "fat", "fth", "fs")
    return cut(rows, C.materialise(good.unionByName(singles).groupBy("at", "th").agg(F.collect_list(F.struct("s", "n", "fat", "fth", "fs")).alias("parts")), "parts"))


MINE = pa.list_(pa.struct([("s", pa.int32()), ("n", pa.int32()), ("fat", pa.int64()), ("fth", pa.int64()), ("fs", pa.int32()), ("sha", pa.binary())]))
TOLD = pa.list_(pa.struct([("fs", pa.int32()), ("n", pa.int32()), ("sha", pa.binary())]))


def deduplicate(docs: DataFrame, batches: int = BATCHES, hash_bits: int = 32) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) for each row of docs, batch after batch by rising doc_id.

    Null and blank texts have no words. Null ids come after all others and not before one another; rows of one doc_id
    don't count as smaller than each other, so that repeated rows are treated alike. Other columns are ignored; an empty
    table gives an empty one. Texts of fewer than 50 words keep all; very long ones are read whole.
    """
    rows = prepared(docs)
    bounds = sorted(set(rows.agg(F.percentile_approx("at", [i / batches for i in range(1, batches)], 1000).alias("q")).first()["q"] or [])) if batches > 1 else []
    index, out = FingerprintIndex(docs.sparkSession, hash_bits=hash_bits), None
    edges = [None, *bounds, None]
    for lo, hi in zip(edges, edges[1:]):
        inside = (F.lit(True) if lo is None else F.col("at") > lo) & (F.lit(True) if hi is None else F.col("at") <= hi)
        found = index.match(rows.where(inside))
        out = found if out is None else out.unionByName(found)
    index.close()
    return cut(rows, out)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All whole documents; null, blank, repeated, tied and very long ones, and an empty table, as in deduplicate()."""
    return deduplicate(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op5_substring_dedup": op5_substring_dedup}
SQL: dict[str, str] = {}
