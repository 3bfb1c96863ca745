"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A sketch has cells of (count, XOR of keys, XOR of check values); each key sits in one cell of each of three thirds.
Sketches of two versions subtract cell by cell; peeling cells that hold one key recovers the digests of the paragraphs
that differ. If some cells stay, both versions are sketched four times as large and peeled again.

A paragraph is a sentence or a line; one of over 64 characters counts as pieces that end, if they can, behind a word that ends in a vowel and one of n, r, s, t: a place
that an insertion elsewhere doesn't move; else of 64. Paragraphs that repeat are numbered, so that a document is a set of keys.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

#: Cells of a third in the stored fingerprint; growth on failure.
THIRD = 8
GROWTH = 4
#: Cells of a third beyond which two documents' sorted keys are compared instead: peeling fails for good where two keys of a document are equal.
LARGEST = 1 << 16
PARAGRAPH = r"[^\n.!?]{0,64}[.!?\n]+|[^\n.!?]{16,128}?[aeiou][nrst] |[^\n.!?]{1,64}"
#: Documents that meet in one window frame, about, and frames at most (their bounds, 16 bytes each, go to all tasks); with more than FRAMES times FRAME_ROWS
#: documents, frames grow, and their sort spills. Quantiles are exact to a fourth of a frame.
FRAME_ROWS = 256
FRAMES = 100_000
NULL_ID = -(1 << 63)


def digests(text: Column) -> Column:
    """64-bit digests of the paragraphs of a text, in order; none for null and empty texts."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PARAGRAPH), F.lit(0)), lambda p: F.xxhash64(p))


def keys_of(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """(document number, key) of all digests; the k-th copy of a digest in a document has a key of its own."""
    values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    lengths = np.diff(lists.offsets.to_numpy()).astype(np.int64)
    doc = np.repeat(np.arange(len(lists)), lengths)
    order = np.lexsort((values, doc))
    doc, values = doc[order], values[order]
    first = np.r_[True, (doc[1:] != doc[:-1]) | (values[1:] != values[:-1])] if len(doc) else np.zeros(0, bool)
    at = np.arange(len(doc))
    copy = at - np.maximum.accumulate(np.where(first, at, 0)) if len(doc) else at
    return doc, C.mix64(values + copy.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def check(keys: np.ndarray) -> np.ndarray:
    return C.mix64(keys ^ np.uint64(0x5851F42D4C957F2D)) & np.uint64(0xFFFFFFFF)


def cells_of(keys: np.ndarray, third: int) -> list[np.ndarray]:
    return [(C.mix64(keys + np.uint64(k + 1)) % np.uint64(third)).astype(np.int64) + k * third for k in range(3)]


class Sketches:
    """Sketches of many documents, each of 3 x third cells."""

    def __init__(self, docs: int, third: int):
        self.third, self.width = third, 3 * third
        self.count, self.key, self.check = np.zeros(docs * self.width, np.int64), np.zeros(docs * self.width, np.uint64), np.zeros(docs * self.width, np.uint64)

    def add(self, doc: np.ndarray, keys: np.ndarray, sign: np.ndarray | int = 1) -> Sketches:
        sums = check(keys)
        for cell in cells_of(keys, self.third):
            at = doc * self.width + cell
            np.add.at(self.count, at, sign)
            np.bitwise_xor.at(self.key, at, keys)
            np.bitwise_xor.at(self.check, at, sums)
        return self

    def text(self, sizes: np.ndarray) -> list[str]:
        """Each document's sketch as base64: the number of its paragraphs, then counts, keys and check values."""
        rows = len(sizes)
        both = np.concatenate([sizes.astype("<u4").view(np.uint8).reshape(rows, 4), self.count.astype("<i4").view(np.uint8).reshape(rows, -1), self.key.astype("<u8").view(np.uint8).reshape(rows, -1), self.check.astype("<u4").view(np.uint8).reshape(rows, -1)], axis=1)
        return [base64.b64encode(row.tobytes()).decode() for row in both]

    def minus(self, other: Sketches) -> Sketches:
        out = Sketches(0, self.third)
        out.count, out.key, out.check = self.count - other.count, self.key ^ other.key, self.check ^ other.check
        return out

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(document, key, sign) of the recovered differences, and whether each document's cells are all empty then. Empties the sketches."""
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for _ in range(self.width * 4):
            at = np.flatnonzero((np.abs(self.count) == 1) & (check(self.key) == self.check))
            if not len(at):
                break
            doc, keys, sign = at // self.width, self.key[at], self.count[at]
            order = np.lexsort((keys, doc))
            doc, keys, sign = doc[order], keys[order], sign[order]
            new = np.r_[True, (doc[1:] != doc[:-1]) | (keys[1:] != keys[:-1])]
            found.append((doc[new], keys[new], sign[new]))
            self.add(doc[new], keys[new], -sign[new])
        left = (self.count != 0) | (self.key != 0) | (self.check != 0)
        whole = ~left.reshape(-1, self.width).any(axis=1)
        doc, keys, sign = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (list(zip(*found)) or [(), (), ()]))
        return doc, keys, sign, whole


def differences(a: pa.ListArray, b: pa.ListArray, third: int = THIRD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pair, key, sign) of the paragraphs that are only in a (+1) or only in b (-1), for each pair of documents, by subtracting and peeling, larger on failure; beyond LARGEST, by comparing keys.

    A key that peeling took out and put back by a chance match of its check value has signs that sum to zero, and isn't counted.
    """
    (doc_a, keys_a), (doc_b, keys_b) = keys_of(a), keys_of(b)
    todo, out = np.arange(len(a)), []
    while len(todo) and third <= LARGEST:
        place = np.full(len(a), -1)
        step = max(1, 2_000_000 // (3 * third))
        failed = []
        for lo in range(0, len(todo), step):
            part = todo[lo : lo + step]
            place[:] = -1
            place[part] = np.arange(len(part))
            ina, inb = place[doc_a] >= 0, place[doc_b] >= 0
            left = Sketches(len(part), third).add(place[doc_a[ina]], keys_a[ina])
            right = Sketches(len(part), third).add(place[doc_b[inb]], keys_b[inb])
            doc, keys, sign, whole = left.minus(right).peel()
            ok = whole[doc] if len(doc) else np.zeros(0, bool)
            out.append(net(part[doc[ok]], keys[ok], sign[ok]))
            failed.append(part[~whole])
        todo, third = np.concatenate(failed), third * GROWTH
    for i in todo.tolist():
        ka, kb = keys_a[doc_a == i], keys_b[doc_b == i]
        out.append(net(np.full(len(ka) + len(kb), i), np.concatenate([ka, kb]), np.repeat([1, -1], [len(ka), len(kb)])))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64))


def net(pair: np.ndarray, keys: np.ndarray, sign: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The keys of each pair whose signs don't sum to zero, each as often as its sum."""
    if not len(pair):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    order = np.lexsort((keys, pair))
    pair, keys, sign = pair[order], keys[order], sign[order]
    new = np.flatnonzero(np.r_[True, (pair[1:] != pair[:-1]) | (keys[1:] != keys[:-1])])
    sums = np.add.reduceat(sign, new)
    return np.repeat(pair[new], np.abs(sums)), np.repeat(keys[new], np.abs(sums)), np.repeat(np.sign(sums), np.abs(sums))


def likeness(a: pa.ListArray, b: pa.ListArray) -> np.ndarray:
    """Twice the common paragraphs by all paragraphs of both; 1 where neither has any."""
    pair, _, _ = differences(a, b)
    total = np.diff(a.offsets.to_numpy()) + np.diff(b.offsets.to_numpy())
    return np.where(total > 0, 1 - np.bincount(pair, minlength=len(a)) / np.maximum(total, 1), 1.0)


def sketch_texts(lists: pa.ListArray, third: int = THIRD) -> list[str]:
    return Sketches(len(lists), third).add(*keys_of(lists)).text(np.diff(lists.offsets.to_numpy()))


def compact(column: pa.Array) -> pa.ListArray:
    """The lists of a slice, with offsets from 0 and no nulls."""
    return pa.array(column.to_numpy(zero_copy_only=False), pa.list_(pa.int64())) if column.offset or column.null_count else column


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text, next): next is the text of the following document by falling doc_id; after the last, the first.

    Texts are shuffled once: rows are dealt to frames of consecutive ids by quantiles of doc_id, and each frame's first
    row is copied to the frame before it. Null ids come last; rows with one id are in the order of their text's falling hash, and an id
    with more rows than a frame holds is parted by it; rows that are equal in both are copies of one another. Columns of docs may have any names.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ids = rows.select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("at"), F.xxhash64("text").alias("th"))
    frames = max(1, min(FRAMES, math.ceil(ids.count() / FRAME_ROWS)))
    marks = [i / frames for i in range(1, frames)]
    found = sorted((ids.agg(F.percentile_approx("at", marks, max(10_000, 4 * frames)).alias("q")).first()["q"] or []) if marks else [])
    marks_at, times = np.unique(np.array(found, np.int64), return_counts=True)
    # the bound of an id is the last of its rows; one that is met m times is parted into m ranges of the hash, of equal width
    steps = [(1 << 64) // int(m) for m in times]
    at_bound = np.repeat(marks_at, times)
    th_bound = np.array([min((1 << 63) - 1, -(1 << 63) + (k + 1) * w) for w, m in zip(steps, times) for k in range(m)], np.int64)
    place = np.arange(len(at_bound))

    def frame_of(at: np.ndarray, th: np.ndarray) -> np.ndarray:
        """The number of bounds before (at, th)."""
        lo, hi = np.searchsorted(at_bound, at), np.searchsorted(at_bound, at, side="right")
        out = lo.copy()
        inside = np.flatnonzero(hi > lo)
        for a in np.unique(at[inside]).tolist():
            mine = inside[at[inside] == a]
            first = lo[mine[0]]
            out[mine] = first + np.searchsorted(th_bound[place[first : hi[mine[0]]]], th[mine])
        return out

    def frame(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([pa.array(frame_of(b["at"].to_numpy(), b["th"].to_numpy())), b["at"], b["th"]], ["frame", "at", "th"])

    tops = sorted((r["frame"], r["top"]["at"], r["top"]["th"]) for r in ids.mapInArrow(frame, "frame long, at long, th long").groupBy("frame").agg(F.max(F.struct("at", "th")).alias("top")).collect())  # one row a frame
    own, top, top_th = (np.array(x, np.int64) for x in (zip(*tops) if tops else ([], [], [])))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[int] = set()
        for big in batches:
            for b in C.chunks([big]):
                at = np.where(b["doc_id"].is_null().to_numpy(zero_copy_only=False), NULL_ID, b["doc_id"].fill_null(0).to_numpy())
                th = b["th"].to_numpy()
                mine = np.searchsorted(own, frame_of(at, th))
                heads = []
                for i in np.flatnonzero((top[mine] == at) & (top_th[mine] == th)).tolist():
                    if mine[i] not in sent:  # a copy for each task at most
                        sent.add(int(mine[i]))
                        heads.append(i)
                heads = np.array(heads, np.int64)
                both = np.concatenate([np.arange(b.num_rows), heads])
                to = np.concatenate([own[mine], own[(mine[heads] + 1) % len(own)]])  # the frame of larger ids; after the largest, the smallest
                copy = np.repeat([False, True], [b.num_rows, len(heads)])
                more = b.take(pa.array(both))
                yield pa.record_batch([pa.array(to), pa.array(copy), more["doc_id"], more["th"], more["text"]], ["frame", "copy", "doc_id", "th", "text"])

    dealt = rows.withColumn("th", F.xxhash64("text")).mapInArrow(deal, "frame long, copy boolean, doc_id long, th long, text string")
    order = "partition by frame order by copy, doc_id desc nulls last, th desc, text"
    return dealt.withColumn("next", F.expr(f"lead(text) over ({order})")).where("not copy").select("doc_id", "text", "next")


def compare(pairs: DataFrame) -> DataFrame:
    """From (doc_id, n_chars, edited_sha256, own, edited, next), the last three lists of digests: fingerprints and likenesses."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for lo in range(0, big.num_rows, 1024):
                b = big.slice(lo, 1024)
                own, edited, after = (compact(b[c]) for c in ("own", "edited", "next"))
                columns = [b["doc_id"], b["n_chars"], b["edited_sha256"], pa.array(sketch_texts(own)), pa.array(sketch_texts(edited)), pa.array(likeness(own, edited)), pa.array(likeness(own, after))]
                yield pa.record_batch(columns, ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return pairs.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated rows stay; a null text is empty; a null doc_id comes last; a single document follows itself; an empty table gives an empty one."""
    both = with_next(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    n = F.char_length("text").cast("long")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), (n - half).cast("int")), F.substring("next", F.lit(1), half))
    return compare(both.select("doc_id", n.alias("n_chars"), "text", edited.alias("edited"), "next").select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), digests(F.col("text")).alias("own"), digests(F.col("edited")).alias("edited"), digests(F.col("next")).alias("next")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op1_fingerprints": op1_fingerprints}
SQL: dict[str, str] = {}
