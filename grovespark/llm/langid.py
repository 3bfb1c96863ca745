"""Language identification with language-bitmask n-gram filters.

A bit-sliced Bloom filter has a bitmask of languages in each slot. The AND of the slots of an n-gram gives at once all
languages whose filter holds it. A text's n-grams are counted by language bit (popcounts); the count expected from
false positives, by the language's share of set slots, is taken out; the largest share decides.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

#: Slots of the filter (a power of two) and slots an n-gram sets: 8 MB for each 64 languages, whatever the input's size.
SLOTS = 1 << 20
HASHES = 2
#: Labelled documents that the filters are fitted on at most (the first by a hash of their id).
FIT_ROWS = 20_000
#: An n-gram is in a language's filter if it makes up this share of the language's n-grams, occurs twice, and its share is
#: at least this part of the largest share that it has in a language, so that stray passages set no bits.
LEAST_SHARE = 2e-6
LEAST_PART = 0.2
FOLDS = 5


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def trigrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, trigram) for each letter of the lower-cased texts: it and its neighbours, a non-letter being 0. 21 bits for each."""
    lower = [(t or "").lower() for t in texts]
    points = np.frombuffer(("\n".join(lower) + "\n").encode("utf-32-le", "replace"), np.uint32)
    own = np.repeat(np.arange(len(lower)), np.fromiter(map(len, lower), np.int64, len(lower)) + 1)
    kept = np.where(letters()[points], points, 0).astype(np.uint64)
    at = np.flatnonzero(kept)
    padded = np.concatenate([np.zeros(1, np.uint64), kept, np.zeros(1, np.uint64)])
    return own[at], padded[at] << np.uint64(42) | padded[at + 1] << np.uint64(21) | padded[at + 2]


def slots_of(grams: np.ndarray) -> list[np.ndarray]:
    mixed = C.mix64(grams)
    return [(mixed >> np.uint64(20 * k) & np.uint64(SLOTS - 1)).astype(np.int64) for k in range(HASHES)]


class Filters:
    """names: the languages in order; masks: planes x SLOTS bitmasks, 64 languages a plane."""

    def __init__(self, names: list[str], masks: np.ndarray):
        self.names, self.masks = names, masks
        self.fill = np.array([((masks[i // 64] >> np.uint64(i % 64)) & np.uint64(1)).mean() for i in range(len(names))])

    def contains(self, grams: np.ndarray) -> np.ndarray:
        """Bitmask planes of the languages that hold each n-gram."""
        first, *rest = slots_of(grams)
        found = self.masks[:, first]
        for s in rest:
            found &= self.masks[:, s]
        return found

    def shares(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(texts x languages shares corrected for false positives, n-grams of each text)."""
        own, grams = trigrams(texts)
        counts = np.bincount(own, minlength=len(texts)).astype(float)
        found, out = self.contains(grams), np.zeros((len(texts), len(self.names)))
        for i in range(len(self.names)):
            bit = (found[i // 64] >> np.uint64(i % 64) & np.uint64(1)).astype(np.float64)
            hits = np.bincount(own, bit, minlength=len(texts))
            wrong = self.fill[i] ** HASHES
            out[:, i] = (hits - counts * wrong) / max(1 - wrong, 1e-9)
        return np.clip(out / np.maximum(counts, 1)[:, None], 0, 1), counts


def even(sizes: list[int], rows: int) -> int:
    """How many rows of each language there may be: what the small ones, which come first, leave of `rows` is shared evenly."""
    for i, n in enumerate(sizes):
        most = max(1, rows // (len(sizes) - i))
        if n > most:
            break
        rows -= n
    return most


def fit(labelled: DataFrame, rows: int = FIT_ROWS) -> Filters:
    """Filters from (doc_id, text, lang). Rows without lang are not used; of more than `rows`, the first by hash of each language are, so that a rare one keeps its examples."""
    usable = labelled.where("lang is not null and text is not null").select(F.xxhash64("doc_id", "text").alias("h"), "text", F.col("lang").cast("string").alias("lang"))
    sizes = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().collect()}
    names = sorted(sizes)
    if not names:
        return Filters([], np.zeros((1, SLOTS), np.uint64))
    if sum(sizes.values()) > rows:
        most = even(sorted(sizes.values()), rows)
        below = {n: int((most / size * 2 - 1) * 2**63) for n, size in sizes.items() if size > most}
        limit = F.element_at(F.create_map(*(F.lit(x) for pair in below.items() for x in pair)), F.col("lang"))
        usable = usable.where(~F.col("lang").isin(list(below)) | (F.col("h") < limit))
    number = {n: i for i, n in enumerate(names)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in C.chunks(batches):
            lang = np.array([number[x] for x in b["lang"].to_pylist()], np.int64)
            own, grams = trigrams(b["text"].to_pylist())
            for i in np.unique(lang).tolist():
                values, n = np.unique(grams[lang[own] == i], return_counts=True)
                yield pa.record_batch([pa.array(np.full(len(values), i, np.int32)), pa.array(values.view(np.int64)), pa.array(n)], ["lang", "gram", "n"])

    counts = C.materialise(usable.mapInArrow(count, "lang int, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")), "ngrams")
    sums = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    share = F.col("n") / F.element_at(F.create_map(*(F.lit(x) for pair in sums.items() for x in pair)), F.col("lang"))
    most = counts.groupBy("gram").agg(F.max(share).alias("most"))
    telling = counts.join(most, "gram").where((F.col("n") >= 2) & (share >= LEAST_SHARE) & (share >= LEAST_PART * F.col("most"))).select("lang", "gram")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lang, grams = b["lang"].to_numpy(zero_copy_only=False).astype(np.int64), b["gram"].to_numpy(zero_copy_only=False).view(np.uint64)
            for s in slots_of(grams):
                masks = (np.uint64(1) << (lang % 64).astype(np.uint64)).view(np.int64)
                yield pa.record_batch([pa.array(lang // 64 * SLOTS + s), pa.array(masks)], ["slot", "mask"])

    table = telling.mapInArrow(place, "slot long, mask long").groupBy("slot").agg(F.expr("bit_or(mask)").alias("mask")).toPandas()
    masks = np.zeros(-(-len(names) // 64) * SLOTS, np.uint64)
    masks[table["slot"].to_numpy(np.int64)] = table["mask"].to_numpy(np.int64).view(np.uint64)
    C.remove(counts)
    return Filters(names, masks.reshape(-1, SLOTS))


def predict(docs: DataFrame, filters: Filters) -> DataFrame:
    """(doc_id, lang_pred, score, languages) for each row of docs.

    lang_pred is `und` with score 0 for texts that are null or have no letter, and where nothing was learned. Of equal
    shares the first name wins. languages are all whose share is at least half of the largest. Whole texts are used.
    """
    shared = docs.sparkSession.sparkContext.broadcast((filters.names, filters.masks))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Filters(*shared.value)
        for b in C.chunks(batches):
            shares, counts = own.shares(b["text"].to_pylist())
            if own.names:
                best = shares.argmax(axis=1)
                known = counts > 0
                score = np.where(known, shares[np.arange(len(best)), best], 0.0)
                name = [own.names[i] if k else "und" for i, k in zip(best, known)]
                others = [[n for n, x in zip(own.names, row) if k and x > 0 and x >= s / 2] for row, k, s in zip(shares, known, score)]
            else:
                score, name, others = np.zeros(b.num_rows), ["und"] * b.num_rows, [[]] * b.num_rows
            yield pa.record_batch([b["doc_id"], pa.array(name), pa.array(score), pa.array(others, pa.list_(pa.string()))], ["doc_id", "lang_pred", "score", "languages"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, lang_pred string, score double, languages array<string>")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from the documents of folds 1 to 4; fold 0 is held out. A null doc_id is in no fold: held_out is null, and it isn't learned from."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    fold = C.crc_rest(F.col("doc_id"), FOLDS)
    filters = fit(docs.where(fold != 0))
    return predict(docs, filters).select("doc_id", (fold == 0).alias("held_out"), "lang_pred", "score", "languages")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op4_language_id": op4_language_id}
SQL: dict[str, str] = {}
