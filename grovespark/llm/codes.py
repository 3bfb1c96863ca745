"""Product-quantised codes of vectors in exact integer arithmetic.

Squared distances to a codebook are |x|^2 - 2 x.c + |c|^2; the dot products of a batch are a matrix product. Integers are
broken into limbs of so few bits that every float64 product, summed over a part, stays below 2^53 and is exact; limb
products are recombined in int64, and the first least entry is taken. So codes don't depend on the order of sums, the
library or the machine.

Codebooks are a fixed number of rows, whatever the table: tasks sum their parts by entry, and only these sums meet.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Vectors whose distances are computed at once.
BATCH = 2048
#: Labels up to which their sums are broadcast; beyond, they are joined by a shuffle.
LABELS = 100_000
LONGEST = (1 << 63) - 1


def saturation(dims: int) -> int:
    """The largest component: with it, a vector's squared distance over all components is below 2^62."""
    return 1 << (60 - (dims - 1).bit_length()) // 2


def limbs(x: np.ndarray, bits: int) -> list[np.ndarray]:
    """Float64 arrays, least first, each below 2^bits in size, whose sum over limb * 2^(bits * place) is x."""
    sign, size, out = np.sign(x), np.abs(x), []
    while True:
        out.append((sign * (size & ((1 << bits) - 1))).astype(np.float64))
        size = size >> bits
        if not size.any():
            return out


def dots(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The exact dot products of the rows of x and c in int64; the true results have to be below 2^63."""
    bits = (53 - max(1, x.shape[1] - 1).bit_length()) // 2
    out = np.zeros((len(x), len(c)), np.int64)
    for i, a in enumerate(limbs(x, bits)):
        for j, b in enumerate(limbs(c, bits)):
            out += (a @ b.T).astype(np.int64) << bits * (i + j)
    return out


def assign(x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of the nearest entry of each part of each vector. x: (n, parts, width); books: (parts, entries, width)."""
    code, error = np.zeros(x.shape[:2], np.int64), np.zeros(x.shape[:2], np.int64)
    for p in range(x.shape[1]):
        own, book = np.ascontiguousarray(x[:, p]), books[p]
        d = (book * book).sum(1)[None, :] - 2 * dots(own, book) + (own * own).sum(1)[:, None]
        code[:, p] = d.argmin(1)
        error[:, p] = d[np.arange(len(own)), code[:, p]]
    return code, error


def integers(vectors: pa.Array, dims: int, parts: int, scale: int = SCALE) -> np.ndarray:
    """Components as floor(scale * x), by vector, part and place; beyond saturation() they stay there."""
    x = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, parts, dims // parts)
    most = float(saturation(dims))
    return np.clip(np.floor(x * scale), -most, most).astype(np.int64)


def whole(vectors: DataFrame, parts: int = PARTS) -> tuple[DataFrame, int]:
    """(vec_id, label, embedding as doubles) of the rows that can be coded, and their length, 0 if there are none.

    Rows whose vector is null or has null, infinite or NaN components go. Of vectors of different lengths, those of the commonest one stay that the parts divide; of equally common ones, the shorter.
    """
    v = F.col("embedding").cast("array<double>")
    finite = F.coalesce(F.forall(v, lambda e: F.coalesce(~F.isnan(e) & (F.abs(e) < float("inf")), F.lit(False))), F.lit(False))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label"), v.alias("embedding")).where(finite)
    size = F.size("embedding")
    lengths = rows.where((size > 0) & (size % parts == 0)).groupBy(size.alias("dims")).agg(F.count("*").alias("n"))
    first = lengths.orderBy(F.desc("n"), "dims").first()
    dims = first["dims"] if first else 0
    return rows.where(size == dims) if first else rows.limit(0), dims


def sums(rows: DataFrame, books: np.ndarray, dims: int) -> DataFrame:
    """(part, entry, n, s): number and component sums of the parts nearest to each entry."""
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s = np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)
        for b in batches:
            for lo in range(0, b.num_rows, BATCH):
                x = integers(b["embedding"].slice(lo, BATCH), dims, parts)
                code, _ = assign(x, books)
                for p in range(parts):
                    n[p] += np.bincount(code[:, p], minlength=entries)
                    np.add.at(s[p], code[:, p], x[:, p])
        part, entry = np.nonzero(n)
        flat = pa.array(s[part, entry].ravel())
        yield pa.record_batch([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(n[part, entry]), pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * width), flat)], ["part", "entry", "n", "s"])

    partial = rows.select("embedding").mapInArrow(run, "part int, entry int, n long, s array<long>")
    each = [F.sum(F.col("s")[k]).alias(f"s{k}") for k in range(width)]
    return partial.groupBy("part", "entry").agg(F.sum("n").alias("n"), *each).select("part", "entry", "n", F.array(*(f"s{k}" for k in range(width))).alias("s"))


def first_books(rows: DataFrame, dims: int, parts: int, entries: int) -> np.ndarray:
    """(parts, entries, width) from the vectors of the smallest ids; fewer entries where there are fewer vectors. Null ids come last, equal ids in order of their vectors."""
    some = rows.orderBy(F.col("vec_id").asc_nulls_last(), "embedding").select("embedding").limit(entries).collect()
    x = integers(pa.array([r[0] for r in some], pa.list_(pa.float64())), dims, parts)
    return np.ascontiguousarray(x.transpose(1, 0, 2))


def fit(rows: DataFrame, dims: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """The codebooks after so many rounds of assignment and floored means; entries without parts stay as they are."""
    books = first_books(rows, dims, parts, entries)
    for _ in range(rounds):
        new = books.copy()
        for r in sums(rows, books, dims).collect():  # a row for each entry at most
            new[r["part"], r["entry"]] = np.floor_divide(np.array(r["s"], np.int64), r["n"])
        books = new
    return books


def encode(rows: DataFrame, books: np.ndarray, dims: int) -> DataFrame:
    """(vec_id, label, code, error)"""
    parts = len(books)
    hexes = np.array([f"{i:02x}" for i in range(books.shape[1])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, BATCH):
                some = b.slice(lo, BATCH)
                code, error = assign(integers(some["embedding"], dims, parts), books)
                text = pa.array(["".join(row) for row in hexes[code].tolist()], pa.string())
                yield pa.record_batch([some["vec_id"], some["label"], text, pa.array(error.sum(1))], ["vec_id", "label", "code", "error"])

    return rows.mapInArrow(run, f"vec_id long, label {rows.schema['label'].dataType.simpleString()}, code string, error long")


def sha256_of(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def capped(total: Column) -> Column:
    """A sum of longs as a long that stops at the largest one."""
    return F.least(total, F.lit(LONGEST).cast("decimal(38,0)")).cast("long")


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) of each vector that can be coded.

    Which rows go is said in whole(). Rows that repeat are coded each; a null vec_id stays null, and null labels are one
    label. Distances that tie go to the lower entry. An empty table, or one whose rows all go, gives an empty one. Other
    columns are ignored. Components beyond saturation() (524,288 / 2 for 64 components, scaled: 2^27) count as that, and sums over
    labels stop at the largest long.
    """
    if entries > 256:
        raise ValueError("two hex digits hold 256 entries at most")
    rows, dims = whole(vectors, parts)
    if not dims:
        return rows.select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    books = fit(rows, dims, parts, entries, rounds)
    coded = C.materialise(encode(rows, books, dims), "codes")
    totals = C.materialise(coded.groupBy(F.col("label").alias("of")).agg(capped(F.sum(F.col("error").cast("decimal(20,0)"))).alias("label_error")), "label_errors")
    totals = F.broadcast(totals) if totals.count() <= LABELS else totals
    out = coded.join(totals, F.col("label").eqNullSafe(F.col("of")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(sha256_of(books)).alias("codebooks_sha256"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors of embeddings; nulls, odd lengths, repeats and an empty table as in compress()."""
    return compress(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _sql() -> str:
    """The same in SQL: a row for each part of each vector, and a join with the part's codebook for each assignment."""
    ctes = [
        "kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"parts AS (SELECT vec_id, label, p, v[p * len(v) // {PARTS} + 1 : (p + 1) * len(v) // {PARTS}] AS x FROM kept, range({PARTS}) AS _(p))",
        f"book0 AS (SELECT p, e, x AS c FROM parts JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept QUALIFY e < {ENTRIES}) USING (vec_id))",
    ]
    near = "list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT"
    for k in range(ROUNDS + 1):
        ctes.append(f"at{k} AS (SELECT vec_id, label, p, x, min((d, e)) AS best FROM (SELECT vec_id, label, p, x, e, {near} AS d FROM parts JOIN book{k} USING (p)) GROUP BY ALL)")
        if k < ROUNDS:
            means = f"SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY i) AS m FROM (SELECT p, best[2] AS e, i, sum(x[i])::BIGINT AS s, count(*) AS n FROM at{k}, range(1, len(x) + 1) AS _(i) GROUP BY ALL) GROUP BY p, e"
            ctes.append(f"book{k + 1} AS (SELECT b.p, b.e, coalesce(m, c) AS c FROM book{k} b LEFT JOIN ({means}) USING (p, e))")
    ctes.append(f"coded AS (SELECT vec_id, label, string_agg(printf('%02x', best[2]), '' ORDER BY p) AS code, sum(best[1])::BIGINT AS error FROM at{ROUNDS} GROUP BY vec_id, label)")
    return f"WITH {', '.join(ctes)} SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) FROM book{ROUNDS}) AS codebooks_sha256 FROM coded"


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op12_vector_codes": op12_vector_codes}
SQL: dict[str, str] = {"op12_vector_codes": _sql()}
