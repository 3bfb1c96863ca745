"""SimHash near-duplicates by anchor-point covering.

A fingerprint's 64 bits are cut into three blocks. In each block the codewords of a covering code are the anchors: the
binary Golay code of length 23, whose 4096 words lie within 3 bits of any word. Two fingerprints that differ in at most
4 bits differ in at most 1 bit in one of the blocks; there, both lie within 3 + 1 bits of the anchor nearest to
either. So each fingerprint is copied to all anchors within that distance (5.3 a block on average) and compared per anchor.

Nothing is dropped: within an anchor, fingerprints that agree in one of five parts (4 differing bits leave one of five
untouched) are compared; long runs by a breadth-first search in which each visited fingerprint is compared only with
those not yet visited, so that a dense ball of thousands costs few comparisons and gives a spanning forest, never all pairs.
An anchor of more than a fixed number of rows is parted: its rows go, five times, to groups by the value of each part, so that a
group stays small however many fingerprints there are, and any two that can link still meet.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

THRESHOLD = 4
SHINGLE = 4
SEED = 42
#: Generator polynomial x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1 of the binary Golay code; its covering radius.
GOLAY = 0b110001110101
RADIUS = 3
#: First bit and width of the blocks (a narrow block is padded with zeros) and of the five parts.
BLOCKS = ((0, 23), (23, 23), (46, 18))
PARTS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
#: Runs up to this length are compared pair by pair.
SHORT_RUN = 48
#: Rows of one anchor that a task compares; an anchor with more is parted by the values of its parts.
SLICE_ROWS = 100_000


def fingerprint_words(words: list[bytes]) -> int:
    """The SimHash of a document's words: a bit is 1 if it is set in over half of the shingles' hashes; no words: 0."""
    if not words:
        return 0
    if len(words) < SHINGLE:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    line, ends = b" ".join(words), np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[:-SHINGLE] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(line[s:e], SEED) for s, e in zip(starts, ends[SHINGLE - 1 :].tolist())], np.uint64)
    ones = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[lo : lo + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, th, fp): a row for each row of docs; th: its text's hash. Null and blank texts have fingerprint 0; other columns are ignored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in C.chunks(batches):
            fps = [fingerprint_words(t.encode().lower().split()) if t else 0 for t in b["text"].to_pylist()]
            yield pa.record_batch([b["doc_id"], b["th"], pa.array(np.array(fps, np.uint64).view(np.int64))], ["doc_id", "th", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("th", F.xxhash64("text")).mapInArrow(run, "doc_id long, th long, fp long")


def golay_words() -> np.ndarray:
    """All codewords, by polynomial multiplication."""
    words = np.zeros(4096, np.uint32)
    for bit in range(12):
        words ^= np.where(np.arange(4096) >> bit & 1, GOLAY << bit, 0).astype(np.uint32)
    return words


def anchors_of(block: np.ndarray, codewords: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, codeword number) of all codewords within radius of each block."""
    rows, words = [], []
    for lo in range(0, len(block), 2048):
        near = np.bitwise_count(block[lo : lo + 2048, None] ^ codewords[None, :]) <= radius
        r, w = np.nonzero(near)
        rows.append(r + lo)
        words.append(w)
    return np.concatenate(rows), np.concatenate(words)


def to_anchors(fps: np.ndarray, codewords: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(anchor, fp) rows: the anchor's number holds the block's number too."""
    keys, out = [], []
    for k, (first, width) in enumerate(BLOCKS):
        block = (fps >> np.uint64(first) & np.uint64((1 << width) - 1)).astype(np.uint32)
        values, back = np.unique(block, return_inverse=True)
        rows, words = anchors_of(values, codewords, RADIUS + THRESHOLD // len(BLOCKS))
        order = np.argsort(back, kind="stable")
        counts = np.bincount(back, minlength=len(values))
        begin = np.cumsum(counts) - counts
        each = counts[rows]
        at = np.repeat(begin[rows] - (np.cumsum(each) - each), each) + np.arange(each.sum())
        keys.append(np.repeat(words, each) + k * len(codewords))
        out.append(fps[order[at]])
    return np.concatenate(keys), np.concatenate(out)


def links_within(fps: np.ndarray, threshold: int = THRESHOLD) -> list[tuple[int, int]]:
    """A spanning forest of the links among distinct fingerprints of one anchor."""
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for first, width in PARTS:
        part = (fps >> np.uint64(first) & np.uint64((1 << width) - 1)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        p, f = part[order], fps[order]
        starts = np.flatnonzero(np.r_[True, p[1:] != p[:-1]])
        length = np.diff(np.r_[starts, len(p)])
        for s, n in zip(starts[length > SHORT_RUN].tolist(), length[length > SHORT_RUN].tolist()):
            pairs += visit(f[s : s + n], threshold)
        short = np.repeat(length <= SHORT_RUN, length)
        for step in range(1, SHORT_RUN):
            if step >= len(p) or not (same := (p[step:] == p[:-step]) & short[step:]).any():
                break
            i = np.flatnonzero(same)
            i = i[np.bitwise_count(f[i] ^ f[i + step]) <= threshold]
            if len(i):
                pairs.append((f[i], f[i + step]))
    return forest(pairs)


def visit(left: np.ndarray, threshold: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Breadth-first search over one long run; each visited fingerprint meets only those not yet visited."""
    pairs, left = [], left.copy()
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = np.bitwise_count(left ^ at) <= threshold
            if near.any():
                found, left = left[near], left[~near]
                pairs.append((np.full(len(found), at), found))
                queue += list(found)
    return pairs


def forest(pairs: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[int, int]]:
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = x = root[up]
        return x

    kept = []
    for a, b in pairs:
        for x, y in zip(a.tolist(), b.tolist()):
            if (rx := find(x)) != (ry := find(y)):
                root[max(rx, ry)] = min(rx, ry)
                kept.append((x, y))
    return kept


def links(distinct: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """(u, v): links that connect what is linked among the distinct fingerprints of the column fp; u < v."""
    spark = distinct.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = distinct.select("fp").repartition(parts, "fp")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codewords, total = golay_words(), np.zeros(len(BLOCKS) << 12, np.int64)
        for b in batches:
            if b.num_rows:
                total += np.bincount(to_anchors(b["fp"].to_numpy().view(np.uint64), codewords)[0], minlength=len(total))
        yield pa.record_batch([pa.array(np.arange(len(total))), pa.array(total)], ["anchor", "n"])

    # 3 x 4096 counts at most, whatever the input's size
    sizes = dealt.mapInArrow(count, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n")).where(F.col("n") > slice_rows).collect()
    large = np.array(sorted(r["anchor"] for r in sizes), np.int64)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(task, fp): the task is an anchor; of a large one, each part's number and value with it."""
        codewords = golay_words()
        for b in batches:
            if b.num_rows:
                keys, fps = to_anchors(b["fp"].to_numpy().view(np.uint64), codewords)
                keys = keys.astype(np.int64) << 32
                hot = np.isin(keys >> 32, large)
                tasks, values = [keys[~hot]], [fps[~hot]]
                for k, (first, width) in enumerate(PARTS):
                    own = (fps[hot] >> np.uint64(first) & np.uint64((1 << width) - 1)).astype(np.int64)
                    tasks.append(keys[hot] + (k + 1 << 16) + own)
                    values.append(fps[hot])
                yield pa.record_batch([pa.array(np.concatenate(tasks)), pa.array(np.concatenate(values).view(np.int64))], ["task", "fp"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for fps in groups(batches, "task", "fp"):
            found = links_within(np.unique(fps.view(np.uint64))) if len(fps) > 1 else []
            if found:
                pairs = np.array(found, np.uint64).view(np.int64)
                yield pa.record_batch([pa.array(pairs.min(axis=1)), pa.array(pairs.max(axis=1))], ["u", "v"])

    copies = dealt.mapInArrow(spread, "task long, fp long").repartition(parts, "task").sortWithinPartitions("task")
    return copies.mapInArrow(compare, "u long, v long").distinct()


def groups(batches: Iterator[pa.RecordBatch], key: str, value: str) -> Iterator[np.ndarray]:
    """The values of each key; rows come sorted by key."""
    open_key, held = None, []
    for b in batches:
        k, v = b[key].to_numpy(zero_copy_only=False), b[value].to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]).tolist() if len(k) else []
        for lo, hi in zip(cuts, [*cuts[1:], len(k)]):
            if k[lo] != open_key and held:
                yield np.concatenate(held)
                held = []
            open_key = k[lo]
            held.append(v[lo:hi].copy())
    if held:
        yield np.concatenate(held)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) of every node of the links (u, v): root is the component's smallest node.

    Alternates large-star and small-star steps until the links no longer change. Every step's table is written to the
    shared folder. A hub's links are spread by Spark's skew join, as minima are a table of their own.
    """

    def minima(pairs: DataFrame) -> DataFrame:
        return C.materialise(pairs.groupBy("a").agg(F.min("b").alias("b")).select("a", F.least("a", "b").alias("m")), "minima")

    def step(e: DataFrame, both: bool) -> DataFrame:
        down = e.select(F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b"))
        pairs = down.unionByName(down.select(F.col("b").alias("a"), F.col("a").alias("b"))) if both else down
        m = minima(pairs)
        if both:
            made = pairs.join(m, "a").where("b > a").select(F.col("b").alias("u"), F.col("m").alias("v"))
        else:
            made = pairs.join(m, "a").select(F.col("b").alias("u"), F.col("m").alias("v")).unionByName(m.select(F.col("a").alias("u"), F.col("m").alias("v")))
        out = C.materialise(made.where("u <> v").distinct(), "stars")
        C.remove(m)
        return out

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    now = C.materialise(edges.select("u", "v").where("u <> v"), "links")
    was = None
    for _ in range(rounds):
        if (is_now := state(now)) == was:
            break
        was = is_now
        large = step(now, True)
        small = step(large, False)
        C.remove(now)
        C.remove(large)
        now = small
    else:
        raise RuntimeError("components did not settle")
    out = C.materialise(now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct(), "roots")
    C.remove(now)
    return out


def grouped(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, th, fp) of each row of docs, and (fp, root) of each distinct fingerprint: root names its component. Both are tables."""
    fps = C.materialise(fingerprints(docs), "fingerprints")
    nodes = C.materialise(fps.select("fp").distinct(), "nodes")
    roots = components(links(nodes))
    rooted = C.materialise(nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root")), "rooted")
    C.remove(roots)
    C.remove(nodes)
    return fps, rooted


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of docs.

    fingerprint: 16 lowercase hex digits. component_id: the smallest doc_id reachable over links of at most 4 differing
    bits. Equal fingerprints are one node. A null doc_id never is the smallest; a component of none but null ids has a
    null component_id. An empty table gives an empty one; further columns are ignored.
    """
    fps, rooted = grouped(docs)
    first = fps.groupBy("fp").agg(F.min("doc_id").alias("first"))
    first = C.materialise(first.join(rooted, "fp"), "first")
    least = first.groupBy("root").agg(F.min("first").alias("component_id"))
    named = C.materialise(first.select("fp", "root").join(least, "root").select("fp", "component_id"), "named")
    C.remove(rooted)
    C.remove(first)
    return fps.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame) -> DataFrame:
    """One row of each component stays: that of the smallest doc_id (null after all others), of those the one whose text has the smallest hash.

    Rows that repeat an id with other texts are rows of their own, and may stay or go apart. Of rows with the same id and text, the one whose columns have the smallest hash stays.
    Null and blank texts are one group. Columns are those of docs, whatever their names; an empty table gives an empty one.
    """
    row, mine_, one_ = C.free_names(docs, "row", "kept", "one")
    fps, rooted = grouped(docs)
    first = fps.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")).alias("first"))
    kept = C.materialise(first.join(rooted, "fp").groupBy("root").agg(F.min("first").alias("first")).select(F.xxhash64("first.doc_id", "first.th").alias("k"), "first.doc_id", "first.th"), "kept")
    C.remove(fps)
    C.remove(rooted)
    own = F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("th"))
    marked = docs.withColumn(row, own)
    found = kept.select(F.struct("k", "doc_id", "th").alias(mine_))
    mine = F.xxhash64(F.col(f"{row}.doc_id"), F.col(f"{row}.th"))
    same = (mine == F.col(f"{mine_}.k")) & F.col(f"{row}.doc_id").eqNullSafe(F.col(f"{mine_}.doc_id")) & F.col(f"{row}.th").eqNullSafe(F.col(f"{mine_}.th"))
    stays = marked.join(found, same, "left_semi")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    hashed = [F.to_json(F.struct(c)) if "map<" in docs.schema[n].dataType.simpleString() else c for n, c in zip(docs.columns, columns)]  # maps have no hash
    one = stays.groupBy(row).agg(F.min_by(F.struct(*columns), F.xxhash64(*hashed)).alias(one_))
    return one.select(f"{one_}.*")


def op6_simhash_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of whole documents with its fingerprint and component; nulls, blanks, repeated ids and an empty table as in near_duplicates()."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op6_simhash_near_dup": op6_simhash_near_dup}
SQL: dict[str, str] = {}
