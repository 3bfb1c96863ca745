"""Harmonic packing: classes of reciprocal capacity, each of whose sequences takes a fixed number of pieces.

A piece of class j is longer than 1/(j + 1) of a sequence and at most 1/j of it, so that j of them always fit. A rest of
a document that leaves more than SLACK tokens of its share unused is cut: its head is exactly the share of the next
class, and what is left goes on. Each worker fills sequences of its own as its documents come, one open per class;
nothing is shuffled, and no worker waits for another.

At its end a worker holds fewer than j pieces of each class j. These, laid end to end, are cut into full sequences, and the
last tokens into sequences of powers of two, which need no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from .packing import CHUNK_BYTES, SEQUENCE, WordIds

END = 2
#: Tokens of its share of a sequence that a piece may leave unused. On sf0.1, 8 gives 1.88 pieces a document and 0.17 % of padding; 16: 1.75, 0.34 %; 64: 1.43, 1.5 %.
SLACK = 8
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, class int"
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


def cut(sizes: np.ndarray, sequence: int = SEQUENCE, slack: int = SLACK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, length) of the pieces of documents of these sizes, by document and start."""
    whole = sizes // sequence
    doc = np.repeat(np.arange(len(sizes)), whole)
    first = np.arange(len(doc)) - np.repeat(np.cumsum(whole) - whole, whole)
    parts = [(doc, first * sequence, np.full(len(doc), sequence))]
    doc, start, rest = np.arange(len(sizes)), whole * sequence, sizes - whole * sequence
    while (some := rest > 0).any():
        doc, start, rest = doc[some], start[some], rest[some]
        of = sequence // rest
        head = np.where(sequence // of - rest <= slack, rest, sequence // (of + 1))
        parts.append((doc, start, head))
        start, rest = start + head, rest - head
    doc, start, length = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((start, doc))
    return doc[order], start[order], length[order]


class Worker:
    """The open sequences of one worker: per class fewer pieces than it takes, with their ids."""

    def __init__(self, number: int, sequence: int = SEQUENCE, slack: int = SLACK):
        self.sequence, self.slack, self.next = sequence, slack, number << 40
        self.held = self.table([], *(np.zeros(0, np.int64) for _ in range(4)))
        self.ids = np.zeros(0, "<u4")

    def table(self, doc_ids, start, length, crc, tokens) -> pa.Table:
        return pa.table([pa.array(doc_ids, pa.int64()), *(pa.array(x, pa.int64()) for x in (start, length, crc, tokens))], NAMES[:5])

    def rows(self, pieces: pa.Table, sequence_id: np.ndarray, offset: np.ndarray, of: np.ndarray) -> pa.Table:
        return pieces.append_column("sequence_id", pa.array(sequence_id, pa.int64())).append_column("offset", pa.array(offset, pa.int64())).append_column("class", pa.array(of, pa.int32()))

    def add(self, doc_ids: pa.Array, ids: np.ndarray, ends: np.ndarray) -> pa.Table:
        """The pieces of all sequences that these documents fill; what isn't full stays open. ids: of all documents; ends: the place after each."""
        sizes = np.diff(np.r_[0, ends])
        doc, start, length = cut(sizes, self.sequence, self.slack)
        at = np.cumsum(length) - length  # pieces follow each other as the ids do
        view = memoryview(ids).cast("B")
        crc = [zlib.crc32(view[s:e]) for s, e in zip((at * 4).tolist(), ((at + length) * 4).tolist())]
        pieces = pa.concat_tables([self.held, self.table(doc_ids.take(pa.array(doc)), start, length, crc, sizes[doc])])
        ids = np.concatenate([self.ids, ids])
        length = pieces["length"].to_numpy()
        at, of = np.cumsum(length) - length, self.sequence // length
        order = np.argsort(of, kind="stable")  # of a class, those that came earlier first
        sorted_of = of[order]
        first = np.searchsorted(sorted_of, sorted_of, side="left")
        count = np.searchsorted(sorted_of, sorted_of, side="right") - first
        place = np.arange(len(order)) - first
        full = place < count // sorted_of * sorted_of
        taken, of, place = order[full], sorted_of[full], place[full]
        opens = place % of == 0
        bins = np.cumsum(opens) - 1
        before = np.cumsum(length[taken]) - length[taken]
        out = self.rows(pieces.take(pa.array(taken)), self.next + bins, before - before[opens][bins], of)
        self.next += int(opens.sum())
        left = np.sort(order[~full])
        self.held = pieces.take(pa.array(left)).combine_chunks()
        self.ids = np.concatenate([np.zeros(0, "<u4"), *(ids[at[i] : at[i] + length[i]] for i in left)])
        return out

    def close(self) -> pa.Table:
        """What is left of all classes, end to end, in full sequences and then powers of two. Class 0 marks these."""
        length = self.held["length"].to_numpy()
        total = int(length.sum())
        rest = total % self.sequence
        powers = [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]
        size = np.array([self.sequence] * (total // self.sequence) + powers, np.int64)
        begin, at = np.cumsum(size) - size, np.cumsum(length) - length
        cuts = np.union1d(begin, at)
        sizes = np.diff(np.r_[cuts, total])
        piece, bin_ = np.searchsorted(at, cuts, side="right") - 1, np.searchsorted(begin, cuts, side="right") - 1
        view = memoryview(np.ascontiguousarray(self.ids)).cast("B")
        crc = [zlib.crc32(view[s * 4 : e * 4]) for s, e in zip(cuts.tolist(), (cuts + sizes).tolist())]
        kept = self.held.take(pa.array(piece))
        pieces = self.table(kept["doc_id"].combine_chunks(), kept["start"].to_numpy() + cuts - at[piece], sizes, crc, kept["doc_tokens"].to_numpy())
        out = self.rows(pieces, self.next + bin_, cuts - begin[bin_], np.zeros(len(cuts)))
        self.__init__(0, self.sequence, self.slack)
        return out


def pack_documents(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", sequence: int = SEQUENCE, slack: int = SLACK, chunk: int = CHUNK_BYTES) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, class) for each piece of each row of docs.

    A null or blank text is the end id alone. A null doc_id stays null. Rows that repeat are packed each. An empty table
    gives an empty one; other columns are ignored. Texts of any length: those longer than a sequence fill whole ones first.
    A worker is a partition of docs; it holds a chunk of texts and, of each of some 127 classes, less than one sequence. A
    worker that is lost packs the same rows again in the same way. Equal lengths go to a class in order of arrival.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers
        from pyspark import TaskContext

        encode, worker = WordIds(public_tokenizers.path(tokenizer), END), Worker(TaskContext.get().partitionId(), sequence, slack)
        for b in C.chunks(batches, limit=chunk):
            yield from worker.add(b["doc_id"], *encode(b["text"])).combine_chunks().to_batches()
            pa.default_memory_pool().release_unused()
        yield from worker.close().combine_chunks().to_batches()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, SCHEMA)


def op11_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All whole documents; null, blank, repeated and very long ones, and an empty table, as in pack_documents()."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op11_harmonic_packing": op11_harmonic_packing}
SQL: dict[str, str] = {}
