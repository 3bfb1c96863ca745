"""Best-fit packing of documents into token sequences, bounded-space and online.

Each packing task keeps a fixed number of open bins. A bitset has a bit for each amount of free space that some open bin
has; the lowest bit not below a piece's length is its best fit. When one bin more would be open than allowed, the
fullest closes first. Pieces are placed as they arrive, in the order of a hash, batch after batch, and a task holds no more than a batch and its open bins.
Tasks pack apart; each gets so many pieces that its last, partly filled bins weigh little.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

SEQUENCE = 4096
END = 1
#: Bins that a task keeps open.
OPEN_BINS = 64
#: Sequences that a packing task fills, and pieces that it gets, about.
TASK_SEQUENCES, TASK_PIECES = 4_000, 2_000_000
#: Bytes of text that are encoded at once. Words repeat more in a larger chunk, and are looked up once; 4 MB less takes some 40 MB less of a worker.
CHUNK_BYTES = 8 << 20
#: Words whose ids a Python worker keeps in each of two generations.
CACHE_WORDS = 100_000
#: Letters that lower-case to one letter each, and stay as they are under normalisation.
LATIN = re.compile(r"[A-Za-z\u00c0-\u00ff]+").fullmatch
#: Stops that end a word after one of these letters but the signs among them, or a digit.
STOPS = r"([A-Za-z0-9\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{ff}])([.,;:!?]+)( |$)"


class WordIds:
    """Token ids of whole texts as little-endian 32-bit bytes.

    The tokenizer drops white space and never joins what it parts, so a text's ids are those of its blank-separated
    words, which are kept by word in two generations, so that common words stay. Of a new word of Latin letters alone, many are
    encoded as one text, whose ids part after those that end a word. Stops after Latin letters or digits are words of their own, as the
    tokenizer parts them; not after others, some of which (dotted capital I, U+0958) normalise to a letter and a mark that belongs to the stop.
    """

    def __init__(self, path: str, end: int = END):
        from tokenizers import Tokenizer

        self.tokenizer, self.end = Tokenizer.from_file(path), end
        self.young: dict[str, bytes] = {"": b""}
        self.old: dict[str, bytes] = {}
        ends = [i for token, i in self.tokenizer.get_vocab().items() if token.endswith("</w>")]
        self.ends_word = np.zeros(max(self.tokenizer.get_vocab_size(), max(ends) + 1), bool)
        self.ends_word[ends] = True

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each with the end id after it; place after each text's end). Words that repeat are looked up once."""
        texts = pc.replace_substring(pc.fill_null(texts, ""), "\n", " ")
        if not pc.any(pc.match_substring(texts, "<|")).as_py():  # special tokens are told apart by case
            texts = pc.ascii_lower(texts)
        texts = pc.replace_substring_regex(texts, STOPS, r"\1 \2\3")
        words = pc.split_pattern(texts, " ")
        counts, coded = pc.list_value_length(words).to_numpy(zero_copy_only=False), words.flatten().dictionary_encode()
        del texts, words
        unique = coded.dictionary.to_pylist()
        if len(self.young) > CACHE_WORDS:
            self.old, self.young = self.young, {"": b""}
        self.learn([w for w in unique if w not in self.young])
        held = list(map(self.young.__getitem__, unique))
        size = np.fromiter(map(len, held), np.int32, len(held)) // 4
        pool, begin = np.frombuffer(b"".join(held), "<u4"), np.cumsum(size, dtype=np.int32) - size
        index = coded.indices.to_numpy()
        each = size[index]
        upto = np.cumsum(each, dtype=np.int32)  # a chunk's ids are far fewer than 2^31
        at = np.repeat(begin[index] - (upto - each), each)
        at += np.arange(len(at), dtype=np.int32)
        ids = pool[at]
        ends = np.concatenate([[0], upto])[np.cumsum(counts)]
        return np.insert(ids, ends, self.end).astype("<u4", copy=False), ends + np.arange(1, len(ends) + 1)

    def learn(self, words: list[str]) -> None:
        """Takes from the old generation what it has, and encodes the rest."""
        had = list(map(self.old.get, words))
        self.young.update((w, x) for w, x in zip(words, had) if x is not None)
        new = [w for w, x in zip(words, had) if x is None]
        letters = [w for w in new if LATIN(w)]
        self.encode_letters(letters)
        self.encode([w for w in new if w not in self.young])

    def encode(self, words: list[str]) -> None:
        """Any words, many as one text; ids go to the word that their place in the text lies in."""
        for lo in range(0, len(words), 500):
            some = words[lo : lo + 500]
            done = self.tokenizer.encode(" ".join(some), add_special_tokens=False)
            ends = np.cumsum(np.fromiter(map(len, some), np.int64, len(some)) + 1)
            owner = np.searchsorted(ends, np.array([s for s, _ in done.offsets], np.int64), side="right")
            ids, cuts = np.array(done.ids, "<u4").tobytes(), (np.searchsorted(owner, np.arange(len(some) + 1)) * 4).tolist()
            self.young.update((w, ids[s:e]) for w, s, e in zip(some, cuts, cuts[1:]))

    def encode_letters(self, words: list[str]) -> None:
        for lo in range(0, len(words), 500):
            some = words[lo : lo + 500]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            cuts = np.flatnonzero(self.ends_word[ids]) + 1
            if len(cuts) != len(some):
                self.encode(some)
                continue
            data, at = ids.tobytes(), [0, *(cuts * 4).tolist()]
            self.young.update((w, data[s:e]) for w, s, e in zip(some, at, at[1:]))


def pieces(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", sequence: int = SEQUENCE, chunk: int = CHUNK_BYTES) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each document's ids and the end id, cut only where longer than a sequence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import public_tokenizers

        encode = WordIds(public_tokenizers.path(tokenizer))
        for b in C.chunks(batches, limit=chunk):
            ids, ends = encode(b["text"])
            sizes = np.diff(np.r_[0, ends])
            pieces_of = -(-sizes // sequence)
            doc = np.repeat(np.arange(b.num_rows), pieces_of)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces_of) - pieces_of, pieces_of)
            start = piece * sequence
            length = np.minimum(sequence, sizes[doc] - start)
            at = ((ends - sizes)[doc] + start) * 4
            view = memoryview(ids).cast("B")
            crc = [zlib.crc32(view[s:e]) for s, e in zip(at.tolist(), (at + length * 4).tolist())]
            yield pa.record_batch([b["doc_id"].take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])
            pa.default_memory_pool().release_unused()  # a chunk's strings, which other stages' tasks beside this worker may need

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


class BestFit:
    """Bounded-space online best fit: the open bins by free space, and a bitset of the amounts of it."""

    def __init__(self, size: int = SEQUENCE, open_bins: int = OPEN_BINS):
        self.size, self.open_bins = size, open_bins
        self.bits, self.by_free, self.open, self.bins, self.closed = 0, {}, 0, 0, 0

    def take(self, free: int) -> int:
        own = self.by_free[free]
        bin_ = own.pop()
        if not own:
            del self.by_free[free]
            self.bits &= ~(1 << free)
        self.open -= 1
        return bin_

    def place(self, n: int) -> tuple[int, int]:
        """(bin, offset) of the next length."""
        if fits := self.bits >> n:
            free = n + (fits & -fits).bit_length() - 1
            bin_ = self.take(free)
        else:
            free, bin_ = self.size, self.bins
            self.bins += 1
        if free > n:
            if self.open == self.open_bins:  # the fullest closes
                self.take((self.bits & -self.bits).bit_length() - 1)
                self.closed += 1
            self.by_free.setdefault(free - n, []).append(bin_)
            self.bits |= 1 << free - n
            self.open += 1
        return bin_, self.size - free


def best_fit(lengths: list[int], size: int = SEQUENCE, open_bins: int = OPEN_BINS) -> tuple[list[int], list[int]]:
    """(bin, offset) of each length, in order of arrival."""
    bins = BestFit(size, open_bins)
    placed = [bins.place(n) for n in lengths]
    return [b for b, _ in placed], [at for _, at in placed]


def pack(cut: DataFrame, sequence: int = SEQUENCE, open_bins: int = OPEN_BINS, task_sequences: int = TASK_SEQUENCES, task_pieces: int = TASK_PIECES) -> DataFrame:
    """Adds sequence_id and offset to pieces. A task's pieces arrive in an order without ties but of equal rows, so that a rerun task packs alike."""
    cut = C.materialise(cut, "pieces")
    total, rows = cut.agg(F.coalesce(F.sum("length"), F.lit(0)), F.count("*")).first()
    tasks = max(1, round(total / sequence / task_sequences), -(-rows // task_pieces))
    kept = [F.col(c) for c in cut.columns]
    # equal pieces, as of null ids, are told apart by their place in the table, so that they part among the tasks too; file names but for their number are new in each run
    part = F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1)
    mixed = cut.select(*kept, F.xxhash64("doc_id", "piece", "ids_crc32", part, F.col("_metadata.row_index")).alias("at"))
    dealt = mixed.repartition(tasks, "at").sortWithinPartitions("at", "doc_id", "piece", "ids_crc32").select(*kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        first, bins = TaskContext.get().partitionId() << 40, BestFit(sequence, open_bins)
        for b in batches:
            placed = np.array([bins.place(n) for n in b["length"].to_pylist()], np.int64).reshape(-1, 2)
            yield pa.record_batch([*b.columns, pa.array(placed[:, 0] + first), pa.array(placed[:, 1])], [*b.schema.names, "sequence_id", "offset"])

    return dealt.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, chunk: int = CHUNK_BYTES) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for each piece of each row of docs.

    A null or blank text is the end id alone. A null doc_id stays null. Rows that repeat are packed each. An empty table
    gives an empty one; other columns are ignored. Texts of any length: only these are cut, into full sequences and a rest.
    """
    return pack(pieces(docs, chunk=chunk))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All whole documents; null, blank, repeated and very long ones, and an empty table, as in pack_documents()."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op10_best_fit_packing": op10_best_fit_packing}
SQL: dict[str, str] = {}
