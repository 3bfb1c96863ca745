"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Terms are all words that three examples hold at least, however common, and words and word
beginnings that are several times as frequent under label 1. A text's vector has TF-IDF weights over them, times a factor that grows with
a term's lift towards label 1 and never falls below a floor, so that ordinary texts have vectors and neighbours too.

The index keeps a term's postings by block of examples, and the largest weight of each term in each block; the commonest
terms, which nearly every block holds, are a matrix, whose products with many texts at once are exact parts of cosines and of bounds. A query first
scores the blocks of the largest upper bounds; then those whose bound reaches its k-th best cosine, so that its neighbours
are exact. Many texts' words, bounds and postings are taken at once; a posting is a count and a place in four bytes, as it is reading
them that takes the time. Similarity-weighted votes are calibrated on the examples, each scored without itself; the neighbours are the evidence.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

#: Labelled rows that are examples at most (the first by a hash of their id), neighbours, examples of a block, blocks that are scored first.
EXAMPLES = 4_096
NEIGHBOURS = 15
BLOCK, FIRST_BLOCKS = 64, 8
#: A word is a term if so many examples hold it,
LEAST_DOCS = 3
#: ... or one fewer, if the logarithm of its lift towards label 1 (smoothed by one document) is at least this; word beginnings count only then.
LEAST_LIFT = 1.0
#: Weights are times the logarithm of the lift by this, and times the floor at least.
LIFT_UNIT, FLOOR = 3.0, 0.05
#: Lengths of the word beginnings that may be terms of their own.
STEMS = (4, 5)
#: The commonest terms at most, of those that one example in DENSE_SHARE holds, whose weights are a matrix by example instead of postings; texts whose products with it are taken at once, and postings that are looked up at once (one text's at least).
DENSE, DENSE_SHARE, TOGETHER, POSTINGS = 384, 16, 64, 1 << 17
#: Rejected at this score.
CUT = 0.7
FOLDS = 3
WORD = re.compile(r"[^\W\d_]+")
CALIBRATION_BINS = 20
#: What a vote is drawn to the prior by, in squared cosines.
PRIOR_WEIGHT = 0.01
#: Bytes of text whose words are looked up at once.
CHUNK = 1 << 20
#: Of each text its number of terms; all texts' terms, by rising number in each; what belongs to each term: counts, or weights.
Vectors = tuple[np.ndarray, np.ndarray, np.ndarray]


def terms_of(text: str | None) -> Counter:
    """Counts of the words of a whole text, lower-cased."""
    return Counter(WORD.findall((text or "").lower()))


def features(word: str) -> list[str]:
    return [word, *(f"{word[:n]}*" for n in STEMS if len(word) > n)]


def ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All places of some ranges, one after the other."""
    upto = np.cumsum(size)
    return np.repeat(begin - (upto - size), size) + np.arange(upto[-1] if len(upto) else 0)


class Vocabulary:
    """Terms and their weights."""

    def __init__(self, terms: list[str], weights: np.ndarray):
        self.numbers, self.weights = {t: i for i, t in enumerate(terms)}, weights
        self.words = pa.array(terms, pa.string())

    def __reduce__(self):
        return Vocabulary, (list(self.numbers), self.weights)

    def counts(self, texts: list[str | None]) -> Vectors:
        """How often each text has each term. Its words are those of terms_of(), as no blank is part of a word; each token is looked up once."""
        tokens = pc.utf8_split_whitespace(pa.array([(t or "").lower() for t in texts], pa.large_string()))
        length, coded = pc.list_value_length(tokens).to_numpy(), tokens.flatten().dictionary_encode()
        token, number = coded.dictionary, coded.indices.to_numpy()
        spelled = token.to_numpy(zero_copy_only=False)
        whole = np.fromiter(map(str.isalpha, spelled), bool, len(spelled))
        parts = [WORD.findall(t) for t in spelled[~whole]]
        words = pa.concat_arrays([token.filter(pa.array(whole)), pa.array(chain.from_iterable(parts), pa.large_string())]).cast(pa.string())
        of = np.r_[np.flatnonzero(whole), np.repeat(np.flatnonzero(~whole), np.fromiter(map(len, parts), np.int64, len(parts)))]
        long = pc.utf8_length(words).to_numpy()
        found = [(of, words)] + [(of[long > n], pc.binary_join_element_wise(pc.utf8_slice_codeunits(words.filter(pa.array(long > n)), 0, n), "*", "")) for n in STEMS]
        term = np.concatenate([pc.fill_null(pc.index_in(w, self.words), -1).to_numpy() for _, w in found])
        of = np.concatenate([o for o, _ in found])[term >= 0]
        order = np.argsort(of, kind="stable")
        term, size = term[term >= 0][order], np.bincount(of, minlength=len(token))
        begin, size = (np.cumsum(size) - size)[number], size[number]
        bits = len(self.weights).bit_length()
        each = np.repeat(np.repeat(np.arange(len(texts)) << bits, length), size) | term[ranges(begin, size)]
        each.sort()
        new = np.flatnonzero(np.diff(each, prepend=-1))
        return np.bincount(each[new] >> bits, minlength=len(texts)), each[new] & (1 << bits) - 1, np.diff(new, append=len(each))

    def unit(self, counted: Vectors) -> Vectors:
        """Weights instead of counts, of unit length in each text."""
        sizes, terms, counts = counted
        raw = (1 + np.log(counts)) * self.weights[terms]
        text = np.repeat(np.arange(len(sizes)), sizes)
        return sizes, terms, raw / np.sqrt(np.bincount(text, raw * raw, len(sizes)))[text]


class Index:
    """Unit vectors of the examples in flat arrays: postings by term and block, and the block maxima."""

    def __init__(self, vocabulary: Vocabulary, doc_ids: np.ndarray, labels: np.ndarray, counted: Vectors, prior: float):
        self.vocabulary, self.prior, self.curve = vocabulary, prior, None
        sizes, terms, weights = vocabulary.unit(counted)
        n = len(sizes)
        row = np.repeat(np.arange(n, dtype=np.int32), sizes)
        best = np.full(n, -1, np.int32)
        by_weight = np.argsort(weights, kind="stable")
        best[row[by_weight]] = terms[by_weight]  # the last one written is the heaviest
        order = np.lexsort((doc_ids, labels, best))  # alike examples share blocks, so maxima are tight
        place = np.empty(n, np.int32)
        place[order] = np.arange(n)
        self.doc_ids, self.labels, self.blocks = doc_ids[order], labels[order].astype(float), -(-n // BLOCK)
        at = place[row]
        del row, by_weight
        held = np.bincount(terms, minlength=len(vocabulary.weights))
        head = np.flatnonzero(held > n // DENSE_SHARE)
        head = np.sort(head[np.argsort(-held[head], kind="stable")[:DENSE]])
        self.column = np.full(len(held), -1, np.int32)
        self.column[head] = np.arange(len(head))
        self.dense = np.zeros((len(head), self.blocks * BLOCK))
        column = self.column[terms]
        self.dense[column[column >= 0], at[column >= 0]] = weights[column >= 0]
        held[head] = 0
        self.held = held.astype(np.int32)  # each term's postings
        at, terms, weights, counts = at[column < 0], terms[column < 0], weights[column < 0], counted[2][column < 0]
        del held, column
        o = np.lexsort((at, terms))
        at, terms, weights = at[o], terms[o], weights[o] / vocabulary.weights[terms[o]]
        levels, level = np.unique(counts[o], return_inverse=True)
        self.factors = 1 + np.log(levels)
        self.shift = (self.blocks * BLOCK).bit_length()
        self.postings = (level << self.shift | at).astype(np.int32 if len(levels) << self.shift < 1 << 31 else np.int64)
        self.inverse = np.zeros(self.blocks * BLOCK)  # what factors are times for a unit vector, by place
        self.inverse[at] = weights / self.factors[level]
        self.inverse = self.inverse.reshape(self.blocks, BLOCK)
        block = at // BLOCK
        new = np.flatnonzero(np.r_[True, (terms[1:] != terms[:-1]) | (block[1:] != block[:-1])]) if len(terms) else np.zeros(0, np.int64)
        self.begin, self.size = new.astype(np.int32), np.diff(new, append=len(terms)).astype(np.min_scalar_type(BLOCK))  # of each (term, block)
        self.block = block[new].astype(np.min_scalar_type(self.blocks))
        self.maxima = np.nextafter(np.maximum.reduceat(weights, new).astype(np.float32), np.float32(np.inf)) if len(new) else np.zeros(0, np.float32)  # rounded up
        self.first = np.searchsorted(terms[new], np.arange(len(vocabulary.weights) + 1)).astype(np.int32)  # each term's (term, block) entries

    def nearest(self, query: Vectors, k: int = NEIGHBOURS, but: int | None = None) -> list[tuple[float, int]]:
        """The k examples of largest cosine with one text, (cosine, place), exactly; ties to the smaller place. `but` is left out."""
        return next(self.neighbours(query, k, [but]))

    def neighbours(self, queries: Vectors, k: int = NEIGHBOURS, but: list[int | None] | None = None) -> Iterator[list[tuple[float, int]]]:
        """nearest() of each text: TOGETHER at a time are multiplied with the matrix, and of those as many as have POSTINGS are looked up."""
        sizes, terms, weights = queries
        end = np.r_[0, np.cumsum(sizes)]
        postings = np.r_[0, np.cumsum(self.held[terms])][end]
        for lo in range(0, len(sizes), TOGETHER):
            hi = min(len(sizes), lo + TOGETHER)
            text, term, weight = np.repeat(np.arange(hi - lo), sizes[lo:hi]), terms[end[lo] : end[hi]], weights[end[lo] : end[hi]]
            column = self.column[term]
            own = np.zeros((hi - lo, len(self.dense)))
            own[text[column >= 0], column[column >= 0]] = weight[column >= 0]
            heads = (own @ self.dense).reshape(hi - lo, self.blocks, BLOCK)  # what the matrix's terms add to each cosine
            text, term, weight = text[column < 0], term[column < 0], weight[column < 0]
            a = lo
            while a < hi:
                b = min(hi, max(a + 1, int(np.searchsorted(postings, postings[a] + POSTINGS, "right")) - 1))
                mine = slice(*np.searchsorted(text, (a - lo, b - lo)))
                yield from self._search(text[mine] - (a - lo), term[mine], weight[mine], heads[a - lo : b - lo], k, but[a:b] if but else [None] * (b - a))
                a = b

    def _search(self, text: np.ndarray, terms: np.ndarray, weights: np.ndarray, heads: np.ndarray, k: int, but: list[int | None]) -> Iterator[list[tuple[float, int]]]:
        """nearest() of some texts, from their listed terms by rising text and their heads."""
        n, shape = len(heads), (self.blocks, BLOCK)
        begin = self.first[terms]
        count = self.first[terms + 1] - begin
        entry = ranges(begin, count)
        weight, cell = np.repeat(weights * self.vocabulary.weights[terms], count), np.repeat(text * self.blocks, count) + self.block[entry]
        bound = np.bincount(cell, weight * self.maxima[entry], n * self.blocks).reshape(n, self.blocks) + heads.max(axis=2)

        def visit(chosen: np.ndarray, least: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
            """Of each text (places, cosines above 0) of the chosen blocks' k best that reach its least."""
            mine = np.flatnonzero(chosen.ravel()[cell])
            of = entry[mine]
            size = self.size[of].astype(np.int64)
            posting = self.postings[ranges(self.begin[of], size)]
            value = self.factors[posting >> self.shift] * np.repeat(weight[mine], size)
            place = posting & (1 << self.shift) - 1
            upto = np.r_[0, np.cumsum(size)][np.searchsorted(cell[mine], np.arange(n + 1) * self.blocks)].tolist()  # cells rise from text to text
            for i in range(n):
                number = np.flatnonzero(chosen[i])
                sums = np.bincount(place[upto[i] : upto[i + 1]], value[upto[i] : upto[i + 1]], self.inverse.size)
                scores = (sums.reshape(shape)[number] * self.inverse[number] + heads[i, number]).ravel()
                found = np.flatnonzero(scores >= least[i] if least[i] > 0 else scores)
                if len(found) > k + 1:
                    found = found[scores[found] >= np.partition(scores[found], len(found) - k - 1)[len(found) - k - 1]]
                places = number[found // BLOCK] * BLOCK + found % BLOCK
                keep = places != but[i]
                yield places[keep], scores[found][keep]

        done = np.zeros((n, self.blocks), bool)
        np.put_along_axis(done, np.argpartition(-bound, min(FIRST_BLOCKS, self.blocks) - 1, axis=1)[:, :FIRST_BLOCKS], True, axis=1)
        first = list(visit(done, np.zeros(n)))
        least = np.array([np.partition(s, len(s) - k)[len(s) - k] if len(s) >= k else 0.0 for _, s in first])
        rest = ~done & (bound > 0) & (bound >= least[:, None] - 1e-12)
        for (places, scores), (more, theirs) in zip(first, visit(rest, least)):
            places, scores = np.concatenate([places, more]), np.concatenate([scores, theirs])
            best = np.lexsort((places, -scores))[:k]
            yield list(zip(scores[best].tolist(), places[best].tolist()))

    def vote(self, near: list[tuple[float, int]]) -> float:
        """The share of label 1 among the neighbours by squared cosine, drawn a little to the prior."""
        weights = sum(s * s for s, _ in near)
        return (sum(s * s * self.labels[p] for s, p in near) + PRIOR_WEIGHT * self.prior) / (weights + PRIOR_WEIGHT)

    def calibrate(self, pairs: list[tuple[float, float]]) -> None:
        """A rising step curve from votes to label shares (pooling neighbours that fall); pairs: (vote, label) of each example without itself."""
        pairs = sorted(pairs)
        size = max(1, len(pairs) // CALIBRATION_BINS)
        pools = [[float(np.mean([v for v, _ in part])), float(sum(y for _, y in part)), len(part)] for part in (pairs[i : i + size] for i in range(0, len(pairs), size))]
        merged: list[list[float]] = []
        for pool in pools:
            merged.append(pool)
            while len(merged) > 1 and merged[-2][1] / merged[-2][2] >= merged[-1][1] / merged[-1][2]:
                v, y, n = merged.pop()
                a = merged[-1]
                merged[-1] = [(a[0] * a[2] + v * n) / (a[2] + n), a[1] + y, a[2] + n]
        self.curve = (np.array([m[0] for m in merged]), np.array([(m[1] + self.prior) / (m[2] + 1) for m in merged]))

    def scores(self, texts: list[str | None]) -> Iterator[tuple[float, list[tuple[float, int]]]]:
        """(score, neighbours) of each text. One without neighbours has the vote of the prior."""
        for near in self.neighbours(self.vectors(texts)):
            yield float(np.interp(self.vote(near), *self.curve)), near

    def vectors(self, texts: list[str | None]) -> Vectors:
        return self.vocabulary.unit(self.vocabulary.counts(texts))

    def vector(self, counts: Counter) -> Vectors:
        """That of one text of these words."""
        return self.vectors([" ".join(counts.elements())])


class Constant:
    """What is learned from examples of one label or of none: their share of label 1."""

    def __init__(self, rate: float):
        self.rate = rate

    def scores(self, texts: list[str | None]) -> Iterator[tuple[float, list]]:
        for _ in texts:
            yield self.rate, []


def fit(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES) -> Index | Constant:
    """The index of labelled documents: labels has (doc_id, toxic); rows with nulls aren't used.

    Of more than `examples` labelled rows, the first by hash are. Documents that repeat a labelled doc_id count once, by the text of the
    least hash. Counts are taken by Spark; what comes to the driver are the examples' terms and vectors.
    """
    known = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic")).withColumn("h", F.xxhash64("doc_id"))
    total = known.count()
    if total > examples:
        known = known.where(F.col("h") < int((examples / total * 2 - 1) * 2**63))
    text = F.col("text").cast("string")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("th"))
    # at most about `examples` labels of a few bytes each
    named = texts.join(F.broadcast(known.select("doc_id", "toxic")), "doc_id")
    picked = C.materialise(named.groupBy("doc_id", "toxic").agg(F.min_by("text", "th").alias("text")), "examples")
    sums = picked.agg(F.count("*"), F.sum("toxic")).first()
    n, ones = sums[0], sums[1] or 0
    if not n or ones in (0, n):
        return Constant(ones / n if n else 0.0)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in C.chunks(batches):
            both = Counter(), Counter()
            for text, y in zip(b["text"].to_pylist(), b["toxic"].to_pylist()):
                both[y].update({f for w in terms_of(text) for f in features(w)})
            for y in (0, 1):
                yield pa.record_batch([pa.array(both[y].keys(), pa.string()), pa.array(np.full(len(both[y]), y, np.int32)), pa.array(both[y].values(), pa.int64())], ["term", "y", "n"])

    df = picked.mapInArrow(count, "term string, y int, n long").groupBy("term").agg(F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("b"))
    prior = ones / n
    lift = F.log((F.col("a") + prior) / (ones + 1.0) / ((F.col("b") + 1 - prior) / (n - ones + 1.0)))
    held = F.col("a") + F.col("b")
    plain = ~F.endswith(F.col("term"), F.lit("*")) & (held >= LEAST_DOCS)
    top = df.withColumn("lift", lift).where(plain | ((F.col("lift") >= LEAST_LIFT) & (held >= LEAST_DOCS - 1))).orderBy("term").toArrow()
    held = top["a"].to_numpy() + top["b"].to_numpy()
    vocabulary = Vocabulary(top["term"].to_pylist(), (np.log((1 + n) / (1 + held)) + 1) * np.maximum(FLOOR, top["lift"].to_numpy() / LIFT_UNIT))
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for b in C.chunks(batches, limit=CHUNK):
            sizes, *both = own.counts(b["text"].to_pylist())
            begin = np.r_[0, np.cumsum(sizes)].astype(np.int32)
            yield pa.record_batch([b["doc_id"], b["toxic"], *(pa.ListArray.from_arrays(begin, x.astype(np.int32)) for x in both)], ["doc_id", "toxic", "terms", "counts"])

    made = picked.mapInArrow(vectors, "doc_id long, toxic int, terms array<int>, counts array<int>").orderBy("doc_id").toArrow().combine_chunks()
    flat = [made[c].combine_chunks() for c in ("terms", "counts")]
    sizes = pc.list_value_length(flat[0]).to_numpy().astype(np.int64)
    index = Index(vocabulary, made["doc_id"].to_numpy(), made["toxic"].to_numpy(), (sizes, flat[0].flatten().to_numpy(), flat[1].flatten().to_numpy()), prior)
    del made, flat, top, held
    shared.destroy()
    full = docs.sparkSession.sparkContext.broadcast(index)

    def votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = full.value
        place = {d: p for p, d in enumerate(own.doc_ids.tolist())}
        for b in C.chunks(batches, limit=CHUNK):
            out = [own.vote(near) for near in own.neighbours(own.vectors(b["text"].to_pylist()), but=[place[d] for d in b["doc_id"].to_pylist()])]
            yield pa.record_batch([pa.array(out, pa.float64()), b["toxic"]], ["vote", "toxic"])

    index.calibrate([(r["vote"], r["toxic"]) for r in picked.mapInArrow(votes, "vote double, toxic int").collect()])  # two numbers an example
    full.destroy()
    C.remove(picked)
    return index


def score(docs: DataFrame, index: Index | Constant) -> DataFrame:
    """(doc_id, score, predicted, neighbours, cosines) for each row of docs; whole texts, null ones being empty.

    neighbours: doc_ids of the nearest labelled examples, nearest first; cosines: theirs. Both are empty for texts without any term. Ids may be null and repeat; very long texts are scored whole; an empty table gives an empty one; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for b in C.chunks(batches, limit=CHUNK):
            scores, ids, cosines = [], [], []
            for s, near in own.scores(b["text"].to_pylist()):
                scores.append(min(1.0, max(0.0, s)))
                ids.append([int(own.doc_ids[p]) for _, p in near])
                cosines.append([c for c, _ in near])
            predicted = np.array([s >= CUT for s in scores], np.int32)
            yield pa.record_batch([b["doc_id"], pa.array(scores, pa.float64()), pa.array(predicted), pa.array(ids, pa.list_(pa.int64())), pa.array(cosines, pa.list_(pa.float64()))], ["doc_id", "score", "predicted", "neighbours", "cosines"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double, predicted int, neighbours array<long>, cosines array<double>")


def keep_clean(docs: DataFrame, index: Index | Constant) -> DataFrame:
    """The rows of docs, unchanged, whose text scores below the cut. Null and empty texts are scored as empty; repeated rows are each kept or not; all columns stay."""
    shared = docs.sparkSession.sparkContext.broadcast(index)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for b in C.chunks(batches, limit=CHUNK):
            clean = [s < CUT for s, _ in own.scores(b.column(at).to_pylist())]
            yield b.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def fit_folds(spark: SparkSession, docs: DataFrame, sf_dir: str) -> Index | Constant:
    """Learns from the labels of folds 0 and 2."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(C.crc_rest(F.col("doc_id"), FOLDS) != 1)
    return fit(docs, labels)


def op3_toxicity_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A null doc_id is in no fold: held_out is null. An empty table gives an empty one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scored = score(docs, fit_folds(spark, docs, sf_dir))
    return scored.select("doc_id", (C.crc_rest(F.col("doc_id"), FOLDS) == 1).alias("held_out"), "score", "predicted", "neighbours", "cosines")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op3_toxicity_nearest": op3_toxicity_nearest}
SQL: dict[str, str] = {}
