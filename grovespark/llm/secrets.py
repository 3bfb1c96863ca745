"""Secret scans: a random forest over candidates takes out false positives, with DataFrame functions and MLlib only.

Candidates are runs of key characters: of eight at least with a digit, of sixteen at least of mixed or capital letters alone, and of any length
behind an equals sign or colon after a word that names a secret. Features: length, character classes and transitions, distinct characters, longest letter run, dictionary coverage
(letter runs that are words of the whole corpus), path (the source's share of secrets among the labelled findings), and the neighbouring
word (its share). The forest is fitted on findings whose shares come from other folds than their own, so that it never sees its own labels in them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

#: Shortest candidate with a digit, and of letters alone; labelled findings that are fitted on at most, shortest letter run and least count of a dictionary word.
SHORTEST, LETTERS, FIT_ROWS, RUN, WORD_COUNT = 8, 16, 20_000, 3, 5
TREES, DEPTH, SEED = 24, 6, 17
#: Folds of findings by their value: 0 is held out, the others' shares come from one another.
FOLDS = 5
CUT = 0.5
MASK = "[SECRET]"
#: Characters of a key; `=` ends one at most.
KEY = r"A-Za-z0-9+/_.~-"
#: What a word is cut into, step by step: other characters, and a run.
STEPS = rf"([^{KEY}]*+)([{KEY}]*+)"
#: Words that name a secret, and forms that providers give theirs.
NAMES = r"(?:password|passwd|pwd|secret|token|api_?key|apikey|auth|credential|bearer|private)"
FORMS = r"^(?:AKIA[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36}|xox[abp]-[0-9A-Za-z-]{10,}|sk_live_[0-9A-Za-z]{16,}|eyJ[0-9A-Za-z_-]{16,}.*)$"
FEATURES = ["length", "digits", "capitals", "transitions", "distinct", "longest_run", "coverage", "word_rate", "source_rate"]


def letters_before(lead: Column) -> Column:
    """The nearest letters before a run, lower-cased: what stands last in the lead, of which only the end counts."""
    return F.regexp_extract(F.lower(F.right(lead, F.lit(64))), r"([\p{L}_]+)[^\p{L}_]*$", 1)


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, th, source, place, run, value, word, assigned): a row for each candidate in each row of docs.

    place: the number of its blank-separated word; run: the number of its run within that word; word: the nearest letters before it among the run before it and the two words before, lower-cased;
    assigned: whether an equals sign or colon parts that word from it. A word is cut into runs by one pass whose every step takes what it reads, so that
    the time is in proportion to a word's length.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), F.split(text, C.BLANKS).alias("w"))
    digits = f"octet_length(w[i]) >= {SHORTEST} and w[i] rlike '[0-9]'"
    letters = f"octet_length(w[i]) >= {LETTERS} and w[i] rlike '[A-Z]' and (w[i] rlike '[a-z][A-Z]' or w[i] rlike '[A-Z]{{{LETTERS}}}')"
    behind = "w[i] rlike '[=:]' or (i > 0 and w[i - 1] rlike '[=:]$') or (i > 1 and w[i - 1] in ('=', ':'))"
    near = f"lower(concat_ws(' ', right(get(w, i - 2), 64), right(get(w, i - 1), 64), left(w[i], 64))) rlike '{NAMES}' or octet_length(w[i]) > 64"
    worth = F.expr(f"filter(sequence(0, size(w) - 1), i -> ({digits}) or ({letters}) or (({behind}) and ({near})))")
    at = rows.withColumn("place", F.explode(worth)).select("doc_id", "th", "source", "place", F.expr("w[place]").alias("own"), F.expr("concat_ws(' ', right(get(w, place - 2), 64), right(get(w, place - 1), 64))").alias("before"))
    steps = F.lit(STEPS)
    cut = at.withColumn("gaps", F.regexp_extract_all("own", steps, F.lit(1))).withColumn("runs", F.regexp_extract_all("own", steps, F.lit(2)))
    run = cut.select("doc_id", "th", "source", "place", "before", "gaps", "runs", F.posexplode("runs").alias("i", "run")).where("run <> ''")
    lead = F.expr("case when i = 0 then concat(before, ' ', right(gaps[0], 64)) else concat(right(runs[i - 1], 64), right(gaps[i], 64)) end")
    ends = F.expr("if(i + 1 < size(gaps) and startswith(gaps[i + 1], '='), if(startswith(gaps[i + 1], '=='), '==', '='), '')")
    value = F.rtrim(F.col("run"), F.lit("."))
    found = run.select("doc_id", "th", "source", "place", F.col("i").alias("run"), F.when(ends != "", F.concat("run", ends)).otherwise(value).alias("value"), lead.alias("lead"))
    found = found.select("doc_id", "th", "source", "place", "run", "value", letters_before(F.col("lead")).alias("word"), F.col("lead").rlike(r"[=:][^\p{L}0-9]*$").alias("assigned"))
    long = (F.length("value") >= SHORTEST) & F.col("value").rlike("[0-9]")
    plain = (F.length("value") >= LETTERS) & (F.col("value").rlike(f"^[A-Z]{{{LETTERS}}}") | (F.regexp_count("value", F.lit("[a-z](?=[A-Z])")) >= 3))
    return found.where("value <> ''").where(long | plain | (F.col("assigned") & F.col("word").rlike(NAMES))).distinct()


def dictionary(docs: DataFrame) -> DataFrame:
    """(run): the words of letters alone that occur five times in the whole corpus, lower-cased."""
    words = docs.select(F.explode(F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), C.BLANKS)).alias("w")).where(r"w rlike '^\\p{L}{3,32}[.,;:!?]?$'")
    return words.groupBy(F.lower(F.rtrim("w", F.lit(".,;:!?"))).alias("run")).agg(F.count("*").alias("n")).where(f"n >= {WORD_COUNT}").select("run")


def shapes(found: DataFrame, words: DataFrame) -> DataFrame:
    """found with the features of each candidate's value; values that repeat are looked at once."""
    value, n = F.col("value"), F.length("value")
    runs = F.regexp_extract_all(F.lower(value), F.lit(rf"[a-z]{{{RUN},}}"), F.lit(0))
    values = found.select("value").distinct().withColumn("runs", runs)
    known = values.select("value", F.explode("runs").alias("run")).join(words, "run").groupBy("value").agg(F.sum(F.length("run")).alias("covered"))
    values = values.join(known, "value", "left").select(
        "value",
        n.cast("double").alias("length"),
        (F.regexp_count(value, F.lit("[0-9]")) / n).alias("digits"),
        (F.regexp_count(value, F.lit("[A-Z]")) / n).alias("capitals"),
        (F.regexp_count(value, F.lit("[0-9](?=[A-Za-z])|[A-Za-z](?=[0-9])|[a-z](?=[A-Z])|[A-Z](?=[a-z])")) / n).alias("transitions"),
        (F.size(F.array_distinct(F.split(value, ""))) / n).alias("distinct"),
        F.coalesce(F.array_max(F.transform("runs", lambda r: F.length(r))), F.lit(0)).cast("double").alias("longest_run"),
        (F.coalesce("covered", F.lit(0)) / n).alias("coverage"),
    )
    return found.join(values, "value")


def labelled_by_form(found: DataFrame) -> DataFrame:
    """A labelled findings table for corpora without reviewed findings: label 1 for values of a provider's form, and for those that are assigned to a word that names a secret; else 0.

    Neither the form nor the assignment is a feature.
    """
    return found.withColumn("label", (F.col("value").rlike(FORMS) | (F.col("assigned") & F.col("word").rlike(NAMES))).cast("double"))


def fold(value: str = "value") -> Column:
    """Copies of a value share a fold."""
    return F.pmod(F.xxhash64(F.lit("fold"), value), F.lit(FOLDS)).cast("int")


class Scanner:
    """The forest and the rates that it was fitted with; a constant where labels are of one kind."""

    def __init__(self, model: RandomForestClassificationModel | None, words: DataFrame, sources: DataFrame, rate: float):
        self.model, self.words, self.sources, self.rate = model, words, sources, rate

    def score(self, shaped: DataFrame) -> DataFrame:
        """shaped with probability. Words and sources that the labelled findings lack have the general rate."""
        # a row for each word or source among at most FIT_ROWS findings
        rated = shaped.join(F.broadcast(self.words), "word", "left").join(F.broadcast(self.sources), "source", "left").fillna(self.rate, ["word_rate", "source_rate"])
        if self.model is None:
            return rated.withColumn("probability", F.lit(self.rate))
        ready = VectorAssembler(inputCols=FEATURES, outputCol="_features").transform(rated)
        return self.model.transform(ready).withColumn("probability", vector_to_array("_probability")[1]).drop("_features", "_raw", "_probability", "_prediction")


def fit(labelled: DataFrame, rows: int = FIT_ROWS) -> Scanner:
    """Trains on findings with features and a label of 0 or 1 that aren't held out; of more than `rows`, the first by hash are used."""
    known = labelled.where("label is not null").withColumn("_fold", fold()).where("_fold > 0").withColumn("_h", F.xxhash64("doc_id", "th", "place", "run"))
    total = known.count()
    if total > rows:
        known = known.where(F.col("_h") < int((rows / total * 2 - 1) * 2**63))
    known = C.materialise(known, "findings")
    seen, ones = known.agg(F.count("*"), F.sum("label")).first()
    rate = (ones or 0.0) / seen if seen else 0.0

    def drawn(ones: Column, n: Column) -> Column:  # to the general rate by the weight of five findings
        return (ones + 5 * rate) / (n + 5)

    def rates(column: str) -> DataFrame:
        return C.materialise(known.groupBy(column).agg(drawn(F.sum("label"), F.count("*")).alias(f"{column}_rate")), "rates")

    def other_folds(df: DataFrame, column: str) -> DataFrame:
        by_fold = known.groupBy(column, "_fold").agg(F.sum("label").alias("_o"), F.count("*").alias("_c"))
        whole = known.groupBy(column).agg(F.sum("label").alias("_all"), F.count("*").alias("_n"))
        share = by_fold.join(whole, column).select(column, "_fold", drawn(F.col("_all") - F.col("_o"), F.col("_n") - F.col("_c")).alias(f"{column}_rate"))
        return df.join(share, [column, "_fold"])

    scanner = Scanner(None, rates("word"), rates("source"), rate)
    if 0 < rate < 1:
        ready = other_folds(other_folds(known, "word"), "source")
        ready = VectorAssembler(inputCols=FEATURES, outputCol="_features").transform(ready).select("_features", "label")
        forest = RandomForestClassifier(featuresCol="_features", labelCol="label", probabilityCol="_probability", rawPredictionCol="_raw", predictionCol="_prediction", numTrees=TREES, maxDepth=DEPTH, minInstancesPerNode=2, seed=SEED)
        scanner.model = forest.fit(ready)
    C.remove(known)
    return scanner


def judged(docs: DataFrame, label: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """The rows of scan(), and the table that they are read from, which holds values in plain text."""
    found = C.materialise(candidates(docs), "candidates")
    shaped = C.materialise(shapes(found, dictionary(docs)), "shapes")
    C.remove(found)
    labelled = label(shaped)
    scored = fit(labelled).score(labelled)
    return scored.withColumn("held_out", fold() == 0).withColumn("is_secret", (F.col("probability") >= CUT).cast("int")), shaped


def scan(docs: DataFrame, label: Callable[[DataFrame], DataFrame] = labelled_by_form) -> DataFrame:
    """(doc_id, th, place, run, value, word, features, label, held_out, probability, is_secret): every candidate of every row of docs.

    Null and empty texts have none; a null source is the empty one; ids may be null; a row that repeats in full counts once; words of any length are read in proportion to it; other columns are ignored. An empty table gives an empty one.
    Values are read from a table in the shared folder, which stays there until that is cleared; redact() and the query leave none.
    """
    return judged(docs, label)[0]


def masked(text: Column, spans: Column) -> Column:
    """The text with the runs of spans, an array of (place, runs), masked: words and spans are sorted together, so that a word's span stands before it."""
    steps, blanks = F.lit(STEPS), F.lit(C.BLANKS)
    words = F.transform(F.split(text, C.BLANKS), lambda w, p: F.struct(p.alias("p"), F.lit(1).alias("kind"), w.alias("w"), F.lit(None).cast("array<int>").alias("runs")))
    marks = F.transform(spans, lambda s: F.struct(s["place"].alias("p"), F.lit(0).alias("kind"), F.lit("").alias("w"), s["runs"].alias("runs")))
    row = F.struct(F.array_sort(F.concat(marks, words)).alias("all"), F.regexp_extract_all(text, blanks, F.lit(0)).alias("gaps"))

    def run_of(w: Column, runs: Column) -> Column:
        before, own = F.regexp_extract_all(w, steps, F.lit(1)), F.regexp_extract_all(w, steps, F.lit(2))

        def piece(z: Column, j: Column) -> Column:  # a value ends before its run's last stops, or takes the equals signs after the run
            gap = F.when(F.array_contains(runs, j - 1), F.regexp_replace(z["gap"], "^={1,2}", "")).otherwise(z["gap"])
            rest = F.when(F.startswith(z["next"], F.lit("=")), "").otherwise(F.regexp_extract(z["run"], "[.]*$", 0))
            return F.concat(gap, F.when(F.array_contains(runs, j), F.concat(F.lit(MASK), rest)).otherwise(z["run"]))

        after = F.concat(F.slice(before, F.lit(2), F.size(before)), F.array(F.lit("")))
        zipped = F.zip_with(F.zip_with(before, own, lambda g, r: F.struct(g.alias("gap"), r.alias("run"))), after, lambda z, n: F.struct(z["gap"].alias("gap"), z["run"].alias("run"), n.alias("next")))
        return F.array_join(F.transform(zipped, piece), "")

    def join(s: Column) -> Column:
        def word(x: Column, j: Column) -> Column:
            mark = F.get(s["all"], j - 1)
            own = F.when(mark["kind"] == 0, run_of(x["w"], mark["runs"])).otherwise(x["w"])
            return F.when(x["kind"] == 0, "").otherwise(F.concat(own, F.coalesce(F.get(s["gaps"], x["p"]), F.lit(""))))

        return F.array_join(F.transform(s["all"], word), "")

    return F.element_at(F.transform(F.array(row), join), 1)  # so that the sorted words are made once


def redact(docs: DataFrame) -> DataFrame:
    """docs with each secret masked where it was found, and n_chars counted anew; all other characters, rows and columns stay.

    Null and empty texts, and null ids, stay as they are; rows that repeat are masked alike. Columns of any name are kept, as the work's own are named apart from them.
    """
    row, secret = C.free_names(docs, "row", "secret")
    scored, shaped = judged(docs, labelled_by_form)
    words = scored.where("is_secret = 1").groupBy("doc_id", "th", "place").agg(F.array_sort(F.collect_set("run")).alias("runs"))
    found = words.groupBy("doc_id", "th").agg(F.collect_list(F.struct("place", "runs")).alias("spans"))
    found = C.materialise(found.select(F.xxhash64("doc_id", "th").alias("k"), "doc_id", "th", "spans"), "spans")
    C.remove(shaped)
    found = found.select(F.struct("k", "doc_id", "th", "spans").alias(secret))
    name = lambda c: F.col(f"`{c}`")
    th = F.xxhash64(F.coalesce(name("text").cast("string"), F.lit("")))
    own = F.struct(name("doc_id").cast("long").alias("doc_id"), th.alias("th"))
    both = docs.withColumn(row, own).join(found, (F.xxhash64(F.col(f"{row}.doc_id"), F.col(f"{row}.th")) == F.col(f"{secret}.k")) & F.col(f"{row}.doc_id").eqNullSafe(F.col(f"{secret}.doc_id")) & (F.col(f"{row}.th") == F.col(f"{secret}.th")), "left")
    spans = F.col(f"{secret}.spans")
    both = both.withColumn(row, F.when(spans.isNotNull(), masked(name("text").cast("string"), spans)))
    made = {"text": F.coalesce(F.col(row), name("text")).alias("text")}
    if "n_chars" in docs.columns:
        made["n_chars"] = F.when(F.col(row).isNull(), name("n_chars")).otherwise(F.char_length(F.col(row)).cast(docs.schema["n_chars"].dataType)).alias("n_chars")
    return both.select(*(made.get(c, name(c)) for c in docs.columns))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate of whole documents with its features and verdict; null, empty and repeated rows as in scan(). held_out: its value was not learned from. Values are written as hashes only."""
    found, shaped = judged(spark.read.parquet(f"{sf_dir}/documents.parquet"), labelled_by_form)
    out = C.materialise(found.select("doc_id", "place", "run", F.sha2(F.col("value").cast("binary"), 256).alias("value_sha256"), "word", *FEATURES, "label", "held_out", "probability", "is_secret"), "verdicts")
    C.remove(shaped)
    return out


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op2_secret_scan": op2_secret_scan}
SQL: dict[str, str] = {}
