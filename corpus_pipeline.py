"""A corpus pipeline of five stages; each is written as Parquet and read again as the next one's documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from grovespark.llm import common, mixing, packing, secrets, simhash, toxicity

#: The share of tokens that the mixture takes; one epoch, so that no document comes twice.
MIX_SHARE = 0.9
#: Bytes of text that packing encodes at once: half the operator's own, as workers here have other stages' memory behind them.
PACK_CHUNK = 4 << 20


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go; null and empty texts score as empty ones, and repeated rows alike. An empty table gives an empty one."""
    return toxicity.keep_clean(docs, toxicity.fit_folds(spark, docs, sf_dir))


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays; null and blank texts are one group. Null ids, ties and repeats as in simhash.keep_first()."""
    return simhash.keep_first(docs)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; all documents stay, also repeated, null and empty ones."""
    return secrets.redact(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents within their leaf's budget stay, unchanged. Nulls, empty texts, ties and repeats as in mixing.select()."""
    return mixing.select(docs, share=MIX_SHARE, epochs=1).select("doc.*")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces with their sequences and places; null and empty texts are the end id alone, and repeated rows are packed each."""
    return packing.pack_documents(docs, PACK_CHUNK)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity_stage),
    ("simhash", simhash_stage),
    ("secrets", secrets_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: SQL can't express nearest neighbours, the forest or packing; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. Each stage's table is removed once the next one has read it; the packing stage has written its pieces when it returns."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES[:-1]:
        docs = common.materialise(stage(spark, docs, sf_dir), name)
        if before is not None:
            common.remove(before)
        before = docs
    out = STAGES[-1][1](spark, docs, sf_dir)
    common.remove(docs)
    return out
