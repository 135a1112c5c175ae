"""Corpus pipeline: quality rules, near-duplicates, secrets, mixing, tokens.

Each stage takes ``(spark, docs, sf_dir)`` and all rows that the stage before kept. Its documents are a
written table, so the tables that the stage before worked with are deleted when it begins.
"""

from __future__ import annotations

from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skerry.llm import bpe, mixing, quality, scratch, secrets, simhash


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; null and blank texts go, repeated rows are judged alike, empty tables stay empty."""
    return quality.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the smallest id: five-word shingles, similarity 0.8 or more.

    Null texts are equal texts; of a group without any id one document stays.
    """
    return simhash.deduplicate(docs)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with a mark in place of every secret; ``n_chars``, where there is one, follows. Null texts stay null."""
    out = docs.withColumn("text", secrets.redacted(docs["text"]))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def mixing_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; the null source is the last one, documents without words are not taken or taken at no cost."""
    return mixing.mixed(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with the document's language and source; a null text has none."""
    return bpe.tokenise(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep=("lang", "source"))


#: Folders of the tables behind the last stage's result, by session.
_behind: dict[str, frozenset[str]] = {}


def _stage(work):
    """The stage, which first deletes what the stage before has left, unless its documents still read that."""

    @wraps(work)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        session = spark.sparkContext.applicationId
        behind = _behind.pop(session, frozenset())
        if behind and not any(root in file for file in docs.inputFiles() for root in map(_path, behind)):
            scratch.release(spark, behind)
        before = scratch.held()
        out = work(spark, docs, sf_dir)
        _behind[session] = scratch.held() - before
        return out

    return run_stage


def _path(root: str) -> str:
    """A folder's path without its scheme, as it stands in the names of its files."""
    return root.split(":", 1)[-1].lstrip("/")


STAGES = [
    ("quality rules", _stage(quality_rules)),
    ("near-dedup", _stage(near_dedup)),
    ("secret scans", _stage(secret_scans)),
    ("mixing", _stage(mixing_to_weights)),
    ("byte-level BPE", _stage(tokens)),
]

#: Fingerprints, robust estimates and random rounding have no SQL form; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again by the next."""
    work = scratch.Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, work.write(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if k:
            work.drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
