"""Corpus preparation: five stages, applied to ``documents`` one after another.

Every stage takes what its predecessor kept, at whole length, and its decisions
take effect: toxic documents and copies go, secrets are taken out of texts.  All
but the last return the columns they were given.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strandline.llm import exact_dedup, secret_scan, simhash, toxicity
from strandline.llm.queries import packed
from strandline.llm.shared import prepare, stage

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the learning fold of ``labels``, scores below one half."""
    labels = prepare(spark).read.parquet(f"{sf_dir}/labels.parquet")
    model, _ = toxicity.fit(docs, labels)
    return toxicity.reject(docs, model)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id."""
    prepare(spark)
    return exact_dedup.drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the row with the smallest doc_id."""
    prepare(spark)
    return simhash.drop_near_copies(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with findings replaced by their kind; n_chars is renewed where the text changes."""
    prepare(spark)
    return secret_scan.redact(docs, chars_col="n_chars" if "n_chars" in docs.columns else None)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences (see ``packing.pack``)."""
    prepare(spark)
    return packed(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxic),
    ("exact_dedup", exact_copies),
    ("simhash_near_dedup", near_copies),
    ("secret_scan", secrets),
    ("packing", packing),
]

#: A trained classifier and fingerprints are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the whole table, each one written before the next reads it."""
    docs = prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stage(docs, f"pipeline-{name}")
    return docs
