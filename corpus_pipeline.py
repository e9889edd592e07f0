"""The corpus pipeline: documents in, packed training sequences out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from recordmill.llm import stages
from recordmill.llm.common import table, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", stages.good_quality),
    ("simhash_near_dedup", stages.one_of_each),
    ("suffix_array_dedup", stages.without_repeats),
    ("secret_scans", stages.without_secrets),
    ("best_fit_packing", stages.packed),
]

#: Classifier, fingerprints, suffix order and packing plan are beyond SQL; the tests compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
