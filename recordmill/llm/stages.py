"""Stages of the corpus pipeline: ``(spark, docs, sf_dir)`` to a DataFrame.

Every stage but the last returns the columns of ``docs``. Null ids, null texts, repeated
rows are handled as the operators say; further columns pass through as they are, whatever
their names. Where a text changes, ``n_chars``
follows it if there is such a column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordmill.llm import bpe, packing, quality_classifier, secrets, simhash, suffix_dedup
from recordmill.llm.common import prepared, spares, table, written
from recordmill.llm.queries import VOCABULARY

#: Documents with a lower calibrated score go.
QUALITY = 0.7


def _changed(docs: DataFrame, text: DataFrame) -> DataFrame:
    """``text`` with the columns of ``docs``, and the length of its text."""
    if "n_chars" in docs.columns:
        text = text.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return text.select(*docs.columns)


@spares("_stage_score", at=1)
def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose calibrated score is at least ``QUALITY``; the model learns from the labelled ones among them."""
    prepared(spark)
    features = written(quality_classifier.featurize(docs.select("doc_id", "text")).drop("text"), "features")
    rows = written(quality_classifier.labelled(features, table(spark, sf_dir, "labels")), "labelled")
    model = quality_classifier.fit(rows)
    scored = quality_classifier.score_texts(docs, model, out="_stage_score")
    return scored.filter(F.col("_stage_score") >= QUALITY).select(*docs.columns)


@spares("_stage_print", "_stage_row", "_stage_key", "_stage_first", at=1)
def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id."""
    prepared(spark)
    stored = written(simhash.fingerprints(docs, out="_stage_print").withColumn("_stage_row", F.monotonically_increasing_id()), "prints")
    rows = stored.select(F.struct("doc_id", "_stage_row").alias("_stage_key"), "_stage_print")
    grouped = simhash.group(rows, "_stage_key", "_stage_print", out="_stage_first")
    first = grouped.filter("_stage_key._stage_row = _stage_first._stage_row").select("_stage_key._stage_row")
    return stored.join(first, "_stage_row", "left_semi").select(*docs.columns)


@spares("_stage_text", "kept", "removed", at=1)
def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that repeat; a document goes if nothing but blanks is left of it."""
    prepared(spark)
    cut = suffix_dedup.remove(docs, decoded="_stage_text")
    left = cut.filter("size(removed) = 0 or _stage_text rlike r'[^\\x20\\x09-\\x0D]'")
    text = F.when(F.size("removed") > 0, F.col("_stage_text")).otherwise(F.col("text"))
    return _changed(docs, left.withColumn("text", text))


@spares("spans", at=1)
def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with every secret replaced by a mark."""
    prepared(spark)
    return _changed(docs, secrets.redact(secrets.find(docs)))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Best-fit packing: the pieces of every document, with their ids, and their places."""
    return packing.pack(packing.pieces(docs, bpe.Vocabulary(prepared(spark), VOCABULARY), payload="ids"))
