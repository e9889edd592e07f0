"""Overlapping word chunks and routing by length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordmill.fixed import CHUNK_OVERLAP, CHUNK_WORDS, LONG_DOCUMENT_WORDS
from recordmill.functions.text import let_sql, py_round, word_count, words_sql


def chunk_total_sql(n_words: str, size: int = CHUNK_WORDS, overlap: int = CHUNK_OVERLAP) -> str:
    """Number of chunks of a text with ``n_words`` words; none for no words."""
    step = size - overlap
    return (f"cast(case when {n_words} = 0 then 0 when {n_words} <= {size} then 1"
            f" else ceil(({n_words} - {size}) / {step}D) + 1 end as int)")


def slice_sql(word_array: str, index: str, size: int = CHUNK_WORDS, overlap: int = CHUNK_OVERLAP) -> str:
    """Words of chunk ``index``, counted from 0."""
    return f"slice({word_array}, {index} * {size - overlap} + 1, {size})"


def chunk_array(text: str, size: int = CHUNK_WORDS, overlap: int = CHUNK_OVERLAP) -> Column:
    """All chunks of a text as ``array<struct<text, word_count>>``; the text is split once."""

    def cut(w: str) -> str:
        total = chunk_total_sql(f"size({w})", size, overlap)
        length = f"cast(least({size}, size({w}) - i * {size - overlap}) as bigint)"
        return (f"if(size({w}) > 0, transform(sequence(0, {total} - 1), i -> named_struct("
                f"'text', array_join({slice_sql(w, 'i', size, overlap)}, ' '), 'word_count', {length})), null)")

    return F.expr(let_sql(words_sql(text), cut))


def chunk_documents(
    docs: DataFrame, size: int = CHUNK_WORDS, overlap: int = CHUNK_OVERLAP, keep: tuple[str, ...] = ()
) -> DataFrame:
    """One row per chunk of every document with any words. No shuffle.

    ``docs`` needs ``filename`` and ``text``; columns in ``keep`` are carried along.
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and below size")
    cut = docs.select(
        *[F.coalesce(F.col("filename"), F.lit("unknown")).alias("filename")], *keep,
        chunk_array("text", size, overlap).alias("_chunks"),
    )
    # the outer form, since for the inner one the optimizer adds a size filter that
    # would cut every document a second time; blank documents give a null position
    exploded = cut.select(
        "filename", *keep, F.size("_chunks").cast("bigint").alias("total_chunks"),
        F.posexplode_outer("_chunks").alias("_pos", "_chunk"),
    ).filter("_pos is not null")
    return exploded.select(
        F.concat("filename", F.lit("_chunk_"), F.col("_pos").cast("string")).alias("chunk_id"),
        "filename", *keep, F.col("_pos").cast("bigint").alias("chunk_index"), "total_chunks",
        F.col("_chunk.word_count").alias("word_count"), F.col("_chunk.text").alias("text"),
    )


def chunk_summary(chunks: DataFrame, size: int = CHUNK_WORDS, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """Chunks and words per document, with the first chunk's preview."""
    preview = F.translate(F.substring("text", 1, 60), "\n", " ")
    return chunks.groupBy("filename").agg(
        F.count(F.lit(1)).alias("chunks"),
        F.sum("word_count").alias("total_words"),
        F.max(F.when(F.col("chunk_index") == 0, preview)).alias("preview"),
    ).withColumns({
        "chunk_size": F.lit(size).cast("bigint"), "overlap": F.lit(overlap).cast("bigint"),
    })


def route(docs: DataFrame, threshold: int = LONG_DOCUMENT_WORDS, override: bool | None = None) -> DataFrame:
    """Add ``word_count`` and ``use_retrieval`` (strictly above the threshold, unless overridden)."""
    long = F.col("word_count") > threshold if override is None else F.lit(override)
    return docs.withColumn("word_count", word_count("text")).withColumn("use_retrieval", long)


def reduction_percent(before: str, after: str) -> Column:
    """Whole percent of words saved."""
    return py_round(f"((1.0D - {after} / greatest({before}, 1)) * 100)", 0).cast("bigint")
