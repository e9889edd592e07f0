"""Search within documents that never leave their row.

A document is cut once, into an array of chunks. One Arrow function embeds the chunks of a batch of documents, scores them against the
queries of each document's type and gives back the numbers of the best chunks. Texts are taken from the array beside it, so
there is no row per chunk, no window, no join and no exchange, and documents are read once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordmill.fixed import CATALOGS, CHUNK_OVERLAP, CHUNK_WORDS, CONTEXT_SEPARATOR, CONTEXT_TOP_K, EMBEDDING_DIM
from recordmill.functions.text import quote
from recordmill.functions.vectors import RANK_DIGITS, cosine_matrix, hashed_matrix
from recordmill.operators.chunking import chunk_array

#: From texts to a matrix with a row for each.
TextModel = Callable[[list[str]], np.ndarray]
#: Texts embedded at a time.
TEXTS = 1024
_HIT = pa.struct([("query_no", pa.int64()), ("rank", pa.int64()), ("chunk_index", pa.int64()), ("score", pa.float64())])


def hashed_model(dim: int = EMBEDDING_DIM) -> TextModel:
    """The built-in embedding."""
    known: dict[str, int] = {}
    return lambda texts: hashed_matrix(texts, dim, known)


def best_chunks(chunks: Column | str, doc_type: Column | str, catalog: str = "run", k: int = CONTEXT_TOP_K,
                make_model: Callable[[], TextModel] | None = None) -> Column:
    """The best ``k`` chunks of a document for each query of its type: ``array<struct<query_no, rank, chunk_index, score>>``.

    ``chunks`` is an array of texts; ``make_model`` runs once per task. Equal scores go to the earlier chunk; chunks
    and queries with a zero vector are not found. A document without chunks has an empty array.
    """
    queries, make = dict(CATALOGS[catalog]), make_model or hashed_model

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        model = make()
        asked = {name: np.asarray(model(list(texts)), np.float64) for name, texts in queries.items()}
        for lists, types in batches:
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            owner = np.repeat(np.arange(len(lists)), sizes)
            number = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            known = np.array([t if t in asked else "unknown" for t in types.to_pylist()], object)
            texts = lists.drop_null().flatten()
            found: list[np.ndarray] = []
            for start in range(0, len(owner), TEXTS):
                part = slice(start, start + TEXTS)
                matrix = np.asarray(model(texts[part].to_pylist()), np.float64)
                for name in set(known[owner[part]]):
                    at = np.flatnonzero(known[owner[part]] == name)
                    scores = cosine_matrix(matrix[at], asked[name])
                    row, query = np.nonzero(~np.isnan(scores))
                    here = start + at[row]
                    found.append(np.stack([owner[here], query, -np.round(scores[row, query], RANK_DIGITS), number[here], scores[row, query]]))
            cells = np.concatenate(found, axis=1) if found else np.zeros((5, 0))
            cells = cells[:, np.lexsort(cells[3::-1])]
            same = np.append(False, (cells[:2, 1:] == cells[:2, :-1]).all(axis=0)) if cells.shape[1] else np.zeros(0, bool)
            first = np.flatnonzero(~same)
            rank = np.arange(cells.shape[1]) - np.repeat(first, np.diff(np.append(first, cells.shape[1])))
            cells, rank = cells[:, rank < k], rank[rank < k]
            offsets = np.append(0, np.cumsum(np.bincount(cells[0].astype(np.int64), minlength=len(lists))))
            hits = pa.StructArray.from_arrays(
                [pa.array(cells[1].astype(np.int64)), pa.array(rank + 1), pa.array(cells[3].astype(np.int64)), pa.array(cells[4])], fields=list(_HIT))
            yield pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), hits)

    udf = F.arrow_udf(run, "array<struct<query_no: bigint, rank: bigint, chunk_index: bigint, score: double>>")
    return udf(chunks, doc_type)


def with_hits(docs: DataFrame, catalog: str = "run", k: int = CONTEXT_TOP_K, make_model: Callable[[], TextModel] | None = None,
              size: int = CHUNK_WORDS, overlap: int = CHUNK_OVERLAP, text: str = "text") -> DataFrame:
    """``docs`` (``doc_type`` and a text) with ``_chunks``, the array of its chunks' texts, and ``_hits`` as of :func:`best_chunks`."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and below size")
    cut = docs.withColumn("_chunks", F.transform(F.coalesce(chunk_array(text, size, overlap), F.expr("array()")), lambda c: c["text"]))
    return cut.withColumn("_hits", best_chunks("_chunks", "doc_type", catalog, k, make_model))


def fan_out(docs: DataFrame, catalog: str = "run", k: int = CONTEXT_TOP_K, make_model: Callable[[], TextModel] | None = None,
            size: int = CHUNK_WORDS, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """A row for each hit of ``docs`` (``filename, doc_type, text``), with the chunk's text."""
    ranked = with_hits(docs, catalog, k, make_model, size, overlap)
    # only the chosen texts are copied; the outer form, as an inner explosion would be planned with the search inside a filter
    hits = F.expr("transform(_hits, h -> named_struct('query_no', h.query_no, 'rank', h.rank, 'chunk_index', h.chunk_index,"
                  " 'score', round(h.score, 4), 'text', _chunks[cast(h.chunk_index as int)]))")
    rows = ranked.select(F.coalesce("filename", F.lit("unknown")).alias("filename"), "doc_type", hits.alias("_hits"))
    return rows.select("filename", "doc_type", F.explode_outer("_hits").alias("_hit")).filter("_hit is not null").select(
        "filename", "doc_type", F.concat("filename", F.lit("_chunk_"), F.col("_hit.chunk_index").cast("string")).alias("chunk_id"), "_hit.*")


def context_sql(dedupe_on: str = "chunk_id", separator: str = CONTEXT_SEPARATOR) -> str:
    """The distinct hits' texts in document order, joined; for rows of :func:`with_hits`. Empty if there are none."""
    texts = "transform(array_sort(array_distinct(transform(_hits, h -> cast(h.chunk_index as int)))), i -> _chunks[i])"
    distinct = f"array_distinct({texts})" if dedupe_on == "text" else texts
    return f"array_join({distinct}, {quote(separator)})"


def contexts(docs: DataFrame, catalog: str = "context", k: int = CONTEXT_TOP_K, dedupe_on: str = "chunk_id", separator: str = CONTEXT_SEPARATOR,
             make_model: Callable[[], TextModel] | None = None, size: int = CHUNK_WORDS, overlap: int = CHUNK_OVERLAP, text: str = "text") -> DataFrame:
    """``docs`` with ``context``."""
    ranked = with_hits(docs, catalog, k, make_model, size, overlap, text)
    return ranked.withColumn("context", F.expr(context_sql(dedupe_on, separator))).drop("_chunks", "_hits")
