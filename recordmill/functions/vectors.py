"""Hashed bag-of-words vectors and cosine similarity.

The default embedding counts the words of a chunk per hash bucket. Counts are
left unscaled: cosine does not depend on the length of a vector, and whole
numbers keep every engine and every summation order on the same value.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from recordmill.fixed import EMBEDDING_DIM
from recordmill.functions.text import let_sql

# scores closer than this many digits count as tied, so that units in the last
# place never decide an order
RANK_DIGITS = 9
# words whose buckets a task remembers before it starts over; every core of an executor holds so many, about 100 bytes each
_KNOWN_WORDS = 100_000


def word_buckets_sql(words: str, dim: int = EMBEDDING_DIM) -> str:
    """Bucket of every word: first 32 bits of the md5 of its lower case, modulo ``dim``."""
    return f"transform({words}, w -> cast(cast(conv(substr(md5(lower(w)), 1, 8), 16, 10) as bigint) % {dim} as int))"


def bucket_counts_sql(buckets: str) -> str:
    """``map<bucket, count>`` from run lengths of the sorted buckets, linear after the sort."""

    def from_sorted(s: str) -> str:
        starts = f"filter(sequence(0, size({s}) - 1), i -> not (get({s}, i) <=> get({s}, i - 1)))"
        return let_sql(starts, lambda p: (
            f"map_from_arrays(transform({p}, at -> get({s}, at)),"
            f" transform({p}, (at, j) -> coalesce(get({p}, j + 1), size({s})) - at))"
        ))

    return let_sql(buckets, lambda b: (
        f"if(size({b}) = 0, cast(map() as map<int,int>), {let_sql(f'sort_array({b})', from_sorted)})"))


def _bucket(word: str, dim: int) -> int:
    return int(hashlib.md5(word.lower().encode()).hexdigest()[:8], 16) % dim


def hashed_matrix(texts: list[str | None], dim: int, known: dict[str, int]) -> np.ndarray:
    """Word counts per bucket, one row per text. ``known`` remembers the buckets of words."""
    matrix = np.zeros((len(texts), dim), dtype=np.float32)
    for row, text in zip(matrix, texts):
        buckets = []
        for word in (text or "").split():
            at = known.get(word)
            if at is None:
                if len(known) >= _KNOWN_WORDS:
                    known.clear()
                at = known[word] = _bucket(word, dim)
            buckets.append(at)
        if buckets:
            row += np.bincount(buckets, minlength=dim)
    return matrix


def list_array(matrix: np.ndarray) -> pa.Array:
    offsets = np.arange(0, matrix.size + 1, matrix.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(matrix.reshape(-1)))


def embed_hashed(text: Column | str, dim: int = EMBEDDING_DIM) -> Column:
    """``array<float>`` of length ``dim`` with the word counts of a text.

    An Arrow UDF: hashing word by word in lambdas costs twenty times as much.
    """

    def vectors(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known: dict[str, int] = {}
        for batch in batches:
            yield list_array(hashed_matrix(batch.to_pylist(), dim, known))

    return F.arrow_udf(vectors, "array<float>")(text)


def matrix_of(column: pa.Array) -> np.ndarray:
    """Rows of a list column as a matrix of doubles; a null row becomes zeros."""
    if column.null_count:
        width = len(next((v for v in column if v.is_valid), []))
        column = pa.array([v if v is not None else [0.0] * width for v in column.to_pylist()], type=column.type)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def cosine_matrix(rows: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Cosine of every row with every query, NaN where either is zero."""
    scale = np.outer(np.linalg.norm(rows, axis=1), np.linalg.norm(queries, axis=1))
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(scale > 0, (rows @ queries.T) / scale, np.nan)


def norm_sql(a: str) -> str:
    return f"sqrt(aggregate({a}, 0D, (acc, x) -> acc + cast(x as double) * cast(x as double)))"


def norm(a: str) -> Column:
    return F.expr(norm_sql(a))


def cosine(a: str, b: str) -> Column:
    """Cosine similarity of two vector columns in doubles; null when either is zero or null."""

    def pairs(left: pa.Array, right: pa.Array) -> pa.Array:
        both = np.flatnonzero(left.is_valid().to_numpy(zero_copy_only=False) & right.is_valid().to_numpy(zero_copy_only=False))
        scores = np.full(len(left), np.nan)
        if not len(both):
            return pa.array(scores, mask=np.isnan(scores))
        x, y = (matrix_of(side.take(pa.array(both))) for side in (left, right))
        scale = np.linalg.norm(x, axis=1) * np.linalg.norm(y, axis=1)
        with np.errstate(divide="ignore", invalid="ignore"):
            scores[both] = np.where(scale > 0, np.einsum("ij,ij->i", x, y) / scale, np.nan)
        return pa.array(scores, mask=np.isnan(scores))

    return F.arrow_udf(pairs, "double")(F.expr(a), F.expr(b))


def query_counts(text: str, dim: int = EMBEDDING_DIM) -> Counter:
    """Bucket counts of a query text known when the plan is built."""
    return Counter(_bucket(w, dim) for w in text.split())


def query_literal_sql(texts: list[str], dim: int = EMBEDDING_DIM) -> str:
    """Queries as a constant ``array<struct<buckets, counts, norm>>``."""
    rows = []
    for text in texts:
        counts = query_counts(text, dim)
        keys = sorted(counts)
        squares = float(sum(c * c for c in counts.values()))
        rows.append(
            f"named_struct('buckets', array({', '.join(map(str, keys))}),"
            f" 'counts', array({', '.join(str(counts[k]) for k in keys)}), 'norm', sqrt({squares}D))"
        )
    return f"array({', '.join(rows)})"


def sparse_scores_sql(counts: str, queries: str) -> str:
    """Cosine of one chunk's bucket counts with each query, to ``RANK_DIGITS`` digits."""
    dot = (f"aggregate(zip_with(q.buckets, q.counts, (b, c) -> cast(coalesce(try_element_at({counts}, b), 0) as double)"
           f" * cast(c as double)), 0D, (acc, x) -> acc + x)")
    return let_sql(norm_sql(f"map_values({counts})"), lambda own: (
        f"transform({queries}, q -> round(try_divide({dot}, {own} * q.norm), {RANK_DIGITS}))"))
