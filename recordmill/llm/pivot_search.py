"""Exact top-k by inner product over a pivot-distance index.

Vectors get one more coordinate that gives all the same length ``M``; for queries it is
zero. Then the squared distance of a query and a vector is ``|q|^2 + M^2 - 2 q.v``, so the
highest inner products are the nearest vectors, and the triangle inequality holds. Every
vector is keyed by its nearest pivot and its distance from it; blocks of a pivot's vectors
in order of distance are the annuli. A query knows from a sample how near its k-th best is
at most, which limits the annuli of each pivot it has to see; they are taken from the
nearest outward, and the limit shrinks as better vectors turn up. Bounds are widened by
rounding errors, and scores are computed in whole numbers, so the result is exact.

Pivots and first limits come from the ``SAMPLE`` vectors with the smallest hashes; the
index holds every vector. Queries travel in tiles, a hot pivot's annuli in blocks.

Defined results: components are ``floor(1024 x)``, held within 64 bits, and products wrap
beyond them as Spark's own do; vectors that are null, empty or hold a null or non-finite
component take no part, nor do rows without id; vectors of different lengths don't meet;
rows with one id are vectors of their own: a query's candidates are all rows but its own, and each
row that is asked for has ranks of its own; fewer candidates than ``k`` give fewer rows; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recordmill.llm.common import smallest_hashes, written

SCALE, K = 1024.0, 10
PIVOTS, SAMPLE = 64, 4096
BLOCK, TILE = 1024, 256


def whole(vectors: DataFrame, key: str, embedding: str) -> DataFrame:
    """``(row, id, dim, v, square)``: whole-numbered vectors as bytes, their squared lengths, and a number for each row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = batch.column(key).to_pylist(), batch.column(embedding)
            out: list[tuple] = []
            for i, row in zip(ids, rows):
                if i is None or not row.is_valid or not len(row.values) or row.values.null_count:
                    continue
                x = row.values.to_numpy(zero_copy_only=False).astype(np.float64)
                if np.isfinite(x).all():
                    v = np.clip(np.floor(SCALE * x), -(2.0**63), 2.0**63 - 1024).astype(np.int64)
                    out.append((i, len(v), v.tobytes(), float(np.square(v.astype(np.float64)).sum())))
            columns = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.binary(), pa.float64()))], names=["id", "dim", "v", "square"])

    made = vectors.select(F.col(key).cast("long").alias(key), embedding).mapInArrow(run, "id bigint, dim int, v binary, square double")
    return made.select(F.monotonically_increasing_id().alias("row"), "*")


class Space:
    """Pivots, first candidates and the common length of the vectors of one dimension."""

    def __init__(self, own: np.ndarray, rows: np.ndarray, top: float, pivots: int = PIVOTS):
        self.own, self.rows, self.top = own, rows, top
        self.pivots = self.lifted(rows[:pivots])

    def lifted(self, rows: np.ndarray) -> np.ndarray:
        x = rows.astype(np.float64)
        return np.hstack([x, np.sqrt(np.maximum(self.top - np.square(x).sum(1), 0))[:, None]])

    def from_pivots(self, points: np.ndarray) -> np.ndarray:
        square = np.square(points).sum(1)[:, None] + np.square(self.pivots).sum(1)[None, :] - 2 * points @ self.pivots.T
        return np.sqrt(np.maximum(square, 0))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, exact in 64 bits."""
    x, y = a.astype(np.float64), b.astype(np.float64)
    if np.sqrt(np.square(x).sum(1).max(initial=0) * np.square(y).sum(1).max(initial=0)) < 2**52:
        return (x @ y.T).astype(np.int64)
    return a @ b.T


def best(query: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int):
    """The ``k`` highest scores of every query, ties to the smaller id."""
    order = np.lexsort((ids, -scores.astype(np.float64), query)) if np.abs(scores).max(initial=0) < 2**52 else np.array(
        sorted(range(len(ids)), key=lambda i: (query[i], -int(scores[i]), ids[i])), np.int64)
    query, ids, scores = query[order], ids[order], scores[order]
    starts = np.flatnonzero(np.append(True, query[1:] != query[:-1])) if len(query) else np.zeros(0, np.int64)
    place = np.arange(len(query)) - np.repeat(starts, np.diff(np.append(starts, len(query))))
    return query[place < k], ids[place < k], scores[place < k]


def spaces(stored: DataFrame, sample: int = SAMPLE) -> dict[int, Space]:
    """From one row per dimension and the sample."""
    tops = {r.dim: r.top for r in stored.groupBy("dim").agg(F.max("square").alias("top")).collect()}
    rows = smallest_hashes(stored, sample, "id", "row").collect()
    found = {}
    for dim, top in tops.items():
        own = [r for r in rows if r.dim == dim]
        matrix = np.frombuffer(b"".join(r.v for r in own), np.int64).reshape(-1, dim)
        found[dim] = Space(np.array([r.row for r in own], np.int64), matrix, top)
    return found


def _matrix(batch: pa.RecordBatch, rows: np.ndarray, dim: int, column: str = "v") -> np.ndarray:
    return np.frombuffer(b"".join(batch.column(column)[i].as_py() for i in rows.tolist()), np.int64).reshape(-1, dim)


def index(stored: DataFrame, known: dict[int, Space], block: int = BLOCK) -> DataFrame:
    """The annuli: ``(cell, low, high, own, ids, rows)`` with at most ``block`` vectors in order of distance."""
    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = np.asarray(batch.column("dim"))
            cell, distance = np.zeros(len(dims), np.int64), np.zeros(len(dims))
            for dim in np.unique(dims).tolist():
                on, space = np.flatnonzero(dims == dim), known[dim]
                if len(space.pivots):
                    far = space.from_pivots(space.lifted(_matrix(batch, on, dim)))
                    cell[on], distance[on] = far.argmin(1), far.min(1)
                cell[on] += dim * PIVOTS
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "id", "v")), pa.array(cell), pa.array(distance)], names=["row", "id", "v", "cell", "distance"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def out() -> pa.RecordBatch:
            own, ids = (np.array([h[c] for h in held], np.int64).tobytes() for c in (2, 3))
            row = (held[0][0], held[0][1], held[-1][1], own, ids, b"".join(h[4] for h in held))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in row], names=["cell", "low", "high", "own", "ids", "rows"])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("cell", "distance", "row", "id", "v"))):
                if held and (row[0] != held[0][0] or len(held) >= block):
                    yield out()
                held.append(row)
        if held:
            yield out()

    keys = stored.select("row", "id", "dim", "v").mapInArrow(keyed, "row bigint, id bigint, v binary, cell bigint, distance double")
    ordered = keys.repartitionByRange("cell", "distance", "row").sortWithinPartitions("cell", "distance", "row")
    return ordered.mapInArrow(blocks, "cell bigint, low double, high double, own binary, ids binary, rows binary")


def tiles(queries: DataFrame, known: dict[int, Space], k: int, tile: int = TILE) -> DataFrame:
    """Tiles of queries for every pivot, with the range of distances that any of their queries has to see.

    ``limits`` holds the k-th best score of each query within the sample.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = np.asarray(batch.column("dim"))
            for dim in np.unique(dims).tolist():
                all_rows, space = np.flatnonzero(dims == dim), known[dim]
                for a in range(0, len(all_rows), tile):
                    on = all_rows[a : a + tile]
                    own, ids, rows = np.asarray(batch.column("row"))[on], np.asarray(batch.column("id"))[on], _matrix(batch, on, dim)
                    limits = np.full(len(on), -np.inf)
                    if len(space.rows) > k:
                        scores = products(rows, space.rows).astype(np.float64)
                        scores[own[:, None] == space.own[None, :]] = -np.inf
                        limits = -np.partition(-scores, k - 1, axis=1)[:, k - 1]
                    middle, reach, _ = _reach(space, rows, limits)
                    for pivot in range(max(1, len(space.pivots))):
                        near, far = (middle[:, pivot] - reach).min(), (middle[:, pivot] + reach).max()
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([x]) for x in (dim * PIVOTS + pivot, float(near), float(far), float(middle[:, pivot].mean()), dim, own.tobytes(), ids.tobytes(), rows.tobytes(), limits.tobytes())],
                            names=["cell", "near", "far", "middle", "dim", "queries", "query_ids", "query_rows", "limits"])

    return queries.mapInArrow(run, "cell bigint, near double, far double, middle double, dim bigint, queries binary, query_ids binary, query_rows binary, limits binary")


def _reach(space: Space, rows: np.ndarray, limits: np.ndarray):
    """Each query's distances from the pivots, and the distance beyond which nothing can reach its limit."""
    x = rows.astype(np.float64)
    square = np.square(x).sum(1)
    middle = space.from_pivots(np.hstack([x, np.zeros((len(x), 1))])) if len(space.pivots) else np.zeros((len(x), 1))
    slack = 1e-6 * (square + space.top) + 1
    return middle, np.sqrt(np.maximum(square + space.top - 2 * limits + slack, 0)) + 1e-6 * np.sqrt(square + space.top), square


def search(vectors: DataFrame, is_query: str, key: str = "vec_id", embedding: str = "embedding", k: int = K) -> DataFrame:
    """``(query_id, rank, vec_id, score)`` of the ``k`` best other vectors for every vector that ``is_query`` selects.

    ``is_query`` is SQL over the column ``id``.
    """
    stored = written(whole(vectors, key, embedding), "vectors")
    known = spaces(stored)
    annuli = written(index(stored, known), "annuli")
    asked = tiles(stored.filter(is_query), known, k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limit: dict[int, float] = {}
        named: dict[int, int] = {}
        pool = [np.zeros(0, np.int64)] * 3

        def reduced(pool):
            out = best(*pool, k)
            ids, first, many = np.unique(out[0], return_index=True, return_counts=True)
            for q, a, n in zip(ids.tolist(), first.tolist(), many.tolist()):
                if n == k:
                    limit[q] = max(limit.get(q, -np.inf), float(out[2][a + n - 1]))
            return list(out)

        for batch in batches:
            for i in range(batch.num_rows):
                cell, low, high, dim, rows, query_rows, limits = (batch.column(c)[i].as_py() for c in ("cell", "low", "high", "dim", "rows", "query_rows", "limits"))
                own, ids, queries, query_ids = (np.frombuffer(batch.column(c)[i].as_py(), np.int64) for c in ("own", "ids", "queries", "query_ids"))
                limits = np.frombuffer(limits)
                named.update(zip(queries.tolist(), query_ids.tolist()))
                rows, query_rows = (np.frombuffer(x, np.int64).reshape(-1, dim) for x in (rows, query_rows))
                limits = np.maximum(limits, [limit.get(q, -np.inf) for q in queries.tolist()])
                middle, reach, _ = _reach(known[dim], query_rows, limits)
                middle = middle[:, cell - dim * PIVOTS]
                on = np.flatnonzero(np.maximum(low - middle, middle - high) <= reach)
                if not len(on):
                    continue
                scores = products(query_rows[on], rows)
                q, v = np.nonzero((scores >= limits[on, None]) & (own[None, :] != queries[on, None]))
                pool = [np.concatenate(x) for x in zip(pool, (queries[on[q]], ids[v], scores[q, v]))]
                pool = reduced(pool)
        ids = np.array([named[q] for q in pool[0].tolist()], np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (pool[0], ids, *pool[1:])], names=["row", "query_id", "vec_id", "score"])

    met = annuli.join(asked, "cell").filter("high >= near and low <= far")
    outward = met.sortWithinPartitions(F.greatest(F.col("low") - F.col("middle"), F.col("middle") - F.col("high"), F.lit(0.0)))
    found = outward.mapInArrow(run, "row bigint, query_id bigint, vec_id bigint, score bigint")
    order = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
