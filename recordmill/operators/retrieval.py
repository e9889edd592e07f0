"""Embedding, cosine top-k and context assembly."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordmill.fixed import (
    CATALOGS, CHUNK_OVERLAP, CHUNK_WORDS, CONTEXT_SEPARATOR, CONTEXT_TOP_K, EMBEDDING_DIM,
    RUN_SEPARATOR, RUN_TOP_K,
)
from recordmill.functions.text import let_sql, quote, words_sql
from recordmill.functions.vectors import (
    RANK_DIGITS, bucket_counts_sql, cosine_matrix, embed_hashed, matrix_of, query_literal_sql,
    sparse_scores_sql, word_buckets_sql,
)
from recordmill.operators.chunking import chunk_total_sql, slice_sql
from recordmill.operators.in_row import TextModel
from recordmill.session import scratch_path, small_table

# rows of a block: 1,024 x 384 doubles are 3 MB
BLOCK = 1024
# queries a catalogue may hold; it travels with every task
CATALOG_LIMIT = 1024
# queries of a block: 4,096 x 384 floats are 6 MB; blocks of vectors in a part of the grid; parts merged at a time
QUERY_BLOCK, CELL_BLOCKS, MERGE = 4096, 64, 64
# the most that a block of queries may have to be sent to every task
SENT_BYTES = 32 << 20

Embedder = Callable[[Column], Column]


def embed(rows: DataFrame, embedder: Embedder | None = None, text: str = "text",
          dim: int = EMBEDDING_DIM) -> DataFrame:
    """Add ``embedding``. ``embedder`` may be a scalar pandas UDF around a real model."""
    vector = (embedder or (lambda column: embed_hashed(column, dim)))(F.col(text))
    return rows.withColumn("embedding", vector)


def model_embedder(make_model: Callable[[], TextModel], batch: int = 256) -> Embedder:
    """An own model as an embedder: served by ``predict_batch_udf``, made once per Python worker, given ``batch`` texts at a time.

    A null text is embedded as an empty one.
    """

    def make_predict() -> Callable[[np.ndarray], np.ndarray]:
        model = make_model()
        return lambda texts: np.asarray(model([t if isinstance(t, str) else "" for t in texts.tolist()]), np.float32)

    predict = predict_batch_udf(make_predict, return_type=T.ArrayType(T.FloatType()), batch_size=batch)
    return lambda text: predict(F.coalesce(text, F.lit("")))


def query_catalog(spark: SparkSession, catalog: str = "run") -> DataFrame:
    rows = [
        (catalog, doc_type, number, text)
        for doc_type, texts in CATALOGS[catalog].items()
        for number, text in enumerate(texts)
    ]
    return small_table(spark, ["catalog", "doc_type", "query_no", "query_text"], rows)


def query_type(doc_type: str = "doc_type") -> Column:
    """Whose queries a document gets: those of its type, or the ``unknown`` ones."""
    known = [t for t in CATALOGS["run"] if t != "unknown"]
    return F.when(F.col(doc_type).isin(known), F.col(doc_type)).otherwise(F.lit("unknown"))


def resolve_queries(docs: DataFrame, catalog: DataFrame) -> DataFrame:
    """Each document with the queries of its type, or the ``unknown`` ones.

    The catalogue is a local relation, so its size is known to the optimizer and
    it is broadcast only while that is small.
    """
    return docs.withColumn("_type", query_type()).join(
        catalog.withColumnRenamed("doc_type", "_type"), "_type"
    ).drop("_type")


def _rank_key(score: Column) -> Column:
    # a few units in the last place must not decide the order
    return F.round(score, RANK_DIGITS)


def _top(scored: DataFrame, keys: list[str], k: int, tie: str) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.col("_key").desc(), F.col(tie))
    # the rank filter also prunes inside each task before the exchange
    return scored.withColumn("rank", F.row_number().over(order).cast("bigint")).filter(F.col("rank") <= k)


def _keep_top(scored: DataFrame, keys: list[str], k: int, tie: str) -> DataFrame:
    return _top(scored.filter(F.col("_key").isNotNull()), keys, k, tie).drop("_key")


def _written(rows: DataFrame, name: str) -> DataFrame:
    """A table in the shared folder, so that rows are computed once and their size is known."""
    path = scratch_path(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def search_within(
    vectors: DataFrame, queries: DataFrame, k: int = CONTEXT_TOP_K, on: str = "filename",
    embedder: Embedder | None = None, carry: tuple[str, ...] = (),
) -> DataFrame:
    """Best ``k`` chunks per document and query of the document's type.

    ``vectors``: ``filename, doc_type, chunk_id, chunk_index, embedding`` and ``carry``; chunks without a
    vector are not found. ``queries`` is a catalogue (``doc_type, query_no, query_text``) of at most
    ``CATALOG_LIMIT`` rows; it travels with the tasks, which score a chunk against its type's queries at
    once. Hits are ranked by ids and scores alone: ``carry`` is repeated for each query, so texts are
    better cut out of the source afterwards.
    """
    asked = embed(queries, embedder, "query_text").select("doc_type", "query_no", "embedding").limit(CATALOG_LIMIT + 1).collect()
    if len(asked) > CATALOG_LIMIT:
        raise ValueError(f"a catalogue has at most {CATALOG_LIMIT} queries; use search() for more")
    by_type: dict[str, tuple[list[int], np.ndarray]] = {}
    for doc_type in {r["doc_type"] for r in asked}:
        own = [r for r in asked if r["doc_type"] == doc_type]
        by_type[doc_type] = ([r["query_no"] for r in own], np.array([r["embedding"] for r in own], dtype=np.float64))

    def score(embedding: pa.Array, doc_type: pa.Array) -> pa.Array:
        types = np.array(doc_type.to_pylist(), dtype=object)
        cells: list[list | None] = [None] * len(types)
        valid = embedding.is_valid().to_numpy(zero_copy_only=False)
        for name, (numbers, wanted) in by_type.items():
            at = np.flatnonzero((types == name) & valid)
            if len(at):
                rows = matrix_of(embedding.take(pa.array(at)))
                for row, scores in zip(at, cosine_matrix(rows, wanted).tolist()):
                    cells[row] = [{"query_no": n, "score": s} for n, s in zip(numbers, scores)]
        return pa.array(cells, type=pa.list_(pa.struct([("query_no", pa.int64()), ("score", pa.float64())])))

    scorer = F.arrow_udf(score, "array<struct<query_no: bigint, score: double>>")
    kept = [on, "doc_type", "chunk_id", "chunk_index", *carry]
    typed = vectors.withColumn("_type", query_type())
    hits = typed.select(*kept, F.inline_outer(scorer("embedding", "_type")).alias("query_no", "_score"))
    scored = hits.withColumn("_score", F.when(~F.isnan("_score"), F.col("_score"))).select(
        *kept, "query_no", F.round("_score", 4).alias("score"), _rank_key(F.col("_score")).alias("_key"),
    )
    return _keep_top(scored, [on, "query_no"], k, "chunk_index")


def _blocks(rows: DataFrame, id_column: str, block: int | None) -> DataFrame:
    """Rows ``id_column, embedding`` as blocks: ids, and the vectors as the bytes of a matrix in the type they have.

    Vectors of one width make a block, of at most ``block`` rows; without a bound there is one for each width and task.
    Rows without a vector are left out here and not by a filter, which would compute the vectors twice.
    """
    kind = rows.schema[id_column].dataType.simpleString()
    number = "<f4" if rows.schema["embedding"].dataType.elementType.simpleString() == "float" else "<f8"

    def sent(width: int, parts: list[tuple[pa.Array, np.ndarray]]) -> pa.RecordBatch:
        ids = pa.concat_arrays([ids for ids, _ in parts])
        lists = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
        matrix = b"".join(values.tobytes() for _, values in parts)
        return pa.RecordBatch.from_arrays([lists, pa.array([width], pa.int32()), pa.array([matrix], pa.binary())], names=["ids", "width", "matrix"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, list[tuple[pa.Array, np.ndarray]]] = {}
        size: dict[int, int] = {}
        for batch in batches:
            vectors, ids = batch.column("embedding"), batch.column("id")
            widths = pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False)
            for width in np.unique(widths[widths > 0]).tolist():
                at = np.flatnonzero(widths == width)
                step = block or len(at)
                for start in range(0, len(at), step):
                    own = pa.array(at[start : start + step])
                    part = (ids.take(own), vectors.take(own).flatten().to_numpy(zero_copy_only=False).astype(number))
                    if block and size.get(width, 0) + len(own) > block:
                        yield sent(width, kept.pop(width))
                        size[width] = 0
                    kept.setdefault(width, []).append(part)
                    size[width] = size.get(width, 0) + len(own)
        for width, parts in kept.items():
            yield sent(width, parts)

    chosen = rows.select(F.col(id_column).alias("id"), "embedding")
    return chosen.mapInArrow(run, f"ids array<{kind}>, width int, matrix binary")


class _Heaps:
    """The best ``k`` rows of every query of one block; what is held grows with the queries of the block alone."""

    def __init__(self, queries: int, k: int):
        self.k, self.worst = k, np.full(queries, -np.inf)
        self.kept: list[pa.Table] = []
        self.size = 0

    def add(self, scores: np.ndarray, ids: pa.Array) -> None:
        """``scores``: a row for each id, a column for each query."""
        # once limits are known few scores come near them; only these are rounded and kept
        row, query = np.nonzero(scores >= self.worst - 10.0 ** -RANK_DIGITS) if np.isfinite(self.worst).any() else (None, None)
        if row is not None and len(row) <= self.k * len(self.worst):
            keys = np.round(scores[row, query], RANK_DIGITS)
            kept = keys >= self.worst[query]
            row, query, keys = row[kept], query[kept], keys[kept]
            full = False
        else:
            rounded = np.round(scores, RANK_DIGITS)
            rounded[np.isnan(rounded)] = -np.inf
            least = self.worst
            if len(rounded) > self.k:
                # everything tied with the k-th key stays until ids decide
                least = np.maximum(least, np.partition(rounded, -self.k, axis=0)[-self.k])
            query, row = np.nonzero(((rounded >= least) & (rounded > -np.inf)).T)
            keys = rounded[row, query]
            full = True
        if len(query):
            self.kept.append(pa.table({"query": query, "key": keys, "id": ids.take(pa.array(row)), "score": scores[row, query]}))
            self.size += len(query)
            if full or self.size > 4 * self.k * len(self.worst):
                self.settle()

    def settle(self) -> pa.Table | None:
        if not self.kept:
            return None
        rows = pa.concat_tables(self.kept)
        rows = rows.take(pc.sort_indices(rows, [("query", "ascending"), ("key", "descending"), ("id", "ascending")]))
        query = rows.column("query").to_numpy()
        first = np.flatnonzero(np.append(True, query[1:] != query[:-1]))
        place = np.arange(len(query)) - np.repeat(first, np.diff(np.append(first, len(query))))
        rows = rows.filter(pa.array(place < self.k))
        last = np.flatnonzero((place == self.k - 1))
        self.worst[query[last]] = rows.column("key").to_numpy()[np.flatnonzero(place[place < self.k] == self.k - 1)]
        self.kept, self.size = [rows], rows.num_rows
        return rows


def search(vectors: DataFrame, queries: DataFrame, k: int = CONTEXT_TOP_K, id_column: str = "chunk_id", block: int = BLOCK,
           query_block: int = QUERY_BLOCK, cell: int = CELL_BLOCKS) -> DataFrame:
    """Exact best ``k`` rows of ``vectors`` (``id_column, embedding``) for every query.

    ``queries``: ``query_id, embedding``, any number of them; several vectors of one query compete
    for its ``k`` places. Null and empty vectors are not searched, and vectors of different widths do not meet.

    Both sides become blocks of bytes in the type of their vectors. Queries of one block, of a checked size, travel to the
    vectors, which are then neither stored nor exchanged. More queries make a grid: blocks of vectors are dealt out over parts of ``cell`` blocks, counted in the input, and a cell of the
    grid is one part of vectors and one block of queries. A task holds one block of queries and ``k`` hits for each; the hits of
    the cells are merged in steps of ``MERGE`` parts. Pairs never become rows.
    """
    id_type = vectors.schema[id_column].dataType.simpleString()
    asked = _written(queries.select("query_id", "embedding"), "queries")
    rows, numbers = asked.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("embedding")), F.lit(0))).first()
    blocks = max(1, -(-rows // query_block))
    named = {"ids": "queries", "matrix": "wanted"}
    stored, parts = _blocks(vectors, id_column, block), 1
    if blocks == 1 and 8 * numbers <= SENT_BYTES:
        wanted = _blocks(asked.coalesce(1), "query_id", None).withColumnsRenamed(named).withColumn("query_part", F.lit(0))
        met = stored.withColumn("part", F.lit(0)).join(F.broadcast(wanted), "width")
    else:
        wanted = _blocks(asked.repartition(blocks), "query_id", None).withColumnsRenamed(named).withColumn("query_part", F.spark_partition_id())
        stored = _written(stored, "vector_blocks")
        # a cell is much work on few bytes, so cells are tasks by number; small tables are cut finer, to give every core some
        held = stored.count()
        parts = max(1, -(-held // cell), min(held, -(-2 * vectors.sparkSession.sparkContext.defaultParallelism // blocks)))
        keys = ["part", "query_part", "width"]
        dealt = stored.withColumn("part", F.pmod(F.xxhash64("matrix"), F.lit(parts)).cast("int")).withColumn(
            "query_part", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).repartition(parts * blocks, *keys).sortWithinPartitions(*keys)
        met = dealt.join(_written(wanted, "query_blocks").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).repartition(parts * blocks, *keys), keys)
    number = {c: "<f4" if df.schema["embedding"].dataType.elementType.simpleString() == "float" else "<f8" for c, df in (("matrix", vectors), ("wanted", queries))}
    names = ["part", "query_id", id_column, "_score", "_key"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, heaps, asking = None, None, None

        def hits() -> Iterator[pa.RecordBatch]:
            rows = heaps.settle() if heaps is not None else None
            if rows is not None:
                cells = [pa.array(np.full(rows.num_rows, at[0], np.int32)), asking.take(rows.column("query").combine_chunks()), *(rows.column(c).combine_chunks() for c in ("id", "score", "key"))]
                yield pa.RecordBatch.from_arrays(cells, names=names)

        for batch in batches:
            for i in range(batch.num_rows):
                width = batch.column("width")[i].as_py()
                where = (batch.column("part")[i].as_py(), batch.column("query_part")[i].as_py(), width)
                if where != at:
                    yield from hits()
                    at, asking = where, batch.column("queries")[i].values
                    against = np.frombuffer(batch.column("wanted")[i].as_buffer(), number["wanted"]).reshape(-1, width).astype(np.float64)
                    heaps = _Heaps(len(asking), k)
                rows = np.frombuffer(batch.column("matrix")[i].as_buffer(), number["matrix"]).reshape(-1, width).astype(np.float64)
                heaps.add(cosine_matrix(rows, against), batch.column("ids")[i].values)
        yield from hits()

    schema = f"part int, query_id {queries.schema['query_id'].dataType.simpleString()}, {id_column} {id_type}, _score double, _key double"
    best = met.select("part", "query_part", "width", "queries", "wanted", "ids", "matrix").mapInArrow(run, schema)
    while parts > MERGE:
        parts = -(-parts // MERGE)
        best = _top(best.withColumn("part", F.expr(f"part div {MERGE}").cast("int")), ["query_id", "part"], k, id_column).drop("rank")
    return _keep_top(best.drop("part"), ["query_id"], k, id_column).withColumn("score", F.round("_score", 4)).drop("_score")


def with_texts(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Hits with the text of their chunks, looked up after the ranking. A chunk is known by document and number.

    Chunks of one document are cut from one text, so a repeated one is the same.
    """
    wanted = hits.select("filename", "chunk_index").distinct()
    texts = chunks.select("filename", "chunk_index", "text").join(wanted, ["filename", "chunk_index"], "left_semi").dropDuplicates(["filename", "chunk_index"])
    return hits.join(texts, ["filename", "chunk_index"])


def dedupe_hits(hits: DataFrame, on: str = "chunk_id") -> DataFrame:
    """One hit per document and chunk id (or chunk text), the earliest chunk of each.

    Hits are at most ``k`` per query, so the groups stay small however long a document is.
    """
    order = Window.partitionBy("filename", on).orderBy("chunk_index", "query_no")
    return hits.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def assemble_context(hits: DataFrame, separator: str = CONTEXT_SEPARATOR) -> DataFrame:
    """Texts of a document's distinct hits in document order, joined."""
    ordered = F.array_sort(F.collect_list(F.struct("chunk_index", "text")))
    return hits.groupBy("filename").agg(
        F.array_join(F.transform(ordered, lambda h: h["text"]), separator).alias("context")
    )


def relevant_context(
    vectors: DataFrame, catalog: str = "context", k: int = CONTEXT_TOP_K,
    dedupe_on: str = "chunk_id", separator: str = CONTEXT_SEPARATOR, embedder: Embedder | None = None,
    docs: DataFrame | None = None,
) -> DataFrame:
    """Context per document of a chunk vector table: fan out, top-k, dedupe, join.

    A document none of whose chunks is found has the empty context; ``docs`` (``filename``) also lists
    those that have no chunks at all.
    """
    queries = query_catalog(vectors.sparkSession, catalog)
    hits = with_texts(search_within(vectors, queries, k, embedder=embedder), vectors)
    found = assemble_context(dedupe_hits(hits, dedupe_on), separator)
    names = (vectors if docs is None else docs).select(F.coalesce("filename", F.lit("unknown")).alias("filename")).distinct()
    return names.join(found, "filename", "left").withColumn("context", F.coalesce("context", F.lit("")))


def context_of(
    text: str, doc_type: str, catalog: str = "run", k: int = RUN_TOP_K,
    separator: str = RUN_SEPARATOR, size: int = CHUNK_WORDS, overlap: int = CHUNK_OVERLAP,
    dim: int = EMBEDDING_DIM,
) -> Column:
    """``relevant_context`` (deduped by text) with the hashed embedding, within the row.

    A document's chunks all come from its own row, so chunking, scoring, top-k and
    joining need neither a join nor an exchange. ``text`` and ``doc_type`` name columns.
    """
    lists = CATALOGS[catalog]
    branches = " ".join(
        f"when '{name}' then {query_literal_sql(texts, dim)}" for name, texts in lists.items() if name != "unknown"
    )
    queries = f"case {doc_type} {branches} else {query_literal_sql(lists['unknown'], dim)} end"

    def pick(w: str, b: str, q: str) -> str:
        counts = bucket_counts_sql(slice_sql(b, "i", size, overlap))
        scored = (f"transform(sequence(0, {chunk_total_sql(f'size({w})', size, overlap)} - 1),"
                  f" i -> {let_sql(counts, lambda m: sparse_scores_sql(m, q))})")

        def best(scores: str) -> str:
            ranked = (f"array_sort(filter(transform({scores}, (s, at) -> named_struct('key', -get(s, n), 'at', at)),"
                      f" c -> c.key is not null))")
            per_query = f"transform(sequence(0, size({q}) - 1), n -> slice({ranked}, 1, {k}))"
            chosen = f"array_sort(array_distinct(transform(flatten({per_query}), c -> c.at)))"
            texts = f"transform({chosen}, i -> array_join({slice_sql(w, 'i', size, overlap)}, ' '))"
            return f"array_join(array_distinct({texts}), {quote(separator)})"

        return f"if(size({w}) = 0, '', {let_sql(scored, best)})"

    return F.expr(let_sql(words_sql(text), lambda w: let_sql(
        word_buckets_sql(w, dim), lambda b: let_sql(queries, lambda q: pick(w, b, q)))))
