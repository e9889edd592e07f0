"""Embedding, search and context against brute force."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordmill.fixed import RUN_QUERIES, RUN_SEPARATOR
from recordmill.functions.text import words_sql
from recordmill.functions.vectors import RANK_DIGITS, bucket_counts_sql, cosine, hashed_matrix, word_buckets_sql
from recordmill.operators import retrieval, store
from recordmill.operators.chunking import chunk_documents
from recordmill.testbed import fixtures as fx

from conftest import SF_DIR


@pytest.fixture(scope="module")
def documents(spark):
    return fx.spark_layers(fx.read(spark, SF_DIR, "documents"), fx.DOCUMENTS).cache()


@pytest.fixture(scope="module")
def vectors(documents):
    return retrieval.embed(chunk_documents(documents, keep=("doc_type",))).cache()


def brute(rows, queries, k, tie):
    """Best k per query of (tie, vector) rows by cosine to nine digits, then the tie value."""
    out = {}
    for name, vector in queries:
        scored = []
        for key, row in rows:
            scale = np.linalg.norm(row) * np.linalg.norm(vector)
            if scale:
                scored.append((-round(float(np.dot(row, vector) / scale), 9), tie(key), key))
        out[name] = [s[2] for s in sorted(scored)[:k]]
    return out


def test_expression_and_arrow_embeddings_agree(spark, vectors):
    counts = F.expr(bucket_counts_sql(word_buckets_sql(words_sql("text"))))
    for r in vectors.select("embedding", counts.alias("counts")).collect():
        assert {i: v for i, v in enumerate(r["embedding"]) if v} == r["counts"]


def test_embedding_of_blank_text_is_zero(one):
    assert set(hashed_matrix(["", None], 8, {}).ravel()) == {0.0}
    assert one(F.expr(bucket_counts_sql(word_buckets_sql(words_sql("t")))), t=" ") == {}


def test_cosine_of_a_zero_vector_is_null(spark):
    rows = spark.createDataFrame([([1.0, 2.0], [2.0, 4.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<float>, b array<double>")
    got = [r[0] for r in rows.select(cosine("a", "b")).collect()]
    assert got[0] == pytest.approx(1.0) and got[1] is None


@pytest.mark.parametrize(("k", "block", "query_block", "cell"), [(3, 1024, 4096, 64), (3, 2, 2, 1), (1, 3, 1, 2)])
def test_search_is_exact_in_any_number_of_blocks(spark, vectors, k, block, query_block, cell):
    rng = np.random.default_rng(k)
    queries = [(q, rng.random(384).tolist()) for q in range(5)]
    asked = spark.createDataFrame(queries, "query_id bigint, embedding array<double>")
    got = {}
    for r in retrieval.search(vectors, asked, k, block=block, query_block=query_block, cell=cell).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = r["chunk_id"]
    rows = [(r["chunk_id"], np.array(r["embedding"])) for r in vectors.collect()]
    want = brute(rows, [(q, np.array(v)) for q, v in queries], k, lambda key: key)
    assert {q: [hits[i] for i in sorted(hits)] for q, hits in got.items()} == want


@pytest.mark.parametrize(("query_block", "cell", "merge"), [(4096, 64, 64), (7, 3, 2), (3, 1, 3)])
def test_search_with_ties_nulls_and_several_widths(spark, monkeypatch, query_block, cell, merge):
    """Both ways, and a grid whose cells are merged in several steps; ids are texts, many scores are the same."""
    monkeypatch.setattr(retrieval, "MERGE", merge)
    pick = np.random.default_rng(7)
    rows = [(f"v{i}", pick.integers(0, 3, size=4 if i % 5 else 2).astype(float).tolist()) for i in range(160)]
    rows += [("null", None), ("empty", []), ("zero", [0.0] * 4), ("nan", [float("nan")] + [1.0] * 3), ("v1", [1.0, 1.0, 1.0, 1.0])]
    queries = [(q, pick.integers(0, 3, size=4 if q % 3 else 2).astype(float).tolist()) for q in range(20)] + [(3, [0.0, 1.0, 0.0, 1.0]), (99, None), (98, [0.0] * 4), (97, [1.0])]
    stored = spark.createDataFrame(rows, "chunk_id string, embedding array<float>").repartition(3)
    asked = spark.createDataFrame(queries, "query_id int, embedding array<double>").repartition(4)
    found = {}
    for r in retrieval.search(stored, asked, 6, block=5, query_block=query_block, cell=cell).collect():
        found.setdefault(r["query_id"], {})[r["rank"]] = (r["chunk_id"], r["score"])
    want = {}
    for q, v in queries:
        for name, w in rows:
            if v and w and len(v) == len(w) and any(v) and any(w) and not np.isnan(w).any():
                score = float(np.dot(v, w) / (np.linalg.norm(v) * np.linalg.norm(w)))
                want.setdefault(q, []).append((-round(score, RANK_DIGITS), name))
    want = {q: [(name, pytest.approx(-key, abs=1e-4)) for key, name in sorted(hits)[:6]] for q, hits in want.items()}
    assert {q: [hits[i] for i in sorted(hits)] for q, hits in found.items()} == want


def test_a_catalogue_meets_vectors_where_they_are(spark, vectors):
    """One embedding, one pass over the vectors; what is exchanged is hits."""
    texts = spark.createDataFrame([(f"c{i}", f"word{i} same") for i in range(50)], "chunk_id string, text string").repartition(2)
    asked = spark.createDataFrame([("q", "same"), ("r", "word3")], "query_id string, text string")
    found = retrieval.search(retrieval.embed(texts), retrieval.embed(asked), 2)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "Generate" not in plan
    physical = found._jdf.queryExecution().executedPlan().toString()
    assert physical.count("Exchange hashpartitioning(query_id") == 1 and "hashpartitioning(width" not in physical
    assert {r["query_id"]: r["chunk_id"] for r in found.collect() if r["rank"] == 1}["r"] == "c3"


def test_search_small_and_empty_stores(spark, vectors):
    one = vectors.limit(1).cache()
    asked = one.select(F.lit("q").alias("query_id"), "embedding")
    assert retrieval.search(one, asked, 5).count() == 1
    assert retrieval.search(one.filter("false"), asked, 5).count() == 0
    assert retrieval.search(one, asked.filter("false"), 5).count() == 0


def test_ties_are_broken_by_id_over_all_tasks(spark):
    # one vector copied many times: the smallest ids win wherever they are
    rows = spark.range(0, 3000, 1, 8).select(
        F.format_string("c%05d", "id").alias("chunk_id"), F.array(F.lit(1.0), F.lit(1.0)).alias("embedding"))
    asked = spark.createDataFrame([("q", [1.0, 0.5])], "query_id string, embedding array<double>")
    got = [r["chunk_id"] for r in retrieval.search(rows.orderBy(F.rand(1)), asked, 4).sort("rank").collect()]
    assert got == ["c00000", "c00001", "c00002", "c00003"]


def test_vectors_of_one_query_compete_and_null_vectors_are_left_out(spark):
    rows = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [1.0, 1.0]), ("d", None)], "chunk_id string, embedding array<double>")
    asked = spark.createDataFrame([("q", [1.0, 0.0]), ("q", [0.0, 1.0]), ("n", None)], "query_id string, embedding array<double>")
    for block in (1, 1024):
        got = retrieval.search(rows, asked, 2, block=block).sort("rank").collect()
        assert [(r["query_id"], r["chunk_id"], r["score"]) for r in got] == [("q", "a", 1.0), ("q", "b", 1.0)]
    none = rows.filter("embedding is null")
    assert retrieval.search(none, asked, 2).count() == 0
    assert none.select(cosine("embedding", "embedding").alias("c")).first()["c"] is None


def test_a_catalogue_is_bounded(spark, vectors):
    many = spark.range(1025).select(F.lit("email").alias("doc_type"), F.col("id").alias("query_no"), F.lit("x").alias("query_text"))
    with pytest.raises(ValueError):
        retrieval.search_within(vectors, many)


def test_search_within_matches_brute_force(spark, vectors):
    got = {}
    for r in retrieval.search_within(vectors, retrieval.query_catalog(spark, "run"), 2).collect():
        got.setdefault((r["filename"], r["query_no"]), {})[r["rank"]] = r["chunk_index"]
    by_file = {}
    for r in vectors.collect():
        by_file.setdefault((r["filename"], r["doc_type"]), []).append((r["chunk_index"], np.array(r["embedding"])))
    for (filename, doc_type), rows in by_file.items():
        texts = RUN_QUERIES.get(doc_type, RUN_QUERIES["unknown"])
        queries = list(enumerate(hashed_matrix(texts, 384, {})))
        for number, want in brute(rows, queries, 2, lambda key: key).items():
            hits = got[filename, number]
            assert [hits[i] for i in sorted(hits)] == want


def test_context_in_the_row_equals_context_from_the_table(documents, vectors):
    in_row = {r["filename"]: r["c"] for r in documents.select(
        "filename", retrieval.context_of("text", "doc_type").alias("c")).collect()}
    table = {r["filename"]: r["context"] for r in retrieval.relevant_context(
        vectors, "run", 2, "text", RUN_SEPARATOR, docs=documents).collect()}
    # documents of unknown type and blank ones are among them
    assert in_row == table and "" in table.values() and documents.filter("doc_type = 'memo'").count() > 0


def test_plan_of_search_within(spark, vectors):
    plan = retrieval.search_within(
        vectors, retrieval.query_catalog(spark, "run"))._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    # ranks are pruned inside the tasks before the exchange
    assert plan.count("WindowGroupLimit") == 2


def test_unknown_types_get_the_unknown_queries(spark):
    docs = spark.createDataFrame([("a", "memo"), ("b", None), ("c", "email")], "k string, doc_type string")
    got = {(r["k"], r["query_no"]): r["query_text"] for r in retrieval.resolve_queries(
        docs, retrieval.query_catalog(spark, "run")).collect()}
    assert got["a", 0] == got["b", 0] == RUN_QUERIES["unknown"][0]
    assert got["c", 3] == RUN_QUERIES["email"][3] and len(got) == 6


def test_replace_by_key(spark):
    old = spark.createDataFrame([("a", 0), ("a", 1), ("b", 0), ("c", 0)], "filename string, n int")
    new = spark.createDataFrame([("a", 9), ("d", 1)], "filename string, n int")
    got = sorted(tuple(r) for r in store.replace_by_key(old, new).collect())
    assert got == [("a", 9), ("b", 0), ("c", 0), ("d", 1)]


SCHEMA = T.StructType([T.StructField("filename", T.StringType()), T.StructField("n", T.IntegerType()), T.StructField("version", T.IntegerType())])


def test_latest_table(spark, tmp_path):
    kept = store.LatestTable(spark, str(tmp_path / "s"), "filename", "version", SCHEMA)
    frame = lambda rows: spark.createDataFrame(rows, SCHEMA)
    assert kept.read().count() == 0
    kept.append(frame([]), "0")
    assert kept.read().count() == 0
    kept.append(frame([(f"f{i}", n, 1) for i in range(20) for n in range(3)] + [(None, 1, 1)]), "1")
    for _ in range(2):  # a repeated batch replaces itself
        kept.append(frame([("f3", 7, 2), ("new", 1, 2)]), "2")
    kept.append(frame([("f3", 8, 1), ("f4", 9, 1), (None, 2, 2)]), "3")  # f3 is older than what is there
    for table in (kept, kept.compact(str(tmp_path / "c"))):
        rows = sorted((r["filename"] or "", r["n"]) for r in table.read().collect())
        assert [n for f, n in rows if f == "f3"] == [7] and [n for f, n in rows if f == "f4"] == [9]
        # rows without a key replace nothing and are not replaced
        assert len(rows) == 18 * 3 + 5 and rows[:2] == [("", 1), ("", 2)]
    with pytest.raises(ValueError):
        store.LatestTable(spark, str(tmp_path / "x"), "filename", "nothing", SCHEMA)


def test_hot_key_upsert(spark, tmp_path):
    kept = store.LatestTable(spark, str(tmp_path / "s"), "filename", "version", SCHEMA)
    rows = spark.range(20000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(
        F.col("id").cast("string")).alias("filename"), F.col("id").cast("int").alias("n"), F.lit(1).alias("version"))
    kept.append(rows, "1")
    kept.append(spark.createDataFrame([("hot", 1, 2)], SCHEMA), "2")
    assert kept.read().count() == 20000 - 6667 + 1


def test_embed_summary(spark):
    docs = spark.createDataFrame(pa.table({"filename": ["a", "b"], "text": ["x " * 201, "  "]}))
    summary = store.embed_summary(docs)
    assert sorted(tuple(r) for r in summary.collect()) == [("a", 2, "success"), ("b", 0, "failed")]
    assert tuple(store.embed_totals(summary).first()) == (1, 2)


def test_stored_rows_are_not_exchanged(spark, tmp_path):
    kept = store.LatestTable(spark, str(tmp_path / "s"), "filename", "version", SCHEMA, buckets=8)
    for batch in range(3):
        kept.append(spark.range(200).select(F.format_string("f%d", F.col("id") + 50 * batch).alias("filename"), F.col("id").cast("int").alias("n"), F.lit(batch).alias("version")).select(*SCHEMA.names), str(batch))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = kept.read()._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Bucketed: true" in plan
        few = kept.lookup(["f60", "f249", "nobody"])
        plan = few._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "SelectedBucketsCount: " in plan and "SelectedBucketsCount: 8 out of 8" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert {(r.filename, r.version) for r in few.collect()} == {("f60", 1), ("f249", 2)}
    assert kept.read().count() == 300


def test_a_batch_that_comes_out_empty_takes_its_rows_away(spark, tmp_path):
    kept = store.LatestTable(spark, str(tmp_path / "s"), "filename", "version", SCHEMA)
    kept.append(spark.createDataFrame([("a", 1, 1)], SCHEMA), "1")
    kept.append(spark.createDataFrame([("a", 2, 2), ("b", 2, 2)], SCHEMA), "2")
    kept.append(spark.createDataFrame([], SCHEMA), "2")
    assert [tuple(r) for r in kept.read().collect()] == [("a", 1, 1)]
    # a new session finds the table by its path
    spark.sql(f"DROP TABLE {kept.name}")
    again = store.LatestTable(spark, str(tmp_path / "s"), "filename", "version", SCHEMA)
    assert [tuple(r) for r in again.read().collect()] == [("a", 1, 1)]


def test_few_scores_are_sorted_once_limits_are_known(monkeypatch):
    rng = np.random.default_rng(5)
    scores = np.round(rng.random((40 * 50, 8)), 2)
    scores[:, 7] = np.nan
    partitions = []
    whole = np.partition
    monkeypatch.setattr(retrieval.np, "partition", lambda *a, **k: partitions.append(1) or whole(*a, **k))
    heaps = retrieval._Heaps(8, 3)
    for start in range(0, len(scores), 50):
        heaps.add(scores[start:start + 50], pa.array(range(start, start + 50)))
    found = heaps.settle().to_pydict()
    wanted = [(q, float(scores[i, q]), i) for q in range(7) for i in sorted(range(len(scores)), key=lambda i: (-scores[i, q], i))[:3]]
    assert list(zip(found["query"], found["score"], found["id"])) == wanted
    assert len(partitions) < 20


def test_a_task_remembers_few_words():
    known: dict = {}
    hashed_matrix([" ".join(f"w{i}" for i in range(start, start + 50_000)) for start in range(0, 300_000, 50_000)], 8, known)
    assert len(known) <= 100_000


def test_cells_of_the_grid_are_tasks_by_number(spark):
    rows = spark.range(300).select(F.col("id").alias("vec_id"), F.array(F.sin("id"), F.cos("id")).alias("embedding"))
    asked = rows.withColumnRenamed("vec_id", "query_id")
    grid = retrieval.search(rows, asked, k=3, id_column="vec_id", block=16, query_block=100, cell=4)
    one = retrieval.search(rows, asked, k=3, id_column="vec_id")
    order = ["query_id", "rank"]
    assert grid.sort(*order).collect() == one.select(grid.columns).sort(*order).collect()
    plan = grid._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan
