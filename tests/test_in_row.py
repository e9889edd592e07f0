"""Search within the row, and models served to the workers."""

from __future__ import annotations

import sys

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from recordmill.fixed import CATALOGS, RUN_SEPARATOR, RUN_TOP_K
from recordmill.functions.vectors import embed_hashed
from recordmill.operators import in_row, retrieval
from recordmill.operators.chunking import chunk_documents
from recordmill.plans.extraction_run import with_context

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LONG = " ".join(f"invoice total {i} amount due date skills education project {i % 7}" for i in range(900))
ROWS = [("a", "invoice", LONG), ("b", "resume", LONG + " more skills"), ("c", "memo", "short words"), ("d", "email", " "), ("e", "email", None),
        (None, None, "sender subject action items date"), ("f", "email", "same " * 3000), ("a2", "invoice", LONG)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "filename string, doc_type string, text string").repartition(3)


def letters():
    return lambda texts: [[t.count(c) for c in "etaoin"] for t in texts]


@pytest.mark.parametrize("catalog", ["run", "context"])
def test_in_row_equals_rows_of_chunks(spark, docs, catalog):
    chunks = retrieval.embed(chunk_documents(docs, keep=("doc_type",)))
    hits = retrieval.with_texts(retrieval.search_within(chunks, retrieval.query_catalog(spark, catalog), 3), chunks)
    columns = ["filename", "doc_type", "query_no", "rank", "chunk_id", "chunk_index", "score", "text"]
    want = sorted(map(tuple, hits.select(*columns).collect()), key=str)
    assert sorted(map(tuple, in_row.fan_out(docs, catalog, 3).select(*columns).collect()), key=str) == want and len(want) > 40


@pytest.mark.parametrize("dedupe_on", ["chunk_id", "text"])
def test_contexts_equal_those_of_a_vector_table(spark, docs, dedupe_on):
    chunks = retrieval.embed(chunk_documents(docs, keep=("doc_type",)))
    want = {tuple(r) for r in retrieval.relevant_context(chunks, "context", 2, dedupe_on, " | ", docs=docs).collect()}
    got = {(r.filename or "unknown", r.context) for r in in_row.contexts(docs, "context", 2, dedupe_on, " | ").collect()}
    assert got == want


def test_equal_scores_go_to_the_earlier_chunk(spark):
    rows = spark.createDataFrame([("x", "email", ["b", "e", "e", "e", "zz"]), ("y", "memo", []), ("z", "email", ["zz"])], "filename string, doc_type string, chunks array<string>")
    got = {r.filename: [(h.query_no, h.rank, h.chunk_index) for h in r.hits] for r in rows.select("filename", in_row.best_chunks("chunks", "doc_type", "run", 2, letters).alias("hits")).collect()}
    queries = [i for i, text in enumerate(CATALOGS["run"]["email"]) if "e" in text]
    assert got == {"x": [(q, r, r) for q in queries for r in (1, 2)], "y": [], "z": []}


def test_batches_of_texts_do_not_matter(spark, docs, monkeypatch):
    want = sorted(map(str, in_row.contexts(docs, make_model=letters).collect()))
    monkeypatch.setattr(in_row, "TEXTS", 3)
    assert sorted(map(str, in_row.contexts(docs, make_model=letters).collect())) == want


def test_documents_are_read_and_cut_once(spark, docs, tmp_path):
    docs.write.parquet(str(tmp_path / "docs"))
    stored = spark.read.parquet(str(tmp_path / "docs"))
    for found in (in_row.fan_out(stored), in_row.contexts(stored)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan") == 1 and plan.count("ArrowEvalPython") == 1 and "Exchange" not in plan and plan.count("regexp_extract_all") == 1


def test_a_run_takes_a_model_of_texts(spark, docs):
    rows = docs.filter("filename is not null").withColumn("doc_id", F.col("filename"))
    kept = ["doc_id", "context", "use_retrieval"]
    own = with_context(rows, make_text_model=lambda: in_row.hashed_model()).select(*kept)
    assert sorted(map(str, own.collect())) == sorted(map(str, with_context(rows, embedder=embed_hashed).select(*kept).collect()))
    assert sorted(map(str, own.collect())) == sorted(map(str, with_context(rows).select(*kept).collect()))
    assert in_row.contexts(docs, "run", RUN_TOP_K, "text", RUN_SEPARATOR).columns == ["filename", "doc_type", "text", "context"]


def test_a_model_is_made_once_for_a_worker(spark, tmp_path):
    made = str(tmp_path / "made")
    sizes = str(tmp_path / "sizes")

    def make():
        import os

        with open(made, "a") as f:
            f.write(f"{os.getpid()}\n")

        def model(texts):
            with open(sizes, "a") as f:
                f.write(f"{len(texts)}\n")
            return np.array([[len(t), 1] for t in texts])

        return model

    rows = spark.range(1000).select(F.when(F.col("id") % 10 > 0, F.col("id").cast("string")).alias("text")).repartition(40)
    got = retrieval.embed(rows, retrieval.model_embedder(make, batch=7)).collect()
    assert all(list(r.embedding) == [len(r.text or ""), 1] for r in got) and len(got) == 1000
    pids = (tmp_path / "made").read_text().split()
    # forty tasks, at most one model for each worker process
    assert len(pids) == len(set(pids)) < 40
    assert max(map(int, (tmp_path / "sizes").read_text().split())) <= 7
