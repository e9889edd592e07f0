"""The stages of the corpus pipeline: on the given tables, and on awkward rows."""

from __future__ import annotations

import re

import corpus_pipeline
import duckdb
import pytest
from pyspark.sql import functions as F

from conftest import SF_DIR
from recordmill.llm import secrets, stages
from recordmill.llm.common import written
from test_operators import AWKWARD, _base, _components, _without_repeats


@pytest.fixture(scope="module")
def kept(spark):
    """What each stage of a run returns, by name."""
    docs, out = spark.read.parquet(f"{SF_DIR}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = out[name] = written(stage(spark, docs, SF_DIR), name)
    return out


def _texts(frame) -> dict:
    return {r.doc_id: r.text for r in frame.collect()}


def test_stages_keep_the_columns(spark, kept):
    columns = spark.read.parquet(f"{SF_DIR}/documents.parquet").columns
    assert all(frame.columns == columns for name, frame in list(kept.items())[:-1])
    assert all(r.n_chars == len(r.text) for r in kept["secret_scans"].collect())


def test_quality_stage_keeps_good_documents(kept):
    labels = dict(duckdb.sql(f"select doc_id, quality from '{SF_DIR}/labels.parquet'").fetchall())
    left = _texts(kept["quality_classifier"])
    assert sum(i in left for i, q in labels.items() if q == 1) > 0.9 * sum(labels.values())


def test_near_copies_go(spark, kept):
    from recordmill.llm import simhash

    before, after = _texts(kept["quality_classifier"]), _texts(kept["simhash_near_dedup"])
    components = _components({i: simhash.simhash(t.encode()) for i, t in before.items()})
    assert after == {i: before[i] for i in set(components.values())}


def test_repeats_and_secrets_go(kept):
    before, after = _texts(kept["simhash_near_dedup"]), _texts(kept["suffix_array_dedup"])
    ids = list(before)
    for i, (n, gone, _, _) in zip(ids, _without_repeats([before[i].encode() for i in ids])):
        assert i not in after if n == gone and n else len(after[i].encode()) <= n - gone if gone else after[i] == before[i]
    clean = _texts(kept["secret_scans"])
    assert clean.keys() == after.keys()
    for i, text in clean.items():
        assert not _base(text) and (text == after[i] or "[SECRET]" in text)


def test_everything_is_packed(kept):
    rows = kept["best_fit_packing"].collect()
    assert {r.doc_id for r in rows} == _texts(kept["secret_scans"]).keys()
    assert all(len(r.ids) == r.length for r in rows) and len({(r.sequence_id, r.offset) for r in rows}) == len(rows)


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES], ids=[n for n, _ in corpus_pipeline.STAGES])
def test_awkward_rows(spark, stage):
    rows = spark.createDataFrame(AWKWARD, "doc_id bigint, text string").withColumns({n: F.lit(n) for n in ("ids", "spans", "kept", "score", "Simhash", "removed", "_stage_row", "_t", "_Print")})
    for docs in (rows, rows.limit(0)):
        out = stage(spark, docs, SF_DIR)
        assert out.count() <= docs.count() or stage is stages.packed
        assert stage is stages.packed or (out.columns == docs.columns and out.schema["spans"].dataType == docs.schema["spans"].dataType)
        if stage is not stages.packed:
            assert all(r[n] == n for r in out.collect() for n in docs.columns[2:])
