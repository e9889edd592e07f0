from __future__ import annotations

import random

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from recordmill.functions import text
from recordmill.operators.chunking import chunk_documents, chunk_summary, reduction_percent, route

ODD = ["", " ", " ", "a", "a b", "a\x1cb\x1f", "　x y", "\x85z", "é ü\tß\n", "😀 b", "​q"]


def table(spark, values, name="text", kind=pa.string()):
    return spark.createDataFrame(pa.table({"i": list(range(len(values))), name: pa.array(values, type=kind)}))


def column(spark, values, col, kind=pa.string()):
    rows = table(spark, values, "v", kind).select("i", col.alias("x")).collect()
    return [r["x"] for r in sorted(rows, key=lambda r: r["i"])]


def test_words_and_strip_match_python(spark):
    assert column(spark, ODD, text.words("v")) == [v.split() for v in ODD]
    assert column(spark, ODD, text.word_count("v")) == [len(v.split()) for v in ODD]
    assert column(spark, ODD, text.strip("v")) == [v.strip() for v in ODD]
    assert column(spark, [*ODD, None], text.has_text("v")) == [bool(v.strip()) for v in ODD] + [False]


def test_every_single_blank_is_stripped(spark):
    blanks = [chr(c) for c in range(0x3001) if chr(c).isspace()]
    assert sorted(blanks) == sorted(text.BLANKS)
    values = [f"{b}x{b}" for b in blanks]
    assert column(spark, values, text.strip("v")) == ["x"] * len(values)
    assert column(spark, values, text.word_count("v")) == [1] * len(values)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(exclude_categories=["Cs"], exclude_characters="\x00"), max_size=30),
                min_size=1, max_size=40))
def test_any_text(spark, values):
    assert column(spark, values, text.words("v")) == [v.split() for v in values]
    assert column(spark, values, text.strip("v")) == [v.strip() for v in values]


@pytest.mark.parametrize("digits", [0, 1, 2, 4, 6])
def test_round_matches_python(spark, digits):
    rng = random.Random(digits)
    values = [rng.random() * 10 ** rng.randint(-8, 8) for _ in range(3000)]
    values += [i * 5e-7 for i in range(2000)] + [i / 128 for i in range(600)] + [-i * 5e-5 for i in range(200)]
    values += [0.0, 0.5, 1.5, 2.5, -2.5, -4.9999999999999996e-05, 1e300, 2.0 ** 53 + 2]
    assert column(spark, values, text.py_round("v", digits), pa.float64()) == [round(v, digits) for v in values]


def test_floats_print_as_in_python(spark):
    values = [12345678.0, 1e7, 9999999.5, 1e16, 9.999e15, 1e-4, 1e-5, 123456789.125, 1.5e22, 1e300, 1e-7, 0.0, -3.25,
              202370.0, 5e-4, 0.1 + 0.2, float("inf"), float("-inf"), float("nan")]
    assert column(spark, values, text.py_float("v"), pa.float64()) == [repr(v) for v in values]


def expected_chunks(raw: str, size=200, overlap=50):
    words, out, start = raw.split(), [], 0
    while words and start < len(words):
        out.append(words[start:start + size])
        if start + size >= len(words):
            break
        start += size - overlap
    return out


@pytest.mark.parametrize(("size", "overlap"), [(200, 50), (10, 0), (7, 6)])
def test_chunks(spark, size, overlap):
    lengths = [0, 1, 199, 200, 201, 350, 351, 500, 1203]
    docs = [("  " if n == 0 else " \n".join(f"w{i}" for i in range(n)) + " ") for n in lengths]
    rows = chunk_documents(
        table(spark, docs).select(F.concat(F.lit("d"), "i").alias("filename"), "text"), size, overlap).collect()
    for i, raw in enumerate(docs):
        got = sorted((r for r in rows if r["filename"] == f"d{i}"), key=lambda r: r["chunk_index"])
        want = expected_chunks(raw, size, overlap)
        assert [r["text"] for r in got] == [" ".join(w) for w in want]
        assert [r["word_count"] for r in got] == [len(w) for w in want]
        assert [r["chunk_id"] for r in got] == [f"d{i}_chunk_{n}" for n in range(len(want))]
        assert {r["total_chunks"] for r in got} <= {len(want)}
        # with the overlap taken off the chunks give the words back
        glued = [w for n, r in enumerate(got) for w in r["text"].split()[overlap if n else 0:]]
        assert glued == raw.split()


def test_chunks_are_cut_once_and_without_exchange(spark):
    docs = spark.range(5).select(F.col("id").cast("string").alias("filename"), F.concat("id", F.lit(" b")).alias("text"))
    plan = chunk_documents(docs)
    text_plan = plan._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in text_plan
    assert text_plan.count("regexp_extract_all") == 1


def test_chunk_limits_are_checked(spark):
    with pytest.raises(ValueError):
        chunk_documents(table(spark, ["a"]), 50, 50)


def test_chunk_summary(spark):
    docs = table(spark, [" ".join(["word"] * 300)]).select(F.lit("f").alias("filename"), "text")
    row = chunk_summary(chunk_documents(docs)).first()
    assert (row["chunks"], row["total_words"], row["preview"]) == (2, 350, ("word " * 12))


def test_route_is_strict_and_can_be_overridden(spark):
    docs = table(spark, [" ".join(["w"] * n) for n in (2000, 2001)])
    assert [r["use_retrieval"] for r in route(docs).sort("i").collect()] == [False, True]
    assert [r["use_retrieval"] for r in route(docs, override=True).collect()] == [True, True]


@pytest.mark.parametrize(("before", "after"), [(0, 0), (1000, 995), (8, 1), (200, 1), (1, 3), (400, 3)])
def test_reduction(one, before, after):
    assert one(reduction_percent("b", "a"), b=before, a=after) == round((1 - after / max(before, 1)) * 100)
