"""Strict JSON and the schema gate on hand-written outputs."""

from __future__ import annotations

import json
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from recordmill.functions import record_json as rj
from recordmill.operators.extraction import infer, with_outcome, with_prompts, schema_text

LINE = {"description": "d", "amount": 1}
INVOICE = {"sender_company": "s", "receiver_company": "r", "line_items": [LINE], "total_amount": 5}


def gated(spark, outputs: list[str], doc_type="invoice"):
    rows = spark.createDataFrame(pa.table({"i": list(range(len(outputs))), "raw": outputs}))
    j = rows.select("i", rj.parse_strict(rj.clean_output_sql("raw")).alias("j"))
    out = j.select("i", F.when(rj.is_object("j"), rj.gate("j", doc_type)).alias("g")).collect()
    return [r["g"] for r in sorted(out, key=lambda r: r["i"])]


@pytest.mark.parametrize(("raw", "valid"), [
    ('{"a":1}', True), ('{"a":1} x', False), ('{"a":1}{"b":2}', False), ('{"a":1},{"b":2}', False),
    ('{"a":1}],[2', False), ('{"a":1}},{', False), ("", False), ("[1, 2]", True), ("nul", False), ('"x"', True),
    ('{"a":1,}', False), ("{'a':1}", False), ('{"a":1', False), ("3.5", True), ('{"a":1,"a":2}', True),
])
def test_strict_parse(one, raw, valid):
    assert one(rj.parse_strict("raw").isNotNull(), raw=raw) == valid


def test_last_duplicate_counts(one):
    assert one(F.try_variant_get(rj.parse_strict("raw"), "$.a", "int"), raw='{"a":1,"a":2}') == 2


@pytest.mark.parametrize("raw", [
    "```json\n{\"a\":1}\n```", "<think>x\n{}</think>\n {\"a\":1} ", "```\n{\"a\":1}```", " {\"a\":1}\n",
    "<think>a</think><think>b</think>{\"a\":1}",
])
def test_cleaning(one, raw):
    assert one(rj.clean_output("raw"), raw=raw) == '{"a":1}'


def test_required_null_and_type_errors_are_listed_in_order(spark):
    bad = {**INVOICE, "sender_company": None, "line_items": {}, "phone": 7}
    del bad["total_amount"]
    result = gated(spark, [json.dumps(bad)])[0]
    assert result["record"] is None
    assert [(e["field"], e["error"]) for e in result["errors"]] == [
        ("sender_company", "null"), ("line_items", "type"), ("total_amount", "missing"), ("phone", "type")]


@pytest.mark.parametrize(("value", "expected"), [
    (5, 5.0), (12.25, 12.25), (True, 1.0), ("12.5", 12.5), (" 12.5 ", 12.5), ("1_000.5", 1000.5), ("1e3", 1000.0),
    (".5", 0.5), ("5.", 5.0), ("\u00a012.5\u2003", 12.5), ("+inf", float("inf")), ("1,200", None), ("12.5d", None), ("", None), (" 1_0 ", None), ([1], None), ("inf", float("inf")),
])
def test_float_coercion(spark, value, expected):
    record = gated(spark, [json.dumps({**INVOICE, "total_amount": value})])[0]["record"]
    assert (record and record["total_amount"]) == expected


@pytest.mark.parametrize(("value", "expected"), [
    (3, 3), (3.0, 3), (3.5, None), ("3", 3), ("3.0", 3), ("3.5", None), (True, 1), (" 7 ", 7), ("\u00a07\x1c", 7), ("12345678901234567890", 2**63 - 1), (12345678901234567890, 2**63 - 1), (-12345678901234567890, -2**63), ("1_000", 1000), ("x", None),
])
def test_int_coercion(spark, value, expected):
    record = gated(spark, [json.dumps({**INVOICE, "line_items": [{**LINE, "quantity": value}]})])[0]["record"]
    assert (record and record["line_items"][0]["quantity"]) == expected


def test_strings_take_only_strings(spark):
    outputs = [json.dumps({**INVOICE, "invoice_number": v}) for v in ("7", 7, 7.5, True, [], {})]
    assert [g["record"] is not None for g in gated(spark, outputs)] == [True, False, False, False, False, False]


def test_lists(spark):
    base = {"name": "n"}
    outputs = [json.dumps({**base, **extra}) for extra in (
        {}, {"projects": None}, {"projects": ["a"]}, {"projects": ["a", 1]}, {"projects": "a"},
        {"education": [{"year": "1"}]}, {"education": [{"year": 1}]}, {"education": [None]}, {"education": ["x"]})]
    results = gated(spark, outputs, "resume")
    assert [g["record"] is not None for g in results] == [True, False, True, False, False, True, False, False, False]
    assert results[0]["record"]["projects"] == [] and results[0]["record"]["education"] == []


def test_extra_fields_are_ignored(spark):
    record = gated(spark, [json.dumps({**INVOICE, "colour": "red", "line_items": [{**LINE, "x": 1}]})])[0]["record"]
    assert record["line_items"][0].asDict() == {"description": "d", "quantity": None, "unit_price": None, "amount": 1.0}


def test_outcomes_and_tokens(spark):
    good = json.dumps({"sender_name": "a", "receiver_name": "b", "subject": "c"})
    cases = [(good, None, "ok", 30), ("oops", None, "json_error", 30), ("null", None, "json_error", 30),
             ("[1]", None, "call_error", 0), ("{}", None, "schema_error", 0), (None, "timeout", "call_error", 0)]
    rows = spark.createDataFrame(pa.table({
        "doc_id": [str(i) for i in range(len(cases))], "doc_type": ["email"] * len(cases),
        "raw_output": [c[0] for c in cases], "call_error": [c[1] for c in cases],
        "prompt_tokens": [10] * len(cases), "completion_tokens": [20] * len(cases)}))
    got = {r["doc_id"]: (r["outcome"], r["token_usage"]["total_tokens"]) for r in with_outcome(rows).collect()}
    assert got == {str(i): (c[2], c[3]) for i, c in enumerate(cases)}


def test_prompt_holds_schema_and_context(spark):
    rows = spark.createDataFrame(pa.table({"doc_id": ["1"], "doc_type": ["email"], "context": ["Dear {x} \\ 'y'"]}))
    row = with_prompts(rows).first()
    assert schema_text("email") in row["user_prompt"] and "Dear {x} \\ 'y'" in row["user_prompt"]
    assert '"key_points": "list[str]"' in row["user_prompt"]


def test_one_bad_prompt_costs_its_own_row(spark):
    rows = spark.range(10).select(
        F.col("id").cast("string").alias("doc_id"), F.lit("s").alias("system_prompt"),
        F.col("id").cast("string").alias("user_prompt"), (F.col("id") * 2).alias("twice"))

    def make_model():
        def model(prompts):
            if any(user == "3" for _, user in prompts):
                raise RuntimeError("refused")
            return [(f"out {user}", 1, 2) for _, user in prompts]

        return model

    got = {r["doc_id"]: r for r in infer(rows, make_model, batch=4, carry=("twice",)).collect()}
    assert len(got) == 10 and all(r["twice"] == 2 * int(d) for d, r in got.items())
    assert got["3"]["call_error"] == "refused" and got["3"]["prompt_tokens"] == 0
    assert all(r["raw_output"] == f"out {d}" and r["call_error"] is None for d, r in got.items() if d != "3")


def test_signed_nan_is_a_number(spark):
    for value in ("nan", "+nan", "-NaN"):
        record = gated(spark, [json.dumps({**INVOICE, "total_amount": value})])[0]["record"]
        assert record["total_amount"] != record["total_amount"]


def test_lists_are_judged_without_naming_the_types_of_their_elements(spark):
    assert ".line_items)" not in re.sub(r"is_variant_null\([^)]*\)|try_variant_get\([^)]*\)", "", rj.gate_sql("j", "invoice"))
    lists = [[LINE], [], [5], [[LINE]], ["x"], [None], [{}], 5, None, {}, "x"]
    found = gated(spark, [json.dumps({**INVOICE, "line_items": v}) for v in lists])
    assert [g["record"] is not None for g in found] == [True, True] + [False] * 9
    assert [[(e["field"], e["error"]) for e in g["errors"]] for g in found] == [[], []] + [
        [("line_items", "null" if v is None else "type")] for v in lists[2:]]
    resumes = gated(spark, [json.dumps({"name": "n", "education": v}) for v in ([{}], [5], [None], ["x"], None)] + ['{"name":"n"}'], "resume")
    assert [g["record"] is not None for g in resumes] == [True, False, False, False, False, True]
