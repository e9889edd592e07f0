"""Rules, scores and prices on hand-written records."""

from __future__ import annotations

import random

import pyarrow as pa
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordmill.fixed import PROVIDERS
from recordmill.functions import costs, rules, scoring
from recordmill.schemas import RECORDS, record_type

ITEM = ("d", 1, 2.0, 5.0)
INVOICE = {"sender_company": "S", "receiver_company": "R", "line_items": [ITEM], "total_amount": 118.0, "subtotal": 100.0,
           "gst": 18.0}


def record_frame(spark, doc_type, **fields):
    names = [f.name for f in RECORDS[doc_type]]
    empty = {f.name: [] if f.kind.startswith("list") else None for f in RECORDS[doc_type]}
    values = tuple({**empty, **fields}[n] for n in names)
    return spark.createDataFrame([Row(record=values)], T.StructType([T.StructField("record", record_type(doc_type))]))


def report(spark, doc_type, **fields):
    got = record_frame(spark, doc_type, **fields).select(rules.validate("record", doc_type).alias("v")).first()["v"]
    assert got["total_checks"] == len(got["checks"]) == got["passed_checks"] + got["failed_checks"]
    assert got["passed"] == (got["failed_checks"] == 0)
    return {c["check"]: (c["passed"], c["message"]) for c in got["checks"]}


MATH = "Math check (subtotal + tax = total)"


def test_good_invoice(spark):
    checks = report(spark, "invoice", **INVOICE, gstin_sender="27 AALCP0001N1Z8")
    assert [c[0] for c in checks.values()] == [True] * 7
    assert checks[MATH][1] == "Subtotal ₹100.0 + Tax ₹18.0 = ₹118.0 (Expected: ₹118.0)"
    assert checks["GSTIN format valid"][1] == "GSTIN: 27 AALCP0001N1Z8 (valid)"


def test_no_tax_prints_a_whole_zero(spark):
    checks = report(spark, "invoice", **{**INVOICE, "gst": 0.0, "total_amount": 100.0})
    assert checks[MATH][1] == "Subtotal ₹100.0 + Tax ₹0 = ₹100.0 (Expected: ₹100.0)"


@pytest.mark.parametrize(("change", "expected"), [
    ({"subtotal": None}, None), ({"subtotal": 0.0}, None), ({"total_amount": 0.0}, None), ({"total_amount": -118.0}, False),
    ({"total_amount": 119.0}, True), ({"total_amount": 119.3}, False), ({"subtotal": float("nan")}, False),
])
def test_math_check(spark, change, expected):
    checks = report(spark, "invoice", **{**INVOICE, **change})
    assert (checks[MATH][0] if MATH in checks else None) == expected


def test_items(spark):
    assert "Line item amounts positive" not in report(spark, "invoice", **{**INVOICE, "line_items": []})
    bad = report(spark, "invoice", **{**INVOICE, "line_items": [ITEM, ("d", None, None, float("nan"))]})
    assert bad["Line item amounts positive"] == (False, "Some line items have zero or negative amounts")
    assert bad["Has line items"] == (True, "Found 2 line item(s)")


def test_gstin_check_needs_a_value(spark):
    assert "GSTIN format valid" not in report(spark, "invoice", **INVOICE, gstin_sender="")
    assert report(spark, "invoice", **INVOICE, gstin_sender="short")["GSTIN format valid"] == (
        False, "GSTIN: short (invalid - must be 15 characters)")


def test_large_amounts_print_plainly(spark):
    assert report(spark, "invoice", **{**INVOICE, "total_amount": 12345678.0})["Total amount positive"][1] == (
        "Total amount: ₹12345678.0")


def test_blank_names_fail(spark):
    checks = report(spark, "invoice", **{**INVOICE, "sender_company": " "})
    assert checks["Sender company name present"] == (False, "Sender:  ")


def test_resume(spark):
    # a blank but non-empty contact counts as contact
    checks = report(spark, "resume", name="N", phone=" ", tech_stack=["t"], education=[("a", None, None, None)])
    assert [c[0] for c in checks.values()] == [True] * 4
    checks = report(spark, "resume", name=" ", phone="")
    assert [c[0] for c in checks.values()] == [False] * 4
    assert checks["Has technical skills"][1] == "Found 0 technical skills"


def test_email(spark):
    checks = report(spark, "email", sender_name="a", receiver_name="b", subject="c", body=" x ", action_items=["t"])
    assert [c[0] for c in checks.values()] == [True] * 4
    assert checks["Body present"][1] == "Body length: 3 characters"
    assert report(spark, "email", sender_name="a", receiver_name="b", subject="c")["Body present"] == (
        False, "Body length: 0 characters")


def test_unknown_type(spark):
    frame = record_frame(spark, "email", sender_name="a").withColumn("t", F.lit("memo"))
    row = frame.select(rules.validate_any("t", {"email": "record"}).alias("v"),
                       scoring.score_any("t", {"email": "record"}).alias("s")).first()
    assert (row["v"]["passed"], row["v"]["checks"][0]["check"]) == (False, "Unknown type")
    assert (row["s"]["avg_confidence"], row["s"]["needs_human_review"], row["s"]["field_scores"]) == (0.0, True, {})


@pytest.mark.parametrize(("kind", "value", "expected"), [
    ("str", None, 0), ("str", "  ", 0), ("str", "ab", 50), ("str", " ab ", 50), ("str", "abc", 80), ("float", None, 0),
    ("float", 1.0, 90), ("float", 0.0, 30), ("float", -1.0, 30), ("float", float("nan"), 30), ("int", 1, 90), ("int", 0, 30),
    ("list", [], 30), ("list", ["a"], 90), ("gstin", "", 40), ("gstin", "27 AALCP0001N1Z8", 95), ("gstin", None, 0),
    ("other", "x", 50),
])
def test_field_scores(spark, kind, value, expected):
    types = {"float": T.DoubleType(), "int": T.LongType(), "list": T.ArrayType(T.StringType())}
    row = spark.createDataFrame([(value,)], T.StructType([T.StructField("v", types.get(kind, T.StringType()))]))
    assert row.select(scoring.score_field("v", kind)).first()[0] == expected


def test_confidence_report(spark):
    row = record_frame(spark, "invoice", **INVOICE).select(scoring.score("record", "invoice").alias("s")).select(
        "s", F.map_keys("s.field_scores").alias("order")).first()
    got = row["s"]
    assert row["order"] == [n for n, _ in scoring.SCORED["invoice"]]
    assert got["avg_confidence"] == round(sum(got["field_scores"].values()) / 11, 1)
    assert got["flagged_fields"] == {n: s for n, s in got["field_scores"].items() if s < 70}
    assert got["needs_human_review"]


def test_bar(one):
    assert one(scoring.bar("s"), s=95) == "█" * 9 + "░"


def test_costs_match_float_arithmetic(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(5000), rng.randrange(5000), rng.choice([*[p[0] for p in PROVIDERS], "nobody"])) for _ in range(4000)]
    prices = {p[0]: p[3:5] for p in PROVIDERS}
    frame = spark.createDataFrame(pa.table({"prompt_tokens": [r[0] for r in rows], "completion_tokens": [r[1] for r in rows],
                                            "provider": [r[2] for r in rows]}))
    got = costs.cost_by_provider_column(frame, "provider").collect()
    for r in got:
        price_in, price_out = prices.get(r["provider"], (0.0, 0.0))
        assert r["cost_usd"] == round(
            (r["prompt_tokens"] / 1_000_000) * price_in + (r["completion_tokens"] / 1_000_000) * price_out, 6)
    assert len(got) == len(rows)
