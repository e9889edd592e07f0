"""Confidence scores per field and their fold."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from recordmill.fixed import REVIEW_BELOW, SCORED
from recordmill.functions.text import let_sql, strip_sql


def score_field_sql(value: str, kind: str) -> str:
    """0 to 95 by kind: ``str``, ``float``, ``int``, ``list``, ``gstin``; other kinds score 50."""
    size = f"length({strip_sql(value)})"
    score = {
        "str": f"case when {size} = 0 then 0 when {size} >= 3 then 80 else 50 end",
        "float": f"if({value} > 0 and not isnan({value}), 90, 30)",
        "int": f"if({value} > 0, 90, 30)",
        "list": f"if(size({value}) = 0, 30, 90)",
        "gstin": f"if(length(replace({value}, ' ', '')) = 15, 95, 40)",
    }.get(kind, "50")
    return f"if({value} is null, 0, {score})"


def score_field(value: str, kind: str) -> Column:
    return F.expr(score_field_sql(value, kind))


def confidence_sql(names: list[str], scores: list[str]) -> str:
    """Mean (1 digit), review flag and field maps, in field order."""
    keys = "array(" + ", ".join(f"'{n}'" for n in names) + ")"

    def fold(s: str) -> str:
        # sums of at most 11 whole scores never fall on a rounding tie
        mean = f"round(aggregate({s}, 0, (acc, x) -> acc + x) / {float(len(names))}D, 1)"
        fields = f"map_from_arrays({keys}, {s})"
        return (f"named_struct('avg_confidence', {mean}, 'needs_human_review', exists({s}, x -> x < {REVIEW_BELOW}),"
                f" 'flagged_fields', map_filter({fields}, (f, x) -> x < {REVIEW_BELOW}), 'field_scores', {fields})")

    return let_sql(f"array({', '.join(scores)})", fold)


def score_sql(record: str, doc_type: str) -> str:
    fields = SCORED[doc_type]
    scores = [score_field_sql(f"{record}.{name}", kind) for name, kind in fields]
    return f"if({record} is not null, {confidence_sql([n for n, _ in fields], scores)}, null)"


def score(record: str, doc_type: str) -> Column:
    """Confidence report of a record column of one type; null for a null record."""
    return F.expr(score_sql(record, doc_type))


def score_any(doc_type: str, records: dict[str, str]) -> Column:
    """Report by type; an unknown type scores 0, needs review and has no fields."""
    empty = "cast(map() as map<string,int>)"
    unknown = (f"named_struct('avg_confidence', 0D, 'needs_human_review', true, 'flagged_fields', {empty},"
               f" 'field_scores', {empty})")
    branches = " ".join(f"when {doc_type} = '{t}' then {score_sql(record, t)}" for t, record in records.items())
    return F.expr(f"case {branches} else {unknown} end")


def bar_sql(value: str) -> str:
    """Ten cells, one full cell per ten points."""
    return f"concat(repeat('█', cast({value} div 10 as int)), repeat('░', 10 - cast({value} div 10 as int)))"


def bar(value: str) -> Column:
    return F.expr(bar_sql(value))
