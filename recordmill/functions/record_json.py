"""Model output to typed records: cleaning, strict JSON, schema gate."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from recordmill.functions.text import let_sql, quote, strip_sql
from recordmill.schemas import NESTED, RECORDS, Field, record_type, spark_type

# texts of numbers, after the blanks around them are gone
_NUMBER_TEXT = quote(r"^[+-]?(\d+(_\d+)*(\.(\d+(_\d+)*)?)?|\.\d+(_\d+)*)([eE][+-]?\d+(_\d+)*)?$")
_SPECIAL_NUMBER = quote(r"(?i)^[+-]?(nan|inf|infinity)$")
_NAN_TEXT = quote(r"(?i)^[+-]?nan$")
_INTEGER_TEXT = quote(r"^[+-]?\d+(_\d+)*(\.0*)?$")
_FRACTION_ZEROS = quote(r"\.0*$")


def clean_output_sql(raw: str) -> str:
    """Drop reasoning blocks and code fences, then strip."""
    # most outputs have neither, and a plain search is much cheaper than a pattern
    answer = strip_sql(f"if(contains({raw}, '<think>'), regexp_replace({raw}, {quote('(?s)<think>.*?</think>')}, ''), {raw})")
    fence = quote(r"```(?:json)?\n?")
    return let_sql(answer, lambda a: strip_sql(f"if(contains({a}, '```'), replace(regexp_replace({a}, {fence}, ''), '```', ''), {a})"))


def parse_strict_sql(cleaned: str) -> str:
    """VARIANT of a text that is exactly one JSON value; null otherwise.

    The parser stops after the first value, so each wrapper alone lets some trailing
    text through. A text passing both, as a member and as the only array element,
    is a single value.
    """
    return let_sql(cleaned, lambda c: (
        f"if(json_array_length(concat('[', {c}, ']')) = 1,"
        f" try_variant_get(try_parse_json(concat('{{\"r\":', {c}, '}}')), '$.r', 'variant'), null)"))


def is_object_sql(value: str) -> str:
    return f"coalesce(startswith(schema_of_variant({value}), 'OBJECT'), false)"


def _kind(value: str) -> str:
    """MISSING, VOID, STRING, BIGINT, ARRAY<..>, OBJECT<..>, ..."""
    return f"coalesce(schema_of_variant({value}), 'MISSING')"


def _list_kind(value: str) -> str:
    """MISSING, VOID or OTHER: naming the type of a list would merge the types of all its elements."""
    return f"case when {value} is null then 'MISSING' when is_variant_null({value}) then 'VOID' else 'OTHER' end"


def _as(value: str, type_name: str) -> str:
    return f"try_variant_get({value}, '$', '{type_name}')"


def _coerced(value: str, name: str, kind: str) -> str:
    """Coerced scalar or null. Lax in the same way as the record models: numbers may
    come as text or booleans, text only as text. ``value`` and its kind are bound."""
    if kind == "str":
        return f"if({name} = 'STRING', {_as(value, 'string')}, null)"
    numeric = f"(startswith({name}, 'DECIMAL') or {name} in ('BIGINT', 'DOUBLE', 'FLOAT', 'BOOLEAN'))"

    def from_text(raw: str) -> str:
        def bare(t: str) -> str:
            tidy = f"replace({t}, '_', '')"
            # blanks are forgiven around a plain number only
            allowed = f"(length({t}) = length({raw}) or not contains({t}, '_'))"
            if kind == "float":
                return (f"case when {t} rlike {_NAN_TEXT} then double('nan') when ({t} rlike {_NUMBER_TEXT} or {t} rlike {_SPECIAL_NUMBER})"
                        f" and {allowed} then try_cast({tidy} as double) end")
            digits = f"regexp_replace({tidy}, {_FRACTION_ZEROS}, '')"
            return f"if({t} rlike {_INTEGER_TEXT} and {allowed}, coalesce(try_cast({digits} as bigint), {_bound(digits + ' not like ' + quote('-%'))}), null)"

        return let_sql(strip_sql(raw), bare)

    written = f"when {name} = 'STRING' then {let_sql(_as(value, 'string'), from_text)}"
    number = _as(value, "double")
    if kind == "float":
        return f"case when {numeric} then {number} {written} end"
    whole = f"({name} in ('BIGINT', 'BOOLEAN') or ({numeric} and {number} = rint({number})))"
    return f"case when {whole} then coalesce({_as(value, 'bigint')}, {_bound(number + ' > 0')}) {written} end"


def _bound(positive: str) -> str:
    """What an integer beyond 64 bits becomes: the nearest one that a record can hold."""
    return f"if({positive}, 9223372036854775807L, -9223372036854775807L - 1L)"


def _judged(value: str, fields: list[Field], fold) -> str:
    """Read every member of an object VARIANT once and fold the outcome.

    ``fold`` gets the kinds and the coerced values of the members, each bound as one
    struct, so the expression grows with the number of fields only.
    """

    def struct(cells: list[str]) -> str:
        return "named_struct(" + ", ".join(f"'{f.name}', {cell}" for f, cell in zip(fields, cells)) + ")"

    def coerced(f: Field, c: str, k: str) -> str:
        if not f.kind.startswith("list<"):
            return _coerced(f"{c}.{f.name}", f"{k}.{f.name}", f.kind)
        items = _list(f"{c}.{f.name}", f.kind)
        if f.presence != "list":
            return items
        return f"if({k}.{f.name} = 'MISSING', cast(array() as {spark_type(f.kind).simpleString()}), {items})"

    children = struct([f"try_variant_get({value}, '$.{f.name}', 'variant')" for f in fields])
    return let_sql(children, lambda c: let_sql(
        struct([(_list_kind if f.kind.startswith("list<") else _kind)(f"{c}.{f.name}") for f in fields]),
        lambda k: let_sql(struct([coerced(f, c, k) for f in fields]), lambda x: fold(k, x))))


def _fits(f: Field, k: str, x: str) -> str:
    if f.presence == "opt":
        return f"({x}.{f.name} is not null or {k}.{f.name} in ('MISSING', 'VOID'))"
    return f"{x}.{f.name} is not null"


def _all_fit(fields: list[Field], k: str, x: str) -> str:
    return " and ".join(_fits(f, k, x) for f in fields)


def _element(value: str, inner: str) -> str:
    """Typed list element, null where it does not fit."""
    if inner not in NESTED:
        return let_sql(_kind(value), lambda k: _coerced(value, k, inner))
    fields = NESTED[inner]
    members = _judged(value, fields, lambda k, x: f"if({_all_fit(fields, k, x)}, {x}, null)")
    if any(f.presence == "req" for f in fields):
        # only an object has members, and without the required ones nothing fits
        return members
    return f"if({is_object_sql(value)}, {members}, null)"


def _list(value: str, kind: str) -> str:
    """Typed array when ``value`` is an array whose every element fits; null otherwise."""
    inner = kind[len("list<"):-1]
    typed = f"transform({_as(value, 'array<variant>')}, e -> {_element('e', inner)})"
    # an element that does not fit is null and spoils the list
    return let_sql(typed, lambda t: f"if(forall({t}, y -> y is not null), {t}, null)")


def gate_sql(value: str, doc_type: str) -> str:
    """Check a VARIANT object against a record type.

    Gives ``struct<record, errors array<struct<field, error>>>``; ``record`` is null
    when there is any error. Fields not in the type are ignored. Every member is read
    and judged once; the bindings keep the expression from repeating itself.
    """
    fields = RECORDS[doc_type]
    target = record_type(doc_type).simpleString()

    def fold(k: str, x: str) -> str:
        errors = ", ".join(
            f"if({_fits(f, k, x)}, null, named_struct('field', '{f.name}', 'error',"
            f" case {k}.{f.name} when 'MISSING' then 'missing' when 'VOID' then 'null' else 'type' end))" for f in fields
        )
        none = "cast(array() as array<struct<field:string,error:string>>)"
        return let_sql(_all_fit(fields, k, x), lambda ok: (
            f"named_struct('record', if({ok}, cast({x} as {target}), null),"
            f" 'errors', if({ok}, {none}, array_compact(array({errors}))))"))

    return let_sql(value, lambda v: _judged(v, fields, fold))


def clean_output(raw: str) -> Column:
    return F.expr(clean_output_sql(raw))


def parse_strict(cleaned: str) -> Column:
    return F.expr(parse_strict_sql(cleaned))


def is_object(value: str) -> Column:
    return F.expr(is_object_sql(value))


def gate(value: str, doc_type: str) -> Column:
    return F.expr(gate_sql(value, doc_type))
