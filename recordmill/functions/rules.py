"""Business rules over typed records; each report is one struct column.

Functions take the name of a record column and build Spark SQL text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from recordmill.functions.text import has_text_sql, let_sql, py_float_sql, quote

CHECK_TYPE = "struct<check:string,passed:boolean,message:string>"


def _check(name: str, passed: str, message: str) -> str:
    return f"named_struct('check', {quote(name)}, 'passed', coalesce({passed}, false), 'message', {message})"


def _positive(x: str) -> str:
    # Spark sorts NaN above every number
    return f"({x} > 0 and not isnan({x}))"


def _present(what: str, label: str, column: str) -> str:
    return _check(what, has_text_sql(column), f"concat('{label}: ', coalesce({column}, 'None'))")


def _number(n: str) -> str:
    return f"cast({n} as string)"


def invoice_checks(r: str) -> list[str]:
    total, subtotal, items, gstin = f"{r}.total_amount", f"{r}.subtotal", f"{r}.line_items", f"{r}.gstin_sender"
    taxes = [f"coalesce({r}.{n}, 0D)" for n in ("igst", "cgst", "sgst", "gst")]
    tax = f"((({taxes[0]} + {taxes[1]}) + {taxes[2]}) + {taxes[3]})"
    any_tax = "(" + " or ".join(f"{t} <> 0" for t in taxes) + ")"

    def balance(added: str) -> str:
        computed = f"({subtotal} + {added})"
        balanced = (f"(abs({computed} - {total}) <= {total} * 0.01D and not isnan({computed}) and not isnan({total}))")
        # no tax at all adds up to a whole zero
        shown_tax = f"if({any_tax}, {py_float_sql(added)}, '0')"
        return _check("Math check (subtotal + tax = total)", balanced, (
            f"concat('Subtotal ₹', {py_float_sql(subtotal)}, ' + Tax ₹', {shown_tax}, ' = ₹', {py_float_sql(computed)},"
            f" ' (Expected: ₹', {py_float_sql(total)}, ')')"))

    item_amounts = let_sql(f"forall({items}, i -> {_positive('i.amount')})", lambda ok: _check(
        "Line item amounts positive", ok,
        f"if({ok}, 'All line item amounts are positive', 'Some line items have zero or negative amounts')"))
    fifteen = f"length(replace({gstin}, ' ', '')) = 15"
    return [
        _check("Total amount positive", _positive(total), f"concat('Total amount: ₹', {py_float_sql(total)})"),
        _check("Has line items", f"size({items}) > 0", f"concat('Found ', {_number(f'size({items})')}, ' line item(s)')"),
        f"if(size({items}) > 0, {item_amounts}, null)",
        f"if(coalesce({subtotal} <> 0, false) and coalesce({total} <> 0, false), {let_sql(tax, balance)}, null)",
        f"if(coalesce({gstin} <> '', false), " + _check(
            "GSTIN format valid", fifteen,
            f"concat('GSTIN: ', {gstin}, ' (', if({fifteen}, 'valid', 'invalid - must be 15 characters'), ')')") + ", null)",
        _present("Sender company name present", "Sender", f"{r}.sender_company"),
        _present("Receiver company name present", "Receiver", f"{r}.receiver_company"),
    ]


def resume_checks(r: str) -> list[str]:
    contact = f"(coalesce({r}.email, '') <> '' or coalesce({r}.phone, '') <> '')"
    skills, education = f"size({r}.technical_skills)", f"size({r}.education)"
    return [
        _present("Name present", "Name", f"{r}.name"),
        _check("Has contact information", contact,
               f"if({contact}, 'Email or phone found', 'No contact information found')"),
        _check("Has technical skills", f"({skills} > 0 or size({r}.tech_stack) > 0)",
               f"concat('Found ', {_number(skills)}, ' technical skills')"),
        _check("Has education", f"{education} > 0", f"concat('Found ', {_number(education)}, ' education record(s)')"),
    ]


def email_checks(r: str) -> list[str]:
    points, actions, body = f"size({r}.key_points)", f"size({r}.action_items)", f"{r}.body"
    return [
        _present("Sender present", "Sender", f"{r}.sender_name"),
        _present("Subject present", "Subject", f"{r}.subject"),
        _check("Body present", has_text_sql(body),
               f"concat('Body length: ', {_number(f'coalesce(length({body}), 0)')}, ' characters')"),
        _check("Has key points or action items", f"({points} > 0 or {actions} > 0)",
               f"concat('Found ', {_number(points)}, ' key points and ', {_number(actions)}, ' action items')"),
    ]


CHECKS = {"invoice": invoice_checks, "resume": resume_checks, "email": email_checks}


def report_sql(checks: list[str]) -> str:
    """Fold checks into counts and the overall verdict; null checks do not apply."""
    listed = f"array_compact(cast(array({', '.join(checks)}) as array<{CHECK_TYPE}>))"
    return let_sql(listed, lambda c: (
        f"named_struct('passed', forall({c}, x -> x.passed), 'total_checks', cast(size({c}) as bigint),"
        f" 'passed_checks', cast(size(filter({c}, x -> x.passed)) as bigint),"
        f" 'failed_checks', cast(size(filter({c}, x -> not x.passed)) as bigint), 'checks', {c})"))


def validate_sql(record: str, doc_type: str) -> str:
    return f"if({record} is not null, {report_sql(CHECKS[doc_type](record))}, null)"


def validate(record: str, doc_type: str) -> Column:
    """Validation report of a record column of one type; null for a null record."""
    return F.expr(validate_sql(record, doc_type))


def validate_any(doc_type: str, records: dict[str, str]) -> Column:
    """Report by type; a type without rules gets a failed report.

    ``records`` names the record column of each type.
    """
    unknown = report_sql([_check("Unknown type", "false", f"concat('Unknown document type: ', coalesce({doc_type}, 'None'))")])
    branches = " ".join(f"when {doc_type} = '{t}' then {validate_sql(record, t)}" for t, record in records.items())
    return F.expr(f"case {branches} else {unknown} end")


def failed_check_names_sql(validation: str) -> str:
    return f"array_join(transform(filter({validation}.checks, c -> not c.passed), c -> c.check), ', ')"


def failed_check_names(validation: str) -> Column:
    return F.expr(failed_check_names_sql(validation))
