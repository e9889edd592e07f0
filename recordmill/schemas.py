"""The three record types: fields in declared order, with kind and presence.

Kinds: ``str``, ``float``, ``int``, ``list<str>`` or a list of a nested record.
Presence: ``req`` must be there and not null, ``opt`` may be null or absent,
``list`` may be absent (then empty) but not null.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T


@dataclass(frozen=True)
class Field:
    name: str
    kind: str
    presence: str = "opt"


def _opt(kind: str, *names: str) -> list[Field]:
    return [Field(n, kind) for n in names]


NESTED: dict[str, list[Field]] = {
    "LineItem": [
        Field("description", "str", "req"),
        Field("quantity", "int"),
        Field("unit_price", "float"),
        Field("amount", "float", "req"),
    ],
    "WorkExperience": _opt("str", "company_name", "role", "duration", "description"),
    "Education": _opt("str", "institution", "degree", "field_of_study", "year"),
}

RECORDS: dict[str, list[Field]] = {
    "invoice": [
        *_opt("str", "invoice_number", "date"),
        Field("sender_company", "str", "req"),
        Field("receiver_company", "str", "req"),
        Field("line_items", "list<LineItem>", "req"),
        Field("subtotal", "float"),
        Field("total_amount", "float", "req"),
        *_opt("str", "gstin_sender", "gstin_receiver"),
        *_opt("float", "gst", "cgst", "sgst", "igst"),
        *_opt("str", "phone", "email", "address", "due_date"),
    ],
    "resume": [
        Field("name", "str", "req"),
        *_opt("str", "email", "phone", "address", "linkedin", "github"),
        Field("technical_skills", "list<str>", "list"),
        Field("soft_skills", "list<str>", "list"),
        Field("tech_stack", "list<str>", "list"),
        Field("work_experience", "list<WorkExperience>", "list"),
        Field("education", "list<Education>", "list"),
        Field("projects", "list<str>", "list"),
        Field("summary", "str"),
    ],
    "email": [
        Field("sender_name", "str", "req"),
        Field("receiver_name", "str", "req"),
        Field("subject", "str", "req"),
        *_opt("str", "date", "body"),
        Field("key_points", "list<str>", "list"),
        Field("action_items", "list<str>", "list"),
        *_opt("str", "sender_email", "receiver_email", "tone", "priority"),
    ],
}

DOC_TYPES = tuple(RECORDS)
# folder names of the batch layout are plurals of the types
FOLDER_TYPES = {"invoices": "invoice", "resumes": "resume", "emails": "email"}

_SCALARS = {"str": T.StringType(), "float": T.DoubleType(), "int": T.LongType()}


def spark_type(kind: str) -> T.DataType:
    if kind in _SCALARS:
        return _SCALARS[kind]
    inner = kind[len("list<"):-1]
    if inner in NESTED:
        return T.ArrayType(struct_type(NESTED[inner]))
    return T.ArrayType(_SCALARS[inner])


def struct_type(fields: list[Field]) -> T.StructType:
    return T.StructType([T.StructField(f.name, spark_type(f.kind)) for f in fields])


def record_type(doc_type: str) -> T.StructType:
    return struct_type(RECORDS[doc_type])


def type_label(field: Field) -> str:
    """How a field's type is named in the prompt."""
    labels = {"str": "<class 'str'>", "float": "<class 'float'>", "int": "<class 'int'>"}
    if field.kind in labels:
        return f"typing.Optional[{field.kind}]" if field.presence == "opt" else labels[field.kind]
    return field.kind.replace("<", "[").replace(">", "]")
