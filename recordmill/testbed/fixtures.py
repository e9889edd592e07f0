"""Documents, records and model responses derived row by row from the given tables.

Every fixture is a base table and a few layers of SQL expressions that Spark and
DuckDB read alike, so both sides start from the same rows. All layers are
projections: nothing is grouped or joined, whatever the keys look like.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordmill.schemas import record_type
RUNS = [
    ("20240101_000000", "2024-01-01 00:00:00", "openai_gpt4o_mini"),
    ("20240102_000000", "2024-01-02 00:00:00", "anthropic_haiku"),
]


#: Names how many tasks share an input whose files have one row group each; unset, as for real tables, nothing is dealt out.
INPUT_TASKS = "spark.recordmill.inputTasks"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    tasks = spark.conf.get(INPUT_TASKS, None)
    return rows.repartition(int(tasks)) if tasks else rows


def spark_layers(base: DataFrame, layers: list[list[str]]) -> DataFrame:
    return reduce(lambda df, layer: df.selectExpr(*[e.replace("//", "div") for e in layer]), layers, base)


def duck_layers(table: str, layers: list[list[str]]) -> str:
    return reduce(lambda inner, layer: f"SELECT {', '.join(layer)} FROM ({inner})", layers, f"SELECT * FROM {table}")


# --- plain documents -----------------------------------------------------------------

DOCUMENTS = [[
    "doc_id AS k", "CAST(doc_id AS STRING) AS doc_id", "'doc_' || CAST(doc_id AS STRING) AS filename",
    "CASE WHEN doc_id % 31 = 5 THEN 'memo' WHEN doc_id % 3 = 0 THEN 'invoice' WHEN doc_id % 3 = 1 THEN 'resume' ELSE 'email' END AS doc_type",
    "CASE WHEN doc_id % 29 = 7 THEN ' ' ELSE text END AS text",
]]

# every way to be turned away, and a type nobody knows
SUBMITTED = [[
    "doc_id AS k",
    "CASE WHEN doc_id % 5 = 0 THEN NULL WHEN doc_id % 5 = 1 THEN '' ELSE 'given_' || CAST(doc_id AS STRING) END AS doc_id",
    "CASE WHEN doc_id % 7 = 0 THEN NULL WHEN doc_id % 13 = 0 THEN 'doc_' || CAST(doc_id AS STRING) || '.pdf'"
    " ELSE 'doc_' || CAST(doc_id AS STRING) || '.txt' END AS filename",
    "CASE WHEN doc_id % 17 = 0 THEN ' ' || chr(10) || chr(9) ELSE text END AS text",
    "CASE doc_id % 4 WHEN 0 THEN 'invoice' WHEN 1 THEN 'resume' WHEN 2 THEN 'email' ELSE 'memo' END AS doc_type",
    "doc_id % 19 <> 0 AS readable",
]]

# --- records -------------------------------------------------------------------------

ITEMS = range(1, 13)
# some items cost nothing, and some, also late ones, are negative
_SIGNS = {1: "CASE WHEN k % 23 = 0 THEN -1 ELSE 1 END", 3: "CASE WHEN k % 27 = 4 THEN 0 ELSE 1 END", 7: "CASE WHEN k % 19 = 3 THEN -1 ELSE 1 END"}


def _money(cents: str) -> str:
    return (f"(CASE WHEN {cents} < 0 THEN '-' ELSE '' END || CAST(abs({cents}) // 100 AS STRING) || '.'"
            f" || lpad(CAST(abs({cents}) % 100 AS STRING), 2, '0'))")


def _item_sums() -> str:
    return " + ".join(f"CASE WHEN n_items >= {i} THEN a{i} ELSE 0 END" for i in ITEMS)


INVOICES = [
    [
        "o_orderkey AS k", "'inv_' || CAST(o_orderkey AS STRING) AS doc_id",
        "CAST(round(o_totalprice * 100) AS BIGINT) AS order_cents", "substr(CAST(o_orderdate AS STRING), 1, 10) AS day",
        "'Customer#' || CAST(o_custkey AS STRING) AS party", "o_orderpriority AS address", "o_orderkey % 13 AS n_items",
        *[f"(o_orderkey + {i}) % 9 + 1 AS q{i}" for i in ITEMS],
        # prices and amounts are counted in halves, so that they have fractions and are exact
        *[f"200 + 2 * ((o_orderkey * 13 + {i * 37}) % 5000) + CASE WHEN o_orderkey % 4 = 0 THEN 0 ELSE {i % 2} END AS u{i}" for i in ITEMS],
    ],
    ["*", *[
        f"q{i} * u{i}" + (f" * {_SIGNS[i]}" if i in _SIGNS else "") + f" AS a{i}" for i in ITEMS
    ]],
    ["*", f"CASE WHEN k % 11 = 0 OR n_items = 0 THEN NULL ELSE {_item_sums()} END AS sub",
     " OR ".join(f"(n_items >= {i} AND a{i} <= 0)" for i in _SIGNS) + " AS bad_item"],
    ["*",
     "CASE WHEN k % 37 = 0 THEN NULL WHEN k % 4 <> 0 THEN sub * 9 END AS gst_cents",
     "CASE WHEN k % 37 = 0 THEN NULL WHEN k % 4 = 0 THEN (sub // 2) * 9 END AS half_cents",
     "CASE WHEN k % 41 = 0 THEN 1234567850 + k * 100 WHEN k % 7 = 0 OR sub IS NULL THEN order_cents"
     " WHEN k % 13 = 0 THEN -100 WHEN k % 29 = 0 THEN 0 ELSE sub * 59 END AS total_cents",
     "CASE WHEN k % 17 = 0 THEN NULL ELSE 'INV-' || CAST(k AS STRING) END AS invoice_number",
     "CASE WHEN k % 6 = 0 THEN NULL ELSE day END AS date", "CASE WHEN k % 2 = 0 THEN NULL ELSE day END AS due_date",
     "CASE WHEN k % 43 = 0 THEN '' ELSE 'Supplier ' || CAST(k % 97 AS STRING) END AS sender_company",
     "CASE WHEN k % 19 = 0 THEN '  ' ELSE party END AS receiver_company",
     "CASE WHEN k % 3 = 0 THEN NULL WHEN k % 12 = 2 THEN ''"
     " WHEN k % 3 = 1 AND k % 2 = 0 THEN '27 AALCP' || lpad(CAST(k % 10000 AS STRING), 4, '0') || 'N1Z8'"
     " WHEN k % 3 = 1 THEN '27AALCP' || lpad(CAST(k % 10000 AS STRING), 4, '0') || 'N1Z8'"
     " ELSE '27AALCP' || lpad(CAST(k % 10000 AS STRING), 4, '0') || 'N1Z' END AS gstin_sender",
     "CASE WHEN k % 4 = 0 THEN NULL WHEN k % 9 = 0 THEN 'ab' ELSE '+91-' || CAST(k AS STRING) END AS phone",
     "CASE WHEN k % 4 = 0 THEN NULL WHEN k % 9 = 0 THEN 'ab' ELSE 'u' || CAST(k AS STRING) || '@example.com' END AS email",
     ],
    ["*", "CAST(sub AS DOUBLE) / 2 AS subtotal", "CAST(total_cents AS DOUBLE) / 100 AS total_amount",
     "CAST(gst_cents AS DOUBLE) / 100 AS gst", "CAST(half_cents AS DOUBLE) / 100 AS cgst",
     "CAST(half_cents AS DOUBLE) / 100 AS sgst", "CAST(NULL AS DOUBLE) AS igst"],
]

RESUMES = [[
    "doc_id AS k", "'res_' || CAST(doc_id AS STRING) AS doc_id", "text AS summary", "lang AS address",
    "CASE WHEN doc_id % 10 = 0 THEN '  ' ELSE source || ' ' || lang END AS name",
    "CASE WHEN doc_id % 3 = 0 THEN NULL ELSE 'p' || CAST(doc_id AS STRING) || '@example.com' END AS email",
    "CASE WHEN doc_id % 14 = 1 THEN '' WHEN doc_id % 2 = 0 THEN NULL ELSE '+44 ' || CAST(doc_id AS STRING) END AS phone",
    "doc_id % 4 AS n_technical", "doc_id % 2 AS n_stack", "doc_id % 3 AS n_education", "doc_id % 2 AS n_work",
    "doc_id % 5 AS n_projects",
]]

EMAILS = [
    ["conv_id * 100 + turn AS k", "'eml_' || CAST(conv_id AS STRING) || '_' || CAST(turn AS STRING) AS doc_id",
     "role", "text"],
    ["k", "doc_id", "text",
     "CASE WHEN k % 13 = 0 THEN '' ELSE role END AS sender_name", "'team' AS receiver_name",
     "CASE WHEN k % 11 = 0 THEN ' ' ELSE role || ' ' || CAST(k AS STRING) END AS subject",
     "CASE WHEN k % 2 = 0 THEN NULL ELSE '2024-01-15' END AS date",
     "CASE WHEN k % 7 = 0 THEN NULL ELSE text END AS body", "k % 3 AS n_points", "k % 2 AS n_actions"],
]

FLAT = {"invoice": ("orders", INVOICES), "resume": ("documents", RESUMES), "email": ("conversations", EMAILS)}


def flat(spark: SparkSession, sf_dir: str, doc_type: str) -> DataFrame:
    table, layers = FLAT[doc_type]
    return spark_layers(read(spark, sf_dir, table), layers)


def _first(items: list, n: str):
    return F.slice(F.array(*items), F.lit(1), F.col(n).cast("int"))


def _texts(label: str, count: int, n: str):
    return _first([F.lit(f"{label} {i}") for i in range(1, count + 1)], n)


def records(spark: SparkSession, sf_dir: str, doc_type: str) -> DataFrame:
    """``doc_id, doc_type`` and the typed record in ``record``, without going through JSON."""
    rows = flat(spark, sf_dir, doc_type)
    null = F.lit(None).cast("string")
    built = {}
    if doc_type == "invoice":
        built["line_items"] = _first([F.struct(
            F.lit(f"part {i}").alias("description"), F.col(f"q{i}").alias("quantity"),
            F.lit(None).cast("double").alias("unit_price") if i % 2 == 0
            else (F.col(f"u{i}") / F.lit(2.0)).alias("unit_price"),
            (F.col(f"a{i}") / F.lit(2.0)).alias("amount"),
        ) for i in ITEMS], "n_items")
        built["gstin_receiver"] = null
    elif doc_type == "resume":
        built = {
            "linkedin": null, "github": null, "technical_skills": _texts("skill", 3, "n_technical"),
            "soft_skills": F.array().cast("array<string>"), "tech_stack": _texts("tool", 1, "n_stack"),
            "projects": _texts("project", 4, "n_projects"),
            "work_experience": _first([F.struct(
                F.lit("Acme").alias("company_name"), F.lit("Engineer").alias("role"),
                null.alias("duration"), null.alias("description"))], "n_work"),
            "education": _first([F.struct(
                F.lit(f"School {i}").alias("institution"), F.lit("BSc").alias("degree"),
                null.alias("field_of_study"), null.alias("year")) for i in (1, 2)], "n_education"),
        }
    else:
        built = {
            "key_points": _texts("point", 2, "n_points"), "action_items": _texts("action", 1, "n_actions"),
            "sender_email": null, "receiver_email": null, "tone": null, "priority": null,
        }
    fields = record_type(doc_type)
    record = F.struct(*[(built[f.name] if f.name in built else F.col(f.name)).alias(f.name) for f in fields])
    return rows.select("doc_id", F.lit(doc_type).alias("doc_type"), record.cast(fields).alias("record"))


def all_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three types in one table, one struct column each."""
    parts = []
    for doc_type in FLAT:
        rows = records(spark, sf_dir, doc_type)
        parts.append(rows.select("doc_id", "doc_type", *[
            (F.col("record") if t == doc_type else F.lit(None).cast(record_type(t))).alias(t) for t in FLAT
        ]))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# --- responses -----------------------------------------------------------------------

def _string(value: str) -> str:
    return f"CASE WHEN {value} IS NULL THEN 'null' ELSE '\"' || {value} || '\"' END"


def _escaped(value: str) -> str:
    out = f"replace({value}, chr(92), chr(92) || chr(92))"
    for code, mark in ((34, "chr(34)"), (10, "'n'"), (13, "'r'"), (9, "'t'")):
        out = f"replace({out}, chr({code}), chr(92) || {mark})"
    return out


def _array(items: list[str], n: str) -> str:
    cells = " || ".join(
        f"CASE WHEN {n} >= {i + 1} THEN {item if i == 0 else chr(39) + ',' + chr(39) + ' || ' + item} ELSE '' END"
        for i, item in enumerate(items)
    )
    return f"'[' || {cells} || ']'"


def _object(members: list[tuple[str, str]]) -> str:
    """JSON object text; a name starting with ``(`` is an expression."""
    cells = []
    for name, value in members:
        key = name if name.startswith("(") else f"'\"{name}\":'"
        cells.append(f"{key} || {value}")
    return "'{' || " + " || ',' || ".join(cells) + " || '}'"


def _literals(label: str, count: int) -> list[str]:
    return [f"'\"{label} {i}\"'" for i in range(1, count + 1)]


_FAULT = "CASE WHEN k % 8 = 6 THEN k % 5 ELSE -1 END AS fault"

_INVOICE_JSON = _object([
    ("invoice_number", _string("invoice_number")), ("date", _string("date")),
    ("sender_company", f"CASE WHEN fault = 4 THEN '5' ELSE {_string('sender_company')} END"),
    ("receiver_company", _string("receiver_company")),
    ("line_items", "CASE WHEN fault = 1 THEN 'null' ELSE " + _array([
        f"'{{\"description\":\"part {i}\",\"quantity\":' || CAST(q{i} AS STRING) || "
        + (f"',\"unit_price\":' || {_money(f'(u{i} * 50)')} || " if i % 2 else "',\"unit_price\":null' || ")
        + f"',\"amount\":' || {_money(f'(a{i} * 50)')} || '}}'" for i in ITEMS
    ], "n_items") + " END"),
    ("subtotal", f"CASE WHEN sub IS NULL THEN 'null' ELSE {_money('(sub * 50)')} END"),
    ("(CASE WHEN fault = 0 THEN '\"total\":' ELSE '\"total_amount\":' END)",
     f"CASE WHEN fault = 2 THEN '\"12.5\"' WHEN fault = 3 THEN '\"1,200\"' ELSE {_money('total_cents')} END"),
    ("gstin_sender", _string("gstin_sender")),
    ("gst", f"CASE WHEN gst_cents IS NULL THEN 'null' ELSE {_money('gst_cents')} END"),
    ("cgst", f"CASE WHEN half_cents IS NULL THEN 'null' ELSE {_money('half_cents')} END"),
    ("sgst", f"CASE WHEN half_cents IS NULL THEN 'null' ELSE {_money('half_cents')} END"),
    ("phone", _string("phone")), ("email", _string("email")), ("address", _string("address")),
    ("due_date", _string("due_date")),
])

_RESUME_JSON = _object([
    ("(CASE WHEN fault = 0 THEN '\"nom\":' ELSE '\"name\":' END)", _string("name")),
    ("email", f"CASE WHEN fault = 3 THEN '7' ELSE {_string('email')} END"), ("phone", _string("phone")),
    ("address", _string("address")),
    ("technical_skills", "CASE WHEN fault = 1 THEN 'null' ELSE " + _array(_literals("skill", 3), "n_technical") + " END"),
    ("tech_stack", _array(_literals("tool", 1), "n_stack")),
    ("work_experience", _array(["'{\"company_name\":\"Acme\",\"role\":\"Engineer\",\"duration\":null}'"], "n_work")),
    ("education", "CASE WHEN fault = 2 THEN '{}' ELSE " + _array(
        [f"'{{\"institution\":\"School {i}\",\"degree\":\"BSc\",\"extra\":{i}}}'" for i in (1, 2)], "n_education") + " END"),
    ("projects", "CASE WHEN fault = 4 THEN '[1]' ELSE " + _array(_literals("project", 4), "n_projects") + " END"),
    ("summary", f"'\"' || {_escaped('summary')} || '\"'"),
])

_EMAIL_JSON = _object([
    ("sender_name", _string("sender_name")), ("receiver_name", _string("receiver_name")),
    ("(CASE WHEN fault = 0 THEN '\"topic\":' ELSE '\"subject\":' END)", f"'\"' || {_escaped('subject')} || '\"'"),
    ("date", _string("date")),
    ("body", f"CASE WHEN body IS NULL OR fault = 2 THEN 'null' ELSE '\"' || {_escaped('body')} || '\"' END"),
    ("key_points", "CASE WHEN fault = 1 THEN 'null' ELSE " + _array(_literals("point", 2), "n_points") + " END"),
    ("action_items", "CASE WHEN fault = 4 THEN '{}' ELSE " + _array(_literals("action", 1), "n_actions") + " END"),
    ("tone", "CASE WHEN fault = 3 THEN '1.5' ELSE 'null' END"), ("seen", "'true'"),
])

_WRAP = """CASE WHEN k % 31 = 0 THEN NULL
 WHEN k % 8 = 2 THEN '```json' || chr(10) || j || chr(10) || '```'
 WHEN k % 8 = 3 THEN '<think>first' || chr(10) || '{"a": 1}</think>' || chr(10) || j
 WHEN k % 8 = 4 THEN j || ' and that is all'
 WHEN k % 8 = 5 THEN substr(j, 1, length(j) - 5)
 WHEN k % 8 = 7 AND k % 3 = 0 THEN 'null'
 WHEN k % 8 = 7 AND k % 3 = 1 THEN '[1]'
 ELSE j END AS raw_output"""

_TEXTS = {
    "invoice": "'Invoice ' || CAST(k AS STRING) || ' to ' || party || ' dated ' || day || ' total ' || "
               + _money("order_cents") + " || ' ' || address",
    "resume": "summary",
    "email": "text",
}


def _response_layers(doc_type: str, json_text: str) -> list[list[str]]:
    return [*FLAT[doc_type][1], ["*", _FAULT], [
        "k", "doc_id", f"'{doc_type}' AS doc_type", "doc_id || '.txt' AS filename",
        f"{_TEXTS[doc_type]} AS text", f"{json_text} AS j",
    ], [
        "k", "doc_id", "doc_type", "filename", "text", _WRAP,
        "CASE WHEN k % 31 = 0 THEN 0 ELSE 100 + k % 1500 END AS prompt_tokens",
        "CASE WHEN k % 31 = 0 THEN 0 ELSE k % 1000 END AS completion_tokens",
        "CASE WHEN k % 31 = 0 THEN 'timeout' END AS call_error",
    ]]


RESPONSES = {t: _response_layers(t, j) for t, j in (
    ("invoice", _INVOICE_JSON), ("resume", _RESUME_JSON), ("email", _EMAIL_JSON))}


def responses_of(spark: SparkSession, sf_dir: str, doc_type: str) -> DataFrame:
    return spark_layers(read(spark, sf_dir, FLAT[doc_type][0]), RESPONSES[doc_type])


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, doc_type, filename, text`` of every submission with its stored model response."""
    a, b, c = (responses_of(spark, sf_dir, t) for t in RESPONSES)
    return a.unionByName(b).unionByName(c)


def duck_responses() -> str:
    return " UNION ALL BY NAME ".join(
        "(" + duck_layers(FLAT[t][0], layers) + ")" for t, layers in RESPONSES.items()
    )
