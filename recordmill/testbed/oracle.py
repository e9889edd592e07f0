"""DuckDB SQL for the registered queries, written from the operators' definitions.

The SQL starts from the given tables (through the shared fixture expressions) and
computes every result its own way: words by word, JSON with DuckDB's functions,
rules and scores as plain CASE expressions.
"""

from __future__ import annotations

from recordmill import fixed
from recordmill.schemas import NESTED, RECORDS
from recordmill.testbed import fixtures as fx

ORACLE: dict[str, str] = {}


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _rounded(x: str, digits: int) -> str:
    """Exact half-even rounding of a double: compare the product's exact error with one half."""
    s = float(10 ** digits)
    sh = 134217729.0 * s - (134217729.0 * s - s)
    sl = s - sh
    d = "::DOUBLE"
    return (
        f"(SELECT (f + CASE WHEN h > 0 OR (h = 0 AND f % 2 = 1) THEN 1 ELSE 0 END){d} / {s}{d} FROM ("
        f"SELECT f, (p - f - 0.5{d}) + (((xh * {sh}{d} - p) + xh * {sl}{d} + xl * {sh}{d}) + xl * {sl}{d}) AS h FROM ("
        f"SELECT v, xh, v - xh AS xl, v * {s}{d} AS p, floor(v * {s}{d}) AS f FROM ("
        f"SELECT v, 134217729.0{d} * v - (134217729.0{d} * v - v) AS xh FROM (SELECT ({x}) AS v)))))"
    )


# --- base relations ----------------------------------------------------------------------

DOCS = fx.duck_layers("documents", fx.DOCUMENTS)
SUBMITTED = fx.duck_layers("documents", fx.SUBMITTED)
RESPONSES = fx.duck_responses()


def _chunks(source: str, keep: str = "") -> str:
    """``source`` has filename and text (and doc_type when kept)."""
    extra = f", {keep}" if keep else ""
    return f"""
      SELECT filename || '_chunk_' || CAST(i AS VARCHAR) AS chunk_id, filename{extra}, i AS chunk_index, total AS total_chunks,
             CAST(least(200, n - 150 * i) AS BIGINT) AS word_count,
             array_to_string(ws[150 * i + 1 : 150 * i + 200], ' ') AS text
      FROM (SELECT *, unnest(range(0, total)) AS i FROM (
        SELECT *, CAST(CASE WHEN n <= 200 THEN 1 ELSE ceil((n - 200) / 150.0) + 1 END AS BIGINT) AS total FROM (
          SELECT *, len(ws) AS n FROM (SELECT filename{extra}, regexp_extract_all(text, '\\S+') AS ws FROM ({source}))
          ) WHERE n > 0))"""


CHUNKS = _chunks(DOCS, "doc_type")
_BUCKET = "('0x' || substr(md5(lower(w)), 1, 8))::BIGINT % 384"


def _catalog(name: str) -> str:
    rows = ", ".join(
        f"({_q(name)}, {_q(t)}, {i}::BIGINT, {_q(text)})"
        for t, texts in fixed.CATALOGS[name].items() for i, text in enumerate(texts)
    )
    return f"SELECT * FROM (VALUES {rows}) AS c(catalog, doc_type, query_no, query_text)"


def _counts(source: str, keys: str, text: str) -> str:
    return (f"SELECT {keys}, {_BUCKET} AS b, count(*) AS c FROM (SELECT {keys}, unnest(regexp_extract_all({text}, '\\S+')) AS w"
            f" FROM {source}) GROUP BY ALL")


def _scored(catalog: str, match: str, source: str = CHUNKS) -> str:
    """CTEs ending in ``scored(chunk_id, filename, ..., q_type, query_no, s)``."""
    return f"""
      chunks AS ({source}), cat AS ({_catalog(catalog)}),
      cc AS ({_counts('chunks', 'chunk_id', 'text')}), qc AS ({_counts('cat', 'doc_type, query_no', 'query_text')}),
      cn AS (SELECT chunk_id, sqrt(sum(c * c)::DOUBLE) AS n FROM cc GROUP BY 1),
      qn AS (SELECT doc_type, query_no, sqrt(sum(c * c)::DOUBLE) AS n FROM qc GROUP BY 1, 2),
      dots AS (SELECT chunk_id, qc.doc_type AS q_type, query_no, sum(cc.c * qc.c)::DOUBLE AS d
               FROM cc JOIN qc USING (b) GROUP BY ALL),
      scored AS (SELECT chunks.*, cat.doc_type AS q_type, cat.query_no, coalesce(d, 0.0) / (cn.n * qn.n) AS s
                 FROM chunks JOIN cat ON {match} JOIN cn USING (chunk_id)
                 JOIN qn ON qn.doc_type = cat.doc_type AND qn.query_no = cat.query_no
                 LEFT JOIN dots ON dots.chunk_id = chunks.chunk_id AND dots.q_type = cat.doc_type
                                AND dots.query_no = cat.query_no)"""


def _top(partition: str, tie: str, k: int) -> str:
    return f"""top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {partition}
               ORDER BY round(s, 9) DESC, {tie}) AS rank FROM scored) WHERE rank <= {k})"""


_OWN_TYPE = "cat.doc_type = CASE WHEN chunks.doc_type IN ('invoice', 'resume', 'email') THEN chunks.doc_type ELSE 'unknown' END"


def _run_context(source: str) -> str:
    """CTEs ending in ``contexts(filename, context)`` as a run assembles them."""
    return _scored("run", _OWN_TYPE, _chunks(source, "doc_type")) + ", " + _top(
        "filename, query_no", "chunk_index", fixed.RUN_TOP_K) + f""",
      distinct_texts AS (SELECT filename, min(chunk_index) AS first_at, text FROM top GROUP BY filename, text),
      contexts AS (SELECT filename, string_agg(text, {_sep(fixed.RUN_SEPARATOR)} ORDER BY first_at) AS context
                   FROM distinct_texts GROUP BY filename)"""


def _sep(text: str) -> str:
    return " || ".join("chr(10)" if p == "\n" else _q(p) for p in _split_lines(text))


def _split_lines(text: str) -> list[str]:
    parts: list[str] = []
    for i, piece in enumerate(text.split("\n")):
        if i:
            parts.append("\n")
        if piece:
            parts.append(piece)
    return parts


_WORDS = "len(regexp_extract_all({}, '\\S+'))"

# --- sources -----------------------------------------------------------------------------

ORACLE["src_text_folder"] = f"""SELECT doc_type, md5(text || chr(10)) AS text_md5, {_WORDS.format('text')} AS words FROM ({DOCS}) WHERE doc_type <> 'memo'"""
ORACLE["src_utf8_gate"] = f"""SELECT k, readable AS accepted, CASE WHEN readable THEN length(text) END AS n_chars FROM ({SUBMITTED})"""
ORACLE["input_gate"] = f"""
  SELECT k, reason = '' AS accepted, reason FROM (SELECT k, CASE
    WHEN filename IS NOT NULL AND NOT ends_with(filename, '.txt') THEN 'extension' WHEN NOT readable THEN 'encoding'
    WHEN {_WORDS.format('text')} = 0 THEN 'blank' WHEN doc_type NOT IN ('invoice', 'resume', 'email') THEN 'doc_type'
    ELSE '' END AS reason FROM ({SUBMITTED}))"""
ORACLE["doc_id_default"] = f"""
  SELECT k, CASE WHEN doc_id <> '' THEN doc_id WHEN filename IS NOT NULL THEN replace(filename, '.txt', '')
    ELSE doc_type || '_' || sha256(text) END AS doc_id FROM ({SUBMITTED})"""
ORACLE["discovery_count"] = f"""
  SELECT t.doc_type, count(d.k) AS documents FROM (VALUES ('invoice'), ('resume'), ('email')) AS t(doc_type)
  LEFT JOIN ({SUBMITTED}) d ON d.doc_type = t.doc_type GROUP BY 1"""

_PRICES = "(VALUES " + ", ".join(
    f"({i}::BIGINT, {_q(k)}, {_q(n)}, {_q(m)}, {a}::DOUBLE, {b}::DOUBLE, {str(f).lower()})"
    for i, (k, n, m, a, b, f) in enumerate(fixed.PROVIDERS)
) + ") AS p(position, key, name, model, input, output, free)"


def _cost(prompt: str, completion: str, price_in: str, price_out: str) -> str:
    return _rounded(
        f"({prompt}::DOUBLE / 1000000.0::DOUBLE) * {price_in}::DOUBLE + ({completion}::DOUBLE / 1000000.0::DOUBLE) * {price_out}::DOUBLE", 6)


ORACLE["providers"] = f"""
  SELECT doc_type, position, key, name, model, input, output, free, key = 'openai_gpt4o_mini' AS active,
         {_cost('pt', 'ct', 'input', 'output')} AS cost_usd
  FROM {_PRICES}, (SELECT doc_type, sum(prompt_tokens)::BIGINT AS pt, sum(completion_tokens)::BIGINT AS ct FROM ({RESPONSES}) GROUP BY doc_type)"""
ORACLE["query_catalog"] = f"""
  SELECT k, d.doc_type, catalog, query_no, query_text FROM ({SUBMITTED}) d
  JOIN ({_catalog('run')} UNION ALL {_catalog('context')}) c
    ON c.doc_type = CASE WHEN d.doc_type = 'memo' THEN 'unknown' ELSE d.doc_type END"""

# --- text --------------------------------------------------------------------------------

ORACLE["word_count"] = f"SELECT doc_id, {_WORDS.format('text')} AS words FROM ({DOCS})"
ORACLE["strip_len"] = f"""
  SELECT doc_id, length(p) AS padded, length(regexp_replace(p, '^\\s+|\\s+$', '', 'g')) AS stripped
  FROM (SELECT doc_id, ' ' || chr(10) || chr(9) || text || chr(13) || chr(10) || '  ' AS p FROM ({DOCS}))"""
ORACLE["chunks"] = f"SELECT chunk_id, filename, chunk_index, total_chunks, word_count, text FROM ({CHUNKS})"
ORACLE["chunk_summary"] = f"""
  SELECT filename, count(*) AS chunks, sum(word_count)::BIGINT AS total_words,
         max(CASE WHEN chunk_index = 0 THEN replace(substr(text, 1, 60), chr(10), ' ') END) AS preview,
         200::BIGINT AS chunk_size, 50::BIGINT AS overlap FROM ({CHUNKS}) GROUP BY filename"""
ORACLE["route_by_length"] = f"""
  SELECT doc_id, {_WORDS.format('text')} AS word_count, {_WORDS.format('text')} > 2000 AS use_retrieval FROM ({DOCS})"""
_LONG = f"SELECT * FROM ({DOCS}) WHERE {_WORDS.format('text')} > {fixed.CHUNK_WORDS}"
ORACLE["context_reduction"] = f"""
  WITH {_run_context(_LONG)}
  SELECT doc_id, before AS words_before, after AS words_after,
         round_even((1.0::DOUBLE - after / greatest(before, 1)) * 100, 0)::BIGINT AS reduction
  FROM (SELECT doc_id, {_WORDS.format('text')} AS before, {_WORDS.format('coalesce(context, text)')} AS after
        FROM ({DOCS}) LEFT JOIN contexts USING (filename))"""


def _lines(text: str) -> str:
    return _sep(text)


_S, _F, _OS, _OF = "<class 'str'>", "<class 'float'>", "typing.Optional[str]", "typing.Optional[float]"
# the field listings as a prompt shows them, written out
_PROMPT_FIELDS = {
    "invoice": [("invoice_number", _OS), ("date", _OS), ("sender_company", _S), ("receiver_company", _S), ("line_items", "list[LineItem]"),
                ("subtotal", _OF), ("total_amount", _F), ("gstin_sender", _OS), ("gstin_receiver", _OS), ("gst", _OF), ("cgst", _OF),
                ("sgst", _OF), ("igst", _OF), ("phone", _OS), ("email", _OS), ("address", _OS), ("due_date", _OS)],
    "resume": [("name", _S), ("email", _OS), ("phone", _OS), ("address", _OS), ("linkedin", _OS), ("github", _OS),
               ("technical_skills", "list[str]"), ("soft_skills", "list[str]"), ("tech_stack", "list[str]"),
               ("work_experience", "list[WorkExperience]"), ("education", "list[Education]"), ("projects", "list[str]"), ("summary", _OS)],
    "email": [("sender_name", _S), ("receiver_name", _S), ("subject", _S), ("date", _OS), ("body", _OS), ("key_points", "list[str]"),
              ("action_items", "list[str]"), ("sender_email", _OS), ("receiver_email", _OS), ("tone", _OS), ("priority", _OS)],
}
_SCHEMA_TEXT = {t: "{\n" + ",\n".join(f'  "{n}": "{kind}"' for n, kind in own) + "\n}" for t, own in _PROMPT_FIELDS.items()}
_SCHEMA_CASE = "CASE doc_type " + " ".join(f"WHEN {_q(t)} THEN {_lines(text)}" for t, text in _SCHEMA_TEXT.items()) + " END"
ORACLE["prompts"] = f"""
  SELECT doc_id, doc_type, md5({_lines(fixed.SYSTEM_PROMPT)}) AS system_md5,
    {_lines(fixed.USER_PROMPT_HEAD)} || {_SCHEMA_CASE} || {_lines(fixed.USER_PROMPT_DOCUMENT)} || text
    || {_lines(fixed.USER_PROMPT_TAIL)} AS user_prompt FROM ({DOCS})"""

# --- vectors -----------------------------------------------------------------------------

ORACLE["embed_hashed"] = f"""
  WITH chunks AS ({CHUNKS}), cc AS ({_counts('chunks', 'chunk_id', 'text')})
  SELECT chunk_id, 384::BIGINT AS dim, sum(c)::BIGINT AS words, sum(c * (b + 1))::BIGINT AS moment_1,
         sum(c * (b + 1) * (b + 1))::BIGINT AS moment_2, round(sqrt(sum(c * c)::DOUBLE), 6) AS norm
  FROM cc GROUP BY chunk_id"""
ORACLE["vector_upsert"] = f"""
  WITH docs AS ({DOCS}), again AS (
    SELECT filename, CASE WHEN k % 5 = 0 THEN ' ' ELSE 'revised ' || text END AS text
    FROM docs WHERE k IN (SELECT doc_id FROM labels)),
  fresh AS ({_chunks('again')}), merged AS (
    SELECT * FROM fresh UNION ALL
    SELECT * FROM ({_chunks('docs')}) WHERE filename NOT IN (SELECT filename FROM fresh))
  SELECT chunk_id, filename, chunk_index, total_chunks, word_count, md5(text) AS text_md5, word_count AS words_in_vector FROM merged"""
ORACLE["embed_model_hook"] = f"""
  SELECT chunk_id, {', '.join(f"length(text) - length(replace(text, '{c}', '')) AS n_{c}" for c in 'etao')} FROM ({CHUNKS})"""
ORACLE["embed_summary"] = f"""
  SELECT filename, n AS chunks_count, CASE WHEN n > 0 THEN 'success' ELSE 'failed' END AS status FROM (
    SELECT filename, CAST(CASE WHEN w = 0 THEN 0 WHEN w <= 200 THEN 1 ELSE ceil((w - 200) / 150.0) + 1 END AS BIGINT) AS n
    FROM (SELECT 'doc_' || CAST(k AS VARCHAR) AS filename, {_WORDS.format('text')} AS w FROM ({SUBMITTED})))"""
ORACLE["embed_totals"] = f"""
  SELECT count_if(status = 'success') AS successful, sum(chunks_count)::BIGINT AS total_chunks FROM ({ORACLE['embed_summary']})"""
_CENTROIDS = """
  cells AS (SELECT label, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS pos FROM embeddings),
  means AS (SELECT label, pos, sum(v::DECIMAL(20, 10))::DOUBLE / count(*) AS m FROM cells GROUP BY 1, 2),
  centroids AS (SELECT label, list(m ORDER BY pos) AS c FROM means GROUP BY 1)"""
_COSINE = """list_dot_product(e::DOUBLE[], c) / (sqrt(list_dot_product(e::DOUBLE[], e::DOUBLE[])) * sqrt(list_dot_product(c, c)))"""
ORACLE["cosine_score"] = f"""
  WITH {_CENTROIDS} SELECT vec_id, label, round({_COSINE}, 4) AS score
  FROM (SELECT vec_id, label, embedding AS e, c FROM embeddings JOIN centroids USING (label))"""
ORACLE["search_topk"] = f"""
  WITH {_scored('run', 'true')}, {_top('q_type, query_no', 'chunk_id', fixed.CONTEXT_TOP_K)}
  SELECT q_type || '_' || CAST(query_no AS VARCHAR) AS query_id, chunk_id, rank, round(s, 4) AS score FROM top"""
ORACLE["search_topk_vectors"] = f"""
  WITH {_CENTROIDS}, scored AS (SELECT query_id, vec_id, {_COSINE} AS s
    FROM (SELECT label::BIGINT AS query_id, c FROM centroids), (SELECT vec_id, embedding AS e FROM embeddings)),
  {_top('query_id', 'vec_id', 5)}
  SELECT query_id, vec_id, rank, round(s, 4) AS score FROM top"""
ORACLE["search_all_vectors"] = f"""
  WITH scored AS (SELECT query_id, vec_id, {_COSINE} AS s
    FROM (SELECT vec_id AS query_id, embedding::DOUBLE[] AS c FROM embeddings), (SELECT vec_id, embedding AS e FROM embeddings)),
  {_top('query_id', 'vec_id', 3)}
  SELECT query_id, vec_id, rank, round(s, 4) AS score FROM top"""
ORACLE["search_topk_filtered"] = f"""
  WITH {_scored('context', _OWN_TYPE)}, {_top('filename, query_no', 'chunk_index', fixed.CONTEXT_TOP_K)}
  SELECT filename, query_no, rank, chunk_id, word_count, round(s, 4) AS score FROM top"""
_FANOUT = f"{_scored('run', _OWN_TYPE)}, {_top('filename, query_no', 'chunk_index', fixed.RUN_TOP_K)}"
ORACLE["retrieve_fanout"] = f"""
  WITH {_FANOUT} SELECT filename, doc_type, query_no, rank, chunk_index, round(s, 4) AS score, md5(text) AS text_md5 FROM top"""
ORACLE["dedupe_hits"] = f"""
  WITH {_FANOUT} SELECT filename, min(chunk_index) AS chunk_index, md5(text) AS text_md5 FROM top GROUP BY filename, text"""
ORACLE["relevant_context"] = f"""
  WITH {_scored('context', _OWN_TYPE)}, {_top('filename, query_no', 'chunk_index', fixed.CONTEXT_TOP_K)},
  hits AS (SELECT DISTINCT filename, chunk_index, text FROM top)
  SELECT filename, md5(coalesce(ctx, '')) AS context_md5, coalesce(length(ctx), 0) AS n_chars FROM ({DOCS}) LEFT JOIN (
    SELECT filename, string_agg(text, chr(10) || chr(10) ORDER BY chunk_index) AS ctx FROM hits GROUP BY filename) USING (filename)"""

# --- model output ------------------------------------------------------------------------

ORACLE["infer_model_hook"] = f"""
  SELECT doc_id, CASE WHEN d[1] = '0' THEN '' ELSE d END AS raw_output, CASE WHEN d[1] = '0' THEN 0 ELSE n END::BIGINT AS prompt_tokens,
    CASE WHEN d[1] = '0' THEN 0 ELSE 32 END::BIGINT AS completion_tokens, CASE WHEN d[1] = '0' THEN 'refused' ELSE '' END AS call_error
  FROM (SELECT doc_id, md5(user_prompt) AS d, length(user_prompt) AS n FROM ({ORACLE['prompts']}) WHERE doc_type <> 'memo')
  UNION ALL SELECT doc_id, '', 0, 0, 'no prompt' FROM ({ORACLE['prompts']}) WHERE doc_type = 'memo'"""

ORACLE["infer_replay"] = f"""
  SELECT doc_id, doc_type, md5(coalesce(raw_output, '')) AS output_md5, prompt_tokens::BIGINT AS prompt_tokens,
         completion_tokens::BIGINT AS completion_tokens,
         CASE WHEN call_error IS NULL THEN '' ELSE 'no response' END AS call_error FROM ({RESPONSES})"""

_TRIM = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"
_CLEAN = _TRIM.format("replace(regexp_replace(" + _TRIM.format(
    "regexp_replace(raw_output, '<think>.*?</think>', '', 'gs')") + ", '```(?:json)?\\n?', '', 'g'), '```', '')")
ORACLE["clean_output"] = f"SELECT doc_id, {_CLEAN} AS cleaned FROM ({RESPONSES})"


def _parsed(source: str) -> str:
    return f"SELECT *, CASE WHEN json_valid(cleaned) THEN cleaned::JSON END AS j FROM (SELECT *, {_CLEAN} AS cleaned FROM ({source}))"


ORACLE["parse_json_strict"] = f"""
  SELECT doc_id, j IS NOT NULL AS valid, coalesce(json_type(j), '') AS kind FROM ({_parsed(RESPONSES)})"""

_FLOAT_TEXT = "'[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]+)?'"


def _fits(doc: str, path: str, kind: str) -> str:
    t = f"json_type({doc}, '{path}')"
    text = f"trim(json_extract_string({doc}, '{path}'))"
    if kind == "str":
        return f"{t} = 'VARCHAR'"
    numeric = "'BIGINT', 'UBIGINT', 'BOOLEAN'"
    if kind == "float":
        return f"({t} IN ({numeric}, 'DOUBLE') OR ({t} = 'VARCHAR' AND regexp_full_match({text}, {_FLOAT_TEXT})))"
    if kind == "int":
        return (f"({t} IN ({numeric}) OR ({t} = 'DOUBLE' AND CAST(json_extract_string({doc}, '{path}') AS DOUBLE) = floor(CAST(json_extract_string({doc}, '{path}') AS DOUBLE)))"
                f" OR ({t} = 'VARCHAR' AND regexp_full_match({text}, '[+-]?[0-9]+([.]0*)?')))")
    inner = kind[len("list<"):-1]
    if inner in NESTED:
        parts = ["json_type(x) = 'OBJECT'"]
        for f in NESTED[inner]:
            ok = _fits("x", f"$.{f.name}", f.kind)
            if f.presence == "opt":
                ok = f"(coalesce(json_type(x, '$.{f.name}'), 'NULL') = 'NULL' OR {ok})"
            parts.append(f"coalesce({ok}, false)")
        element = " AND ".join(parts)
    else:
        element = "json_type(x) = 'VARCHAR'"
    return f"({t} = 'ARRAY' AND len(list_filter(json_extract({doc}, '{path}[*]'), lambda x: NOT ({element}))) = 0)"


def _gate_errors(doc_type: str) -> str:
    """Comma-joined ``field:error`` of the object ``j``; empty when it fits."""
    cells = []
    for f in RECORDS[doc_type]:
        t = f"json_type(j, '$.{f.name}')"
        fits = f"coalesce({_fits('j', f'$.{f.name}', f.kind)}, false)"
        absent = {"req": "'missing'", "opt": "NULL", "list": "NULL"}[f.presence]
        null = "NULL" if f.presence == "opt" else "'null'"
        cells.append(f"{_q(f.name + ':')} || CASE WHEN {t} IS NULL THEN {absent} WHEN {t} = 'NULL' THEN {null}"
                     f" WHEN NOT {fits} THEN 'type' END")
    return f"concat_ws(',', {', '.join(cells)})"


def _objects(doc_type: str) -> str:
    source = "(" + fx.duck_layers(fx.FLAT[doc_type][0], fx.RESPONSES[doc_type]) + ")"
    return (f"SELECT *, coalesce(json_type(j), '') = 'OBJECT' AS is_object, {_gate_errors(doc_type)} AS faults FROM ({_parsed(source)})")


def _text(name: str) -> str:
    return f"json_extract_string(j, '$.{name}')"


def _number(name: str) -> str:
    return f"TRY_CAST(trim(json_extract_string(j, '$.{name}')) AS DOUBLE)"


def _size(name: str) -> str:
    return f"coalesce(json_array_length(j, '$.{name}'), 0)::BIGINT"


def _gate_sql(doc_type: str, shown: dict[str, str]) -> str:
    columns = ", ".join(f"CASE WHEN is_object AND faults = '' THEN {sql} END AS {name}" for name, sql in shown.items())
    return (f"SELECT doc_id, is_object AND faults = '' AS accepted, CASE WHEN is_object THEN faults ELSE '' END AS errors, {columns}"
            f" FROM ({_objects(doc_type)})")


def _item_sum(name: str, cast: str) -> str:
    return f"coalesce(list_sum(list_transform(json_extract(j, '$.line_items[*].{name}'), lambda x: coalesce(TRY_CAST(x AS {cast}), 0))), 0)::{cast}"


ORACLE["schema_gate_invoice"] = _gate_sql("invoice", {
    "invoice_number": _text("invoice_number"), "sender_company": _text("sender_company"), "subtotal": _number("subtotal"),
    "total_amount": _number("total_amount"), "gst": _number("gst"), "quantities": _item_sum("quantity", "BIGINT"),
    "unit_prices": _item_sum("unit_price", "DOUBLE"), "amounts": _item_sum("amount", "DOUBLE"),
})
ORACLE["schema_gate_resume"] = _gate_sql("resume", {
    "name": _text("name"), "phone": _text("phone"), "n_technical": _size("technical_skills"), "n_soft": _size("soft_skills"),
    "schools": "array_to_string(list_transform(json_extract(j, '$.education[*]'), lambda x: json_extract_string(x, '$.institution')), '|')",
    "n_work": _size("work_experience"), "summary": _text("summary"),
})
ORACLE["schema_gate_email"] = _gate_sql("email", {
    "sender_name": _text("sender_name"), "subject": _text("subject"), "date": _text("date"), "body": _text("body"),
    "points": "array_to_string(json_extract_string(j, '$.key_points[*]'), '|')", "n_actions": _size("action_items"),
})

_OUTCOMES = f"""
  SELECT *, CASE WHEN outcome IN ('ok', 'json_error') THEN prompt_tokens ELSE 0 END::BIGINT AS pt,
            CASE WHEN outcome IN ('ok', 'json_error') THEN completion_tokens ELSE 0 END::BIGINT AS ct FROM (
    SELECT *, CASE WHEN call_error IS NOT NULL THEN 'call_error' WHEN j IS NULL OR json_type(j) = 'NULL' THEN 'json_error'
      WHEN json_type(j) <> 'OBJECT' THEN 'call_error'
      WHEN CASE doc_type WHEN 'invoice' THEN {_gate_errors('invoice')} WHEN 'resume' THEN {_gate_errors('resume')}
           ELSE {_gate_errors('email')} END = '' THEN 'ok' ELSE 'schema_error' END AS outcome
    FROM ({_parsed(RESPONSES)}))"""
ORACLE["extraction_outcome"] = f"""
  SELECT doc_id, doc_type, outcome, pt AS prompt_tokens, ct AS completion_tokens, pt + ct AS total_tokens FROM ({_OUTCOMES})"""

# --- rules and scores ----------------------------------------------------------------------

_TAX = "(((coalesce(igst, 0.0) + coalesce(cgst, 0.0)) + coalesce(sgst, 0.0)) + coalesce(gst, 0.0))"
_NO_TAX = " AND ".join(f"coalesce({t}, 0.0) = 0" for t in ("igst", "cgst", "sgst", "gst"))
_GSTIN_OK = "length(replace(gstin_sender, ' ', '')) = 15"


def _filled(name: str) -> str:
    return f"coalesce(trim({name}) <> '', false)"


# (name, applies, passed, message)
RULES = {
    "invoice": [
        ("Total amount positive", "true", "total_amount > 0", "'Total amount: ₹' || CAST(total_amount AS VARCHAR)"),
        ("Has line items", "true", "n_items > 0", "'Found ' || CAST(n_items AS VARCHAR) || ' line item(s)'"),
        ("Line item amounts positive", "n_items > 0", "NOT bad_item",
         "CASE WHEN bad_item THEN 'Some line items have zero or negative amounts' ELSE 'All line item amounts are positive' END"),
        ("Math check (subtotal + tax = total)", "coalesce(subtotal <> 0 AND total_amount <> 0, false)",
         f"abs(subtotal + {_TAX} - total_amount) <= total_amount * 0.01::DOUBLE",
         f"'Subtotal ₹' || CAST(subtotal AS VARCHAR) || ' + Tax ₹' || CASE WHEN {_NO_TAX} THEN '0' ELSE CAST({_TAX} AS VARCHAR) END"
         f" || ' = ₹' || CAST(subtotal + {_TAX} AS VARCHAR) || ' (Expected: ₹' || CAST(total_amount AS VARCHAR) || ')'"),
        ("GSTIN format valid", "coalesce(gstin_sender <> '', false)", _GSTIN_OK,
         f"'GSTIN: ' || gstin_sender || CASE WHEN {_GSTIN_OK} THEN ' (valid)' ELSE ' (invalid - must be 15 characters)' END"),
        ("Sender company name present", "true", _filled("sender_company"), "'Sender: ' || sender_company"),
        ("Receiver company name present", "true", _filled("receiver_company"), "'Receiver: ' || receiver_company"),
    ],
    "resume": [
        ("Name present", "true", _filled("name"), "'Name: ' || name"),
        ("Has contact information", "true", "(coalesce(email, '') <> '' OR coalesce(phone, '') <> '')",
         "CASE WHEN coalesce(email, '') <> '' OR coalesce(phone, '') <> '' THEN 'Email or phone found'"
         " ELSE 'No contact information found' END"),
        ("Has technical skills", "true", "(n_technical > 0 OR n_stack > 0)",
         "'Found ' || CAST(n_technical AS VARCHAR) || ' technical skills'"),
        ("Has education", "true", "n_education > 0", "'Found ' || CAST(n_education AS VARCHAR) || ' education record(s)'"),
    ],
    "email": [
        ("Sender present", "true", _filled("sender_name"), "'Sender: ' || sender_name"),
        ("Subject present", "true", _filled("subject"), "'Subject: ' || subject"),
        ("Body present", "true", _filled("body"), "'Body length: ' || CAST(length(coalesce(body, '')) AS VARCHAR) || ' characters'"),
        ("Has key points or action items", "true", "(n_points > 0 OR n_actions > 0)",
         "'Found ' || CAST(n_points AS VARCHAR) || ' key points and ' || CAST(n_actions AS VARCHAR) || ' action items'"),
    ],
}


def _s(name: str) -> tuple[str, str]:
    size = f"length(regexp_replace({name}, '^\\s+|\\s+$', '', 'g'))"
    return name, f"CASE WHEN {name} IS NULL OR {size} = 0 THEN 0 WHEN {size} >= 3 THEN 80 ELSE 50 END"


def _l(name: str, column: str) -> tuple[str, str]:
    return name, f"CASE WHEN {column} > 0 THEN 90 ELSE 30 END"


def _f(name: str) -> tuple[str, str]:
    return name, f"CASE WHEN {name} IS NULL THEN 0 WHEN {name} > 0 THEN 90 ELSE 30 END"


SCORES = {
    "invoice": [
        _s("invoice_number"), _s("date"), _s("sender_company"), _s("receiver_company"), _l("line_items", "n_items"),
        _f("subtotal"), _f("total_amount"),
        ("gstin_sender", f"CASE WHEN gstin_sender IS NULL THEN 0 WHEN {_GSTIN_OK} THEN 95 ELSE 40 END"),
        _s("phone"), _s("email"), _s("due_date"),
    ],
    "resume": [_s("name"), _s("email"), _s("phone"), _l("technical_skills", "n_technical"),
               _l("work_experience", "n_work"), _l("education", "n_education"), _l("projects", "n_projects")],
    "email": [_s("sender_name"), _s("receiver_name"), _s("subject"), _s("date"), _s("body"),
              _l("key_points", "n_points"), _l("action_items", "n_actions")],
}


def _judged(doc_type: str, source: str) -> str:
    """Adds lists of applicable checks and of scores to flat record rows."""
    checks = ", ".join(
        f"CASE WHEN {applies} THEN {{'check_name': {_q(name)}, 'passed': coalesce({passed}, false), 'message': {message}}} END"
        for name, applies, passed, message in RULES[doc_type]
    )
    scores = ", ".join(f"{{'field': {_q(f)}, 'score': ({sql})::BIGINT}}" for f, sql in SCORES[doc_type])
    return f"""SELECT doc_id, '{doc_type}' AS doc_type, list_filter([{checks}], lambda c: c IS NOT NULL) AS checks,
                      [{scores}] AS scores FROM ({source})"""


_PASSED = "len(list_filter(checks, lambda c: c.passed))::BIGINT"
_TOTAL = "len(checks)::BIGINT"
_SUM = "list_sum(list_transform(scores, lambda s: s.score))"
_AVG = f"round({_SUM} / len(scores)::DOUBLE, 1)"
_LOW = "list_filter(scores, lambda s: s.score < 70)"
_FAILED_NAMES = "array_to_string(list_transform(list_filter(checks, lambda c: NOT c.passed), lambda c: c.check_name), ', ')"


def _pairs(lists: str) -> str:
    return f"array_to_string(list_transform({lists}, lambda s: s.field || '=' || CAST(s.score AS VARCHAR)), ',')"


def _flat(doc_type: str) -> str:
    table, layers = fx.FLAT[doc_type]
    return fx.duck_layers(table, layers)


_VERDICT = f"""{_PASSED} = {_TOTAL} AS passed, {_TOTAL} AS total_checks, {_PASSED} AS passed_checks,
               {_TOTAL} - {_PASSED} AS failed_checks"""
for _t in RULES:
    ORACLE[f"validate_{_t}"] = f"""
      SELECT doc_id, {_VERDICT}, array_to_string(list_transform(checks, lambda c: c.check_name), '|') AS checks,
             array_to_string(list_transform(checks, lambda c: CAST(c.passed AS VARCHAR)), '|') AS verdicts
      FROM ({_judged(_t, _flat(_t))})"""
    ORACLE[f"confidence_{_t}"] = f"""
      SELECT doc_id, {_AVG} AS avg_confidence, len({_LOW}) > 0 AS needs_human_review, {_pairs('scores')} AS scores,
             {_pairs(_LOW)} AS flagged FROM ({_judged(_t, _flat(_t))})"""

_ALL = " UNION ALL ".join(_judged(t, _flat(t)) for t in RULES)
# documents of a type nobody knows: one failed check, no scores
_ROUTED = f"""
  SELECT doc_id, CASE WHEN length(doc_id) % 7 = 0 THEN 'memo' ELSE doc_type END AS doc_type,
    CASE WHEN length(doc_id) % 7 = 0 THEN [{{'check_name': 'Unknown type', 'passed': false,
      'message': 'Unknown document type: memo'}}] ELSE checks END AS checks,
    CASE WHEN length(doc_id) % 7 <> 0 THEN scores ELSE [] END AS scores FROM ({_ALL})"""
ORACLE["validate_all"] = f"SELECT doc_id, doc_type, {_VERDICT} FROM ({_ROUTED})"
ORACLE["validation_report"] = f"""
  SELECT doc_type, count(*) AS documents, count_if(passed) AS passed, sum(total_checks)::BIGINT AS total_checks,
         sum(passed_checks)::BIGINT AS passed_checks, sum(failed_checks)::BIGINT AS failed_checks
  FROM (SELECT doc_type, {_VERDICT} FROM ({_ROUTED})) GROUP BY 1"""
ORACLE["validation_messages"] = f"""
  SELECT doc_id, n - 1 AS check_no, checks[n].check_name AS check_name, checks[n].message AS message
  FROM (SELECT doc_id, checks, unnest(range(1, len(checks) + 1)) AS n FROM ({_ROUTED}))"""
ORACLE["field_scores"] = f"""
  SELECT doc_id, s.field AS field, s.score AS score FROM (SELECT doc_id, unnest(scores) AS s FROM ({_ROUTED}))"""
_ROUTED_SCORE = f"""
  SELECT doc_id, doc_type, CASE WHEN len(scores) = 0 THEN 0.0::DOUBLE ELSE {_AVG} END AS avg_confidence,
         len(scores) = 0 OR len({_LOW}) > 0 AS needs_human_review, len(scores)::BIGINT AS n_fields,
         {_pairs(_LOW)} AS flagged, len({_LOW}) AS n_flagged FROM ({_ROUTED})"""
ORACLE["confidence_all"] = f"SELECT doc_id, doc_type, avg_confidence, needs_human_review, n_fields, flagged FROM ({_ROUTED_SCORE})"
ORACLE["confidence_report"] = f"""
  SELECT doc_type, count(*) AS documents, count_if(needs_human_review) AS needs_review,
         sum(round(avg_confidence * 10)::BIGINT)::BIGINT AS tenths, sum(n_flagged)::BIGINT AS flagged
  FROM ({_ROUTED_SCORE}) GROUP BY 1"""

# --- results -------------------------------------------------------------------------------

_FROM_JSON = {
    "invoice": [
        *[f"{_text(n)} AS {n}" for n in ("invoice_number", "date", "sender_company", "receiver_company", "gstin_sender",
                                         "phone", "email", "due_date")],
        *[f"{_number(n)} AS {n}" for n in ("subtotal", "total_amount", "gst", "cgst", "sgst", "igst")],
        f"{_size('line_items')} AS n_items",
        "len(list_filter(json_extract(j, '$.line_items[*].amount'), lambda x: CAST(x AS DOUBLE) <= 0)) > 0 AS bad_item",
    ],
    "resume": [
        *[f"{_text(n)} AS {n}" for n in ("name", "email", "phone")],
        *[f"{_size(f)} AS {n}" for f, n in (("technical_skills", "n_technical"), ("tech_stack", "n_stack"),
                                            ("education", "n_education"), ("work_experience", "n_work"),
                                            ("projects", "n_projects"))],
    ],
    "email": [
        *[f"{_text(n)} AS {n}" for n in ("sender_name", "receiver_name", "subject", "date", "body")],
        f"{_size('key_points')} AS n_points", f"{_size('action_items')} AS n_actions",
    ],
}
_OK = {t: _judged(t, f"SELECT doc_id, {', '.join(cols)} FROM outcomes WHERE outcome = 'ok' AND doc_type = '{t}'")
       for t, cols in _FROM_JSON.items()}
_RUN_VALUES = ", ".join(
    f"({_q(run)}, {_q(at.replace(' ', 'T'))}, {_q(p)}, {_q(m)}, {i}::DOUBLE, {o}::DOUBLE)"
    for run, at, p in fx.RUNS for k, _, m, i, o, _f2 in fixed.PROVIDERS if k == p
)
# one row per run and document
_RES = f"""
  outcomes AS ({_OUTCOMES}), judged AS ({' UNION ALL '.join(_OK.values())}),
  runs AS (SELECT * FROM (VALUES {_RUN_VALUES}) AS r(run_id, ts, provider, model, price_in, price_out)),
  res AS (SELECT *, {_cost('pt', 'ct', 'price_in', 'price_out')} AS cost_usd FROM (
    SELECT run_id, ts, provider, model, price_in, price_out, o.doc_id, filename, o.doc_type, text, pt, ct,
      outcome = 'ok' AS ok, CASE WHEN outcome = 'ok' THEN 'success' ELSE 'failed' END AS status,
      CASE WHEN outcome = 'ok' THEN '' ELSE 'Extraction failed' END AS error, checks, scores,
      CASE WHEN outcome = 'ok' THEN {_PASSED} = {_TOTAL} END AS passed, CASE WHEN outcome = 'ok' THEN {_AVG} END AS avg_confidence,
      CASE WHEN outcome = 'ok' THEN len({_LOW}) > 0 END AS review
    FROM outcomes o LEFT JOIN judged USING (doc_id) CROSS JOIN runs)),
  latest AS (SELECT * FROM res WHERE run_id = (SELECT max(run_id) FROM res))"""

ORACLE["src_results_json"] = f"""
  WITH {_RES} SELECT run_id, doc_id, filename, status, error, coalesce({_TOTAL}, 0) AS total_checks,
    coalesce({_pairs('scores')}, '') AS scores, cost_usd FROM res"""
ORACLE["latest_run"] = f"WITH {_RES} SELECT run_id, doc_id, provider, status, cost_usd FROM latest"
ORACLE["failed_checks"] = f"WITH {_RES} SELECT filename, doc_type, {_FAILED_NAMES} AS failed_checks FROM latest WHERE NOT passed"
ORACLE["field_score_rows"] = f"""
  WITH {_RES} SELECT filename, doc_type, n - 1 AS field_no, scores[n].field AS field, scores[n].score AS score,
    scores[n].score < 70 AS flagged,
    repeat('█', scores[n].score // 10) || repeat('░', 10 - scores[n].score // 10) AS bar
  FROM (SELECT filename, doc_type, scores, unnest(range(1, len(scores) + 1)) AS n FROM latest WHERE ok)"""
ORACLE["review_queue"] = f"""
  WITH {_RES} SELECT filename, s.field AS field, s.score AS score
  FROM (SELECT filename, unnest({_LOW}) AS s FROM latest WHERE ok)"""

ORACLE["cost_active"] = f"""
  SELECT doc_id, {_cost('prompt_tokens', 'completion_tokens', '0.15', '0.6')} AS cost_usd FROM ({RESPONSES})"""
ORACLE["cost_for_provider"] = f"""
  SELECT doc_id, provider, {_cost('prompt_tokens', 'completion_tokens', 'coalesce(input, 0)', 'coalesce(output, 0)')} AS cost_usd
  FROM (SELECT *, ['groq', 'google_flash', 'mistral_large', 'custom', 'nobody'][k % 5 + 1] AS provider FROM ({RESPONSES})) r
  LEFT JOIN {_PRICES} ON p.key = r.provider"""
_TOTALS = f"""
  {_RES}, totals AS (SELECT count(*) AS total, count_if(ok) AS successful, count_if(passed) AS validation_passed,
    count_if(review) AS needs_review, sum(avg_confidence::DECIMAL(18, 1)) AS conf, count(avg_confidence) AS scored,
    sum(pt)::BIGINT AS prompt_tokens, sum(ct)::BIGINT AS completion_tokens, sum(pt + ct)::BIGINT AS total_tokens,
    sum(cost_usd::DECIMAL(18, 6))::DOUBLE AS total_cost FROM latest)"""
ORACLE["cost_compare"] = f"""
  WITH {_TOTALS} SELECT position, key, name, run_cost, {_rounded('run_cost / greatest(successful, 1)', 6)} AS cost_per_doc
  FROM (SELECT position, key, name, successful, {_cost('prompt_tokens', 'completion_tokens', 'input', 'output')} AS run_cost
        FROM {_PRICES}, totals WHERE NOT free AND key <> 'custom')"""
ORACLE["cost_projection"] = f"""
  WITH {_TOTALS} SELECT total_cost, c AS cost_per_doc, {_rounded('c * 1000', 4)} AS cost_per_1000,
    {_rounded('c * 10000', 2)} AS cost_per_10000
  FROM (SELECT total_cost, {_rounded('total_cost / greatest(successful, 1)', 6)} AS c FROM totals)"""
ORACLE["cost_flat_estimate"] = f"""
  WITH {_TOTALS} SELECT scored AS documents, scored * 800 AS estimated_tokens,
    ((scored * 800)::DOUBLE / 1000000.0::DOUBLE) * 0.15::DOUBLE AS estimated_cost FROM totals"""

_LONG_SUBMISSIONS = f"SELECT doc_id AS filename, doc_type, text FROM ({RESPONSES}) WHERE {_WORDS.format('text')} > 2000"
_FULL = f"""
  WITH {_RES}, {_run_context(_LONG_SUBMISSIONS)},
  full_run AS (SELECT r.*, c.filename IS NOT NULL AS use_retrieval, {_WORDS.format('coalesce(context, text)')} AS context_words
          FROM res r LEFT JOIN contexts c ON c.filename = r.doc_id WHERE run_id = {_q(fx.RUNS[0][0])})"""
ORACLE["extraction_run"] = f"""
  {_FULL} SELECT doc_id, doc_type, status, error, use_retrieval, context_words, passed AS validation_passed,
    CASE WHEN ok THEN {_PASSED} END AS passed_checks, avg_confidence,
    coalesce({_pairs(_LOW)}, '') AS flagged, pt + ct AS total_tokens, cost_usd FROM full_run"""
ORACLE["stream_ingest"] = f"""
  {_FULL} SELECT doc_id, status, use_retrieval, context_words, passed AS validation_passed, avg_confidence,
    pt + ct AS total_tokens, cost_usd FROM full_run
  UNION ALL SELECT NULL, 'failed', false, 4, NULL, NULL, 0, 0 FROM ({RESPONSES}) WHERE k % 17 = 3"""
ORACLE["batch_summary"] = f"""
  WITH {_TOTALS} SELECT total, successful, total - successful AS failed, validation_passed, needs_review,
    {_rounded('conf::DOUBLE / greatest(successful, 1)', 1)} AS avg_confidence, prompt_tokens, completion_tokens, total_tokens,
    total_cost FROM totals"""
ORACLE["report_summary"] = f"""
  WITH {_TOTALS} SELECT total, successful, total - successful AS failed, validation_passed || '/' || total AS validation_ratio,
    needs_review || '/' || total AS review_ratio, {_rounded('conf::DOUBLE / greatest(scored, 1)', 1)} AS avg_confidence FROM totals"""
_YES = "CASE WHEN {} THEN 'Yes' ELSE 'No' END"
ORACLE["per_document"] = f"""
  WITH {_RES} SELECT filename, doc_type, {_YES.format('passed')} AS valid,
    CASE WHEN ok THEN CAST(avg_confidence AS VARCHAR) || '%' ELSE 'N/A' END AS confidence, pt + ct AS tokens,
    {_YES.format('review')} AS review, CASE WHEN ok THEN '' ELSE '[FAILED]' END AS marker FROM latest"""
ORACLE["results_list"] = f"""
  WITH {_RES} SELECT filename, doc_type, status, passed AS validation_passed, avg_confidence, review AS needs_human_review,
    pt + ct AS total_tokens, cost_usd, ts AS timestamp, (SELECT count(*) FROM latest) AS total FROM latest"""
ORACLE["result_lookup"] = f"""
  WITH {_RES} SELECT run_id, doc_id, provider, status, {_pairs('scores')} AS scores,
    array_to_string(list_transform(checks, lambda c: c.message), '|') AS messages, cost_usd FROM res WHERE doc_id = 'inv_11'"""
_HAS = "len(list_filter(scores, lambda s: s.field = '{}' AND s.score < 70)) > 0"
_NO_NUMBER = "': No invoice number found. Ask sender to include invoice number for tracking.'"
_NO_DATE = "': No date found. Date is important for payment tracking and compliance.'"
_NO_BODY = "': Email body not extracted. Consider improving extraction prompt for emails.'"
_ADVICE = f"""list_filter([
    CASE WHEN doc_type = 'invoice' AND {_HAS.format('invoice_number')} THEN '[WARN] ' || filename || {_NO_NUMBER} END,
    CASE WHEN {_HAS.format('date')} THEN '[WARN] ' || filename || {_NO_DATE} END,
    CASE WHEN avg_confidence < 60 THEN '[CRIT] ' || filename || ': Low confidence (' || CAST(avg_confidence AS VARCHAR)
      || '%). Manual review strongly recommended.' END,
    CASE WHEN NOT passed THEN '[FIX] ' || filename || ': Validation failed on: ' || {_FAILED_NAMES} END,
    CASE WHEN doc_type = 'email' AND {_HAS.format('body')} THEN '[FIX] ' || filename || {_NO_BODY} END
  ], lambda a: a IS NOT NULL)"""
ORACLE["recommendations"] = f"""
  WITH {_RES}, advised AS (SELECT filename, {_ADVICE} AS advice FROM latest WHERE ok)
  SELECT filename, n AS rule_order, advice[n] AS recommendation
  FROM (SELECT filename, advice, unnest(range(1, len(advice) + 1)) AS n FROM advised)"""
ORACLE["sink_json"] = f"WITH {_RES} SELECT doc_id, status, NOT ok AS null_kept FROM latest"
_PY_BOOL = "CASE WHEN NOT ok THEN 'N/A' WHEN {} THEN 'True' ELSE 'False' END"
ORACLE["batch_csv"] = f"""
  WITH {_RES} SELECT filename, doc_type, model, provider, status, {_PY_BOOL.format('passed')} AS validation_passed,
    CASE WHEN ok THEN CAST({_PASSED} AS VARCHAR) ELSE 'N/A' END AS checks_passed,
    CASE WHEN ok THEN CAST({_TOTAL} AS VARCHAR) ELSE 'N/A' END AS total_checks,
    CASE WHEN ok THEN CAST(avg_confidence AS VARCHAR) ELSE 'N/A' END AS avg_confidence,
    {_PY_BOOL.format('review')} AS needs_human_review,
    CASE WHEN ok THEN array_to_string(list_transform({_LOW}, lambda s: s.field), ', ') ELSE '' END AS flagged_fields,
    CAST(pt AS VARCHAR) AS prompt_tokens, CAST(ct AS VARCHAR) AS completion_tokens, CAST(pt + ct AS VARCHAR) AS total_tokens,
    CAST(cost_usd AS VARCHAR) AS cost_usd, ts AS timestamp FROM latest"""
ORACLE["run_history"] = f"""
  WITH {_RES} SELECT run_id, provider, count(*) AS documents, count_if(ok) AS successful,
    sum(cost_usd::DECIMAL(18, 6))::DOUBLE AS total_cost FROM res GROUP BY 1, 2"""

# the report line by line; headings have an empty filename
_THIN, _THICK = "─" * 65, "=" * 65
_HEADINGS = ", ".join(f"({s}, {n}, {_q(t)})" for s, n, t in [
    (0, 0, _THICK), (0, 1, "INTELLIGENT DOCUMENT PROCESSOR"), (0, 2, "   Batch Processing Report"), (0, 4, _THICK),
    (1, -9, _THIN), (1, -8, "OVERALL STATISTICS"), (1, -7, _THIN),
    (2, -9, _THIN), (2, -8, "PER-DOCUMENT BREAKDOWN"), (2, -7, _THIN),
    (2, -6, "File                      Type       Valid    Conf     Review"), (2, -5, _THIN),
    (3, -9, _THIN), (3, -8, "FIELD-LEVEL CONFIDENCE SCORES"), (3, -7, _THIN),
    (4, -9, _THIN), (4, -8, "FIELDS FLAGGED FOR HUMAN REVIEW"), (4, -7, _THIN),
    (5, -9, _THIN), (5, -8, "RECOMMENDATIONS"), (5, -7, _THIN),
    (6, -9, _THIN), (6, -8, "COST ANALYSIS"), (6, -7, _THIN), (6, 4, "  Actual cost (Groq)        : $0.0000 (free tier)"),
    (6, 5, "  NOTE: Groq is free tier. Figures above show"), (6, 6, "  production cost reference using OpenAI pricing."),
    (7, 0, _THICK), (7, 1, "Report complete."), (7, 2, _THICK),
])


def _fact(section: int, n: int, label: str, value: str) -> str:
    return f"SELECT {section}, {n}, '  {label:<26}: ' || {value} FROM totals"


_AVERAGE = f"CAST({_rounded('conf::DOUBLE / greatest(scored, 1)', 1)} AS VARCHAR) || '%'"
_FACTS = " UNION ALL ".join([
    _fact(1, 1, "Total documents processed", "total"), _fact(1, 2, "Successfully extracted", "successful"),
    _fact(1, 3, "Failed extractions", "total - successful"), _fact(1, 4, "Validation passed", "validation_passed || '/' || total"),
    _fact(1, 5, "Flagged for human review", "needs_review || '/' || total"), _fact(1, 6, "Average confidence", _AVERAGE),
    _fact(6, 1, "Documents processed", "scored"),
    _fact(6, 2, "Estimated tokens used", "'~' || format('{:,}', scored * 800)"),
    _fact(6, 3, "Estimated cost (OpenAI)", "'$' || format('{:.4f}', ((scored * 800)::DOUBLE / 1000000.0::DOUBLE) * 0.15::DOUBLE)"),
    "SELECT 0, 3, '   Generated: ' || replace(substr(CAST(max(ts) AS VARCHAR), 1, 19), 'T', ' ') FROM latest",
    "SELECT 4, 0, '   No fields flagged for review!' FROM totals WHERE needs_review = 0",
    "SELECT 5, 0, '  No recommendations — all documents processed cleanly!' FROM totals"
    f" WHERE NOT EXISTS (SELECT 1 FROM latest WHERE ok AND len({_ADVICE}) > 0)",
])
_SHOWN = "CASE WHEN ok THEN CAST(avg_confidence AS VARCHAR) || '%' ELSE 'N/A' END"
_DOC_LINE = (f"rpad(filename, greatest(length(filename), 25)::INTEGER, ' ') || ' ' || rpad(doc_type, 10, ' ') || ' '"
             f" || rpad({_YES.format('passed')}, 8, ' ') || ' ' || rpad({_SHOWN}, 8, ' ') || ' ' || {_YES.format('review')}"
             f" || CASE WHEN ok THEN '' ELSE ' [FAILED]' END")
ORACLE["report_lines"] = f"""
  WITH {_TOTALS}, facts(section, line_no, line) AS ({_FACTS} UNION ALL SELECT * FROM (VALUES {_HEADINGS})),
  docs(section, filename, line_no, line) AS (
    SELECT 2, filename, 1, {_DOC_LINE} FROM latest
    UNION ALL SELECT 3, filename, 1, filename || ' (' || doc_type || ')' FROM latest WHERE ok
    UNION ALL SELECT 3, filename, n + 1, '   ' || CASE WHEN scores[n].score < 70 THEN '! ' ELSE '  ' END
      || rpad(scores[n].field, 20, ' ') || ' ' || repeat('█', scores[n].score // 10) || repeat('░', 10 - scores[n].score // 10)
      || ' ' || scores[n].score || '%'
      FROM (SELECT filename, scores, unnest(range(1, len(scores) + 1)) AS n FROM latest WHERE ok)
    UNION ALL SELECT 4, filename, 1, filename || ':' FROM latest WHERE review
    UNION ALL SELECT 4, filename, n + 1, '   ' || low[n].field || ': ' || low[n].score || '% confidence — needs manual verification'
      FROM (SELECT filename, low, unnest(range(1, len(low) + 1)) AS n FROM (SELECT filename, {_LOW} AS low FROM latest WHERE ok))
    UNION ALL SELECT 5, filename, n, '  ' || advice[n]
      FROM (SELECT filename, advice, unnest(range(1, len(advice) + 1)) AS n FROM (SELECT filename, {_ADVICE} AS advice FROM latest WHERE ok)))
  SELECT section::BIGINT AS section, '' AS filename, line_no::BIGINT AS line_no, line FROM facts
  UNION ALL SELECT section::BIGINT, filename, line_no::BIGINT, line FROM docs"""
