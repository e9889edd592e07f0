"""Aggregates and report tables over result rows. One pass over the results each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordmill import fixed
from recordmill.functions.costs import priced, providers
from recordmill.functions.rules import failed_check_names, failed_check_names_sql
from recordmill.functions.scoring import bar, bar_sql
from recordmill.functions.text import py_float, py_float_sql, py_round, quote
from recordmill.session import scratch_path

# averages have one decimal and costs six: whole tenths and micros add up to the
# same total in every task order
_MILLION = 1_000_000.0


def _total_tenths() -> Column:
    return F.coalesce(F.sum(F.round(F.col("confidence.avg_confidence") * 10).cast("bigint")), F.lit(0))


def _total_micros() -> Column:
    return F.coalesce(F.sum(F.round(F.col("cost_usd") * _MILLION).cast("bigint")), F.lit(0))


def _whole(column: Column) -> Column:
    return F.coalesce(column, F.lit(0)).cast("bigint")


def batch_summary(results: DataFrame) -> DataFrame:
    """Counts, mean confidence over successful documents, tokens and cost of the rows given."""
    row = results.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("status") == "success").alias("successful"),
        F.count_if(F.col("validation.passed")).alias("validation_passed"),
        F.count_if(F.col("confidence.needs_human_review")).alias("needs_review"),
        _total_tenths().alias("_tenths"),
        _whole(F.sum("token_usage.prompt_tokens")).alias("prompt_tokens"),
        _whole(F.sum("token_usage.completion_tokens")).alias("completion_tokens"),
        _whole(F.sum("token_usage.total_tokens")).alias("total_tokens"),
        _total_micros().alias("_micros"),
    )
    return row.select(
        "total", "successful", (F.col("total") - F.col("successful")).alias("failed"), "validation_passed",
        "needs_review", py_round("((_tenths / 10D) / greatest(successful, 1))", 1).alias("avg_confidence"), "prompt_tokens", "completion_tokens",
        "total_tokens", (F.col("_micros") / F.lit(_MILLION)).alias("total_cost"),
    )


def report_summary(results: DataFrame) -> DataFrame:
    """Counts as in the batch summary, mean over rows that have a confidence (0 if none)."""
    row = results.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("status") == "success").alias("successful"),
        F.count_if(F.col("validation.passed")).alias("validation_passed"),
        F.count_if(F.col("confidence.needs_human_review")).alias("needs_review"),
        _total_tenths().alias("_tenths"), F.count("confidence.avg_confidence").alias("_scored"),
    )
    ratio = lambda c: F.concat(F.col(c).cast("string"), F.lit("/"), F.col("total").cast("string"))
    return row.select(
        "total", "successful", (F.col("total") - F.col("successful")).alias("failed"),
        ratio("validation_passed").alias("validation_ratio"), ratio("needs_review").alias("review_ratio"),
        py_round("((_tenths / 10D) / greatest(_scored, 1))", 1).alias("avg_confidence"),
    )


def per_document(results: DataFrame) -> DataFrame:
    failed = F.col("status") != "success"
    yes_no = lambda c: F.when(F.coalesce(F.col(c), F.lit(False)), F.lit("Yes")).otherwise(F.lit("No"))
    shown = F.concat(py_float("confidence.avg_confidence"), F.lit("%"))
    return results.select(
        "filename", "doc_type", yes_no("validation.passed").alias("valid"),
        F.coalesce(shown, F.lit("N/A")).alias("confidence"),
        F.col("token_usage.total_tokens").alias("tokens"),
        yes_no("confidence.needs_human_review").alias("review"),
        F.when(failed, F.lit("[FAILED]")).otherwise(F.lit("")).alias("marker"),
    )


def results_list(results: DataFrame) -> DataFrame:
    """The nine listing fields and the number of listed rows. Sort by ``filename`` where shown."""
    total = results.agg(F.count(F.lit(1)).alias("total"))
    return results.select(
        "filename", "doc_type", "status", F.col("validation.passed").alias("validation_passed"),
        F.col("confidence.avg_confidence").alias("avg_confidence"),
        F.col("confidence.needs_human_review").alias("needs_human_review"),
        F.coalesce("token_usage.total_tokens", F.lit(0)).cast("bigint").alias("total_tokens"),
        F.coalesce("cost_usd", F.lit(0.0)).alias("cost_usd"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"),
    ).withColumn("total", total.scalar())


def result_lookup(results: DataFrame, doc_id: str) -> DataFrame:
    return results.filter(F.col("doc_id") == doc_id)


def field_score_rows(results: DataFrame) -> DataFrame:
    """One row per document and scored field, in declared field order."""
    rows = results.filter("confidence is not null").select(
        "filename", "doc_type", "status", F.posexplode("confidence.field_scores").alias("_pos", "field", "score")
    )
    return rows.select(
        "filename", "doc_type", F.col("_pos").cast("bigint").alias("field_no"), "field",
        F.col("score").cast("bigint").alias("score"),
        (F.col("score") < fixed.REVIEW_BELOW).alias("flagged"), bar("score").alias("bar"),
    )


def review_queue(results: DataFrame) -> DataFrame:
    """One row per field a person has to check."""
    return results.select(
        "filename", F.explode("confidence.flagged_fields").alias("field", "_score")
    ).select("filename", "field", F.col("_score").cast("bigint").alias("score"))


def failed_checks(results: DataFrame) -> DataFrame:
    return results.filter("not validation.passed").select(
        "filename", "doc_type", failed_check_names("validation").alias("failed_checks")
    )


def _advice_sql() -> str:
    """Recommendations of one result row, in rule order."""
    flagged = lambda f: f"coalesce(map_contains_key(confidence.flagged_fields, '{f}'), false)"
    mean = "confidence.avg_confidence"
    rules = [
        (f"doc_type = 'invoice' and {flagged('invoice_number')}",
         f"'[WARN] ', filename, {quote(fixed.ADVICE_INVOICE_NUMBER)}"),
        (flagged("date"), f"'[WARN] ', filename, {quote(fixed.ADVICE_DATE)}"),
        (f"{mean} < 60",
         f"'[CRIT] ', filename, ': Low confidence (', {py_float_sql(mean)}, '%). Manual review strongly recommended.'"),
        ("not validation.passed",
         f"'[FIX] ', filename, ': Validation failed on: ', {failed_check_names_sql('validation')}"),
        (f"doc_type = 'email' and {flagged('body')}",
         f"'[FIX] ', filename, {quote(fixed.ADVICE_BODY)}"),
    ]
    return "array_compact(array(" + ", ".join(f"if({test}, concat({text}), null)" for test, text in rules) + "))"


def recommendations(results: DataFrame) -> DataFrame:
    """What to do about each document, numbered in rule order."""
    # the outer form, since the inner one would evaluate every rule again in a size filter
    return results.filter("confidence is not null").select(
        "filename", F.posexplode_outer(F.expr(_advice_sql())).alias("_pos", "recommendation")
    ).filter("_pos is not null").select("filename", (F.col("_pos") + 1).cast("bigint").alias("rule_order"), "recommendation")


def cost_compare(results: DataFrame) -> DataFrame:
    """Cost of the rows at every paid provider with a price. One totals row meets ten prices."""
    summary = batch_summary(results).select("successful", "prompt_tokens", "completion_tokens")
    paid = providers(results.sparkSession).filter((~F.col("free")) & (F.col("key") != fixed.FALLBACK_PROVIDER))
    # both sides are tiny by construction: a global aggregate and the price list
    rows = paid.crossJoin(summary)
    run_cost = priced("prompt_tokens", "completion_tokens", "input", "output")
    return rows.withColumn("run_cost", run_cost).select(
        "position", "key", "name", "run_cost",
        py_round("(run_cost / greatest(successful, 1))", 6).alias("cost_per_doc"),
    )


def cost_projection(results: DataFrame) -> DataFrame:
    """Cost per document, per 1,000 and per 10,000, each from the rounded cost per document."""
    summary = batch_summary(results)
    each = py_round("(total_cost / greatest(successful, 1))", 6)
    return summary.select("successful", "total_cost", each.alias("cost_per_doc")).select(
        "total_cost", "cost_per_doc",
        py_round("(cost_per_doc * 1000)", 4).alias("cost_per_1000"),
        py_round("(cost_per_doc * 10000)", 2).alias("cost_per_10000"),
    )


def cost_flat_estimate(results: DataFrame) -> DataFrame:
    """Estimate from a fixed token count per scored document."""
    tokens = F.col("documents") * fixed.ESTIMATE_TOKENS_PER_DOCUMENT
    return results.agg(F.count("confidence.avg_confidence").alias("documents")).select(
        "documents", tokens.alias("estimated_tokens"),
        ((tokens / F.lit(_MILLION)) * F.lit(fixed.ESTIMATE_USD_PER_MILLION)).alias("estimated_cost"),
    )


_RULE = "─" * 65
_LINE = "struct<section:int,line_no:int,line:string>"
#: Lines up to which a report is one file.
ONE_FILE_LINES = 1_000_000


def report_lines(results: DataFrame) -> DataFrame:
    """The text report as ``section, filename, line_no, line``.

    All lines of a document come from one pass over its row. Sorting by the first
    three columns gives the report, from the title (section 0) to the closing words (section 7); headings have an
    empty ``filename``. The time of the report is that of its newest row.
    """
    mean = "confidence.avg_confidence"
    mark = lambda c: f"if(coalesce({c}, false), 'Yes', 'No')"
    line = lambda section, n, text: f"named_struct('section', {section}, 'line_no', cast({n} as int), 'line', {text})"
    row = (f"concat(rpad(filename, greatest(length(filename), 25), ' '), ' ', rpad(doc_type, 10, ' '), ' ',"
           f" rpad({mark('validation.passed')}, 8, ' '), ' ', rpad(coalesce(concat({py_float_sql(mean)}, '%'), 'N/A'), 8, ' '),"
           f" ' ', {mark('confidence.needs_human_review')}, if(status = 'success', '', ' [FAILED]'))")
    score = (f"concat('   ', if(e.value < {fixed.REVIEW_BELOW}, '! ', '  '), rpad(e.key, 20, ' '), ' ',"
             f" {bar_sql('e.value')}, ' ', cast(e.value as string), '%')")
    flag = "concat('   ', e.key, ': ', cast(e.value as string), '% confidence — needs manual verification')"
    numbered = lambda items, section, first, text: (
        f"transform({items}, (e, i) -> {line(section, f'i + {first}', text)})")
    only_if = lambda test, array: f"if({test}, {array}, cast(array() as array<{_LINE}>))"
    scored = "confidence is not null"
    parts = [
        f"array({line(2, 1, row)})",
        only_if(scored, f"array({line(3, 1, "concat(filename, ' (', doc_type, ')', if(status = 'success', '', ' [validation failed]'))")})"),
        only_if(f"{scored} and size(confidence.field_scores) = 0", f"array({line(3, 2, quote('   No field scores available'))})"),
        only_if(scored, numbered("map_entries(confidence.field_scores)", 3, 2, score)),
        only_if(f"{scored} and size(confidence.flagged_fields) > 0", "array(" + line(4, 1, "concat(filename, ':')") + ")"),
        only_if(scored, numbered("map_entries(confidence.flagged_fields)", 4, 2, flag)),
        only_if(scored, numbered(_advice_sql(), 5, 1, "concat('  ', e)")),
    ]
    # every document has at least its table line, so the outer form adds no empty rows
    body = results.select("filename", F.inline_outer(F.expr(f"concat({', '.join(parts)})"))).select(
        "section", "filename", "line_no", "line")

    facts = _report_facts(results)
    fact = lambda label, value: f"concat('  {label:<26}: ', {value})"
    heads = [line(s, n, quote(t)) for s, title in fixed.REPORT_SECTIONS.items()
             for n, t in ((-9, _RULE), (-8, title), (-7, _RULE))]
    table = " ".join(label.ljust(width) for label, width in fixed.REPORT_TABLE_HEAD)
    heads += [line(2, -6, quote(table)), line(2, -5, quote(_RULE))]
    heads += [line(0, n, quote(t)) for n, t in enumerate(["=" * 65, *fixed.REPORT_TITLE])]
    heads += [line(0, 3, "concat('   Generated: ', coalesce(date_format(_ts, 'yyyy-MM-dd HH:mm:ss'), ''))"), line(0, 4, quote("=" * 65))]
    heads += [line(7, n, quote(t)) for n, t in enumerate(["=" * 65, fixed.REPORT_CLOSING, "=" * 65])]
    stats = [
        line(1, 1, fact("Total documents processed", "total")),
        line(1, 2, fact("Successfully extracted", "successful")),
        line(1, 3, fact("Failed extractions", "failed")),
        line(1, 4, fact("Validation passed", "validation_ratio")),
        line(1, 5, fact("Flagged for human review", "review_ratio")),
        line(1, 6, fact("Average confidence", f"{py_float_sql('avg_confidence')}, '%'")),
        f"if(_flagged = 0, {line(4, 0, quote('   No fields flagged for review!'))}, null)",
        f"if(_advised = 0, {line(5, 0, quote('  No recommendations — all documents processed cleanly!'))}, null)",
        line(6, 1, fact("Documents processed", "documents")),
        line(6, 2, fact("Estimated tokens used", "'~', format_number(estimated_tokens, 0)")),
        line(6, 3, fact("Estimated cost (OpenAI)", "'$', format_string('%.4f', estimated_cost)")),
        line(6, 4, fact("Actual cost (Groq)", "'$0.0000 (free tier)'")),
        *[line(6, 5 + n, quote(t)) for n, t in enumerate(fixed.REPORT_COST_NOTE)],
    ]
    frame = facts.select(F.inline(F.expr(f"array_compact(array({', '.join(heads + stats)}))"))).select(
        "section", F.lit("").alias("filename"), "line_no", "line")
    return frame.unionByName(body)


def _report_facts(results: DataFrame) -> DataFrame:
    """Everything the headings need, from one aggregate."""
    row = results.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "success").alias("successful"),
        F.count_if(F.col("validation.passed")).alias("_valid"),
        F.count_if(F.col("confidence.needs_human_review")).alias("_review"),
        _total_tenths().alias("_tenths"), F.count("confidence.avg_confidence").alias("documents"),
        F.count_if(F.size("confidence.flagged_fields") > 0).alias("_flagged"),
        F.count_if(F.expr(f"confidence is not null and size({_advice_sql()}) > 0")).alias("_advised"), F.max("ts").alias("_ts"),
    )
    ratio = lambda c: F.concat(F.col(c).cast("string"), F.lit("/"), F.col("total").cast("string"))
    tokens = F.col("documents") * fixed.ESTIMATE_TOKENS_PER_DOCUMENT
    mean = py_round("((_tenths / 10D) / greatest(documents, 1))", 1)
    return row.select(
        "total", "successful", (F.col("total") - F.col("successful")).alias("failed"),
        ratio("_valid").alias("validation_ratio"), ratio("_review").alias("review_ratio"),
        mean.alias("avg_confidence"), "documents", tokens.alias("estimated_tokens"),
        ((tokens / F.lit(_MILLION)) * F.lit(fixed.ESTIMATE_USD_PER_MILLION)).alias("estimated_cost"),
        "_flagged", "_advised", "_ts",
    )


def write_report(results: DataFrame, path: str, one_file: int = ONE_FILE_LINES) -> None:
    """The report as text in order: one file up to ``one_file`` lines, else files whose names are in order.

    The sort is a range exchange, so no task holds the report; a single file is written by a task that reads the sorted
    parts one after the other. Files appear when the whole write is committed, with the marker ``_SUCCESS``.
    """
    stored = scratch_path(results.sparkSession, "report")
    lines = report_lines(results)
    lines.write.parquet(stored)
    lines = results.sparkSession.read.schema(lines.schema).parquet(stored)
    ordered = lines.orderBy("section", "filename", "line_no").select("line")
    (ordered.coalesce(1) if lines.count() <= one_file else ordered).write.mode("overwrite").text(path)
