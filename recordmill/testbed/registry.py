"""One registered query per operator, each over whole tables."""

from __future__ import annotations

import hashlib
import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordmill import fixed
from recordmill.functions import costs, record_json, rules, scoring, text, vectors
from recordmill.operators import chunking, extraction, in_row, intake, retrieval, store
from recordmill.plans import extraction_run as runs
from recordmill.plans import reports
from recordmill.session import configure, scratch_path
from recordmill.sources import files
from recordmill.streaming import inference
from recordmill.streaming.ingest import ingest
from recordmill.testbed import fixtures as fx

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(name: str) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        def configured(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(configure(spark), sf_dir)

        configured.__name__ = name
        configured.__doc__ = fn.__doc__
        QUERIES[name] = configured
        return fn

    return add


# --- shared inputs ---------------------------------------------------------------------

def documents(spark: SparkSession, sf: str) -> DataFrame:
    return fx.spark_layers(fx.read(spark, sf, "documents"), fx.DOCUMENTS)


def submitted(spark: SparkSession, sf: str) -> DataFrame:
    return fx.spark_layers(fx.read(spark, sf, "documents"), fx.SUBMITTED)


def chunk_vectors(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.embed(chunking.chunk_documents(documents(spark, sf), keep=("doc_type",)))


_tables: dict[tuple[str, str], str] = {}
_lock = threading.Lock()


def results_path(spark: SparkSession, sf: str) -> str:
    """The results table of two runs, written once per application and data folder.

    Reports read what runs have written; the second run prices the same extractions
    at another provider.
    """
    key = (spark.sparkContext.applicationId, sf)
    with _lock:
        if key not in _tables:
            path = scratch_path(spark, "results")
            (first, at, provider), (second, later, other) = fx.RUNS
            submissions = fx.responses(spark, sf)
            files.write_run(runs.run(
                submissions.select("doc_id", "doc_type", "filename", "text"), first, at,
                responses=submissions, provider=provider,
            ), path)
            earlier = files.read_runs(spark, path).filter(F.col("run_id") == first)
            files.write_run(runs.reprice(earlier, second, later, other), path)
            _tables[key] = path
        return _tables[key]


def all_runs(spark: SparkSession, sf: str) -> DataFrame:
    return files.read_runs(spark, results_path(spark, sf))


def results(spark: SparkSession, sf: str) -> DataFrame:
    return files.latest_run(spark, results_path(spark, sf))


def pairs_text(map_column: str):
    """``field=score`` of a map in field order, as one text."""
    return F.array_join(F.transform(
        F.map_entries(map_column), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")


def list_text(column, field: str):
    return F.array_join(F.transform(column, lambda c: c[field].cast("string")), "|")


# --- sources ---------------------------------------------------------------------------

@query("src_text_folder")
def _(spark, sf):
    path = scratch_path(spark, "folder")
    files.write_text_folder(documents(spark, sf), path)
    return files.read_text_folder(spark, path).select(
        "doc_type", F.md5("text").alias("text_md5"), text.word_count("text").alias("words"))


@query("src_utf8_gate")
def _(spark, sf):
    rows = submitted(spark, sf)
    content = F.when(F.col("readable"), F.encode("text", "UTF-8")).otherwise(
        F.concat(F.encode("text", "UTF-8"), F.unhex(F.lit("FF"))))
    return rows.withColumn("content", content).select(
        "k", intake.valid_utf8(F.col("content")).alias("accepted"),
        F.length(intake.decode(F.col("content"))).cast("bigint").alias("n_chars"))


@query("input_gate")
def _(spark, sf):
    rows = submitted(spark, sf)
    content = F.when(F.col("readable"), F.encode("text", "UTF-8")).otherwise(
        F.concat(F.encode("text", "UTF-8"), F.unhex(F.lit("FF"))))
    reason = intake.reject_reason(F.col("filename"), "text", F.col("doc_type"), content)
    return rows.select("k", reason.isNull().alias("accepted"), F.coalesce(reason, F.lit("")).alias("reason"))


@query("doc_id_default")
def _(spark, sf):
    return submitted(spark, sf).select("k", intake.default_doc_id(
        F.col("doc_id"), F.col("doc_type"), F.col("text"), F.col("filename")).alias("doc_id"))


@query("discovery_count")
def _(spark, sf):
    return intake.discovery_count(submitted(spark, sf))


@query("src_results_json")
def _(spark, sf):
    path = scratch_path(spark, "json")
    files.write_json(all_runs(spark, sf), path)
    return files.read_json(spark, path).select(
        "run_id", "doc_id", "filename", "status", F.coalesce("error", F.lit("")).alias("error"),
        F.coalesce("validation.total_checks", F.lit(0)).cast("bigint").alias("total_checks"),
        F.coalesce(pairs_text("confidence.field_scores"), F.lit("")).alias("scores"), "cost_usd")


@query("latest_run")
def _(spark, sf):
    return results(spark, sf).select("run_id", "doc_id", "provider", "status", "cost_usd")


@query("providers")
def _(spark, sf):
    used = fx.responses(spark, sf).groupBy("doc_type").agg(
        F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"))
    # bounded on both sides: one row per document type, ten prices
    return used.crossJoin(costs.providers(spark, "openai_gpt4o_mini")).select(
        "doc_type", "position", "key", "name", "model", "input", "output", "free", "active",
        costs.priced("prompt_tokens", "completion_tokens", "input", "output")
        .alias("cost_usd"))


@query("query_catalog")
def _(spark, sf):
    both = retrieval.query_catalog(spark, "run").unionByName(retrieval.query_catalog(spark, "context"))
    return retrieval.resolve_queries(submitted(spark, sf).select("k", "doc_type"), both).select(
        "k", "doc_type", "catalog", "query_no", "query_text")


# --- text ------------------------------------------------------------------------------

@query("word_count")
def _(spark, sf):
    return documents(spark, sf).select("doc_id", text.word_count("text").alias("words"))


@query("strip_len")
def _(spark, sf):
    padded = F.concat(F.lit(" \n\t"), F.col("text"), F.lit("\r\n  ")).alias("padded")
    return documents(spark, sf).select("doc_id", padded).select(
        "doc_id", F.length("padded").cast("bigint").alias("padded"),
        F.length(text.strip("padded")).cast("bigint").alias("stripped"))


@query("chunks")
def _(spark, sf):
    return chunking.chunk_documents(documents(spark, sf))


@query("chunk_summary")
def _(spark, sf):
    return chunking.chunk_summary(chunking.chunk_documents(documents(spark, sf)))


@query("route_by_length")
def _(spark, sf):
    return chunking.route(documents(spark, sf)).select("doc_id", "word_count", "use_retrieval")


@query("context_reduction")
def _(spark, sf):
    rows = runs.with_context(documents(spark, sf), threshold=fixed.CHUNK_WORDS)
    counted = rows.select("doc_id", F.col("word_count").alias("words_before"),
                          text.word_count("context").alias("words_after"))
    return counted.withColumn("reduction", chunking.reduction_percent("words_before", "words_after"))


@query("prompts")
def _(spark, sf):
    docs = documents(spark, sf).withColumn("context", F.col("text"))
    return extraction.with_prompts(docs).select("doc_id", "doc_type", F.md5("system_prompt").alias("system_md5"),
                                                "user_prompt")


# --- vectors ---------------------------------------------------------------------------

@query("embed_hashed")
def _(spark, sf):
    def total(weight):
        return F.aggregate(
            F.transform(F.col("embedding"), lambda v, i: v.cast("bigint") * weight(i.cast("bigint") + 1)),
            F.lit(0).cast("bigint"), lambda acc, x: acc + x)

    return chunk_vectors(spark, sf).select(
        "chunk_id", F.size("embedding").cast("bigint").alias("dim"),
        total(lambda i: F.lit(1)).alias("words"), total(lambda i: i).alias("moment_1"),
        total(lambda i: i * i).alias("moment_2"),
        F.round(vectors.norm("embedding"), 6).alias("norm"))


@query("vector_upsert")
def _(spark, sf):
    # documents with a quality label come in again, changed; every fifth comes in empty
    docs = documents(spark, sf).select("k", "filename", "text")
    labelled = fx.read(spark, sf, "labels").select(F.col("doc_id").alias("k")).distinct()
    again = docs.join(labelled, "k", "left_semi").withColumn(
        "text", F.when(F.col("k") % 5 == 0, F.lit(" ")).otherwise(F.concat(F.lit("revised "), "text")))
    first, second = (retrieval.embed(chunking.chunk_documents(d)).withColumn("version", F.lit(v)) for v, d in ((1, docs), (2, again)))
    kept = store.LatestTable(spark, scratch_path(spark, "vectors"), "filename", "version", first.schema)
    kept.append(second, "1")
    kept.append(first, "2")  # arrives late and changes nothing that is newer
    return kept.read().select(
        "chunk_id", "filename", "chunk_index", "total_chunks", "word_count", F.md5("text").alias("text_md5"),
        F.aggregate("embedding", F.lit(0).cast("bigint"), lambda acc, x: acc + x.cast("bigint")).alias("words_in_vector"))


@query("embed_summary")
def _(spark, sf):
    return store.embed_summary(submitted(spark, sf).select(F.concat(F.lit("doc_"), "k").alias("filename"), "text"))


@query("embed_totals")
def _(spark, sf):
    return store.embed_totals(store.embed_summary(submitted(spark, sf).select(F.concat(F.lit("doc_"), "k").alias("filename"), "text")))


def letters_model():
    """An own model: how often each of four letters occurs."""
    return lambda texts: [[t.count(c) for c in "etao"] for t in texts]


@query("embed_model_hook")
def _(spark, sf):
    rows = retrieval.embed(chunking.chunk_documents(documents(spark, sf)), retrieval.model_embedder(letters_model, batch=512))
    return rows.select("chunk_id", *[F.col("embedding")[i].cast("bigint").alias(f"n_{c}") for i, c in enumerate("etao")])


def label_centroids(spark, sf):
    """Mean vector per label; decimal sums do not depend on the order of the tasks."""
    cells = fx.read(spark, sf, "embeddings").select("label", F.posexplode("embedding").alias("pos", "value"))
    means = cells.groupBy("label", "pos").agg(
        (F.sum(F.col("value").cast("decimal(20,10)")).cast("double") / F.count(F.lit(1))).alias("mean"))
    return means.groupBy("label").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("pos", "mean"))), lambda c: c["mean"]).alias("centroid"))


@query("cosine_score")
def _(spark, sf):
    rows = fx.read(spark, sf, "embeddings").join(label_centroids(spark, sf), "label")
    return rows.select("vec_id", "label", F.round(
        vectors.cosine("embedding", "centroid"), 4).alias("score"))


@query("search_topk")
def _(spark, sf):
    chunks = chunk_vectors(spark, sf).select("chunk_id", "embedding")
    asked = retrieval.embed(
        retrieval.query_catalog(spark, "run").withColumn(
            "query_id", F.concat_ws("_", "doc_type", F.col("query_no").cast("string"))), text="query_text")
    return retrieval.search(chunks, asked)


@query("search_topk_vectors")
def _(spark, sf):
    rows = fx.read(spark, sf, "embeddings").select("vec_id", "embedding")
    asked = label_centroids(spark, sf).select(F.col("label").cast("bigint").alias("query_id"),
                                              F.col("centroid").alias("embedding"))
    return retrieval.search(rows, asked, k=5, id_column="vec_id")


@query("search_all_vectors")
def _(spark, sf):
    rows = fx.read(spark, sf, "embeddings").select("vec_id", "embedding")
    return retrieval.search(rows, rows.select(F.col("vec_id").alias("query_id"), "embedding"), k=3, id_column="vec_id")


@query("search_topk_filtered")
def _(spark, sf):
    hits = retrieval.search_within(chunk_vectors(spark, sf), retrieval.query_catalog(spark, "context"),
                                   fixed.CONTEXT_TOP_K, carry=("word_count",))
    return hits.select("filename", "query_no", "rank", "chunk_id", "word_count", "score")


def fanout(spark, sf):
    return in_row.fan_out(documents(spark, sf), "run", fixed.RUN_TOP_K)


@query("retrieve_fanout")
def _(spark, sf):
    return fanout(spark, sf).select("filename", "doc_type", "query_no", "rank", "chunk_index", "score",
                                    F.md5("text").alias("text_md5"))


@query("dedupe_hits")
def _(spark, sf):
    return retrieval.dedupe_hits(fanout(spark, sf), "text").select(
        "filename", "chunk_index", F.md5("text").alias("text_md5"))


@query("relevant_context")
def _(spark, sf):
    return in_row.contexts(documents(spark, sf)).select(
        "filename", F.md5("context").alias("context_md5"), F.length("context").cast("bigint").alias("n_chars"))


# --- model output ----------------------------------------------------------------------

@query("infer_replay")
def _(spark, sf):
    rows = fx.responses(spark, sf)
    # only answers are stored; a document whose call failed has none
    kept = rows.filter("call_error is null").drop("doc_type", "filename", "text", "k")
    return extraction.replay(rows.select("doc_id", "doc_type"), kept).select(
        "doc_id", "doc_type", F.md5(F.coalesce("raw_output", F.lit(""))).alias("output_md5"), "prompt_tokens",
        "completion_tokens", F.coalesce("call_error", F.lit("")).alias("call_error"))


def echo_model():
    """A model whose answer is the digest of its prompt; it refuses every prompt with a fixed digit."""
    def model(prompts):
        digests = [hashlib.md5(user.encode()).hexdigest() for _, user in prompts]
        if any(d.startswith("0") for d in digests):
            raise RuntimeError("refused")
        return [(d, len(user), len(d)) for d, (_, user) in zip(digests, prompts)]

    return model


@query("infer_model_hook")
def _(spark, sf):
    # whole batches; a type without a schema has no prompt
    docs = documents(spark, sf).withColumn("context", F.col("text"))
    path = scratch_path(spark, "prompts")
    extraction.with_prompts(docs).select("doc_id", "system_prompt", "user_prompt").withColumn("prompt_key", F.col("doc_id")).write.parquet(path)
    prompts = spark.read.parquet(path)
    answers = inference.ask(prompts, echo_model, scratch_path(spark, "answers"))
    return prompts.select("doc_id", "prompt_key").join(answers, "prompt_key").select(
        "doc_id", F.coalesce("raw_output", F.lit("")).alias("raw_output"), "prompt_tokens", "completion_tokens",
        F.coalesce("call_error", F.lit("")).alias("call_error"))


@query("clean_output")
def _(spark, sf):
    return fx.responses(spark, sf).select(
        "doc_id", record_json.clean_output("raw_output").alias("cleaned"))


@query("parse_json_strict")
def _(spark, sf):
    parsed = record_json.parse_strict(record_json.clean_output_sql("raw_output"))
    rows = fx.responses(spark, sf).select("doc_id", parsed.alias("j"))
    kind = F.schema_of_variant("j")
    return rows.select(
        "doc_id", F.col("j").isNotNull().alias("valid"),
        F.when(kind.startswith("OBJECT"), "OBJECT").when(kind.startswith("ARRAY"), "ARRAY").when(
            kind == "VOID", "NULL").otherwise(F.coalesce(kind, F.lit(""))).alias("kind"))


def _gate_query(doc_type, shown):
    def run(spark, sf):
        parsed = record_json.parse_strict(record_json.clean_output_sql("raw_output"))
        rows = fx.responses_of(spark, sf, doc_type).select("doc_id", parsed.alias("j"))
        gated = rows.select("doc_id", F.when(
            record_json.is_object("j"), record_json.gate("j", doc_type)).alias("g"))
        errors = F.array_join(F.transform("g.errors", lambda e: F.concat(e["field"], F.lit(":"), e["error"])), ",")
        return gated.select("doc_id", F.col("g.record").isNotNull().alias("accepted"), F.coalesce(errors, F.lit("")).alias("errors"), *[c.alias(n) for n, c in shown(F.col("g.record")).items()])

    return run


query("schema_gate_invoice")(_gate_query("invoice", lambda r: {
    "invoice_number": r["invoice_number"], "sender_company": r["sender_company"], "subtotal": r["subtotal"],
    "total_amount": r["total_amount"], "gst": r["gst"],
    "quantities": F.aggregate(r["line_items"], F.lit(0).cast("bigint"), lambda a, i: a + F.coalesce(i["quantity"], F.lit(0))),
    "unit_prices": F.aggregate(r["line_items"], F.lit(0.0), lambda a, i: a + F.coalesce(i["unit_price"], F.lit(0.0))),
    "amounts": F.aggregate(r["line_items"], F.lit(0.0), lambda a, i: a + i["amount"]),
}))
query("schema_gate_resume")(_gate_query("resume", lambda r: {
    "name": r["name"], "phone": r["phone"], "n_technical": F.size(r["technical_skills"]).cast("bigint"),
    "n_soft": F.size(r["soft_skills"]).cast("bigint"),
    "schools": F.array_join(F.transform(r["education"], lambda e: e["institution"]), "|"),
    "n_work": F.size(r["work_experience"]).cast("bigint"), "summary": r["summary"],
}))
query("schema_gate_email")(_gate_query("email", lambda r: {
    "sender_name": r["sender_name"], "subject": r["subject"], "date": r["date"], "body": r["body"],
    "points": F.array_join(r["key_points"], "|"), "n_actions": F.size(r["action_items"]).cast("bigint"),
}))


@query("extraction_outcome")
def _(spark, sf):
    return extraction.with_outcome(fx.responses(spark, sf)).select("doc_id", "doc_type", "outcome", "token_usage.*")


# --- rules and scores --------------------------------------------------------------------

def _report_columns(report):
    return [F.col(f"{report}.passed").alias("passed"), F.col(f"{report}.total_checks").alias("total_checks"),
            F.col(f"{report}.passed_checks").alias("passed_checks"),
            F.col(f"{report}.failed_checks").alias("failed_checks")]


def _validation_query(doc_type):
    def run(spark, sf):
        rows = fx.records(spark, sf, doc_type).select("doc_id", rules.validate("record", doc_type).alias("v"))
        return rows.select("doc_id", *_report_columns("v"), list_text(F.col("v.checks"), "check").alias("checks"),
                           list_text(F.col("v.checks"), "passed").alias("verdicts"))

    return run


for _type in fx.FLAT:
    query(f"validate_{_type}")(_validation_query(_type))


def _validated(spark, sf):
    rows = fx.all_records(spark, sf)
    # a type without rules is routed as well
    kind = F.when(F.length("doc_id") % 7 == 0, F.lit("memo")).otherwise(F.col("doc_type"))
    return rows.withColumn("doc_type", kind).select(
        "doc_id", "doc_type", rules.validate_any("doc_type", {t: t for t in fx.FLAT}).alias("v"))


@query("validation_report")
def _(spark, sf):
    return _validated(spark, sf).groupBy("doc_type").agg(
        F.count(F.lit(1)).alias("documents"), F.count_if("v.passed").alias("passed"),
        F.sum("v.total_checks").alias("total_checks"), F.sum("v.passed_checks").alias("passed_checks"),
        F.sum("v.failed_checks").alias("failed_checks"))


@query("validate_all")
def _(spark, sf):
    return _validated(spark, sf).select("doc_id", "doc_type", *_report_columns("v"))


@query("validation_messages")
def _(spark, sf):
    return _validated(spark, sf).select("doc_id", F.posexplode_outer("v.checks").alias("_n", "_c")).select(
        "doc_id", F.col("_n").cast("bigint").alias("check_no"), F.col("_c.check").alias("check_name"),
        F.col("_c.message").alias("message"))


@query("failed_checks")
def _(spark, sf):
    return reports.failed_checks(results(spark, sf))


def _scores_query(doc_type):
    def run(spark, sf):
        rows = fx.records(spark, sf, doc_type).select("doc_id", scoring.score("record", doc_type).alias("s"))
        return rows.select("doc_id", F.col("s.avg_confidence").alias("avg_confidence"),
                           F.col("s.needs_human_review").alias("needs_human_review"),
                           pairs_text("s.field_scores").alias("scores"), pairs_text("s.flagged_fields").alias("flagged"))

    return run


for _type in fx.FLAT:
    query(f"confidence_{_type}")(_scores_query(_type))


def _scored(spark, sf):
    rows = fx.all_records(spark, sf)
    kind = F.when(F.length("doc_id") % 7 == 0, F.lit("memo")).otherwise(F.col("doc_type"))
    return rows.withColumn("doc_type", kind).select(
        "doc_id", "doc_type", scoring.score_any("doc_type", {t: t for t in fx.FLAT}).alias("s"))


@query("field_scores")
def _(spark, sf):
    return _scored(spark, sf).select("doc_id", F.explode_outer("s.field_scores").alias("field", "_v")).filter(
        "field is not null").select("doc_id", "field", F.col("_v").cast("bigint").alias("score"))


@query("confidence_report")
def _(spark, sf):
    return _scored(spark, sf).groupBy("doc_type").agg(
        F.count(F.lit(1)).alias("documents"), F.count_if("s.needs_human_review").alias("needs_review"),
        F.sum(F.round(F.col("s.avg_confidence") * 10).cast("bigint")).alias("tenths"),
        F.sum(F.size("s.flagged_fields")).alias("flagged"))


@query("confidence_all")
def _(spark, sf):
    return _scored(spark, sf).select(
        "doc_id", "doc_type", F.col("s.avg_confidence").alias("avg_confidence"),
        F.col("s.needs_human_review").alias("needs_human_review"),
        F.size("s.field_scores").cast("bigint").alias("n_fields"), pairs_text("s.flagged_fields").alias("flagged"))


@query("field_score_rows")
def _(spark, sf):
    return reports.field_score_rows(results(spark, sf))


@query("review_queue")
def _(spark, sf):
    return reports.review_queue(results(spark, sf))


# --- cost --------------------------------------------------------------------------------

@query("cost_active")
def _(spark, sf):
    return fx.responses(spark, sf).select("doc_id", costs.cost(
        "prompt_tokens", "completion_tokens", "openai_gpt4o_mini").alias("cost_usd"))


@query("cost_for_provider")
def _(spark, sf):
    names = F.array(*[F.lit(n) for n in ("groq", "google_flash", "mistral_large", "custom", "nobody")])
    rows = fx.responses(spark, sf).select(
        "doc_id", "prompt_tokens", "completion_tokens",
        F.get(names, (F.col("k") % 5).cast("int")).alias("provider"))
    return costs.cost_by_provider_column(rows, "provider").select("doc_id", "provider", "cost_usd")


@query("cost_compare")
def _(spark, sf):
    return reports.cost_compare(results(spark, sf))


@query("cost_projection")
def _(spark, sf):
    return reports.cost_projection(results(spark, sf))


@query("cost_flat_estimate")
def _(spark, sf):
    return reports.cost_flat_estimate(results(spark, sf))


# --- runs and reports ----------------------------------------------------------------------

def flagship(spark: SparkSession, sf: str) -> DataFrame:
    submissions = fx.responses(spark, sf)
    run_id, at, provider = fx.RUNS[0]
    rows = runs.run(submissions.select("doc_id", "doc_type", "filename", "text"), run_id, at,
                    responses=submissions, provider=provider)
    return rows.select(
        "doc_id", "doc_type", "status", F.coalesce("error", F.lit("")).alias("error"), "use_retrieval",
        "context_words", F.col("validation.passed").alias("validation_passed"),
        F.col("validation.passed_checks").alias("passed_checks"),
        F.col("confidence.avg_confidence").alias("avg_confidence"),
        F.coalesce(pairs_text("confidence.flagged_fields"), F.lit("")).alias("flagged"),
        F.col("token_usage.total_tokens").alias("total_tokens"), "cost_usd")


query("extraction_run")(flagship)


@query("batch_summary")
def _(spark, sf):
    return reports.batch_summary(results(spark, sf))


@query("report_summary")
def _(spark, sf):
    return reports.report_summary(results(spark, sf))


@query("per_document")
def _(spark, sf):
    return reports.per_document(results(spark, sf))


@query("results_list")
def _(spark, sf):
    return reports.results_list(results(spark, sf))


@query("result_lookup")
def _(spark, sf):
    return reports.result_lookup(all_runs(spark, sf), "inv_11").select(
        "run_id", "doc_id", "provider", "status", pairs_text("confidence.field_scores").alias("scores"),
        list_text(F.col("validation.checks"), "message").alias("messages"), "cost_usd")


@query("recommendations")
def _(spark, sf):
    return reports.recommendations(results(spark, sf))


# --- sinks and streams -----------------------------------------------------------------------

@query("sink_json")
def _(spark, sf):
    path = scratch_path(spark, "json")
    files.write_json(results(spark, sf), path)
    # the lines as written, without a schema laid over them
    lines = spark.read.text(path)
    return lines.select(
        F.get_json_object("value", "$.doc_id").alias("doc_id"),
        F.get_json_object("value", "$.status").alias("status"),
        F.col("value").contains('"validation":null').alias("null_kept"))


@query("batch_csv")
def _(spark, sf):
    path = scratch_path(spark, "csv")
    files.write_csv(results(spark, sf), path)
    schema = ", ".join(f"{c} string" for c in fixed.BATCH_CSV_COLUMNS)
    return spark.read.schema(schema).option("header", True).option("emptyValue", "").csv(path).withColumn(
        "flagged_fields", F.coalesce("flagged_fields", F.lit("")))


@query("run_history")
def _(spark, sf):
    return all_runs(spark, sf).groupBy("run_id", "provider").agg(
        F.count(F.lit(1)).alias("documents"), F.count_if(F.col("status") == "success").alias("successful"),
        (F.sum(F.round(F.col("cost_usd") * 1e6).cast("bigint")) / F.lit(1e6)).alias("total_cost"))


@query("report_lines")
def _(spark, sf):
    return reports.report_lines(results(spark, sf)).select(
        F.col("section").cast("bigint").alias("section"), "filename",
        F.col("line_no").cast("bigint").alias("line_no"), "line")


@query("stream_ingest")
def _(spark, sf):
    # submissions of all types, some of them again, some without a version or an id, and stale versions that arrive last
    source = scratch_path(spark, "submissions")
    current = fx.responses(spark, sf).select("k", "doc_id", "doc_type", "filename", "text", F.when(F.col("k") % 13 != 5, 2).alias("version"))
    stale = current.filter("k % 7 = 0 and version is not null").withColumns({"text": F.lit("stale"), "version": F.lit(1)})
    nameless = current.filter("k % 17 = 3").withColumns({"doc_id": F.lit(None).cast("string"), "text": F.lit("submitted without an id")})
    for rows in (current, current.filter("k % 5 = 0").unionByName(nameless), stale):
        rows.write.mode("append").option("compression", "zstd").parquet(source)
    stream = spark.readStream.schema(current.schema).option("maxFilesPerTrigger", 32).parquet(source)
    answers = extraction.KeyedAnswers(spark, scratch_path(spark, "answers")).write(fx.responses(spark, sf))
    run_id, at, provider = fx.RUNS[0]

    def transform(batch: DataFrame) -> DataFrame:
        return runs.run(batch.select("doc_id", "doc_type", "filename", "text", "version"), run_id, at, responses=answers,
                        provider=provider, carry=("version",))

    kept = store.LatestTable(spark, scratch_path(spark, "ingest"), "doc_id", "version", transform(current.limit(0)).schema)
    ingest(stream, transform, kept, scratch_path(spark, "checkpoint")).awaitTermination()
    return kept.read().select(
        "doc_id", "status", "use_retrieval", "context_words", F.col("validation.passed").alias("validation_passed"),
        F.col("confidence.avg_confidence").alias("avg_confidence"),
        F.col("token_usage.total_tokens").alias("total_tokens"), "cost_usd")
