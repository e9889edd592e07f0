"""A run: documents in, one result row per document out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordmill import fixed
from recordmill.functions.costs import cost
from recordmill.functions.rules import validate_any
from recordmill.functions.scoring import score_any
from recordmill.functions.text import word_count
from recordmill.operators.chunking import chunk_documents, route
from recordmill.operators.extraction import KeyedAnswers, extraction_json, replay, with_outcome, with_prompts
from recordmill.operators.in_row import TextModel, contexts
from recordmill.operators.intake import REASON_TEXT, reject_reason
from recordmill.operators.retrieval import Embedder, context_of, embed, relevant_context
from recordmill.schemas import DOC_TYPES
from recordmill.session import named_path, scratch_path
from recordmill.streaming.inference import ask



def with_context(docs: DataFrame, threshold: int = fixed.LONG_DOCUMENT_WORDS, override: bool | None = None,
                 embedder: Embedder | None = None, make_text_model: Callable[[], TextModel] | None = None) -> DataFrame:
    """Add ``word_count``, ``use_retrieval`` and ``context``: the whole text, or for long
    documents the chunks their type's queries find. ``docs`` needs ``doc_id, doc_type, text``. An own model is
    either ``make_text_model``, a function of texts made once per task, which ranks in the row; or ``embedder``, a function of a
    column, for which chunks become rows.
    """
    routed = route(docs, threshold, override).withColumn("use_retrieval", F.coalesce("use_retrieval", F.lit(False)))
    if make_text_model is not None:
        # short texts are not cut or embedded
        cut = routed.withColumn("_long", F.when(F.col("use_retrieval"), F.col("text")))
        found = contexts(cut, "run", fixed.RUN_TOP_K, "text", fixed.RUN_SEPARATOR, make_text_model, text="_long")
        return found.withColumn("context", F.when(F.col("use_retrieval"), F.col("context")).otherwise(F.col("text"))).drop("_long")
    if embedder is None:
        found = context_of("text", "doc_type")
        return routed.withColumn("context", F.when(F.col("use_retrieval"), found).otherwise(F.col("text")))
    # two documents may share an id, so a document is known by all it is made of
    routed = routed.withColumn("_key", F.sha2(F.concat_ws("\n", "doc_id", "doc_type", "text"), 256))
    long = routed.filter("use_retrieval").select(F.col("_key").alias("filename"), "doc_type", "text").dropDuplicates(["filename"])
    vectors = embed(chunk_documents(long, keep=("doc_type",)), embedder)
    picked = relevant_context(
        vectors, "run", fixed.RUN_TOP_K, "text", fixed.RUN_SEPARATOR, embedder
    ).withColumnRenamed("filename", "_key")
    # only ids and short contexts of the long documents are exchanged, short texts stay in place
    short = routed.filter("not use_retrieval").withColumn("context", F.col("text"))
    joined = routed.filter("use_retrieval").join(picked, "_key", "left").withColumn(
        "context", F.coalesce("context", F.lit(""))
    )
    return short.unionByName(joined).drop("_key")


def run(
    docs: DataFrame, run_id: str, timestamp: str, *, responses: DataFrame | KeyedAnswers | None = None,
    make_model: Callable | None = None, provider: str = fixed.DEFAULT_PROVIDER,
    threshold: int = fixed.LONG_DOCUMENT_WORDS, embedder: Embedder | None = None, answers: str | None = None,
    batch: int = 64, carry: tuple[str, ...] = (), make_text_model: Callable[[], TextModel] | None = None,
) -> DataFrame:
    """Result rows for ``docs`` (``doc_id, doc_type, filename, text``, optionally ``content``).

    Outputs come from stored ``responses`` (a table, or answers laid out by key) or from ``make_model``. Rejected
    and failed documents stay as rows with an error. ``timestamp`` is a parameter, so a repeated
    run gives the same rows. Rejected documents are not cut, searched or sent to a model. Prompts are written once and
    asked by :func:`recordmill.streaming.inference.ask`, ``batch`` in a call: answers are kept under ``answers``, by
    default a folder named by the run, and a run that starts again asks only for documents without a good answer. The
    columns in ``carry`` pass through to the results.
    """
    if (responses is None) == (make_model is None):
        raise ValueError("give either responses or make_model")
    content = F.col("content") if "content" in docs.columns else None
    taken = docs.withColumn(
        "_reason", reject_reason(F.col("filename"), "text", F.col("doc_type"), content)
    ).withColumn("text", F.when(F.col("_reason").isNull(), F.col("text")))
    ready = with_context(taken, threshold, None, embedder, make_text_model).withColumn(
        "context_words", F.when(F.col("use_retrieval"), word_count("context")).otherwise(F.coalesce("word_count", F.lit(0)))
    )
    kept = ["doc_id", "doc_type", "filename", "_reason", "use_retrieval", "context_words", *carry]
    if responses is not None:
        answered = replay(ready.select(*kept), responses)
    else:
        # contexts are computed once: everything that follows reads this table
        spark, path = docs.sparkSession, scratch_path(docs.sparkSession, "prompts")
        prompts = with_prompts(ready).withColumn("user_prompt", F.when(F.col("_reason").isNull(), F.col("user_prompt"))).withColumn(
            "prompt_key", F.when(F.col("_reason").isNull(), F.sha2(F.concat_ws("\n", "doc_id", "user_prompt"), 256))
        ).select(*kept, "prompt_key", "system_prompt", "user_prompt")
        prompts.write.parquet(path)
        prompts = spark.read.schema(prompts.schema).parquet(path)
        # calls are dear: answers are stored before anything reads them, and kept for a run that starts again
        found = ask(prompts.filter("_reason is null").select("prompt_key", "system_prompt", "user_prompt"), make_model,
                    answers or named_path(spark, f"answers/{run_id}"), batch)
        # a document submitted twice asks once; its rows share the answer. What was rejected has no key and no answer
        answered = prompts.select(*kept, "prompt_key").join(found, "prompt_key", "left").drop("prompt_key").withColumns({
            "call_error": F.when(F.col("_reason").isNotNull(), F.lit("rejected")).otherwise(F.col("call_error")),
            "prompt_tokens": F.coalesce("prompt_tokens", F.lit(0)).cast("bigint"),
            "completion_tokens": F.coalesce("completion_tokens", F.lit(0)).cast("bigint")})
    return envelope(with_outcome(answered), run_id, timestamp, provider, carry)


def envelope(judged: DataFrame, run_id: str, timestamp: str, provider: str = fixed.DEFAULT_PROVIDER,
             carry: tuple[str, ...] = ()) -> DataFrame:
    """Validate, score and price gated rows and lay them out as results."""
    ok = (F.col("outcome") == "ok") & F.col("_reason").isNull()
    records = {t: t for t in DOC_TYPES}
    tokens = F.when(F.col("_reason").isNull(), F.col("token_usage")).otherwise(F.struct(
        *[F.lit(0).cast("bigint").alias(n) for n in ("prompt_tokens", "completion_tokens", "total_tokens")]
    ))
    reason = F.lit(None).cast("string")
    for name, text in REASON_TEXT.items():
        reason = F.when(F.col("_reason") == name, F.lit(text)).otherwise(reason)
    model = {p[0]: p[2] for p in fixed.PROVIDERS}.get(provider, provider)
    return judged.withColumn("token_usage", tokens).select(
        # a document submitted without a file is listed under its id
        "doc_id", F.coalesce("filename", "doc_id").alias("filename"), "doc_type", F.to_timestamp(F.lit(timestamp)).alias("ts"),
        F.lit(model).alias("model"), F.lit(provider).alias("provider"),
        F.when(ok, F.lit("success")).otherwise(F.lit("failed")).alias("status"),
        F.when(F.col("_reason").isNotNull(), reason).when(~ok, F.lit(fixed.EXTRACTION_FAILED)).alias("error"),
        F.when(ok, extraction_json()).alias("extraction"),
        F.when(ok, validate_any("doc_type", records)).alias("validation"),
        F.when(ok, score_any("doc_type", records)).alias("confidence"),
        "token_usage",
        cost("token_usage.prompt_tokens", "token_usage.completion_tokens", provider).alias("cost_usd"),
        "use_retrieval", "context_words", F.lit(run_id).alias("run_id"), *carry,
    )


def reprice(results: DataFrame, run_id: str, timestamp: str, provider: str) -> DataFrame:
    """The same extractions as a new run at another provider's prices."""
    model = {p[0]: p[2] for p in fixed.PROVIDERS}.get(provider, provider)
    return results.withColumns({
        "run_id": F.lit(run_id), "ts": F.to_timestamp(F.lit(timestamp)), "provider": F.lit(provider),
        "model": F.lit(model),
        "cost_usd": cost("token_usage.prompt_tokens", "token_usage.completion_tokens", provider),
    })
