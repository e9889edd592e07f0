"""Prompts, the model hook and the outcome of each model call."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recordmill import fixed
from recordmill.functions.record_json import clean_output, gate, parse_strict
from recordmill.schemas import DOC_TYPES, RECORDS, type_label

# takes the prompts of one batch, returns (output, prompt tokens, completion tokens) for each
Model = Callable[[list[tuple[str, str]]], list[tuple[str, int, int]]]


#: Single calls that fail in a row before the rest of a failed batch is given up, as in an outage.
GIVE_UP = 3
#: Error of a row without a prompt.
NO_PROMPT = "no prompt"


def schema_text(doc_type: str) -> str:
    return json.dumps({f.name: type_label(f) for f in RECORDS[doc_type]}, indent=2)


def user_prompt(doc_type: Column, context: Column) -> Column:
    schema = F.lit(None).cast("string")
    for name in DOC_TYPES:
        schema = F.when(doc_type == name, F.lit(schema_text(name))).otherwise(schema)
    return F.concat(
        F.lit(fixed.USER_PROMPT_HEAD), schema, F.lit(fixed.USER_PROMPT_DOCUMENT), context,
        F.lit(fixed.USER_PROMPT_TAIL),
    )


def with_prompts(docs: DataFrame) -> DataFrame:
    """Add ``system_prompt`` and ``user_prompt`` to rows with ``doc_type`` and ``context``."""
    return docs.withColumns({
        "system_prompt": F.lit(fixed.SYSTEM_PROMPT),
        "user_prompt": user_prompt(F.col("doc_type"), F.col("context")),
    })


def infer(prompts: DataFrame, make_model: Callable[[], Model], batch: int = 64,
          carry: tuple[str, ...] = ()) -> DataFrame:
    """Call a model on every prompt: ``doc_id`` to output, tokens, ``call_error`` and ``called``.

    ``make_model`` runs once per task, so each task owns one client. A failing batch is
    tried again row by row, so one bad prompt costs its own row only; after ``GIVE_UP`` rows
    that fail one after the other, the rest of the batch fails without a call; ``called`` is
    false for these, so that they can be asked later. A null prompt, as for a type without a schema, is
    no call and fails with ``NO_PROMPT``. Columns in
    ``carry`` pass through, which saves joining the answers back to their documents.
    """
    kept = ["doc_id", *carry]
    answer = ["raw_output", "prompt_tokens", "completion_tokens", "call_error", "called"]
    types = dict(prompts.dtypes)
    schema = ", ".join(f"{c} {types[c]}" for c in kept) + (
        ", raw_output string, prompt_tokens bigint, completion_tokens bigint, call_error string, called boolean")

    def call(model: Model, texts: list[tuple[str, str]]) -> list[tuple]:
        try:
            answers = model(texts)
            if len(answers) != len(texts):
                raise ValueError("the model must answer every prompt of a batch")
            return [(*out, None, True) for out in answers]
        except Exception as failure:
            failed = (None, 0, 0, str(failure) or type(failure).__name__, True)
            if len(texts) == 1:
                return [failed]
            rows: list[tuple] = []
            for text in texts:
                out = len(rows) >= GIVE_UP and all(r[3] is not None for r in rows[-GIVE_UP:])
                rows += [(*failed[:-1], False)] if out else call(model, [text])
            return rows

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = None
        for frame in frames:
            model = model or make_model()
            for start in range(0, len(frame), batch):
                part = frame.iloc[start:start + batch].reset_index(drop=True)
                asked = part["user_prompt"].notna()
                answers = iter(call(model, list(zip(part["system_prompt"][asked], part["user_prompt"][asked]))) if asked.any() else ())
                rows = [next(answers) if a else (None, 0, 0, NO_PROMPT, True) for a in asked]
                yield pd.concat([part[kept], pd.DataFrame(rows, columns=answer)], axis=1)

    return prompts.select(*kept, "system_prompt", "user_prompt").mapInPandas(run, schema)


def replay(docs: DataFrame, responses: DataFrame | KeyedAnswers, order: str | None = None) -> DataFrame:
    """Stored model responses instead of calls; a document without one is a failed call.

    Of several answers to one id the one with the greatest ``order`` counts, without an
    order the greatest answer. Of answers laid out by key
    only those to the ids of ``docs`` are read.
    """
    if isinstance(responses, KeyedAnswers):
        last = responses.of(docs)
    else:
        last = _newest_answers(responses, order)
    found = last.withColumn("_found", F.lit(True))
    return docs.join(found, "doc_id", "left").withColumns({
        "call_error": F.when(F.col("_found").isNull(), F.lit("no response")).otherwise(F.col("call_error")),
        "prompt_tokens": F.coalesce("prompt_tokens", F.lit(0)).cast("bigint"),
        "completion_tokens": F.coalesce("completion_tokens", F.lit(0)).cast("bigint"),
    }).drop("_found")


class KeyedAnswers:
    """Stored answers laid out by key: a table in ``parts`` folders by the hash of the id, one answer per id, sorted.

    A reader that asks for the ids of a small batch lists the folders those ids hash to and reads no others, so what
    a micro-batch costs depends on its own size. ``parts`` is chosen so that a folder holds some ten thousand answers.
    """

    ANSWER = ("raw_output string", "prompt_tokens bigint", "completion_tokens bigint", "call_error string")

    def __init__(self, spark: SparkSession, path: str, parts: int = 64, key_type: str = "string"):
        self.spark, self.path, self.parts = spark, path.rstrip("/"), parts
        self.schema = f"doc_id {key_type}, {', '.join(self.ANSWER)}, part int"

    def _part(self) -> Column:
        return part_of(self.parts)

    def write(self, responses: DataFrame, order: str | None = None) -> KeyedAnswers:
        """Store ``responses``, the newest of each id by ``order``; ids are not null."""
        newest = _newest_answers(responses, order, self.parts)
        newest.sortWithinPartitions("part", "doc_id").write.mode("overwrite").options(
            partitionOverwriteMode="static", compression="zstd").partitionBy("part").parquet(self.path)
        return self

    def of(self, docs: DataFrame) -> DataFrame:
        """The answers to the ids of ``docs``: of the folders they hash to, and only rows that are asked for.

        ``docs`` is read twice, so it should be a written table. At most ``parts`` numbers come to the driver.
        """
        asked = docs.select("doc_id").filter("doc_id is not null").distinct()
        parts = [r[0] for r in asked.select(self._part().alias("part")).distinct().collect()]
        stored = self.spark.read.schema(self.schema).parquet(self.path).filter(F.col("part").isin(parts) if parts else F.lit(False))
        return stored.drop("part").join(asked, "doc_id", "left_semi")


def part_of(parts: int) -> Column:
    """The folder of an id, of ``parts`` folders."""
    return F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int")


def _newest_answers(responses: DataFrame, order: str | None, parts: int | None = None) -> DataFrame:
    """``doc_id`` and the answer with the greatest ``order`` (without an order the greatest answer); answers to no id are left out.

    Answers are texts, which are compared in sorted order. So they are dealt out by id first and sorted once, in parts of an
    exchange's size, instead of in the parts the input happens to have, where they would be sorted and spilled again.
    """
    answer = F.struct("raw_output", "prompt_tokens", "completion_tokens", "call_error")
    last = F.max(answer) if order is None else F.max_by(answer, F.struct(F.col(order), answer))
    known = responses.filter("doc_id is not null")
    if parts is None:
        return known.repartition("doc_id").groupBy("doc_id").agg(last.alias("_last")).select("doc_id", "_last.*")
    dealt = known.withColumn("part", part_of(parts)).repartition(parts, "part")
    return dealt.groupBy("part", "doc_id").agg(last.alias("_last")).select("doc_id", "_last.*", "part")


def with_outcome(responses: DataFrame) -> DataFrame:
    """Parse and gate ``raw_output`` by ``doc_type``.

    Adds ``outcome`` (ok, json_error, schema_error, call_error), one struct column per
    record type (set for ok rows of that type), ``schema_errors`` and ``token_usage``.
    A failed call, a failed gate and JSON that is no object count no tokens.
    """
    parsed = responses.withColumn("_cleaned", clean_output("raw_output")).withColumn("_json", parse_strict("_cleaned"))
    # the text is one valid value by now, so its first character tells its kind
    parsed = parsed.withColumn("_object", F.col("_json").isNotNull() & F.col("_cleaned").startswith("{"))
    json_null = F.col("_cleaned") == "null"
    gated = parsed.withColumns({
        f"_{t}": F.when((F.col("doc_type") == t) & F.col("_object"), gate("_json", t)) for t in DOC_TYPES
    })
    errors = F.coalesce(*[F.col(f"_{t}.errors") for t in DOC_TYPES])
    any_record = F.coalesce(*[F.col(f"_{t}.record").isNotNull() for t in DOC_TYPES], F.lit(False))
    for t in DOC_TYPES[1:]:
        any_record = any_record | F.coalesce(F.col(f"_{t}.record").isNotNull(), F.lit(False))
    outcome = (
        F.when(F.col("call_error").isNotNull(), F.lit("call_error"))
        .when(F.col("_json").isNull() | json_null, F.lit("json_error"))
        .when(~F.col("_object"), F.lit("call_error"))
        .when(any_record, F.lit("ok"))
        .otherwise(F.lit("schema_error"))
    )
    judged = gated.withColumns({"outcome": outcome, "schema_errors": errors})
    counted = F.col("outcome").isin("ok", "json_error")
    prompt = F.when(counted, F.col("prompt_tokens")).otherwise(F.lit(0)).cast("bigint")
    completion = F.when(counted, F.col("completion_tokens")).otherwise(F.lit(0)).cast("bigint")
    kept = [c for c in responses.columns if c not in ("raw_output", "prompt_tokens", "completion_tokens")]
    return judged.select(
        *kept, "outcome", "schema_errors",
        *[F.when(F.col("outcome") == "ok", F.col(f"_{t}.record")).alias(t) for t in DOC_TYPES],
        F.struct(
            prompt.alias("prompt_tokens"), completion.alias("completion_tokens"),
            (prompt + completion).alias("total_tokens"),
        ).alias("token_usage"),
    )


def extraction_json() -> Column:
    """The record of the row as JSON text, nulls kept."""
    return F.coalesce(*[F.to_json(F.col(t), {"ignoreNullFields": "false"}) for t in DOC_TYPES])
