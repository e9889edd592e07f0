"""Model calls that survive lost executors: prompts on file, asked in small waves, answers on file."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordmill.operators.extraction import Model, infer

#: Prompts of a file. A task asks one file or a few, so this is about what is asked again when an executor is lost.
FILE_PROMPTS = 256
#: Drains in a row without any answer after which prompts that were not called stay failed until the next run.
FRUITLESS = 3

_PROMPT = "prompt_key string, system_prompt string, user_prompt string"
_ANSWER = "raw_output string, prompt_tokens bigint, completion_tokens bigint, call_error string, called boolean"


class PromptQueue:
    """Prompts under ``path`` and the answers to them.

    Prompts are files of at most ``file_prompts`` rows. A stream reads them with ``availableNow`` a few files at a
    time; each micro-batch is a wave, whose answers are a partition of their own and count once the wave is committed. The
    checkpoint knows which files have been asked: a lost executor repeats the files of its task, a run that died
    the files of one wave, and none of what was answered before.
    """

    def __init__(self, spark: SparkSession, path: str, batch: int = 64, file_prompts: int = FILE_PROMPTS, wave_files: int | None = None):
        self.spark, self.path, self.batch, self.file_prompts = spark, path.rstrip("/"), batch, file_prompts
        self.wave_files = wave_files or 2 * spark.sparkContext.defaultParallelism
        for name, schema in (("prompts", _PROMPT), ("answers/wave=-", f"prompt_key string, {_ANSWER}")):
            # an empty table, so that there is something to read from the start
            spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{self.path}/{name}")

    def add(self, prompts: DataFrame) -> None:
        """Append ``prompt_key, system_prompt, user_prompt`` to what is to be asked."""
        rows = prompts.select("prompt_key", "system_prompt", "user_prompt")
        rows.write.mode("append").option("maxRecordsPerFile", self.file_prompts).parquet(f"{self.path}/prompts")

    def drain(self, make_model: Callable[[], Model]) -> None:
        """Ask everything that is on file and has not been asked, wave by wave."""

        def wave(prompts: DataFrame, number: int) -> None:
            answers = infer(prompts.withColumnRenamed("prompt_key", "doc_id"), make_model, self.batch).withColumnRenamed("doc_id", "prompt_key")
            answers.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(f"{self.path}/answers/wave={number:012d}")

        stream = self.spark.readStream.schema(_PROMPT).option("maxFilesPerTrigger", self.wave_files).parquet(f"{self.path}/prompts")
        stream.writeStream.foreachBatch(wave).option("checkpointLocation", f"{self.path}/checkpoint").trigger(availableNow=True).start().awaitTermination()

    def answers(self) -> DataFrame:
        """All answers with the wave they came in."""
        return self.spark.read.schema(f"prompt_key string, {_ANSWER}, wave string").parquet(f"{self.path}/answers")

    def last_wave(self) -> str:
        return self.answers().agg(F.max("wave")).first()[0] or "-"

    def best(self) -> DataFrame:
        """One answer for each prompt: a good one if there is any."""
        fields = ["raw_output", "prompt_tokens", "completion_tokens", "call_error"]
        ranked = F.struct(F.col("call_error").isNull().alias("good"), *fields)
        return self.answers().groupBy("prompt_key").agg(F.max(ranked).alias("_a")).select("prompt_key", *[F.col(f"_a.{f}") for f in fields])


def ask(prompts: DataFrame, make_model: Callable[[], Model], path: str, batch: int = 64, file_prompts: int = FILE_PROMPTS,
        wave_files: int | None = None) -> DataFrame:
    """Answers to ``prompts`` (``prompt_key, system_prompt, user_prompt``), one row per key: a :class:`PromptQueue` under ``path``.

    First what an earlier run left open is asked, then every key without a good answer, once however often it is
    there. Prompts of a batch that was given up are put on file again, until ``FRUITLESS`` drains in a row
    bring no answer. ``prompts`` is read twice, so it should be a written table.
    """
    queue = PromptQueue(prompts.sparkSession, path, batch, file_prompts, wave_files)
    queue.drain(make_model)
    before = queue.last_wave()
    known = queue.answers().filter("call_error is null").select("prompt_key").distinct()
    waiting = prompts.dropDuplicates(["prompt_key"])
    queue.add(waiting.join(known, "prompt_key", "left_anti"))
    fruitless = 0
    while True:
        mark = queue.last_wave()
        queue.drain(make_model)
        own = queue.answers().filter(F.col("wave") > before)
        left = own.groupBy("prompt_key").agg(F.bool_or("called").alias("_called")).filter("not _called").select("prompt_key")
        if left.isEmpty():
            return queue.best()
        fruitless = 0 if own.filter((F.col("wave") > mark) & F.col("call_error").isNull()).take(1) else fruitless + 1
        if fruitless == FRUITLESS:
            return queue.best()
        queue.add(waiting.join(left, "prompt_key", "left_semi"))
