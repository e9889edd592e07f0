"""Text folders, result files and the run-partitioned results table."""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from recordmill.fixed import BATCH_CSV_COLUMNS
from recordmill.functions.text import py_bool, py_float
from recordmill.operators.intake import canonical_type, decode, valid_utf8
from recordmill.schemas import FOLDER_TYPES
from recordmill.session import small_table

RESULT_SCHEMA = """
    doc_id string, filename string, doc_type string, ts timestamp, model string, provider string,
    status string, error string, extraction string,
    validation struct<passed: boolean, total_checks: bigint, passed_checks: bigint, failed_checks: bigint,
                      checks: array<struct<check: string, passed: boolean, message: string>>>,
    confidence struct<avg_confidence: double, needs_human_review: boolean,
                      flagged_fields: map<string, int>, field_scores: map<string, int>>,
    token_usage struct<prompt_tokens: bigint, completion_tokens: bigint, total_tokens: bigint>,
    cost_usd double, use_retrieval boolean, context_words bigint, run_id string
"""

#: File names listed, and bytes of files read, before they are handed on.
_LISTED, _READ_BYTES = 10_000, 4 << 20
# text files are packed, quickly; readers unpack them by their names
_PACKED = {"compression": "gzip", "zlib.compress.level": "BEST_SPEED"}


def read_text_folder(spark: SparkSession, root: str) -> DataFrame:
    """One row per ``*.txt`` file in the known type folders of ``root``.

    ``text`` is null and ``readable`` false where the bytes are not UTF-8. Line ends
    are unified. A folder may also be named ``column=invoices``. Files come in no
    particular order; sort by ``doc_type, filename`` where order is shown.

    On a folder of the local file system, mounted alike on every machine, tasks list and read the files: Spark's reader
    holds the status of every file on the driver. New files are seen by every run, new folders are not.
    """
    files = _text_files(spark, root)
    parts = F.split("path", "/")
    folder = F.regexp_extract(F.element_at(parts, -2), r"([^=]+)$", 1)
    return files.filter(folder.isin(*FOLDER_TYPES)).select(
        canonical_type(folder).alias("doc_type"),
        F.url_decode(F.element_at(parts, -1)).alias("filename"),
        F.col("path").alias("filepath"),
        valid_utf8(F.col("content")).alias("readable"),
        F.regexp_replace(decode(F.col("content")), "\r\n?", "\n").alias("text"),
    )


def _hidden(name: str) -> bool:
    """Whether Spark's readers pass over a file or folder of this name."""
    return name.startswith(".") or name.startswith("_") and "=" not in name or name.endswith("._COPYING_")


def _local(spark: SparkSession, path: str) -> str | None:
    """``path`` without its scheme if it is in the local file system."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    uri = target.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(target).toUri()
    return uri.getPath() if uri.getScheme() == "file" else None


def _text_files(spark: SparkSession, root: str) -> DataFrame:
    """``path, content`` of every ``*.txt`` file under ``root``, without empty ones, as Spark's reader gives them."""
    local = None if re.search(r"[*?{}\[\]\\]", root) else _local(spark, root)
    if local is None or not os.path.isdir(local):
        return spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").option(
            "recursiveFileLookup", "true").load(root).select("path", "content")
    folders = [local]
    for folder in folders:  # grows meanwhile; files are passed over and not kept
        with os.scandir(folder) as entries:
            folders.extend(e.path for e in entries if not _hidden(e.name) and e.is_dir())

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder in batch.column("folder").to_pylist():
                with os.scandir(folder) as entries:
                    found = (e.path for e in entries if e.name.endswith(".txt") and not _hidden(e.name) and e.is_file())
                    while some := list(islice(found, _LISTED)):
                        yield pa.RecordBatch.from_arrays([pa.array(some, pa.string())], names=["file"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        paths, contents, size = [], [], 0
        for batch in batches:
            for file in batch.column("file").to_pylist():
                with open(file, "rb") as opened:
                    content = opened.read()
                if content:
                    paths.append(f"file:{file}")
                    contents.append(content)
                    size += len(content)
                if size >= _READ_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(contents, pa.binary())], names=["path", "content"])
                    paths, contents, size = [], [], 0
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(contents, pa.binary())], names=["path", "content"])

    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    files = small_table(spark, ["folder"], [(f,) for f in folders]).mapInArrow(listed, "file string")
    # dealt out by number: the names are few bytes, the files are not
    return files.repartition(tasks, "file").mapInArrow(read, "path string, content binary")


def write_text_folder(docs: DataFrame, path: str) -> None:
    """One ``.txt`` file per row of ``doc_type, text`` under its plural folder; earlier files stay.

    On a folder of the local file system, mounted alike on every machine, tasks write their files themselves: there Hadoop's client
    starts a process for the permissions of every file and its checksum, and the driver moves the files one by one in the end.
    """
    folder = F.lit(None).cast("string")
    for name, doc_type in FOLDER_TYPES.items():
        folder = F.when(F.col("doc_type") == doc_type, F.lit(name)).otherwise(folder)
    rows = docs.select(folder.alias("folder"), "text").filter("folder is not null")
    spark = docs.sparkSession
    root, write = _local(spark, path), uuid.uuid4().hex
    if root is None:
        rows.write.partitionBy("folder").option("maxRecordsPerFile", 1).mode("append").text(path)
        return
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(target)

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get(), 0
        for folder in FOLDER_TYPES:
            os.makedirs(f"{root}/folder={folder}", exist_ok=True)
        for batch in batches:
            for folder, text in zip(batch.column("folder").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()):
                # a repeated task writes the same names, and nobody sees half a file
                name = f"part-{task.partitionId():05d}-{write}-{number:08d}.txt"
                hidden = f"{root}/folder={folder}/.{name}.{task.taskAttemptId()}"
                with open(hidden, "wb") as out:
                    out.write((text or b"") + b"\n")
                os.replace(hidden, f"{root}/folder={folder}/{name}")
                number += 1
        yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64())], names=["files"])

    rows.mapInArrow(save, "files bigint").write.format("noop").mode("overwrite").save()


def write_run(results: DataFrame, path: str) -> None:
    """Add a run to the results table. Earlier runs stay; repeating a run replaces only itself."""
    seen = Observation()
    results.observe(seen, F.collect_set("run_id").alias("ids")).write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic").option(
        "compression", "zstd").partitionBy("run_id").parquet(path)
    # one row per run written, so that nobody has to look through the runs for their names
    ids = F.array(*map(F.lit, seen.get["ids"])).cast("array<string>")
    results.sparkSession.range(1).select(F.explode(ids).alias("run_id")).write.mode("append").parquet(_names(path))


def _names(path: str) -> str:
    return f"{path.rstrip('/')}_names"


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    # the schema is given, so no file is opened to infer it and run ids stay text
    return spark.read.schema(RESULT_SCHEMA).parquet(path)


def latest_run(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the greatest ``run_id``; only its partition of the table is listed and read."""
    newest = spark.read.schema("run_id string").parquet(_names(path)).agg(F.max("run_id")).first()[0]
    return read_runs(spark, path).filter(F.col("run_id") == F.lit(newest))


def write_json(results: DataFrame, path: str) -> None:
    """Result documents as JSON lines by run, nulls written out, in files packed by gzip: names and messages repeat in every line."""
    results.write.mode("overwrite").option("ignoreNullFields", "false").options(**_PACKED).partitionBy("run_id").json(path)


def read_json(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Result documents from JSON lines, plain or packed by gzip, or from one document per file with ``multi_line``."""
    return spark.read.schema(RESULT_SCHEMA).option("multiLine", multi_line).option(
        "pathGlobFilter", "*.json{,.gz}").json(path)


def batch_csv(results: DataFrame) -> DataFrame:
    """The batch CSV as text columns: absent reports print ``N/A``, booleans ``True``/``False``."""
    def shown(column):
        return F.coalesce(column, F.lit("N/A"))

    flagged = F.array_join(F.map_keys("confidence.flagged_fields"), ", ")
    values = {
        "validation_passed": shown(py_bool("validation.passed")),
        "checks_passed": shown(F.col("validation.passed_checks").cast("string")),
        "total_checks": shown(F.col("validation.total_checks").cast("string")),
        "avg_confidence": shown(py_float("confidence.avg_confidence")),
        "needs_human_review": shown(py_bool("confidence.needs_human_review")),
        "flagged_fields": F.coalesce(flagged, F.lit("")),
        "prompt_tokens": F.coalesce("token_usage.prompt_tokens", F.lit(0)).cast("string"),
        "completion_tokens": F.coalesce("token_usage.completion_tokens", F.lit(0)).cast("string"),
        "total_tokens": F.coalesce("token_usage.total_tokens", F.lit(0)).cast("string"),
        "cost_usd": py_float("coalesce(cost_usd, 0D)"),
        "timestamp": F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"),
    }
    return results.select(*[values.get(c, F.col(c)).alias(c) for c in BATCH_CSV_COLUMNS])


def write_csv(results: DataFrame, path: str) -> None:
    batch_csv(results).write.mode("overwrite").option("header", True).options(**_PACKED).csv(path)
