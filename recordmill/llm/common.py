"""What the corpus operators share: session options, written tables, worker state."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordmill.session import configure, scratch_path

#: Bytes and rows of text handed to a Python worker at a time, so that batches of long texts stay small.
ARROW_BYTES, ARROW_ROWS = 8 << 20, 4096
#: What separates words: space and the control characters from tab to carriage return.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"


def prepared(spark: SparkSession) -> SparkSession:
    """Runtime options of the library, and small Arrow batches."""
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepared(spark).read.parquet(f"{sf_dir}/{name}.parquet")


#: Shuffle files of an execution go with its end instead of with the driver's next garbage collection.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, name: str, paths: list[str] | None = None) -> DataFrame:
    """``df`` as a table in the shared folder: lineage ends here and nothing is computed twice.

    The schema is given on reading, so an empty table can be read too. Nothing executes the
    write again, so what it exchanged is deleted at once. ``paths`` gets the table's folder, for ``dropped``.
    """
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    if paths is not None:
        paths.append(path)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, paths: list[str]) -> None:
    """Deletes written tables that nothing reads any more."""
    for path in paths:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def spares(*names: str, at: int = 0) -> Callable:
    """Columns of the table at argument ``at`` that are named like an operator's own step aside and come back in its result.

    Names are compared whatever the case of their letters, as Spark does. Without such columns nothing is done.
    """
    own = {n.lower() for n in names}

    def around(operator: Callable) -> Callable:
        @wraps(operator)
        def run(*args, **options):
            args = list(args)
            taken = {c.lower() for c in args[at].columns} | own
            aside: dict[str, str] = {}
            for column in args[at].columns:
                if column.lower() in own:
                    name = column + "_"
                    while name.lower() in taken:
                        name += "_"
                    taken.add(name.lower())
                    aside[column] = name
            if not aside:
                return operator(*args, **options)
            args[at] = args[at].withColumnsRenamed(aside)
            # an argument may name such a column
            args = [aside.get(a, a) if isinstance(a, str) else a for a in args]
            options = {k: aside.get(a, a) if isinstance(a, str) else a for k, a in options.items()}
            return operator(*args, **options).withColumnsRenamed({new: old for old, new in aside.items()})

        return run

    return around


def smallest_hashes(df: DataFrame, most: int, *columns: str) -> DataFrame:
    """The ``most`` rows with the smallest hashes of ``columns``: a sample that does not depend on the order of rows.

    Rows that can hardly be among them are left out first, so that few enough meet in the end.
    """
    share = min(1.0, (2 * most + 1000) / max(df.count(), 1))
    hashed = df.withColumn("_hash", F.xxhash64(*columns))
    near = hashed.filter(F.col("_hash") <= F.lit(min(int(-(2**63) + share * 2**64), 2**63 - 1)))
    return near.orderBy("_hash", *columns).limit(most).drop("_hash")


def worker_state(key: str, make: Callable[[], object]) -> object:
    """An object that a Python worker keeps between its tasks, made once per ``key``."""
    kept = sys.modules.setdefault("_recordmill_worker", types.ModuleType("_recordmill_worker")).__dict__
    if key not in kept:
        kept[key] = make()
    return kept[key]


def forget_state() -> None:
    """Frees what a reused worker has kept for other operators."""
    sys.modules.pop("_recordmill_worker", None)


def with_columns(batch: pa.RecordBatch, columns: dict[str, pa.Array]) -> pa.RecordBatch:
    """A batch with columns set or replaced by name."""
    names, arrays = list(batch.schema.names), list(batch.columns)
    for name, array in columns.items():
        if name in names:
            arrays[names.index(name)] = array
        else:
            names.append(name)
            arrays.append(array)
    return pa.RecordBatch.from_arrays(arrays, names=names)


def add_in_arrow(df: DataFrame, schema: str, make: Callable[[pa.RecordBatch], dict[str, pa.Array]], stateful: bool = False) -> DataFrame:
    """Columns computed from Arrow batches; every other column of ``df`` goes through unchanged.

    ``schema`` lists the new columns; one that ``df`` has already, whatever the case of its letters, is replaced. Unless ``stateful``, the
    worker first frees the state it has kept for other operators.
    """
    from pyspark.sql.types import StructType

    new = StructType.fromDDL(schema)
    gone = {n.lower() for n in new.names}
    kept = [f for f in df.schema.fields if f.name.lower() not in gone]
    target = StructType([*kept, *new.fields])
    names = target.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not stateful:
            forget_state()
        for batch in batches:
            out = with_columns(batch, make(batch))
            yield out.select(names)

    return df.mapInArrow(run, target)


def int_list(values, offsets) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int32()))
