"""Replace-by-key tables: new rows take the place of all rows with the same key."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordmill.fixed import CHUNK_OVERLAP, CHUNK_WORDS
from recordmill.functions.text import quote, word_count
from recordmill.operators.chunking import chunk_total_sql


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def replace_by_key(old: DataFrame, new: DataFrame, key: str = "filename") -> DataFrame:
    """``old`` without the keys of ``new``, plus ``new``. A key absent from ``new`` keeps its rows."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


class LatestTable:
    """A table that grows by batches; of each key the rows of the newest version count.

    A batch is a partition of its own, so writing touches nothing else and a batch that is
    repeated replaces itself. The version of a row is its ``order``, then its batch, so
    an older submission that arrives late changes nothing; a row without an order is older than any other.
    Rows without a key stand for themselves and all count.

    The files of every batch are bucketed and sorted by the key (``buckets`` is fixed when a table is made). New rows go
    to the buckets from where they were made, without an exchange, so a task writes a file for each bucket that it has rows of; versions
    are compared, and keys looked up, where the rows are. ``compact`` writes what counts to a new table now and then, a file for each bucket. The table is known to the session's catalogue under a name made of its path; a
    new session declares it again over the same files.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, order: str, schema: T.StructType, buckets: int = 16):
        if not {key, order} <= set(schema.names):
            raise ValueError("key and order must be columns of the table")
        self.spark, self.path, self.key, self.order, self.schema, self.buckets = spark, path.rstrip("/"), key, order, schema, buckets
        self.name = f"recordmill_{hashlib.md5(self.path.encode()).hexdigest()}"
        columns = ", ".join(f"{quoted(f.name)} {f.dataType.simpleString()}" for f in schema.fields)
        if spark.catalog.tableExists(self.name):
            return
        spark.sql(f"CREATE TABLE {self.name} ({columns}, batch string) USING parquet OPTIONS (compression 'zstd') PARTITIONED BY (batch)"
                  f" CLUSTERED BY ({quoted(key)}) SORTED BY ({quoted(key)}) INTO {buckets} BUCKETS LOCATION {quote(self.path)}")
        # files of an earlier session; the folder has to be there to be searched
        files, folder = self._folder()
        files.mkdirs(folder)
        spark.sql(f"MSCK REPAIR TABLE {self.name}")

    def append(self, rows: DataFrame, batch: str) -> None:
        """Write one batch; one that is there already is replaced. Batch names are compared as text."""
        if not re.fullmatch(r"[\w.-]+", batch):
            raise ValueError("a batch is named by letters, digits, points, hyphens and underscores")
        new = rows.select(*map(quoted, self.schema.names), F.lit(batch).alias("batch"))
        # overwriting by partitions replaces nothing if there are no new rows, so a batch that comes again empty is taken away
        again = not self.spark.sql(f"SHOW PARTITIONS {self.name} PARTITION (batch = {quote(batch)})").isEmpty()
        if again and new.isEmpty():
            self.spark.sql(f"ALTER TABLE {self.name} DROP PARTITION (batch = {quote(batch)})")
            files, folder = self._folder(f"/batch={batch}")
            files.delete(folder, True)
            return
        new.write.mode("overwrite").insertInto(self.name)

    def _folder(self, below: str = "") -> tuple:
        """The file system of the table, and a path in it."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(self.path + below)
        return folder.getFileSystem(self.spark._jsc.hadoopConfiguration()), folder

    def history(self) -> DataFrame:
        return self.spark.table(self.name)

    def read(self) -> DataFrame:
        return self._newest(self.history())

    def lookup(self, keys: list) -> DataFrame:
        """What counts of a few keys; only the buckets that these hash to are read."""
        return self._newest(self.history().filter(F.col(quoted(self.key)).isin(keys)))

    def _newest(self, rows: DataFrame) -> DataFrame:
        key = F.col(quoted(self.key))
        version = F.struct(F.col(quoted(self.order)).alias("order"), "batch")
        newest = rows.filter(key.isNotNull()).groupBy(key.alias("_key")).agg(F.max(version).alias("_newest"))
        # the greatest version is the only one not below it; an equality would ask for rows dealt out by version as well
        kept = rows.join(newest, (key == F.col("_key")) & (version >= F.col("_newest")), "left_semi")
        return kept.unionByName(rows.filter(key.isNull())).select(*map(quoted, self.schema.names))

    def compact(self, path: str) -> LatestTable:
        """A table at ``path`` with the rows that count as its first batch."""
        other = LatestTable(self.spark, path, self.key, self.order, self.schema, self.buckets)
        other.append(self.read().repartition(self.buckets, quoted(self.key)), "0")
        return other


def embed_summary(docs: DataFrame, size: int = CHUNK_WORDS, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """Chunk count and status per document, within its row; no chunks means ``failed``."""
    n = F.expr(f"cast({chunk_total_sql('_words', size, overlap)} as bigint)")
    return docs.withColumn("_words", F.coalesce(word_count("text"), F.lit(0))).select(
        "filename", n.alias("chunks_count"), F.when(n > 0, F.lit("success")).otherwise(F.lit("failed")).alias("status"))


def embed_totals(summary: DataFrame) -> DataFrame:
    return summary.agg(
        F.count_if(F.col("status") == "success").alias("successful"),
        F.coalesce(F.sum("chunks_count"), F.lit(0)).cast("bigint").alias("total_chunks"),
    )
