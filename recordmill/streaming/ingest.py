"""Continuous document ingest into a keyed results store."""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from recordmill.operators.store import LatestTable
from recordmill.session import scratch_path

#: Groups that the versions of keys are kept in; fixed for the life of a checkpoint.
BUCKETS = 256
#: Keys in a slot of a group's state on average, at most, and slots of a group held in memory.
SLOT_KEYS, HELD_SLOTS = 256, 4096
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def last_per_key(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The row with the greatest ``order`` for each key, combined before the exchange.

    A null order comes before all others. Ties go to the greatest row by its plain columns, so results
    do not depend on the order of tasks. Rows without a key stand for themselves and all stay.
    """
    plain = [f.name for f in rows.schema.fields if f.dataType.simpleString() not in ("variant",) and not f.dataType.simpleString().startswith(("map", "struct", "array"))]
    keyed = rows.filter(F.col(key).isNotNull())
    packed = keyed.groupBy(key).agg(F.max_by(F.struct(*rows.columns), F.struct(order, *plain)).alias("_row"))
    return packed.select("_row.*").unionByName(rows.filter(F.col(key).isNull()))


class _Newest(StatefulProcessor):
    """Lets a submission pass unless a newer one of its key has passed; the state holds versions only.

    A call to the state costs more than a row, so the keys of a group are dealt out to slots of ``SLOT_KEYS`` or fewer on average, and a slot
    is read and written as a whole. Slots are split as keys become more, so what a micro-batch costs depends on its own rows.
    """

    def __init__(self, key: str, order: str):
        self.key, self.order = key, order

    def init(self, handle) -> None:
        self.size = handle.getValueState("size", "bits int, keys bigint")
        self.slots = handle.getMapState("slots", "slot int", "versions binary")

    @staticmethod
    def slot(key, bits: int) -> int:
        # the same in every process, unlike Python's own hash of a text
        return zlib.crc32(repr(key).encode("utf-8", "surrogatepass")) & ((1 << bits) - 1)

    def _load(self, slot: int) -> dict:
        stored = self.slots.getValue((slot,))
        return {} if stored is None else pickle.loads(bytes(stored[0]))

    def _store(self, slot: int, versions: dict) -> None:
        self.slots.updateValue((slot,), (pickle.dumps(versions),))

    def handleInputRows(self, bucket, rows: Iterator[Row], timers) -> Iterator[Row]:
        bits, keys = self.size.get() if self.size.exists() else (0, 0)
        had = keys
        held: dict[int, dict] = {}
        changed: set[int] = set()
        for row in rows:
            key, version = row[self.key], row[self.order]
            if key is None:
                yield row
                continue
            slot = self.slot(key, bits)
            if slot not in held:
                if len(held) >= HELD_SLOTS:
                    for other in changed:
                        self._store(other, held[other])
                    held.clear()
                    changed.clear()
                # nothing has passed through a new group, so there is nothing to look up
                held[slot] = self._load(slot) if had else {}
            versions = held[slot]
            newest = versions.get(key)
            if newest is None or (version is not None and version >= newest):
                keys += key not in versions
                versions[key] = version
                changed.add(slot)
                yield row
        if not changed and keys == had:
            return
        more = bits
        while keys > SLOT_KEYS << more:
            more += 1
        for slot in changed if more == bits else range(1 << bits):
            versions = held.pop(slot) if slot in held else self._load(slot)
            if more > bits:
                parts: dict[int, dict] = {slot: {}}
                for key, version in versions.items():
                    parts.setdefault(self.slot(key, more), {})[key] = version
                for part, own in parts.items():
                    self._store(part, own)
            else:
                self._store(slot, versions)
        if (more, keys) != (bits, had):
            self.size.update((more, keys))

    def close(self) -> None:
        pass


def newest_only(stream: DataFrame, key: str, order: str, buckets: int = BUCKETS) -> DataFrame:
    """The submissions of a stream that are not older than what came before them.

    The newest version of each key is kept in Spark's state store (a map of slots in each of ``buckets`` groups), so an old
    submission that arrives late is dropped before anything is computed for it. Texts are not kept. A null version is older
    than any other; rows without a key are dealt out by their content and pass.
    """
    stream.sparkSession.conf.set(_PROVIDER, _ROCKSDB)
    dealt = F.when(F.col(key).isNotNull(), F.xxhash64(key)).otherwise(F.xxhash64(*stream.columns))
    grouped = stream.withColumn("_bucket", F.pmod(dealt, F.lit(buckets)).cast("int")).groupBy("_bucket")
    return grouped.transformWithState(
        statefulProcessor=_Newest(key, order), outputStructType=stream.schema, outputMode="Update", timeMode="None")


def ingest(
    stream: DataFrame, transform: Callable[[DataFrame], DataFrame], store: LatestTable, checkpoint: str,
    available_now: bool = True, buckets: int = BUCKETS,
) -> StreamingQuery:
    """Run ``transform`` on every micro-batch and append its rows to the store.

    The stream has the store's key and order, and ``transform`` carries both to its results. Submissions older than
    one that came before are dropped first (:func:`newest_only`); of several of one key in a batch the last is
    transformed. Rows without a key stand for themselves: each is transformed and kept. What is left of a batch is written
    once, so ``transform`` may read it as often as it likes, and deleted when its results are stored. A batch repeated after a failure replaces its own rows.
    """
    spark: SparkSession = stream.sparkSession

    def one_batch(batch: DataFrame, number: int) -> None:
        path = scratch_path(spark, "microbatch")
        last_per_key(batch, store.key, store.order).write.option("compression", "zstd").parquet(path)
        results = transform(spark.read.schema(batch.schema).parquet(path))
        missing = {store.key, store.order} - set(results.columns)
        if missing:
            raise ValueError(f"transform has to carry {sorted(missing)}")
        store.append(results, f"{number:012d}")
        # the batch is in the store; a stream must not leave a copy of all that went through it
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)

    fresh = newest_only(stream, store.key, store.order, buckets)
    writer = fresh.writeStream.outputMode("update").foreachBatch(one_batch).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
