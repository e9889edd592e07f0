"""Removal of repeated passages by suffix arrays over shards, sorted in external memory.

A byte goes if it lies in a string of ``MATCH`` bytes that also starts anywhere else. Each
such string contains a k-mer of least hash, which depends on the string alone; the runs of
starts that share it are the fragments of a text. Equal strings lie in fragments with the
same k-mer, so the k-mer's hash deals out the work, and fragments whose k-mer occurs once
hold nothing that repeats. Equal fragments are put together first: what all copies share
is settled by a count. Of those that differ, one copy each goes to a shard, whose suffix
array with common prefixes (``induced_sort``) tells which starts repeat.

Defined results: a null text counts as empty and keeps nothing; matches never cross texts;
equal texts get equal results, and wholly repeated texts of ``MATCH`` bytes or more keep
nothing; texts below that length stay; an empty table gives an empty result. Columns named
like a result, whatever the case of their letters, are replaced, others pass through.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordmill.llm import induced_sort
from recordmill.llm.common import add_in_arrow, dropped, spares, written

MATCH, KMER = 200, 32
#: Bytes of fragments in a shard, on average.
SHARD_BYTES = 4 << 20
#: Starts looked at together; longer texts go in pieces.
WINDOWS = 1 << 16

_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _ODD[3]
    return x ^ (x >> np.uint64(29))


class Fragments:
    """Fragments of byte strings: ``(start, starts, key, content)`` arrays."""

    def __init__(self, match: int = MATCH, kmer: int = KMER):
        self.match, self.kmer = match, kmer
        size = WINDOWS + match
        self.powers, self.inverse = [], []
        for r in _ODD[:2]:
            self.powers.append(np.cumprod(np.append(np.uint64(1), np.full(size, r))))
            self.inverse.append(np.cumprod(np.append(np.uint64(1), np.full(size, np.uint64(pow(int(r), -1, 1 << 64))))))

    def __call__(self, data: bytes):
        parts = [self._part(np.frombuffer(data, np.uint8, min(WINDOWS + self.match - 1, len(data) - a), a), a)
                 for a in range(0, max(len(data) - self.match + 1, 0), WINDOWS)]
        return [np.concatenate(p) for p in zip(*parts)] if parts else [np.zeros(0, np.int64)] * 4

    def _part(self, text: np.ndarray, base: int):
        value = text.astype(np.uint64) + np.uint64(1)
        h, width = value * _ODD[0], 1
        while width < self.kmer:
            h = _mixed(h[:-width] * _ODD[1] + h[width:])
            width *= 2
        low = (h & ~np.uint64(0xFFFFFF)) | np.arange(len(h), dtype=np.uint64)
        reach, width = self.match - self.kmer + 1, 1
        while 2 * width <= reach:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        low = np.minimum(low[: len(text) - self.match + 1], low[reach - width :])
        anchor = (low & np.uint64(0xFFFFFF)).astype(np.int64)
        start = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))
        many = np.diff(np.append(start, len(anchor)))
        end = start + many + self.match - 1
        content = many.astype(np.uint64)
        for powers, inverse in zip(self.powers, self.inverse):
            sums = np.append(np.uint64(0), np.cumsum(value * powers[: len(value)]))
            content = _mixed(content * _ODD[2] + (sums[end] - sums[start]) * inverse[start])
        return start + base, many, h[anchor[start]].view(np.int64), content.view(np.int64)


def fragments(df: DataFrame, match: int = MATCH) -> DataFrame:
    """One row per fragment of ``_t``, under the text's two hashes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = Fragments(match)
        for batch in batches:
            found = [cut(t.encode()) for t in batch.column("_t").to_pylist()]
            many = [len(f[0]) for f in found]
            columns = [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0, np.int64)] * 4
            rows = pa.array(np.repeat(np.arange(len(found)), many))
            yield pa.RecordBatch.from_arrays(
                [batch.column("_a").take(rows), batch.column("_b").take(rows), pa.array(columns[0].astype(np.int32)), pa.array(columns[1].astype(np.int32)),
                 pa.array(columns[2]), pa.array(columns[3])], names=["_a", "_b", "at", "n", "key", "content"])

    return df.select("_a", "_b", "_t").mapInArrow(run, "_a bigint, _b int, at int, n int, key bigint, content bigint")


#: NUL separates the fragments of a shard; UTF-8 has no byte 255, which stands for a NUL of the text.
_NUL = bytes.maketrans(b"\x00\xff", b"\xff\x00")


def repeated_in_shards(pieces: DataFrame, match: int = MATCH, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Spans that repeat in the distinct fragments ``(key, piece, many)`` of the texts ``_a, _b`` at ``at``: ``(_a, _b, s)``.

    Fragments marked ``many`` repeat as a whole: they take part in the order, but their own spans are not given.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with tempfile.TemporaryDirectory(prefix="shard-") as folder:
            first, second, starts, marks, ends = [], [], [], [], [np.zeros(1, np.int64)]
            path = Path(folder) / "text"
            with path.open("wb") as file:
                for batch in batches:
                    own = batch.column("piece").to_pylist()
                    for column, parts in (("_a", first), ("_b", second), ("at", starts)):
                        parts.append(np.asarray(batch.column(column)))
                    marks.append(batch.column("many").to_numpy(zero_copy_only=False))
                    ends.append(np.cumsum([len(p) + 1 for p in own]) + ends[-1][-1])
                    file.write(b"".join(p.translate(_NUL) + b"\x00" for p in own))
            if not marks:
                return
            text_a, text_b, at, bounds = (np.concatenate(parts) for parts in (first, second, starts, ends))
            text = np.asarray(np.memmap(path, np.uint8, "r")) if bounds[-1] > induced_sort.IN_MEMORY else np.fromfile(path, np.uint8)
            again = induced_sort.repeated_starts(text, match)
            for a in range(1, len(bounds), 4096):  # what would reach over the end of a fragment
                again[(bounds[a : a + 4096, None] - np.arange(1, match + 1)).ravel()] = False
        low = np.flatnonzero(again & ~np.append(False, again[:-1]))
        high = np.flatnonzero(again & ~np.append(again[1:], False))
        owner = np.searchsorted(bounds, low, "right") - 1
        own = ~np.concatenate(marks).astype(bool)[owner]
        low, high, owner = low[own], high[own], owner[own]
        for a in range(0, len(low), 1 << 16):
            o = owner[a : a + (1 << 16)]
            inside = at[o] - bounds[o]
            spans = [pa.array((x + inside).astype(np.int32)) for x in (low[a : a + (1 << 16)], high[a : a + (1 << 16)] + match)]
            yield pa.RecordBatch.from_arrays([pa.array(text_a[o]), pa.array(text_b[o]), pa.StructArray.from_arrays(spans, ["start", "end"])], names=["_a", "_b", "s"])

    total = pieces.select(F.sum(F.length("piece"))).first()[0] or 0
    shards = max(12, -(-total // shard_bytes))
    return pieces.repartition(shards, "key").mapInArrow(run, "_a bigint, _b int, s struct<start: int, end: int>")


def repeats(df: DataFrame, match: int = MATCH, paths: list[str] | None = None) -> DataFrame:
    """Byte ranges to remove of every text that has any: ``(_a, _b, _spans)`` by the text's two hashes.

    ``df`` has ``_t``, ``_a`` and ``_b`` and is read twice. ``paths`` gets the folders of the tables that the result reads.
    """
    passing: list[str] = []
    found = written(fragments(df, match), "fragments", passing)
    keys = found.groupBy("key").agg(F.count("*").alias("c"), F.min("content").alias("x"), F.max("content").alias("y"))
    # stored, as a join can split the rows of a hot key only if no aggregate shares its exchange
    keys = written(keys.filter("c > 1").select("key", (F.col("x") != F.col("y")).alias("mixed")), "keys", passing)
    found = written(found.join(keys, "key"), "candidates", paths)
    dropped(df.sparkSession, passing)
    mixed = found.filter("mixed")
    distinct = written(mixed.groupBy("key", "content").agg(F.count("*").alias("c"), F.min(F.struct("_a", "_b", "at", "n")).alias("r")), "distinct", paths)
    wanted = distinct.groupBy("r._a", "r._b").agg(F.collect_list(F.struct("r.at", "r.n", "key", "content", (F.col("c") > 1).alias("many"))).alias("wanted"))  # bounded by a text's length
    place = F.struct("_a", "_b", F.col("w.at").alias("at")).alias("place")
    pieces = df.join(wanted, ["_a", "_b"]).select(F.encode("_t", "utf-8").alias("_t"), "_a", "_b", F.explode("wanted").alias("w")).select(
        "w.key", "w.content", "w.many", place, F.expr(f"substring(_t, w.at + 1, w.n + {match - 1})").alias("piece"))
    # copies of a text give the same pieces again
    pieces = pieces.groupBy("key", "content").agg(F.min("piece").alias("piece"), F.max("many").alias("many"), F.min("place").alias("place"))
    pieces = written(pieces.select("key", "place.*", "many", "piece"), "pieces", paths)
    # a fragment that occurs once is known by its place; of the others every start repeats, and each occurrence meets one row at most
    inner = repeated_in_shards(pieces, match)
    whole = distinct.filter("c > 1").select("key", "content", F.lit(True).alias("whole"))
    span = F.expr(f"struct(at as start, at + n + {match - 1} as end)")
    spans = mixed.join(whole, ["key", "content"], "left").select("_a", "_b", F.when(F.col("whole"), span).alias("s"))
    spans = spans.union(inner).union(found.filter("not mixed").select("_a", "_b", span.alias("s")))
    return spans.groupBy("_a", "_b").agg(F.collect_set("s").alias("_spans"))  # bounded by a text's length


@spares("_t", "_a", "_b", "_spans")
def remove(df: DataFrame, text: str = "text", match: int = MATCH, decoded: str | None = None) -> DataFrame:
    """Adds ``kept``, the bytes that remain, and ``removed``, the maximal byte ranges that went.

    ``decoded`` names a column for the remaining text without characters that a cut has split.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    keyed = df.drop("kept", "removed").withColumn("_t", whole).withColumns({"_a": F.xxhash64("_t"), "_b": F.hash("_t")})
    # stored, so that the tables behind the ranges are gone before the texts are exchanged
    paths: list[str] = []
    spans = written(repeats(keyed.select("_t", "_a", "_b"), match, paths), "ranges")
    dropped(df.sparkSession, paths)

    def run(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        kept, removed = [], []
        for data, own in zip(batch.column("_t").to_pylist(), batch.column("_spans").to_pylist()):
            data = data.encode()
            merged: list[dict] = []
            for a, b in sorted((s["start"], s["end"]) for s in own or ()):
                if merged and a <= merged[-1]["end"]:
                    merged[-1]["end"] = max(b, merged[-1]["end"])
                else:
                    merged.append({"start": a, "end": b})
            at, parts = 0, []
            for s in merged:
                parts.append(data[at : s["start"]])
                at = s["end"]
            kept.append(b"".join([*parts, data[at:]]))
            removed.append(merged)
        out = {"kept": pa.array(kept, pa.binary()), "removed": pa.array(removed, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))}
        return out | ({decoded: pa.array([k.decode("utf-8", "ignore") for k in kept], pa.string())} if decoded else {})

    # a text is exchanged once, and only then handed on under both names
    joined = keyed.drop("_t").join(spans, ["_a", "_b"], "left").drop("_a", "_b").withColumn("_t", whole)
    schema = "kept binary, removed array<struct<start: int, end: int>>" + (f", `{decoded}` string" if decoded else "")
    return add_in_arrow(joined, schema, run).drop("_t", "_spans")
