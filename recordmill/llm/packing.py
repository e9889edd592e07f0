"""Best-fit packing of token pieces into sequences by exact-complement hashing.

The plan is made on the number of pieces of each length, a table of at most ``capacity``
rows whatever the corpus: it says how often each combination of lengths is packed. Pieces
are numbered where they are cut, by task and length; how many pieces of a length the tasks
before hold is a small table, so no piece moves to be numbered.

Defined results: null text counts as empty, an empty text is one piece holding the end
token; equal rows are packed separately; an empty table gives an empty result. Columns
of the input named like a result column, whatever the case of their letters, are replaced,
others pass through.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from recordmill.llm.bpe import Vocabulary
from recordmill.llm.common import int_list, spares, with_columns, written
from recordmill.llm.fields import without
from recordmill.session import small_table

CAPACITY, END = 1024, 2
#: Texts encoded at a time.
ROWS = 1024
#: Bytes of the numbers of earlier tasks that are broadcast at most.
BROADCAST = 32 << 20
#: Columns that number the pieces: the task that cut a piece, and how many of its length that task cut before.
TASK, NTH = "_task", "_nth"


class Numbers:
    """Numbers the pieces of each length within a task."""

    def __init__(self) -> None:
        self.task, self.seen = TaskContext.get().partitionId(), np.zeros(1, np.int64)

    def __call__(self, lengths: np.ndarray) -> dict[str, pa.Array]:
        if len(lengths):
            self.seen = np.append(self.seen, np.zeros(max(0, int(lengths.max()) + 1 - len(self.seen)), np.int64))
        order = np.argsort(lengths, kind="stable")
        ordered = lengths[order]
        nth = np.empty(len(lengths), np.int64)
        nth[order] = self.seen[ordered] + np.arange(len(ordered)) - np.searchsorted(ordered, ordered)
        self.seen += np.bincount(lengths, minlength=len(self.seen))
        return {TASK: pa.array(np.full(len(lengths), self.task, np.int64)), NTH: pa.array(nth)}


def numbered(parts: DataFrame, length: str = "length") -> DataFrame:
    """A table of pieces from elsewhere with the two columns that ``pack`` needs."""
    target = StructType([*without(parts, TASK, NTH).schema.fields, *StructType.fromDDL(f"{TASK} bigint, {NTH} bigint").fields])
    names = target.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = Numbers()
        for batch in batches:
            yield with_columns(batch, numbers(np.asarray(batch.column(length), np.int64))).select(names)

    return without(parts, TASK, NTH).mapInArrow(run, target)


def pieces(df: DataFrame, vocabulary: Vocabulary, text: str = "text", capacity: int = CAPACITY, end: int = END, keep: tuple[str, ...] = ("doc_id",), payload: str = "ids") -> DataFrame:
    """One row per piece: the columns ``keep``, ``piece``, ``start``, ``length`` and the payload.

    The payload is ``ids`` (array of int) for training files or ``ids_crc32``, the checksum
    of the ids as unsigned little-endian 32-bit numbers, which saves storing the ids. All
    pieces but the first have exactly ``capacity`` tokens; the first has what is over.
    """
    own = StructType.fromDDL(f"piece int, start bigint, length bigint, {'ids array<int>' if payload == 'ids' else 'ids_crc32 bigint'}, {TASK} bigint, {NTH} bigint").fields
    gone = {"ids", "ids_crc32", *(f.name for f in own)}
    kept = [c for c in keep if c.lower() not in gone]
    target = StructType([*(df.schema[c] for c in kept), *own])
    names = target.names
    tail = np.array([end], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, numbers = vocabulary.encoder(), Numbers()
        for batch in (part.slice(a, ROWS) for part in batches for a in range(0, part.num_rows, ROWS)):
            coded = [c + tail for c in encoder([t or "" for t in batch.column(text).to_pylist()])]
            tokens = np.array([len(c) // 4 for c in coded], np.int64)
            many = -(-tokens // capacity)
            first = tokens - (many - 1) * capacity
            row = np.repeat(np.arange(len(coded)), many)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
            length = np.where(piece == 0, first[row], capacity)
            start = np.where(piece == 0, 0, first[row] + (piece - 1) * capacity)
            # the pieces follow one another in the joined ids
            joined, ends = b"".join(coded), np.append(0, np.cumsum(length))
            if payload == "ids":
                load = int_list(np.frombuffer(joined, "<i4"), ends)
            else:
                whole = memoryview(joined)
                load = pa.array([zlib.crc32(whole[4 * a : 4 * b]) for a, b in pairwise(ends.tolist())], pa.int64())
            taken = [batch.column(c).take(pa.array(row)) for c in kept]
            made = [pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), load]
            yield pa.RecordBatch.from_arrays([*taken, *made, *numbers(length).values()], names=names)

    return df.select(*dict.fromkeys([*kept, text])).mapInArrow(cut, target)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Combinations of lengths and how many sequences each fills, all pieces used up.

    From the longest piece down, the gap beside it is filled exactly where that is possible:
    by one piece, by a pair or by a triple whose lengths sum to the gap, longest parts first,
    as often as there are pieces. What has no exact complement is packed by best fit: the
    longest piece that fits into the gap, again and again, with the exact complement taken
    as soon as there is one.
    """
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        if not 0 < length <= capacity:
            raise ValueError(f"a piece of {length} does not fit a sequence of {capacity}")
        left[length] += n
    made: list[tuple[tuple[int, ...], int]] = []

    def take(parts: tuple[int, ...]) -> None:
        """Packs a combination as often as its pieces last."""
        need: dict[int, int] = defaultdict(int)
        for p in parts:
            need[p] += 1
        times = min(int(left[p]) // n for p, n in need.items())
        for p, n in need.items():
            left[p] -= times * n
        made.append((parts, times))

    for longest in range(capacity, 0, -1):
        while left[longest]:
            parts = (longest,)
            gap = capacity - longest
            while gap:
                left_now = left.copy()
                for p in parts:
                    left_now[p] -= 1
                found = complement(left_now, gap)
                if found is None:
                    fits = np.flatnonzero(left_now[1 : gap + 1] > 0)
                    if not len(fits):
                        break
                    found = (int(fits[-1]) + 1,)
                parts += found
                gap -= sum(found)
            take(parts)
    return made


def complement(left: np.ndarray, gap: int) -> tuple[int, ...] | None:
    """One, two or three available lengths that sum to ``gap``; those with the longest first part."""
    if left[gap] > 0:
        return (gap,)
    lengths = np.flatnonzero(left[:gap] > 0)
    lengths = lengths[lengths > 0][::-1]
    have = left > 0
    others = gap - lengths
    pair = lengths[have[others] & (others <= lengths) & ((others != lengths) | (left[lengths] > 1))]
    if len(pair):
        return int(pair[0]), gap - int(pair[0])
    for first in lengths.tolist():
        rest = gap - first
        if 3 * first < gap:
            break
        left[first] -= 1
        second = lengths[(lengths <= first) & (lengths < rest)]
        third = rest - second
        good = second[(left[second] > 0) & (left[third] > 0) & (third <= second) & ((third != second) | (left[second] > 1))]
        left[first] += 1
        if len(good):
            return first, int(good[0]), rest - int(good[0])
    return None


def slots(made: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """Where the pieces of each length go: ``(length, first, last, sequence, place)`` per run of their numbers.

    Piece number ``first + i`` of a length goes to sequence ``sequence + i`` at ``place``.
    """
    used: dict[int, int] = defaultdict(int)
    rows, sequence = [], 0
    for parts, times in made:
        place = 0
        for length in parts:
            rows.append((length, used[length], used[length] + times - 1, sequence, place))
            used[length] += times
            place += length
        sequence += times
    return rows


@spares("_of", "_length", "_many", "_base", "_at", "_slot", "_first", "_last", "_sequence", "_place")
def pack(parts: DataFrame, capacity: int = CAPACITY, length: str = "length") -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to a table of pieces.

    The pieces are stored once, with their numbers within task and length. The driver sees one
    row per length. What earlier tasks hold is one array of ``capacity`` numbers per task,
    which is broadcast up to ``BROADCAST`` bytes. Beyond that it is joined with one exchange, where
    no key holds more than one task's pieces.
    """
    spark = parts.sparkSession
    if not {TASK, NTH} <= set(parts.columns):
        parts = numbered(parts, length)
    stored = written(without(parts, "sequence_id", "offset"), "pieces")
    per_task = stored.groupBy(TASK, F.col(length).alias("_length")).agg(F.count("*").alias("_many"))
    before = Window.partitionBy("_length").orderBy(TASK).rowsBetween(Window.unboundedPreceding, -1)
    counted = written(per_task.withColumn("_base", F.coalesce(F.sum("_many").over(before), F.lit(0))), "numbers")
    counts = {r[0]: r[1] for r in counted.groupBy("_length").agg(F.sum("_many")).collect()}
    if not counts:
        return stored.drop(TASK, NTH).withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")})
    names = ["_slot", "_first", "_last", "_sequence", "_place"]
    places = small_table(spark, names, slots(plan(counts, capacity)))
    known = counted.groupBy(F.col(TASK).alias("_of")).agg(F.map_from_entries(F.collect_list(F.struct(F.col("_length").cast("int"), "_base"))).alias("_base"))
    bases = written(known.withColumn("_base", F.expr(f"transform(sequence(1, {capacity}), n -> coalesce(_base[n], 0L))")), "bases")
    bases = F.broadcast(bases) if bases.count() * capacity * 8 <= BROADCAST else bases.hint("merge")
    nth = F.get("_base", F.col(length) - 1) + F.col(NTH)
    based = stored.join(bases, F.col(TASK) == F.col("_of"))
    # at most a few thousand rows: every combination but the last few uses up a length
    placed = based.withColumn("_at", nth).join(F.broadcast(places), (F.col(length) == F.col("_slot")) & F.col("_at").between(F.col("_first"), F.col("_last")))
    return placed.withColumns({"sequence_id": F.col("_sequence") + F.col("_at") - F.col("_first"), "offset": F.col("_place")}).drop(
        TASK, NTH, "_of", "_base", "_at", *names)
