"""Token counts of texts of any length by overlapping windows that find back into step.

A text of more than ``WINDOW`` characters is cut into windows that share ``OVERLAP`` characters with the next. The
windows are rows, dealt out over the tasks by text and number, so one huge text keeps many tasks busy and none holds it
all. Every window is encoded with the offsets of its tokens. Two neighbouring windows are spliced where both have the
same token at the same place of the text: the tokens of the left window up to there, those of the right one from there.

Why that place is proven: merging goes by the rank of a pair, leftmost first, and a merge inside two neighbouring tokens
never depends on anything outside them. So a row of tokens is the encoding of its text exactly if every two neighbours
are the encoding of their joint text. At the splice the left token and the common token are neighbours in the left
window, and all other neighbours are neighbours in one of the windows; so the spliced row is the encoding of the whole
text. No context is assumed and nothing is estimated.

Where a pair of windows has no common token (a long run of one character may stay out of step for ever), the text is cut
again with four times the overlap, and longer windows where the overlap asks for them. In the end a window holds the
whole text, so every count is exact.

Defined results: a null text has a null count (the query reads null texts as empty), an empty one has 0. Rows are
independent: repeated rows and ties get the same count each, an empty table gives an empty table. Other columns pass
through, whatever their names; a column that is named like the result, in any case of letters, is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordmill.llm.common import add_in_arrow, worker_state, written
from recordmill.llm.fields import fresh, quoted, without

#: Characters of a window, and characters it shares with the next one at first.
WINDOW, OVERLAP = 1 << 15, 1 << 8
#: By how much overlaps grow where two windows are not in step.
WIDER = 4
#: No piece holds this character, so nothing merges over it: what follows it is encoded as in the middle of a text.
BARRIER = "\n"
#: Characters sent to the JVM at a time.
_SENT = 1 << 22


class Pieces:
    """A sentence piece model: counts of texts, tokens and offsets of windows."""

    def __init__(self, proto: bytes):
        self.model = sentencepiece.SentencePieceProcessor(model_proto=proto)
        size = self.model.get_piece_size()
        pieces = [self.model.id_to_piece(i) for i in range(size)]
        if any(BARRIER in p for p in pieces):
            raise ValueError("a piece of the model holds the character that separates windows")
        # a character without a piece comes as its bytes: the first one stands for the character
        self.lengths = np.array([len(p) for p in pieces], np.int64)
        for i in range(size):
            if self.model.is_byte(i):
                self.lengths[i] = 0 if 0x80 <= int(pieces[i][3:5], 16) < 0xC0 else 1
        self.head = len(self.model.encode(BARRIER))

    def counts(self, texts: list[str]) -> list[int]:
        return [len(ids) for ids in self.model.encode(texts, num_threads=1)]

    def window(self, text: str, first: bool) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a window and the place in it where each begins. Only the first window of a text gets the model's leading blank."""
        ids = np.array(self.model.encode(text) if first else self.model.encode(BARRIER + text)[self.head :], np.int64)
        ends = np.cumsum(self.lengths[ids]) - (1 if first and len(ids) else 0)
        return ids, ends - self.lengths[ids]


class PieceModel:
    """A model file, read on the driver and sent to the workers (its size is fixed by the file)."""

    def __init__(self, spark: SparkSession, path: str):
        with open(path, "rb") as f:
            self._proto = spark.sparkContext.broadcast(f.read())
        self.path = path

    def pieces(self) -> Pieces:
        return worker_state(f"pieces {self.path}", lambda: Pieces(self._proto.value))


def starts(length: int, window: int, overlap: int) -> range:
    """Where the windows of a text begin; the last one reaches its end."""
    return range(0, max(length - overlap, 1), window - overlap)


def count_tokens(df: DataFrame, model: PieceModel, text: str = "text", out: str = "n_tokens", window: int = WINDOW, overlap: int = OVERLAP) -> DataFrame:
    """Adds the number of tokens of ``text``. ``window`` has to be twice ``overlap`` at least, so that a window's splices keep their order.

    Texts of one window are counted where they are; only the windows of longer ones are exchanged.
    """
    if window < 2 * overlap or overlap < 1:
        raise ValueError("a window holds at least two overlaps")
    df = without(df, out)
    longer = F.coalesce(F.length(F.col(quoted(text))) > window, F.lit(False))

    def direct(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        column = batch.column(text)
        counts = model.pieces().counts([t or "" for t in column.to_pylist()])
        return {out: pa.array(counts, pa.int64(), mask=column.is_null().to_numpy(zero_copy_only=False))}

    short = add_in_arrow(df.filter(~longer), f"{quoted(out)} bigint", direct, stateful=True)
    uid = fresh(df, "uid")
    long = written(df.filter(longer).withColumn(uid, F.monotonically_increasing_id()), "long_texts")
    if long.isEmpty():
        return short
    totals = _totals(long.select(F.col(uid).alias("uid"), F.col(quoted(text)).alias("text")), model, window, overlap)
    counted = long.join(totals.withColumnsRenamed({"uid": uid, "n": out}), uid)
    return short.unionByName(counted.select(*short.columns))


def _totals(texts: DataFrame, model: PieceModel, window: int, overlap: int) -> DataFrame:
    """``uid`` and ``n`` of texts (``uid, text``): a round for each width of overlap, of texts not settled before."""
    done = None
    while True:
        settled = written(_spliced(_encoded(_windows(texts, window, overlap), model, window, overlap)), "spliced")
        exact = settled.filter("out_of_step = 0").select("uid", "n")
        done = exact if done is None else done.unionByName(exact)
        left = settled.filter("out_of_step > 0").select("uid")
        if left.isEmpty():
            return done
        texts = texts.join(left, "uid", "left_semi")
        overlap *= WIDER
        window = max(window, WIDER * overlap)


def _windows(texts: DataFrame, window: int, overlap: int) -> DataFrame:
    """A row for every window: ``uid, number, start, last, text``."""
    names = ["uid", "number", "start", "last", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            for uid, text in zip(batch.column("uid").to_pylist(), batch.column("text").to_pylist()):
                places = starts(len(text), window, overlap)
                for number, at in enumerate(places):
                    rows.append((uid, number, at, number == len(places) - 1, text[at : at + window]))
                    if len(rows) * window >= _SENT:
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=names)
                        rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=names)

    return texts.mapInArrow(run, "uid bigint, number bigint, start bigint, last boolean, text string")


def _encoded(windows: DataFrame, model: PieceModel, window: int, overlap: int) -> DataFrame:
    """For every seam the marks of the window on either side; for the last window its number of tokens.

    A mark is a token that begins within the overlap: its place and id in one number, and how many tokens precede it.
    """
    schema = pa.schema([("uid", pa.int64()), ("seam", pa.int64()), ("left", pa.binary()), ("right", pa.binary()), ("n", pa.int64())])

    def marks(ids: np.ndarray, at: np.ndarray, base: int, low: int, high: int, lengths: np.ndarray) -> bytes:
        here = np.flatnonzero((at + base >= low) & (at + base < high) & (lengths[ids] > 0))
        return np.concatenate([(at[here] + base) << 20 | ids[here], here]).astype("<i8").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = model.pieces()
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                uid, number, start = row["uid"], row["number"], row["start"]
                ids, at = pieces.window(row["text"], number == 0)
                if number:
                    rows.append((uid, number - 1, None, marks(ids, at, start, start, start + overlap, pieces.lengths), None))
                if row["last"]:
                    rows.append((uid, number, None, None, len(ids)))
                else:
                    stop = start + window
                    rows.append((uid, number, marks(ids, at, start, stop - overlap, stop, pieces.lengths), None, None))
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in rows], schema=schema)

    return windows.repartition("uid", "number").mapInArrow(run, "uid bigint, seam bigint, left binary, right binary, n bigint")


def _spliced(seams: DataFrame) -> DataFrame:
    """``uid, n, out_of_step``: the tokens of each text and at how many seams no common token was found.

    A window counts from the splice on its left to the splice on its right, so a text has the tokens of its last window
    and, for each seam, what precedes the splice in the left window less what precedes it in the right one.
    """

    @F.arrow_udf("bigint")
    def difference(left: pa.Array, right: pa.Array) -> pa.Array:
        found: list[int | None] = []
        for a, b in zip(left.to_pylist(), right.to_pylist()):
            x, y = (np.frombuffer(s or b"", "<i8").reshape(2, -1) for s in (a, b))
            _, i, j = np.intersect1d(x[0], y[0], assume_unique=True, return_indices=True)
            middle = len(i) // 2
            found.append(int(x[1][i[middle]] - y[1][j[middle]]) if len(i) else None)
        return pa.array(found, pa.int64())

    met = seams.groupBy("uid", "seam").agg(F.max("left").alias("left"), F.max("right").alias("right"), F.max("n").alias("n"))
    judged = met.select("uid", F.col("n").isNotNull().alias("end"), F.coalesce("n", difference("left", "right")).alias("n"))
    return judged.groupBy("uid").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count_if(F.col("n").isNull()).alias("out_of_step"))
