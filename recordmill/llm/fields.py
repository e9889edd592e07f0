"""Column names and vectorised cutting of texts, for operators that pass other columns through."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def fresh(df: DataFrame, name: str) -> str:
    """A column name that clashes with none of ``df``, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without the columns that a result of one of these names would clash with."""
    gone = {n.lower() for n in names}
    kept = [c for c in df.columns if c.lower() not in gone]
    return df if len(kept) == len(df.columns) else df.select(*(quoted(c) for c in kept))


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def lower_ascii() -> np.ndarray:
    """Byte table that folds A-Z only."""
    table = np.arange(256, dtype=np.uint8)
    table[ord("A") : ord("Z") + 1] += 32
    return table


@dataclass
class Words:
    """Words of a column of texts, in order: the words, the row each comes from, and a number that changes at every piece."""

    words: pa.Array
    row: np.ndarray
    piece: np.ndarray

    def __len__(self) -> int:
        return len(self.row)


def cut(texts: pa.Array, kind: np.ndarray, fold: np.ndarray | None = None) -> Words:
    """Cuts texts at byte level: of each byte ``kind`` says 0 for a part of a word, 1 for a separator, 2 for the end of a piece.

    All texts are cut in one go over their joint buffer; a text's end ends its last word and piece. Null texts have no words.
    """
    column = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    kinds = kind[raw]
    inside = kinds == 0
    opens = np.zeros(len(raw) + 1, bool)
    opens[offsets] = True
    opens = opens[:-1]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | opens[1:]
    starts = np.flatnonzero(begins)
    closes = inside.copy()
    closes[:-1] &= ~inside[1:] | opens[1:]
    lengths = np.flatnonzero(closes) - starts + 1
    breaks = np.flatnonzero((kinds == 2) | opens)
    piece = np.searchsorted(breaks, starts, side="right").astype(np.int32)
    letters = raw[inside] if fold is None else fold[raw[inside]]
    bounds = np.append(0, np.cumsum(lengths)).astype(np.int64)
    words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(letters))
    row = (np.searchsorted(offsets, starts, side="right") - 1).astype(np.int32)
    return Words(words, row, piece)
