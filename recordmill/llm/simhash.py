"""SimHash near-duplicates by tiled exact comparison.

Distinct fingerprints are laid out in cells by the population counts of their 16-bit
quarters. Two fingerprints differ in at least as many bits as these counts differ in sum,
so tile pairs whose counts differ by more than the radius are never compared: the counts
of the upper two quarters choose the pairs that meet, those of the lower two skip the
tiles within. All others are compared in full by exclusive-or and bit counts. A pair of
tiles reports a spanning forest of its links, never the pairs of a group.

Defined results: a null or wordless text has fingerprint zero and links like any other;
fewer words than a shingle are one shingle; repeated rows and ids share a component; rows
with a null id get a component but never name one unless all ids in it are null; an empty
table gives an empty result. Texts of any length are read whole. A column named
like a result, whatever the case of its letters, is replaced; all others pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordmill.llm.common import add_in_arrow, spares, written
from recordmill.llm.components import components
from recordmill.session import small_table

WORDS, BITS, SEED = 3, 3, 42
#: Fingerprints in a tile, on average.
TILE = 16384
#: Fingerprints compared at once on either side.
BLOCK = 1024

_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")


def simhash(text: bytes, words: int = WORDS, seed: int = SEED) -> int:
    """Unsigned fingerprint of a text: a bit is set if it is in over half of the shingles' hashes."""
    tokens = text.lower().split()  # of bytes: A-Z only, and exactly the six blanks of a word's definition
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    if len(tokens) <= words:
        hashes = [xxhash.xxh64_intdigest(joined, seed)]
    else:
        ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1)
        starts = np.append(0, ends[:-words])
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:b], seed) for a, b in zip(starts.tolist(), (ends[words - 1 :] - 1).tolist())]
    cells = np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8).astype(np.int64) + np.arange(8) * 256
    counts = np.bincount(cells.ravel(), minlength=2048).reshape(8, 256) @ _BYTE_BITS.astype(np.int64)
    return int(np.packbits(counts.ravel() * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, text: str = "text", out: str = "simhash", words: int = WORDS) -> DataFrame:
    """Adds the fingerprint as a signed 64-bit number."""

    def run(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        values = [simhash((t or "").encode(), words) for t in batch.column(text).to_pylist()]
        return {out: pa.array(np.array(values, np.uint64).view(np.int64))}

    return add_in_arrow(df, f"`{out}` bigint", run)


def forest(a: np.ndarray, b: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the same nodes ``0..size`` as the links ``a - b`` do, fewer than nodes."""
    label = np.arange(size)
    while True:
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        np.minimum.at(label, before[a], low)
        np.minimum.at(label, before[b], low)
        label = label[label]
        if (label == before).all():
            moved = np.flatnonzero(label != np.arange(size))
            return moved, label[moved]


def _quarters(values: np.ndarray) -> np.ndarray:
    return np.bitwise_count(values.view("<u2").reshape(-1, 4)).astype(np.int64)


def compare(left: np.ndarray, right: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between two tiles of unsigned fingerprints with at most ``bits`` differing bits, as a forest."""
    both = np.concatenate([left, right])
    tiles = []
    for side, base in ((left, 0), (right, len(left))):
        counts = _quarters(side)
        order = np.lexsort((counts[:, 0], counts[:, 1], counts[:, 2], counts[:, 3]))
        keys, starts = np.unique(counts[order] @ (17 ** np.arange(4)), return_index=True)
        inner = np.stack([keys // 17 ** k % 17 for k in range(4)], axis=1)
        tiles.append((inner, np.append(starts, len(side)), order + base, side[order]))
    (ka, sa, oa, va), (kb, sb, ob, vb) = tiles
    found: list[tuple[np.ndarray, np.ndarray]] = []
    links = 0
    for i in range(len(ka)):
        # tiles whose population counts differ beyond the radius are skipped
        for j in np.flatnonzero(np.abs(kb - ka[i]).sum(axis=1) <= bits).tolist():
            for x in range(sa[i], sa[i + 1], BLOCK):
                part = va[x : min(x + BLOCK, sa[i + 1]), None]
                for y in range(sb[j], sb[j + 1], BLOCK):
                    near = np.bitwise_count(part ^ vb[y : min(y + BLOCK, sb[j + 1])]) <= bits
                    if near.any():
                        p, q = np.nonzero(near)
                        found.append((oa[x + p], ob[y + q]))
                        links += len(p)
            if links > 1 << 21:
                found = [forest(*map(np.concatenate, zip(*found)), len(both))]
                links = len(found[0][0])
    if not found:
        return both[:0], both[:0]
    a, b = map(np.concatenate, zip(*found))
    differ = both[a] != both[b]
    a, b = forest(a[differ], b[differ], len(both)) if differ.any() else (a[:0], b[:0])
    return both[a], both[b]


def links(prints: DataFrame, bits: int = BITS, tile: int = TILE) -> DataFrame:
    """Links ``(a, b)`` that connect all pairs of distinct fingerprints within ``bits`` bits.

    ``prints`` has one column of signed numbers without repeats. Tiles are bounded by
    hashing each cell of the upper quarters' counts into as many tiles as its size needs;
    there are at most 289 cells, so their sizes may be known to the driver.
    """
    spark = prints.sparkSession
    name = prints.columns[0]
    cells = prints.select(
        F.col(name).alias("v"),
        (F.bit_count(F.shiftrightunsigned(name, 48)) * 17 + F.bit_count(F.shiftrightunsigned(name, 32).bitwiseAND(F.lit(0xFFFF)))).alias("cell"))
    many = {r.cell: -(-r["count"] // tile) for r in cells.groupBy("cell").count().collect()}
    if not many:
        return spark.createDataFrame([], "a bigint, b bigint")
    sizes = small_table(spark, ["cell", "tiles"], sorted(many.items()))
    tiles = cells.join(F.broadcast(sizes), "cell").groupBy(
        "cell", F.pmod(F.xxhash64("v", F.lit(1)), F.col("tiles")).alias("no")).agg(F.collect_list("v").alias("prints"))
    tiles = written(tiles.withColumn("id", F.col("cell").cast("long") * (1 << 40) + F.col("no")), "tiles")
    meets = [
        (c, d, n) for c in many for d, n in many.items()
        if abs(c // 17 - d // 17) + abs(c % 17 - d % 17) <= bits and c <= d
    ]
    targets = small_table(spark, ["cell", "target", "tiles"], meets)  # at most 289 x 25 rows
    visits = (
        tiles.join(F.broadcast(targets), "cell")
        .select("id", "prints", "target", F.explode(F.sequence(F.lit(0), (F.col("tiles") - 1).cast("int"))).alias("n"))
        .select(F.col("id").alias("guest"), F.col("prints").alias("guests"), (F.col("target").cast("long") * (1 << 40) + F.col("n")).alias("id"))
        .filter("guest <= id")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                left, right = (batch.column(c)[k].values.to_numpy().view(np.uint64) for c in ("prints", "guests"))
                a, b = compare(left, right, bits)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    return tiles.join(visits, "id").select("prints", "guests").mapInArrow(run, "a bigint, b bigint")


@spares("_print")
def group(df: DataFrame, key: str, prints: str = "simhash", bits: int = BITS, out: str = "component_id") -> DataFrame:
    """Adds the smallest ``key`` (nulls last) that is reachable over links from a row's fingerprint.

    ``df`` is read several times and should be a stored table without its texts.
    """
    firsts = written(df.groupBy(F.col(prints).alias("_print")).agg(F.min(key).alias("_first")), "prints")
    roots = components(links(firsts.select("_print"), bits))
    rooted = firsts.join(roots, firsts["_print"] == roots["node"], "left").select(
        "_print", "_first", F.coalesce("component", "_print").alias("_root"))
    named = rooted.groupBy("_root").agg(F.min("_first").alias(out))
    of_print = rooted.select("_print", "_root").join(named, "_root").select("_print", out)
    return df.drop(out).join(of_print, df[prints] == F.col("_print")).drop("_print")
