"""Ranked lexical search: Block-Max MaxScore over compressed postings, one heap per shard.

**Index.** Every task turns its documents into shards of a bounded amount of text. A shard numbers its documents by
ascending id, and holds for each of its terms the postings in blocks of ``BLOCK``: gaps and term frequencies as variable
bytes, and beside them, readable without unpacking, the last document and the greatest impact of each block. An
impact is ``(1000000000 * tf) div (1000 * tf + 8 * m)``, with the document's length in ``m``; it does not depend on the
query, so the maxima are exact. The index is a table with a row for each term of each shard; building it exchanges nothing.

**Search.** The distinct terms of the queries are joined with the index, once for the document frequencies, which give the
weights, and once for the postings; what is exchanged is the postings of asked terms only. A task gets one shard and one
block of queries. For each query the terms are ordered by their bound, weight times the shard's greatest impact. Terms
whose bounds together cannot pass the worst of the best ``k`` so far are non-essential: their postings never propose a
document. The essential ones propose documents, range by range; a proposed document is dropped as soon as its score so far and
the block maxima of the other terms cannot pass that worst score, before any of their blocks is unpacked for it. Ranges whose
block maxima cannot pass it are skipped as a whole. At the end the heaps of the shards meet in one window per query, which
keeps ``k`` rows inside each task first.

Scores are whole numbers, so results do not depend on the order of tasks. Nothing is left out: the bounds are exact, and
a document is dropped only if its score cannot be among the best.

Defined results: null texts and texts without a term are no documents of the collection and are never found; queries without
a term, or whose terms occur nowhere, have no rows. Documents are rows: repeated ones are ranked each. Equal scores rank by
ascending id, null ids last. Queries are the distinct pairs of id and text, null texts ask for nothing. A term of any length counts, a
document of any length is read whole. Other columns do not enter; columns are read by the names given. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recordmill.llm.common import forget_state, written
from recordmill.llm.fields import Words, cut, lower_ascii, quoted

#: Postings of a block.
BLOCK = 128
#: Bytes of text and documents of a shard; a shard is closed after the batch that passes either.
SHARD_BYTES, SHARD_DOCUMENTS = 8 << 20, 1 << 15
#: Documents scored at a time, and queries that share a task.
RANGE, QUERIES = 4096, 256
#: The length normalisation in percent, and the scale of impacts.
NORM, IMPACT_SCALE, TF_SCALE, M_SCALE = 75, 1_000_000_000, 1000, 8

#: Letters, digits and everything beyond ASCII make terms.
_KIND = np.ones(256, np.uint8)
_KIND[[c for c in range(128) if chr(c).isalnum()]] = 0
_KIND[128:] = 0
_FOLD = lower_ascii()


def terms(texts: pa.Array) -> Words:
    return cut(texts, _KIND, _FOLD)


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return IMPACT_SCALE * tf // (TF_SCALE * tf + M_SCALE * m)


# --- variable bytes ------------------------------------------------------------------------

def pack(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Seven bits a byte, lowest first, the top bit set on all but the last byte; and the end of each value."""
    size = np.ones(len(values), np.int64)
    for bits in range(7, 63, 7):
        size += values >= 1 << bits
    ends = np.cumsum(size)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    begins = ends - size
    for i in range(int(size.max(initial=0))):
        has = np.flatnonzero(size > i)
        more = (size[has] > i + 1).astype(np.uint8) << 7
        out[begins[has] + i] = (values[has] >> 7 * i & 127).astype(np.uint8) | more
    return out, ends


def unpack(data: np.ndarray) -> np.ndarray:
    last = data < 128
    if last.all():
        return data.astype(np.int64)
    begins = np.flatnonzero(np.append(True, last[:-1]))
    place = np.arange(len(data)) - np.repeat(begins, np.diff(np.append(begins, len(data))))
    return np.add.reduceat((data & 127).astype(np.int64) << 7 * place, begins)


# --- the index -------------------------------------------------------------------------------

@dataclass
class Index:
    """``postings``: ``shard, term, df, lasts, tops, ends, data``, and a row without a term for a shard's documents."""

    postings: DataFrame
    documents: int
    length: int


def _postings_of(shard: int, parts: list[tuple[Words, pa.Array]], documents: int, length: int) -> pa.RecordBatch | None:
    """The rows of one shard."""
    ids = pa.concat_arrays([i for _, i in parts])
    bases = np.cumsum([0, *(len(i) for _, i in parts)])
    doc = np.concatenate([w.row + np.int32(base) for (w, _), base in zip(parts, bases)])
    if not len(doc):
        return None
    coded = pa.chunked_array([w.words.dictionary_encode() for w, _ in parts]).unify_dictionaries()
    vocabulary = coded.chunk(0).dictionary
    # documents in the order of their ids, those without a term left out
    sizes = np.bincount(doc, minlength=len(ids))
    missing = ids.is_null().to_numpy(zero_copy_only=False)
    values = ids.fill_null(0).to_numpy()
    order = np.lexsort((values, missing))
    order = order[sizes[order] > 0]
    number = np.zeros(len(ids), np.int64)
    number[order] = np.arange(len(order))
    m = 100 - NORM + NORM * sizes[order] * documents // length

    key = np.concatenate([c.indices.to_numpy() for c in coded.chunks]).astype(np.int64)
    key *= len(order)
    key += number[doc]
    key.sort()
    runs = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    tf = np.diff(np.append(runs, len(key)))
    code, doc = np.divmod(key[runs], len(order))
    del key, coded
    first = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
    df = np.diff(np.append(first, len(code)))
    at = np.arange(len(code)) - np.repeat(first, df)
    heads = np.flatnonzero(at % BLOCK == 0)
    gaps = np.diff(doc, prepend=0)
    # the first gap of a block counts from the last document of the block before, that of a list from zero
    gaps[first] = doc[first]
    data, ends = pack(np.stack([gaps, tf], axis=1).reshape(-1))
    stops = np.append(heads[1:], len(code))
    tops = np.maximum.reduceat(impacts(tf, m[doc]), heads)
    lasts = doc[stops - 1]
    block_ends = ends[2 * stops - 1]
    per_term = (df + BLOCK - 1) // BLOCK
    list_begins = np.append(0, block_ends)[np.append(0, np.cumsum(per_term))]

    def column(values: np.ndarray, extra: bytes) -> pa.Array:
        """Numbers of each list's blocks, and at the end what the row of the documents holds."""
        offsets = np.append(np.append(0, np.cumsum(per_term)) * 4, 4 * len(values) + len(extra)).astype(np.int64)
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(values.astype("<i4").tobytes() + extra)])

    n = len(first) + 1
    relative = block_ends - np.repeat(list_begins[:-1], per_term)
    tail = m.astype("<i8").tobytes()
    bounds = np.append(list_begins, list_begins[-1] + len(tail)).astype(np.int64)
    arrays = [
        pa.array(np.full(n, shard)), pa.concat_arrays([vocabulary.take(pa.array(code[first])), pa.nulls(1, vocabulary.type)]),
        pa.array(np.append(df, len(order))), column(lasts, values[order].astype("<i8").tobytes()),
        column(tops, missing[order].tobytes()), column(relative, b""),
        pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(bounds), pa.py_buffer(data.tobytes() + tail)]),
    ]
    return pa.RecordBatch.from_arrays([a.cast(t) for a, t in zip(arrays, _TYPES)], names=_NAMES)


_NAMES = ["shard", "term", "df", "lasts", "tops", "ends", "data"]
_TYPES = [pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
_SCHEMA = "shard bigint, term string, df bigint, lasts binary, tops binary, ends binary, data binary"


def build(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> Index:
    """Indexes all of ``docs``: one pass for the size of the collection, one for the postings."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_state()
        for batch in batches:
            row = terms(batch.column(0)).row
            yield pa.RecordBatch.from_pydict({"documents": [len(np.unique(row))], "length": [len(row)]})

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_state()
        task = TaskContext.get().partitionId() << 24
        parts: list[tuple[Words, pa.Array]] = []
        size = rows = done = 0
        for batch in batches:
            found = terms(batch.column("text"))
            parts.append((found, batch.column("id")))
            size += batch.column("text").nbytes
            rows += batch.num_rows
            if size >= SHARD_BYTES or rows >= SHARD_DOCUMENTS:
                yield from _sent(_postings_of(task | done, parts, documents, length))
                parts, size, rows, done = [], 0, 0, done + 1
        if parts:
            yield from _sent(_postings_of(task | done, parts, documents, length))

    given = docs.select(F.col(quoted(id_column)).cast("bigint").alias("id"), F.col(quoted(text)).alias("text"))
    sizes = given.select("text").mapInArrow(measure, "documents bigint, length bigint").agg(F.sum("documents"), F.sum("length")).first()
    documents, length = (int(v or 0) for v in sizes)
    return Index(written(given.mapInArrow(shards, _SCHEMA), "postings"), documents, length)


def _sent(rows: pa.RecordBatch | None) -> Iterator[pa.RecordBatch]:
    for start in range(0, rows.num_rows if rows is not None else 0, 1 << 14):
        yield rows.slice(start, 1 << 14)


# --- one shard -------------------------------------------------------------------------------

class Postings:
    """The list of one term within a shard; blocks are unpacked when first needed and then kept."""

    def __init__(self, row: dict, m: np.ndarray):
        self.lasts, self.tops, self.ends = (np.frombuffer(row[c], "<i4") for c in ("lasts", "tops", "ends"))
        self.data = np.frombuffer(row["data"], np.uint8)
        self.m = m
        # a block that is still packed is filled with its last document, so the list is sorted at all times
        self.docs = np.repeat(self.lasts, BLOCK)[: row["df"]]
        self.impact = np.zeros(row["df"], np.int64)
        self.open = np.zeros(len(self.lasts), bool)
        self.top = int(self.tops.max())

    def need(self, blocks: np.ndarray) -> None:
        """Unpacks blocks given in ascending order."""
        blocks = blocks[~self.open[blocks]]
        if not len(blocks):
            return
        self.open[blocks] = True
        for run in np.split(blocks, np.flatnonzero(np.diff(blocks) > 1) + 1):
            a, b = int(run[0]), int(run[-1]) + 1
            pairs = unpack(self.data[self.ends[a - 1] if a else 0 : self.ends[b - 1]]).reshape(-1, 2)
            docs = np.cumsum(pairs[:, 0]) + (self.lasts[a - 1] if a else 0)
            at = slice(a * BLOCK, a * BLOCK + len(docs))
            self.docs[at], self.impact[at] = docs, impacts(pairs[:, 1], self.m[docs])

    def between(self, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents from ``low`` up to ``high`` and their impacts."""
        a, b = np.searchsorted(self.lasts, (low, high))
        self.need(np.arange(a, min(b + 1, len(self.lasts))))
        start, stop = np.searchsorted(self.docs, (low, high))
        return self.docs[start:stop], self.impact[start:stop]

    def most(self, low: int, high: int) -> int:
        a, b = np.searchsorted(self.lasts, (low, high))
        return int(self.tops[a : b + 1].max(initial=0))

    def bounds(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Block of each document and the block's maximum, zero beyond the end of the list."""
        block = np.searchsorted(self.lasts, docs)
        return block, np.append(self.tops, 0)[block].astype(np.int64)

    def found(self, docs: np.ndarray, block: np.ndarray) -> np.ndarray:
        """Impact on each of ``docs``, which lie in these blocks."""
        inside = block < len(self.lasts)
        self.need(np.unique(block[inside]))
        at = np.minimum(np.searchsorted(self.docs, docs), len(self.docs) - 1)
        return np.where(inside & (self.docs[at] == docs), self.impact[at], 0)


def best(lists: list[tuple[int, Postings]], size: int, k: int, span: int = RANGE) -> tuple[np.ndarray, np.ndarray]:
    """The best ``k`` documents of a shard of ``size`` for a query of weighted lists: scores and numbers, best first."""
    lists = sorted(((w, p) for w, p in lists if w > 0), key=lambda c: c[0] * c[1].top)
    reach = np.cumsum([w * p.top for w, p in lists])
    scores, docs, worst = np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    for low in range(0, size, span):
        high = min(low + span, size)
        # what cannot pass the worst score even together; documents come in order, so a tie is lost
        passive = int(np.searchsorted(reach, worst, side="right"))
        if passive == len(lists):
            break
        if worst and sum(w * p.most(low, high) for w, p in lists) <= worst:
            continue
        score = np.zeros(high - low, np.int64)
        for w, p in lists[passive:]:
            at, impact = p.between(low, high)
            score[at - low] += w * impact
        here = np.flatnonzero(score)
        score, here = score[here], here + low
        if passive and len(here):
            looked = [p.bounds(here) for _, p in lists[:passive]]
            blocks = [block for block, _ in looked]
            rest = np.cumsum([w * top for (w, _), (_, top) in zip(lists, looked)], axis=0)
            for i in range(passive - 1, -1, -1):
                alive = score + rest[i] > worst
                if not alive.all():
                    score, here, rest = score[alive], here[alive], rest[:, alive]
                    blocks = [block[alive] for block in blocks[: i + 1]]
                if not len(here):
                    break
                w, p = lists[i]
                score = score + w * p.found(here, blocks[i])
        good = score > worst
        scores, docs = np.append(scores, score[good]), np.append(docs, here[good])
        if len(scores) > k:
            top = np.lexsort((docs, -scores))[:k]
            scores, docs = scores[top], docs[top]
        if len(scores) >= k:
            worst = int(scores.min())
    top = np.lexsort((docs, -scores))
    return scores[top], docs[top]


# --- search ----------------------------------------------------------------------------------

def search(index: Index, items: DataFrame, k: int = 10, id_column: str = "item_id", text: str = "text") -> DataFrame:
    """The best ``k`` documents with a score above 0 for every query: ``item_id, rank, doc_id, score``."""
    given = items.select(F.col(quoted(id_column)).alias("item_id"), F.col(quoted(text)).alias("text")).distinct()
    asked = written(given.withColumn("number", F.monotonically_increasing_id()), "asked")
    names = asked.select("number", "item_id")

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = terms(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("number").take(pa.array(found.row)), found.words.cast(pa.string())], names=["number", "term"])

    wanted = asked.select("number", "text").mapInArrow(words, "number bigint, term string").groupBy("number", "term").agg(F.count(F.lit(1)).alias("times"))
    wanted = written(wanted, "query_terms")
    blocks = asked.agg(F.floor(F.count(F.lit(1)) / QUERIES)).first()[0]
    # numbers of a written table have gaps, so their hash deals queries out to blocks
    block = F.pmod(F.xxhash64("number"), F.lit(blocks + 1)).cast("int")
    postings = index.postings
    weight = F.floor(1000 * F.log((F.lit(2.0) * index.documents + 2) / (2 * F.col("df") + 1)))
    weights = postings.select("term", "df").join(wanted.select("term").distinct(), "term").groupBy("term").agg(F.sum("df").alias("df")).select("term", weight.alias("weight"))
    # a term is asked for by at most QUERIES queries of a block
    uses = written(wanted.join(weights, "term").groupBy(block.alias("block"), "term", "weight").agg(
        F.collect_list(F.struct("number", "times")).alias("uses")), "query_lists")
    lists = postings.join(uses, "term").select("shard", "block", "df", "lasts", "tops", "ends", "data", "weight", "uses")
    whole = postings.filter("term is null").select(
        "shard", F.explode(F.sequence(F.lit(0), F.lit(blocks).cast("int"))).alias("block"), "df", "lasts", "tops", "ends", "data",
        F.lit(None).cast("bigint").alias("weight"), F.lit(None).cast(uses.schema["uses"].dataType).alias("uses"))

    def one_shard(rows: pa.Table) -> pa.Table:
        numbers, ids, scores = [], [], []
        head = pc.is_null(rows.column("uses"))
        documents = rows.filter(head).to_pylist()[0]
        m = np.frombuffer(documents["data"], "<i8")
        id_of = pa.array(np.frombuffer(documents["lasts"], "<i8"), mask=np.frombuffer(documents["tops"], bool))
        queries: dict[int, list[tuple[int, Postings]]] = {}
        for row in rows.filter(pc.invert(head)).to_pylist():
            postings = Postings(row, m)
            for use in row["uses"]:
                queries.setdefault(use["number"], []).append((row["weight"] * use["times"], postings))
        for number, lists in queries.items():
            score, at = best(lists, len(m), k)
            numbers.append(np.full(len(at), number, np.int64))
            scores.append(score)
            ids.append(at)
        if not numbers:
            return empty
        return pa.table([pa.array(np.concatenate(numbers)), id_of.take(pa.array(np.concatenate(ids))), pa.array(np.concatenate(scores))], schema=empty.schema)

    empty = pa.schema([("number", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())]).empty_table()
    heaps = lists.unionByName(whole).groupBy("shard", "block").applyInArrow(one_shard, "number bigint, doc_id bigint, score bigint")
    order = Window.partitionBy("number").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ranked = heaps.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.join(names, "number").select("item_id", "rank", "doc_id", "score")
