"""Phrase collocations by dynamic itemset counting.

**Blocks.** Texts are cut once into blocks of words: the distinct words of a block, a hash of each with its language, and a
number per occurrence, with marks where a piece begins. Blocks are dealt out over ``SHARDS`` shards, which are then scanned
one after the other, round and round.

**Dynamic counting.** Words are counted from the start. A phrase of two to four words becomes active as soon as both of its
subphrases (without the last and without the first word) have reached the threshold in what was counted so far, in the middle of a
cycle if it so happens, and lengths are counted side by side in one scan. From its activation on, a phrase is counted through
exactly one full cycle, that is once through every shard, and then settled. A phrase that reaches the threshold has only
subphrases that reach it, so none is missed, and each settled count is a count over all documents. Scanning ends when no
phrase is open, after at most four cycles.

**Which phrases are active** is read from a table of ``SLOTS`` bytes: a phrase hashes to a slot, and the slot holds the step at which
the first of its phrases reached the threshold. A slot never changes once set, so the step at which a phrase becomes active is
the same for every task and step, and every active phrase gets exactly one cycle. Phrases that share a slot can make others active
that need not be: those are counted, exactly, and dropped in the end. So the table has a fixed size however many phrases there are,
which is what is broadcast and what comes back to the driver; results do not depend on it.

Tasks combine the counts of a block before the exchange, and Spark those of a task; open counts are kept in a written table of each step.

**Scores** are whole numbers; products are decimals of 38 digits. A candidate is dropped by a longer one through a join on the contiguous
parts of all candidates.

Defined results: a null text is empty, a null language is ``und``; texts and pieces without words count nothing. Repeated rows
count each. Equal scores rank by count, then by the phrase in byte order, and a phrase is there once per language, so ranks
have no ties. Empty tables give no rows. Texts of any length are read whole. Columns are read by the names given, others do not enter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recordmill.llm.common import forget_state, written
from recordmill.llm.fields import cut, lower_ascii, quoted
from recordmill.session import scratch_path

#: Shards of a cycle.
SHARDS = 2
#: Slots of the table of phrases that have reached the threshold; a slot is a byte.
SLOT_BITS = 24
#: Bytes of text of a block.
BLOCK_BYTES = 3 << 20
#: Lengths, threshold, share of a longer phrase that drops a shorter one, scale of scores, rows of a language.
LONGEST, LEAST, DROP_SHARE, SCALE, KEPT = 4, 30, 80, 2_000_000, 2000
NO_LANGUAGE = "und"

_KIND = np.zeros(256, np.uint8)
_KIND[list(b" \t")] = 1
_KIND[list(b".,;:!?\n\x0b\x0c\r")] = 2
_FOLD = lower_ascii()
_NEVER = 255
_GOLD, _STIR = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


# --- blocks ----------------------------------------------------------------------------------

def blocks(docs: DataFrame, text: str = "text", lang: str = "lang", shards: int = SHARDS) -> DataFrame:
    """``shard, lang, n_words, words, hashes, codes``: a written table, a folder per shard.

    ``codes`` numbers the words of the block by occurrence; the first word of a piece has the complement of its number.
    """
    names = ["shard", "lang", "n_words", "words", "hashes", "codes"]
    schema = "shard int, lang string, n_words bigint, words array<string>, hashes binary, codes binary"

    def block(shard: int, name: str, texts: list[pa.Array]) -> pa.RecordBatch:
        found = cut(pa.concat_arrays(texts), _KIND, _FOLD)
        coded = found.words.dictionary_encode()
        codes = coded.indices.to_numpy().astype("<i4")
        begins = np.append(True, np.diff(found.piece) != 0)[: len(codes)]
        codes = np.where(begins, ~codes, codes).astype("<i4")
        seed = xxhash.xxh3_64_intdigest(name.encode())
        hashes = np.array([xxhash.xxh3_64_intdigest(w, seed) for w in coded.dictionary.cast(pa.large_binary()).to_pylist()], "<u8")
        words = pa.ListArray.from_arrays(pa.array([0, len(hashes)], pa.int32()), coded.dictionary.cast(pa.string()))
        return pa.RecordBatch.from_arrays([
            pa.array([shard], pa.int32()), pa.array([name]), pa.array([len(codes)], pa.int64()), words,
            pa.array([hashes.tobytes()], pa.binary()), pa.array([codes.tobytes()], pa.binary())], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_state()
        kept: dict[str, list[pa.Array]] = {}
        size: dict[str, int] = {}
        turn = TaskContext.get().partitionId()
        for batch in batches:
            langs = batch.column("lang").dictionary_encode()
            for i, name in enumerate(langs.dictionary.to_pylist()):
                texts = batch.column("text").filter(pc.equal(langs.indices, i)).cast(pa.large_string())
                kept.setdefault(name, []).append(texts)
                size[name] = size.get(name, 0) + texts.nbytes
                if size[name] >= BLOCK_BYTES:
                    yield block(turn % shards, name, kept.pop(name))
                    turn, size[name] = turn + 1, 0
        for name, texts in kept.items():
            yield block(turn % shards, name, texts)
            turn += 1

    given = docs.select(F.coalesce(F.col(quoted(lang)), F.lit(NO_LANGUAGE)).alias("lang"), F.col(quoted(text)).alias("text"))
    # a block is megabytes in one row. Parquet looks at sizes every hundred rows, keeps the least and the greatest value of each row
    # group until the file ends, and is read by up to 4,096 rows of a row group at once: all blocks of a task would be in memory together
    alone = {"parquet.block.row.count.limit": "1"}
    for column in ("hashes", "codes"):
        alone |= {f"parquet.column.statistics.enabled#{column}": "false", f"parquet.enable.dictionary#{column}": "false"}
    return _stored(given.mapInArrow(run, schema), "phrase_blocks", alone)


def _stored(rows: DataFrame, name: str, options: dict[str, str] | None = None) -> DataFrame:
    """A written table, packed more tightly than the default: it is read often or holds many strings."""
    path = scratch_path(rows.sparkSession, name)
    rows.write.option("compression", "zstd").options(**options or {}).parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


# --- one scan --------------------------------------------------------------------------------

def mix(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of a phrase and one more word."""
    x = (left * _GOLD) ^ right
    x ^= x >> np.uint64(31)
    return x * _STIR


def slots(hashes: np.ndarray, bits: int) -> np.ndarray:
    return ((hashes ^ hashes >> np.uint64(29)) * _GOLD >> np.uint64(64 - bits)).astype(np.int32)


def packed(slot: np.ndarray, since: np.ndarray, k: int) -> np.ndarray:
    """What follows from a phrase, in one number: its slot, the step that made it active, its words."""
    return slot.astype(np.int64) << 16 | since.astype(np.int64) << 8 | k


def _ranked(codes: list[np.ndarray], size: int) -> np.ndarray:
    """One number below 2^62 for each tuple of word numbers, the same for equal tuples only."""
    joint = codes[0]
    span = size
    for code in codes[1:]:
        if span > (1 << 62) // size:
            distinct, joint = np.unique(joint, return_inverse=True)
            span = len(distinct)
        joint = joint * size + code
        span *= size
    return joint


def phrases(words: pa.Array, hashes: np.ndarray, codes: np.ndarray, reached: np.ndarray, step: int, shards: int, longest: int) -> Iterator[pa.RecordBatch]:
    """Counts of the phrases of a block that are active at a step: ``phrase, state, n`` (see :func:`packed`)."""
    bits = len(reached).bit_length() - 1
    begins = codes < 0
    code = np.where(begins, ~codes, codes).astype(np.int64)
    size = max(len(hashes), 1)

    def counted(at: np.ndarray, k: int, slot: np.ndarray, since: np.ndarray) -> pa.RecordBatch:
        """``slot`` and ``since`` belong to the places ``at``."""
        _, first, n = np.unique(_ranked([code[at + i] for i in range(k)], size), return_index=True, return_counts=True)
        parts = [words.take(pa.array(code[at[first] + i])) for i in range(k)]
        joined = parts[0] if k == 1 else pc.binary_join_element_wise(*parts, " ")
        return pa.RecordBatch.from_arrays([joined, pa.array(packed(slot[first], since[first], k)), pa.array(n.astype(np.int64))], names=["phrase", "state", "n"])

    place = np.arange(len(code))
    own = slots(hashes, bits)
    if step <= shards and len(code):
        yield counted(place, 1, own[code], np.zeros(len(code), np.int32))
    step_of = reached[own].astype(np.int32)
    step_of[(step_of == 0) | (step_of >= step)] = _NEVER
    # by place: step at which the phrase of k - 1 words from here reached the threshold, and its hash
    since, print_ = step_of[code], hashes[code]
    for k in range(2, longest + 1):
        # places whose phrase of k words lies in one piece: the word at its end opens none
        if len(place) == 0:
            return
        end = place + k - 1
        inner = np.flatnonzero(end < len(code))
        inner = inner[~begins[end[inner]]]
        # both subphrases begin at places that are still listed, the second one a place further
        after = np.searchsorted(place, place[inner] + 1)
        there = after < len(place)
        there[there] = place[after[there]] == place[inner[there]] + 1
        inner, after = inner[there], after[there]
        joint = np.maximum(since[inner], since[after])
        good = joint != _NEVER
        inner, joint = inner[good], joint[good]
        place, print_ = place[inner], mix(print_[inner], hashes[code[place[inner] + k - 1]])
        slot = slots(print_, bits)
        due = np.flatnonzero(joint >= step - shards)
        if len(due):
            yield counted(place[due], k, slot[due], joint[due])
        since = reached[slot].astype(np.int32)
        never = (since == 0) | (since >= step)
        # a slot may be set by another phrase before this one is active; what builds on it waits for both
        since = np.where(never, _NEVER, np.maximum(since, joint))


def _scan(shard: DataFrame, table: Broadcast, step: int, shards: int, longest: int) -> DataFrame:
    """``phrase, state, n``; the phrase has its language and a line break in front, as no word holds one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_state()
        reached = np.frombuffer(table.value, np.uint8)
        for batch in batches:
            for i in range(batch.num_rows):
                words = batch.column("words")[i].values
                hashes, codes = (np.frombuffer(batch.column(c)[i].as_buffer(), t) for c, t in (("hashes", "<u8"), ("codes", "<i4")))
                for found in phrases(words, hashes, codes, reached, step, shards, longest):
                    keys = pc.binary_join_element_wise(batch.column("lang")[i], found.column(0), "\n")
                    rows = pa.RecordBatch.from_arrays([keys, *found.columns[1:]], names=["phrase", "state", "n"])
                    for start in range(0, rows.num_rows, 1 << 16):
                        yield rows.slice(start, 1 << 16)

    return shard.select("lang", "words", "hashes", "codes").mapInArrow(run, "phrase string, state bigint, n bigint")


def frequent(stored: DataFrame, least: int = LEAST, shards: int = SHARDS, longest: int = LONGEST, bits: int = SLOT_BITS) -> DataFrame:
    """``lang, phrase, k, n`` of all phrases of up to ``longest`` words that occur ``least`` times or more in blocks ``stored``."""
    if longest * shards >= _NEVER:
        raise ValueError("steps are kept in a byte")
    context = stored.sparkSession.sparkContext
    reached = np.zeros(1 << bits, np.uint8)
    k, since, slot = (F.expr(e).cast("int") for e in ("state & 255", "(state >> 8) & 255", "state >> 16"))
    open_rows = result = None
    step = 0
    while True:
        step += 1
        table = context.broadcast(reached.tobytes())
        found = _scan(stored.filter(F.col("shard") == (step - 1) % shards), table, step, shards, longest)
        if open_rows is not None:
            found = found.unionByName(open_rows)
        total = found.groupBy("phrase", "state").agg(F.sum("n").alias("n"))
        rows = _stored(total.filter((F.col("n") >= least) | (since + shards > step)), "phrase_counts")
        table.destroy()
        # at most one number per slot
        new = rows.filter((F.col("n") >= least) & (k < longest)).select(slot.alias("slot")).distinct().toArrow().column(0).to_numpy()
        new = new[reached[new] == 0]
        reached[new] = step
        done = rows.filter(since + shards <= step).select(
            F.expr("left(phrase, length(phrase) - length(substring_index(phrase, '\\n', -1)) - 1)").alias("lang"),
            F.expr("substring_index(phrase, '\\n', -1)").alias("phrase"), k.alias("k"), "n")
        result = done if result is None else result.unionByName(done)
        open_rows = rows.filter(since + shards > step)
        # words are open through the first cycle, phrases for a cycle after the step that made them active
        if step >= shards and int(reached.max()) + shards <= step:
            return result


# --- scores ----------------------------------------------------------------------------------

def part(first: str, length: str) -> str:
    """SQL for ``length`` words of a phrase from word number ``first``, counted from one."""
    return f"array_join(slice(split(phrase, ' '), {first}, {length}), ' ')"


def score(counts: DataFrame, words: DataFrame, least: int = LEAST, kept: int = KEPT) -> DataFrame:
    """The best phrases of each language: ``lang, rank, phrase, a, l, r, n, score``.

    ``counts`` are those of :func:`frequent`; ``words`` (``lang, n_words``) the sizes of the blocks.
    """
    candidates = counts.filter((F.col("k") >= 2) & (F.col("n") >= least)).withColumnRenamed("n", "a")
    # a candidate is dropped by a longer one that holds it and is nearly as frequent
    longer = candidates.filter("k > 2").select("lang", F.col("a").alias("f"), F.explode(F.expr(
        f"array_distinct(flatten(transform(sequence(2, k - 1), j -> transform(sequence(1, k - j + 1), i -> {part('i', 'j')}))))")).alias("phrase"))
    held = longer.groupBy("lang", "phrase").agg(F.max("f").alias("f"))
    alive = candidates.join(held, ["lang", "phrase"], "left").filter(F.col("f").isNull() | (F.expr(f"cast(100 as decimal(3,0)) * f < cast({DROP_SHARE} as decimal(3,0)) * a")))
    cuts = alive.select("lang", "phrase", "a", F.explode(F.expr("sequence(1, k - 1)")).alias("c"), F.expr("k").alias("k")).select(
        "lang", "phrase", "a", "c", F.expr(part("1", "c")).alias("head"), F.expr(part("c + 1", "k - c")).alias("tail"))
    sizes = counts.select("lang", F.col("phrase").alias("part"), "n")
    cuts = cuts.join(sizes.withColumnsRenamed({"part": "head", "n": "l"}), ["lang", "head"]).join(sizes.withColumnsRenamed({"part": "tail", "n": "r"}), ["lang", "tail"])
    value = F.expr(f"cast(cast({SCALE} as decimal(8,0)) * cast(a as decimal(19,0)) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0))) as bigint)")
    # the weakest cut counts
    weakest = cuts.withColumn("score", value).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "c", "l", "r")).alias("cut"))
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), F.col("phrase"))
    best = weakest.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score").withColumn("rank", F.row_number().over(order).cast("bigint")).filter(F.col("rank") <= kept)
    totals = words.groupBy("lang").agg(F.sum("n_words").alias("n"))
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def mine(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, kept: int = KEPT, shards: int = SHARDS, longest: int = LONGEST, bits: int = SLOT_BITS) -> DataFrame:
    """Collocations of all documents: :func:`blocks`, :func:`frequent` and :func:`score`."""
    stored = blocks(docs, text, lang, shards)
    counts = written(frequent(stored, least, shards, longest, bits), "phrases")
    return score(counts, stored.select("lang", "n_words"), least, kept)
