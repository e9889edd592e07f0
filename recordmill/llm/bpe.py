"""BPE encoding and decoding by a bounded-lookahead streaming transducer.

A text is cut where a single space follows something that is not white space: no
pre-token reaches over such a place, so one character of lookahead settles a cut and
every chunk is encoded alone. Within a chunk, short pre-tokens are merged directly;
a long one is streamed byte by byte and its tokens leave as soon as no continuation
can change them (see :meth:`Merges.stream`).

Defined results: a null text encodes to null ids and decodes to null (the query reads
null texts as empty); an empty text gives no ids and an empty text. Texts of any length
are read whole. Other columns pass through; columns named like a result are replaced.
"""

from __future__ import annotations

import codecs
import json
import re
from array import array
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from recordmill.llm.common import add_in_arrow, int_list, worker_state

#: Fixed value: the pattern of byte-level pre-tokens that belongs to the vocabulary.
PRETOKEN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pre-tokens of more bytes are streamed.
STREAM_FROM = 96
#: Chunks remembered by a worker; results do not depend on it.
REMEMBERED = 250_000
_NONE = 1 << 60


def byte_letters() -> dict[str, int]:
    """Letter of the vocabulary file -> byte: printable bytes stand for themselves, the rest follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Merges:
    """Merge list and vocabulary of a byte-level BPE file."""

    def __init__(self, source: str):
        spec = json.loads(source)
        letters = byte_letters()
        vocab = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.token = {i: bytes(letters[c] for c in t) for t, i in vocab.items()}
        self.token |= {i: t.encode() for t, i in self.special.items()}
        self.id = {bytes(letters[c] for c in t): i for t, i in vocab.items()}
        self.byte = [self.id.get(bytes([b]), -1) for b in range(256)]
        self.rank: dict[tuple[int, int], int] = {}
        self.merged: list[int] = []
        for pair in spec["model"]["merges"]:
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.rank.setdefault((vocab[left], vocab[right]), len(self.merged))
            self.merged.append(vocab[left + right])
        #: Sufficient lookahead: a token that crosses a position ends within so many bytes behind it.
        self.lookahead = max(map(len, self.id), default=1)
        self.lengths = sorted({len(t) for t in self.id})
        keys = np.array([a << 32 | b for a, b in self.rank], np.int64)
        order = np.argsort(keys)
        self._pairs, self._pair_rank = keys[order], np.array([*self.rank.values()], np.int64)[order]
        self._merged, self._byte_ids = np.array(self.merged, np.int64), np.array(self.byte, np.int64)
        self._fits: dict[tuple[int, int], bool] = {}
        self._whole: dict[int, bool] = {}

    def merge(self, piece: bytes) -> list[int]:
        """Merges by rank, leftmost first, until none applies."""
        byte, rank, merged = self.byte, self.rank, self.merged
        ids = [byte[b] for b in piece]
        ranks = [rank.get(p, _NONE) for p in zip(ids, ids[1:])]
        while ranks:
            low = min(ranks)
            if low == _NONE:
                break
            i = ranks.index(low)
            ids[i : i + 2] = [merged[low]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank.get((ids[i - 1], ids[i]), _NONE)
            if i < len(ranks):
                ranks[i] = rank.get((ids[i], ids[i + 1]), _NONE)
        return ids

    def whole(self, token: int) -> bool:
        """Whether the token's bytes encode to the token itself."""
        if token not in self._whole:
            self._whole[token] = self.merge(self.token[token]) == [token]
        return self._whole[token]

    def fits(self, left: int, right: int) -> bool:
        """Whether the two tokens stay as they are side by side.

        A sequence is the encoding of its bytes exactly if every two neighbours fit.
        """
        key = (left, right)
        if key not in self._fits:
            if len(self._fits) >= REMEMBERED:
                self._fits.clear()
            self._fits[key] = self.merge(self.token[left] + self.token[right]) == [left, right]
        return self._fits[key]

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of neighbours, ``_NONE`` for pairs that never merge."""
        wanted = left << 32 | right
        at = np.searchsorted(self._pairs, wanted)
        at[at == len(self._pairs)] = 0
        return np.where(self._pairs[at] == wanted, self._pair_rank[at], _NONE)

    def merge_many(self, pieces: list[bytes]) -> list[bytes]:
        """:meth:`merge` of many pre-tokens at once: each round makes the first best merge of every one.

        Returns the ids of each as unsigned 32-bit little-endian bytes.
        """
        out = [b""] * len(pieces)
        sizes = np.array([len(p) for p in pieces], np.int64)
        which = np.flatnonzero(sizes)
        sizes = sizes[which]
        ids = self._byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        rank = np.full(len(ids), _NONE)
        if len(ids) > 1:
            rank[:-1] = self.ranks(ids[:-1], ids[1:])
        rank[np.cumsum(sizes) - 1] = _NONE
        while len(which):
            starts = np.cumsum(sizes) - sizes
            low = np.minimum.reduceat(rank, starts)
            ready = low == _NONE
            if ready.any():
                data = ids.astype("<u4").tobytes()
                for k, a, n in zip(which[ready].tolist(), starts[ready].tolist(), sizes[ready].tolist()):
                    out[k] = data[4 * a : 4 * (a + n)]
                on = np.repeat(~ready, sizes)
                ids, rank = ids[on], rank[on]
                which, sizes, low = which[~ready], sizes[~ready], low[~ready]
                if not len(which):
                    break
            owner = np.repeat(np.arange(len(which)), sizes)
            best = np.flatnonzero(rank == low[owner])
            best = best[np.append(True, owner[best][1:] != owner[best][:-1])]
            ids[best] = self._merged[low]
            stay = np.ones(len(ids), bool)
            stay[best + 1] = False
            # a pair that ended its pre-token takes that end along
            tail = rank[best + 1]
            ids, rank, owner = ids[stay], rank[stay], owner[stay]
            best -= np.arange(len(best))
            sizes -= 1
            last = np.cumsum(sizes) - 1
            rank[best] = tail
            inner = best[best < last]
            rank[inner] = self.ranks(ids[inner], ids[inner + 1])
            rank[last] = _NONE
            prior = best[best > last - sizes + 1] - 1
            rank[prior] = self.ranks(ids[prior], ids[prior + 1])
        return out

    def stream(self, blocks: Iterator[bytes]) -> Iterator[int]:
        """Tokens of one pre-token that arrives in blocks.

        For every end position the last token of the encoding up to there is unique. Any later
        token starts at one of the last ``lookahead`` positions, so what the encodings up to
        all of these have in common is stable and leaves; the rest is all that is kept.
        """
        kept, base = b"", 0  # bytes not yet emitted and the position of the first
        last: dict[int, int] = {}  # end position -> last token
        done = 0
        for block in blocks:
            kept += block
            for end in range(done + 1, base + len(kept) + 1):
                for n in self.lengths:
                    start = end - n
                    if start < base:
                        break
                    token = self.id.get(kept[start - base : end - base])
                    if token is None or not self.whole(token) or (start > base and start not in last):
                        continue
                    before = last.get(start)
                    if before is None or self.fits(before, token):
                        last[end] = token
                        break
            done = base + len(kept)
            common = self._ancestor(last, max(base, done - self.lookahead), done, base)
            if common > base:
                yield from self._path(last, common, base)
                # the token before the cut stays known, as the next one has to fit it
                last = {p: t for p, t in last.items() if p >= common}
                kept, base = kept[common - base :], common
        yield from self._path(last, done, base)

    def _ancestor(self, last: dict[int, int], low: int, high: int, base: int) -> int:
        """The last position that the encodings up to all ends from ``low`` to ``high`` pass."""
        live = set(range(low, high + 1)) & ({base} | last.keys())
        while len(live) > 1:
            far = max(live)
            live.remove(far)
            live.add(far - len(self.token[last[far]]))
        return live.pop() if live else base

    def _path(self, last: dict[int, int], end: int, base: int) -> list[int]:
        path = []
        while end > base:
            path.append(last[end])
            end -= len(self.token[last[end]])
        return path[::-1]


class Encoder:
    """Texts to ids, as unsigned 32-bit little-endian bytes."""

    def __init__(self, merges: Merges):
        self.merges = merges
        self.pretokens = regex.compile(PRETOKEN)
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(merges.special, key=len, reverse=True))) + ")") if merges.special else None
        #: White space, a space, and white space or the end: cuts at single spaces would be wrong there.
        self.unsafe = re.compile(r"\s (?:\s|$)")
        self.words: dict[str, bytes] = {}  # chunks that follow a space, without it
        self.pieces: dict[str, bytes] = {}

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Texts are cut into chunks; each distinct one is looked up once, and all not met before are encoded together."""
        heads: list[list] = []  # pre-tokens of every text, or of its first chunk; ids of special strings
        plain: list[int] = []  # texts cut at single spaces
        for i, text in enumerate(texts):
            if self.special is not None and any(s in text for s in self.merges.special):
                parts = self.special.split(text)
                heads.append([x for k, part in enumerate(parts) for x in ([array("I", [self.merges.special[part]]).tobytes()] if k % 2 else self.pretokens.findall(part))])
            elif self.unsafe.search(text):
                heads.append(self.pretokens.findall(text))
            else:
                plain.append(i)
                heads.append(self.pretokens.findall(text.partition(" ")[0]))
        cut = pc.split_pattern(pa.array([texts[i] for i in plain], pa.large_string()), " ")
        ends = cut.offsets.to_numpy()
        later = np.ones(len(cut.values), bool)
        later[ends[:-1]] = False
        coded = cut.values.filter(pa.array(later)).dictionary_encode()
        words = coded.dictionary.to_pylist()
        found = [*map(self.words.get, words)]
        open_words = [k for k, x in enumerate(found) if x is None]
        single = [words[k].isalpha() for k in open_words]
        parts = [" " + words[k] if one else self._pretokens(" " + words[k]) for k, one in zip(open_words, single)]
        wanted = {p for p, one in zip(parts, single) if one}
        wanted.update(p for own, one in zip(parts, single) if not one for p in own)
        wanted.update(p for own in heads for p in own if isinstance(p, str))
        pieces = self._settled(wanted)
        for k, own, one in zip(open_words, parts, single):
            found[k] = pieces[own] if one else b"".join(map(pieces.__getitem__, own))
        for k in open_words[: max(0, REMEMBERED - len(self.words))]:  # what comes first is what is common
            if len(words[k]) <= STREAM_FROM:
                self.words[words[k]] = found[k]
        # the ids of all chunks, one after the other
        sizes = np.fromiter(map(len, found), np.int64, len(found)) >> 2
        lists = pa.LargeListArray.from_arrays(np.append(0, np.cumsum(sizes)), pa.array(np.frombuffer(b"".join(found), "<u4")))
        taken = lists.take(coded.indices)
        upto, ids = taken.offsets.to_numpy(), taken.values.to_numpy()
        done = [b"".join(x if isinstance(x, bytes) else pieces[x] for x in head) for head in heads]
        bounds = upto[ends - np.arange(len(ends))].tolist()
        for i, a, b in zip(plain, bounds, bounds[1:]):
            done[i] += ids[a:b].tobytes()
        return done

    def _pretokens(self, chunk: str) -> list[str]:
        if chunk[1:].isalpha():
            return [chunk]
        if chunk[-1:] in ".," and chunk[1:-1].isalpha():
            return [chunk[:-1], chunk[-1]]
        return self.pretokens.findall(chunk)

    def _settled(self, pieces: set[str]) -> dict[str, bytes]:
        """The ids of pre-tokens; those that are not remembered are encoded together."""
        out, short = {}, []
        for piece in pieces:
            if (known := self.pieces.get(piece)) is not None:
                out[piece] = known
            else:
                short.append(piece)
        data = [piece.encode() for piece in short]
        for piece, long in [(p, d) for p, d in zip(short, data) if len(d) > STREAM_FROM]:
            blocks = (long[i : i + 1024] for i in range(0, len(long), 1024))
            out[piece] = array("I", self.merges.stream(blocks)).tobytes()
        short = [p for p, d in zip(short, data) if len(d) <= STREAM_FROM]
        new = dict(zip(short, self.merges.merge_many([d for d in data if len(d) <= STREAM_FROM])))
        self.pieces.update(islice(new.items(), max(0, REMEMBERED - len(self.pieces))))
        return out | new


class Decoder:
    """Ids to text: bytes enter in blocks, characters leave once their bytes are complete.

    Bytes that are no UTF-8 give the replacement character.
    """

    def __init__(self, merges: Merges):
        size = max(merges.token, default=-1) + 1
        self.table = [merges.token.get(i, b"") for i in range(size)]

    def __call__(self, ids: np.ndarray, block: int = 1 << 16) -> str:
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        table = self.table.__getitem__
        parts = [machine.decode(b"".join(map(table, ids[i : i + block].tolist()))) for i in range(0, len(ids), block)]
        return "".join([*parts, machine.decode(b"", True)])


class Vocabulary:
    """A vocabulary file, read on the driver and sent to the workers (its size is fixed by the file)."""

    def __init__(self, spark, path: str):
        with open(path, encoding="utf-8") as f:
            self._source = spark.sparkContext.broadcast(f.read())
        self.path = path

    def merges(self) -> Merges:
        return worker_state(f"merges {self.path}", lambda: Merges(self._source.value))

    def encoder(self) -> Encoder:
        return worker_state(f"encoder {self.path}", lambda: Encoder(self.merges()))

    def decoder(self) -> Decoder:
        return worker_state(f"decoder {self.path}", lambda: Decoder(self.merges()))


def encode(df: DataFrame, vocabulary: Vocabulary, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """Adds the token ids of ``text`` and, if ``decoded`` is named, the text they decode to."""

    def run(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        encoder = vocabulary.encoder()
        column = batch.column(text)
        coded = encoder([t or "" for t in column.to_pylist()])
        offsets = np.zeros(len(coded) + 1, np.int64)
        np.cumsum([len(c) // 4 for c in coded], out=offsets[1:])
        values = np.frombuffer(b"".join(coded), "<i4")
        lists = int_list(values, offsets)
        if column.null_count:
            lists = pa.ListArray.from_arrays(pa.array(np.append(offsets[:-1], offsets[-1]).astype(np.int32), mask=np.append(column.is_null().to_numpy(zero_copy_only=False), False)), pa.array(values, pa.int32()))
        out = {ids: lists}
        if decoded:
            out[decoded] = _texts(vocabulary, values, offsets, column.is_null().to_numpy(zero_copy_only=False))
        return out

    return add_in_arrow(df, f"`{ids}` array<int>" + (f", `{decoded}` string" if decoded else ""), run, stateful=True)


def decode(df: DataFrame, vocabulary: Vocabulary, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Adds the text of token ids; ids outside the vocabulary stand for nothing."""

    def run(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        rows = batch.column(ids).to_pylist()
        offsets = np.zeros(len(rows) + 1, np.int64)
        np.cumsum([len(r or ()) for r in rows], out=offsets[1:])
        top = len(vocabulary.decoder().table)
        values = np.array([i if i is not None and 0 <= i < top else -1 for r in rows for i in r or ()], np.int64)
        return {decoded: _texts(vocabulary, values, offsets, np.array([r is None for r in rows], bool))}

    return add_in_arrow(df, f"`{decoded}` string", run, stateful=True)


def _texts(vocabulary: Vocabulary, values: np.ndarray, offsets: np.ndarray, missing: np.ndarray) -> pa.Array:
    decoder = vocabulary.decoder()
    spans = zip(offsets[:-1].tolist(), offsets[1:].tolist(), missing.tolist())
    return pa.array([None if no else decoder(v[v >= 0]) for a, b, no in spans for v in (values[a:b],)], pa.string())
