"""External induced sorting of the suffixes of one shard, with common-prefix values.

The order of a text's suffixes follows from the order of its leftmost S-type suffixes:
scanning the sorted suffixes, each one tells the place of its left neighbour, which enters
the queue of its first symbol. The queues together form a priority queue by first symbol
and order of arrival; they hold suffix tuples (position, length of the prefix shared with
the tuple before) and move to disk when they outgrow the memory they may take. The
leftmost S-type suffixes are named by their substrings, and the string of names, which has
too many symbols for queues, is sorted by prefix doubling: names and their order are in files
once they are large, and only what is still tied is sorted again, a piece at a time.

Plain numpy for use inside a Spark task; ``suffix_dedup`` deals out the shards.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np

#: Tuples kept in memory by all queues of a level, and handed on at once.
IN_MEMORY, BLOCK = 1 << 22, 1 << 20
#: Names sorted together in memory; equal names are, however many.
SMALL = 1 << 21
_TUPLE = np.dtype([("at", "<i8"), ("lcp", "u1")])


class Queues:
    """First-in first-out queues of tuples by symbol; what exceeds the memory is spilled to files."""

    def __init__(self, folder: Path, name: str, most: int = IN_MEMORY):
        self.folder, self.name, self.most = folder, name, most
        self.parts: dict[int, list] = {}
        self.held: dict[int, int] = {}
        self.total = self.files = 0

    def push(self, symbol: int, tuples: np.ndarray) -> None:
        self.parts.setdefault(symbol, []).append(tuples)
        self.held[symbol] = self.held.get(symbol, 0) + len(tuples)
        self.total += len(tuples)
        while self.total > self.most and self.held:
            self._spill(max(self.held, key=self.held.get))

    def _spill(self, symbol: int) -> None:
        """Writes what a queue holds in memory to a file of its own, in place of the parts in memory."""
        parts, loose = [], []
        for part in [*self.parts[symbol], None]:
            if isinstance(part, np.ndarray):
                loose.append(part)
                continue
            if loose:
                path = self.folder / f"{self.name}-{self.files}"
                self.files += 1
                np.concatenate(loose).tofile(path)
                parts.append(path)
                loose = []
            if part is not None:
                parts.append(part)
        self.parts[symbol] = parts
        self.total -= self.held.pop(symbol)

    def _load(self, part, backwards: bool) -> Iterator[np.ndarray]:
        if isinstance(part, np.ndarray):
            yield part[::-1] if backwards else part
            return
        size = part.stat().st_size // _TUPLE.itemsize
        starts = range(0, size, BLOCK)
        for start in reversed(starts) if backwards else starts:
            block = np.fromfile(part, _TUPLE, min(BLOCK, size - start), offset=start * _TUPLE.itemsize)
            yield block[::-1] if backwards else block

    @staticmethod
    def _joined(parts: list) -> Iterator:
        """Parts in order, neighbours in memory joined up to a block."""
        loose, size = [], 0
        for part in parts:
            if loose and (not isinstance(part, np.ndarray) or size + len(part) > BLOCK):
                yield np.concatenate(loose)
                loose, size = [], 0
            if isinstance(part, np.ndarray):
                loose.append(part)
                size += len(part)
            else:
                yield part
        if loose:
            yield np.concatenate(loose)

    def drain(self, symbol: int) -> Iterator[np.ndarray]:
        """Empties a queue, including what is pushed to it meanwhile."""
        while self.parts.get(symbol):
            taken, self.parts[symbol] = self.parts[symbol], []
            self.total -= self.held.pop(symbol, 0)
            for part in self._joined(taken):
                yield from self._load(part, False)
                if isinstance(part, Path):
                    part.unlink()
        self.parts.pop(symbol, None)

    def read(self, symbol: int, backwards: bool = False) -> Iterator[np.ndarray]:
        parts = list(self._joined(self.parts.get(symbol, [])))
        for part in reversed(parts) if backwards else parts:
            yield from self._load(part, backwards)


def room(folder: Path | None, size: int, kind) -> np.ndarray:
    """A zeroed array, in a file if it is large."""
    if folder is None or size <= IN_MEMORY:
        return np.zeros(size, kind)
    with tempfile.NamedTemporaryFile(dir=folder) as file:  # the mapping outlives the name
        return np.asarray(np.memmap(file, kind, "w+", shape=(size,)))


def s_types(text: np.ndarray, folder: Path | None = None) -> np.ndarray:
    """Whether each suffix is smaller than the one after it; the end counts as smallest."""
    n = len(text)
    out = room(folder, n, bool)
    later, first = False, -1
    for end in range(n, 0, -BLOCK):
        start = max(0, end - BLOCK)
        own = np.asarray(text[start:end]).astype(np.int64)
        after = np.append(own[1:], first)
        differs = own != after
        nearest = np.where(differs, np.arange(len(own)), len(own))
        nearest = np.minimum.accumulate(nearest[::-1])[::-1]
        out[start:end] = np.where(nearest < len(own), (own < after)[np.minimum(nearest, len(own) - 1)], later)
        later, first = bool(out[start]), int(own[0])
    return out


def shared(text: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Length of the common prefix of the suffixes at ``a`` and ``b``, at most ``most``."""
    n, size = len(text), np.zeros(len(a), np.int64)
    if text.dtype == np.uint8 and n >= 8:
        words = np.ndarray((n - 7,), "<u8", text, 0, (1,))
        live = np.arange(len(a))
        for step in range(0, most, 8):
            x, y = a[live] + step, b[live] + step
            fits = np.maximum(x, y) + 8 <= n
            live, x, y = live[fits], x[fits], y[fits]
            apart = words[x] ^ words[y]
            same = np.where(apart == 0, 8, np.bitwise_count((apart & (~apart + np.uint64(1))) - np.uint64(1)) >> 3)
            size[live] += same
            live = live[same == 8]
            if not len(live):
                break
    # what is left: text ends, and symbols that are no bytes
    live = np.flatnonzero((size < most) & (np.maximum(a, b) + size < n))
    while len(live):
        live = live[text[a[live] + size[live]] == text[b[live] + size[live]]]
        size[live] += 1
        live = live[(size[live] < most) & (np.maximum(a[live], b[live]) + size[live] < n)]
    return np.minimum(size, most)


class _Scan:
    """Turns tuples scanned in order into tuples of their left neighbours, with common prefixes.

    The prefix that two neighbours of scanned suffixes share is one symbol and what lies
    between the two in the scan at least shares; that minimum is kept per target symbol.
    """

    def __init__(self, text: np.ndarray, small: np.ndarray, want_small: bool, most: int, alphabet: int):
        self.text, self.small, self.want_small, self.most = text, small, want_small, most
        self.since = np.zeros(alphabet, np.uint8) if most else None

    def push(self, tuples: np.ndarray, queues: Queues) -> None:
        at, lcp = tuples["at"], tuples["lcp"]
        left = at - 1
        on = np.flatnonzero((left >= 0) & (self.small[left] == self.want_small))
        if len(on):
            left = left[on]
            symbol = self.text[left]  # sorted fastest as bytes
            order = np.argsort(symbol, kind="stable")
            symbol, left, on = symbol[order], left[order], on[order]
            cuts = np.flatnonzero(np.append(True, symbol[1:] != symbol[:-1]))
            out = np.zeros(len(left), _TUPLE)
            out["at"] = left
            if self.most:
                table = [lcp]
                while 1 << len(table) <= len(lcp):
                    half = 1 << (len(table) - 1)
                    table.append(np.minimum(table[-1][:-half], table[-1][half:]))
                start = np.append(0, on[:-1] + 1)
                start[cuts] = 0
                least = _range_min(table, start, on)
                least[cuts] = np.minimum(least[cuts], self.since[symbol[cuts]])
                out["lcp"] = np.minimum(least.astype(np.int64) + 1, self.most)
                ends = np.append(cuts[1:], len(on)) - 1
                rest = on[ends] + 1
                tail = np.full(len(cuts), 255, np.uint8)
                more = rest < len(lcp)
                tail[more] = _range_min(table, rest[more], np.full(more.sum(), len(lcp) - 1))
                np.minimum(self.since, lcp.min(), out=self.since)
                self.since[symbol[cuts]] = tail
            for a, b, s in zip(cuts.tolist(), np.append(cuts[1:], len(left)).tolist(), symbol[cuts].tolist()):
                queues.push(s, out[a:b])
        elif self.most and len(lcp):
            np.minimum(self.since, lcp.min(), out=self.since)


def _range_min(table: list[np.ndarray], first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Minimum of ``table[0][first .. last]`` by a sparse table."""
    level = np.frexp((last - first + 1).astype(float))[1] - 1
    out = np.empty(len(first), np.uint8)
    for k in np.unique(level).tolist():
        on = level == k
        out[on] = np.minimum(table[k][first[on]], table[k][last[on] - (1 << k) + 1])
    return out


def _induce(text: np.ndarray, small: np.ndarray, seeds: dict[int, np.ndarray], folder: Path, name: str, most: int):
    """Both scans over sorted ``seeds``; gives the symbols and the queues of L-type and, backwards, S-type suffixes."""
    symbols = sorted(set().union(*(np.unique(text[i : i + BLOCK]).tolist() for i in range(0, len(text), BLOCK))))
    alphabet = int(symbols[-1]) + 1 if most else 0
    rising, large = Queues(folder, f"{name}-l"), Queues(folder, f"{name}-L")
    scan = _Scan(text, small, False, most, alphabet)
    start = np.zeros(1, _TUPLE)
    start["at"] = len(text)
    scan.push(start, rising)
    for c in symbols:
        last = None
        fresh = True
        for block in rising.drain(c):
            if fresh:
                block = block.copy()
                block["lcp"][0] = 0
                fresh = False
            large.push(c, block)
            scan.push(block, rising)
            last = int(block["at"][-1])
        own = seeds.get(c)
        if own is not None and len(own):
            own = own.copy()
            own["lcp"][0] = _seam(text, last, int(own["at"][0]), most)
            scan.push(own, rising)
    falling, less = Queues(folder, f"{name}-s"), Queues(folder, f"{name}-S")
    scan = _Scan(text, small, True, most, alphabet)
    for c in reversed(symbols):
        last = None
        fresh = True
        for block in falling.drain(c):
            if fresh:
                block = block.copy()
                block["lcp"][0] = 0
                fresh = False
            less.push(c, block)
            scan.push(block, falling)
            last = int(block["at"][-1])
        carry = None
        for block in large.read(c, backwards=True):
            # a tuple knows what it shares with the one before it; backwards, with the one scanned just now
            turned = block.copy()
            turned["lcp"][1:] = block["lcp"][:-1]
            turned["lcp"][0] = _seam(text, last, int(block["at"][0]), most) if carry is None else carry
            carry = block["lcp"][-1]
            scan.push(turned, falling)
    return symbols, large, less


def _seam(text: np.ndarray, a: int | None, b: int, most: int) -> int:
    return 0 if a is None or not most else int(shared(text, np.array([a]), np.array([b]), most)[0])


def _by_symbol(text: np.ndarray, at: np.ndarray, lcp: np.ndarray | None) -> dict[int, np.ndarray]:
    symbol = text[at]
    order = np.argsort(symbol, kind="stable")
    symbol = symbol[order]
    cuts = np.flatnonzero(np.append(True, symbol[1:] != symbol[:-1])) if len(at) else np.zeros(0, np.int64)
    tuples = np.zeros(len(at), _TUPLE)
    tuples["at"] = at[order]
    if lcp is not None:
        tuples["lcp"] = lcp[order]
    return {int(symbol[a]): tuples[a:b] for a, b in zip(cuts.tolist(), np.append(cuts[1:], len(at)).tolist())}


def _sorted_seeds(text: np.ndarray, small: np.ndarray, folder: Path, name: str, depth: int, limit: int) -> np.ndarray:
    """Positions of the leftmost S-type suffixes in suffix order."""
    seed = np.flatnonzero(small & np.append(False, ~small[:-1]))
    if len(seed) < 2:
        return seed
    symbols, _, less = _induce(text, small, _by_symbol(text, seed, None), folder, f"{name}-n", 0)
    is_seed = room(folder, len(text), bool)
    is_seed[seed] = True
    order = np.concatenate([p for c in symbols for block in less.read(c, backwards=True) for p in (block["at"][is_seed[block["at"]]],)])
    # substrings reach to the next seed, and the last one to the end of the text
    until = np.append(seed[1:] + 1, len(text))
    length = room(folder, len(text), np.int64)
    length[seed] = until - seed
    names = room(folder, len(order), np.int64)
    name = 1
    for at in range(0, len(order), BLOCK):
        b = order[at : at + BLOCK]
        a = order[max(at - 1, 0) : at + len(b) - 1]
        b = b[len(b) - len(a) :]  # the first of all has none before it
        pairs = np.flatnonzero((length[a] == length[b]) & (b != seed[-1]) & (a != seed[-1]))
        width = length[a[pairs]]
        differs = np.ones(len(a), np.int64)
        differs[pairs] = shared(text, a[pairs], b[pairs], int(width.max(initial=0))) < width
        own = name + np.cumsum(differs)
        names[at : at + BLOCK] = own if at else np.append(name, own)
        name = int(names[min(at + BLOCK, len(order)) - 1])
    if name == len(order):
        return order
    length[order] = names
    del order, names, a, b, pairs, width, differs, own
    return seed[_doubled(length[seed], depth, limit, folder)]


def _by_name(string: np.ndarray, folder: Path | None) -> tuple[np.ndarray, np.ndarray]:
    """Places of a string of names from 1 on in order of their names, and how many names at all are smaller than each, plus one."""
    n = len(string)
    first = np.append(0, np.cumsum(np.bincount(string)))[:-1]
    rank, order, filled = room(folder, n, np.int64), room(folder, n, np.int64), first.copy()
    for start in range(0, n, BLOCK):
        own = string[start : start + BLOCK]
        rank[start : start + BLOCK] = first[own] + 1
        at = np.argsort(own, kind="stable")
        own = own[at]
        cuts = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        many = np.diff(np.append(cuts, len(own)))
        order[filled[own] + np.arange(len(own)) - np.repeat(cuts, many)] = at + start
        filled[own[cuts]] += many
    return order, rank


def _doubled(string: np.ndarray, depth: int, limit: int = SMALL, folder: Path | None = None) -> np.ndarray:
    """Suffixes of a string of names in order of at least their first ``depth`` names, by prefix doubling.

    A suffix has the rank of the first it is tied with. Ties that are broken count at once, also for what is sorted later in the
    same round: ranks only get finer. ``limit`` names are sorted at a time, or a larger tie.
    """
    n, h = len(string), 1
    order, rank = _by_name(string, folder)
    tied = np.ones(-(-n // limit), bool)  # pieces of the order with ties that begin there
    while h < min(depth, n) and tied.any():
        for piece in np.flatnonzero(tied).tolist():
            # ties that begin in the piece, to the end of the last one
            a, b = piece * limit, min((piece + 1) * limit, n)
            own = rank[order[a:b]]
            a += int(np.searchsorted(own, a + 1))
            if a >= b:
                tied[piece] = False
                continue
            last = own[-1]
            step = limit
            while b < n and rank[order[b]] == last:
                more = rank[order[b : b + step]]
                b += int(np.searchsorted(more, last, "right"))
                step *= 2
            at = order[a:b]
            own = rank[at]
            fresh = np.append(True, own[1:] != own[:-1])
            live = np.flatnonzero(~(fresh & np.append(fresh[1:], True)))
            if not len(live):
                tied[piece] = False
                continue
            tied[piece : -(-b // limit)] = True  # a tie that is broken leaves others, which begin further on
            at, own = at[live], own[live]
            key = np.zeros(len(at), np.int64)
            inside = at + h < n
            key[inside] = rank[at[inside] + h]
            key |= own << 32
            turn = np.argsort(key)
            at, key = at[turn], key[turn]
            fresh = np.append(True, key[1:] != key[:-1])
            order[a + live] = at
            # the place in the order of the first that is tied
            rank[at] = np.maximum.accumulate(np.where(fresh, a + live + 1, 0))
        h *= 2
    return order


def sorted_suffixes(text: np.ndarray, folder: Path, most: int, name: str = "t", depth: int = 1 << 40, limit: int = SMALL) -> Iterator[np.ndarray]:
    """All suffixes in order, as blocks of tuples; ``lcp`` is shared with the suffix before, at most ``most`` (below 255).

    The order is that of the first ``depth`` symbols at least. With ``most`` 0, no prefixes are computed.
    """
    if not len(text):
        return
    small = s_types(text, folder)
    seeds = _sorted_seeds(text, small, folder, name, depth, limit)
    lcp = np.zeros(len(seeds), np.uint8)
    for at in range(1, len(seeds) if most else 0, BLOCK):
        own = seeds[at : at + BLOCK]
        lcp[at : at + BLOCK] = shared(text, seeds[at - 1 : at - 1 + len(own)], own, most)
    symbols, large, less = _induce(text, small, _by_symbol(text, seeds, lcp), folder, name, most)
    for c in symbols:
        last = None
        for block in large.read(c):
            yield block
            last = int(block["at"][-1])
        before = None
        for block in less.read(c, backwards=True):
            turned = block.copy()
            turned["lcp"][1:] = block["lcp"][:-1]
            turned["lcp"][0] = _seam(text, last, int(block["at"][0]), most) if before is None else before
            before = block["lcp"][-1]
            yield turned


def repeated_starts(text: np.ndarray, match: int, limit: int = SMALL) -> np.ndarray:
    """Whether the ``match`` symbols from each position also start elsewhere in the text."""
    with tempfile.TemporaryDirectory(prefix="suffixes-") as folder:
        again = room(Path(folder), len(text), bool)
        last = None
        for block in sorted_suffixes(text, Path(folder), match, depth=match, limit=limit):
            hit = np.flatnonzero(block["lcp"] >= match)
            again[block["at"][hit]] = True
            again[block["at"][hit[hit > 0] - 1]] = True
            if len(hit) and hit[0] == 0 and last is not None:
                again[last] = True
            last = int(block["at"][-1])
    return again
