"""Packing: documents become token sequences of a fixed length by Karmarkar-Karp multiway differencing.

Each partition packs its own documents in blocks of bounded size, so nothing is shuffled and a lost
executor's partition is simply packed again. Within a block:

1. A block ends where its ids nearly fill its windows. A document of `length` ids or more gives whole sequences; what
   is left of it, and every shorter document, is one item.
2. The last block of a partition first moves its odd remainder into sequences of power-of-two lengths,
   which need no padding, so that the rest nearly fills whole windows.
3. The items go into as few windows as leave a little room in each. Every item starts as a partial partition of its own.
   The two partial partitions whose sums differ most are merged, the largest sums of one with the
   smallest of the other, until one is left, whose sums are nearly equal.
4. What a window has beyond `length` ids, `excess` at most, is cut off its largest items and put where there is room:
   only so much is cut as differencing couldn't balance. If a window exceeds `length` by more, or all together by more
   than half of the others' room, the window count rises by one and the block is divided again.

Null text is an empty text: one piece of the end id alone. Repeated rows are packed once each. doc_id may be
null. Ties are told apart by the order of rows in a partition. A very long text is many whole sequences, and its ids
are held while they are placed. Further columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplework.llm import common
from ripplework.llm.tokens import BatchEncoder, with_end

#: Sequences of a partition are numbered from partition << SHIFT.
SHIFT = 40

SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, sequence_tokens long, ids binary"


def differencing(sizes: np.ndarray, k: int) -> list[list[int]]:
    """Divide items into k windows of nearly equal sums; the item numbers of each window."""
    n = len(sizes)
    if n == 0:
        return [[] for _ in range(k)]
    left, right = list(range(n)), [-1] * n  # tree nodes: the first n are items, the others unite two
    sums: dict[int, np.ndarray] = {i: np.array([sizes[i]], np.int64) for i in range(n)}
    tops: dict[int, np.ndarray] = {i: np.array([i]) for i in range(n)}
    spread = lambda s: int(s[0] - (s[-1] if len(s) == k else 0))
    heap = [(-spread(sums[i]), i) for i in range(n)]
    heapq.heapify(heap)
    at = n
    while len(heap) > 1:
        (_, a), (_, b) = heapq.heappop(heap), heapq.heappop(heap)
        sa, sb, ta, tb = sums.pop(a), sums.pop(b), tops.pop(a), tops.pop(b)
        both = len(sa) + len(sb) - k
        if both > 0:  # the smallest of a stand opposite the largest of b
            x, y = len(sa) - both, both
            joined = np.arange(len(left), len(left) + both)
            left.extend(ta[x:].tolist())
            right.extend(tb[:y][::-1].tolist())
            s = np.concatenate([sa[:x], sa[x:] + sb[:y][::-1], sb[y:]])
            t = np.concatenate([ta[:x], joined, tb[y:]])
        else:
            s, t = np.concatenate([sa, sb]), np.concatenate([ta, tb])
        order = np.argsort(-s, kind="stable")
        sums[at], tops[at] = s[order], t[order]
        heapq.heappush(heap, (-spread(sums[at]), at))
        at += 1
    windows = []
    for top in tops[heap[0][1]].tolist():
        items, stack = [], [top]
        while stack:
            x = stack.pop()
            if x < n:
                items.append(x)
            else:
                stack += (left[x], right[x])
        windows.append(sorted(items))
    return windows + [[] for _ in range(k - len(windows))]


def fitted(sizes: np.ndarray, length: int, room: int, excess: int = 0) -> list[list[int]]:
    """Windows, `room` below `length` on average at first, of at most `length`; of `excess` more where the others have twice the room for that."""
    k = max(1, -(-int(sizes.sum()) // (length - room)))
    while True:
        windows = differencing(sizes, k)
        sums = np.array([sizes[w].sum() for w in windows], np.int64)
        over, free = np.maximum(sums - length, 0), np.maximum(length - sums, 0)
        if over.max(initial=0) <= excess and 2 * over.sum() <= free.sum():
            return [w for w in windows if w]
        k += 1


def evened(sizes: np.ndarray, groups: list[list[int]], length: int) -> list[list[tuple[int, int, int]]]:
    """The windows as pieces (item, start, size): what exceeds `length` is cut off a window's largest pieces and put where most is free."""
    windows = [[(i, 0, int(sizes[i])) for i in w] for w in groups]
    sums = np.array([sizes[w].sum() for w in groups], np.int64)
    over, free = np.maximum(sums - length, 0), np.maximum(length - sums, 0)
    moved: list[tuple[int, int, int]] = []
    for w in np.flatnonzero(over).tolist():
        rest = int(over[w])
        while rest:
            at = max(range(len(windows[w])), key=lambda x: windows[w][x][2])  # noqa: B023
            item, start, size = windows[w].pop(at)
            cut = min(rest, size)
            if size > cut:
                windows[w].insert(at, (item, start, size - cut))
            moved.append((item, start + size - cut, cut))
            rest -= cut
    heap = [(-f, w) for w, f in enumerate(free.tolist()) if f]
    heapq.heapify(heap)
    for item, start, size in sorted(moved, key=lambda x: -x[2]):
        while size:
            f, w = heapq.heappop(heap)
            here = min(size, -f)
            windows[w].append((item, start, here))
            start, size = start + here, size - here
            if f + here:
                heapq.heappush(heap, (f + here, w))
    return [sorted(w) for w in windows if w]


class Packer:
    """Takes documents one by one and yields (document, start, length, sequence, offset, sequence_tokens), block by block."""

    def __init__(self, length: int, item: int, windows: int):
        self.length, self.item, self.excess = length, item, max(1, length // 8)
        self.room = max(1, length // 200)  # ids that a window may stay short of the length, so that differencing can balance
        self.most = (length - self.room) * windows
        self.items: list[tuple] = []  # document, start, length
        self.tokens = self.sequences = 0

    def _emit(self, pieces: list[tuple]) -> Iterator[tuple]:
        total, at = sum(p[2] for p in pieces), 0
        for doc, start, size in pieces:
            yield doc, start, size, self.sequences, at, total
            at += size
        self.sequences += 1

    def add(self, doc: object, size: int) -> Iterator[tuple]:
        start = 0
        while size - start >= self.length:
            yield from self._emit([(doc, start, self.length)])
            start += self.length
        while start < size:
            piece = min(self.item, size - start)
            self.items.append((doc, start, piece))
            self.tokens += piece
            start += piece
        if self.tokens >= self.most:
            over = self._take(self.tokens - self.most)  # opens the next block
            yield from self._block(self.items)
            self.items, self.tokens = over, sum(p[2] for p in over)

    def _block(self, items: list[tuple]) -> Iterator[tuple]:
        sizes = np.array([p[2] for p in items], np.int64)
        for window in evened(sizes, fitted(sizes, self.length, self.room, self.excess), self.length):
            # pieces of a document that meet in a window, end to start, are one piece again
            pieces: list[tuple] = []
            for i, within, size in window:
                doc, start = items[i][0], items[i][1] + within
                if pieces and pieces[-1][0] is doc and pieces[-1][1] + pieces[-1][2] == start:
                    pieces[-1] = (doc, pieces[-1][1], pieces[-1][2] + size)
                else:
                    pieces.append((doc, start, size))
            yield from self._emit(pieces)

    def _take(self, size: int) -> list[tuple]:
        """Pieces of exactly `size` ids from the end of the items, cutting one of them if need be."""
        out = []
        while size:
            doc, start, have = self.items.pop()
            if have > size:
                self.items.append((doc, start, have - size))
                start, have = start + have - size, size
            out.append((doc, start, have))
            size -= have
        return out[::-1]

    def finish(self) -> Iterator[tuple]:
        full, rest = divmod(self.tokens, self.length)
        step = max(1, self.length // 128)
        odd = min(-(-(rest + self.room * full) // step) * step, self.tokens) if full else self.tokens
        if odd >= self.length:
            odd = 0  # the windows are nearly full as they are
        for bit in reversed(range(odd.bit_length())):
            if odd >> bit & 1:
                yield from self._emit(self._take(1 << bit))
        yield from self._block(self.items)
        self.items, self.tokens = [], 0


def _tasks(tokenizer: str, end_id: int, length: int, item: int, windows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer = BatchEncoder(tokenizer), Packer(length, item, windows)
        first = TaskContext.get().partitionId() << SHIFT
        names = [x.split()[0] for x in SCHEMA.split(", ")]

        def rows(pieces: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
            out: list[tuple] = []
            for doc, start, size, sequence, offset, total in pieces:
                doc_id, ids = doc
                out.append((doc_id, start, size, len(ids), first + sequence, offset, total, ids[start : start + size].astype("<u4").tobytes()))
                if len(out) >= 2048:
                    yield batch(out)
                    out = []
            if out:
                yield batch(out)

        def batch(out: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.int64()] * 7 + [pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*out, strict=True), kinds, strict=True)], names)

        def pieces() -> Iterator[tuple]:
            for got in batches:
                ids, bounds = with_end(*encode(got.column(1)), end_id)
                for i, doc_id in enumerate(got.column(0).to_pylist()):
                    own = ids[bounds[i] : bounds[i + 1]]
                    yield from packer.add((doc_id, own), len(own))
            yield from packer.finish()

        yield from rows(pieces())

    return run


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 2, length: int = 4096, item: int | None = None, windows: int = 512) -> DataFrame:
    """Pieces of packed sequences, with their ids as little-endian unsigned 32-bit integers.

    docs: doc_id, text. length: ids of a sequence; item: ids that a part has at most before it is placed, all that
    don't fill a sequence by default; windows: sequences that are balanced together.
    """
    common.bound_batches(docs.sparkSession)
    return common.texts(docs).mapInArrow(_tasks(tokenizer, end_id, length, item or length, windows), SCHEMA)


def digest(pieces: DataFrame) -> DataFrame:
    """The pieces with a checksum in place of their ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "sequence_tokens")
