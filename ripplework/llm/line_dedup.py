"""Line dedup by pairwise alignment: documents that share rare lines are aligned, and common blocks go from the later one.

A line is a sentence, or the part of one, up to a line break: running text often has whole passages on one line.
Sentences end at . ! ? and their full-width forms, quotation marks and brackets after them included. A line of more
than LONG words is cut further, after words that a hash chooses, so that a passage in its middle is cut alike in
every document. Lines are compared by a 64-bit hash of their bytes without the blanks around; lines without words
are passed over.

1. An anchor is a line joined with the next ones that it takes to have `block_words` words, known by one hash. A block
   of `block_words` words or more that two documents share begins with an anchor that they share, and so does each
   line of it, up to the last ones, of fewer words than that together.
2. Each document that has an anchor is paired with the first one that has it (smallest doc_id). A rare anchor, of two
   documents, so proposes the pair of these; a frequent one, of n, proposes n - 1 pairs instead of all, and none
   is too frequent to count. The last lines of a block, of fewer than `block_words` words together, are looked for in
   the first document that has the anchor before them.
3. Each pair is aligned by patience diff, over the lines that their shared anchors reach: lines that occur once in both
   are matched in the longest common order, and what lies between two matches is aligned in the same way. Matches that
   follow each other in both documents form a block; blocks of at least `block_words` words count. What is left is
   aligned again, for blocks in another order, until none is found; stretches of `block_words` words that stand
   several times in the later document are found by looking up all of the earlier one's.
4. The lines of a later document's blocks, each measured within its own pair, are united and go. Blank lines between
   two lines that go, go with them. The rest of the text stays as it is, byte for byte.

Pairs carry only those lines of the later document that its anchors reach, so a long document with many partners isn't
repeated whole; an earlier one is looked up by the lines of the later. Anchors that more than one in HOT of all lines
begin can't be more than HOT; they are broadcast, and the others are joined, so no task gets all rows of a hot anchor.
Texts meet their removals once, in a join that doesn't sort them. A text that is a copy of an earlier one is emptied.

Null text is empty and stays null. Null doc_id counts as the smallest. Rows that share a doc_id are one document
for the order and don't lose lines to each other; each has its own text shortened. Very long texts are cut and aligned
whole. Further columns stay, but for lines_removed and words_removed, which are replaced; an empty table gives no rows.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from ripplework.llm import common

FIRST = -(1 << 63)
BLANK = b" \t\n\x0b\x0c\r"
#: A sentence's end and the quotation marks and brackets after it.
CLOSED = re.compile(rb"[.!?](?:[\"')\]]|\xe2\x80[\x99\x9d]|\xc2\xbb)+\Z")
#: Words of a line at most before it is cut by content, and one in how many words ends a part.
LONG, STEP = 40, 8
HOT = 1 << 11
_BASE = np.uint64(0x9E3779B97F4A7C15)
LINES = "doc long, text_hash long, hashes array<long>, words array<int>, anchors array<long>"


_SPACE = np.zeros(256, bool)
_SPACE[list(BLANK)] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".!?")] = True
#: Last bytes of quotation marks and brackets that may stand between a sentence's end and the blank after it.
_CLOSER = np.zeros(256, bool)
_CLOSER[list(b"\"')]\x99\x9d\xbb")] = True


class Layout:
    """Lines of texts that are laid out one after another, a line break after each.

    bounds: of lines, blank ones too; text: of each line; words: of each line; low, high: bounds of its words.
    """

    def __init__(self, texts: list[bytes]):
        import xxhash

        self.raw = b"\n".join([*texts, b""])
        data = np.frombuffer(self.raw, np.uint8)
        self.starts = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)])
        cut = np.zeros(len(data) + 1, bool)  # whether a line ends before a place
        cut[1:] = data == 10
        if len(data) > 3:
            blank = data[1:] == 32
            cut[2:] |= blank & _STOP[data[:-1]]
            for at in np.flatnonzero(blank & _CLOSER[data[:-1]]).tolist():
                cut[at + 2] |= CLOSED.search(self.raw, max(0, at - 40), at + 1) is not None
            cut[3:] |= (data[:-2] == 0xE3) & (data[1:-1] == 0x80) & (data[2:] == 0x82)
            cut[3:] |= (data[:-2] == 0xEF) & (data[1:-1] == 0xBC) & ((data[2:] == 0x81) | (data[2:] == 0x9F))
        space = _SPACE[data]
        begins = ~space
        begins[1:] &= space[:-1] | cut[1:-1]
        ends = np.zeros(len(data) + 1, bool)
        ends[1:] = ~space
        ends[1:-1] &= space[1:] | cut[1:-1]
        begin, end = np.flatnonzero(begins), np.flatnonzero(ends)
        cuts = np.flatnonzero(cut)
        upto = np.searchsorted(begin, cuts)  # words before the end of each line
        words = np.diff(upto, prepend=0)
        more = []
        for line in np.flatnonzero(words > LONG).tolist():
            for w in range(upto[line] - words[line], upto[line] - 1):
                if xxhash.xxh32_intdigest(self.raw[begin[w] : end[w]]) % STEP == 0:
                    more.append(end[w])
        if more:
            cuts = np.sort(np.concatenate([cuts, np.array(more, np.int64)]))
            upto = np.searchsorted(begin, cuts)
            words = np.diff(upto, prepend=0)
        self.bounds = np.concatenate([[0], cuts])
        self.words = words.astype(np.int64)
        self.text = np.searchsorted(self.starts, self.bounds[:-1], "right") - 1
        self.low, self.high = begin[np.minimum(upto - words, len(begin) - 1)] if len(begin) else upto, end[np.maximum(upto - 1, 0)] if len(end) else upto


def lines_of(text: bytes) -> list[bytes]:
    """The lines, with the blanks after them, so that they join to the text again."""
    bounds = Layout([text]).bounds.tolist()
    bounds[-1] -= 1
    return [text[a:b] for a, b in zip(bounds, bounds[1:], strict=False) if a < b]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def ends_of(words: np.ndarray, block_words: int) -> np.ndarray:
    """Where the shortest run from each line that has block_words words ends (exclusive); beyond the last line if there is none."""
    total = np.concatenate([[0], np.cumsum(words, dtype=np.int64)])
    return np.searchsorted(total, total[:-1] + block_words)


def anchors_of(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of runs of lines."""
    out = np.full(len(starts), _BASE, np.uint64)
    size = ends - starts
    for k in range(int(size.max(initial=0))):
        live = np.flatnonzero(size > k)
        out[live] = _mixed(out[live] * np.uint64(31) + hashes[starts[live] + k])
    return out


def _sketch(block_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        digest = xxhash.xxh64_intdigest
        for got in batches:
            texts = got.column("text").cast(pa.binary()).to_pylist()
            laid = Layout(texts)
            full = np.flatnonzero(laid.words > 0)
            words, text = laid.words[full], laid.text[full]
            raw = memoryview(laid.raw)
            hashes = np.fromiter((digest(raw[a:b]) for a, b in zip(laid.low[full].tolist(), laid.high[full].tolist(), strict=True)), np.uint64, len(full))
            of_text = np.searchsorted(text, np.arange(len(texts) + 1))
            ends = ends_of(words, block_words)
            begun = np.flatnonzero(ends <= of_text[1:][text]) if len(full) else full
            anchors = anchors_of(hashes, begun, ends[begun])
            of_anchor = np.searchsorted(begun, of_text)
            columns = [(of_text, hashes.view(np.int64)), (of_text, words.astype(np.int32)), (of_anchor, anchors.view(np.int64))]
            lists = [pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values)) for at, values in columns]
            yield pa.RecordBatch.from_arrays([got.column("doc"), got.column("text_hash"), *lists], [x.split()[0] for x in LINES.split(", ")])

    return run


def sketch(docs: DataFrame, block_words: int) -> DataFrame:
    """doc (the order), text_hash, hash and words of each line that has any, and the anchor of each but the last ones."""
    keyed = docs.select(F.coalesce("doc_id", F.lit(FIRST)).alias("doc"), F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("text").alias("text_hash"))
    return keyed.mapInArrow(_sketch(block_words), LINES)


def shared_anchors(sketched: DataFrame) -> tuple[DataFrame, int]:
    """doc, text_hash, anchor, first, n: anchors that at least two documents have, the first document that has each, and how many lines begin it. With it a bound: fewer than HOT anchors are begun by more lines."""
    limit = (sketched.agg(F.sum(F.size("anchors"))).first()[0] or 0) // HOT + 1
    began = sketched.select("doc", "text_hash", F.explode("anchors").alias("anchor"))
    groups = began.groupBy("anchor").agg(F.min("doc").alias("first"), F.max("doc").alias("last"), F.count("*").alias("n")).where("first < last").drop("last")
    groups = common.staged(groups, "anchors")
    hot = F.broadcast(groups.where(F.col("n") > limit))
    often = began.join(hot, "anchor")
    seldom = began.join(hot.select("anchor"), "anchor", "left_anti").join(groups.where(F.col("n") <= limit), "anchor")
    return often.unionByName(seldom), limit


PARTS = "doc long, text_hash long, first long, first_hash long, places array<int>, hashes array<long>, words array<int>"


def _parts(block_words: int):
    """For each document that a document is paired with, the lines that their anchors reach: up to the end of the next line's anchor, where a block that goes on ends at the latest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in PARTS.split(", ")]
        kinds = [pa.int64()] * 4 + [pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32())]
        for got in batches:
            rows = []
            for doc, text_hash, hashes, words, anchors, shared in zip(*(got.column(c).to_pylist() for c in ("doc", "text_hash", "hashes", "words", "anchors", "shared")), strict=True):
                partner = {x["anchor"]: (x["first"], x["first_hash"]) for x in shared}
                ends = [*np.minimum(ends_of(np.array(words, np.int32), block_words), len(words)).tolist(), len(words)]
                reached: dict[tuple[int, int], list[int]] = {}
                for place, anchor in enumerate(anchors):
                    if (first := partner.get(anchor)) is not None:
                        own = reached.setdefault(first, [])
                        own.extend(range(max(place, own[-1] + 1 if own else 0), ends[place + 1]))
                rows += [(doc, text_hash, *first, own, [hashes[i] for i in own], [words[i] for i in own]) for first, own in reached.items()]
            columns = zip(*rows, strict=True) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names)

    return run


def _chain(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence, of pairs in order of their first number, whose second numbers ascend."""
    tops: list[int] = []
    at: list[int] = []
    back: list[int] = []
    for i, (_, j) in enumerate(pairs):
        k = bisect_left(tops, j)
        back.append(at[k - 1] if k else -1)
        if k == len(tops):
            tops.append(j)
            at.append(i)
        else:
            tops[k], at[k] = j, i
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def _counted(lines: Sequence[int]) -> list[tuple[int, int]]:
    """Each line with the number of times that it has stood before."""
    seen: Counter[int] = Counter()
    out = []
    for x in lines:
        out.append((x, seen[x]))
        seen[x] += 1
    return out


def patience(a: Sequence[int], b: Sequence[int]) -> list[tuple[int, int]]:
    """Matched places of a and b, ascending in both."""
    found: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            found.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            found.append((a1, b1))
        if a0 == a1 or b0 == b1 or set(a[a0:a1]).isdisjoint(b[b0:b1]):
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {x: j for j, x in enumerate(b[b0:b1], b0) if in_b[x] == 1 and in_a.get(x) == 1}
        chain = _chain([(i, place[x]) for i, x in enumerate(a[a0:a1], a0) if x in place])
        if not chain:  # no unique line: tell occurrences apart
            counted = {x: j for j, x in enumerate(_counted(b[b0:b1]), b0)}
            chain = _chain([(i, counted[x]) for i, x in enumerate(_counted(a[a0:a1]), a0) if x in counted])
        if not chain:
            continue
        found += chain
        i0, j0 = a0, b0
        for i, j in [*chain, (a1, b1)]:
            if i > i0 and j > j0:
                todo.append((i0, i, j0, j))
            i0, j0 = i + 1, j + 1
    return sorted(found)


def _stretches(places: list[int], words: list[int], block_words: int) -> Iterator[tuple[int, int]]:
    """Bounds of the shortest stretches of lines in a row with at least block_words words, up to each line and from each line on."""
    cuts = [0, *(i for i in range(1, len(places)) if places[i] != places[i - 1] + 1), len(places)]
    for low, high in zip(cuts, cuts[1:], strict=False):
        i = low
        size = 0
        for j in range(low, high):
            size += words[j]
            while size - words[i] >= block_words:
                size -= words[i]
                i += 1
            if size >= block_words:
                yield i, j + 1
        j, size = low, 0
        for i in range(low, high):
            while size < block_words and j < high:
                size += words[j]
                j += 1
            if size < block_words:
                break
            yield i, j
            size -= words[i]


#: Lines of one document: places, hashes, words; places that follow each other are lines in a row.
Side = tuple[list[int], list[int], list[int]]


def common_blocks(later: Side, first: Side, block_words: int) -> set[int]:
    """Places of the later document's lines in blocks of at least block_words words that the earlier one has too."""
    places, lines, words = later
    places_b, lines_b, words_b = first
    gone: set[int] = set()
    rest_a, rest_b = list(range(len(lines))), list(range(len(lines_b)))
    while rest_a and rest_b:
        blocks: list[list[tuple[int, int]]] = []
        for i, j in patience([lines[i] for i in rest_a], [lines_b[j] for j in rest_b]):
            i, j = rest_a[i], rest_b[j]
            if blocks and places[i] == places[blocks[-1][-1][0]] + 1 and places_b[j] == places_b[blocks[-1][-1][1]] + 1:
                blocks[-1].append((i, j))
            else:
                blocks.append([(i, j)])
        found = [m for block in blocks if sum(words[i] for i, _ in block) >= block_words for m in block]
        if not found:
            break
        gone.update(i for i, _ in found)
        rest_a = [i for i in rest_a if i not in gone]
        taken = {j for _, j in found}
        rest_b = [j for j in rest_b if j not in taken]
    if rest_a:  # what stands several times, or overlaps what has been aligned
        known = {tuple(lines_b[i:j]) for i, j in _stretches(places_b, words_b, block_words)}
        for i, j in _stretches(places, words, block_words):
            if tuple(lines[i:j]) in known:
                gone.update(range(i, j))
    return {places[i] for i in gone}


def _align(block_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, index = None, {}
        for got in batches:
            out = []
            whole = got.column("first_lines")
            for i, (first, first_hash, places, hashes, words) in enumerate(zip(*(got.column(c).to_pylist() for c in ("first", "first_hash", "places", "hashes", "words")), strict=True)):
                if known != (first, first_hash):
                    known, index = (first, first_hash), {}
                    for j, x in enumerate(whole[i].as_py()):
                        index.setdefault(x, []).append(j)
                size = dict(zip(hashes, words, strict=True))
                there = sorted((j, x) for x in size for j in index.get(x, ()))
                found = common_blocks((places, hashes, words), ([j for j, _ in there], [x for _, x in there], [size[x] for _, x in there]), block_words)
                out.append(sorted(found))
            yield pa.RecordBatch.from_arrays([got.column("doc"), got.column("text_hash"), pa.array(out, pa.list_(pa.int32()))], ["doc", "text_hash", "places"])

    return run


def removals(docs: DataFrame, block_words: int) -> DataFrame:
    """doc, text_hash and the lines with words (places among them) to remove, for documents that lose any."""
    spark, key = docs.sparkSession, ["doc", "text_hash"]
    common.bound_batches(spark)
    sketched = common.staged(sketch(docs, block_words), "lines")
    shared, limit = shared_anchors(sketched)
    shared = common.staged(shared, "shared")
    firsts = shared.where("doc = first").groupBy("anchor").agg(F.min("text_hash").alias("first_hash"), F.first("n").alias("many"))
    later = shared.where("doc <> first")
    often = later.where(F.col("n") > limit).join(F.broadcast(firsts.where(F.col("many") > limit)), "anchor")
    seldom = later.where(F.col("n") <= limit).join(firsts.where(F.col("many") <= limit), "anchor")
    own = often.unionByName(seldom).groupBy(*key).agg(F.collect_set(F.struct("anchor", "first", "first_hash")).alias("shared"))  # of one text
    parts = own.join(sketched, key).mapInArrow(_parts(block_words), PARTS)
    first = sketched.select(F.col("doc").alias("first"), F.col("text_hash").alias("first_hash"), F.col("hashes").alias("first_lines"))
    found = parts.join(first, ["first", "first_hash"]).mapInArrow(_align(block_words), "doc long, text_hash long, places array<int>")
    return found.groupBy(*key).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("places")))).alias("places")).where(F.size("places") > 0)


def shortened(texts: list[bytes], gone: list[list[int]]) -> list[tuple[bytes, int, int]]:
    """Each text without the lines with words at its places, and the blank lines between two of them; how many lines and words went."""
    laid = Layout(texts)
    out = []
    of_text = np.searchsorted(laid.text, np.arange(len(texts) + 1))
    for k, places in enumerate(gone):
        a, b = of_text[k], of_text[k + 1]
        full = laid.words[a:b] > 0
        at = np.cumsum(full) - 1  # the line with words at or before each line
        lost = np.zeros(int(full.sum()) + 2, bool)
        lost[places] = True
        go = np.where(full, lost[at], (at >= 0) & lost[at] & lost[at + 1])
        bounds = laid.bounds[a : b + 1]
        left = b"".join(laid.raw[bounds[i] : bounds[i + 1]] for i in np.flatnonzero(~go).tolist())
        if not go[-1]:
            left = left[:-1]  # the line break that Layout puts after a text
        out.append((left, int(go.sum()), int(laid.words[a:b][go].sum())))
    return out


def _shorten(names: list[str], counts: tuple[str, str]):
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in batches:
            texts, places = got.column(at).to_pylist(), got.column(len(names)).to_pylist()
            lost_lines, lost_words = [0] * len(texts), [0] * len(texts)
            hit = [k for k, (text, own) in enumerate(zip(texts, places, strict=True)) if text and own]
            for k, (left, lines, words) in zip(hit, shortened([texts[k].encode("utf-8", "surrogatepass") for k in hit], [places[k] for k in hit]), strict=True):
                texts[k], lost_lines[k], lost_words[k] = left.decode("utf-8", "surrogatepass"), lines, words
            columns = [*got.columns[:at], pa.array(texts, got.column(at).type), *got.columns[at + 1 : len(names)], pa.array(lost_lines, pa.int64()), pa.array(lost_words, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [*names, *counts])

    return run


def dedup_lines(docs: DataFrame, block_words: int = 20, counts: tuple[str, str] = ("lines_removed", "words_removed")) -> DataFrame:
    """docs (doc_id, text, and others, which stay) with repeated passages removed from later texts, and how many lines and words that were (in place of columns of those names)."""
    gone = removals(docs, block_words)
    kept = [f for f in docs.schema.fields if f.name not in counts]
    keyed = docs.select(*[F.col(f"`{f.name}`") for f in kept], F.coalesce("doc_id", F.lit(FIRST)).alias("_rw_doc"), F.xxhash64("text").alias("_rw_hash"))
    gone = gone.select(F.col("doc").alias("_rw_doc"), F.col("text_hash").alias("_rw_hash"), F.col("places").alias("_rw_places")).hint("shuffle_hash")
    joined = keyed.join(gone, ["_rw_doc", "_rw_hash"], "left").select(*[F.col(f"`{f.name}`") for f in kept], "_rw_places")
    out = StructType([*kept]).add(counts[0], LongType()).add(counts[1], LongType())
    return joined.mapInArrow(_shorten([f.name for f in kept], counts), out)
