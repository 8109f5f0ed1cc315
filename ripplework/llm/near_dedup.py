"""Near-duplicate detection: Order MinHash proposes, banded alignment decides, connected components make classes.

Similarity. Words are runs of other than ASCII white space; a text's shingles are its runs of `shingle` words
(a text of fewer words is one shingle), in order, repeats included. Two texts that can be aligned with m equal
shingles, in order, have similarity m / (a + b - m), a and b their numbers of shingles. Texts of at least
`threshold` (0.8) are linked; classes are what links connect. For texts in the same order this is the Jaccard
similarity of their shingles; unlike that, it falls when passages change places.

1. Exact copies (same words) are one text from here on, known by a 64-bit hash of its words, however large the
   group of copies. (Among 3e10 texts some 20 pairs share such a hash by chance.)
2. Order MinHash: shingles are labelled with their occurrence number, so that repeats count. Each of `sketches`
   random orders picks the `picks` smallest labelled shingles and retains their order in the text; that tuple is
   a bucket. Two texts of similarity 0.8 share one sketch with a chance of about 0.8 ** 3, so 24 sketches miss
   one pair in 3e7.
3. In the buckets of the first third of the sketches every text is verified against the one of the smallest hash.
   The sketches agree on that one for most small groups, so this is about one pair for each text.
4. For buckets, of all sketches, whose texts aren't all in one class after that (chains of edits; passages that many texts share)
   every pair of texts of different classes is verified, in pieces of bounded size that meet two at a time:
   nothing that shares a bucket is left out, and pairs that links connect already cost nothing. An exact count of
   common shingles, an upper bound of the alignment's, sorts out what can't reach the threshold before it is aligned.
5. Shingles that stand once in both texts and ascend in both are a part of an alignment; where they are too few to
   reach the threshold, all are aligned. Alignment is limited to the band that the threshold allows (a + b - 2m <= a / 4 there) and runs on bit
   vectors, a machine word of cells at a time.

Links and classes stay distributed: classes are found by passing on the smallest id and jumping pointers, each
round written to the shared folder.

Null text is an empty text, and texts without words are copies of each other. Null doc_id counts as the smallest
id. Each row belongs to the class of its own text, rows with the same doc_id too. Further columns are ignored.
An empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplework.llm import common

FIRST = -(1 << 63)
BLANK = b" \t\n\x0b\x0c\r"
#: Texts and words of a piece of a bucket that is held at once.
PIECE_TEXTS, PIECE_WORDS = 2048, 1_000_000


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit permutation with well-spread bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words, and each text's bounds. A word is hashed once a batch."""
    import pyarrow.compute as pc
    import xxhash

    words = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
    bounds = np.asarray(words.offsets, np.int64)
    coded = pc.dictionary_encode(words.values.slice(bounds[0], bounds[-1] - bounds[0]))
    of_name = np.fromiter((xxhash.xxh64_intdigest(x) for x in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    full = np.asarray(pc.binary_length(coded.dictionary)) > 0  # blanks at an end leave empty words
    names = np.asarray(coded.indices)
    there = full[names] if len(names) else np.zeros(0, bool)
    ends = np.concatenate([[0], np.cumsum(there)])
    return of_name[names[there]], ends[bounds - bounds[0]]


def text_hashes(words: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Hash of each text's words in their order."""
    place = np.arange(len(words), dtype=np.uint64) - np.repeat(bounds[:-1], np.diff(bounds)).astype(np.uint64)
    summed = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mixed(words + _mixed(place + np.uint64(1))), dtype=np.uint64)])
    return _mixed(summed[bounds[1:]] - summed[bounds[:-1]] + np.diff(bounds).astype(np.uint64))


def shingles(words: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all texts, and each text's bounds; a text without words has none."""
    n = np.diff(bounds)
    count = np.where(n > 0, np.maximum(1, n - size + 1), 0)
    ends = np.concatenate([[0], np.cumsum(count)])
    at = np.repeat(bounds[:-1] - ends[:-1], count) + np.arange(ends[-1])
    last = np.repeat(bounds[1:] - 1, count)
    out = np.full(len(at), 0x9E3779B97F4A7C15, np.uint64)
    for k in range(size):
        inside = at + k <= last
        out = _mixed(out * np.uint64(31) + np.where(inside, words[np.minimum(at + k, last)] if len(words) else 0, np.uint64(k)))
    return out, ends


def occurrences(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How often each value has stood earlier in its own text."""
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    order = np.lexsort((values, text))
    v, t = values[order], text[order]
    first = np.ones(len(v), bool)
    first[1:] = (v[1:] != v[:-1]) | (t[1:] != t[:-1])
    starts = np.flatnonzero(first)
    out = np.empty(len(v), np.int64)
    out[order] = np.arange(len(v)) - np.repeat(starts, np.diff(np.append(starts, len(v))))
    return out


def order_minhash(values: np.ndarray, bounds: np.ndarray, sketches: int, picks: int, seed: int = 0x51ED) -> np.ndarray:
    """texts x sketches: hashes of the ordered tuples. Texts must have shingles."""
    labelled = _mixed(values + occurrences(values, bounds).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    starts, sizes = bounds[:-1], np.diff(bounds)
    out = np.empty((len(sizes), sketches), np.uint64)
    text = np.repeat(np.arange(len(sizes)), sizes)
    odd = _mixed(np.arange(1, sketches + 1, dtype=np.uint64) * np.uint64(seed)) | np.uint64(1)
    for s in range(sketches):
        key = labelled * odd[s]
        key ^= key >> np.uint64(32)
        key *= np.uint64(0x9E3779B97F4A7C15)
        places = np.empty((picks, len(sizes)), np.int64)
        for p in range(picks):
            low = np.minimum.reduceat(key, starts)
            hits = np.flatnonzero(key == low[text])
            own = text[hits]
            fresh = np.ones(len(hits), bool)
            fresh[1:] = own[1:] != own[:-1]
            places[p] = hits[fresh]  # a text of fewer shingles than picks gives the last again
            key[places[p]] = np.uint64(0xFFFFFFFFFFFFFFFF)
        places.sort(0)
        mix = np.full(len(sizes), s, np.uint64)
        for p in range(picks):
            mix = _mixed(mix * np.uint64(31) + labelled[places[p]])
        out[:, s] = mix
    return out


def aligned_shingles(a: np.ndarray, b: np.ndarray, threshold: float) -> int:
    """The most shingles of a and b that can be aligned within the band that the threshold allows.

    Longest common subsequence by bit vectors: bit j is 0 where the length grows at b[j]. Only bits within the
    band around the diagonal are held; those that leave it are counted.
    """
    if len(a) == len(b) and (a == b).all():
        return len(a)
    band = int((1 - threshold) / threshold * max(len(a), len(b))) + 1
    n = len(b)
    places: dict[int, list[int]] = {}
    for j, x in enumerate(b.tolist()):
        places.setdefault(x, []).append(j)
    seen: dict[int, tuple[int, int, int]] = {}
    low, high = 0, min(n, band + 1)
    bits, done = (1 << high) - 1, 0
    for i, x in enumerate(a.tolist()):
        new_low, new_high = max(0, min(n, i - band)), min(n, i + band + 1)
        if new_low > low:
            left = bits & ((1 << (new_low - low)) - 1)
            done += (new_low - low) - left.bit_count()
            bits >>= new_low - low
            low = new_low
        if new_high > high:
            bits |= ((1 << (new_high - high)) - 1) << (high - low)
            high = new_high
        here = places.get(x)
        if not here:
            continue
        match, at, k = seen.get(x, (0, low, 0))  # a shingle's places within the band, as it was when it came last
        match >>= low - at
        while k < len(here) and here[k] < high:
            if here[k] >= low:
                match |= 1 << (here[k] - low)
            k += 1
        seen[x] = match, low, k
        u = bits & match
        if u:
            full = (1 << (high - low)) - 1
            bits = ((bits + u) | (bits - u)) & full
    return done + (high - low) - bits.bit_count()


def similar(a: np.ndarray, b: np.ndarray, threshold: float) -> bool:
    """Whether two shingle sequences reach the threshold."""
    small, large = sorted((len(a), len(b)))
    if small == 0:
        return large == 0
    if small < threshold * large:
        return False
    ua, fa, ca = np.unique(a, return_index=True, return_counts=True)
    ub, fb, cb = np.unique(b, return_index=True, return_counts=True)
    _, ia, ib = np.intersect1d(ua, ub, assume_unique=True, return_indices=True)
    most = int(np.minimum(ca[ia], cb[ib]).sum())
    need = lambda m: m >= threshold * (len(a) + len(b) - m) - 1e-9
    if not need(most):
        return False
    once = (ca[ia] == 1) & (cb[ib] == 1)
    at, to = fa[ia][once], fb[ib][once]
    return need(_ascending(to[np.argsort(at)].tolist())) or need(aligned_shingles(a, b, threshold))


def _ascending(x: list[int]) -> int:
    """Length of the longest ascending subsequence: for places of shingles that stand once in two texts, a part of their alignment."""
    tops: list[int] = []
    for v in x:
        k = bisect_left(tops, v)
        tops[k : k + 1] = [v]
    return len(tops)


def _unpack(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.uint64)


def _sketch(size: int, sketches: int, picks: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc", "text_hash", "node", "n", "buckets"]
        for got in batches:
            words, bounds = word_hashes(got.column(1))
            values, ends = shingles(words, bounds, size)
            n = np.diff(ends)
            some = np.flatnonzero(n > 0)
            node = text_hashes(words, bounds)
            buckets: list = [[] for _ in range(len(n))]
            if len(some):
                rows = order_minhash(values, np.append(ends[some], ends[-1]), sketches, picks).view(np.int64)
                for i, row in zip(some.tolist(), rows.tolist(), strict=True):
                    buckets[i] = row
            yield pa.RecordBatch.from_arrays([got.column(0), got.column(2), pa.array(node.view(np.int64)), pa.array(n), pa.array(buckets, pa.list_(pa.int64()))], names)

    return run


def _pack(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in batches:
            words, bounds = word_hashes(got.column(1))
            values, ends = shingles(words, bounds, size)
            raw, cut = values.tobytes(), (ends * 8).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(text_hashes(words, bounds).view(np.int64)), pa.array([raw[a:b] for a, b in zip(cut, cut[1:], strict=False)], pa.binary())], ["node", "shingles"])

    return run


def _verify(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in batches:
            ok = [similar(_unpack(a), _unpack(b), threshold) for a, b in zip(got.column("sa").to_pylist(), got.column("sb").to_pylist(), strict=True)]
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([got.column("a").filter(keep), got.column("b").filter(keep)], ["a", "b"])

    return run


def links_between(visitors: list[tuple], own: list[tuple], threshold: float) -> list[tuple[int, int]]:
    """Links that join classes, between texts (id, class, shingles) of two pieces; a link that is found joins its classes at once."""
    parent = {x[1]: x[1] for x in [*visitors, *own]}

    def root(c: int) -> int:
        while parent[c] != c:
            parent[c] = parent[parent[c]]
            c = parent[c]
        return c

    theirs, mine = [_unpack(x[2]) for x in visitors], [_unpack(x[2]) for x in own]
    (v, at), (o, bounds) = _labelled([x[2] for x in visitors]), _labelled([x[2] for x in own])
    sizes = np.diff(bounds)
    order = np.argsort(o, kind="stable")
    ranked, owner = o[order], np.repeat(np.arange(len(own)), sizes)[order]
    out = []
    roots = np.array([root(x[1]) for x in own], np.int64)
    for i, (name, group, _) in enumerate(visitors):
        asked = v[at[i] : at[i + 1]]
        lo, hi = np.searchsorted(ranked, asked), np.searchsorted(ranked, asked, "right")
        # whoever reaches the threshold lacks at most `spare` of the shingles, and so has all but that of any: of the rarest here
        spare = len(asked) - int(np.ceil(threshold * len(asked) - 1e-9))
        least = np.argsort(hi - lo, kind="stable")[: spare + 1 + len(asked) // 8]
        near = np.flatnonzero(np.bincount(owner[_ranges(lo[least], hi[least])], minlength=len(own)) >= len(least) - spare)
        near = near[(roots[near] != root(group)) & (sizes[near] >= threshold * len(asked)) & (len(asked) >= threshold * sizes[near])]
        if not len(near):
            continue
        shared = np.bincount(owner[_ranges(lo, hi)], minlength=len(own))[near]  # shingles in common with each text, repeats counted
        could = shared >= threshold * (len(asked) + sizes[near] - shared) - 1e-9
        for j, _ in sorted(zip(near[could].tolist(), shared[could].tolist(), strict=True), key=lambda x: -x[1]):
            a, b = root(group), root(own[j][1])
            if a != b and similar(theirs[i], mine[j], threshold):
                parent[max(a, b)] = min(a, b)
                roots[(roots == a) | (roots == b)] = min(a, b)
                out.append((name, own[j][0]))
    return out


def _ranges(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """All numbers of the ranges, one after another."""
    size = high - low
    total = np.concatenate([[0], np.cumsum(size)])
    return np.repeat(low - total[:-1], size) + np.arange(total[-1])


def _pieces(threshold: float):
    def run(frame):
        import pandas as pd

        rows = list(zip(frame["node"].tolist(), frame["class"].tolist(), frame["shingles"].tolist(), strict=True))
        visits = frame["visits"].tolist()
        found = links_between([r for r, x in zip(rows, visits, strict=True) if x], [r for r, x in zip(rows, visits, strict=True) if not x], threshold)
        return pd.DataFrame(found, columns=["a", "b"]).astype("int64")

    return run


def components(links: DataFrame) -> DataFrame:
    """node, class: the smallest node that links (a, b) connect each node with, for nodes that have links."""
    both = common.staged(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    state = common.staged(both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("a", "low").alias("class")), "classes")
    while True:
        from_near = both.join(state.select(F.col("node").alias("b"), F.col("class").alias("near")), "b").groupBy("a").agg(F.min("near").alias("near"))
        lower = state.join(from_near, state["node"] == from_near["a"]).select("node", F.col("class").alias("was"), F.least("class", "near").alias("class"))
        jump = state.select(F.col("node").alias("class"), F.col("class").alias("next"))
        after = common.staged(lower.join(jump, "class", "left").select("node", "was", F.coalesce("next", "class").alias("class")), "classes")
        if after.where(F.col("class") != F.col("was")).isEmpty():
            found = after.select("node", "class")
            found.staged_at = after.staged_at
            return found
        state = after.select("node", "class")


def near_duplicates(docs: DataFrame, threshold: float = 0.8, shingle: int = 5, sketches: int = 24, picks: int = 3) -> DataFrame:
    """doc_id, class_id (the smallest doc_id of its class), n_copies and n_texts (rows with the same words; different texts in the class) of each row of docs (doc_id, text)."""
    plain = lambda name: F.when(F.col(name) != FIRST, F.col(name))
    return _classified(docs, threshold, shingle, sketches, picks).select(plain("doc").alias("doc_id"), plain("class_doc").alias("class_id"), F.col("rows").alias("n_copies"), "n_texts")


def one_of_each(docs: DataFrame, threshold: float = 0.8, shingle: int = 5, sketches: int = 24, picks: int = 3) -> DataFrame:
    """docs with one row of each class: that of the smallest doc_id, and of the smallest hash among rows that share it; of equal rows one stays."""
    found = _classified(docs, threshold, shingle, sketches, picks)
    chosen = found.groupBy("class").agg(F.min(F.struct("doc", "text_hash")).alias("x")).select(F.col("x.doc").alias("_rw_doc"), F.col("x.text_hash").alias("_rw_hash"))
    keyed = docs.withColumns({"_rw_doc": F.coalesce("doc_id", F.lit(FIRST)), "_rw_hash": _text_hash()})
    key = ["_rw_doc", "_rw_hash"]
    return keyed.join(chosen.distinct().hint("shuffle_hash"), key, "left_semi").dropDuplicates(key).drop(*key)


def _text_hash() -> Column:
    return F.xxhash64(F.coalesce("text", F.lit("")))


def _classes(docs: DataFrame, threshold: float, shingle: int, sketches: int, picks: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows with their nodes (different texts), the nodes, and the classes of nodes that have links; staged."""
    keyed = common.texts(docs).select(F.coalesce("doc_id", F.lit(FIRST)).alias("doc"), "text", _text_hash().alias("text_hash"))
    sketched = common.staged(keyed.mapInArrow(_sketch(shingle, sketches, picks), "doc long, text_hash long, node long, n long, buckets array<long>"), "sketches")
    texts = common.staged(sketched.groupBy("node").agg(F.min("doc").alias("doc"), F.count("*").alias("rows")), "texts")
    sketched_texts = common.staged(sketched.where("n > 0").join(texts.select("node", "doc"), ["node", "doc"]).select("node", "n", "buckets"), "buckets")

    members = _members(sketched_texts, max(1, sketches // 3))
    packed = _packed(keyed.select("doc", "text"), texts, members.select("node").distinct(), shingle)
    to_head = members.where("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b")).distinct()
    links = common.staged(_with_shingles(to_head, packed).mapInArrow(_verify(threshold), "a long, b long"), "found")

    odd = _odd(sketched_texts, components(links))
    new = odd.select("node").distinct().join(packed.select("node"), "node", "left_anti")
    packed = packed.unionByName(_packed(keyed.select("doc", "text"), texts, new, shingle))
    classes = components(links.unionByName(common.staged(_across_classes(odd, packed, threshold), "found")))
    return sketched, texts, classes


def _classified(docs: DataFrame, threshold: float, shingle: int, sketches: int, picks: int) -> DataFrame:
    """doc, text_hash, class, class_doc, rows, n_texts of each row."""
    spark = docs.sparkSession
    common.bound_batches(spark)
    with common.collected(spark) as keep:
        keep += _classes(docs, threshold, shingle, sketches, picks)
    sketched, texts, classes = keep
    of_text = texts.join(classes, "node", "left").withColumn("class", F.coalesce("class", "node"))
    of_class = of_text.groupBy("class").agg(F.min("doc").alias("class_doc"), F.count("*").alias("n_texts"))
    of_text = of_text.join(of_class, "class").select("node", "rows", "class", "class_doc", "n_texts")
    return sketched.select("doc", "text_hash", "node").join(of_text, "node").drop("node")


def _members(texts: DataFrame, first: int) -> DataFrame:
    """bucket, node, head: texts in buckets of at least two, of the first sketches."""
    buckets = texts.select("node", F.explode(F.array_distinct(F.slice("buckets", 1, first))).alias("bucket"))
    heads = buckets.groupBy("bucket").agg(F.min("node").alias("head"), F.max("node").alias("last")).where("head < last").select("bucket", "head")
    return common.staged(buckets.join(heads, "bucket").select("bucket", "node", "head").distinct(), "members")


def _packed(keyed: DataFrame, texts: DataFrame, nodes: DataFrame, shingle: int) -> DataFrame:
    """node, shingles of the nodes."""
    ids = texts.join(nodes, "node", "left_semi").select("doc").distinct().hint("shuffle_hash")
    found = keyed.join(ids, "doc", "left_semi").mapInArrow(_pack(shingle), "node long, shingles binary")
    return common.staged(found.join(nodes, "node", "left_semi").dropDuplicates(["node"]), "shingles")


def _with_shingles(pairs: DataFrame, packed: DataFrame) -> DataFrame:
    a = packed.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    b = packed.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", "sa", "sb")


def _odd(texts: DataFrame, classes: DataFrame) -> DataFrame:
    """bucket, node, class, texts, words: the buckets of all sketches whose texts aren't in one class; of buckets with the same texts one."""
    classed = texts.join(classes, "node", "left").select("node", "n", F.coalesce("class", "node").alias("class"), F.explode(F.array_distinct("buckets")).alias("bucket"))
    return common.staged(_of_two_classes(classed), "odd")


def _of_two_classes(classed: DataFrame) -> DataFrame:
    """Rows (bucket, node, class, n) of buckets with more than one class, with the bucket's texts and words; of buckets with the same texts one."""
    mark = F.xxhash64("node").cast("decimal(38,0)")
    mixed = classed.groupBy("bucket").agg(F.min("class").alias("low"), F.max("class").alias("high"), F.count("*").alias("texts"), F.sum("n").alias("words"), F.sum(mark).alias("mark")).where("low < high")
    once = mixed.groupBy("mark", "texts").agg(F.min("bucket").alias("bucket"), F.min("words").alias("words")).drop("mark")
    return classed.join(once, "bucket").distinct()


def _labelled(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of texts, told apart by how often they have stood before, and each text's bounds."""
    seqs = [_unpack(x) for x in raw]
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in seqs])]).astype(np.int64)
    flat = np.concatenate(seqs) if seqs else np.zeros(0, np.uint64)
    return _mixed(flat + occurrences(flat, bounds).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), bounds


def _n_pieces() -> Column:
    return F.greatest(F.ceil(F.col("texts") / PIECE_TEXTS), F.ceil(F.col("words") / PIECE_WORDS)).cast("int")


def _across_classes(odd: DataFrame, packed: DataFrame, threshold: float) -> DataFrame:
    """Links between texts of a bucket that aren't in one class yet."""
    counts = odd.groupBy("bucket", "class").count()
    major = counts.groupBy("bucket").agg(F.max(F.struct("count", "class")).alias("x")).select("bucket", F.col("x.class").alias("major"))
    odd = odd.join(major, "bucket").select("bucket", "node", "class", (F.col("class") != F.col("major")).alias("minor"), _n_pieces().alias("pieces"))
    odd = odd.withColumn("piece", F.pmod(F.xxhash64("node", "bucket"), F.col("pieces")).cast("int"))
    # a pair has a text that isn't of the major class: it visits, with its piece, every piece of the bucket
    every = F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))
    visitors = odd.where("minor").select("bucket", "node", "class", F.lit(True).alias("visits"), F.col("piece").alias("p"), every.alias("q"))
    hosts = odd.select("bucket", "node", "class", F.lit(False).alias("visits"), every.alias("p"), F.col("piece").alias("q"))
    met = visitors.unionByName(hosts).join(packed, "node").select("bucket", "p", "q", "node", "class", "visits", "shingles")
    return met.groupBy("bucket", "p", "q").applyInPandas(_pieces(threshold), "a long, b long")
