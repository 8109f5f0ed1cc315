"""Benchmark decontamination: one Aho-Corasick automaton over the windows of all benchmark texts.

Normalised text: A-Z lower-cased, words are runs of ASCII letters, digits and non-ASCII characters, joined by
single spaces. A window is `width` consecutive words of an item; an item with fewer words, but not none, is one
window. Each document is normalised and scanned once, and a match's place is mapped back to code points of the
original text. A word inside any match is hit.

The benchmark is never gathered on the driver. Its distinct windows, each known by a 64-bit hash, are dealt by
that hash into parts of about `limit` bytes in all, as measured; one part at a time is sent to the tasks, which
build its automaton once each and scan every document with it. What a document has hit is united over the parts,
and which items a window belongs to is joined to the windows that were hit, so neither the benchmark's size nor
the number of items with the same window is bounded by a machine's memory.

Null texts, of documents or items, have no words. Repeated item texts all count as items; repeated rows of an
item_id count once. Items without an id mark words as others do, and count as one item, a null in the
list of ids. doc_id may be null; repeated documents give a row each, also those that share a doc_id but not
their text. Very long texts are scanned whole, in linear time. Further columns are ignored. An empty benchmark
marks nothing; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ripplework.llm import common

#: To lower case; every other ASCII byte that isn't a letter or a digit is a separator. Longer UTF-8 bytes stay.
NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: A word in text that isn't lower-cased yet.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
#: Bytes of windows in one automaton.
LIMIT = 4 << 20
SCANNED = "doc_id long, text_hash long, row long, n_words long, windows array<long>, runs array<struct<first:long,last:long,start:long,end:long>>"


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(NORMAL).split()


def windows_of(words: list[bytes], width: int) -> list[bytes]:
    """Each padded with a space on either side, so that matches begin and end at words."""
    if not words:
        return []
    return [b" " + b" ".join(words[i : i + width]) + b" " for i in range(max(1, len(words) - width + 1))]


def _hash(window: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(window) - (1 << 63)


def automaton(windows: list[bytes]):
    """Finds windows: their length and hash. Bytes as Latin-1 characters, one each."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for window in windows:
        found.add_word(window.decode("latin-1"), (len(window), _hash(window)))
    if windows:
        found.make_automaton()
    return found if windows else None


class Scanned:
    """A normalised document and what an automaton finds in it."""

    def __init__(self, text: str, found):
        words = words_of(text)
        self.n_words, self.normal = len(words), b" " + b" ".join(words) + b" "
        self.places: list[tuple[int, int]] = []  # of the spaces around a match
        self.windows: set[int] = set()
        for end, (size, window) in found.iter(self.normal.decode("latin-1")) if found else ():
            self.places.append((end + 1 - size, end))
            self.windows.add(window)

    def runs(self, text: str) -> list[dict]:
        """Runs of words that are in a match: words, and code points of the original text; both without their end."""
        if not self.places:
            return []
        before = np.cumsum(np.frombuffer(self.normal, np.uint8) == 32) - 1  # at a space: the number of words before it
        at = before[np.array(self.places)]
        change = np.zeros(self.n_words + 1, np.int64)
        np.add.at(change, at[:, 0], 1)
        np.add.at(change, at[:, 1], -1)
        edges = np.flatnonzero(np.diff(np.concatenate([[0], (np.cumsum(change)[:-1] > 0).astype(np.int8), [0]])))
        spots = [m.span() for m in WORD.finditer(text)]
        return [{"first": a, "last": b, "start": spots[a][0], "end": spots[b - 1][1]} for a, b in edges.reshape(-1, 2).tolist()]


def _scan(windows: list[bytes], hits_only: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, at = automaton(windows), TaskContext.get().partitionId() << 40
        names = [x.split()[0] for x in SCANNED.split(", ")]
        kinds = [pa.int64()] * 4 + [pa.list_(pa.int64()), pa.list_(pa.struct([(x, pa.int64()) for x in ("first", "last", "start", "end")]))]
        for got in batches:
            rows = []
            for doc_id, text, text_hash in zip(*(got.column(c).to_pylist() for c in ("doc_id", "text", "text_hash")), strict=True):
                doc = Scanned(text, found)
                at += 1
                if doc.windows or not hits_only:
                    rows.append((doc_id, text_hash, at, doc.n_words, sorted(doc.windows), doc.runs(text)))
            columns = zip(*rows, strict=True) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(columns, kinds, strict=True)], names)

    return run


def _windows(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in batches:
            rows = [(w, _hash(w), item_id) for item_id, text in zip(got.column(0).to_pylist(), got.column(1).to_pylist(), strict=True) for w in dict.fromkeys(windows_of(words_of(text), width))]
            columns = zip(*rows, strict=True) if rows else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, (pa.binary(), pa.int64(), pa.int64()), strict=True)], ["content", "window", "item_id"])

    return run


class Benchmark:
    """The windows of all items, staged in the shared folder and taken part by part."""

    def __init__(self, items: DataFrame, width: int, limit: int):
        common.bound_batches(items.sparkSession)
        texts = items.where("text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), "text")
        self.owned = common.staged(texts.mapInArrow(_windows(width), "content binary, window long, item_id long"), "windows")
        self.distinct = self.owned.groupBy("window").agg(F.min("content").alias("content"))
        size = self.distinct.agg(F.sum(F.octet_length("content"))).first()[0] or 0
        self.parts = max(1, -(-size // limit))

    def part(self, number: int) -> list[bytes]:
        """About `limit` bytes of windows."""
        return [bytes(r.content) for r in self.distinct.where(F.pmod("window", F.lit(self.parts)) == number).select("content").collect()]


def find_contamination(docs: DataFrame, benchmark: DataFrame, width: int = 10, limit: int = LIMIT) -> DataFrame:
    """docs: doc_id, text; benchmark: item_id, text. Per document its words, hit words, items, and hit spans (code points of the text)."""
    known = Benchmark(benchmark, width, limit)
    keyed = common.texts(docs).select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    found = common.staged(keyed.mapInArrow(_scan(known.part(0), False), SCANNED), "scanned")
    key = F.struct(F.col("doc_id").isNull(), F.coalesce("doc_id", F.lit(0)), "text_hash").alias("key")
    if known.parts > 1:
        more = [common.staged(keyed.mapInArrow(_scan(known.part(p), True), SCANNED), "scanned") for p in range(1, known.parts)]
        hits = more[0]
        for one in more[1:]:
            hits = hits.unionByName(one)
        once = hits.select(key, F.explode("windows").alias("window"), "runs").groupBy("key", "window").agg(F.first("runs").alias("runs"))  # repeated rows of a document have the same hits
        other = once.groupBy("key").agg(F.collect_list("window").alias("windows_more"), F.flatten(F.collect_set("runs")).alias("runs_more"))
        joined = found.select("*", key).join(other, "key", "left")
        found = joined.select("doc_id", "text_hash", "row", "n_words", F.concat("windows", F.coalesce("windows_more", F.array())).alias("windows"), _united(F.concat("runs", F.coalesce("runs_more", F.array()))).alias("runs"))
        found = common.staged(found, "scanned")
    hit = found.where(F.size("windows") > 0).select("row", F.explode("windows").alias("window"))
    items = hit.join(known.owned.select("window", "item_id"), "window").groupBy("row").agg(F.collect_set(F.struct("item_id")).alias("_items"))
    ids = F.sort_array(F.transform(F.coalesce("_items", F.array().cast("array<struct<item_id:bigint>>")), lambda x: x["item_id"]))
    n_hit = F.aggregate("runs", F.lit(0).cast("long"), lambda a, r: a + r["last"] - r["first"])
    spans = F.transform("runs", lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end")))
    return found.join(items, "row", "left").select("doc_id", "n_words", n_hit.alias("n_hit"), ids.alias("items"), spans.alias("spans"))


def _united(runs: Column) -> Column:
    """Runs in order, those that overlap or touch as one."""

    def put(out: Column, run: Column) -> Column:
        last = F.try_element_at(out, F.lit(-1))
        longer = F.struct(last["first"].alias("first"), F.greatest(last["last"], run["last"]).alias("last"), last["start"].alias("start"), F.greatest(last["end"], run["end"]).alias("end"))
        return F.when((F.size(out) > 0) & (F.try_element_at(out, F.lit(-1))["last"] >= run["first"]), F.concat(F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0))), F.array(longer))).otherwise(F.concat(out, F.array(run)))

    return F.aggregate(F.array_sort(runs), F.array().cast("array<struct<first:bigint,last:bigint,start:bigint,end:bigint>>"), put)


def clean(docs: DataFrame, benchmark: DataFrame, width: int = 10, limit: int = LIMIT) -> DataFrame:
    """docs (text and any others) without those that have a hit word. Part by part: each looks at what the ones before have left."""
    known, at = Benchmark(benchmark, width, limit), docs.columns.index("text")

    def without(windows: list[bytes]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = automaton(windows)
            for got in batches:
                yield got.filter(pa.array([not Scanned(text or "", found).windows for text in got.column(at).to_pylist()], pa.bool_()))

        return run

    for p in range(known.parts):
        docs = (common.staged(docs, "left") if p else docs).mapInArrow(without(known.part(p)), docs.schema)
    return docs


def digest(found: DataFrame) -> DataFrame:
    names = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(names, ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
#: By a join of all windows of documents and items.
ORACLE = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
item_windows AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS words FROM (SELECT *, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM b WHERE len(w) > 0)),
doc_windows AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS words FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM item_windows) WHERE len(w) >= n)),
hits AS (SELECT doc_id, i, n, item_id FROM doc_windows JOIN item_windows USING (n, words)),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id),
covered AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS place FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""
