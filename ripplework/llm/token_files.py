"""Token ids as binary files: canonical length-limited Huffman codes in independently decodable blocks.

File format. A dataset is a folder with two Parquet tables.

`code`, one row: `lengths`, the code length in bits of each id from 0 on (0: the id doesn't occur), one byte
each; `limit`, the longest length allowed; `every`, ids between two checkpoints. Codes are canonical: shorter
first, equal lengths in order of id, numbered upwards.

`blocks`, a row for each block, in ascending order of doc_id: `shard` and `block` (blocks of a shard follow one
another, shards do so too), `shard_start` (ids of the shard before this block), `doc_ids` and `doc_tokens` of
its documents, all whole, `bits` (the number of bits), `checkpoints` (the bit offset of each `every`-th id) and
`payload` (the codes, most significant bit first, padded to bytes). A block needs only the code to be decoded,
and a reader of a single document starts at the last checkpoint before it.

Documents with a null doc_id come first, equal doc_ids in order of a hash of their ids, and may lie in several shards. Null text is empty: the end id
alone. Further columns are ignored. An empty table gives an empty dataset.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplework.llm import common
from ripplework.llm.tokens import BatchEncoder, with_end

BLOCKS = "shard long, block long, shard_start long, doc_ids array<long>, doc_tokens array<long>, bits long, checkpoints array<long>, payload binary"
READ = "doc_id long, shard long, shard_start long, n_tokens long, ids binary"
EVERY, BLOCK_IDS = 128, 1 << 16


def code_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """Optimal code lengths of at most `limit` bits for ids with these counts (package-merge); 0 for a count of 0."""
    lengths = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} ids don't fit into codes of {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.int64)
    levels, weights, inner = [], leaves, np.zeros(len(leaves), bool)
    for _ in range(limit - 1):  # bottom up: pair the cheapest, merge the pairs with the leaves
        levels.append(inner)
        pairs = weights[: len(weights) // 2 * 2].reshape(-1, 2).sum(1)
        mixed, marks = np.concatenate([leaves, pairs]), np.concatenate([np.zeros(len(leaves), bool), np.ones(len(pairs), bool)])
        rank = np.argsort(mixed, kind="stable")
        weights, inner = mixed[rank], marks[rank]
    levels.append(inner)
    take = 2 * len(leaves) - 2
    for inner in reversed(levels):  # top down: the cheapest `take`, then the pairs among them opened
        pairs = int(inner[:take].sum())
        lengths[order[: take - pairs]] += 1
        take = 2 * pairs
    return lengths


def canonical(lengths: np.ndarray) -> np.ndarray:
    """The code of each id, from the lengths alone."""
    codes = np.zeros(len(lengths), np.uint64)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    if len(order):
        longest = int(lengths[order[-1]])
        steps = np.uint64(1) << (longest - lengths[order].astype(np.int64)).astype(np.uint64)
        starts = np.cumsum(steps) - steps  # as if all codes had the longest length
        codes[order] = starts >> (longest - lengths[order].astype(np.int64)).astype(np.uint64)
    return codes


def encode(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray, every: int = EVERY) -> tuple[bytes, int, np.ndarray]:
    """Payload, number of bits, and the bit offset of each `every`-th id."""
    size = lengths[ids].astype(np.int64)
    ends = np.cumsum(size)
    bits = int(ends[-1]) if len(ends) else 0
    at = ends - size
    shifted = codes[ids] << (64 - (at & 31) - size).astype(np.uint64)  # from bit at % 32 of two words of 32 bits
    word, out = at >> 5, np.zeros(bits // 32 + 2, np.uint64)
    starts = np.flatnonzero(np.diff(word, prepend=-1))
    if len(starts):  # bits don't overlap: a word is the sum of the codes that begin in it and of the rest of the last one before
        out[word[starts]] = np.add.reduceat(shifted >> np.uint64(32), starts)
        out[word[starts] + 1] += np.add.reduceat(shifted & np.uint64(0xFFFFFFFF), starts)
    return out.astype(">u4").tobytes()[: -(-bits // 8)], bits, at[::every]


class Decoder:
    """Table-driven: the next `longest` bits name the id and its length. All checkpoints of a block advance together."""

    def __init__(self, lengths: np.ndarray):
        self.longest = int(lengths.max()) if len(lengths) else 0
        order = np.lexsort((np.arange(len(lengths)), lengths))
        order = order[lengths[order] > 0]
        span = 1 << (self.longest - lengths[order].astype(np.int64))
        self.ids = np.repeat(order.astype(np.uint32), span)
        self.sizes = np.repeat(lengths[order].astype(np.int64), span)
        gap = (1 << self.longest) - len(self.ids)  # only where a single id occurs
        self.ids, self.sizes = np.pad(self.ids, (0, gap)), np.pad(self.sizes, (0, gap), constant_values=1)

    def __call__(self, payload: bytes, n: int, checkpoints: np.ndarray, every: int = EVERY) -> np.ndarray:
        data = payload + b"\0" * 16
        wide = np.empty(len(payload) + 8, np.uint64)  # the 64 bits from each byte on
        for k in range(8):
            wide[k::8] = np.frombuffer(data, ">u8", len(wide[k::8]), k)
        at, out = np.array(checkpoints, np.int64), np.zeros((len(checkpoints), every), np.uint32)
        last = len(wide) - 1
        for i in range(every):
            peek = (wide[np.minimum(at >> 3, last)] << (at & 7).astype(np.uint64)) >> np.uint64(64 - self.longest)
            out[:, i] = self.ids[peek]
            at += self.sizes[peek]
        return out.reshape(-1)[:n]  # a stretch's ids beyond the end are cut off


TOKENS = "doc_id long, width int, ids binary, counts array<struct<id:long,n:long>>"


def _tokenise(tokenizer: str, end_id: int):
    """A row for each document, and one for each task with the counts of its ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, total = BatchEncoder(tokenizer), np.zeros(1, np.int64)
        kinds = [pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.struct([("id", pa.int64()), ("n", pa.int64())]))]
        batch = lambda *columns: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "width", "ids", "counts"])
        for got in batches:
            ids, bounds = with_end(*encoder(got.column(1)), end_id)
            own = np.bincount(ids, minlength=len(total))
            own[: len(total)] += total
            total = own
            wide = np.dtype("<u4") if not len(ids) or ids.max() > 0xFFFF else np.dtype("<u2")
            raw, cut = ids.astype(wide).tobytes(), (bounds * wide.itemsize).tolist()
            n = got.num_rows
            yield batch(got.column(0), [wide.itemsize] * n, [raw[a:b] for a, b in zip(cut, cut[1:], strict=False)], [None] * n)
        seen = np.flatnonzero(total)
        yield batch([None], [None], [None], [[{"id": int(i), "n": int(total[i])} for i in seen]])

    return run


def _ids(got: pa.RecordBatch) -> list[np.ndarray]:
    return [np.frombuffer(x, f"<u{w}") for w, x in zip(got.column("width").to_pylist(), got.column("ids").to_pylist(), strict=True)]


def _write(lengths: np.ndarray, every: int, block_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, shard = canonical(lengths), TaskContext.get().partitionId()
        block, start = 0, 0
        names, parts = [], []

        def flush() -> pa.RecordBatch:
            nonlocal block, start, names, parts
            payload, bits, checkpoints = encode(np.concatenate(parts).astype(np.int64), lengths, codes, every)
            sizes = [len(x) for x in parts]
            row = [shard, block, start, names, sizes, bits, checkpoints.tolist(), payload]
            kinds = [pa.int64()] * 3 + [pa.list_(pa.int64())] * 2 + [pa.int64(), pa.list_(pa.int64()), pa.binary()]
            block, start, names, parts = block + 1, start + sum(sizes), [], []
            return pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in zip(row, kinds, strict=True)], [x.split()[0] for x in BLOCKS.split(", ")])

        held = 0
        for got in batches:
            for doc_id, ids in zip(got.column("doc_id").to_pylist(), _ids(got), strict=True):
                names.append(doc_id)
                parts.append(ids)
                held += len(ids)
                if held >= block_ids:
                    held = 0
                    yield flush()
        if parts:
            yield flush()

    return run


def _read(lengths: np.ndarray, every: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(lengths)
        for got in batches:
            for row in got.to_pylist():
                sizes = np.array(row["doc_tokens"], np.int64)
                ends = np.cumsum(sizes)
                raw = decoder(row["payload"], int(ends[-1]), row["checkpoints"], every).astype("<u4").tobytes()
                columns = [
                    pa.array(row["doc_ids"], pa.int64()), pa.array([row["shard"]] * len(sizes), pa.int64()), pa.array(row["shard_start"] + ends - sizes, pa.int64()), pa.array(sizes, pa.int64()),
                    pa.array([raw[4 * a : 4 * b] for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True)], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in READ.split(", ")])

    return run


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, limit: int = 18, every: int = EVERY, block_ids: int = BLOCK_IDS) -> None:
    """Encode docs (doc_id, text) into the dataset at path, in ascending order of doc_id. limit: bits of a code at most."""
    spark = docs.sparkSession
    common.bound_batches(spark)
    staged = common.staged(common.texts(docs).mapInArrow(_tokenise(tokenizer, end_id), TOKENS), "tokens")
    counted = staged.where("counts IS NOT NULL").select(F.inline("counts")).groupBy("id").agg(F.sum("n").alias("n")).collect()  # a row for each id of the vocabulary at most
    tokens = staged.where("counts IS NULL").select("doc_id", "width", "ids")
    counts = np.zeros(max((r.id for r in counted), default=0) + 1, np.int64)
    for r in counted:
        counts[r.id] = r.n
    lengths = code_lengths(counts, limit)
    shards = max(1, tokens.rdd.getNumPartitions(), int(spark.conf.get("spark.sql.shuffle.partitions")))
    tie = F.xxhash64("ids")  # rows that share a doc_id may be many: the hash deals them too, and bounds of ranges stay short
    ordered = tokens.repartitionByRange(shards, "doc_id", tie).sortWithinPartitions("doc_id", tie, "ids")
    ordered.mapInArrow(_write(lengths, every, block_ids), BLOCKS).write.option("compression", "none").parquet(f"{path}/blocks")
    spark.createDataFrame([(bytearray(lengths.tobytes()), limit, every)], "lengths binary, limit int, every int").coalesce(1).write.parquet(f"{path}/code")
    common.discard(spark, staged)


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids (little-endian unsigned 32-bit) from the dataset at path. Broadcast: a row of two numbers for each shard."""
    common.bound_batches(spark)
    code = spark.read.parquet(f"{path}/code").first()
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    totals = blocks.groupBy("shard").agg(F.sum(F.aggregate("doc_tokens", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n")).orderBy("shard").collect()  # a row for each shard
    before, starts = 0, []
    for r in totals:
        starts.append((r.shard, before))
        before += r.n
    docs = blocks.mapInArrow(_read(np.frombuffer(code.lengths, np.uint8), code.every), READ)
    at = spark.createDataFrame(starts, "shard long, before long")
    return docs.join(F.broadcast(at), "shard").select("doc_id", (F.col("before") + F.col("shard_start")).alias("start"), "n_tokens", "ids")


def digest(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
