"""Quality classifier: a byte-level convolutional network in numpy.

A text's UTF-8 bytes are covered by chunks of CHUNK bytes, each overlapping the next by half. Filters of WIDTH
bytes, learned over byte embeddings, slide over every position; each filter's strongest answer in a chunk is
kept (max-pooling); a small hidden layer turns a chunk's answers into a score, and the scores, weighted by the
bytes that a chunk has, combine into one probability for the whole document.

Filters are applied by table: the answer of a filter to a byte at each of its places is computed once for all
256 bytes, so that a position costs WIDTH table rows instead of a matrix product.

Training weighs both classes the same; the share of good ones among all usable labels is then added to the
odds. It takes a bounded sample of the labelled rows, at most `per_class` documents of each class, chosen by hash,
with their whole texts; each round goes over all their bytes, in chunks that begin half a chunk later every other
time. Scoring covers every byte of every text; a very long text's positions are held a slab at a time.

Null and empty texts are scored as a chunk without bytes. A label or doc_id that is null is not trained on;
repeated labels of a document are averaged out by training on each. Without labels of both classes every score
is 0.5. Further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplework.llm import common

CHUNK, WIDTH, EMBED, FILTERS, HIDDEN = 512, 6, 8, 32, 16
HALF = CHUNK // 2
#: Positions that are held at once.
SLAB = 16 * HALF


@dataclass
class Net:
    embed: np.ndarray  # 256 x EMBED
    filters: np.ndarray  # WIDTH x EMBED x FILTERS
    bias: np.ndarray  # FILTERS
    hidden: np.ndarray  # FILTERS + 1 x HIDDEN: the last for how full a chunk is
    hidden_bias: np.ndarray
    out: np.ndarray  # HIDDEN
    out_bias: np.ndarray  # 1

    @classmethod
    def fresh(cls, seed: int) -> Net:
        r = np.random.default_rng(seed)
        draw = lambda scale, *shape: (r.standard_normal(shape) * scale).astype(np.float32)
        return cls(draw(1.0, 256, EMBED), draw((WIDTH * EMBED) ** -0.5, WIDTH, EMBED, FILTERS), np.zeros(FILTERS, np.float32), draw(FILTERS**-0.5, FILTERS + 1, HIDDEN), np.zeros(HIDDEN, np.float32), draw(HIDDEN**-0.5, HIDDEN), np.zeros(1, np.float32))

    def tables(self) -> np.ndarray:
        """WIDTH x 256 x FILTERS: what a byte at a place adds to each filter."""
        return np.einsum("be,wef->wbf", self.embed, self.filters).astype(np.float32)

    def judge(self, pooled: np.ndarray, filled: np.ndarray) -> np.ndarray:
        """Chunk scores (log-odds) from pooled filter answers and the bytes that chunks have."""
        return np.tanh(features(pooled + self.bias, filled) @ self.hidden + self.hidden_bias) @ self.out + self.out_bias[0]


def features(raw: np.ndarray, filled: np.ndarray) -> np.ndarray:
    return np.column_stack([np.maximum(raw, 0), 2 * np.sqrt(filled / CHUNK)]).astype(np.float32)


def answers(tables: np.ndarray, data: np.ndarray, n: int) -> np.ndarray:
    """Each filter's answer at positions 0 to n - 1; data has WIDTH - 1 bytes more."""
    out = tables[0][data[:n]]
    step = np.empty_like(out)
    for place in range(1, WIDTH):
        np.take(tables[place], data[place : place + n], axis=0, out=step, mode="clip")
        out += step
    return out


def score_texts(net: Net, tables: np.ndarray, texts: list[bytes]) -> np.ndarray:
    """Probability that a text is good, for each."""
    sizes = np.array([len(t) for t in texts], np.int64)
    halves = np.maximum(1, -(-sizes // HALF))  # a text is laid out from the start of a half; what is left of the last is zero
    starts = np.concatenate([[0], np.cumsum(halves)])
    data = np.zeros(int(starts[-1]) * HALF + WIDTH, np.uint8)
    for text, at in zip(texts, (starts[:-1] * HALF).tolist(), strict=True):
        data[at : at + len(text)] = np.frombuffer(text, np.uint8)
    best = np.empty((int(starts[-1]), FILTERS), np.float32)
    lasts, edge = starts[1:] - 1, WIDTH - 1
    ends = np.zeros((len(texts), 2 * edge), np.uint8)  # the last bytes of each text's last half, and zeros: the next text isn't looked at
    ends[:, :edge] = data[(lasts[:, None] + 1) * HALF - edge + np.arange(edge)]
    for a in range(0, int(starts[-1]) * HALF, SLAB):
        n, half = min(SLAB, int(starts[-1]) * HALF - a), a // HALF
        got = answers(tables, data[a : a + n + WIDTH], n).reshape(-1, HALF, FILTERS)
        low, high = np.searchsorted(lasts, [half, half + len(got)])
        got[lasts[low:high] - half, HALF - edge :] = sum(tables[w][ends[low:high, w : w + edge]] for w in range(WIDTH))
        best[half : half + len(got)] = got.max(1)
    own = np.repeat(np.arange(len(texts)), halves)
    filled = np.clip(sizes[own] - (np.arange(len(own)) - starts[own]) * HALF, 0, HALF)
    joined = np.zeros(len(own), bool)  # a chunk is a half and the next; a text's last half alone is a chunk only if it's the sole one
    joined[:-1] = own[:-1] == own[1:]
    chunk = joined | (halves[own] == 1)
    at = np.flatnonzero(chunk)
    after = np.where(joined[at], at + 1, at)
    size = filled[at] + np.where(joined[at], filled[after], 0)
    scores = net.judge(np.maximum(best[at], best[after]), size)
    odds = np.bincount(own[at], scores * (size + 1e-3), len(texts)) / np.bincount(own[at], size + 1e-3, len(texts))
    return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def train(chunks: np.ndarray, filled: np.ndarray, label: np.ndarray, doc: np.ndarray, epochs: int, seed: int, other: tuple | None = None) -> Net:
    """Adam on the log loss of documents' chunks; each document weighs the same within its class, each class as much as the other. `other` chunks, with their bytes, labels and documents, are gone over every other time.

    A quarter of the chunks, other ones each time, are cut short, for short texts are rare among the sample.
    """
    phases = [(chunks, filled, label, doc), other or (chunks, filled, label, doc)]
    net, r = Net.fresh(seed), np.random.default_rng(seed + 1)
    params = [net.embed, net.filters, net.bias, net.hidden, net.hidden_bias, net.out, net.out_bias]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step, size = 0, 64
    for epoch in range(epochs):
        chunks, filled, label, doc = phases[epoch % 2]
        weight = (filled + 1e-3) / np.bincount(doc, filled + 1e-3)[doc]
        weight = weight * np.where(label == 1, 0.5 / weight[label == 1].sum(), 0.5 / weight[label == 0].sum()) * len(label)
        order = r.permutation(len(label))
        rate = 0.01 * (1 - epoch / epochs) + 0.0005
        for a in range(0, len(order), size):
            pick = order[a : a + size]
            data, full, m = chunks[pick].copy(), filled[pick], len(pick)
            cut = np.where(r.random(m) < 0.25, np.minimum(full, r.integers(8, CHUNK, m)), full)
            data[np.arange(data.shape[1]) >= np.where(cut < full, cut, data.shape[1])[:, None]] = 0
            tables = net.tables()
            pooled, place = np.empty((m, FILTERS), np.float32), np.empty((m, FILTERS), np.int64)
            for i in range(m):
                got = answers(tables, data[i], CHUNK)
                place[i] = got.argmax(0)
                pooled[i] = got[place[i], np.arange(FILTERS)]
            raw = pooled + net.bias
            on = features(raw, cut)
            hid = np.tanh(on @ net.hidden + net.hidden_bias)
            odds = hid @ net.out + net.out_bias[0]
            d_odds = ((1 / (1 + np.exp(-np.clip(odds, -30, 30))) - label[pick]) * weight[pick] / m).astype(np.float32)
            d_hid = np.outer(d_odds, net.out) * (1 - hid**2)
            d_raw = (d_hid @ net.hidden[:-1].T) * (raw > 0)
            seen = data[np.arange(m)[:, None, None], place[:, :, None] + np.arange(WIDTH)]  # m x FILTERS x WIDTH: the bytes that a filter answered to
            vectors = net.embed[seen]
            d_filters = np.einsum("mf,mfwe->wef", d_raw, vectors)
            d_embed = np.zeros_like(net.embed)
            np.add.at(d_embed, seen.reshape(-1), np.einsum("mf,wef->mfwe", d_raw, net.filters).reshape(-1, EMBED))
            grads = [d_embed, d_filters, d_raw.sum(0), on.T @ d_hid, d_hid.sum(0), hid.T @ d_odds, d_odds.sum(keepdims=True)]
            step += 1
            for p, g, f, s in zip(params, grads, first, second, strict=True):
                f += 0.1 * (g - f)
                s += 0.001 * (g * g - s)
                p -= rate * (f / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
                if p.ndim > 1:
                    p *= 1 - rate * 1e-3
    return net


def laid_out(texts: list[bytes], phase: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chunks of whole texts one after another, from `phase` on (from the start if a text has no more), each with the next WIDTH - 1 bytes; the bytes that each has, and its text."""
    starts = [range(phase if len(t) > phase else 0, max(len(t), 1), CHUNK) for t in texts]
    data = np.zeros((sum(map(len, starts)), CHUNK + WIDTH - 1), np.uint8)
    filled, own, k = np.zeros(len(data), np.int64), np.zeros(len(data), np.int64), 0
    for i, text in enumerate(texts):
        for at in starts[i]:
            piece = text[at : at + CHUNK + WIDTH - 1]
            data[k, : len(piece)] = np.frombuffer(piece, np.uint8)
            filled[k], own[k] = min(len(piece), CHUNK), i
            k += 1
    return data, filled, own


def fit(docs: DataFrame, labels: DataFrame, per_class: int = 1500, epochs: int = 6, seed: int = 7) -> Net | None:
    """A network that tells labels (doc_id, label 0 or 1) of docs (doc_id, text) apart; None if a class is missing.

    Only the chosen labels, 2 * per_class rows, are broadcast; the driver gets the texts of these.
    """
    common.bound_batches(docs.sparkSession)
    chosen = None
    for value in (0, 1):
        one = labels.where((F.col("label") == value) & F.col("doc_id").isNotNull()).select("doc_id", F.col("label").cast("int").alias("label"))
        one = one.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(per_class)
        chosen = one if chosen is None else chosen.unionByName(one)
    got = common.texts(docs).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "label").toArrow()
    rows = sorted(zip(*(got.column(c).to_pylist() for c in ("doc_id", "label", "text")), strict=True))  # the same whatever the partitions
    label = np.array([r[1] for r in rows], np.float32)
    if len(np.unique(label)) < 2:
        return None
    texts = [r[2].encode("utf-8", "surrogatepass") for r in rows]
    (a, a_filled, a_doc), (b, b_filled, b_doc) = (laid_out(texts, phase) for phase in (0, HALF))
    net = train(a, a_filled, label[a_doc], a_doc, epochs, seed, (b, b_filled, label[b_doc], b_doc))
    # both classes weighed the same in training: among all labels one is the likelier
    count = {r.label: r["count"] for r in labels.where("label IN (0, 1) AND doc_id IS NOT NULL").groupBy("label").count().collect()}
    net.out_bias += np.float32(np.clip(np.log(count[1] / count[0]), -4, 4))
    return net


def score(docs: DataFrame, net: Net | None, column: str = "score") -> DataFrame:
    """docs (doc_id, text, and others, which stay) with a column (in place of one of that name), the probability that the whole text is good."""
    if net is None:
        return docs.withColumn(column, F.lit(0.5))
    common.bound_batches(docs.sparkSession)
    kept = [f for f in docs.schema.fields if f.name != column]
    at = [f.name for f in kept].index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = net.tables()
        for got in batches:
            values = score_texts(net, tables, [x.encode("utf-8", "surrogatepass") if x else b"" for x in got.column(at).to_pylist()]) if got.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*got.columns, pa.array(values, pa.float64())], [*got.schema.names, column])

    from pyspark.sql.types import DoubleType, StructType

    return docs.select(*[F.col(f"`{f.name}`") for f in kept]).mapInArrow(run, StructType([*kept]).add(column, DoubleType()))
