import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ripplework.llm import entries, packing, token_files, tokens

WORDS = st.lists(st.sampled_from([*"aAbZé.,!?&%'s \n\t\x01\x0b0199<|>#ÀΣß", "<|endoftext|>", "<|ENDOFTEXT|>", "'ll", "́", "wörd", "The,", " and "]), max_size=40).map("".join)


@pytest.fixture(scope="module")
def encoder():
    return tokens.BatchEncoder(entries.vocabulary())


@given(texts=st.lists(WORDS, max_size=8))
@settings(max_examples=150, deadline=None)
def test_ids_are_the_librarys(encoder, texts):
    ids, bounds = encoder(pa.array(texts, pa.string()))
    got = [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:], strict=False)]
    assert got == [x.ids for x in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_a_small_cache_changes_nothing(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_WORDS", 3)
    encoder = tokens.BatchEncoder(entries.vocabulary())
    for text in ("one two, three. four", "five six seven one", "two, eight"):
        assert encoder(pa.array([text]))[0].tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids


@given(counts=st.lists(st.integers(0, 1000), min_size=1, max_size=200), limit=st.integers(8, 14))
@settings(max_examples=100, deadline=None)
def test_code_is_prefix_free_limited_and_decodes(counts, limit):
    counts = np.array(counts)
    lengths = token_files.code_lengths(counts, limit)
    assert ((lengths > 0) == (counts > 0)).all() and lengths.max() <= limit
    assert sum(2.0 ** -int(x) for x in lengths if x) <= 1
    ids = np.repeat(np.arange(len(counts)), np.minimum(counts, 5))
    np.random.default_rng(0).shuffle(ids)
    payload, bits, checkpoints = token_files.encode(ids, lengths, token_files.canonical(lengths), 16)
    assert bits == lengths[ids].sum() and len(payload) == -(-bits // 8)
    assert (token_files.Decoder(lengths)(payload, len(ids), checkpoints, 16) == ids).all()
    for k in range(0, len(checkpoints)):  # from any checkpoint
        part = token_files.Decoder(lengths)(payload, min(16, len(ids) - 16 * k), checkpoints[k : k + 1], 16)
        assert (part == ids[16 * k : 16 * k + 16]).all()


def test_optimal_lengths():
    lengths = token_files.code_lengths(np.array([1, 1, 2, 4, 8]), 16)
    assert lengths.tolist() == [4, 4, 3, 2, 1]
    assert token_files.code_lengths(np.array([1, 1, 2, 4, 8]), 3).max() == 3


ROWS = [(5, "b a b", "z"), (None, "null id", "z"), (1, None, "z"), (2, "", "z"), (3, "same", "z"), (3, "same", "z"), (9, "long text, " * 30_000, "z")]
SCHEMA = "doc_id long, text string, start string"


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_files_round_trip(spark, tmp_path, encoder):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    token_files.write(docs, str(tmp_path / "t"), entries.vocabulary(), block_ids=8, every=4)
    got = token_files.digest(token_files.read(spark, str(tmp_path / "t"))).orderBy("start").collect()
    start = 0
    for r, (doc_id, text, _) in zip(got, sorted(ROWS, key=lambda x: (x[0] is not None, x[0] or 0)), strict=True):
        ids = [*encoder.tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc_id, start, len(ids), crc(ids))
        start += len(ids)
    token_files.write(docs.limit(0), str(tmp_path / "e"), entries.vocabulary())
    assert token_files.read(spark, str(tmp_path / "e")).collect() == []


def packed(pieces, docs, encoder, length):
    """Check all that packing promises; the share of padding."""
    want = sorted([*encoder.tokenizer.encode(text or "", add_special_tokens=False).ids, 2] for text in docs)
    own, sequences = {}, {}
    for r in pieces:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert len(ids) == r.length > 0
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length, r.sequence_tokens))
        own.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, ids))
    got = []
    for (_, total), parts in own.items():
        parts.sort()
        joined = [i for _, ids in parts for i in ids]
        assert len(joined) % total == 0
        got += [total] * (len(joined) // total)
    assert sorted(got) == sorted(map(len, want))
    padding = 0
    for parts in sequences.values():
        at = 0
        for offset, size, total in sorted(parts):
            assert offset == at
            at += size
        assert at == total <= length
        padding += 0 if at & (at - 1) == 0 else length - at
    return padding / max(1, sum(map(len, want)))


def test_packing(spark, encoder, sf_dir):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    packed(packing.pack_documents(docs, entries.vocabulary(), length=64, item=16).collect(), [r[1] for r in ROWS], encoder, 64)
    assert packing.pack_documents(docs.limit(0), entries.vocabulary()).collect() == []
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").coalesce(1)
    pieces = packing.pack_documents(docs, entries.vocabulary()).collect()
    assert packed(pieces, [r.text for r in docs.select("text").collect()], encoder, 4096) < 0.03
    by_doc = {r.doc_id: [*encoder.tokenizer.encode(r.text, add_special_tokens=False).ids, 2] for r in docs.collect()}
    for r in packing.digest(packing.pack_documents(docs, entries.vocabulary())).collect():
        assert r.ids_crc32 == crc(by_doc[r.doc_id][r.start : r.start + r.length])


@given(sizes=st.lists(st.integers(1, 512), max_size=80), k=st.integers(1, 12))
@settings(max_examples=100, deadline=None)
def test_differencing_places_each_item_once(sizes, k):
    windows = packing.differencing(np.array(sizes, np.int64), k)
    assert len(windows) == k and sorted(i for w in windows for i in w) == list(range(len(sizes)))


def test_differencing_balances_better_than_the_largest_item():
    sizes = np.random.default_rng(1).integers(1, 512, 2000)
    sums = [sizes[w].sum() for w in packing.differencing(sizes, 50)]
    assert max(sums) - np.mean(sums) < 32
    assert all(sizes[w].sum() <= 4096 for w in packing.fitted(sizes, 4096, 20))
