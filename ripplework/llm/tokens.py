"""Token ids of whole Arrow columns, with each distinct word encoded once per worker."""

from __future__ import annotations

import json
import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Distinct words that a worker remembers; later ones, mostly rare, are encoded for each batch that has them.
CACHE_WORDS = 400_000
#: Words in one call of the library; a character that stands between them; punctuation that is split off.
GROUP, MARK, TAIL = 128, "\x01", ".,!?&%$#*;:"
PLAIN = re.compile("[a-z]+").fullmatch


def traits(path: str) -> tuple[bool, bool]:
    """Whether the vocabulary file removes white space between words, so that words are encoded independently of each other, and whether it lower-cases."""
    with open(path, encoding="utf-8") as f:
        file = json.load(f)
    steps = file.get("pre_tokenizer") or {}
    steps = steps.get("pretokenizers", [steps])
    by_word = bool(steps) and steps[0].get("type") == "Split" and steps[0].get("behavior") == "Removed" and steps[0].get("invert") is True
    normal = file.get("normalizer") or {}
    return by_word, any(x.get("type") == "Lowercase" for x in normal.get("normalizers", [normal]))


def parted(words: pa.LargeStringArray) -> tuple[pa.Array, pa.Array]:
    """Words without the punctuation that follows an ASCII letter at their end, and that punctuation: the two are always encoded separately."""
    n = len(words)
    base = pc.ascii_rtrim(words, characters=TAIL)
    whole, cut = (np.frombuffer(x.buffers()[1], np.int64, n + 1, 8 * x.offset) for x in (words, base))
    tail = np.diff(whole) - np.diff(cut)
    letters = np.frombuffer(base.buffers()[2] or b"", np.uint8)
    ends = np.zeros(n, np.uint8)
    some = np.diff(cut) > 0
    ends[some] = letters[cut[1:][some] - 1] | 32
    tail = np.where((ends >= 97) & (ends <= 122), tail, 0)
    base = pc.if_else(pa.array(tail > 0), base, words)
    at = np.concatenate([[0], np.cumsum(tail)])
    chars = np.frombuffer(words.buffers()[2] or b"", np.uint8)[np.repeat(whole[1:] - at[1:], tail) + np.arange(at[-1])]
    return base, pa.LargeStringArray.from_buffers(n, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(chars.tobytes()))


class BatchEncoder:
    """Encodes a string array into one flat id array and its row offsets.

    Where the vocabulary drops white space, a text's ids are those of its words in turn (words here: runs
    between ASCII white space). Words are then split and deduplicated by Arrow, each distinct one is encoded
    by the tokenizers library once, and ids are gathered with numpy. Other vocabularies encode whole texts.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks fill the cores already
        self.tokenizer = Tokenizer.from_file(path)
        self.by_word, self.lowers = traits(path)
        self.row: dict[str, int] = {"": 0}
        self.flat, self.starts, self.sizes = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.kept = 1, 0  # rows and ids that stay
        mark = self.tokenizer.encode(MARK, add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None
        probes = ["a", "the", "qzx", "wordsthatgoonandon", "zz" * 30]  # whether plain letters are one piece to the vocabulary, and unchanged
        self.direct = self.by_word and all([t.id for t in self.tokenizer.model.tokenize(w)] == self.tokenizer.encode(w, add_special_tokens=False).ids for w in probes)

    def _encode(self, words: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The words in another order, the ids of all, and how many each has.

        Plain letters go straight to the vocabulary's model. Many others go into one call, a mark between them,
        for the library takes long to set up each result.
        """
        plain = [w for w in words if PLAIN(w)] if self.direct else []
        others = [w for w in words if not PLAIN(w)] if self.direct else words
        tokenize = self.tokenizer.model.tokenize
        own = [[t.id for t in tokenize(w)] for w in plain]
        flat, sizes = [np.fromiter(chain.from_iterable(own), np.uint32)], [np.fromiter(map(len, own), np.int64, len(own))]
        for a in range(0, len(others), GROUP):
            group = others[a : a + GROUP]
            joined = f" {MARK} ".join(group)
            if self.mark is not None and joined.count(MARK) == len(group) - 1 and "<|" not in joined:
                ids = np.array(self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, np.uint32)
                cuts = np.flatnonzero(ids == self.mark)
                if len(cuts) == len(group) - 1:
                    flat.append(np.delete(ids, cuts))
                    sizes.append(np.diff(np.concatenate([[-1], cuts, [len(ids)]])) - 1)
                    continue
            own = [x.ids for x in self.tokenizer.encode_batch_fast(group, add_special_tokens=False)]
            flat.append(np.array([i for x in own for i in x], np.uint32))
            sizes.append(np.array([len(x) for x in own], np.int64))
        return plain + others, np.concatenate(flat), np.concatenate(sizes)

    def _store(self, words: list[str]) -> dict[str, int]:
        """Encode words and put their ids after those that stay; the row of each."""
        words, ids, sizes = self._encode(words)
        (rows, end), n = self.kept, len(words)
        if end + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat[:end], np.zeros(end + 2 * len(ids), np.uint32)])
        if rows + n > len(self.starts):
            self.starts, self.sizes = (np.concatenate([x[:rows], np.zeros(rows + 2 * n, np.int64)]) for x in (self.starts, self.sizes))
        self.flat[end : end + len(ids)] = ids
        self.starts[rows : rows + n], self.sizes[rows : rows + n] = end + np.cumsum(sizes) - sizes, sizes
        here = dict(zip(words, range(rows, rows + n), strict=True))
        if rows + n <= CACHE_WORDS:
            self.row |= here
            self.kept = rows + n, end + len(ids)
        return here

    def _rows(self, words: list[str]) -> np.ndarray:
        """The row of self.starts and self.sizes for each of the words, good until the next call; row 0 has no ids."""
        known = self.row.get
        rows = np.fromiter((known(x, -1) for x in words), np.int64, len(words))
        missing = np.flatnonzero(rows < 0)
        if len(missing):
            fresh = dict.fromkeys(words[i] for i in missing.tolist())
            here = self._store(list(fresh))
            rows[missing] = [here[words[i]] for i in missing.tolist()]
        return rows

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if not self.by_word:
            got = [x.ids for x in self.tokenizer.encode_batch(texts.to_pylist(), add_special_tokens=False)]
            sizes = np.array([len(x) for x in got], np.int64)
            ids = np.concatenate([np.array(x, np.uint32) for x in got]) if got else np.zeros(0, np.uint32)
            return ids, np.concatenate([[0], np.cumsum(sizes)])
        texts = texts.cast(pa.large_string())
        if len(texts) and self.lowers and not pc.any(pc.match_substring(texts, "<|")).as_py():  # a special token's name keeps its case
            if texts.offset or np.frombuffer(texts.buffers()[1], np.int64, 1)[0]:  # a slice, for which Arrow's lower-casing gives wrong offsets
                texts = texts.take(pa.array(np.arange(len(texts))))
            texts = pc.ascii_lower(texts)
        words = pc.ascii_split_whitespace(texts)
        bounds = np.asarray(words.offsets, np.int64)
        coded = pc.dictionary_encode(words.values.slice(bounds[0], bounds[-1] - bounds[0]))
        base, tail = parted(coded.dictionary)
        base, tail = pc.dictionary_encode(base), pc.dictionary_encode(tail)
        rows = self._rows(base.dictionary.to_pylist() + tail.dictionary.to_pylist())
        rows = np.column_stack([rows[np.asarray(base.indices)], rows[len(base.dictionary) + np.asarray(tail.indices)]])
        named, of_name = gathered(self.flat, self.starts[rows.reshape(-1)], self.sizes[rows.reshape(-1)])
        of_name = of_name[::2]  # a name's two rows are next to each other
        names = np.asarray(coded.indices)
        ids, of_word = gathered(named, of_name[names], np.diff(of_name)[names])
        return ids, of_word[bounds - bounds[0]]


def gathered(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stretches of flat one after another, and where each begins and ends."""
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    small = np.int32 if bounds[-1] + len(flat) < 1 << 31 else np.int64
    at = np.repeat((starts - bounds[:-1]).astype(small), sizes)
    at += np.arange(bounds[-1], dtype=small)
    return flat[at], bounds


def with_end(ids: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same rows, each followed by end_id."""
    return np.insert(ids, offsets[1:], np.uint32(end_id)), offsets + np.arange(len(offsets))
