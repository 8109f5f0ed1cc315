import itertools
import math
import os
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from ripplework.llm import near_dedup as nd

R = random.Random(5)
WORDS = [f"w{i}" for i in range(4000)]


def longest(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            row[j], before = (before + 1 if x == y else max(row[j], row[j - 1])), row[j]
    return row[-1]


def test_banded_alignment_against_the_full_table():
    for _ in range(300):
        a = [R.randint(0, 30) for _ in range(R.randint(1, 40))]
        b = list(a)
        for _ in range(R.randint(0, 6)):
            k = R.randrange(len(b)) if b else 0
            b[k : k + R.randint(0, 1)] = [R.randint(0, 30)] * R.randint(0, 1)
        if not b:
            continue
        m = longest(a, b)
        reaches = m >= 0.8 * (len(a) + len(b) - m) - 1e-9
        x, y = np.array(a, np.uint64), np.array(b, np.uint64)
        assert nd.similar(x, y, 0.8) == reaches
        if reaches:
            assert nd.aligned_shingles(x, y, 0.8) == m


def shingles(text):
    words, bounds = nd.word_hashes(pa.array([text or ""]))
    return nd.shingles(words, bounds, 5)[0]


def brute(rows):
    """Class of each row, by comparing all pairs."""
    seqs = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if nd.similar(seqs[i], seqs[j], 0.8):
            a, b = root(i), root(j)
            parent[max(a, b)] = min(a, b)
    groups = {}
    for i, (doc_id, _) in enumerate(rows):
        groups.setdefault(root(i), []).append(nd.FIRST if doc_id is None else doc_id)
    return [min(groups[root(i)]) for i in range(len(rows))]


def edited(words, n):
    out = list(words)
    for _ in range(n):
        out[R.randrange(len(out))] = R.choice(WORDS)
    return out


def corpus():
    rows, base = [], R.choices(WORDS, k=200)
    chain = base
    for _ in range(40):  # a chain: each is near the one before, its ends are far apart
        chain = edited(chain, 2)
        rows.append(" ".join(chain))
    rows += [" ".join(edited(base, R.randint(0, 4))) for _ in range(60)]
    passage = R.choices(WORDS, k=60)
    rows += [" ".join(R.choices(WORDS, k=R.randint(20, 60)) + passage) for _ in range(40)]  # share a passage, aren't near
    rows += [" ".join(passage)] * 30 + ["short"] * 3 + ["a b c d e", "a b c d e f"]
    half = R.choices(WORDS, k=100)
    rows += [" ".join(half[:50] + half[50:]), " ".join(half[50:] + half[:50])]  # the order counts
    rows += [" ".join(["again"] * 30), " ".join(["again"] * 31), " ".join(["again"] * 60)]  # repeats count
    rows += [None, "", " \n", " a  b\tc d e "]
    R.shuffle(rows)
    return [(i if i % 37 else None, t) for i, t in enumerate(rows)] + [(3, rows[3]), (4, "another text of number four")]


def test_classes_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(nd, "PIECE_TEXTS", 8)  # buckets are cut into pieces
    rows = corpus()
    docs = spark.createDataFrame([(*r, "z", 1) for r in rows], "doc_id long, text string, class_id string, node int")
    got = nd.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    want = sorted((nd.FIRST if d is None else d, c) for (d, _), c in zip(rows, brute(rows), strict=True))
    assert sorted((nd.FIRST if r.doc_id is None else r.doc_id, nd.FIRST if r.class_id is None else r.class_id) for r in got) == want


def test_one_of_each(spark):
    rows = [(5, "x y z"), (2, "x  y z"), (2, "x y z"), (7, "p q r"), (7, "p q r"), (7, "another text"), (None, None)]
    kept = nd.one_of_each(spark.createDataFrame([(*r, "en") for r in rows], "doc_id long, text string, lang string")).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in kept) == [(False, 2), (False, 7), (False, 7), (True, 0)] and kept[0].lang == "en"


def test_empty_table(spark):
    assert nd.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.mark.parametrize("n", [1, 2, 30])
def test_components(spark, n):
    links = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(100, 101)], "a long, b long")
    got = {r.node: r["class"] for r in nd.components(links).collect()}
    assert got == {**{i: 0 for i in range(n + 1)}, 100: 100, 101: 100}


def test_real_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    got = {r.doc_id: r.class_id for r in nd.near_duplicates(docs).collect()}
    assert got == {d: c for (d, _), c in zip(rows, brute(rows), strict=True)}


def test_classes_of_a_whole_table_against_all_pairs(spark, sf_dir):
    """Every pair that can reach 0.8 meets by an exact prefix filter, without sketches, and is aligned in the full table."""
    path = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.01")
    docs = spark.read.parquet(f"{path if os.path.exists(path) else sf_dir}/documents.parquet")
    ids = defaultdict(list)
    for row in docs.select("doc_id", "text").collect():
        ids[tuple(re.findall(r"[^\x20\x09-\x0D]+", row.text or ""))].append(row.doc_id)
    texts = sorted(ids, key=len)
    runs = [[w[i : i + 5] for i in range(max(1, len(w) - 4))] if w else [] for w in texts]
    often = Counter(x for r in runs for x in set(r))
    parent, index = list(range(len(texts))), defaultdict(list)

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, own in enumerate(runs):
        seen, labelled = Counter(), []
        for x in own:
            labelled.append((often[x], x, seen[x]))
            seen[x] += 1
        met = set()
        for _, x, k in sorted(labelled)[: len(own) - math.ceil(0.8 * len(own) - 1e-9) + 1]:
            met.update(index[x, k])
            index[x, k].append(i)
        for j in met:
            reaches = lambda m, n=len(own) + len(runs[j]): m >= 0.8 * (n - m) - 1e-9
            if reaches((seen & Counter(runs[j])).total()) and reaches(longest(own, runs[j])):
                parent[root(i)] = root(j)
    classes = defaultdict(list)
    for i, w in enumerate(texts):
        classes[root(i)] += ids[w]
    want = {d: min(c) for c in classes.values() for d in c}
    got = {r.doc_id: r.class_id for r in nd.near_duplicates(docs).collect()}
    assert got == want and len(set(parent)) < len(texts)
