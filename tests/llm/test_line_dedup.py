import random

import numpy as np
import pytest

from ripplework.llm import line_dedup as ld

@pytest.mark.parametrize(
    ("a", "b", "places"),
    [([1, 2, 3, 4], [9, 2, 3], {1, 2}), ([5, 6, 1, 2], [1, 2, 5, 6], {0, 1, 2, 3}), ([1, 1, 1], [1, 1], {0, 1, 2}), ([], [1], set()), ([1], [], set()), ([7, 1, 8], [9, 1, 9], {1}), ([1, 2, 3], [1, 2, 3], {0, 1, 2})],
)
def test_alignment(a, b, places):
    side = lambda x: (list(range(len(x))), x, [40] * len(x))
    assert ld.common_blocks(side(a), side(b), 30) == places


def test_blocks_are_in_a_row_in_both():
    side = lambda places, x: (places, x, [8] * len(x))
    assert ld.common_blocks(side([0, 1, 2], [1, 2, 3]), side([0, 1, 2], [1, 2, 3]), 20) == {0, 1, 2}
    assert ld.common_blocks(side([0, 1, 2], [1, 2, 3]), side([0, 2, 4], [1, 2, 3]), 20) == set()
    assert ld.common_blocks(side([0, 2, 4], [1, 2, 3]), side([0, 1, 2], [1, 2, 3]), 20) == set()
    r = random.Random(4)
    for _ in range(500):
        a, b = ([r.randint(1, 4) for _ in range(r.randint(0, 12))] for _ in range(2))
        size = {1: 1, 2: 2, 3: 3, 4: 9}
        got = ld.common_blocks((list(range(len(a))), a, [size[x] for x in a]), (list(range(len(b))), b, [size[x] for x in b]), 9)
        assert got == in_blocks(a, b, [size[x] for x in a], 9)


def in_blocks(a, b, words, block_words):
    """Places of a in runs of at least block_words words that b has, by trying all pairs of places."""
    out = set()
    for i in range(len(a)):
        for j in range(len(b)):
            k = n = 0
            while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k]:
                n += words[i + k]
                k += 1
            if n >= block_words:
                out.update(range(i, i + k))
    return out


def test_alignment_is_a_common_order():
    r = random.Random(1)
    for _ in range(200):
        a, b = ([r.randint(0, 12) for _ in range(r.randint(0, 25))] for _ in range(2))
        found = ld.patience(a, b)
        assert all(a[i] == b[j] for i, j in found)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(found, found[1:], strict=False))


def test_lines():
    text = 'One two. "Three!" Four?) Five…\nSix.Seven。Eight！Nine'.encode()
    assert ld.lines_of(text) == [x.encode() for x in ("One two. ", '"Three!" ', "Four?) ", "Five…\n", "Six.Seven。", "Eight！", "Nine")]
    r = random.Random(8)
    words = [f"w{r.randint(0, 9000)}" for _ in range(400)]
    parts = [" ".join(x).encode() for x in (words, [*["q"] * 50, *words[100:300], *["r"] * 50])]
    cut = [ld.lines_of(x) for x in parts]
    assert [b"".join(x) for x in cut] == parts and all(len(x) > 10 for x in cut)
    shared = {x.strip() for x in cut[0]} & {x.strip() for x in cut[1]}
    assert sum(len(x.split()) for x in shared) > 150


def test_ends():
    r = random.Random(6)
    for _ in range(200):
        words = [r.randint(1, 9) for _ in range(r.randint(0, 20))]
        want = [next((j for j in range(i, len(words) + 1) if sum(words[i:j]) >= 12), len(words) + 1) for i in range(len(words))]
        assert ld.ends_of(np.array(words, np.int32), 12).tolist() == want


def simple(rows, block_words):
    """What goes, by comparing each document with every earlier one."""
    out = []
    split = lambda t: ld.lines_of((t or "").encode())
    full = lambda t: [x.split() for x in split(t) if x.split()]
    order = lambda d: ld.FIRST if d is None else d
    for doc_id, text in rows:
        own = full(text)
        gone = set()
        for d, t in rows:
            if order(d) < order(doc_id):
                theirs = full(t)
                gone |= in_blocks(own, theirs, [len(x) for x in own], block_words)
        keep, at, lines = [], -1, split(text)
        places = []
        for x in lines:
            at += bool(x.split())
            places.append(at if x.split() else None)
        for i, x in enumerate(lines):
            before = next((p for p in reversed(places[:i]) if p is not None), -1)
            lost = places[i] in gone if places[i] is not None else before in gone and before + 1 in gone
            if not lost:
                keep.append(x)
        out.append((doc_id, None if text is None else b"".join(keep).decode()))
    return out


def sentence(r, n):
    return " ".join(f"w{r.randint(0, 5000)}" for _ in range(n)) + "."


def test_passages_against_a_simple_version(spark):
    r = random.Random(2)
    hot = " ".join(sentence(r, 11) for _ in range(6))
    rows = [(i, "\n".join([sentence(r, 12) for _ in range(5)] + ([hot] if i % 2 else []) + [sentence(r, 9)])) for i in range(60)]
    rows += [(100, rows[3][1]), (101, rows[3][1]), (102, f"{sentence(r, 8)} {hot} {sentence(r, 8)}"), (103, "Of it. " * 3), (104, "Of it. " * 3), (105, None), (106, ""), (None, hot), (107, "x " * 50_000)]
    docs = spark.createDataFrame([(*x, "en", 3) for x in rows], "doc_id long, text string, lang string, words int")
    got = ld.dedup_lines(docs).collect()
    assert sorted(((x.doc_id is not None, x.doc_id or 0), x.text or "") for x in got) == sorted(((d is not None, d or 0), t or "") for d, t in simple(rows, 20))
    by_id = {x.doc_id: x for x in got}
    assert by_id[100].text == "" and hot not in by_id[102].text and by_id[103].text == by_id[104].text == "Of it. " * 3
    assert by_id[105].text is None and by_id[None].text == hot and by_id[1].lang == "en" and by_id[1].words == 3


def test_repeated_passages(spark):
    r = random.Random(3)
    passage = " ".join(sentence(r, 11) for _ in range(4))
    other = lambda: " ".join(sentence(r, 9) for _ in range(3))
    several = lambda n: "\n".join(x for _ in range(n) for x in (other(), passage)) + "\n" + other()
    rows = [(1, several(2)), (2, several(1)), (3, several(13)), (4, several(3)), (5, other())]
    got = {x.doc_id: x for x in ld.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {d: x.text for d, x in got.items()} == dict(simple(rows, 20))
    assert [got[d].words_removed for d in range(1, 6)] == [0, 44, 13 * 44, 3 * 44, 0]


def test_passages_of_short_lines(spark):
    r = random.Random(5)
    menu = "\n\n".join(sentence(r, r.randint(1, 3)) for _ in range(14))
    verse = "\n".join(sentence(r, n) for n in (8, 3, 8, 2, 1))
    junk = " ".join(f"w{r.randint(0, 5000)}!!" for _ in range(60))
    rows = [(i, "\n".join([sentence(r, 12), (menu, verse, junk)[i % 3], sentence(r, 9)])) for i in range(12)]
    rows += [(20, junk), (21, menu.replace("\n\n", "\n")), (22, "\n".join(sentence(r, 2) for _ in range(30)))]
    got = {x.doc_id: x.text for x in ld.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {d: t.split() for d, t in got.items()} == {d: t.split() for d, t in simple(rows, 20)}
    assert got[20] == got[21] == "" and verse not in got[4] and got[0] == rows[0][1] and got[22] == rows[-1][1]


def test_sentences_of_several_documents_are_no_block(spark):
    r = random.Random(7)
    three = [sentence(r, 8) for _ in range(3)]
    far = lambda x: f"{sentence(r, 30)} {x} {sentence(r, 30)}"
    rows = [(i, far(x)) for i, x in enumerate(three)] + [(3, " ".join([sentence(r, 9) for _ in range(9)])), (9, far(" ".join(three))), (10, far(" ".join(three)))]
    got = {x.doc_id: x for x in ld.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {d: x.text for d, x in got.items()} == dict(simple(rows, 20))
    assert got[9].words_removed == 0 and got[10].words_removed == 24


@pytest.mark.parametrize("hot", [1 << 11, 4])
def test_hot_anchors(spark, monkeypatch, hot):
    monkeypatch.setattr(ld, "HOT", hot)
    r = random.Random(9)
    passages = [" ".join(sentence(r, r.randint(3, 14)) for _ in range(4)) for _ in range(12)]
    rows = []
    for i in range(80):
        rows.append((r.randint(0, 60) if i % 9 else None, "\n".join(r.choice(passages) if r.random() < 0.6 else sentence(r, r.randint(2, 30)) for _ in range(r.randint(1, 9)))))
    docs = spark.createDataFrame(rows + rows[:5], "doc_id long, text string")
    got = sorted((x.doc_id is not None, x.doc_id or 0, x.text) for x in ld.dedup_lines(docs).collect())
    assert got == sorted((d is not None, d or 0, t) for d, t in simple(rows + rows[:5], 20))


def test_whole_table(spark, sf_dir):
    rows = [(x.doc_id, x.text) for x in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = {x.doc_id: x.text for x in ld.dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect()}
    assert got == dict(simple(rows, 20))


def test_same_id_and_empty_table(spark):
    long = " ".join(f"v{i}" for i in range(60)) + "."
    docs = spark.createDataFrame([(1, long), (1, long), (2, long)], "doc_id long, text string")
    assert sorted((x.doc_id, x.text) for x in ld.dedup_lines(docs).collect()) == [(1, long), (1, long), (2, "")]
    assert ld.dedup_lines(docs.limit(0)).collect() == []
