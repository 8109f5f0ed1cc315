import hashlib
import re

from ripplework.llm import decontamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def brute(docs, items, width):
    windows = {}
    for item_id, text in items:
        words = WORD.findall(lower(text))
        for i in range(max(1, len(words) - width + 1) if words else 0):
            windows.setdefault(tuple(words[i : i + width]), set()).add(item_id)
    out = {}
    for doc_id, text in docs:
        words, hit, found = WORD.findall(lower(text)), set(), set()
        for size in {len(w) for w in windows}:
            for i in range(len(words) - size + 1):
                if ids := windows.get(tuple(words[i : i + size])):
                    hit |= set(range(i, i + size))
                    found |= ids
        out[doc_id] = (len(words), len(hit), sorted(found))
    return out


def check(spark, docs, items, width=10, limit=decontamination.LIMIT):
    d = spark.createDataFrame([(*x, "z", 7) for x in docs], "doc_id long, text string, item_id string, n_words int")
    b = spark.createDataFrame([(*x, "z") for x in items], "item_id long, text string, doc_id string")
    got = decontamination.find_contamination(d, b, width, limit).collect()
    assert {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in got} == brute(docs, items, width)
    return {r.doc_id: r for r in got}


def test_windows_short_items_ties_and_offsets(spark):
    long = " ".join(f"w{i}" for i in range(14))
    items = [(1, long), (2, "Só Élan"), (3, None), (4, ""), (5, "sÓ élan"), (6, long), (6, long), (7, "...")]
    docs = [(1, "x " + long.upper() + " y"), (2, "a-SÓ,\n élan! SÓ Élan"), (3, None), (4, ""), (5, " ".join(f"w{i}" for i in range(9))), (6, "x" * 50_000 + " " + long * 40)]
    got = check(spark, docs, items, width=10)
    assert [tuple(s) for s in got[1].spans] == [(2, 2 + len(long))]
    check(spark, docs, items, width=10, limit=20)  # one automaton for each part
    check(spark, docs, [], width=10)


def test_null_item_ids(spark):
    long = " ".join(f"w{i}" for i in range(12))
    docs = spark.createDataFrame([(1, long), (2, "no such words"), (None, long), (1, long), (1, "x")], "doc_id long, text string")
    items = spark.createDataFrame([(5, long), (None, long), (None, "such"), (4, "w3")], "item_id long, text string")
    for limit in (decontamination.LIMIT, 30):
        got = decontamination.digest(decontamination.find_contamination(docs, items, 10, limit)).collect()
        found = sorted((r.doc_id is not None, r.doc_id or 0, r.n_words, r.n_hit, r.n_items, r.items_sha256[:6]) for r in got)
        two, none = hashlib.sha256(b"4,5").hexdigest()[:6], hashlib.sha256(b"").hexdigest()[:6]
        assert found == [(False, 0, 12, 12, 3, two), (True, 1, 1, 0, 0, none), (True, 1, 12, 12, 3, two), (True, 1, 12, 12, 3, two), (True, 2, 3, 1, 1, none)]
        assert [r.text for r in decontamination.clean(docs, items, 10, limit).collect()] == ["x"]


def test_empty_tables(spark):
    d, b = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert decontamination.find_contamination(d, b).collect() == []


def test_whole_table_against_brute_force(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    got = check(spark, docs, items)
    assert any(r.n_hit for r in got.values())
