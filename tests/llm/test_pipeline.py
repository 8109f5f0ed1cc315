import random

import numpy as np

import corpus_pipeline
from ripplework.llm import common, decontamination, entries, quality_net

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_network_on_held_out_labels(spark, sf_dir):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    got = [r for r in entries.op1_quality_net(spark, sf_dir).collect() if r.held_out and r.doc_id in labels]
    assert sum(r.predicted == labels[r.doc_id] for r in got) >= 0.9 * len(got)
    assert all(0 <= r.score <= 1 for r in got)


def test_scores_cover_whole_texts_and_odd_rows(spark):
    r = random.Random(0)
    good = lambda: " ".join(r.choice(["the house", "and then", "of water", "with light", "in towns"]) for _ in range(120)) + "."
    bad = lambda: " ".join(r.choice(["zz&&&", "qq%%%", "xx###"]) for _ in range(200))
    rows = [(i, good() if i % 2 else bad(), i % 2) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label int")
    net = quality_net.fit(docs.drop("label"), docs.select("doc_id", "label"), per_class=60)
    odd = spark.createDataFrame([(1, None, "z"), (2, "", "z"), (None, good(), "z"), (None, good(), "z"), (4, good() + " " + " ".join(bad() for _ in range(40)), "z")], "doc_id long, text string, score string")
    got = quality_net.score(odd, net).collect()
    assert got[0].score == got[1].score and got[2].score > 0.5 and got[4].score < 0.5  # a bad rest outweighs a good beginning
    assert quality_net.fit(docs.drop("label"), docs.select("doc_id", "label").where("label = 1")) is None
    assert quality_net.score(odd, None).first().score == 0.5
    assert quality_net.score(odd.limit(0), net).collect() == []


def test_scores_against_one_chunk_at_a_time():
    net, r = quality_net.Net.fresh(3), random.Random(2)
    texts = [b"", b"a", bytes(r.randrange(256) for _ in range(255)), *(bytes(r.randrange(97, 123) for _ in range(r.randint(1, 3000))) for _ in range(40))]
    for text, got in zip(texts, quality_net.score_texts(net, net.tables(), texts), strict=True):
        odds = weight = 0.0
        for at in range(0, max(len(text) - quality_net.HALF, 1), quality_net.HALF):
            piece = np.zeros(quality_net.CHUNK + quality_net.WIDTH, np.uint8)
            own = np.frombuffer(text[at : at + len(piece)], np.uint8)
            piece[: len(own)] = own
            positions = quality_net.CHUNK if at + quality_net.HALF < len(text) else quality_net.HALF
            raw = [sum(net.embed[piece[i + w]] @ net.filters[w] for w in range(quality_net.WIDTH)) for i in range(positions)]
            size = min(quality_net.CHUNK, len(text) - at)
            odds += net.judge(np.max(raw, 0)[None], np.array([size]))[0] * (size + 1e-3)
            weight += size + 1e-3
        assert abs(got - 1 / (1 + np.exp(-odds / weight))) < 1e-4, len(text)


def test_training_sees_every_byte():
    texts = [b"", b"x" * 100, bytes(range(256)) * 9, b"y" * 256, b"z" * 512]
    for phase in (0, quality_net.HALF):
        data, filled, own = quality_net.laid_out(texts, phase)
        for i, text in enumerate(texts):
            assert b"".join(d[:n].tobytes() for d, n in zip(data[own == i], filled[own == i], strict=True)) == text[phase if len(text) > phase else 0 :]


def test_gradients():
    """Training lowers the loss on what a linear filter can tell apart."""
    r = np.random.default_rng(0)
    data = r.integers(97, 123, (200, quality_net.CHUNK + quality_net.WIDTH - 1)).astype(np.uint8)
    label = (np.arange(200) % 2).astype(np.float32)
    data[label == 0, 100:103] = ord("%")
    net = quality_net.train(data, np.full(200, quality_net.CHUNK), label, np.arange(200), 25, 1)
    scores = quality_net.score_texts(net, net.tables(), [d.tobytes() for d in data])
    assert ((scores > 0.5) == (label == 1)).mean() > 0.9


def test_stages(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before, docs = docs, common.staged(stage(spark, docs, sf_dir), name)
        if k < 4:
            assert docs.columns == COLUMNS and docs.dtypes == before.dtypes and 0 < docs.count() <= before.count()
        if name == "near_dedup":
            assert docs.select("doc_id").distinct().count() == docs.count()
    assert docs.groupBy("sequence_id").sum("length").where("`sum(length)` > 4096").count() == 0
    clean = decontamination.find_contamination(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark")).where("n_hit > 0")
    assert clean.join(docs, "doc_id").count() == 0


def test_empty_and_odd_rows_pass(spark, sf_dir, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, None, None, None, None), (None, "a text", "en", None, 6), (2, "", "en", "s", 0), (3, "same words here", "en", "s", 15), (3, "same words here", "en", "s", 15), (4, "very long " * 60_000 + "end", "en", "s", 9)]
    for name, data in (("some", rows), ("none", [])):
        folder = str(tmp_path / name)
        spark.createDataFrame(data, schema).write.parquet(f"{folder}/documents.parquet")
        for t in ("labels", "benchmark"):
            spark.read.parquet(f"{sf_dir}/{t}.parquet").limit(0).write.parquet(f"{folder}/{t}.parquet")
        ids = [r.doc_id for r in corpus_pipeline.run(spark, folder).collect()]
        assert sorted(ids, key=lambda x: (x is not None, x)) == ([None, 1, 3] if data else []) or set(ids) <= {None, 1, 2, 3, 4}
        assert ids.count(3) == (1 if data else 0)


def test_columns_that_clash_stay(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents").selectExpr("*", "'a' AS score", "'b' AS lines_removed", "1 AS class", "'c' AS node")
    for _, stage in corpus_pipeline.STAGES[:4]:
        after = common.staged(stage(spark, docs, sf_dir), "stage")
        assert after.dtypes == docs.dtypes and after.where("score = 'a' AND lines_removed = 'b' AND class = 1 AND node = 'c'").count() == after.count()
        docs = after
