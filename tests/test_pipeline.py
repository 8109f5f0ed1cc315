import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from ripplework.operators import embedding
from ripplework.operators.segments import SegmentConfig
from ripplework.plans import pipeline
from ripplework.sources import manifests, signals, tensors

SR = 8000


@pytest.fixture(scope="module")
def recordings(spark):
    t = np.arange(8 * SR) / SR
    rows = [("a", (0.5 * np.sin(2 * np.pi * 220 * t)).tolist()), ("b", (0.3 * np.sin(2 * np.pi * 440 * t[: 2 * SR])).tolist())]
    return spark.createDataFrame(rows, "rec_id string, x array<double>").cache()


CONFIG = SegmentConfig(segment_len=2.0, hop=1.0, max_seq_len=5, k_start=2, k_end=2)
NAMES = ["loudness_extractor", "tempo", "quality", "spectral_extractor"]


def test_modes(recordings):
    out = pipeline.process(recordings, "both", CONFIG, NAMES, sr=SR)
    m = {r.video_id: r for r in out.manifests.collect()}
    assert [e.name for e in m["a"].extractors] == sorted(NAMES) and all(e.success for e in m["a"].extractors)
    shaped = {r.rec_id: r for r in out.tensors.collect()}
    assert len(shaped["a"].features) == 5 and len(shaped["a"].features[0]) == 19 and list(shaped["a"].mask) == [1] * 5
    assert list(shaped["b"].mask) == [1, 0, 0, 0, 0] and shaped["b"].num_segments == 1
    assert shaped["a"].features[0][0] == pytest.approx(0.5 / np.sqrt(2), abs=0.05)
    assert pipeline.process(recordings, "aggregates_only", CONFIG, NAMES).segments is None
    assert pipeline.process(recordings, "segments_only", CONFIG, NAMES).manifests is None
    with pytest.raises(ValueError, match="mode"):
        pipeline.process(recordings, "none")


def test_manifest_round_trip(spark, recordings, tmp_path):
    out = pipeline.process(recordings, "aggregates_only", CONFIG, [*NAMES, "no_such"], dataset="d1", sr=SR)
    manifests.write(out.manifests, str(tmp_path / "m"))
    manifests.write(out.manifests, str(tmp_path / "m"))  # again: replaced, not doubled
    back = manifests.read(spark, str(tmp_path / "m"))
    assert back.count() == 2 and {r.dataset for r in back.collect()} == {"d1"}
    total = pipeline.totals(spark, str(tmp_path / "m")).where("name IS NULL").first()
    assert (total.total, total.failed) == (8, 0)


def test_tensor_store(spark, recordings, tmp_path):
    out = pipeline.process(recordings, "segments_only", CONFIG, NAMES[:1], sr=SR)
    tensors.write(out.tensors, str(tmp_path / "t"), "d1")
    assert tensors.read(spark, str(tmp_path / "t"), ids=["b"]).count() == 1
    listing = tensors.catalogue(spark, str(tmp_path / "t")).first()
    assert listing.recordings == 2 and listing.bytes > 0
    import io

    row = tensors.to_npy(tensors.read(spark, str(tmp_path / "t"))).first()
    assert np.load(io.BytesIO(row.features_npy)).shape == (5, 19) and np.load(io.BytesIO(row.mask_npy)).dtype == np.uint8


def test_wav_source(spark, tmp_path):
    x = (np.sin(np.arange(60_000) / 10) * 20000).astype("<i2")
    with wave.open(str(tmp_path / "s.wav"), "wb") as f:
        f.setnchannels(2)
        f.setsampwidth(2)
        f.setframerate(SR)
        f.writeframes(np.stack([x, x // 2], 1).tobytes())
    (tmp_path / "bad.wav").write_bytes(b"junk")
    waves = signals.read_wav(spark, str(tmp_path))
    got = {r.path.rsplit("/", 1)[1]: r for r in waves.collect()}
    assert got["bad.wav"].error and len(got["s.wav"].channels) == 2
    assert signals.samples(waves).count() == 60_000 * 22050 // SR  # converted to the usual rate
    rows = signals.samples(signals.read_wav(spark, str(tmp_path), None))  # at the file's own
    assert rows.count() == 60_000 and rows.agg(F.max(F.abs("x")).alias("m")).first().m == pytest.approx(1.0)
    files = spark.createDataFrame([("a.WAV", 3), ("a.txt", 3), ("b.mp3", 0)], "path string, length long")
    assert [r.ok for r in files.select(signals.valid_media(F.col("path"), F.col("length")).alias("ok")).collect()] == [True, False, False]


@pytest.mark.parametrize("kind", ["sine", "chirp", "silence", "clipped", "noise"])
def test_synthetic(spark, kind):
    one = signals.synthetic(spark, kind, seconds=0.1).agg(F.count("*").alias("n"), F.max(F.abs("x")).alias("m")).first()
    assert one.n == 2205 and one.m <= (1.5 if kind == "noise" else 1.0)


def test_embedding_models_and_components(spark, sf_dir, tmp_path):
    rows = spark.createDataFrame([("a", [1.0, 2.0]), ("b", None)], "rec_id string, x array<double>")
    got = {r.rec_id: r for r in embedding.embed(rows, embedding.stub(16)).collect()}
    assert len(got["a"].embedding) == 16
    bad = {r.rec_id: r for r in embedding.embed(rows, lambda: lambda x: x / 0 if x.ndim == 0 else x).collect()}
    assert bad["a"].embedding == [1.0, 2.0]
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").withColumn("kind", F.lit("clap"))
    model = embedding.Compressor({"clap": 4, "none": 3}).fit(vectors)
    var = model.explained()["clap"]
    assert len(var) == 4 and var == sorted(var, reverse=True)
    out = model.transform(vectors.unionByName(vectors.limit(1).withColumn("kind", F.lit("other"))))
    assert out.where("pca IS NULL").count() == 1 and len(out.where("kind = 'clap'").first().pca) == 4
    x = np.array([r.embedding for r in vectors.collect()])
    z = (x - x.mean(0)) / x.std(0)
    values = np.linalg.eigvalsh(np.cov(z.T))[::-1][:4]
    got = np.array([r.pca for r in out.where("kind = 'clap'").collect()])
    assert np.allclose(got.var(0, ddof=1), values, rtol=1e-6)
    model.save(str(tmp_path / "models"))
    assert embedding.Compressor.load_pca(str(tmp_path / "models"), "clap").getK() == 4


def test_the_full_row(spark):
    sr, t = 8000, np.arange(8 * SR) / SR
    waves = spark.createDataFrame([(1, (0.5 * np.sin(2 * np.pi * 220 * t)).tolist()), (2, (0.3 * np.sin(2 * np.pi * 440 * t)).tolist())], "rec_id long, x array<double>")
    config = SegmentConfig(segment_len=2.0, hop=1.0, max_seq_len=5, k_start=2, k_end=2)
    r = np.random.default_rng(0)
    rows = [(rec, k, kind, r.normal(size=dim).tolist()) for rec in (1, 2) for k in range(8) for kind, dim in (("clap", 160), ("wav2vec", 80), ("yamnet", 130))]
    vectors = spark.createDataFrame(rows, "rec_id long, segment_index long, kind string, embedding array<double>")
    out = pipeline.process(waves, "segments_only", config, ["tempo"], sr=sr, vectors=vectors)
    got = {x.rec_id: x for x in out.tensors.collect()}
    assert set(got) == {"1", "2"} and all(len(x.features) == 5 and {len(f) for f in x.features} == {416} for x in got.values())
    segments = {(x.rec_id, x.segment_index): x for x in out.segments.collect()}
    made = {(str(x.rec_id), x.segment_index): x.pca for x in out.compressor.transform(vectors).where("kind = 'wav2vec'").collect()}
    first = got["1"].features[0]
    assert np.allclose(first[19 + 128 : 19 + 192], made["1", 0], atol=1e-4)
    assert np.allclose(first[-77:], [*segments["1", 0].mel, *segments["1", 0].mfcc], atol=1e-3)
    assert len({tuple(segments["1", k].mel) for k in range(3)}) > 1


def test_timelines(spark):
    from ripplework.plans import extractors

    t = np.arange(SR) / SR
    x = np.concatenate([np.zeros(SR), 0.5 * np.sin(2 * np.pi * 300 * t), np.zeros(SR)])
    rows = spark.createDataFrame([("a", x.tolist()), ("b", []), ("c", None)], "rec_id string, x array<double>")
    got = extractors.timelines(rows, sr=SR).collect()
    assert {r.name for r in got if r.video_id == "a"} == set(extractors.TIMELINES) - {"sound_event_detection"} and not any(r.error for r in got if r.video_id == "a")
    burst = np.concatenate([0.01 * x, np.sin(2 * np.pi * 300 * t[:2000]), np.zeros(SR)])
    starts, _, _, labels = extractors.TIMELINES["sound_event_detection"](extractors.Clip(burst, SR))["events"]
    assert len(starts) and abs(starts[0] - 3) < 0.3 and len(labels) == len(starts)
    assert all(r.error and r.series is None for r in got if r.video_id != "a") and len([r for r in got if r.video_id == "b"]) == len(extractors.TIMELINES)
    one = lambda series: sorted((r for r in got if r.series == series), key=lambda r: r.i)
    speech = one("speech")
    assert len(speech) == 1 and abs(speech[0].start - 1) < 0.05 and abs(speech[0].end - 2) < 0.05 and speech[0].label == "speech"
    assert [r.label for r in one("sounds")][0] == "silence" and {"vowel"} <= {r.label for r in one("sounds")}
    sounds = one("sounds")
    assert all(a.end == b.start for a, b in zip(sounds, sounds[1:], strict=False))
    assert all(abs(r.value - 300) < 5 for r in one("f0_pyin")[5:-5]) and len(one("turns")) == 1
    assert abs(one("onset_energy")[0].start - 1) < 0.15 and one("rms")[0].value == 0
    assert all(r.label and r.value > 0 for r in one("chords"))
