import numpy as np
import pytest

from ripplework.operators import dsp
from ripplework.plans import extractors

SR = 22050


def tone(freq=440.0, seconds=1.0, sr=SR):
    return 0.8 * np.sin(2 * np.pi * freq * np.arange(int(seconds * sr)) / sr)


def test_centroid_and_pitch_of_a_sine():
    clip = dsp.Clip(tone())
    inner = slice(4, -4)
    assert abs(np.median(clip.centroid[inner]) - 440) < 15
    f0 = clip.f0()[inner] if np.isfinite(clip.f0()[inner]).any() else dsp.yin(tone(), SR, 50, 2000)[inner]
    assert abs(np.nanmedian(dsp.yin(tone(), SR, 50, 2000)[inner]) - 440) < 3 and len(f0)
    assert abs(np.median(clip.rms[inner]) - 0.8 / np.sqrt(2)) < 0.01


def test_loudness_of_the_standards_sine():
    # a full-scale 997 Hz sine is at -3.01 LUFS
    x = np.sin(2 * np.pi * 997 * np.arange(48000 * 2) / 48000)
    assert abs(dsp.integrated_loudness(x, 48000) + 3.01) < 0.1
    assert dsp.integrated_loudness(np.zeros(48000), 48000) == -70.0


def test_levinson_recovers_a_predictor():
    r = np.random.default_rng(0)
    x = np.zeros(20000)
    for i in range(2, len(x)):
        x[i] = 1.2 * x[i - 1] - 0.6 * x[i - 2] + r.standard_normal()
    auto = np.correlate(x, x, "full")[len(x) - 1 : len(x) + 2]
    assert np.allclose(dsp.levinson(auto, 2), [1, -1.2, 0.6], atol=0.03)


def test_separation_tells_a_tone_from_clicks():
    clicks = np.zeros(SR)
    clicks[::2205] = 1
    assert dsp.Clip(tone()).parts[0] > 0.9 and dsp.Clip(clicks).parts[1] > 0.8


def test_tempo_of_a_metronome():
    x = np.zeros(8 * SR)
    for k in range(16):
        at = k * SR // 2
        x[at : at + 400] = np.random.default_rng(1).standard_normal(400) * np.exp(-np.arange(400) / 80)
    clip = dsp.Clip(x)
    assert abs(clip.bpm - 120) < 4
    assert abs(np.median(np.diff(clip.times(clip.beat_frames))) - 0.5) < 0.03


def test_mel_filters_and_transform():
    filters = dsp.mel_filters(SR, 2048, 40)
    assert filters.shape == (40, 1025) and (filters >= 0).all()
    x = np.random.default_rng(2).standard_normal((16, 3))
    basis = dsp.dct2(np.eye(16), 16)
    assert np.allclose(basis @ basis.T, np.eye(16)) and dsp.dct2(x, 4).shape == (4, 3)


def test_true_peak_between_samples():
    x = np.sin(2 * np.pi * np.arange(1000) / 4 + np.pi / 4)
    assert abs(np.abs(x).max() - np.sqrt(0.5)) < 1e-9 and dsp.true_peak(x) > 0.99


@pytest.mark.parametrize("x", [tone(), tone(880, 0.5), np.zeros(SR), np.clip(1.5 * np.sin(np.arange(SR) / 20), -0.8, 0.8), np.random.default_rng(3).standard_normal(2 * SR) * 0.2, np.ones(100), np.array([0.5])])
def test_every_extractor_gives_numbers(x):
    clip = dsp.Clip(x)
    for name in extractors.REGISTRY:
        ok, payload, error, _ = extractors.run_one(name, clip)
        assert ok, (name, error)
        assert all(isinstance(v, float) and not np.isnan(v) for v in payload.values()), (name, [k for k, v in payload.items() if np.isnan(v)])


def test_shares_sum_to_one():
    clip = dsp.Clip(tone())
    for name, prefix in (("emotion_recognition", ("emotion_happy", "emotion_sad", "emotion_angry", "emotion_fearful", "emotion_surprised", "emotion_disgusted", "emotion_neutral")), ("source_separation", tuple(f"instrument_{i}" for i in ("vocal", "drums", "bass", "guitar", "piano", "brass", "strings")))):
        payload = extractors.run_one(name, clip)[1]
        assert abs(sum(payload[p] for p in prefix) - 1) < 1e-6


def test_an_error_stays_with_its_extractor(spark, monkeypatch):
    rows = spark.createDataFrame([("a", [0.1] * 5000), ("b", []), ("c", None)], "rec_id string, x array<double>")
    got = extractors.extract(rows, ["quality", "no_such", "tempo"]).collect()
    assert {(r.video_id, r.name, r.success) for r in got} == {("a", "quality", True), ("a", "tempo", True), ("b", "quality", False), ("b", "tempo", False), ("c", "quality", False), ("c", "tempo", False)}
    assert all(r.error for r in got if not r.success)
    assert len(extractors.REGISTRY) == 22


@pytest.mark.parametrize("rate", [8000, 16000, 44100, 48000, 11025])
def test_resampling_keeps_tones_and_lengths(rate):
    at = lambda sr: np.sin(2 * np.pi * 440 * np.arange(sr) / sr)
    got = dsp.resampled(at(rate), rate, 22050)
    assert len(got) == 22050 and np.abs(got - at(22050))[200:-200].max() < 0.01
    assert len(dsp.resampled(np.ones(1), rate, 22050)) >= 1 and not len(dsp.resampled(np.zeros(0), rate, 22050))


def test_wav_at_any_rate(spark, tmp_path):
    from ripplework.plans import extractors, pipeline, q_runs
    from ripplework.sources import signals

    for path, content in q_runs.tones(str(tmp_path), seconds=2.0):
        open(path, "wb").write(content)
    for own in (22050, None):
        waves = signals.windows_of_samples(signals.samples(signals.read_wav(spark, str(tmp_path), own)), 0)
        found = extractors.extract(waves, ["asr_extractor", "pitch"]).collect()
        assert all(abs(r.payload["audio_duration"] - 2) < 0.001 for r in found if r.name == "asr_extractor") and len(found) == 10
        assert all(abs(r.payload["pitch_median"] - 330) < 3 for r in found if r.name == "pitch")
        ends = pipeline.frames(waves).groupBy("rec_id").agg({"t": "max"}).collect()
        assert len(ends) == 5 and all(1.9 < r[1] < 2 for r in ends)
    x = signals.pcm(b"\x00\x00\x40\x00\x00\xc0", 3)
    assert x.tolist() == [0.5, -0.5]


def test_formants_read_the_whole_signal():
    r = np.random.default_rng(0)
    x = r.normal(size=6000)
    y = np.append(x[0], x[1:] - 0.97 * x[:-1]) * np.hamming(len(x))
    direct = np.correlate(y, y, "full")[len(y) - 1 : len(y) + 24]
    roots = np.roots(dsp.levinson(direct, 24))
    want = sorted(f for f in np.angle(roots[np.imag(roots) > 0.01]) * 22050 / (2 * np.pi) if f > 90)[:4]
    assert np.allclose(dsp.formants(x, 22050), want, rtol=1e-6)


def test_probabilistic_pitch_tells_tone_from_noise():
    silence, noise = np.zeros(SR), np.random.default_rng(5).standard_normal(SR) * 0.1
    for freq in (110.0, 440.0, 1500.0):
        f0, voiced = dsp.pyin(np.concatenate([silence, tone(freq)]), SR, 50, 2000)
        inner = slice(SR // 512 + 4, -4)
        assert np.isnan(f0[: SR // 512 - 3]).all() and np.abs(f0[inner] / freq - 1).max() < 0.01 and voiced[inner].min() > 0.9
    f0, voiced = dsp.pyin(noise, SR, 50, 2000)
    assert np.isnan(f0).mean() > 0.5 and voiced.mean() < 0.2  # by chance, troughs of some frames in a row are near each other
    assert np.isnan(dsp.pyin(silence, SR, 50, 2000)[0]).all()


def test_the_first_estimator_that_finds_a_pitch_counts():
    got = extractors.run_one("pitch", dsp.Clip(tone(330.0)))[1]
    assert got["f0_method"] == 0 and all(abs(got[k] - 330) < 2 for k in ("f0_median", "f0_median_pyin", "f0_median_yin", "pitch_median"))
    assert got["f0_count_crepe"] == 0 and got["voiced_fraction_pyin"] > 0.9
    got = extractors.run_one("pitch", dsp.Clip(np.zeros(SR)))[1]
    assert got["f0_method"] == -1 and got["f0_mean"] == got["pitch_stability"] == 0


def test_onsets_by_each_method():
    # a tone that jumps an octave up each half second; a rise from silence would be 80 dB, beside which a jump's 3 count as none
    t = np.arange(SR // 2) / SR
    x = np.concatenate([0.5 * np.sin(2 * np.pi * 300 * 2**k * t) for k in range(4)])
    clip = dsp.Clip(x)
    at = clip.times(clip.onsets_by("spectral_rolloff"))
    assert all(np.abs(at - s).min() < 0.08 for s in (0.5, 1.0, 1.5)), at
    assert len(dsp.Clip(np.concatenate([np.zeros(SR // 2), x])).onsets_by("spectral_rolloff")) == 1
    got = extractors.run_one("onset", clip)[1]
    assert {f"onset_count_{m}" for m in dsp.ONSET_METHODS} <= got.keys() and got["onset_count_spectral_rolloff"] == len(at)
    silent = extractors.run_one("onset", dsp.Clip(np.zeros(SR)))[1]
    assert all(silent[f"onset_count_{m}"] == 0 for m in dsp.ONSET_METHODS)
