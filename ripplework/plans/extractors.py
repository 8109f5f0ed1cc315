"""The extractors: named bundles of features of a recording, run by name with errors kept apart.

An extractor is a function of a Clip that returns numbers by name. Recordings are rows, so Spark spreads them;
within a row, what several extractors need is computed once. A failing extractor gives a row with success false
and its error, and the others go on.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from ripplework.functions import scoring
from ripplework.operators import dsp, joins
from ripplework.operators.dsp import EPS, Clip
from ripplework.operators.segments import SegmentConfig
from ripplework.session import bound_batches

Payload = dict[str, float]
RESULTS = "video_id string, name string, version string, success boolean, payload map<string,double>, error string, processing_time double"
VERSION = "1.0.0"
REGISTRY: dict[str, tuple[str, Callable[[Clip], Payload]]] = {}


def extractor(name: str, description: str) -> Callable:
    def add(f: Callable[[Clip], Payload]) -> Callable[[Clip], Payload]:
        REGISTRY[name] = (description, f)
        return f

    return add


def stats(x: np.ndarray, prefix: str, names: str = "mean std min max") -> Payload:
    x = np.asarray(x, np.float64)
    x = x[np.isfinite(x)]
    if not len(x):
        return {f"{prefix}_{n}": 0.0 for n in names.split()}
    made = {
        "mean": x.mean, "std": x.std, "min": x.min, "max": x.max, "median": lambda: np.median(x), "p25": lambda: np.percentile(x, 25), "p75": lambda: np.percentile(x, 75), "p90": lambda: np.percentile(x, 90),
        "range": lambda: np.ptp(x), "cv": lambda: x.std() / x.mean() if x.mean() > 0 else 0.0, "count": lambda: len(x),
        "skewness": lambda: ((x - x.mean()) ** 3).mean() / x.std() ** 3 if len(x) >= 3 and x.std() > 0 else 0.0, "kurtosis": lambda: ((x - x.mean()) ** 4).mean() / x.std() ** 4 - 3 if len(x) >= 4 and x.std() > 0 else 0.0,
    }
    return {f"{prefix}_{n}": float(made[n]()) for n in names.split()}


def bands(x: np.ndarray, prefix: str) -> Payload:
    """Statistics of each row, and of all."""
    out = stats(x, prefix)
    for i, row in enumerate(x):
        out |= stats(row, f"{prefix}_{i}")
    return out


@extractor("mfcc_extractor", "Mel-frequency cepstral coefficients and their deltas")
def mfcc(c: Clip) -> Payload:
    return bands(c.mfcc, "mfcc") | bands(dsp.savgol_delta(c.mfcc), "mfcc_delta") | bands(dsp.savgol_delta(c.mfcc, order=2), "mfcc_delta2")


@extractor("mel_extractor", "Log-mel spectrogram")
def mel(c: Clip) -> Payload:
    m = dsp.to_db(c.mel(64))
    return bands(m, "mel64") | {"mel64_range": float(np.ptp(m))}


@extractor("chroma_extractor", "Pitch classes and descriptors of their shape")
def chroma(c: Clip) -> Payload:
    x = c.chroma
    p = x / np.maximum(x.sum(0), EPS)
    shape = {
        "energy": x.sum(0), "centroid": np.arange(12) @ p, "spread": x.std(0), "flux": (np.diff(x, axis=1) ** 2).sum(0), "entropy": -(p * np.log2(p + EPS)).sum(0),
        "irregularity": np.abs(np.diff(x, axis=0)).mean(0), "variation": x.std(0) / (x.mean(0) + EPS), "tonality": x.max(0) / (x.sum(0) + EPS),
    }
    out = bands(x, "chroma")
    for name, values in shape.items():
        out |= stats(values, f"chroma_{name}")
    return out


@extractor("loudness_extractor", "RMS, LUFS, peaks and clipping")
def loudness(c: Clip) -> Payload:
    a, peak = np.abs(c.x), float(np.abs(c.x).max())
    rms = float(np.sqrt((c.x**2).mean()))
    clipped = a[a >= 0.99]
    return stats(c.rms, "rms", "mean std min max median p25 p75 range cv") | {
        "loudness_lufs": dsp.integrated_loudness(c.x, c.sr), "peak": peak, "peak_db": 20 * np.log10(peak) if peak > 0 else float("-inf"), "peak_to_peak": float(np.ptp(c.x)), "crest_factor": peak / rms if rms > 0 else 0.0,
        "peak_count": float((a >= 0.95 * peak).sum()), "clip_fraction": float((a >= 0.99).mean()), "hard_clip_fraction": float((a >= 1).mean()), "clip_severity": float((clipped - 0.99).mean()) if len(clipped) else 0.0,
        "true_peak": dsp.true_peak(c.x),
    }


def _voiced(c: Clip, size_s: float = 0.03) -> np.ndarray:
    n = max(1, int(size_s * c.sr))
    rows = dsp.framed(c.x, n, n, centred=False)
    level = np.sqrt((rows**2).mean(1))
    return level > 0.1 * max(level.max(), EPS)


def _runs(flags: np.ndarray) -> np.ndarray:
    """Starts and ends (exclusive) of runs of true."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return edges.reshape(-1, 2)


@extractor("vad_extractor", "Voice activity by level, and the pitch of voiced frames")
def vad(c: Clip) -> Payload:
    v = _voiced(c)
    lengths = np.diff(_runs(v), axis=1).ravel() * 0.03
    f0 = stats(c.f0(), "f0", "mean std min max median p25 p75 range cv count")
    return {"voiced_fraction": float(v.mean()), "speech_segments": float(len(lengths)), **stats(lengths, "speech_seconds"), **f0, "f0_stability": 1 / (1 + f0["f0_cv"])}


def _vector(x: np.ndarray, prefix: str) -> Payload:
    p = np.abs(x) / (np.abs(x).sum() + EPS)
    return stats(x, prefix) | {f"{prefix}_dim": float(len(x)), f"{prefix}_norm": float(np.linalg.norm(x)), f"{prefix}_energy": float((x**2).sum()), f"{prefix}_sparsity": float((np.abs(x) < 1e-6).mean()), f"{prefix}_entropy": float(-(p * np.log(p + EPS)).sum())}


@extractor("clap_extractor", "No trained model is part of this engine: a mark alone; see operators.embedding.embed")
def clap(c: Clip) -> Payload:
    return {"clap_stub": 1.0}


@extractor("asr_extractor", "Timing that a transcript would be aligned with: no trained recogniser is part of this engine")
def asr(c: Clip) -> Payload:
    v = _voiced(c)
    return {"asr_stub": 1.0, "audio_duration": c.duration, "speech_seconds": float(v.sum() * 0.03), "words_count": 0.0, "words_per_sec": 0.0}


#: Estimators of pitch, the best one first: a recording's own pitch is that of the first one that finds any.
PITCH_METHODS = ("pyin", "yin", "crepe")


@extractor("pitch", "Pitch by three estimators (crepe, a trained one, finds none here), and that of the best that finds any")
def pitch(c: Clip) -> Payload:
    found = {m: f0[np.isfinite(f0)] for m, f0 in c.pitches.items()} | {"crepe": np.zeros(0)}
    out: Payload = {}
    for method in PITCH_METHODS:
        made = stats(found[method], "f0", "mean std min max median p25 p75 p90 count")
        out |= {f"{name}_{method}": v for name, v in made.items()}
    f0, voiced = c.pyin
    out |= {"voiced_fraction_pyin": float(np.isfinite(f0).mean()) if len(f0) else 0.0, "voiced_probability_mean_pyin": float(voiced.mean()) if len(voiced) else 0.0}
    used = next((i for i, m in enumerate(PITCH_METHODS) if len(found[m])), -1)
    best = found[PITCH_METHODS[used]] if used >= 0 else np.zeros(0)
    steps = np.diff(best)
    variation = float(steps.std()) if len(steps) else 0.0
    out |= stats(best, "f0", "mean std min max median") | stats(best, "pitch", "mean std min max median skewness kurtosis count range")
    return out | {"f0_method": float(used), "pitch_variation": variation, "pitch_stability": 1 / (1 + variation) if len(steps) else 0.0}


@extractor("spectral_extractor", "Descriptors of the spectrum")
def spectral(c: Clip) -> Payload:
    s, p = c.s, c.s / np.maximum(c.s.sum(0), EPS)
    steps = np.diff(s, axis=0)
    edges = np.linspace(0, len(s), 7).astype(int)
    log = np.log(np.maximum(s, EPS))
    centred = c.freqs - c.freqs.mean()
    each = {
        "zcr": c.zcr, "spectral_centroid": c.centroid, "spectral_bandwidth": c.bandwidth, "spectral_rolloff": c.rolloff, "spectral_flatness": c.flatness,
        "spectral_contrast": np.array([np.ptp(s[a:b], axis=0) for a, b in zip(edges, edges[1:], strict=False)]).mean(0), "spectral_flux": (np.diff(s, axis=1) ** 2).sum(0), "spectral_entropy": -(p * np.log2(p + EPS)).sum(0),
        "spectral_irregularity": np.abs(steps).mean(0), "spectral_decrease": steps.mean(0), "spectral_slope": centred @ log / (centred @ centred),
    }
    out: Payload = {}
    for name, values in each.items():
        out |= stats(values, name, "mean std min max median p25 p75 p90 cv skewness kurtosis")
    m = out["spectral_centroid_mean"]
    return out | {"bandwidth_ratio": out["spectral_bandwidth_mean"] / m if m > 0 else 0.0, "rolloff_ratio": out["spectral_rolloff_mean"] / m if m > 0 else 0.0, "centroid_normalised": m / (c.sr / 2)}


def _gaps(t: np.ndarray, prefix: str) -> Payload:
    g = np.diff(t)
    out = stats(g, prefix, "mean std min max median")
    var = out[f"{prefix}_std"] / out[f"{prefix}_mean"] if out[f"{prefix}_mean"] > 0 else 0.0
    return out | {f"{prefix}_variability": var, f"{prefix}_regularity": 1 / (1 + var)}


def _tempo_class(bpm: float) -> int:
    return next((i for i, (bound, _) in enumerate(scoring.TEMPO_CLASSES) if bpm < bound), len(scoring.TEMPO_CLASSES))


def _syncopation(c: Clip) -> float:
    b, o = c.times(c.beat_frames), c.times(c.onsets)
    if len(b) < 2 or not len(o):
        return 0.0
    return float((np.abs(o[:, None] - b).min(1) > 0.1 * np.diff(b).mean()).mean()) if len(b) * len(o) < 1e7 else float(np.mean([np.abs(b - t).min() > 0.1 * np.diff(b).mean() for t in o]))


@extractor("tempo", "Tempo, beats, onsets and their regularity")
def tempo(c: Clip) -> Payload:
    s = c.strength
    cv = s.std() / s.mean() if s.mean() > 0 else 0.0
    ratio = len(c.onsets) / len(c.beat_frames) if len(c.beat_frames) else 0.0
    return {
        "tempo_bpm": c.bpm, "tempo_class": float(_tempo_class(c.bpm)), "beat_count": float(len(c.beat_frames)), "onset_count": float(len(c.onsets)), "onset_density": len(c.onsets) / c.duration,
        "rhythm_complexity": float(min((cv + ratio) / 2, 1.0)), "syncopation": _syncopation(c), "beats_per_bar": 4.0, "accent_strength": float(s.mean()), **_gaps(c.times(c.beat_frames), "beat_interval"), **_gaps(c.times(c.onsets), "onset_interval"),
    }


def _noise_levels(c: Clip) -> tuple[float, float]:
    """SNR in dB over time and over the spectrum."""
    n = max(1, int(0.1 * c.sr))
    energy = np.array([(c.x[a : a + n] ** 2).mean() for a in range(0, len(c.x) - n, n)])
    floor = np.percentile(energy, 20) if len(energy) else 0.0
    over_time = 0.0 if not len(energy) else 100.0 if floor <= 0 else float(10 * np.log10(energy.mean() / floor))
    power = (c.s**2).sum(0)
    quiet = power <= np.percentile(power, 10)
    tone = (c.s[:, ~quiet].mean(1) ** 2).sum() if (~quiet).any() else 0.0
    noise = (c.s[:, quiet].mean(1) ** 2).sum()
    return over_time, 0.0 if tone <= 0 else 100.0 if noise <= 0 else float(10 * np.log10(tone / noise))


@extractor("quality", "Noise, clipping, hum and distortion, and a score of them")
def quality(c: Clip) -> Payload:
    over_time, over_spectrum = _noise_levels(c)
    a = np.abs(c.x)
    runs = np.diff(_runs(a >= 0.99), axis=1).ravel()
    whole, freqs = np.abs(np.fft.rfft(c.x)), np.fft.rfftfreq(len(c.x), 1 / c.sr)

    def stands_out(f: float) -> bool:
        i = int(round(f * len(c.x) / c.sr))
        near = np.concatenate([whole[max(0, i - 5) : i], whole[i + 1 : i + 6]])
        return 0 < i < len(whole) and len(near) > 0 and whole[i] > 2 * near.mean() + EPS

    from ripplework.operators.spectral import HUM

    hum = any(stands_out(f) for f in HUM)
    at = lambda f: float(whole[np.argmin(np.abs(freqs - f))])
    thd = float(np.sqrt(sum(at(440 * k) ** 2 for k in (2, 3, 4, 5))) / (at(440) + EPS))
    distorted = thd > 0.1 and float(c.flatness.mean()) > 0.5
    nyquist, snr, clip = c.sr / 2, min(over_time, over_spectrum), float((a >= 0.99).mean())
    tone = float(np.clip((c.centroid.mean() / nyquist + c.rolloff.mean() / nyquist + c.bandwidth.mean() / nyquist + 1 - c.zcr.mean()) / 4, 0, 1))
    score = 0.3 * min(snr / 40, 1) + 0.25 * max(0.0, 1 - 100 * clip) + 0.2 * (not hum) + 0.15 * (not distorted) + 0.1 * tone
    rms = float(np.sqrt((c.x**2).mean()))
    return {
        "snr_db": snr, "snr_temporal_db": over_time, "snr_spectral_db": over_spectrum, "clip_fraction": clip, "clip_events": float(len(runs)), "clip_max_seconds": float(runs.max(initial=0) / c.sr), "hum_detected": float(hum), "thd": thd,
        "distortion_detected": float(distorted), "dynamic_range": float(a.max()) / (rms + EPS), "spectral_quality": tone, "overall_quality": float(np.clip(score, 0, 1)), "duration_seconds": c.duration,
    }


@extractor("onset", "Onsets by four methods; intervals, clusters and places of those by energy; strength")
def onset(c: Clip) -> Payload:
    out = stats(c.strength, "onset_strength", "mean std min max median")
    for method in dsp.ONSET_METHODS:
        n = len(c.onsets_by(method))
        out |= {f"onset_count_{method}": float(n), f"onset_density_{method}": n / c.duration}
    t = c.times(c.onsets_by("energy"))
    clusters = np.split(t, np.flatnonzero(np.diff(t) > 0.5) + 1) if len(t) else []
    sizes = np.array([len(x) for x in clusters])
    thirds = np.histogram(t, 3, (0, c.duration))[0] / (c.duration / 3)
    last = c.onset_curve(dsp.ONSET_METHODS[-1])  # the strength's distribution is that of the last method
    strong = float((last > np.percentile(last, 75)).mean()) if len(last) else 0.0
    return out | {
        "onset_density": len(t) / c.duration, "onset_clusters": float((sizes > 1).sum()), "onset_cluster_score": float((sizes > 2).sum() / max(1, len(t))), "strong_onsets_ratio": strong,
        "onset_first_third": float(thirds[0]), "onset_second_third": float(thirds[1]), "onset_last_third": float(thirds[2]), "onset_densest_third": float(thirds.argmax()),
        **stats(last, "onset_strength", "skewness kurtosis p25 p75 p90"), **_gaps(t, "onset_interval"),
    }


def _turns(c: Clip) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends, in voice frames, of stretches between pauses, and the side of each by timbre."""
    runs = _runs(_voiced(c))
    if not len(runs):
        return runs, np.zeros(0, int)
    at = lambda t: min(int(t * 0.03 * c.sr / c.hop), c.mfcc.shape[1] - 1)
    timbre = np.array([c.mfcc[1:, at(a) : at(b) + 1].mean(1) for a, b in runs])
    lead = timbre - timbre.mean(0)
    axis = np.linalg.svd(lead, full_matrices=False)[2][0] if len(runs) > 1 else np.zeros(12)
    return runs, (lead @ axis > 0).astype(int)


@extractor("speaker_diarization", "Turns between pauses, grouped in two by timbre: a stand-in for a trained model")
def diarization(c: Clip) -> Payload:
    runs, side = _turns(c)
    if not len(runs):
        return {"num_speakers": 0.0, "num_turns": 0.0, "speaker_changes": 0.0, "speaker_balance": 0.0}
    seconds = np.bincount(side, np.diff(runs, axis=1).ravel() * 0.03, 2)
    p = seconds[seconds > 0] / seconds.sum()
    balance = float(-(p * np.log2(p)).sum() / np.log2(len(p))) if len(p) > 1 else 1.0
    return {"num_speakers": float(len(p)), "num_turns": float(len(runs)), "speaker_changes": float((np.diff(side) != 0).sum()), "speaker_balance": balance, "dominant_share": float(p.max()), "speaker_stub": 1.0}


@extractor("voice_quality", "Jitter, shimmer, harmonics to noise, formants")
def voice_quality(c: Clip) -> Payload:
    f0 = c.f0()
    voiced = np.isfinite(f0)
    n = min(len(f0), len(c.rms))
    period, level = 1 / f0[voiced], c.rms[:n][voiced[:n]]

    def near(x: np.ndarray, width: int, own: bool) -> float:
        if len(x) < width or x.mean() <= 0:
            return 0.0
        rows = np.lib.stride_tricks.sliding_window_view(x, width)
        mid = rows[:, width // 2]
        mean = rows.mean(1) if own else (rows.sum(1) - mid) / (width - 1)
        return float(np.abs(mid - mean).mean() / x.mean())

    def local(x: np.ndarray) -> float:
        return float(np.abs(np.diff(x)).mean() / x.mean()) if len(x) > 1 and x.mean() > 0 else 0.0

    mean_f0 = float(f0[voiced].mean()) if voiced.any() else 0.0
    hnr = dsp.harmonics_to_noise(c.x, c.sr, mean_f0)
    found = dsp.formants(c.x, c.sr) if len(c.x) > 64 else [0.0] * 4
    jitter, shimmer = local(period), local(level)
    index = (1 - min(100 * jitter, 1) + 1 - min(100 * shimmer, 1) + min(hnr / 20, 1)) / 3
    return {
        "jitter_local": jitter, "jitter_rap": near(period, 3, True), "jitter_ppq5": near(period, 5, False), "jitter_ddp": 3 * near(period, 3, True), "shimmer_local": shimmer, "shimmer_apq3": near(level, 3, True), "shimmer_apq5": near(level, 5, False),
        "shimmer_apq11": near(level, 11, True), "shimmer_dda": 3 * near(level, 3, True), "hnr_db": hnr, "voice_quality_index": float(index), "voiced_frames": float(voiced.sum()), **{f"formant_{i + 1}": f for i, f in enumerate(found)},
    }


def _acoustics(c: Clip) -> Payload:
    f0 = stats(c.f0(), "pitch")
    return {"pitch_mean": f0["pitch_mean"], "pitch_std": f0["pitch_std"], "energy_mean": float(c.rms.mean()), "energy_std": float(c.rms.std()), "tempo": c.bpm, "zcr_mean": float(c.zcr.mean()), "centroid": float(c.centroid.mean()), "centroid_std": float(c.centroid.std()), "pitch_present": float(np.isfinite(c.f0()).mean())}


def _holds(condition: str, values: Payload) -> bool:
    """A rule's condition on numbers: comparisons and BETWEEN, joined by AND."""
    import re

    text = re.sub(r"(\w+) BETWEEN ([\d.]+) AND ([\d.]+)", r"\2 <= \1 <= \3", condition)
    for part in text.split(" AND "):
        terms = part.split()
        numbers = [values[t] if t in values else float(t) for t in terms[::2]]
        if not all((a < b) if op == "<" else (a > b) if op == ">" else (a <= b) for a, op, b in zip(numbers, terms[1::2], numbers[1:], strict=False)):
            return False
    return True


def _points(rules: tuple, values: Payload) -> float:
    return min(sum(p for condition, p in rules if _holds(condition, values)), 1.0)


@extractor("emotion_recognition", "Rule-based emotion shares, valence and arousal")
def emotion(c: Clip) -> Payload:
    v = _acoustics(c)
    score = {e: 0.4 if _holds(strong, v) else 0.2 if _holds(weak, v) else 0.0 for e, (strong, weak) in scoring.EMOTIONS.items()}
    score["neutral"] = 0.4 if _holds(scoring.NEUTRAL, v) else 0.1
    total = sum(score.values())
    share = {f"emotion_{e}": s / total for e, s in score.items()}
    valence = (min(v["pitch_mean"] / 300, 1) + min(v["centroid"] / 4000, 1)) / 2
    arousal = (min(v["energy_mean"] / 0.2, 1) + min(v["tempo"] / 200, 1)) / 2
    return share | {"emotion_dominant": float(np.argmax(list(score.values()))), "emotion_dom_conf": max(share.values()), "emotion_valence": valence, "emotion_arousal": arousal}


SOUNDS = ("silence", "fricative", "vowel", "consonant")


def _sounds(c: Clip) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Level, zero crossings and kind (of SOUNDS) of each frame, and where the kind changes, both ends included."""
    n = min(len(c.rms), len(c.zcr))
    rms, zcr = c.rms[:n], c.zcr[:n]
    label = np.where(rms < 0.1 * max(rms.max(), EPS), 0, np.where(zcr > 0.3, 1, np.where(zcr < 0.1, 2, 3)))
    return rms, zcr, label, np.concatenate([[0], np.flatnonzero(np.diff(label)) + 1, [n]]).astype(int)


@extractor("phoneme_analysis", "Stretches of silence, fricatives, vowels and consonants by level and zero crossings")
def phonemes(c: Clip) -> Payload:
    rms, zcr, label, cuts = _sounds(c)
    lengths = np.diff(cuts) * c.hop / c.sr
    kinds = label[cuts[:-1]]
    kept = (lengths > 0.01) & (kinds > 0)
    var = lambda x: float(x.std() / (x.mean() + EPS))
    return {"phoneme_count": float(kept.sum()), "phoneme_rate": float(kept.sum() / c.duration), **stats(lengths[kept], "phoneme_seconds"), "vowel_share": float((label == 2).mean()), "fricative_share": float((label == 1).mean()), "energy_variability": var(rms), "energy_stability": 1 / (1 + var(rms)), "zcr_variability": var(zcr), "zcr_stability": 1 / (1 + var(zcr))}


@extractor("advanced_spectral_extractor", "Spectrum, mel, cepstrum, chroma and tonal centroid together")
def advanced(c: Clip) -> Payload:
    out: Payload = {}
    angles = np.outer([7, 3, 4], np.arange(12)) * 2 * np.pi / 12 * np.array([1, 1, 1])[:, None]
    p = c.chroma / np.maximum(c.chroma.sum(0), EPS)
    tonnetz = np.concatenate([np.sin(angles) @ p, np.cos(angles) @ p])
    for name, values in (("stft", c.s), ("mel", dsp.to_db(c.mel(128))), ("mfcc", c.mfcc), ("chroma", c.chroma), ("tonnetz", tonnetz), ("zcr", c.zcr), ("rolloff", c.rolloff), ("bandwidth", c.bandwidth), ("centroid", c.centroid), ("flatness", c.flatness)):
        out |= stats(np.asarray(values).ravel(), f"advanced_{name}")
    return out


def _match(x: np.ndarray, templates: list) -> tuple[int, float]:
    """The template that correlates best, and how much."""
    t = np.array([row for _, _, row in templates])
    a, b = x - x.mean(), t - t.mean(1, keepdims=True)
    r = b @ a / (np.linalg.norm(b, axis=1) * np.linalg.norm(a) + EPS)
    return int(r.argmax()), float(r.max())


def _chords(c: Clip) -> np.ndarray:
    templates = joins.chord_templates()
    return np.array([_match(f, templates)[0] for f in c.chroma.T])


@extractor("music_analysis", "Key, chords, danceability, energy and complexity")
def music(c: Clip) -> Payload:
    key, sure = _match(c.chroma.mean(1), joins.key_templates())
    chords = _chords(c)
    gaps = np.diff(c.times(c.beat_frames))
    regular = 1 / (1 + gaps.std() / gaps.mean()) if len(gaps) and gaps.mean() > 0 else 0.0
    rhythm = 0.7 * regular + 0.3 * min(len(c.beat_frames) / c.duration / 2, 1) if len(c.beat_frames) >= 2 else 0.0
    cv = lambda x: x.std() / (x.mean() + EPS)
    return {
        "key_index": float(key // 2), "mode_minor": float(key % 2), "key_confidence": sure, "chord_diversity": len(set(chords.tolist())) / len(chords), "chord_transition_rate": float((np.diff(chords) != 0).sum() / len(chords)),
        "chord_most_common": float(np.bincount(chords).argmax()), "rhythm_score": float(rhythm), "danceability": float(0.4 * min(c.bpm / 140, 1) + 0.3 * min(c.rms.mean() / 0.2, 1) + 0.3 * rhythm), **stats(c.rms, "energy"),
        "musical_complexity": float(min((cv(c.centroid) + cv(c.bandwidth) + cv(c.zcr)) / 3, 1)), "harmonic_ratio": c.parts[0], "percussive_ratio": c.parts[1],
    }


def _vocal(c: Clip) -> float:
    f0 = c.f0(80, 400)
    f0 = f0[np.isfinite(f0)]
    tier = lambda x, inner, outer: 1.0 if inner[0] <= x <= inner[1] else 0.7 if outer[0] <= x <= outer[1] else 0.3
    one, two = c.mfcc[1].mean(), c.mfcc[2].mean()
    found = [tier(c.centroid.mean(), (1000, 3000), (800, 4000)), tier(c.zcr.mean(), (0.1, 0.3), (0.05, 0.4)), 0.8 if -20 <= one <= 0 and -10 <= two <= 10 else 0.6 if -30 <= one <= 10 and -20 <= two <= 20 else 0.5]
    return float(np.mean([*([1 / (1 + f0.std() / (f0.mean() + EPS))] if len(f0) else []), *found]))


@extractor("source_separation", "Harmonic and percussive shares, vocals and instruments")
def sources(c: Clip) -> Payload:
    power = (c.s**2).sum(1)
    total = power.sum() + EPS
    low, high = power[c.freqs <= 500].sum() / total, power[c.freqs >= 4000].sum() / total
    mid = 1 - low - high
    vocal, (harmonic, percussive) = _vocal(c), c.parts
    parts = {
        "vocal": vocal, "drums": percussive * min(c.bpm / 120, 1) * 0.8, "bass": low * 0.7, "guitar": mid * harmonic * 0.6, "piano": min(c.bandwidth.mean() / 4000, 1) * harmonic * 0.5,
        "brass": high * c.centroid.mean() / (c.sr / 2) * 0.4, "strings": mid / (1 + c.centroid.std() / (c.centroid.mean() + EPS)) * 0.5,
    }
    sum_ = sum(parts.values()) + EPS
    return {"vocal_fraction": vocal, "harmonic_ratio": harmonic, "percussive_ratio": percussive, "low_share": float(low), "mid_share": float(mid), "high_share": float(high), **{f"instrument_{k}": float(v / sum_) for k, v in parts.items()}}


def _moments(c: Clip) -> tuple[np.ndarray, list[int]]:
    """Frames of loud moments, and the kind of each (-1: unknown)."""
    rms = c.rms
    found = dsp.pick_peaks(np.where(rms > rms.mean() + 2 * rms.std(), rms, 0), above=0.0, wait=5)
    v = _acoustics(c)
    kinds = []
    for i in found.tolist():
        own = {**v, "energy_mean": float(rms[i]), "zcr_mean": float(c.zcr[min(i, len(c.zcr) - 1)])}
        score = {k: _points(r, own) for k, r in scoring.EVENTS.items()}
        best = max(score, key=score.get)
        kinds.append(list(scoring.EVENTS).index(best) if score[best] > 0.3 else -1)
    return found, kinds


@extractor("sound_event_detection", "Loud moments, their kinds, and the acoustic scene")
def events(c: Clip) -> Payload:
    found, kinds = _moments(c)
    v = _acoustics(c)
    scene = {k: _points(r, v) for k, r in scoring.SCENES.items()}
    total = sum(scene.values()) or 1.0
    counts = {f"event_{k}": float(kinds.count(i)) for i, k in enumerate(scoring.EVENTS)}
    return {"event_count": float(len(found)), "event_density": len(found) / c.duration, **counts, **{f"scene_{k}": s / total for k, s in scene.items()}, "scene_index": float(np.argmax(list(scene.values()))), "scene_confidence": max(scene.values()) / total}


@extractor("rhythmic_analysis", "Tempo over time, patterns, meter, off-beat onsets")
def rhythm(c: Clip) -> Payload:
    b = c.times(c.beat_frames)
    g = np.diff(b)
    local = 60 / g[g > 0] if len(g) else np.zeros(0)
    rel = g / g.mean() if len(g) and g.mean() > 0 else np.zeros(0)
    best, score = 4, 0.0
    for meter in (4, 3, 2, 6):
        rows = g[: len(g) // meter * meter].reshape(-1, meter)
        value = float(np.maximum(0, 1 - rows.std(1) / np.maximum(rows.mean(1), EPS)).mean()) if len(rows) else 0.0
        if value > score:
            best, score = meter, value
    pairs = sum(1 for i in range(0, len(g) - 1, 2) if g[i] > 0 and 1.5 <= g[i + 1] / g[i] <= 2.5)
    even, off = (float(((rel >= 0.8) & (rel <= 1.2)).mean()), float(((rel < 0.7) | (rel > 1.3)).mean())) if len(rel) else (0.0, 0.0)
    pattern = 0 if even > 0.7 else 1 if pairs > len(g) / 4 else 2 if off > 0.3 else 3
    return {"tempo_bpm": c.bpm, **stats(local, "local_tempo", "mean std min max cv"), "tempo_acceleration": float(np.diff(local).mean()) if len(local) > 1 else 0.0, "rhythm_pattern": float(pattern), "meter": float(best), "meter_score": score, "syncopation": _syncopation(c)}


@extractor("advanced_embeddings_extractor", "A vector of cepstrum and spectrum, where trained models aren't part of this engine")
def embeddings(c: Clip) -> Payload:
    x = np.concatenate([c.mfcc.mean(1), [c.centroid.mean(), c.rolloff.mean(), c.bandwidth.mean()]])
    return {f"fallback_{i}": float(v) for i, v in enumerate(x)} | _vector(x, "fallback")


def registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(name, VERSION, description) for name, (description, _) in REGISTRY.items()], "name string, version string, description string")


def run_one(name: str, clip: Clip) -> tuple[bool, Payload | None, str | None, float]:
    began = time.perf_counter()
    try:
        return True, {k: float(v) for k, v in REGISTRY[name][1](clip).items()}, None, time.perf_counter() - began
    except Exception as e:  # noqa: BLE001  an extractor's error is its result
        return False, None, str(e) or type(e).__name__, time.perf_counter() - began


def extract(recordings: DataFrame, names: list[str] | None = None, rec: str = "rec_id", sr: int = 22050) -> DataFrame:
    """Results (see RESULTS) of the named extractors, all by default, for recordings (rec, x: array of samples; sr where rows have their own)."""
    wanted = [n for n in (names or list(REGISTRY)) if n in REGISTRY]
    bound_batches(recordings.sparkSession)
    columns = [rec, "x", *(["sr"] if "sr" in recordings.columns else [])]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for row in frame.itertuples(index=False):
                out = []
                try:
                    clip = Clip(np.asarray(row.x, np.float64), int(getattr(row, "sr", sr)))
                except Exception as e:  # noqa: BLE001
                    out = [(str(row[0]), n, VERSION, False, None, str(e) or type(e).__name__, 0.0) for n in wanted]
                else:
                    for n in wanted:
                        ok, payload, error, seconds = run_one(n, clip)
                        out.append((str(row[0]), n, VERSION, ok, payload, error, seconds))
                yield pd.DataFrame(out, columns=[x.split()[0] for x in RESULTS.split(", ")])

    return recordings.select(*columns).mapInPandas(run, RESULTS)


#: Rows of a series: starts, ends (of a moment, its start), values, labels.
Series = tuple[np.ndarray, np.ndarray, np.ndarray, list[str | None]]
TIMES = "video_id string, name string, series string, i int, start double, end double, value double, label string, error string"


def _curve(c: Clip, x: np.ndarray, kept: np.ndarray | None = None) -> Series:
    """A value for each hop, or for those kept."""
    at = np.arange(len(x)) if kept is None else np.flatnonzero(kept)
    return c.times(at), c.times(at + 1), x[at], [None] * len(at)


def _marks(c: Clip, frames: np.ndarray, values: np.ndarray, labels: list[str] | None = None) -> Series:
    return c.times(frames), c.times(frames), values[frames] if len(frames) else np.zeros(0), labels or [None] * len(frames)


def _spans(bounds: np.ndarray, unit: float, labels: list[str]) -> Series:
    return bounds[:, 0] * unit, bounds[:, 1] * unit, (bounds[:, 1] - bounds[:, 0]) * unit, labels


def _labelled(c: Clip, kinds: np.ndarray, name: Callable[[int], str]) -> Series:
    """Stretches of frames of one kind."""
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(kinds)) + 1, [len(kinds)]]).astype(int)
    return _spans(np.stack([cuts[:-1], cuts[1:]], 1), c.hop / c.sr, [name(int(kinds[a])) for a in cuts[:-1]])


def _chord_name(i: int) -> str:
    return joins.chord_templates()[i][1]


#: What extractors can tell over time: name -> the series of a recording.
TIMELINES: dict[str, Callable[[Clip], dict[str, Series]]] = {
    "loudness_extractor": lambda c: {"rms": _curve(c, c.rms)},
    "vad_extractor": lambda c: {"speech": _spans(r := _runs(_voiced(c)), 0.03, ["speech"] * len(r)), "f0": _curve(c, f := c.f0(), np.isfinite(f))},
    "pitch": lambda c: {f"f0_{m}": _curve(c, f, np.isfinite(f)) for m, f in c.pitches.items()},
    "spectral_extractor": lambda c: {n: _curve(c, getattr(c, n)) for n in ("centroid", "bandwidth", "rolloff", "flatness", "zcr")},
    "tempo": lambda c: {"beats": _marks(c, c.beat_frames, c.strength), "onsets": _marks(c, c.onsets, c.strength)},
    "onset": lambda c: {f"onset_{m}": _marks(c, c.onsets_by(m), c.onset_curve(m)) for m in dsp.ONSET_METHODS},
    "speaker_diarization": lambda c: {"turns": _spans((t := _turns(c))[0], 0.03, [f"speaker_{s}" for s in t[1]])},
    "phoneme_analysis": lambda c: {"sounds": _labelled(c, _sounds(c)[2], SOUNDS.__getitem__)},
    "music_analysis": lambda c: {"chords": _labelled(c, _chords(c), _chord_name)},
    "sound_event_detection": lambda c: {"events": _marks(c, (m := _moments(c))[0], c.rms, [list(scoring.EVENTS)[k] if k >= 0 else "unknown" for k in m[1]])},
}


def timelines(recordings: DataFrame, names: list[str] | None = None, rec: str = "rec_id", sr: int = 22050) -> DataFrame:
    """Rows (see TIMES) of the series of the named extractors, all that have any by default, for recordings as in `extract`.

    Curves, moments and labelled stretches are rows of one kind, so segments take them by time (`segments.assign` on
    start). What fails gives a row with its error and no series. Narrow: one pass, no shuffle.
    """
    wanted = [n for n in (names or list(TIMELINES)) if n in TIMELINES]
    bound_batches(recordings.sparkSession)
    columns = [rec, "x", *(["sr"] if "sr" in recordings.columns else [])]
    fields = [x.split()[0] for x in TIMES.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for row in frame.itertuples(index=False):
                clip = None
                for n in wanted:
                    try:
                        clip = clip or Clip(np.asarray(row.x, np.float64), int(getattr(row, "sr", sr)))
                        made = TIMELINES[n](clip)
                    except Exception as e:  # noqa: BLE001
                        yield pd.DataFrame([(str(row[0]), n, None, None, None, None, None, None, str(e) or type(e).__name__)], columns=fields)
                        continue
                    for series, (starts, ends, values, labels) in made.items():
                        text = lambda x, size=len(starts): pd.Series(x if isinstance(x, list) else [x] * size, dtype=object)
                        some = {"i": np.arange(len(starts)), "start": starts, "end": ends, "value": np.asarray(values, np.float64)}
                        some |= {"video_id": text(str(row[0])), "name": text(n), "series": text(series), "label": text(labels), "error": text(None)}
                        yield pd.DataFrame(some, columns=fields)

    return recordings.select(*columns).mapInPandas(run, TIMES)


def segment_spectra(recordings: DataFrame, config: SegmentConfig, rec: str = "rec_id", sr: int = 22050) -> DataFrame:
    """rec, segment_index, mel and mfcc: means over the frames that begin in each segment; recordings without samples, or that fail, have none."""
    bound_batches(recordings.sparkSession)
    columns = [rec, "x", *(["sr"] if "sr" in recordings.columns else [])]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            for row in frame.itertuples(index=False):
                if row.x is None or not len(row.x):
                    continue
                clip = Clip(np.asarray(row.x, np.float64), int(getattr(row, "sr", sr)))
                mel, mfcc = dsp.to_db(clip.mel(config.n_mels)), dsp.dct2(dsp.to_db(clip.mel(128)), config.n_mfcc)
                t, out = clip.times(np.arange(mel.shape[1])), []
                for k in range(int(clip.duration / config.hop) + 1):
                    a, b = np.searchsorted(t, [k * config.hop, k * config.hop + config.segment_len])
                    if a < b:
                        out.append((row[0], k, mel[:, a:b].mean(1), mfcc[:, a:b].mean(1)))
                yield pd.DataFrame(out, columns=[rec, "segment_index", "mel", "mfcc"])

    kind = recordings.schema[rec].dataType.simpleString()
    return recordings.select(*columns).mapInPandas(run, f"{rec} {kind}, segment_index long, mel array<double>, mfcc array<double>")
