"""Numpy signal processing for one clip at a time; Spark deals the clips."""

from __future__ import annotations

import functools

import numpy as np

EPS = 1e-10


#: Zero crossings of the resampling filter on each side, and outputs of a block.
CROSSINGS, RESAMPLED = 32, 1 << 12


@functools.cache
def filter_bank(up: int, down: int) -> np.ndarray:
    """(up, taps): for each place of an output between two inputs the weights of the inputs around it, a windowed sinc.

    The band is that of the lower rate; every filter leaves a constant as it is.
    """
    cut = min(1.0, up / down)
    half = int(np.ceil(CROSSINGS / cut))
    at = np.arange(-half + 1, half + 1)[None, :] - np.arange(up)[:, None] / up
    bank = cut * np.sinc(cut * at) * np.where(np.abs(at) < half, 0.5 + 0.5 * np.cos(np.pi * at / half), 0)
    return bank / bank.sum(axis=1, keepdims=True)


def resample(x: np.ndarray, sr: int, target: int, block: int = RESAMPLED) -> np.ndarray:
    """Band-limited resampling by a polyphase filter, so many outputs at a time; beyond its ends a signal is silent."""
    if sr == target or not len(x):
        return x
    shared = int(np.gcd(sr, target))
    up, down = target // shared, sr // shared
    bank = filter_bank(up, down)
    taps = bank.shape[1]
    padded = np.concatenate((np.zeros(taps // 2 - 1), x, np.zeros(taps // 2 + 1)))
    out = np.empty(int(round(len(x) * target / sr)))
    for first in range(0, len(out), block):
        at, phase = np.divmod(np.arange(first, min(first + block, len(out)), dtype=np.int64) * down, up)
        near = np.lib.stride_tricks.sliding_window_view(padded, taps)[np.minimum(at, len(padded) - taps)]
        out[first : first + block] = np.einsum("ij,ij->i", near, bank[phase])
    return out


def frames(x: np.ndarray, length: int, hop: int, centred: bool = True) -> np.ndarray:
    """(n_frames, length); with ``centred`` the signal is padded by half a frame."""
    if centred:
        x = np.pad(x, length // 2)
    if len(x) < length:
        x = np.pad(x, (0, length - len(x)))
    return np.lib.stride_tricks.sliding_window_view(x, length)[::hop]


def window(kind: str, n: int) -> np.ndarray:
    a = {"hamming": 0.54, "hann": 0.5}[kind]
    return a - (1 - a) * np.cos(2 * np.pi * np.arange(n) / n)


def spectrum(x: np.ndarray, n_fft: int = 512, hop: int = 256, kind: str = "hamming") -> np.ndarray:
    """Magnitudes (n_frames, n_fft // 2 + 1)."""
    return np.abs(np.fft.rfft(frames(x, n_fft, hop) * window(kind, n_fft), axis=1))


def centroid(s: np.ndarray, sr: int) -> np.ndarray:
    f = np.linspace(0, sr / 2, s.shape[1])
    return (s @ f) / np.maximum(s.sum(1), EPS)


def bandwidth(s: np.ndarray, sr: int) -> np.ndarray:
    f = np.linspace(0, sr / 2, s.shape[1])
    p = s / np.maximum(s.sum(1, keepdims=True), EPS)
    return np.sqrt((p * (f[None, :] - centroid(s, sr)[:, None]) ** 2).sum(1))


def rolloff(s: np.ndarray, sr: int, part: float = 0.85) -> np.ndarray:
    f = np.linspace(0, sr / 2, s.shape[1])
    grown = s.cumsum(1)
    return f[(grown >= part * grown[:, -1:]).argmax(1)]


def zero_crossings(x: np.ndarray, length: int = 512, hop: int = 256) -> np.ndarray:
    f = frames(x, length, hop)
    return (np.diff(np.signbit(f), axis=1)).sum(1) / length


def rms(x: np.ndarray, length: int = 512, hop: int = 256) -> np.ndarray:
    return np.sqrt((frames(x, length, hop) ** 2).mean(1))


def contrast(s: np.ndarray, sr: int, bands: int = 6, low: float = 200.0, part: float = 0.02) -> np.ndarray:
    """(n_frames, bands + 1): decibels between peaks and valleys of octave bands."""
    f = np.linspace(0, sr / 2, s.shape[1])
    edges = [0.0, *[low * 2.0**k for k in range(bands + 1)]]
    if edges[-2] >= sr / 2:
        raise ValueError("the highest band lies above half the sample rate")
    out = []
    for k in range(bands + 1):
        inside = (f >= edges[k]) & (f <= edges[k + 1] if k < bands else True)
        band = np.sort(s[:, inside], axis=1)
        n = max(1, int(round(part * band.shape[1])))
        peak, valley = band[:, -n:].mean(1), band[:, :n].mean(1)
        out.append(10 * np.log10(np.maximum(peak, EPS)) - 10 * np.log10(np.maximum(valley, EPS)))
    return np.stack(out, axis=1)


def chroma(s: np.ndarray, sr: int) -> np.ndarray:
    """(n_frames, 12): power by pitch class, the largest of each frame 1."""
    f = np.linspace(0, sr / 2, s.shape[1])[1:]
    pitch = np.round(12 * np.log2(f / 440.0) + 69).astype(int) % 12
    fold = np.zeros((len(f), 12))
    fold[np.arange(len(f)), pitch] = 1
    out = (s[:, 1:] ** 2) @ fold
    return out / np.maximum(out.max(1, keepdims=True), EPS)


@functools.cache
def mel_filters(sr: int, n_fft: int, n_mels: int = 128) -> np.ndarray:
    """Triangles of equal area on the mel scale, (n_mels, n_fft // 2 + 1)."""
    to_mel = lambda f: np.where(f < 1000, f * 3 / 200, 15 + 27 * np.log(np.maximum(f, 1e-9) / 1000) / np.log(6.4))
    to_hz = lambda m: np.where(m < 15, m * 200 / 3, 1000 * np.exp((m - 15) * np.log(6.4) / 27))
    points = to_hz(np.linspace(0, float(to_mel(np.array(sr / 2))), n_mels + 2))
    f = np.linspace(0, sr / 2, n_fft // 2 + 1)
    up = (f[None, :] - points[:-2, None]) / np.diff(points)[:-1, None]
    down = (points[2:, None] - f[None, :]) / np.diff(points)[1:, None]
    return np.maximum(0, np.minimum(up, down)) * (2 / (points[2:] - points[:-2]))[:, None]


def mfcc(x: np.ndarray, sr: int, n: int = 13, n_fft: int = 512, hop: int = 256, n_mels: int = 128, kind: str = "hamming") -> np.ndarray:
    """(n_frames, n): orthonormal DCT-II of the log mel spectrum in decibels, 80 below the peak at most."""
    power = spectrum(x, n_fft, hop, kind) ** 2
    db = 10 * np.log10(np.maximum(power @ mel_filters(sr, n_fft, n_mels).T, EPS))
    db = np.maximum(db, db.max() - 80)
    k, m = np.arange(n)[:, None], np.arange(n_mels)[None, :]
    basis = np.cos(np.pi * k * (2 * m + 1) / (2 * n_mels)) * np.where(k == 0, np.sqrt(1 / n_mels), np.sqrt(2 / n_mels))
    return db @ basis.T


def delta(c: np.ndarray, width: int = 9, order: int = 1) -> np.ndarray:
    """Savitzky-Golay derivative along the frames; the ends take the derivative of the end fit."""
    if len(c) < width:
        raise ValueError(f"a delta of width {width} needs as many frames")
    half = width // 2
    t = np.arange(-half, half + 1)
    fit = np.linalg.pinv(np.vander(t, order + 1, increasing=True))
    factor = 1 if order == 1 else 2
    windows = np.lib.stride_tricks.sliding_window_view(c, width, axis=0)
    inner = windows @ (fit[order] * factor)
    first, last = fit @ c[:width], fit @ c[-width:]
    slope = lambda p, at: p[1] if order == 1 else 2 * p[2]
    head = np.stack([slope(first, x) for x in t[:half]])
    tail = np.stack([slope(last, x) for x in t[half + 1 :]])
    return np.concatenate((head, inner, tail))


def mfcc_frames(x: np.ndarray, sr: int, deltas: bool = True, delta_deltas: bool = False, **options) -> np.ndarray:
    base = mfcc(x, sr, **options)
    return np.concatenate([base, *([delta(base)] if deltas else []), *([delta(base, order=2)] if delta_deltas else [])], axis=1)


def spectral_frames(x: np.ndarray, sr: int, n_fft: int = 512, hop: int = 256, with_contrast: bool = True, with_chroma: bool = True) -> np.ndarray:
    """(n_frames, 24): one spectrum for the Hamming features, one Hann spectrum for contrast and chroma."""
    s = spectrum(x, n_fft, hop)
    parts = [centroid(s, sr)[:, None], bandwidth(s, sr)[:, None], rolloff(s, sr)[:, None], zero_crossings(x, n_fft, hop)[:, None], rms(x, n_fft, hop)[:, None]]
    if with_contrast or with_chroma:
        hann = spectrum(x, n_fft, hop, "hann")
        parts += [contrast(hann, sr)] if with_contrast else []
        parts += [chroma(hann, sr)] if with_chroma else []
    n = min(map(len, parts))
    return np.concatenate([p[:n] for p in parts], axis=1)


#: Thresholds of the period search and how likely each is (a beta distribution of 2 and 18), after Mauch and Dixon (2014).
THRESHOLDS = np.linspace(0.01, 1, 100)
_PRIOR = THRESHOLDS * (1 - THRESHOLDS) ** 17
_PRIOR /= _PRIOR.sum()
#: Chance to start or stop voicing at a frame, and how many octaves pitch moves from frame to frame, about.
SWITCH, GLIDE = 0.01, 0.1


def _difference(f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cumulative-mean-normalised differences (frames, lags) of frames, and the energy of their first halves."""
    length = f.shape[1]
    half = length // 2
    spec = np.fft.rfft(f, 2 * length, axis=1)
    head = np.fft.rfft(f[:, :half], 2 * length, axis=1)
    cross = np.fft.irfft(spec * np.conj(head), axis=1)[:, :half]
    power = np.concatenate((np.zeros((len(f), 1)), (f**2).cumsum(1)), axis=1)
    tau = np.arange(half)
    energy = power[:, half + tau] - power[:, tau]
    d = np.maximum(energy[:, :1] + energy - 2 * cross, 0)
    grown = d.cumsum(1)
    norm = np.where(grown > EPS, d * np.maximum(tau, 1) / np.maximum(grown, EPS), 1.0)
    norm[:, 0] = 1
    return norm, energy[:, 0]


def _candidates(row: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Periods of a frame, refined by a parabola, and their probabilities: how many thresholds choose each, weighted."""
    inside = row[low : high + 1]
    at = np.flatnonzero((inside[1:-1] <= inside[:-2]) & (inside[1:-1] < inside[2:])) + low + 1
    if not len(at):
        return np.empty(0), np.empty(0)
    below = row[at][:, None] < THRESHOLDS[None, :]
    hit = below.any(0)
    chance = np.bincount(below.argmax(0)[hit], weights=_PRIOR[hit], minlength=len(at))
    at, chance = at[chance > 0], chance[chance > 0]
    a, b, c = row[at - 1], row[at], row[at + 1]
    bend = np.maximum(a - 2 * b + c, EPS)
    return at + np.clip((a - c) / (2 * bend), -0.5, 0.5), chance


def pitch(x: np.ndarray, sr: int, low: float = 50.0, high: float = 8000.0, length: int = 2048, hop: int = 512) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """F0 (NaN unvoiced), voiced flags and probabilities: periods of each frame by many thresholds, then the most likely path through them."""
    norm, energy = _difference(frames(x, length, hop))
    first, last = max(2, int(sr / high)), min(norm.shape[1] - 2, int(sr / low))
    found = [_candidates(row, first, last) if e > EPS else (np.empty(0), np.empty(0)) for row, e in zip(norm, energy, strict=True)]
    probability = np.array([c.sum() for _, c in found])
    # states of a frame: its periods, then silence
    score, before = [], []
    for k, (tau, chance) in enumerate(found):
        seen = np.log(np.maximum(np.append(chance, 1 - chance.sum()), EPS))
        if k == 0:
            score.append(seen)
            before.append(None)
            continue
        step = np.full((len(found[k - 1][0]) + 1, len(tau) + 1), np.log(SWITCH))
        step[:-1, :-1] = np.log(1 - SWITCH) - np.abs(np.log2(found[k - 1][0][:, None] / tau[None, :])) / GLIDE
        step[-1, -1] = np.log(1 - SWITCH)
        total = score[-1][:, None] + step
        before.append(total.argmax(0))
        score.append(total.max(0) + seen)
    f0 = np.full(len(found), np.nan)
    state = int(score[-1].argmax()) if found else 0
    for k in range(len(found) - 1, -1, -1):
        tau = found[k][0]
        if state < len(tau):
            f0[k] = sr / tau[state]
        state = int(before[k][state]) if k else 0
    return f0, ~np.isnan(f0), np.clip(probability, 0, 1)


def _stats(v: np.ndarray) -> list[float]:
    q = np.percentile(v, [50, 25, 75])
    return [v.mean(), v.std(), v.min(), v.max(), np.ptp(v), *q]


def prosody(x: np.ndarray, sr: int, length: int = 2048, hop: int = 512) -> np.ndarray:
    """The 26 statistics of a clip; without a voiced frame the ten of pitch are 0."""
    f0, voiced, probability = pitch(x, sr, length=length, hop=hop)
    known = f0[~np.isnan(f0)]
    tone = [*_stats(known), voiced.mean(), np.nanmean(probability)] if len(known) else [0.0] * 10
    s = spectrum(x, length, hop, "hann")
    z, c, r = zero_crossings(x, length, hop), centroid(s, sr), rolloff(s, sr)
    return np.array([*tone, *_stats(rms(x, length, hop)), len(x) / sr, z.mean(), z.std(), z.max(), c.mean(), c.std(), r.mean(), r.std()])


def trim_silence(x: np.ndarray, threshold: float = 0.01, length: int = 2048, hop: int = 512) -> np.ndarray:
    """Cut the ends that stay below ``threshold`` times the loudest frame (0.01: 40 dB)."""
    if not len(x):
        return x
    level = rms(x, length, hop)
    loud = np.flatnonzero(level > threshold * level.max()) if level.max() > 0 else []
    return x[max(0, loud[0] * hop) : min(len(x), (loud[-1] + 1) * hop)] if len(loud) else x[:0]
