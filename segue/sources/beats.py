"""Beats and tempo of a sound.

Onsets are rises of the log mel spectrum. Their autocorrelation in windows of
some seconds, averaged, and weighed by how far a tempo is from 120 beats a minute
in octaves, gives the period that the sound keeps most of the time. A dynamic
programme then places beats: each on an onset, and as far from the one before as
the period says. The tempo is that of the beats that keep to their usual distance.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

RATE, WINDOW, HOP = 22050, 1024, 256
FRAMES = RATE / HOP  # a second

#: Seconds of a window of the autocorrelation, tempi that are heard, the likeliest one and its spread in octaves.
SECONDS, SLOWEST, FASTEST, LIKELY, OCTAVES = 8.0, 30, 300, 120.0, 1.0

#: How much a beat's distance from the one before counts against its onset.
TIGHT = 100.0


@lru_cache(maxsize=4)
def mel(bands: int = 40, window: int = WINDOW) -> np.ndarray:
    """Triangles over the bins of a spectrum, evenly wide in mels."""
    hz = np.fft.rfftfreq(window, 1 / RATE)
    points = 700 * (10 ** (np.linspace(0, 2595 * np.log10(1 + RATE / 2 / 700), bands + 2) / 2595) - 1)
    rise = (hz[None] - points[:-2, None]) / np.diff(points)[:-1, None]
    fall = (points[2:, None] - hz[None]) / np.diff(points)[1:, None]
    return np.maximum(0, np.minimum(rise, fall))


def onsets(y: np.ndarray) -> np.ndarray:
    """How much the mel bands' level rises, in dB, frame by frame."""
    cut = np.lib.stride_tricks.sliding_window_view(np.pad(y, WINDOW // 2), WINDOW)[::HOP]
    shape, parts = np.hanning(WINDOW), []
    for at in range(0, len(cut), 4096):
        parts.append(np.abs(np.fft.rfft(cut[at : at + 4096] * shape, axis=1)) ** 2 @ mel().T)
    power = np.concatenate(parts)
    level = 10 * np.log10(np.maximum(power, max(power.max() * 1e-8, 1e-10)))
    return np.concatenate([[0.0], np.maximum(0, np.diff(level, axis=0)).mean(axis=1)])


def period(onset: np.ndarray) -> float | None:
    """Frames from beat to beat, as most windows have it; null where nothing is repeated."""
    width = min(len(onset), int(SECONDS * FRAMES))
    lags = np.arange(1, width)
    bpm = 60 * FRAMES / lags
    heard = (bpm >= SLOWEST) & (bpm <= FASTEST)
    if not heard.any():
        return None
    total = np.zeros(width)
    for at in range(0, max(len(onset) - width, 0) + 1, max(1, width // 4)):
        part = onset[at : at + width]
        part = (part - part.mean()) * np.hanning(len(part) + 2)[1:-1]
        again = np.fft.irfft(np.abs(np.fft.rfft(part, 2 * width)) ** 2)[:width]
        if again[0] > 0:
            total += again / again[0]
    lags, bpm = lags[heard], bpm[heard]
    score = total[lags] * np.exp(-0.5 * (np.log2(bpm / LIKELY) / OCTAVES) ** 2)
    if score.max() <= 0:
        return None
    at = int(lags[score.argmax()])
    left, mid, right = total[at - 1], total[at], total[at + 1] if at + 1 < width else total[at]
    bend = left - 2 * mid + right
    return at + (float(np.clip(0.5 * (left - right) / bend, -0.5, 0.5)) if bend < 0 else 0.0)


def placed(onset: np.ndarray, every: float) -> np.ndarray:
    """Frames of the beats, about ``every`` frames apart."""
    spread = onset.std()
    if spread <= 0:
        return np.empty(0, np.int64)
    wide = np.arange(-int(every), int(every) + 1)
    local = np.convolve(onset / spread, np.exp(-0.5 * (wide * 32 / every) ** 2), "same")
    back = np.arange(-int(2 * every), -max(1, round(every / 2)) + 1)
    cost = -TIGHT * np.log(-back / every) ** 2
    total, before = local.copy(), np.full(len(local), -1)
    for t in range(len(local)):
        lo = max(0, -(t + back[0]))
        if lo >= len(back):
            continue
        score = total[t + back[lo:]] + cost[lo:]
        k = int(score.argmax())
        if score[k] > 0:
            total[t] += score[k]
            before[t] = t + back[lo + k]
    peak = np.flatnonzero((total[1:-1] > total[:-2]) & (total[1:-1] >= total[2:])) + 1
    if not len(peak):
        return np.empty(0, np.int64)
    at, out = int(peak[total[peak] >= 0.5 * np.median(total[peak])][-1]), []
    while at >= 0:
        out.append(at)
        at = int(before[at])
    return np.array(out[::-1])


def beats(y: np.ndarray) -> tuple[float | None, np.ndarray]:
    """(beats a minute, seconds of the beats); null and none for silence and scraps."""
    none = None, np.empty(0)
    if len(y) < 100 or np.abs(y).max() < 1e-4:
        return none
    onset = onsets(y)
    every = period(onset)
    if every is None:
        return none
    at = placed(onset, every)
    gaps = np.diff(at)
    if len(gaps) >= 4:
        usual = float(np.median(gaps))
        steady = gaps[np.abs(gaps - usual) <= max(1.0, 0.04 * usual)]
        if abs(steady.mean() - every) <= 0.1 * every:
            every = float(steady.mean())
    return 60 * FRAMES / every, at / FRAMES
