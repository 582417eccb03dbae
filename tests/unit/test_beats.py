"""Tempi of clicks, swung patterns and noise; places of beats."""

import numpy as np
import pytest

from segue.sources import audio, beats

RATE = beats.RATE


def clicks(times, seconds, loud=None, noise=0.005, seed=0):
    rng = np.random.default_rng(seed)
    y = rng.normal(0, noise, int(seconds * RATE))
    t = np.arange(int(0.05 * RATE)) / RATE
    hit = np.exp(-80 * t) * np.sin(2 * np.pi * 1000 * t)
    for k, at in enumerate(times):
        a = int(at * RATE)
        n = min(len(hit), len(y) - a)
        if n > 0:
            y[a : a + n] += (1.0 if loud is None else loud[k]) * hit[:n]
    return y


@pytest.mark.parametrize("bpm", [72, 90, 100, 117, 120, 128, 133, 140, 155, 174])
def test_steady_clicks(bpm):
    times = np.arange(0.2, 30, 60 / bpm)
    y = clicks(times, 30)
    assert abs(audio.tempo(y) - bpm) <= 1
    _, at = beats.beats(y)
    gaps = np.abs(at[:, None] - times[None]).min(axis=1)
    assert len(at) > 0.8 * len(times) and np.mean(gaps < 0.03) > 0.95


@pytest.mark.parametrize("first,then", [(100, 140), (128, 90), (120, 126)])
def test_tempo_change(first, then):
    """The tempo that most of the minute has."""
    times = np.concatenate([np.arange(0.1, 40, 60 / first), np.arange(40, 60, 60 / then)])
    assert abs(audio.tempo(clicks(times, 60)) - first) <= 1


@pytest.mark.parametrize("bpm", [96, 120, 138])
def test_swing(bpm):
    """Beats and softer strokes at two thirds of the way to the next."""
    on = np.arange(0.1, 40, 60 / bpm)
    times, loud = np.concatenate([on, on + 40 / bpm]), [1.0] * len(on) + [0.5] * len(on)
    assert abs(audio.tempo(clicks(times, 40, loud)) - bpm) <= 1


def test_noise_and_tones_over_beats():
    times = np.arange(0.1, 40, 60 / 124)
    y = clicks(times, 40, noise=0.1, seed=3) + 0.2 * np.sin(2 * np.pi * 220 * np.arange(40 * RATE) / RATE)
    assert abs(audio.tempo(y) - 124) <= 1


def test_silence_and_scraps():
    assert audio.tempo(np.zeros(RATE)) is None and audio.tempo(np.ones(50)) is None and beats.beats(np.empty(0))[1].size == 0
    assert audio.tempo(np.full(RATE * 2, 0.5)) is None or audio.tempo(np.full(RATE * 2, 0.5)) > 0
