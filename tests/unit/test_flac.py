"""FLAC files of all kinds of frames give the samples that were put in."""

import os
import sys
import wave

import numpy as np
import pytest

from segue.sources import audio, flac

sys.path.insert(0, os.path.dirname(__file__))
from flac_writer import encode  # noqa: E402
from test_sources import tone  # noqa: E402


def sound(n, channels=2, bits=16, seed=0):
    rng = np.random.default_rng(seed)
    t = np.arange(n)[:, None]
    y = 0.4 * np.sin(t / (9 + np.arange(channels))) + 0.3 * np.sin(t / 31) + rng.normal(0, 0.01, (n, channels))
    return np.round(np.clip(y, -1, 1) * ((1 << (bits - 1)) - 1)).astype(np.int64)


@pytest.mark.parametrize("kind", ["verbatim", "fixed0", "fixed1", "fixed2", "fixed3", "fixed4", "lpc"])
@pytest.mark.parametrize("channel", [1, 8, 9, 10])
def test_kinds_of_frames(kind, channel):
    x = sound(1000)
    got, about = flac.decode(encode(x, layouts=[(channel, [kind, kind])]))
    assert np.array_equal(got, x) and (about.rate, about.channels, about.bits, about.samples) == (22050, 2, 16, 1000)


@pytest.mark.parametrize("options", [{"escape": True}, {"wide": True}, {"wide": True, "escape": True}, {"parts_log": 0}, {"parts_log": 5}])
def test_residuals(options):
    x = sound(700)
    assert np.array_equal(flac.decode(encode(x, layouts=[(1, ["fixed1", "lpc"])], **options))[0], x)


@pytest.mark.parametrize("bits", [8, 12, 16, 24])
def test_sample_sizes_channels_and_wasted_bits(bits):
    x = sound(600, 3, bits)
    assert np.array_equal(flac.decode(encode(x, bits=bits, layouts=[(2, ["fixed2", "lpc", "verbatim"])]))[0], x)
    x = x >> 3 << 3
    assert np.array_equal(flac.decode(encode(x, bits=bits, wasted=3))[0], x)


def test_constant_and_many_frames():
    x = np.zeros((300 * 16, 1), np.int64)
    x[16 * 200 :] = -7
    assert np.array_equal(flac.decode(encode(x, block=16, layouts=[(0, ["constant"])]))[0], x)
    y = sound(5000)
    data = encode(y, layouts=[(1, ["fixed2", "lpc"]), (10, ["lpc", "fixed4"]), (8, ["verbatim", "fixed0"])], total=0)
    assert np.array_equal(flac.decode(data)[0], y)
    assert np.array_equal(flac.decode(data, 0.05)[0], y[: int(0.05 * 22050)])
    assert flac.decode(encode(y[:0]))[0].shape == (0, 2)


def test_broken_files():
    data = encode(sound(2000))
    for bad in (b"", b"RIFF", data[:20], data[: len(data) // 2], data[:-1], data[: flac.stream(data).at + 3]):
        with pytest.raises(flac.Broken):
            flac.decode(bad)
    rng = np.random.default_rng(1)
    for spot in rng.integers(flac.stream(data).at, len(data), 40).tolist():
        with pytest.raises(flac.Broken):
            flac.decode(data[:spot] + bytes([data[spot] ^ 0x10]) + data[spot + 1 :])


def test_long_sound_in_little_time():
    import time

    x = sound(441_000)
    data = encode(x, block=4096, parts_log=4)
    began = time.perf_counter()
    assert np.array_equal(flac.decode(data)[0], x)
    assert time.perf_counter() - began < 20


def test_features_equal_those_of_the_same_wav(spark, tmp_path):
    y = tone(440)
    x = np.round(y * 32000).astype(np.int64)[:, None]
    (tmp_path / "a.flac").write_bytes(encode(x, block=1024))
    with wave.open(str(tmp_path / "a.wav"), "wb") as f:
        f.setparams((1, 2, 22050, 0, "NONE", ""))
        f.writeframes(x.astype("<i2").tobytes())
    (tmp_path / "b.mp3").write_bytes(b"ID3 and so on")
    (tmp_path / "c.flac").write_bytes(encode(x)[:300])
    (tmp_path / "d.txt").write_bytes(b"no sound")
    rows = {r.path.rpartition("/")[2]: r for r in audio.features(spark, str(tmp_path)).collect()}
    assert set(rows) == {"a.flac", "a.wav", "b.mp3", "c.flac"}
    for name in (*audio.NAMES, "camelot_key"):
        assert getattr(rows["a.flac"], name) == getattr(rows["a.wav"], name)
    assert rows["a.flac"].error is None and "decoder" in rows["b.mp3"].error and "cut short" in rows["c.flac"].error and rows["b.mp3"].rms_energy is None
    assert {r.path.rpartition("/")[2] for r in audio.tempos(spark, str(tmp_path)).collect()} == set(rows)
