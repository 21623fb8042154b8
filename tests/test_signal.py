"""Filters and quantisers on arrays."""

import numpy as np

from lodestone.operators import signal


def tone(hz, rate, n):
    return np.sin(2 * np.pi * hz * np.arange(n) / rate)


def level(x):
    return 20 * np.log10(np.sqrt(np.mean(x[500:-500] ** 2)) * np.sqrt(2) + 1e-12)


def test_resampler_keeps_and_cuts():
    kept = signal.resample(tone(1000, 96_000, 48_001), 2)
    assert len(kept) == 24_001 and np.abs(kept[500:-500] - tone(1000, 48_000, 24_001)[500:-500]).max() < 1e-4
    assert abs(level(signal.resample(tone(19_000, 96_000, 48_000), 2))) < 0.02
    assert level(signal.resample(tone(30_000, 96_000, 48_000), 2)) < -80


def test_decimation_mixes_and_cuts():
    both = np.stack([tone(1000, 44_100, 44_100), tone(1000, 44_100, 44_100)], 1)
    assert len(signal.decimate(both, 44_100)) == 11_025 and abs(level(signal.decimate(both, 44_100))) < 0.5
    high = np.stack([tone(9000, 44_100, 44_100)] * 2, 1)
    assert level(signal.decimate(high, 44_100)) < -60


def test_quantiser_rounds_up_clamps_and_repeats():
    assert signal.quantize(np.array([0.5 / 128, -0.5 / 128, 1.0, -1.0]), 8).tolist() == [1, 0, 127, -128]
    x = tone(100, 8000, 4000) * 0.3
    assert np.array_equal(signal.quantize(x, 16, 7), signal.quantize(x, 16, 7)) and np.abs(signal.quantize(x, 16, 7) - x * 32768).max() < 1.6


def test_power_of_empty_and_odd_rows(spark):
    rows = spark.createDataFrame([(1, []), (2, None), (3, [1.0, 2.0, 3.0])], "track long, samples array<double>")
    got = {}
    for r in signal.power_spectrum(rows).collect():
        got.setdefault(r.track, []).append(r.power)
    assert len(got[3]) == 3 and got[1] == got[2] == [0.0]
