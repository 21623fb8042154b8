"""Signal features from samples in long form: (track, channel, idx, value), all as aggregates."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def effective_bits(samples: DataFrame, bits: int) -> DataFrame:
    """Bits below which every sample is zero don't count; silence has none. One OR a track, with partial sums."""
    folded = samples.groupBy("track").agg(F.bit_or("value").alias("o"))
    zeros = F.bit_count(F.col("o").bitwiseAND(-F.col("o")) - 1)
    return folded.select("track", F.when(F.col("o") == 0, 0).otherwise(F.lit(bits) - zeros).cast("int").alias("effective_bits"))


def blocks(samples: DataFrame, length: int, least: int) -> DataFrame:
    """(track, channel, block, n, rms, peak): root of twice the mean square, and the largest size. The last block counts
    if it has ``least`` samples."""
    block = F.floor(F.col("idx") / length).cast("long")
    each = samples.groupBy("track", "channel", block.alias("block")).agg(F.count("*").alias("n"), F.sum(F.col("value") * F.col("value")).alias("s"), F.max(F.abs("value")).alias("peak"))
    return each.where(F.col("n") >= least).select("track", "channel", "block", "n", F.sqrt(2.0 * F.col("s") / F.col("n")).alias("rms"), "peak")


def dynamic_range(made: DataFrame) -> DataFrame:
    """(track, dr): 20 log10 of the second largest peak over the rms of the loudest fifth, the mean of the channels; none
    for less than two blocks. A track's blocks are bounded by its length."""
    loud = Window.partitionBy("track", "channel").orderBy(F.desc("rms"), "block")
    high = Window.partitionBy("track", "channel").orderBy(F.desc("peak"), "block")
    whole = Window.partitionBy("track", "channel")
    ranked = made.select("*", F.row_number().over(loud).alias("l"), F.row_number().over(high).alias("h"), F.count("*").over(whole).alias("c"))
    top = F.greatest(F.lit(1), F.floor(0.2 * F.col("c") + 0.5))
    each = ranked.where("c >= 2").groupBy("track", "channel").agg(F.sqrt(F.avg(F.when(F.col("l") <= top, F.col("rms") * F.col("rms")))).alias("rms"), F.max(F.when(F.col("h") == 2, F.col("peak"))).alias("peak"))
    return each.where("rms > 0 and peak > 0").groupBy("track").agg(F.round(F.avg(20 * F.log10(F.col("peak") / F.col("rms"))), 6).alias("dr"))


def smooth(spectrum: DataFrame, half: int) -> DataFrame:
    """Centred moving mean over (track, bin, db), clamped at the edges."""
    frame = Window.partitionBy("track").orderBy("bin").rowsBetween(-half, half)
    return spectrum.select("track", "bin", F.round(F.avg("db").over(frame), 6).alias("db"))


def levels(spectrum: DataFrame, hz: float) -> DataFrame:
    """(track, bin, level): smoothed over 120 Hz, against the loudest smoothed bin between 200 Hz and 4 kHz."""
    smoothed = smooth(spectrum, max(1, _bin(60, hz)))
    low, high = _bin(200, hz), max(_bin(200, hz), _bin(4000, hz))
    whole = Window.partitionBy("track")
    return smoothed.select("track", "bin", (F.col("db") - F.max(F.when(F.col("bin").between(low, high), F.col("db"))).over(whole)).alias("level"))


def _bin(of: float, hz: float) -> int:
    return math.floor(of / hz + 0.5)


def cliffs(level: DataFrame, hz: float, bins: int) -> DataFrame:
    """(track, hz, drop, below, above) of the steepest wall of each track, if it has one: more than 20 dB between the
    kilohertz below and above a point from 10.5 kHz on, the first of equals, unless the level comes back later. The edge is
    the first bin below half of the way."""
    near = max(1, _bin(200, hz))
    far = max(near + 1, _bin(1200, hz))
    top = bins - 1 - max(1, _bin(50, hz))
    first, last = max(_bin(10_500, hz), far), top - max(near + 1, _bin(300, hz)) - near
    order = Window.partitionBy("track").orderBy("bin")
    within = F.when(F.col("bin") <= top, F.col("level"))
    each = level.select("track", "bin", F.avg("level").over(order.rowsBetween(-far, -near)).alias("below"), F.avg(within).over(order.rowsBetween(near, far)).alias("above"))
    drops = each.where(F.col("bin").between(first, last)).withColumn("drop", F.round(F.col("below") - F.col("above"), 9)).where("drop > 20")
    best = drops.groupBy("track").agg(F.max_by(F.struct("bin", "drop", "below", "above"), F.struct("drop", -F.col("bin"))).alias("w"))
    near_wall = level.join(best, "track")
    judged = near_wall.groupBy("track", "w").agg(
        F.max(F.when(F.col("bin").between(F.col("w.bin") + near, F.lit(top)), F.col("level"))).alias("later"),
        F.min(F.when(F.col("bin").between(F.col("w.bin") - near, F.least(F.lit(top), F.col("w.bin") + far)) & (F.col("level") < (F.col("w.below") + F.col("w.above")) / 2), F.col("bin"))).alias("edge"),
    )
    kept = judged.where(F.col("later") <= F.col("w.above") + 15)
    return kept.select("track", (F.coalesce("edge", "w.bin") * hz).alias("hz"), F.round("w.drop", 6).alias("drop"), F.round("w.below", 6).alias("below"), F.round("w.above", 6).alias("above"))


def across(level: DataFrame, hz: float, bins: int, *boundaries: float) -> DataFrame:
    """(track, across_0, ...): how far the level falls across each boundary, 4 to 1 kHz below against 1.5 to 4.5 kHz above;
    0 where that is out of range. One aggregate for all boundaries."""
    means = []
    for i, at in enumerate(boundaries):
        spans = [(_bin(at + a, hz), _bin(at + b, hz)) for a, b in ((-4000, -1000), (1500, 4500))]
        if any(a < 0 or b > bins - 1 or b <= a for a, b in spans):
            means.append(F.lit(0.0).alias(f"across_{i}"))
            continue
        below, above = (F.avg(F.when(F.col("bin").between(a, b), F.col("level"))) for a, b in spans)
        means.append(F.round(below - above, 6).alias(f"across_{i}"))
    return level.groupBy("track").agg(F.count("*").alias("_n"), *means).drop("_n")


def ultrasonic(fallen: DataFrame, rates: DataFrame) -> DataFrame:
    """(track, ultrasonic_db): the larger fall of a track of 88.2 kHz and more, else 0."""
    return fallen.join(rates, "track").select("track", F.when(F.col("sample_rate") >= 88_200, F.greatest("across_0", "across_1")).otherwise(0.0).alias("ultrasonic_db"))


def words(frames: DataFrame) -> DataFrame:
    """(track, frame, word) of rows (track, frame, bands: array of 33 energies): bit m says whether the difference of bands
    m and m + 1 grew against the frame before. The first frame has none."""
    before = F.lag("bands").over(Window.partitionBy("track").orderBy("frame"))
    pairs = frames.select("track", "frame", "bands", before.alias("old")).where("old is not null")
    grew = lambda m: (F.col("bands")[m] - F.col("bands")[m + 1]) - (F.col("old")[m] - F.col("old")[m + 1]) > 0
    word = F.aggregate(F.sequence(F.lit(0), F.lit(31)), F.lit(0).cast("long"), lambda s, m: s + F.when(grew(m), F.expr("bigint(1)") * F.pow(F.lit(2.0), m).cast("long")).otherwise(0))
    return pairs.select("track", "frame", word.alias("word"))


def packed(power: DataFrame, points: int, bins: int, reference: float) -> DataFrame:
    """(track, point, level): the mean power of each point's bins in whole dB below the reference, 0 to 255, halves up."""
    point = F.floor(F.col("bin") * points / bins).cast("int")
    each = power.groupBy("track", point.alias("point")).agg(F.avg("power").alias("p"))
    db = F.floor(F.round(reference - 10 * F.log10(F.col("p") + 1e-30), 9) + 0.5)
    return each.select("track", "point", F.greatest(F.lit(0), F.least(F.lit(255), db)).cast("int").alias("level"))


def power_spectrum(frames: DataFrame) -> DataFrame:
    """(track, bin, power) of rows (track, samples: array): a Hann window, zeros up to the next power of two, and the square
    of each frequency's size. A row is one transform, so rows go through in Arrow batches."""

    def run(batches):
        for batch in batches:
            out = {"track": [], "bin": [], "power": []}
            for track, values in zip(batch.column("track").to_pylist(), batch.column("samples").to_pylist()):
                values = np.array(values or [0.0], float)
                size = 1 << (len(values) - 1).bit_length()
                power = np.abs(np.fft.rfft(values * np.hanning(len(values) + 1)[:-1], size)) ** 2
                out["track"] += [track] * len(power)
                out["bin"] += range(len(power))
                out["power"] += power.tolist()
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("track", pa.int64()), ("bin", pa.int32()), ("power", pa.float64())]))

    return frames.select("track", F.col("samples").cast("array<double>")).mapInArrow(run, "track long, bin int, power double")


def sinc(taps: int, cutoff: float, beta: float | None = None) -> np.ndarray:
    """A low pass of unit sum; cutoff as a share of the rate; a Blackman window, or a Kaiser one of that beta."""
    at = np.arange(taps) - (taps - 1) / 2
    made = 2 * cutoff * np.sinc(2 * cutoff * at) * (np.blackman(taps) if beta is None else np.kaiser(taps, beta))
    return made / made.sum()


def decimate(values: np.ndarray, rate: int) -> np.ndarray:
    """The first 30 seconds of a mono mix, low-passed at 4 kHz, every rate // 11025-th sample."""
    taps = max(9, int(5.5 * rate / 4000) | 1)
    mono = values[: 30 * rate].mean(axis=1)
    return np.convolve(mono, sinc(taps, 4000 / rate), "same")[:: max(1, rate // 11025)]


def resample(values: np.ndarray, factor: int) -> np.ndarray:
    """Every factor-th sample after a Kaiser low pass of 100 dB, without delay: ceil(n / factor) of them."""
    taps = 2 * 64 * factor + 1
    return np.convolve(values, sinc(taps, 0.455 / factor, 0.1102 * (100 - 8.7)), "full")[taps // 2 : taps // 2 + len(values)][::factor]


def quantize(values: np.ndarray, bits: int, seed: int | None = None) -> np.ndarray:
    """Whole numbers of that many bits for values from -1 to 1, halves up, with triangular dither of a seed if there is one."""
    scaled = values * (1 << (bits - 1))
    if seed is not None:
        rng = np.random.default_rng(seed)
        scaled = scaled + rng.random(len(values)) - rng.random(len(values))
    return np.clip(np.floor(scaled + 0.5), -(1 << (bits - 1)), (1 << (bits - 1)) - 1).astype(np.int64)


def loudest(made: DataFrame) -> DataFrame:
    """The loudest fifth of each channel's blocks, one at least."""
    ranked = made.select("*", F.row_number().over(Window.partitionBy("track", "channel").orderBy(F.desc("rms"), "block")).alias("l"), F.count("*").over(Window.partitionBy("track", "channel")).alias("c"))
    return ranked.where(F.col("l") <= F.greatest(F.lit(1), F.floor(0.2 * F.col("c") + 0.5))).drop("l", "c")


def spectrum(samples: DataFrame, size: int = 4096, hop: int = 4096) -> DataFrame:
    """(track, bin, db) of rows (track, channel, idx, value): the power of a Hann window of ``size`` samples every ``hop`` ones,
    averaged over windows and channels, in decibels. A window that the samples don't fill is left out; a group is a window."""
    placed = samples.where(F.col("idx") % hop < size).withColumn("_frame", F.floor(F.col("idx") / hop))
    frames = placed.groupBy("track", "channel", "_frame").agg(F.array_sort(F.collect_list(F.struct("idx", "value"))).alias("s")).where(F.size("s") == size)
    power = power_spectrum(frames.select("track", F.col("s.value").alias("samples")))
    return power.groupBy("track", "bin").agg((10 * F.log10(F.avg("power") + 1e-30)).alias("db"))


def mapped(tracks: DataFrame, make) -> DataFrame:
    """(track, idx, value) of ``make``'s array for each row (track, samples: array)."""

    def run(batches):
        for batch in batches:
            for track, values in zip(batch.column("track").to_pylist(), batch.column("samples").to_pylist()):
                out = np.asarray(make(np.array(values or [], float)), float)
                yield pa.RecordBatch.from_pydict({"track": [track] * len(out), "idx": range(len(out)), "value": out}, schema=pa.schema([("track", pa.int64()), ("idx", pa.int64()), ("value", pa.float64())]))

    return tracks.select("track", F.col("samples").cast("array<double>")).mapInArrow(run, "track long, idx long, value double")
