"""Equal recordings by fingerprint: exact words are looked up first, and only pairs that share words at one offset are
compared bit by bit. Fingerprints are rows (track, frame, word), words as long with 32 bits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Every third frame is looked up, at most 65 entries a word, two votes, 100 frames in common, a quarter of bits.
STRIDE, ENTRIES, VOTES, OVERLAP, SAME = 3, 65, 2, 100, 0.25
FULL = 0xFFFFFFFF


def close_length(a: Column, b: Column) -> Column:
    apart = F.abs(a - b)
    return (apart <= 3000) | (apart <= F.floor(F.greatest(a, b) / 50))


def prints(frames: DataFrame) -> DataFrame:
    """(track, print): the words of a track in order."""
    return frames.groupBy("track").agg(F.transform(F.array_sort(F.collect_list(F.struct("frame", "word"))), lambda x: x["word"]).alias("print"))


def error_rate(a: Column, b: Column, offset: Column) -> Column:
    """Share of differing bits of b, shifted by the offset, against a; 1 where fewer than 100 frames overlap."""
    start = F.greatest(F.lit(0), -offset)
    n = F.least(F.size(a), F.size(b) - offset) - start
    bits = F.zip_with(F.slice(a, start + 1, n), F.slice(b, start + offset + 1, n), lambda x, y: F.bit_count(x.bitwiseXOR(y).bitwiseAND(F.lit(FULL))))
    return F.when(n >= OVERLAP, F.aggregate(bits, F.lit(0).cast("long"), lambda s, x: s + x) / (32.0 * n)).otherwise(F.lit(1.0))


def rates(pairs: DataFrame, printed: DataFrame) -> DataFrame:
    """(a, b, offset, ber) of each row (a, b, offset)."""
    one, two = printed.select(F.col("track").alias("a"), F.col("print").alias("pa")), printed.select(F.col("track").alias("b"), F.col("print").alias("pb"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "offset", error_rate(F.col("pa"), F.col("pb"), F.col("offset")).alias("ber"))


def best_rates(pairs: DataFrame, printed: DataFrame, radius: int) -> DataFrame:
    """(a, b, offset, ber): the least rate within the radius of each pair's offset, the first one of equals. The prints
    are joined once and all shifts are tried in one expression."""
    one, two = printed.select(F.col("track").alias("a"), F.col("print").alias("pa")), printed.select(F.col("track").alias("b"), F.col("print").alias("pb"))
    tried = F.array_min(F.transform(F.sequence(F.col("offset") - radius, F.col("offset") + radius), lambda o: F.struct(error_rate(F.col("pa"), F.col("pb"), o).alias("ber"), o.alias("offset"))))
    found = pairs.join(one, "a").join(two, "b").select("a", "b", F.col("offset").alias("_around"), tried.alias("m"))
    return found.select("a", "b", F.when(F.col("m.ber") < 1, F.col("m.offset")).otherwise(F.col("_around")).alias("offset"), F.col("m.ber").alias("ber"))


def candidates(frames: DataFrame, lengths: DataFrame) -> DataFrame:
    """(a, b, offset): pairs with two votes or more for one offset, and the offset with most votes, the least of equals.

    The entries of a word are the first 65 by track and frame, by definition; Spark cuts them before the shuffle. The
    other side of a frequent word only meets those 65."""
    real = frames.where(f"word <> 0 and word <> {FULL}")
    order = Window.partitionBy("word").orderBy("track", "frame")
    index = real.where(f"frame % {STRIDE} = 0").select("word", "track", "frame", F.row_number().over(order).alias("n")).where(f"n <= {ENTRIES}").select("word", F.col("track").alias("b"), F.col("frame").alias("fb"))
    hits = real.select("word", F.col("track").alias("a"), F.col("frame").alias("fa")).join(index, "word").where("b > a")
    votes = hits.groupBy("a", "b", (F.col("fb") - F.col("fa")).cast("int").alias("offset")).agg(F.count("*").alias("votes")).where(f"votes >= {VOTES}")
    best = votes.groupBy("a", "b").agg(F.max_by("offset", F.struct("votes", -F.col("offset"))).alias("offset"))
    ms = lambda side: lengths.select(F.col("track").alias(side), F.col("duration_ms").alias(f"{side}_ms"))
    return best.join(ms("a"), "a").join(ms("b"), "b").where(close_length(F.col("a_ms"), F.col("b_ms"))).select("a", "b", "offset")


def same_recording(frames: DataFrame, lengths: DataFrame) -> DataFrame:
    """(a, b, offset, ber) of tracks of one recording."""
    return best_rates(candidates(frames, lengths), prints(frames), 2).where(f"ber < {SAME}")
