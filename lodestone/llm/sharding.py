"""Reproducible shuffle and sharding: a Feistel permutation with cycle walking over global row numbers.

Rows are numbered without gaps in the order of (bucket, key, checksum, size), where the bucket is a hash. The number goes
through a keyed permutation of [0, n); the result modulo the number of shards is the shard, the quotient the slot. So
shard and slot of any row number can be computed alone, and the row numbers of any shard by the inverse.
"""

from __future__ import annotations

import math
import struct

import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Hash buckets for numbering: their counts, so many numbers at most, go to the driver. Rounds of the permutation.
BUCKETS, ROUNDS = 4096, 6
#: Walks of a row that is out of range; at one chance in sqrt(n) each, more would show a fault, and raise.
WALKS = 64


def sides(n: int) -> tuple[int, int]:
    """The two moduli of a domain that holds n numbers and less than sqrt(n) + 1 more."""
    a = max(1, math.isqrt(max(0, n - 1)) + 1)
    return a, max(1, -(-n // a))


def _key(seed: int, turn: int) -> int:
    return seed * 1000003 + turn


def permute(row: int, n: int, seed: int = 0) -> int:
    """Where the row number goes, computed alone."""
    a, b = sides(n)
    while True:
        left, right = divmod(row, b)
        for turn in range(ROUNDS):
            if turn % 2:
                right = (right + _mix(left, _key(seed, turn), b)) % b
            else:
                left = (left + _mix(right, _key(seed, turn), a)) % a
        row = left * b + right
        if row < n:
            return row


def invert(position: int, n: int, seed: int = 0) -> int:
    """The row number that goes to this position."""
    a, b = sides(n)
    while True:
        left, right = divmod(position, b)
        for turn in reversed(range(ROUNDS)):
            if turn % 2:
                right = (right - _mix(left, _key(seed, turn), b)) % b
            else:
                left = (left - _mix(right, _key(seed, turn), a)) % a
        position = left * b + right
        if position < n:
            return position


def _mix(value: int, key: int, modulus: int) -> int:
    first = xxhash.xxh64_intdigest(struct.pack("<q", value), 42)
    full = xxhash.xxh64_intdigest(struct.pack("<q", key), first)
    return (full - (1 << 64) if full >> 63 else full) % modulus


def _mixed(value: Column, key: Column, modulus: int) -> Column:
    return F.pmod(F.xxhash64(value, key), F.lit(modulus).cast("long"))


def _walked(x: Column, n: int, seed: int) -> Column:
    """x itself where it is in range, else the first number in range that the permutation leads it to."""
    a, b = sides(n)

    def turn(state: Column, i: Column) -> Column:
        key = F.lit(seed * 1000003).cast("long") + i
        moved = (state["r"] + _mixed(state["l"], key, b)) % b
        return F.when(i % 2 == 1, F.struct(state["l"].alias("l"), moved.alias("r"))).otherwise(F.struct(((state["l"] + _mixed(state["r"], key, a)) % a).alias("l"), state["r"].alias("r")))

    def walk(at: Column, _: Column) -> Column:
        start = F.struct(F.floor(at / F.lit(b)).cast("long").alias("l"), F.pmod(at, F.lit(b).cast("long")).alias("r")) if b > 1 else F.struct(at.alias("l"), F.expr("0L").alias("r"))
        rounds = F.sequence(F.lit(0).cast("long"), F.lit(ROUNDS - 1).cast("long"))
        return F.when(at < n, at).otherwise(F.aggregate(rounds, start, turn, lambda s: s["l"] * b + s["r"]))

    far = F.aggregate(F.sequence(F.lit(1), F.lit(WALKS)), x, walk)
    far = F.when(far < n, far).otherwise(F.raise_error(F.lit("the permutation did not come back into range")).cast("long"))
    return F.when(x < n, x).otherwise(far)


def shard(df: DataFrame, shards: int, key: str = "doc_id", text: str = "text", seed: int = 0) -> DataFrame:
    """(key, size, text_crc32, row, position, shard, slot) for every row; counts of shards differ by one at most, and
    slots have no gaps.

    The size is the text's UTF-8 bytes plus 1; a null text counts as none. A null key sorts first. Rows that are equal
    in key, checksum and size take any of their numbers, so the table of results is the same. Other columns aren't
    carried. An empty table gives an empty one. Of the rows only key, size and checksum are shuffled, once."""
    value = F.coalesce(F.col(text), F.lit(""))
    slim = df.select(F.col(key).alias("_key"), (F.octet_length(value).cast("long") + 1).alias("_size"), F.crc32(value.cast("binary")).alias("_crc"))
    slim = slim.withColumn("_bucket", F.coalesce(F.pmod(F.xxhash64("_key", "_crc", "_size"), F.lit(BUCKETS)).cast("int"), F.lit(0)))
    counts = {r["_bucket"]: r["count"] for r in slim.groupBy("_bucket").count().collect()}
    starts, n = [], 0
    for bucket in sorted(counts):
        starts.append((bucket, n))
        n += counts[bucket]
    a, b = sides(n)
    bases = df.sparkSession.createDataFrame(starts, "_bucket int, _base long")
    order = Window.partitionBy("_bucket").orderBy("_key", "_crc", "_size")
    at = slim.withColumn("_nth", F.row_number().over(order)).join(F.broadcast(bases), "_bucket")
    at = at.select("_key", "_size", "_crc", (F.col("_base") + F.col("_nth") - 1).alias("row"))
    at = at.select("*", F.expr(f"row div {b}").alias("_l"), (F.col("row") % b).alias("_r"))
    for turn in range(ROUNDS):
        secret = F.lit(_key(seed, turn)).cast("long")
        if turn % 2:
            at = at.select("_key", "_size", "_crc", "row", "_l", ((F.col("_r") + _mixed(F.col("_l"), secret, b)) % b).alias("_r"))
        else:
            at = at.select("_key", "_size", "_crc", "row", ((F.col("_l") + _mixed(F.col("_r"), secret, a)) % a).alias("_l"), "_r")
    at = at.select("_key", "_size", "_crc", "row", (F.col("_l") * b + F.col("_r")).alias("_x"))
    at = at.select("_key", "_size", "_crc", "row", _walked(F.col("_x"), n, seed).alias("position"))
    return at.select(
        F.col("_key").alias(key), F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"), "row", "position",
        (F.col("position") % shards).cast("int").alias("shard"), F.expr(f"position div {shards}").alias("slot"),
    )
