"""Frames of tracks made from the relational test tables, so that the operators run at any scale without media files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The numbers that a track's id is made of, and what each counts.
_PARTS_OF_ID = {"l_orderkey": 10_000_000_000_000, "l_linenumber": 1_000_000_000_000, "l_partkey": 100_000, "l_suppkey": 1}


def _track_id(lines: DataFrame) -> Column:
    """The SQL's number: a bigint, or where that overflows for a line of the table, the same number as decimal(38,0)."""
    near = " or ".join(f"{c} not between {-(2**61 // unit)} and {2**61 // unit - 1}" for c, unit in _PARTS_OF_ID.items())
    narrow, *more = [f"try_multiply(cast({c} as bigint), {unit})" for c, unit in _PARTS_OF_ID.items()]
    for part in more:
        narrow = f"try_add({narrow}, {part})"
    known = " and ".join(f"{c} is not null" for c in _PARTS_OF_ID)
    # Without a part beyond a quarter of the range, which the files' statistics tell, no line is read for this.
    fits = lines.where(near).where(f"{known} and {narrow} is null").isEmpty()
    return F.expr(" + ".join(f"cast({c} as {'bigint' if fits else 'decimal(38,0)'}) * {unit}" for c, unit in _PARTS_OF_ID.items())).cast("bigint" if fits else "decimal(38,0)")


def album_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order is a folder and its lines are the tracks, with gaps, repeats and mixed values."""
    lines = table(spark, sf_dir, "lineitem")
    number = _track_id(lines)
    return lines.join(table(spark, sf_dir, "part"), F.expr("l_partkey = p_partkey")).select(
        number.alias("id"),
        F.expr("concat('/music/', l_orderkey)").alias("folder"),
        F.expr("concat('/music/', l_orderkey, '/', l_linenumber, '-', l_partkey, '-', l_suppkey, if(l_partkey % 5 = 0, '.mp3', '.flac'))").alias("path"),
        F.expr("cast(l_extendedprice * 100 as bigint)").alias("size"),
        F.expr("cast(l_suppkey as bigint) * 1000").alias("modified"),
        F.expr("if(l_partkey % 5 = 0, 'MP3', 'FLAC')").alias("format"),
        F.expr("l_partkey % 5 <> 0").alias("lossless"),
        F.expr("cast(case l_partkey % 4 when 0 then 96000 when 1 then 88200 when 2 then 48000 else 44100 end as int)").alias("sample_rate"),
        F.expr("cast(if(l_partkey % 5 = 0, 0, if(l_partkey % 3 = 0, 24, 16)) as int)").alias("bits"),
        F.expr("cast(2 + l_partkey % 9 as int)").alias("channels"),
        F.expr("cast(l_quantity * 10000 as bigint)").alias("duration_ms"),
        F.expr("cast(128 + l_partkey % 3 * 96 as int)").alias("bitrate"),
        F.expr("if(l_partkey % 11 = 0, null, p_name)").alias("title"),
        F.expr("if(l_partkey % 13 = 0, null, concat('Artist ', l_suppkey % 7, if(l_partkey % 6 = 0, ' feat. Guest', '')))").alias("artist"),
        F.expr("if(l_partkey % 7 = 0, null, p_type)").alias("album"),
        F.expr("if(l_partkey % 2 = 0, null, p_brand)").alias("album_artist"),
        F.expr("cast(if(l_partkey % 17 = 0, 0, l_linenumber) as int)").alias("track"),
        F.expr("cast(l_partkey % 4 * 3 as int)").alias("track_total"),
        F.expr("cast(l_suppkey % 2 as int)").alias("disc"),
        F.expr("cast(l_partkey % 3 as int)").alias("pictures"),
        F.expr("cast(l_partkey % 7 * 300000 as int)").alias("picture_bytes"),
        F.expr("cast(l_partkey % 5 * 500 as int)").alias("picture_w"),
        F.expr("cast(l_partkey % 6 * 400 as int)").alias("picture_h"),
        F.expr("cast(l_suppkey % 64 as int)").alias("issues"),
        F.expr("cast(l_partkey % 8 as int)").alias("accepted"),
        F.expr("cast(if(l_partkey % 10 = 0, 0, 1) as int)").alias("deep_version"),
        F.expr("if(l_discount = 0, null, cast(l_discount * 100 as double))").alias("dr"),
        F.expr("cast(l_partkey % 40 * 700 as int)").alias("cutoff_hz"),
        F.expr("cast(l_suppkey % 60 as double)").alias("ultrasonic_db"),
        F.expr("cast(l_suppkey % 25 as int)").alias("effective_bits"),
    )


#: The same frame for other engines.
ALBUM_TRACKS_SQL = """select l_orderkey * 10000000000000 + l_linenumber * 1000000000000 + l_partkey * 100000 + l_suppkey as id,
 '/music/' || l_orderkey as folder,
 '/music/' || l_orderkey || '/' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || if(l_partkey % 5 = 0, '.mp3', '.flac') as path,
 trunc(l_extendedprice * 100)::bigint as size, l_suppkey::bigint * 1000 as modified, if(l_partkey % 5 = 0, 'MP3', 'FLAC') as format, l_partkey % 5 <> 0 as lossless,
 (case l_partkey % 4 when 0 then 96000 when 1 then 88200 when 2 then 48000 else 44100 end)::int as sample_rate,
 if(l_partkey % 5 = 0, 0, if(l_partkey % 3 = 0, 24, 16))::int as bits, (2 + l_partkey % 9)::int as channels, trunc(l_quantity * 10000)::bigint as duration_ms,
 (128 + l_partkey % 3 * 96)::int as bitrate, if(l_partkey % 11 = 0, null, p_name) as title,
 if(l_partkey % 13 = 0, null, 'Artist ' || l_suppkey % 7 || if(l_partkey % 6 = 0, ' feat. Guest', '')) as artist,
 if(l_partkey % 7 = 0, null, p_type) as album, if(l_partkey % 2 = 0, null, p_brand) as album_artist, if(l_partkey % 17 = 0, 0, l_linenumber)::int as track,
 (l_partkey % 4 * 3)::int as track_total, (l_suppkey % 2)::int as disc, (l_partkey % 3)::int as pictures, (l_partkey % 7 * 300000)::int as picture_bytes,
 (l_partkey % 5 * 500)::int as picture_w, (l_partkey % 6 * 400)::int as picture_h, (l_suppkey % 64)::int as issues, (l_partkey % 8)::int as accepted,
 if(l_partkey % 10 = 0, 0, 1)::int as deep_version, if(l_discount = 0, null, l_discount * 100) as dr, (l_partkey % 40 * 700)::int as cutoff_hz,
 (l_suppkey % 60)::double as ultrasonic_db, (l_suppkey % 25)::int as effective_bits
 from lineitem join part on l_partkey = p_partkey"""


def document_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as tracks: equal texts are identical files."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.expr("concat('/', source, '/', lang, '/', doc_id, '.txt')").alias("path"), F.expr("concat('/', source, '/', lang)").alias("folder"),
        F.col("n_chars").alias("size"), F.expr("md5(cast(text as binary))").alias("hash"), F.col("source").alias("artist"), F.expr("substring(text, 1, 24)").alias("title"), F.expr("n_chars * 60").alias("duration_ms"),
    )


DOCUMENT_TRACKS_SQL = """select doc_id as id, '/' || source || '/' || lang || '/' || doc_id || '.txt' as path, '/' || source || '/' || lang as folder,
 n_chars as size, md5(text) as hash, source as artist, substring(text, 1, 24) as title, n_chars * 60 as duration_ms from documents"""
