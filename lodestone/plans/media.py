"""Queries on files: each part gives the numbers for a small file of a format, which the parser reads back."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from lodestone.catalog import add
from lodestone.functions import tracks as fn
from lodestone.plans.bind import table
from lodestone.sources import flac, made, media

_NUMBERS = {
    "id": "p_partkey", "rate": "cast(case p_partkey % 3 when 0 then 44100 when 1 then 48000 else 32000 end as int)", "bits": "cast(if(p_partkey % 2 = 0, 16, 24) as int)",
    "channels": "cast(1 + p_partkey % 2 as int)", "samples": "cast(p_size as int) * 1152", "title": "p_name",
}
_MADE = ", ".join(f"{x} as {n}" for n, x in _NUMBERS.items())
_FIELDS = "path, sample_rate, bits, channels, samples, duration_ms, tags['TITLE'] as title, pictures, picture_w, error"


def _files(spark, d, kind):
    return made.files(table(spark, d, "part").select(*[F.expr(x).alias(n) for n, x in _NUMBERS.items()]), kind)


def _register(name: str, kind: str, bits: str = "bits", samples: str = "samples", title: str = "title", pictures: int = 0, width: int = 0):
    add(name, f"""with m as (select {_MADE} from part) select '/' || id || '.{kind}' as path, rate as sample_rate, ({bits})::int as bits, channels, ({samples})::bigint as samples, (({samples}) * 1000 // rate)::bigint as duration_ms, {title} as title,
     {pictures} as pictures, {width} as picture_w, null::varchar as error from m""")(lambda spark, d: media.probe_content(_files(spark, d, kind)).selectExpr(*_FIELDS.split(", ")))


_register("src_flac_head", "flac", pictures=1, width=600)
_register("src_mp3_head", "mp3", bits="0", pictures=1, width=300)
_register("src_wav_aiff", "wav")
_register("src_aiff", "aiff")
_register("src_dsd", "dsf", bits="1")
_register("src_dff", "dff", bits="1", title="null::varchar")
_register("src_monkey", "ape")
_register("src_wavpack", "wv")


def _sound(spark, d):
    """(path, content) of a short FLAC file for each part: sample i of channel c is (i * (7 + id % 5) + c * 31) % 201 - 100."""

    def rows(given):
        i, n = np.arange(given["n"])[:, None], np.arange(given["channels"])
        values = (i * (7 + given["id"] % 5) + n * 31) % 201 - 100
        yield {"path": f"/{given['id']}.flac", "content": flac.encode(values, given["bits"], given["rate"], block=96)}

    wanted = table(spark, d, "part").select(*[F.expr(_NUMBERS[n]).alias(n) for n in ("id", "rate", "bits", "channels")], F.expr("cast(100 + p_size * 7 as int)").alias("n"))
    return media._mapped(wanted, "path string, content binary", rows)


_SOUND = "p as (select p_partkey as id, 100 + p_size * 7 as n, 1 + p_partkey % 2 as channels from part), v as (select id, c, i, (i * (7 + id % 5) + c * 31) % 201 - 100 as x from (select id, n, c, unnest(range(n)) as i from (select id, n, unnest(range(channels)) as c from p)))"
add("src_flac_decode", f"with {_SOUND} select '/' || id || '.flac' as path, c::int as channel, count(*) as samples, sum(x)::bigint as total, sum(x * (i % 13))::bigint as weighted from v group by all")(
    lambda spark, d: flac.samples(_sound(spark, d)).select("path", "channel", "start", F.posexplode("values").alias("at", "x")).groupBy("path", "channel").agg(F.count("*").alias("samples"), F.sum("x").alias("total"), F.sum(F.expr("x * ((start + at) % 13)")).alias("weighted"))
)
add("sig_md5", "with p as (select p_partkey as id, 100 + p_size * 7 as n from part) select '/' || id || '.flac' as path, 0 as frame_errors, n::bigint as decoded_samples, 1 as md5_match, false as damaged from p")(
    lambda spark, d: flac.listen(_sound(spark, d)).withColumnRenamed("error", "deep_error").select("path", "frame_errors", "decoded_samples", "md5_match", fn.damaged().alias("damaged"))
)
