"""Queries on spectra and samples, on changes of the store, and views, with their SQL. Embeddings stand for spectra of 64 bins."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from lodestone.catalog import _A, _BLOCKS, _FOLD, _KHZ, _OPEN, _S, _samples, add, on_albums, on_documents
from lodestone.functions import tracks as fn
from lodestone.operators import albums, changes, duplicates, signal
from lodestone.plans.bind import table

BINS = 64


def _spectrum(spark, d):
    """Levels that fall by 25 dB at a bin of the vector's own, so that there are walls."""
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("track"), F.posexplode("embedding").alias("bin", "x")).select("track", "bin", F.expr("cast(x as double) * 10 - if(bin > 30 + track % 40, 25, 0)").alias("db"))


def _p(hz: float) -> str:
    near, far = max(1, int(200 / hz + 0.5)), max(max(1, int(200 / hz + 0.5)) + 1, int(1200 / hz + 0.5))
    top = BINS - 1 - max(1, int(50 / hz + 0.5))
    half, low, high = max(1, int(60 / hz + 0.5)), int(200 / hz + 0.5), max(int(200 / hz + 0.5), int(4000 / hz + 0.5))
    first, last = max(int(10500 / hz + 0.5), far), top - max(near + 1, int(300 / hz + 0.5)) - near
    return f"""with p as (select vec_id as track, unnest(range(len(embedding)))::int as bin, unnest(embedding)::double as x from embeddings), q as (select track, bin, x * 10 - if(bin > 30 + track % 40, 25, 0) as db from p),
 s as (select track, bin, round(avg(db) over (partition by track order by bin rows between {half} preceding and {half} following), 6) as db from q), l as (select track, bin, db - max(db) filter (bin between {low} and {high}) over (partition by track) as level from s),
 e as (select track, bin, avg(level) over (partition by track order by bin rows between {far} preceding and {near} preceding) as below, avg(level) filter (bin <= {top}) over (partition by track order by bin rows between {near} following and {far} following) as above from l),
 w as (select track, first(struct_pack(bin := bin, d := round(below - above, 9), below := below, above := above) order by round(below - above, 9) desc, bin) as w from e where bin between {first} and {last} and round(below - above, 9) > 20 group by track),
 j as (select track, any_value(w) as w, max(level) filter (bin between w.bin + {near} and {top}) as later, min(bin) filter (bin between w.bin - {near} and least({top}, w.bin + {far}) and level < (w.below + w.above) / 2) as edge from l join w using (track) group by track)"""


add("sig_cliff", _p(345.0) + ' select track, coalesce(edge, w.bin) * 345.0::double as hz, round(w.d, 6) as "drop", round(w.below, 6) as below, round(w.above, 6) as above from j where later <= w.above + 15')(lambda spark, d: signal.cliffs(signal.levels(_spectrum(spark, d), 345.0), 345.0, BINS))
_span = lambda a, b: f"avg(level) filter (bin between {int(a / 750 + 0.5)} and {int(b / 750 + 0.5)})"
_ACROSS = _p(750.0) + f", a as (select track, round({_span(18050, 21050)} - {_span(23550, 26550)}, 6) as across_0, round({_span(20000, 23000)} - {_span(25500, 28500)}, 6) as across_1 from l group by track)"
add("sig_across", _ACROSS + " select * from a")(lambda spark, d: signal.across(signal.levels(_spectrum(spark, d), 750.0), 750.0, BINS, 22_050, 24_000))
add("sig_ultrasonic", _ACROSS + " select track, if(track % 2 = 0, greatest(across_0, across_1), 0.0) as ultrasonic_db from a")(
    lambda spark, d: signal.ultrasonic(signal.across(signal.levels(_spectrum(spark, d), 750.0), 750.0, BINS, 22_050, 24_000), table(spark, d, "embeddings").select(F.col("vec_id").alias("track"), F.expr("if(vec_id % 2 = 0, 96000, 44100)").alias("sample_rate")))
)
_FRAMES = "with f as (select label as track, vec_id as frame, embedding as n, lag(embedding) over (partition by label order by vec_id) as o from embeddings)"
add("sig_fingerprint", _FRAMES + " select track, frame, list_sum(list_transform(range(1, 33), lambda m: if((n[m]::double - n[m + 1]::double) - (o[m]::double - o[m + 1]::double) > 0, 1::bigint << (m - 1), 0::bigint)))::bigint as word from f where o is not null")(
    lambda spark, d: signal.words(table(spark, d, "embeddings").select(F.col("label").alias("track"), F.col("vec_id").alias("frame"), F.col("embedding").cast("array<double>").alias("bands")))
)
_FFT = """with p as (select vec_id as track, unnest(range(64)) as n, unnest(embedding)::double as x from embeddings), w as (select track, n, x * (0.5 - 0.5 * cos(2 * pi() * n / 64)) as x from p),
 f as (select track, k::int as bin, pow(sum(x * cos(2 * pi() * k * n / 64)), 2) + pow(sum(x * sin(2 * pi() * k * n / 64)), 2) as power from w, range(33) r(k) group by all)"""


def _fft(spark, d):
    return signal.power_spectrum(table(spark, d, "embeddings").select(F.col("vec_id").alias("track"), F.col("embedding").alias("samples")))


add("sig_fft", _FFT + " select track, bin, round(power, 6) as power from f")(lambda spark, d: _fft(spark, d).withColumn("power", F.round("power", 6)))
add("sig_spectrum_pack", _FFT + " select track, (bin * 11 // 33)::int as point, greatest(0, least(255, floor(round(20 - 10 * log10(avg(power) + 1e-30), 9) + 0.5)))::int as level from f group by all")(lambda spark, d: signal.packed(_fft(spark, d), 11, 33, 20.0))
add("ord_topk_loud", _BLOCKS + " select track, channel, block from (select *, row_number() over (partition by track, channel order by rms desc, block) as l, count(*) over (partition by track, channel) as c from b) where l <= greatest(1, floor(0.2 * c + 0.5))")(
    lambda spark, d: signal.loudest(signal.blocks(_samples(spark, d), 16, 5)).select("track", "channel", "block")
)
# Windows, filters and samples of other widths; a user's events are a track's samples
def _arrays(spark, d):
    return _samples(spark, d).groupBy("track").agg(F.array_sort(F.collect_list(F.struct("idx", "value"))).alias("s")).select("track", F.col("s.value").alias("samples"))


add("sig_spectrum", _S + """, w as (select track, channel, idx // 20 as frame, idx % 20 as n, value * (0.5 - 0.5 * cos(2 * pi() * (idx % 20) / 16)) as x, count(*) over (partition by track, channel, idx // 20) as c from s where idx % 20 < 16),
 f as (select track, frame, k::int as bin, pow(sum(x * cos(2 * pi() * k * n / 16)), 2) + pow(sum(x * sin(2 * pi() * k * n / 16)), 2) as power from w, range(9) r(k) where c = 16 group by all)
 select track, bin, round(10 * log10(avg(power) + 1e-30), 4) as db from f group by all""")(lambda spark, d: signal.spectrum(_samples(spark, d), 16, 20).withColumn("db", F.round("db", 4)))
_TAPS = """t as (select 31 as m, 4000.0 / 22050 as cut), u as (select i, 2 * cut * if(i * 2 = m - 1, 1, sin(pi() * 2 * cut * (i - (m - 1) / 2.0)) / (pi() * 2 * cut * if(i * 2 = m - 1, 1, i - (m - 1) / 2.0))) * (0.42 - 0.5 * cos(2 * pi() * i / (m - 1)) + 0.08 * cos(4 * pi() * i / (m - 1))) as x from t, range(31) r(i)),
 taps as (select i, x / sum(x) over () as x from u)"""
add("sig_lowpass", f"with {_TAPS} select i as tap, round(x, 9) as weight from taps")(lambda spark, d: spark.createDataFrame([(i, round(float(x), 9)) for i, x in enumerate(signal.sinc(max(9, int(5.5 * 22_050 / 4000) | 1), 4000 / 22_050))], "tap long, weight double"))
add("sig_decimate", f"{_S}, {_TAPS}, o as (select track, idx as p from s where idx % 2 = 0) select o.track, p // 2 as idx, round(sum(taps.x * s.value), 4) as value from o join s on s.track = o.track and s.idx between p - 15 and p + 15 join taps on taps.i = p + 15 - s.idx group by o.track, p")(
    lambda spark, d: signal.mapped(_arrays(spark, d), lambda x: signal.decimate(x[:, None], 22_050)).withColumn("value", F.round("value", 4))
)
add("sig_quantize", _S + " select track, idx, greatest(-128, least(127, floor(value / 6000.0 * 128 + 0.5)))::double as value from s")(lambda spark, d: signal.mapped(_arrays(spark, d), lambda x: signal.quantize(x / 6000, 8)))
add("sig_resample")(lambda spark, d: signal.mapped(_arrays(spark, d), lambda x: signal.resample(x, 2)).withColumn("value", F.round("value", 4)))
on_documents("inc_sample_hash", ", c as (select id, substring(repeat(hash, 20), 1, (20 + id % 600)::bigint) as t from track), n as (select id, t, length(t) as n from c) select id, md5(substring(t, 1, 64) || substring(t, greatest(n // 2 - 32, 0) + 1, 64) || substring(t, greatest(n - 64, 0) + 1, 64)) as sample from n",
    lambda t: t.select("id", F.expr("cast(substring(repeat(hash, 20), 1, int(20 + id % 600)) as binary)").alias("c")).select("id", changes.sample_hash(F.col("c"), 64).alias("sample")))

def _replaced(spark, d):
    """A table of cover folders that is written and then replaced."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    path, new = f"{root.rstrip('/')}/folders-{uuid.uuid4().hex}", table(spark, d, "orders").select(F.expr("concat('/music/', o_orderkey)").alias("folder"), F.expr("if(o_orderkey % 3 = 0, 'cover.jpg', null)").alias("cover"))
    changes.replace_table(new.where("cover is null"), path)
    return changes.replace_table(new, path)


add("sink_replace_table", "select '/music/' || o_orderkey as folder, if(o_orderkey % 3 = 0, 'cover.jpg', null) as cover from orders")(_replaced)
# Changes of the store
on_documents("sink_header_update", "select id, path, if(id % 4 = 0, 'new ' || title, title) as title, if(id % 4 = 0, null, hash) as hash from track", lambda t: changes.header_update(t.select("id", "path", "title", "hash"), t.where("id % 4 = 0").select("id", F.concat(F.lit("new "), F.col("title")).alias("title")), ["title"]))
on_albums("sink_deep_update", "select id, if(cutoff_hz % 3 = 0, if(cutoff_hz = 0, null, cutoff_hz::double), dr) as dr from (select distinct id, cutoff_hz, max(dr) over (partition by id) as dr from track)",
    lambda t: changes.deep_update(t.groupBy("id").agg(F.max("dr").alias("dr")), t.where("cutoff_hz % 3 = 0").select("id", F.expr("if(cutoff_hz = 0, double('nan'), double(cutoff_hz))").alias("dr")).distinct(), ["dr"]))
on_documents("sink_hash_update", "select id, if(id % 5 = 0, upper(hash), hash) as hash from track", lambda t: changes.deep_update(t.select("id", "hash"), t.where("id % 5 = 0").select("id", F.upper("hash").alias("hash")), ["hash"]))
on_documents("sink_quarantine_add", "select id, path as original, '/.aside/9' || path as moved, size, 0 as kind from track where id % 6 = 0", lambda t: changes.quarantine(t.where("id % 6 = 0"), F.lit(9), 0).select("id", "original", "moved", "size", "kind"))
on_documents("sink_restore", "select id, if(id % 12 = 0, path, if(id % 6 = 0, '/.aside/9' || path, path)) as path from track", lambda t: changes.restore(t.withColumn("path", F.expr("if(id % 6 = 0, concat('/.aside/9', path), path)")).select("id", "path"), changes.quarantine(t.where("id % 12 = 0"), F.lit(9), 3)))
on_documents("sink_empty", "select id from track where id % 6 <> 0", lambda t: changes.emptied(t.withColumn("path", F.expr("if(id % 6 = 0, concat('/.aside/9', path), path)")), changes.quarantine(t.where("id % 6 = 0"), F.lit(9), 3)).select("id"))
on_documents("sink_migrate", "select id, 0 as accepted, hash from track", lambda t: changes.migrate(t.select("id", "hash"), {"accepted": 0, "hash": ""}))
# Views and labels
on_albums("agg_badges", _OPEN + ", t as (select folder, count(*) as n from track group by folder), r as (select open.folder, issue, if(open = n, 'all', open::varchar) as count, row_number() over (partition by open.folder order by bit) as place from open join t using (folder) join i using (issue)) select folder, issue, count from r where place <= 3",
    lambda t: albums.badges(t))
on_albums("ord_albums", "select distinct folder, row_number() over (order by lower(a), lower(t), folder) as place from (select folder, coalesce(min(album_artist), '') as a, coalesce(min(album), '') as t from track group by folder)",
    lambda t: albums.by_artist(t.groupBy("folder").agg(F.coalesce(F.min("album_artist"), F.lit("")).alias("artist"), F.coalesce(F.min("album"), F.lit("")).alias("title"))))
on_albums("cls_md5_match", "select id, case when title is null then -1 when title = 'x' or id % 3 = 0 then 1 else 0 end as m from track", lambda t: t.select("id", fn.md5_match(F.col("title"), F.expr("if(id % 3 = 0, title, 'none')")).alias("m")))
_FORMATS = "['FLAC', 'WAV', 'AIFF', 'MP3', 'AAC', 'ALAC', 'OGG', 'OPUS', 'M4A', 'DSF', 'WV']"
on_albums("cls_route", f"select id, case when f = 'FLAC' then 'flac' when f in ('WAV', 'AIFF') then 'pcm' when f in ('MP3', 'AAC', 'ALAC', 'OGG', 'OPUS') then 'codec' end as route from (select id, {_FORMATS}[(id % 11 + 1)::int] as f from track)", lambda t: t.select("id", fn.route(F.expr(f"element_at(array({_FORMATS[1:-1]}), int(id % 11 + 1))")).alias("route")))
on_albums("fn_ago_label", "select id, case when m < 1 then 'just now' when m < 60 then m || ' min' when m < 2880 then (m // 60) || ' h' else (m // 1440) || ' days' end as label from (select id, size // 60000 as m from track)", lambda t: t.select("id", fn.ago_label(F.col("size")).alias("label")))
on_albums("inc_progress_eta", "select id, if(duration_ms < 20000 or modified = 0, null, size * duration_ms // modified) as eta from track", lambda t: t.select("id", fn.eta(F.col("modified"), F.col("size"), F.col("duration_ms")).alias("eta")))
on_albums("view_actions", "select id, (issues & ~accepted & 62) <> 0 as open, (issues & accepted & 62) <> 0 as kept from track where issues & 62 <> 0", lambda t: t.where(fn.has(fn.FAKES)).select("id", fn.has(fn.FAKES, fn.open_mask()).alias("open"), (F.expr("issues & accepted & 62") != 0).alias("kept")))
on_albums("join_album_copy", """, n as (select folder, lower(max(album)) as t, lower(max(album_artist)) as a from track group by folder), c as (select t, a, min(folder) as one, max(folder) as last from n where t is not null and a is not null group by t, a having count(*) > 1)
 select folder, if(folder = one, last, one) as copy from n join c using (t, a)""", lambda t: albums.copies(t))  # fmt: skip
