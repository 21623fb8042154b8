"""All registered queries outside the llm subpackage, and their SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.functions import tracks as fn
from lodestone.operators import albums, changes, duplicates, signal
from lodestone.sources import media
from lodestone.plans.bind import ALBUM_TRACKS_SQL, DOCUMENT_TRACKS_SQL, album_tracks, document_tracks, table

QUERIES: dict = {}
ORACLE_SQL: dict = {}

_A, _D = f"with track as ({ALBUM_TRACKS_SQL})", f"with track as ({DOCUMENT_TRACKS_SQL})"
_FOLD = "regexp_replace(regexp_replace(lower({0}), '[^\\p{{L}}\\p{{Nd}}]', '', 'g'), '[\\x{{10000}}-\\x{{10FFFF}}]', '', 'g')"
_KHZ = "case when sample_rate <= 0 then '?' when sample_rate % 1000 = 0 then (sample_rate // 1000)::varchar else printf('%.1f', sample_rate / 1000.0) end"
_QUALITY = f"case when lossless and bits > 0 then format || ' ' || bits || '/' || {_KHZ} when lossless then format || ' ' || {_KHZ} when bitrate > 0 then format || ' ' || bitrate else format end"
_TENTHS = "({0} + {1} // 2) // {1} // 10 || '.' || ({0} + {1} // 2) // {1} % 10"
_SIZE = f"case when {{0}} >= 1000000000 then {_TENTHS.replace('{1}', '100000000')} || ' GB' when {{0}} >= 1000000 then {_TENTHS.replace('{1}', '100000')} || ' MB' else" \
    " ({0} // 1000) || ' KB' end"
_ISSUES = " union all ".join(f"select '{n}' as issue, {b} as bit" for n, b in fn.ISSUES.items())


def _covers(spark, d):
    """Folders with an image of their own: every third order."""
    return table(spark, d, "orders").where("o_orderkey % 3 = 0").select(F.expr("concat('/music/', o_orderkey)").alias("folder"))


_COVERS = "select '/music/' || o_orderkey as folder from orders where o_orderkey % 3 = 0"


def _titled(spark, d):
    """Some tracks without an artist, some with a fingerprint."""
    return document_tracks(spark, d).withColumn("artist", F.expr("if(id % 17 = 0, null, artist)")).withColumn("printed", F.expr("id % 3 = 0"))


def _edges(spark, d):
    t = _titled(spark, d)
    return duplicates.union_edges(duplicates.star(t, ["hash", "size"], duplicates.IDENTICAL), duplicates.same_title(t))


_EDGES = f"""{_D}, h as (select id, min(id) over (partition by hash, size) as a from track), t as (select id, duration_ms, id % 3 = 0 as printed, {_FOLD.format("artist")} as ak, {_FOLD.format("title")} as tk from track where id % 17 <> 0 and title is not null),
 s as (select ak, tk from t group by ak, tk having count(*) between 2 and 12), n as (select t.* from t join s using (ak, tk)),
 identical as (select a, id as b, 0 as kind from h where id <> a), titled as (select x.id as a, y.id as b, 3 as kind from n x join n y on x.ak = y.ak and x.tk = y.tk and x.id < y.id and abs(x.duration_ms - y.duration_ms) <= 2000 and not (x.printed and y.printed)),
 edge as (select least(a, b) as a, greatest(a, b) as b, min(kind) as kind from (select * from identical union all select * from titled) group by all)"""
_PARTS = (
    _EDGES.replace("with track", "with recursive track", 1)
    + """, link as (select a, b from edge union select b, a from edge), reach as (select a as id, a as o from link union select r.id, l.b from reach r join link l on l.a = r.o), part as (select id, min(o) as root from reach group by id)"""
)


def _samples(spark, d):
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").select(F.col("user_id").alias("track"), F.lit(0).alias("channel"), (F.row_number().over(order) - 1).cast("long").alias("idx"), F.round(F.col("value") * 100).cast("long").alias("value"))


_S = "with s as (select user_id as track, 0 as channel, row_number() over (partition by user_id order by ts, event_id) - 1 as idx, round(value * 100)::bigint as value from events)"
_BLOCKS = _S + ", b as (select track, channel, idx // 16 as block, count(*) as n, sqrt(2.0 * sum(value * value)::double / count(*)) as rms, max(abs(value)) as peak from s group by all having count(*) >= 5)"


def _spectrum(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("track"), F.posexplode("embedding").alias("bin", "db")).withColumn("db", F.col("db").cast("double"))


_SPECTRUM = "with p as (select vec_id as track, unnest(range(len(embedding))) as bin, unnest(embedding)::double as db from embeddings)"


def add(name: str, sql: str | None = None):
    def put(query):
        QUERIES[name] = query
        if sql is not None:
            ORACLE_SQL[name] = sql
        return query

    return put


def on_albums(name: str, sql: str, make):
    add(name, f"{_A} {sql}")(lambda spark, d: make(album_tracks(spark, d)))


def on_documents(name: str, sql: str, make):
    add(name, f"{_D} {sql}")(lambda spark, d: make(document_tracks(spark, d)))


# Sources
_ENDINGS = "['flac', 'MP3', 'wav', 'aif', 'aiff', 'aifc', 'dsf', 'dff', 'ape', 'wv', 'm4a', 'mp4', 'aac', 'alac', 'ogg', 'oga', 'Opus', 'wma', 'txt', 'jpg', 'flac~', 'mka', 'cue']"
on_albums("src_ext_filter", f"""select id, path from (select id, path || '.' || {_ENDINGS}[(id % 23 + 1)::int] as path from track) where regexp_extract(lower(path), '[^.]+$') in
 ('flac', 'mp3', 'wav', 'aif', 'aiff', 'aifc', 'dsf', 'dff', 'ape', 'wv', 'm4a', 'mp4', 'aac', 'alac', 'ogg', 'oga', 'opus')""", lambda t: t.select("id", F.expr(f"concat(path, '.', element_at(array({_ENDINGS[1:-1]}), int(id % 23 + 1)))").alias("path")).where(fn.extension().isin(fn.EXTENSIONS)))
on_albums("src_table_scan", "select id, path, size, issues from track where deep_version > 0", lambda t: t.where("deep_version > 0").select("id", "path", "size", "issues"))
on_albums("src_point_lookup", "select id, path from track where folder = '/music/7'", lambda t: t.where("folder = '/music/7'").select("id", "path"))
_FILES = "concat(folder, '/', case id % 9 when 0 then 'Folder.JPG' when 1 then 'zz cover.png' when 2 then 'back.webp' when 3 then '.cover.jpg' when 4 then 'cover-2.gif' when 5 then 'notes.txt' when 6 then 'inlay.bmp' else concat(id, if(id % 2 = 0, '.flac', '.mp3')) end)"
on_albums("src_folder_cover", f""", f as (select folder, regexp_extract(p, '[^/]*$') as name from (select folder, {_FILES} as p from track)), e as (select folder, name, lower(regexp_extract(name, '[^.]*$')) as ending from f where name not like '.%')
 select folder, coalesce(max(name) filter (ending in ('jpg', 'jpeg', 'png', 'webp', 'bmp', 'gif') and regexp_matches(lower(name), '^(cover|folder|front|album)')), min(name) filter (ending in ('jpg', 'jpeg', 'png', 'webp', 'bmp', 'gif'))) as cover
 from e group by folder having count(*) filter (ending in ('flac', 'mp3')) > 0""", lambda t: media.covers(t.select(F.expr(_FILES).alias("path"))))
# Scalar functions
on_albums("fn_path_parts", "select id, regexp_extract(path, '[^/]*$') as name, regexp_replace(path, '/[^/]*$', '') as folder from track", lambda t: t.select("id", fn.file_name().alias("name"), F.regexp_replace("path", "/[^/]*$", "").alias("folder")))
on_documents("fn_norm_key", f"select id, {_FOLD.format('title')} as key from track", lambda t: t.select("id", fn.norm_key(F.col("title")).alias("key")))
on_albums("fn_quality", f"select id, {_QUALITY} as quality from track", lambda t: t.select("id", fn.quality().alias("quality")))
on_albums("fn_khz", f"select id, {_KHZ} as khz from track", lambda t: t.select("id", fn.khz(F.col("sample_rate")).alias("khz")))
on_albums("fn_size_label", f"select folder, {_SIZE.format('s')} as label from (select folder, sum(size)::bigint * 100 as s from track group by folder)", lambda t: t.groupBy("folder").agg((F.sum("size") * 100).alias("s")).select("folder", fn.size_label(F.col("s")).alias("label")))
on_albums("fn_plural", "select folder, count(*) || ' track' || if(count(*) = 1, '', 's') as label from track group by folder", lambda t: t.groupBy("folder").agg(F.count("*").alias("n")).select("folder", fn.plural(F.col("n"), "track").alias("label")))
on_albums("fn_duration_label", "select id, case when s >= 3600 then printf('%d:%02d:%02d', s // 3600, s % 3600 // 60, s % 60) else printf('%d:%02d', s // 60, s % 60) end as label from (select id, duration_ms * 20 // 1000 as s from track)", lambda t: t.select("id", fn.duration_label(F.col("duration_ms") * 20).alias("label")))
on_albums("fn_bitrate", "select id, if(duration_ms > 0, size * 8 // duration_ms, 0) as kbps from track", lambda t: t.select("id", fn.kbps(F.col("size"), F.col("duration_ms")).alias("kbps")))
on_albums("fn_flags", f"select id, issues & ~accepted as open, list_aggregate(list_transform(list_filter([{', '.join(f'struct_pack(n := {n!r}, b := {b})' for n, b in fn.ISSUES.items())}], lambda x: issues & x.b <> 0), lambda x: x.n), 'string_agg', ',') as names from track", lambda t: t.select("id", fn.open_mask().alias("open"), F.nullif(F.concat_ws(",", *[F.when(fn.has(b), F.lit(n)) for n, b in fn.ISSUES.items()]), F.lit("")).alias("names")))
on_albums("fn_like_bitrate", "select id, case when cutoff_hz <= 11500 then 'up to 64' when cutoff_hz <= 15500 then '96-112' when cutoff_hz <= 17200 then '128' when cutoff_hz <= 18200 then '160' when cutoff_hz <= 19200 then '192' else '256-320' end as kbps from track", lambda t: t.select("id", fn.like_bitrate(F.col("cutoff_hz")).alias("kbps")))
on_documents("fn_path_score", "select id, -1000 * len(regexp_extract_all(p, '(?i)(\\(\\d+\\)|\\bcopy\\b|копия|/download|/telegram|/tmp/|/temp/)')) - length(p) as score from (select id, path || if(id % 3 = 0, ' (1)', '') || if(id % 5 = 0, ' copy', '') as p from track)", lambda t: t.select("id", F.expr("concat(path, if(id % 3 = 0, ' (1)', ''), if(id % 5 = 0, ' copy', ''))").alias("path")).select("id", fn.path_score().cast("long").alias("score")))
on_albums("fn_lead_artist", "select id, regexp_replace(artist, ' feat. Guest$', '') as lead from track", lambda t: t.select("id", fn.lead_artist(F.col("artist")).alias("lead")))
on_albums("fn_number_pair", "select id, track as number, track_total as total from track", lambda t: t.select("id", *[c.alias(n) for c, n in zip(fn.number_pair(F.expr("concat(lpad(track, 2, '0'), '/', track_total)")), ("number", "total"))]))
on_albums("fn_prefix_match", "select id from track where starts_with(path, '/music/1') and starts_with(path, '/music/11/')", lambda t: t.where(F.col("path").startswith("/music/11/")).select("id"))
on_documents("fn_hex", "select id, hash, upper(hash) as packed from track", lambda t: t.select("id", F.lower(F.hex(F.unhex("hash"))).alias("hash"), F.hex(F.unhex("hash")).alias("packed")))

# Classification
_FOUND = """if(issues & 1 <> 0, 1, 0) + if(lossless and cutoff_hz between 1 and 19000, 2, 0) + if(lossless and cutoff_hz between 19001 and 20600, 4, 0)
 + if(lossless and sample_rate >= 88200 and (cutoff_hz between 1 and 24500 or ultrasonic_db >= 40), 8, 0) + if(lossless and bits >= 24 and effective_bits between 1 and 16, 16, 0) + if(not lossless and bitrate >= 256 and cutoff_hz between 1 and 17000, 32, 0)"""
on_albums("cls_issues", f"select id, {_FOUND} as found from track", lambda t: t.select("id", fn.found_issues(fn.has(fn.DAMAGED)).alias("found")))
_CLASS = "case when not lossless then 0 when issues & 2 <> 0 then 1 when issues & 4 <> 0 then 2 else 3 end"
_RESOLUTION = "case when not lossless then if(issues & 32 <> 0, 128, bitrate)::bigint else if(issues & 8 <> 0, least(sample_rate, 44100), sample_rate)::bigint * if(issues & 24 <> 0, least(bits, 16), greatest(bits, 1)) end"
on_albums("grp_source_class", f"select id, {_CLASS} as class from track", lambda t: t.select("id", fn.source_class().alias("class")))
on_albums("grp_resolution", f"select id, {_RESOLUTION} as resolution from track", lambda t: t.select("id", fn.resolution().alias("resolution")))
on_albums("cls_shrink_target", """, n as (select *, case when sample_rate % 44100 = 0 then 44100 when sample_rate % 48000 = 0 then 48000 else sample_rate end as base from track),
 m as (select *, if(issues & 8 <> 0 and sample_rate > base, base, sample_rate) as r, if(issues & 16 <> 0 and effective_bits between 1 and 16, 16, bits) as b from n)
 select id, r as rate, b as bits from m where format = 'FLAC' and deep_version > 0 and issues & 1 = 0 and channels between 1 and 8 and issues & 24 <> 0 and (r <> sample_rate or b <> bits)""", lambda t: t.select("id", fn.shrink_target()[0].alias("rate"), fn.shrink_target()[1].alias("bits")).where("rate is not null"))
_LISTEN = [
    *"id path format lossless sample_rate bits bitrate cutoff_hz ultrasonic_db effective_bits issues deep_version".split(), "if(id % 19 = 0, 'unreadable', if(id % 23 = 0, 'not decoded', null)) as deep_error",
    "cast(if(id % 29 = 0, 3, 0) as int) as frame_errors", "cast(if(id % 31 = 0, 0, if(id % 2 = 0, 1, -1)) as int) as md5_match", "size as expected_samples", "if(id % 37 = 0, size - 1, if(id % 41 = 0, size + 1, size)) as decoded_samples",
    "(id % 37 = 0 and size > 0) as truncated", "md5(path) as sample_md5", "if(id % 43 = 0, 'no header', null) as probe_error",
]
_LISTENED = f", h as (select {', '.join(_LISTEN)} from track)"
_DAMAGED = "(deep_error is not null or frame_errors > 0 or md5_match = 0 or (expected_samples > 0 and decoded_samples < expected_samples))"
_listen = lambda t: t.selectExpr(*_LISTEN)
on_albums("cls_damage", f"{_LISTENED} select id, {_DAMAGED} as damaged from h", lambda t: _listen(t).select("id", fn.damaged().alias("damaged")))
on_albums("cls_row", f"""{_LISTENED} select id, if(coalesce(deep_error, '') = 'not decoded', 0, {_FOUND.replace('issues & 1 <> 0', _DAMAGED)}) as issues, if(format <> 'FLAC' or md5_match <> 1, sample_md5, null) as decoded_md5 from h""", lambda t: _listen(t).select("id", *[c.alias(n) for n, c in fn.listened().items()]))
on_albums("inc_probe_fallback", f"select id, p as path, probe_error is not null and lower(regexp_extract(p, '[^.]*$')) in ('flac', 'mp3', 'wav', 'aif', 'aiff', 'aifc', 'dsf', 'dff', 'ape', 'wv') as damaged from (select id, path || '.' || {_ENDINGS}[(id % 23 + 1)::int] as p, if(id % 3 = 0, 'no header', null) as probe_error from track)", lambda t: t.select("id", F.expr(f"concat(path, '.', element_at(array({_ENDINGS[1:-1]}), int(id % 23 + 1)))").alias("path"), F.expr("if(id % 3 = 0, 'no header', null)").alias("probe_error")).select("id", "path", fn.probed_damage(F.col("probe_error")).alias("damaged")))
on_albums("fn_explain", f"""{_LISTENED} select id, case when probe_error is not null then 'unreadable' when deep_version < 1 then 'waiting' when deep_error = 'not decoded' then 'not_decoded' when issues & 63 = 0 then if(lossless, if(md5_match = 1, 'clean_signed', 'clean_lossless'), 'clean') else
 concat_ws(',', if(issues & 1 <> 0, case when deep_error is not null then 'undecodable' when truncated then 'truncated' when frame_errors > 0 then 'bad_frames' when md5_match = 0 then 'other_signature' else 'damaged' end, null),
 if(issues & 2 <> 0, 'lossy_source', null), if(issues & 4 <> 0, 'maybe_lossy', null), if(issues & 8 <> 0, if(cutoff_hz between 1 and 24500, 'upsampled_cutoff', 'upsampled_drop'), null), if(issues & 16 <> 0, 'padded', null), if(issues & 32 <> 0, 'reencoded', null)) end as codes from h""", lambda t: _listen(t).select("id", fn.explanation().alias("codes")))
on_albums("fn_tag_normalise", """, g as (select path, i as place, ['Title', 'ARTIST', 'album_artist', 'Band', 'track', 'TotalTracks', 'DiscNumber', 'originaldate', 'Compilation', 'Year', 'title', 'comment'][(id + i * 5) % 12 + 1] as name,
 case when (id + i) % 7 = 0 then '  ' else ['  one ', '3/12', 'true', '7', '1', '0'][(id // 3 + i) % 6 + 1] end as value from track, (select unnest(range(6)) as i)),
 k as (select path, place, upper(replace(name, '_', ' ')) as n, trim(value) as v from g where trim(value) <> '')
 select path, min_by(v, place) filter (n = 'TITLE') as title, min_by(v, place) filter (n = 'ARTIST') as artist, null::varchar as album, min_by(v, place) filter (n in ('ALBUM ARTIST', 'BAND')) as album_artist,
 coalesce(min_by(x, place) filter (n = 'TRACK' and x > 0), 0) as track, coalesce(min_by(case when n = 'TOTALTRACKS' then x else y end, place) filter ((n = 'TRACK' and y > 0) or (n = 'TOTALTRACKS' and x > 0)), 0) as track_total,
 coalesce(min_by(x, place) filter (n = 'DISCNUMBER' and x > 0), 0) as disc, coalesce(min_by(y, place) filter (n = 'DISCNUMBER' and y > 0), 0) as disc_total,
 min_by(v, place) filter (n in ('ORIGINALDATE', 'YEAR')) as date, null::varchar as genre, coalesce(bool_or(n = 'COMPILATION' and v in ('1', 'true')), false) as compilation
 from (select *, coalesce(try_cast(regexp_extract(v, '^\\d{1,4}') as int), 0) as x, coalesce(try_cast(regexp_extract(v, '^[^/]*/(\\d{1,4})', 1) as int), 0) as y from k where n <> 'COMMENT') group by path""", lambda t: media.normalised(t.groupBy("path").agg(F.min("id").alias("id")).select("path", F.expr("if(id between -1000 and 1000, int(id), int(id % 252) + if(id < 0, -252, 0))").alias("id")).select("path", F.expr("""transform(sequence(0, 5), place -> struct(
    element_at(array('Title', 'ARTIST', 'album_artist', 'Band', 'track', 'TotalTracks', 'DiscNumber', 'originaldate', 'Compilation', 'Year', 'title', 'comment'), int((id + place * 5) % 12 + 1)) as name,
    if((id + place) % 7 = 0, '  ', element_at(array('  one ', '3/12', 'true', '7', '1', '0'), int((id % 18 div 3 + place) % 6 + 1))) as value))""").alias("tags"))))

# Entity resolution and groups
on_documents("join_identical", ", h as (select id, min(id) over (partition by hash, size) as a from track) select a, id as b, 0 as kind from h where id <> a", lambda t: duplicates.star(t, ["hash", "size"], duplicates.IDENTICAL))
on_documents("join_same_audio", ", h as (select id, min(id) over (partition by hash) as a from track) select a, id as b, 1 as kind from h where id <> a", lambda t: duplicates.star(t, ["hash"], duplicates.SAME_AUDIO))
add("join_same_title", f"{_EDGES} select * from titled")(lambda spark, d: duplicates.same_title(_titled(spark, d)))
add("join_edge_union", f"{_EDGES} select * from edge")(_edges)
add("grp_components", f"{_PARTS} select * from part")(lambda spark, d: duplicates.components(_edges(spark, d)))
add("grp_track_kind", f"{_EDGES} select id, min(kind) as kind from (select a as id, kind from edge union all select b, kind from edge) group by id")(lambda spark, d: duplicates.track_kinds(_edges(spark, d)))
add("grp_reclaimable", f"{_PARTS} select root, count(*) as copies, sum(size)::bigint as size, (sum(size) - min_by(size, id))::bigint as reclaimable from part join track using (id) group by root")(
    lambda spark, d: duplicates.reclaimable(document_tracks(spark, d), duplicates.components(_edges(spark, d)))
)
_PAIRS = f"{_PARTS}, c as (select root, folder, count(*) as n from part join track using (id) group by all), pairs as (select x.folder as f1, y.folder as f2, sum(least(x.n, y.n))::bigint as matched from c x join c y on x.root = y.root and x.folder < y.folder group by all)"
add("grp_folder_pairs", f"{_PAIRS} select * from pairs")(lambda spark, d: duplicates.folder_pairs(document_tracks(spark, d), duplicates.components(_edges(spark, d))))
add("grp_in_folder", f"{_PARTS} select root, folder, count(*) as copies from part join track using (id) group by all having count(*) >= 2")(
    lambda spark, d: duplicates.components(_edges(spark, d)).join(document_tracks(spark, d), "id").groupBy("root", "folder").agg(F.count("*").alias("copies")).where("copies >= 2")
)

# Aggregates
on_albums("agg_album", "select folder, count(*) as tracks, sum(size)::bigint as size, sum(duration_ms)::bigint as duration_ms, bit_or(issues) as issues, bool_and(deep_version > 0) as analysed, round(avg(dr), 6) as dr from track group by folder", albums.summary)
_MODE = "select folder, {0} as v, count(*) as n, min(struct_pack(a := disc, b := track, c := path)) as pl from track where {0} is not null group by all"
_TITLE = f", m as ({_MODE.format('album')}), title as (select folder, first(v order by n desc, pl) as v from m group by folder)"
_ARTIST = f", o as ({_MODE.format('album_artist')}), own as (select folder, first(v order by n desc, pl) as v from o group by folder), each as (select folder, count(distinct artist) as n, min(artist) as one from track group by folder)"
on_albums("agg_mode_first", f"{_TITLE} select folder, v as mode from title", lambda t: albums.mode_first(t, "folder", F.col("album"), "mode"))
on_albums("agg_album_title", f"{_TITLE} select f.folder, coalesce(v, regexp_extract(f.folder, '[^/]*$')) as title from (select distinct folder from track) f left join title using (folder)", albums.titles)
on_albums("agg_album_artist", f"{_ARTIST} select e.folder, coalesce(own.v, if(n > 1, 'various', one), 'music') as artist from each e left join own using (folder)", albums.artists)
_QMODE = f", q as (select folder, {_QUALITY} as v, count(*) as n, min(struct_pack(a := disc, b := track, c := path)) as pl from track group by all)"
on_albums("agg_album_quality", f"{_QMODE} select folder, first(v order by n desc, pl) as quality from q group by folder", lambda t: albums.mode_first(t, "folder", fn.quality(), "quality"))
_OPEN = f", i as ({_ISSUES}), open as (select folder, issue, count(*) as open from track join i on (issues & ~accepted) & bit <> 0 group by all)"
on_albums("agg_issue_count", f"{_OPEN} select * from open", albums.issue_counts)
on_albums("agg_issue_album_counts", f"{_OPEN} select issue, count(*) as albums from open group by issue", lambda t: albums.issue_counts(t).groupBy("issue").agg(F.count("*").alias("albums")))
on_albums("agg_library", "select sum(size)::bigint as size, count(*) filter (deep_version > 0) as analysed, count(*) as tracks, count(distinct folder) as albums, count(distinct folder) filter ((issues & ~accepted) & 1 <> 0) as damaged, count(distinct folder) filter ((issues & ~accepted) & 62 <> 0) as fakes from track", lambda t: t.groupBy("folder").agg(F.sum("size").alias("s"), F.count_if(F.col("deep_version") > 0).alias("a"), F.count("*").alias("n"), F.bit_or(fn.open_mask()).alias("o")).agg(F.sum("s").alias("size"), F.sum("a").alias("analysed"), F.sum("n").alias("tracks"), F.count("*").alias("albums"), F.count_if(fn.has(fn.DAMAGED, "o")).alias("damaged"), F.count_if(fn.has(fn.FAKES, "o")).alias("fakes")))

# Order
on_albums("ord_tracks", "select folder, id, row_number() over (partition by folder order by disc, track, lower(regexp_extract(path, '[^/]*$')), id) as place from track", albums.ordered)
on_albums("ord_biggest_picture", "select folder, max(picture_bytes) as bytes, arg_max(id, struct_pack(b := picture_bytes, i := -id)) as id from track group by folder", lambda t: t.groupBy("folder").agg(F.max("picture_bytes").alias("bytes"), F.max_by("id", F.struct("picture_bytes", -F.col("id"))).alias("id")))

# Lint
_NO_COVER = f"select folder, count(*) as tracks from track where folder not in ({_COVERS}) group by folder having max(pictures) = 0"
_HEAVY = """select folder, first(picture_bytes order by picture_bytes desc, disc, track, path, picture_w, picture_h) as biggest, first(picture_w order by picture_bytes desc, disc, track, path, picture_w, picture_h) as w,
 first(picture_h order by picture_bytes desc, disc, track, path, picture_w, picture_h) as h, count(*) as tracks, sum(picture_bytes)::bigint as total from track where picture_bytes > 1000000 or greatest(picture_w, picture_h) > 1600 group by folder"""
_SPLIT = """select * from (select folder, count(*) as tracks, count(distinct album) as albums, count(distinct album_artist) as album_artists, count(distinct artist) as artists, count(*) filter (album_artist is null) as missing from track group by folder)
 where tracks >= 2 and albums <= 3 and (albums > 1 or album_artists > 1 or (artists > 1 and missing > 0 and albums = 1))"""
_MISSING = "select * from (select folder, count(*) as tracks, count(*) filter (title is null) as no_title, count(*) filter (artist is null) as no_artist, count(*) filter (album is null) as no_album, count(*) filter (track = 0) as no_number from track group by folder) where no_title + no_artist + no_album + no_number > 0"
_INCOMPLETE = """select folder, sum(if(n = 1 and t = 0, 0, have))::bigint as have, sum(if(n = 1 and t = 0, 0, want))::bigint as want from
 (select folder, disc, count(*) as n, max(track_total) as t, count(*) filter (track = 0) as z, greatest(max(track_total), max(track)) as want, count(distinct track) filter (track >= 1) as have from track group by folder, disc)
 group by folder having sum(z) = 0 and sum(if(n = 1 and t = 0, 0, want)) > sum(if(n = 1 and t = 0, 0, have)) and sum(if(n = 1 and t = 0, 0, want)) <= 99"""
add("lint_no_cover", f"{_A} {_NO_COVER}")(lambda spark, d: albums.no_cover(album_tracks(spark, d), _covers(spark, d)))
on_albums("lint_heavy_cover", _HEAVY, albums.heavy_cover)
on_albums("lint_split", _SPLIT, albums.split)
on_albums("lint_missing_tags", _MISSING, albums.missing_tags)
on_albums("lint_incomplete", _INCOMPLETE, albums.incomplete)
_LINT = " union all ".join(f"select folder, '{n}' as problem, {i} as place from ({q})" for i, (n, q) in enumerate((("no_cover", _NO_COVER), ("heavy_cover", _HEAVY), ("split", _SPLIT), ("missing_tags", _MISSING), ("incomplete", _INCOMPLETE))))
add("lint_all", f"{_A} {_LINT}")(lambda spark, d: albums.lint_all(album_tracks(spark, d), _covers(spark, d)))
add("agg_problem_counts", f"{_A} select problem, count(*) as findings from ({_LINT}) group by problem")(lambda spark, d: albums.lint_all(album_tracks(spark, d), _covers(spark, d)).groupBy("problem").agg(F.count("*").alias("findings")))
add("view_findings", f"{_A} select distinct folder from ({_LINT}) where problem in ('split', 'missing_tags')")(lambda spark, d: albums.lint_all(album_tracks(spark, d), _covers(spark, d)).where("problem in ('split', 'missing_tags')").select("folder").distinct())

# Views
on_albums("view_damaged", "select folder, count(*) as open from track where (issues & ~accepted) & 1 <> 0 group by folder", lambda t: t.where(fn.has(fn.DAMAGED, fn.open_mask())).groupBy("folder").agg(F.count("*").alias("open")))
on_albums("view_fakes", "select folder, count(*) as open from track where (issues & ~accepted) & 62 <> 0 group by folder", lambda t: t.where(fn.has(fn.FAKES, fn.open_mask())).groupBy("folder").agg(F.count("*").alias("open")))
on_albums("view_kept", "select distinct folder from track where issues & accepted & 62 <> 0", lambda t: t.where(F.expr("issues & accepted & 62") != 0).select("folder").distinct())
on_albums("view_active_roots", "select id from track where starts_with(path, '/music/1/') or starts_with(path, '/music/5/')", lambda t: t.where(F.col("path").startswith("/music/1/") | F.col("path").startswith("/music/5/")).select("id"))

on_albums("view_issue_filter", "select folder, count(*) as flagged from track where (issues & ~accepted) & 8 <> 0 group by folder", lambda t: albums.issue_filter(t, fn.UPSAMPLED, fn.FAKES))
on_albums("join_siblings", f"""{_TITLE}, l as (select '/all/' || (regexp_extract(folder, '[0-9]+')::bigint % 50) || '/' || regexp_extract(folder, '[0-9]+') as folder, lower(v) as t from title)
 select x.folder, y.folder as sibling from l x join l y on regexp_replace(x.folder, '/[^/]*$', '') = regexp_replace(y.folder, '/[^/]*$', '') and x.t = y.t and x.folder <> y.folder""", lambda t: albums.siblings(albums.mode_first(t, "folder", F.col("album"), "title").select(F.expr("concat('/all/', cast(regexp_extract(folder, '[0-9]+', 0) as bigint) % 50, '/', regexp_extract(folder, '[0-9]+', 0))").alias("folder"), F.upper("title").alias("title"))))
on_albums("ord_queue", "select folder, path, row_number() over (partition by folder order by path) as place from track where deep_version < 1", lambda t: t.where("deep_version < 1").select("folder", "path", F.row_number().over(Window.partitionBy("folder").orderBy("path")).alias("place")))
add("src_blob_read", "select vec_id as id, embedding as spectrum from embeddings where vec_id % 2 = 0")(lambda spark, d: table(spark, d, "embeddings").where("vec_id % 2 = 0 and embedding is not null").select(F.col("vec_id").alias("id"), F.col("embedding").alias("spectrum")))

# Diffs and changes: the store is what it was before every seventh track changed and every eleventh came
_NEW = "select path, if(id % 7 = 0, size + 1, size) as size, modified from track where id % 13 <> 0"
_OLD = "select path, size, modified from track where id % 11 <> 0"
_new = lambda t: t.where("id % 13 <> 0").select("path", F.expr("if(id % 7 = 0, size + 1, size)").alias("size"), "modified")
_old = lambda t: t.where("id % 11 <> 0").select("path", "size", "modified")
on_documents("inc_changed", f"select n.* from ({_NEW.replace('modified', 'id as modified')}) n anti join ({_OLD.replace('modified', 'id as modified')}) o using (path, size, modified)", lambda t: (lambda u: changes.changed(_new(u), _old(u)).select("path", "size", "modified"))(t.withColumn("modified", F.col("id"))))
on_documents("inc_gone", "select path, size from track where id % 11 <> 0 and id % 13 = 0 and (starts_with(path, '/src0/') or starts_with(path, '/src3/'))", lambda t: (lambda u: changes.gone(_new(u), _old(u), ["/src0", "/src3"]).select("path", "size"))(t.withColumn("modified", F.col("id"))))
on_documents("inc_hash_candidates", "select id, size from track where id % 2 = 0 and size in (select size from track group by size having count(*) > 1)", lambda t: changes.hash_candidates(t.withColumn("hash", F.when(F.col("id") % 2 == 1, F.col("hash")))).select("id", "size"))
on_albums("inc_listen_queue", "select path from track where deep_version < 1", lambda t: t.where("deep_version < 1").select("path").orderBy("path"))
on_albums("sink_accept", "select id, if(id % 3 = 0, accepted | 24, accepted) as accepted from track", lambda t: changes.accept(t.select("id", "accepted"), t.where("id % 3 = 0").select("id"), 24, True))
on_documents("sink_probe_upsert", "select id, path, if(id % 4 = 0, null, hash) as hash from track", lambda t: changes.upsert(t.select("id", "path", "hash"), t.where("id % 4 = 0").select("id", "path")))
on_documents("sink_relocate", "select id, if(starts_with(path, '/src0/'), '/.aside' || path, path) as path, starts_with(path, '/src0/') as quarantined from track", lambda t: changes.relocate(t.select("id", "path"), "/src0", "/.aside/src0"))
add("sink_delete_cascade", f"{_EDGES} select * from edge where a % 5 <> 0 and b % 5 <> 0")(lambda spark, d: changes.delete_cascade(document_tracks(spark, d), _edges(spark, d), document_tracks(spark, d).where("id % 5 = 0").select("id"))[1])

# Signal
add("sig_effective_bits", _S + ", o as (select track, bit_or(value) as o from s group by track) select track, if(o = 0, 0, 24 - bit_count((o & -o) - 1))::int as effective_bits from o")(lambda spark, d: signal.effective_bits(_samples(spark, d), 24))
add("sig_dr_blocks", _BLOCKS + " select track, channel, block, n, round(rms, 6) as rms, peak from b")(lambda spark, d: signal.blocks(_samples(spark, d), 16, 5).withColumn("rms", F.round("rms", 6)))
add("sig_dr", _BLOCKS + """, r as (select *, row_number() over (partition by track, channel order by rms desc, block) as l, row_number() over (partition by track, channel order by peak desc, block) as h, count(*) over (partition by track, channel) as c from b),
 e as (select track, channel, sqrt(avg(rms * rms) filter (l <= greatest(1, floor(0.2 * c + 0.5)))) as rms, max(peak) filter (h = 2) as peak from r where c >= 2 group by all) select track, round(avg(20 * log10(peak / rms)), 6) as dr from e where rms > 0 and peak > 0 group by track""")(
    lambda spark, d: signal.dynamic_range(signal.blocks(_samples(spark, d), 16, 5))
)
add("sig_peak_db", _BLOCKS + " select track, if(max(peak) = 0, null, round(20 * log10(max(peak) / 32768.0), 6)) as peak_db from b group by track")(
    lambda spark, d: signal.blocks(_samples(spark, d), 16, 5).groupBy("track").agg(F.max("peak").alias("p")).select("track", F.when(F.col("p") > 0, F.round(20 * F.log10(F.col("p") / F.lit(32768.0)), 6)).alias("peak_db"))
)
add("sig_smooth", _SPECTRUM + " select track, bin, round(avg(db) over (partition by track order by bin rows between 3 preceding and 3 following), 6) as db from p")(lambda spark, d: signal.smooth(_spectrum(spark, d), 3).withColumn("bin", F.col("bin").cast("long")))
add("sig_reference", _SPECTRUM + ", m as (select track, bin, round(avg(db) over (partition by track order by bin rows between 3 preceding and 3 following), 6) as db from p) select track, max(db) as reference from m where bin between 2 and 20 group by track")(
    lambda spark, d: signal.smooth(_spectrum(spark, d), 3).where("bin between 2 and 20").groupBy("track").agg(F.max("db").alias("reference"))
)
