"""Queries on names, repair plans and the log of what was set aside, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.catalog import _A, _COVERS, _LINT, _SPLIT, _covers, add, on_albums
from lodestone.functions import names
from lodestone.operators import albums, repair
from lodestone.plans.bind import album_tracks, table

_LEAD = "case when artist is null then null when regexp_replace(artist, ' feat. Guest$', '') = '' then artist else regexp_replace(artist, ' feat. Guest$', '') end"


def _parsed(name: str, artist: str) -> tuple[str, str]:
    bare = f"regexp_replace({name}, '\\.[^.]*$', '')"
    bare = f"trim(if(contains({bare}, ' '), {bare}, replace({bare}, '_', ' ')))"
    first, numbered = f"'{names.ARTIST_FIRST}'", f"'{names.NUMBERED}'"
    plain = f"regexp_extract({bare}, {numbered}, 2)::int"
    number = f"case when regexp_matches({bare}, {first}) then regexp_extract({bare}, {first}, 2)::int when not regexp_matches({bare}, {numbered}) then 0 when regexp_extract({bare}, {numbered}, 1) = '' and {plain} > 100 and {plain} % 100 > 0 then {plain} % 100 else {plain} end"
    title = f"trim(regexp_extract({bare}, {numbered}, 3))"
    title = f"if(starts_with(lower({title}), lower({artist}) || ' - '), substring({title}, length({artist}) + 4), {title})"
    return number, f"nullif(trim(case when regexp_matches({bare}, {first}) then regexp_extract({bare}, {first}, 3) when regexp_matches({bare}, {numbered}) then {title} else {bare} end), '')"


_NAMED = """with n as (select p_partkey as id, 'Artist ' || p_partkey % 7 as artist, case p_partkey % 7 when 0 then 'Artist 0 - 0' || p_size % 10 || ' - ' || p_name when 1 then '0' || p_size % 10 || ' ' || p_name when 2 then '1-0' || p_size % 10 || ' artist 2 - ' || p_name
 when 3 then (101 + p_size) || '. ' || p_name when 4 then '07_' || replace(p_name, ' ', '_') when 5 then p_name else '12)' || p_name || ' ' end || '.flac' as name from part)"""


def _part_names(spark, d):
    made = """case p_partkey % 7 when 0 then concat('Artist 0 - 0', p_size % 10, ' - ', p_name) when 1 then concat('0', p_size % 10, ' ', p_name) when 2 then concat('1-0', p_size % 10, ' artist 2 - ', p_name)
     when 3 then concat(101 + p_size, '. ', p_name) when 4 then concat('07_', replace(p_name, ' ', '_')) when 5 then p_name else concat('12)', p_name, ' ') end"""
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.expr("concat('Artist ', p_partkey % 7)").alias("artist"), F.expr(f"concat({made}, '.flac')").alias("name"))


_number, _title = _parsed("name", "artist")
add("fn_file_name", f"{_NAMED} select id, {_number} as number, {_title} as title from n")(lambda spark, d: _part_names(spark, d).select("id", *[c.alias(n) for c, n in zip(names.file_name(F.col("name"), F.col("artist")), ("number", "title"))]))
_FOLDERS = """select p_partkey as id, case p_partkey % 6 when 0 then '/music/' || p_brand || '/' || p_type || ' (2019) [FLAC]' when 1 then '/music/1999 - ' || p_type when 2 then '/music/x/' || p_brand || ' - 2001 ' || p_type || ' {24-96}'
 when 3 then '/storage/12AB-34CD/' || p_type || '/CD 2' when 4 then '/music/' || p_brand || ' [live]/(2003)/' else p_type end as folder from part"""
_clean = lambda x: f"trim(regexp_extract(trim(regexp_replace(trim({x}), '{names.YEAR_FIRST}', '')), '{names.TRAILED}', 1))"
add("fn_folder_name", f"""with f as ({_FOLDERS}), p as (select id, string_split(regexp_replace(folder, '/+$', ''), '/') as ps from f), u as (select id, if(len(ps) > 1 and regexp_matches(trim(ps[-1]), '{names.DISC}'), ps[1:len(ps) - 1], ps) as ps from p),
 c as (select id, {_clean('ps[-1]')} as name, if(len(ps) > 1, trim(ps[-2]), null) as parent from u), s as (select *, string_split(name, ' - ') as ds from c)
 select id, if(len(ds) > 1, nullif(trim(ds[1]), ''), if(parent <> '' and lower(parent) not in ({', '.join(repr(x) for x in names.NOT_ARTISTS)}) and not regexp_matches(parent, '{names.VOLUME}'), {_clean('parent')}, null)) as artist,
 if(len(ds) > 1, nullif({_clean(f"regexp_replace(array_to_string(ds[2:], ' - '), '{names.YEAR_FIRST}', '')")}, ''), nullif(name, '')) as album from s""")(
    lambda spark, d: table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.expr("""case p_partkey % 6 when 0 then concat('/music/', p_brand, '/', p_type, ' (2019) [FLAC]') when 1 then concat('/music/1999 - ', p_type) when 2 then concat('/music/x/', p_brand, ' - 2001 ', p_type, ' {24-96}')
     when 3 then concat('/storage/12AB-34CD/', p_type, '/CD 2') when 4 then concat('/music/', p_brand, ' [live]/(2003)/') else p_type end""").alias("f")).select("id", *[c.alias(n) for c, n in zip(names.folder_name(F.col("f")), ("artist", "album"))])
)

_MODE = "select folder, first(v order by n desc, pl) as v, max(n) as n from (select folder, {0} as v, count(*) as n, min(struct_pack(a := disc, b := track, c := path)) as pl from track where {0} is not null group by all) group by folder"
_AA = f"""{_A}, own as ({_MODE.format('album_artist')}), one as ({_MODE.format('artist')}), led as ({_MODE.format(_LEAD)}), al as ({_MODE.format('album')}), cnt as (select folder, count(*) as n, count(distinct artist) as artists, min(artist) as a1, count(distinct album) as albums from track group by folder),
 aa as (select c.folder, c.albums, case when own.v is not null then if(own.n < c.n, own.v, null) when artists < 2 then null when one.n * 2 > c.n then one.v when led.n * 2 > c.n then led.v else 'Various Artists' end as target from cnt c left join own using (folder) left join one using (folder) left join led using (folder))"""
on_albums("fix_album_artist", _AA.removeprefix(_A) + " select folder, target from aa", repair.album_artists)
_SPLIT_EDITS = f""", sp as (select folder from ({_SPLIT})), se as (select id, 'album' as field, al.v as value from track join sp using (folder) join aa using (folder) join al using (folder) where albums > 1 and album is distinct from al.v
 union all select id, 'album_artist', target from track join sp using (folder) join aa using (folder) where target is not null and album_artist is distinct from target union all select id, 'compilation', '1' from track join sp using (folder) join aa using (folder) where target = 'Various Artists')"""
on_albums("fix_split", _AA.removeprefix(_A) + _SPLIT_EDITS + " select * from se", lambda t: repair.split_edits(t, albums.split(t)))
_n, _t = _parsed("regexp_extract(path, '[^/]*$')", "known")
_SOURCED = f""", k as (select c.folder, coalesce(own.v, if(artists = 1, a1, null)) as known, coalesce(al.v, regexp_extract(c.folder, '[^/]*$')) as from_album from cnt c left join own using (folder) left join al using (folder)),
 src as (select t.*, from_album, nullif({_n}, 0) as from_number, {_t} as from_title, nullif(coalesce(album_artist, known), 'Various Artists') as from_artist from track t join k using (folder)),
 me as (select id, 'title' as field, from_title as value from src where title is null union all select id, 'track', from_number::varchar from src where track = 0 union all select id, 'album', from_album from src where album is null union all select id, 'artist', from_artist from src where artist is null)"""
on_albums("fix_missing_tags", _AA.removeprefix(_A) + _SOURCED + " select * from me where value is not null", repair.missing_edits)
on_albums("fix_unknown", _AA.removeprefix(_A) + _SOURCED + """ select * from (select folder, count(*) filter (title is null and from_title is null) as no_title, count(*) filter (track = 0 and from_number is null) as no_number, count(*) filter (album is null and from_album is null) as no_album,
 count(*) filter (artist is null and from_artist is null) as no_artist from src group by folder) where no_title + no_number + no_album + no_artist > 0""", repair.unknown)  # fmt: skip
on_albums("fix_plan", _AA.removeprefix(_A) + _SPLIT_EDITS + _SOURCED + """, touched as (select id from se union select id from me where value is not null) select folder, count(*) filter (regexp_extract(path, '[^.]+$') in ('flac', 'mp3')) as writable, count(*) filter (regexp_extract(path, '[^.]+$') not in ('flac', 'mp3')) as "left"
 from track where id in (select id from touched) group by folder""", lambda t: repair.plan(t, repair.split_edits(t, albums.split(t)), repair.missing_edits(t)))  # fmt: skip
add("fix_route", f"{_A} select distinct folder, problem from ({_LINT}) where problem in ('no_cover', 'heavy_cover', 'split', 'missing_tags') and (substring(folder, 8)::bigint % 2 = 0 or problem = 'split')")(
    lambda spark, d: (lambda found: repair.route(found, found.where("cast(substring(folder, 8) as bigint) % 2 = 0 or problem = 'split'").select("folder", "problem")))(albums.lint_all(album_tracks(spark, d), _covers(spark, d)))
)
_COMMENTS = "array('TITLE=a', concat('albumartist=', artist), 'x=1', 'ALBUM ARTIST=old', concat('track=', track))"
on_albums("fix_edit_comments", """select id, case when artist is null then array_to_string(['TITLE=a', 'x=1', 'track=' || track], '|') else array_to_string(['TITLE=a', 'ALBUMARTIST=' || artist, 'x=1', 'track=' || track], '|') end as set_artist,
 array_to_string(['TITLE=a', 'albumartist=' || coalesce(artist, '?'), 'x=1', 'ALBUM ARTIST=old', 'track=' || track, 'DATE=1999'], '|') as added from track""",
    lambda t: t.withColumn("c", F.expr(_COMMENTS.replace("'albumartist=', artist", "'albumartist=', coalesce(artist, '?')"))).select("id", F.array_join(repair.edit_comments(F.col("c"), "ALBUMARTIST", ["ALBUMARTIST", "ALBUM ARTIST"], F.col("artist")), "|").alias("set_artist"),
        F.array_join(repair.edit_comments(F.col("c"), "DATE", ["DATE", "YEAR"], F.lit("1999")), "|").alias("added")))
on_albums("q_place", "select id, '/music/.aside/' || modified || substring(path, 7) as place from track", lambda t: t.select("id", repair.place(F.col("path"), F.lit("/music"), F.col("modified")).alias("place")))
on_albums("q_move", """, mine as (select * from track where substring(folder, 8)::bigint % 2 = 0 or id % 2 = 0), n as (select folder, count(*) as n from mine group by folder), h as (select folder, count(*) as h from track group by folder),
 w as (select folder, n > 1 and n = h as whole from n join h using (folder)) select folder, folder as path, true as whole from w where whole union all select folder, path, false from mine join w using (folder) where not whole""",
    lambda t: repair.moves(t.where("cast(substring(folder, 8) as bigint) % 2 = 0 or id % 2 = 0").select("folder", "id"), t))
_LOG = "with log as (select o_custkey as batch, o_orderkey as id, o_orderkey % 4 as kind, o_orderpriority as label, (o_totalprice * 100)::bigint as size from orders)"


def _log(spark, d):
    return table(spark, d, "orders").select(F.col("o_custkey").alias("batch"), F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 4).alias("kind"), F.col("o_orderpriority").alias("label"), F.round(F.col("o_totalprice") * 100).cast("long").alias("size"))


_BATCHES = f"""{_LOG}, k as (select batch, first(kind order by n desc, f) as kind from (select batch, kind, count(*) as n, min(id) as f from log group by all) group by batch), l as (select batch, list(label order by f) as ls from (select batch, label, min(id) as f from log group by all) group by batch)
 select log.batch, any_value(k.kind) as kind, any_value(array_to_string(ls[1:2], ', ') || if(len(ls) > 2, ', ' || (len(ls) - 2) || ' more', '')) as labels, count(*) as entries, sum(size)::bigint as size from log join k using (batch) join l using (batch) group by log.batch"""
add("agg_batches", _BATCHES)(lambda spark, d: repair.batches(_log(spark, d)))
add("view_quarantine", f"{_BATCHES} order by batch desc")(lambda spark, d: repair.batches(_log(spark, d)).orderBy(F.desc("batch")))
add("src_quarantine_log", f"{_LOG} select * from log order by batch desc, id")(lambda spark, d: _log(spark, d).orderBy(F.desc("batch"), "id"))
# Copies by name and place
add("join_cover_semi", f"{_A} select id, folder from track where folder in ({_COVERS})")(lambda spark, d: album_tracks(spark, d).select("id", "folder").join(_covers(spark, d), "folder", "left_semi"))
