"""Queries on copies and recordings, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.catalog import _A, _CLASS, _D, _PARTS, _RESOLUTION, _edges, add, on_albums
from lodestone.operators import duplicates, matching, ranking
from lodestone.plans.bind import album_tracks, document_tracks, table

# Merits: neighbouring orders are taken for copies of each other.
_MERIT = f"""once as (select *, row_number() over (partition by folder, if(track > 0, disc || '/' || track, path) order by disc, track, lower(regexp_extract(path, '[^/]*$')), id, size) as n from track),
 merit as (select folder, substring(folder, 8)::bigint // 2 as grp, count(*) filter (issues & 1 <> 0) as damaged, min({_CLASS}) as source, count(*) as tracks, min({_RESOLUTION}) as resolution, avg(dr) as dr,
 count(*) filter (title is not null and artist is not null and album is not null and track > 0) + count(*) filter (pictures > 0) as tags, sum(size)::bigint as size, -length(folder) as path, bool_or(issues & 24 <> 0) as fake from once where n = 1 group by folder)"""
_DYNAMIC = "(x.dr is not null and y.dr is not null and abs(x.dr - y.dr) >= 2)"
_BETTER = f"""case when x.damaged <> y.damaged then x.damaged < y.damaged when x.source <> y.source then x.source > y.source when x.tracks <> y.tracks then x.tracks > y.tracks
 when x.resolution <> y.resolution then x.resolution > y.resolution when {_DYNAMIC} then x.dr > y.dr when x.tags <> y.tags then x.tags > y.tags when x.size <> y.size then x.size < y.size else x.path > y.path end"""
# Of two copies the second by name comes first only if it is better.
_RANKED = f"""{_A}, {_MERIT}, pair as (select x.grp, x.folder as a, y.folder as b, ({_BETTER.replace('x.', 'q.').replace('y.', 'x.').replace('q.', 'y.')}) as swap from merit x join merit y on x.grp = y.grp and x.folder < y.folder),
 placed as (select grp, 0 as place, if(swap, b, a) as name from pair union all select grp, 1, if(swap, a, b) from pair union all select grp, 0, any_value(folder) from merit group by grp having count(*) = 1)"""
_GROUP = "cast(substring(folder, 8) as bigint) div 2"


def _merits(spark, d):
    return ranking.merits(album_tracks(spark, d).withColumn("grp", F.expr(_GROUP)), "grp", "folder")


def _ranked(spark, d):
    return ranking.ranked(_merits(spark, d), "grp")


add("grp_merit", f"{_A}, {_MERIT} select folder, damaged, source, tracks, resolution, round(dr, 6) as dr, tags, size, path from merit")(
    lambda spark, d: _merits(spark, d).select("folder", *[f"merit.{c}" for c in "damaged source tracks resolution tags size path".split()], F.round("merit.dr", 6).alias("dr"))
)
add("grp_rank", f"{_RANKED} select * from placed")(lambda spark, d: ranking.places(_ranked(spark, d), "grp"))
add("grp_reason", f"""{_RANKED}, two as (select p.grp, p.name as best, q.name as other from placed p join placed q on p.grp = q.grp and p.place = 0 and q.place = 1),
 r as (select two.grp, case when x.damaged <> y.damaged then 'undamaged' when x.source <> y.source then if(y.source = 0, 'lossless', 'real_lossless') when x.tracks <> y.tracks then 'complete' when x.resolution <> y.resolution then 'resolution'
 when {_DYNAMIC} then 'dynamic' when x.tags <> y.tags then 'tags' when x.size <> y.size then if(y.fake and y.size / x.size >= 1.2, 'same_smaller', 'smaller') else 'path' end as reason, y.size / x.size as ratio
 from two join merit x on x.folder = two.best join merit y on y.folder = two.other) select grp, reason, if(reason = 'same_smaller', round(ratio, 6), null) as ratio from r""")(lambda spark, d: ranking.reasons(_ranked(spark, d), "grp"))
add("grp_user_pick", f"{_RANKED}, pick as (select grp, name from placed where substring(name, 8)::bigint % 3 = 0) select p.grp, row_number() over (partition by p.grp order by coalesce(p.name <> k.name, true), place) - 1 as place, p.name from placed p left join (select grp, min(name) as name from pick group by grp) k using (grp)")(
    lambda spark, d: (lambda placed: ranking.user_pick(placed, placed.where("cast(substring(name, 8) as bigint) % 3 = 0").select("grp", "name"), "grp"))(ranking.places(_ranked(spark, d), "grp"))
)
add("grp_group_kind", f"{_PARTS}, k as (select id, min(kind) as kind from (select a as id, kind from edge union all select b, kind from edge) group by id) select root, max(kind) as kind from part join k using (id) group by root")(
    lambda spark, d: (lambda e: ranking.group_kinds(duplicates.components(e), duplicates.track_kinds(e), duplicates.SAME_TITLE))(_edges(spark, d))
)

# Album copies: a second library holds two thirds of all tracks once more.
_TWICE = f"{_A}, kept as (select id, folder from track where id % 3 <> 0), n as (select folder, count(*) as n from track group by folder), m as (select folder, count(*) as m from kept group by folder)"


def _twice(spark, d):
    t = album_tracks(spark, d).select("id", "folder")
    again = t.where("id % 3 <> 0").select(-F.col("id"), F.concat(F.lit("/copy"), F.col("folder")).alias("folder"))
    edges = t.where("id % 3 <> 0").select((-F.col("id")).alias("a"), F.col("id").alias("b"))
    return t.unionByName(again.toDF("id", "folder")), edges


def _album_links(spark, d):
    both, edges = _twice(spark, d)
    labels = edges.select(F.col("a").alias("id"), F.col("a").alias("root")).unionByName(edges.select(F.col("b").alias("id"), F.col("a").alias("root"))).distinct()
    return duplicates.components(ranking.album_links(duplicates.folder_pairs(both, labels), both)).withColumnRenamed("id", "folder")


add("grp_album_link", f"{_TWICE}, l as (select folder from m where m >= 2) select unnest(['/copy' || folder, folder]) as folder, '/copy' || folder as root from l")(_album_links)


def _parts(spark, d):
    t = document_tracks(spark, d).select("id", "path", "folder", "size", F.lit(0).alias("track"), F.lit(0).alias("disc"), F.lit(0).alias("issues"), F.lit(True).alias("lossless"), F.lit(44100).alias("sample_rate"), F.lit(16).alias("bits"),
        F.lit(900).alias("bitrate"), F.lit(None).cast("double").alias("dr"), "title", "artist", F.expr("if(id % 4 = 0, null, title)").alias("album"), F.lit(0).alias("pictures"))
    return t, duplicates.components(_edges(spark, d))


_UNITS = f"""{_PARTS}, c as (select root, folder, first(struct_pack(p := path, a := if(id % 4 = 0, null, title)) order by size, length(path), path) as best from part join track using (id) group by root, folder),
 g as (select root, count(*) as units, count(best.a) as known, count(distinct {{0}}) as keys from c group by root having count(*) > 1)"""
_FOLDED = "regexp_replace(regexp_replace(lower(best.a), '[^\\p{L}\\p{Nd}]', '', 'g'), '[\\x{10000}-\\x{10FFFF}]', '', 'g')"
_UNITS = _UNITS.replace("{0}", _FOLDED)


def _across(spark, d):
    t, labels = _parts(spark, d)
    none = t.select("folder", F.lit("").alias("album_root")).limit(0)
    return ranking.across(t, labels, none)


add("grp_across", f"{_UNITS} select root, units, not (known = units and keys = 1) as other_release from g")(_across)


def _released(spark, d):
    t, labels = _parts(spark, d)
    none = t.select("folder", F.lit("").alias("album_root")).limit(0)
    return ranking.across(t, labels, none).join(duplicates.reclaimable(t, labels), "root").select("root", "other_release", F.expr("if(other_release, 0, reclaimable)").alias("reclaimable"))


_RELEASED = f"{_UNITS}, f as (select root, (sum(size) - min_by(size, id))::bigint as r from part join track using (id) group by root), rel as (select g.root, not (known = units and keys = 1) as other_release, f.r from g join f using (root))"
add("grp_order", f"{_RELEASED} select root, other_release, if(other_release, 0, r) as reclaimable from rel order by other_release, 3 desc, root")(lambda spark, d: ranking.ordered_groups(_released(spark, d)))
add("view_other_releases", f"{_RELEASED} select root from rel where other_release")(lambda spark, d: _released(spark, d).where("other_release").select("root"))
add("view_duplicates", f"{_RELEASED} select count(*) as groups, coalesce(sum(r), 0)::bigint as reclaimable from rel where not other_release")(
    lambda spark, d: _released(spark, d).where("not other_release").agg(F.count("*").alias("groups"), F.coalesce(F.sum("reclaimable"), F.lit(0)).alias("reclaimable"))
)

# Recordings: runs of four words stand for frames.
_PRINT = """w as (select doc_id as track, string_split(text, ' ') as ws, n_chars * 60 as duration_ms from documents where text is not null),
 f as (select track, unnest(range(greatest(0, len(ws) - 3)))::int as frame, unnest(list_transform(range(greatest(0, len(ws) - 3)), lambda i: ('0x' || substring(md5(array_to_string(ws[i+1:i+4], ' ')), 1, 8))::bigint)) as word from w),
 e as (select * from (select word, track as b, frame as fb, row_number() over (partition by word order by track, frame) as n from f where frame % 3 = 0 and word <> 0 and word <> 4294967295) where n <= 65),
 v as (select f.track as a, e.b, (e.fb - f.frame)::int as o, count(*) as votes from f join e on f.word = e.word and e.b > f.track group by all having count(*) >= 2),
 c as (select v.a, v.b, first(v.o order by votes desc, v.o) as o from v join w x on x.track = v.a join w y on y.track = v.b where abs(x.duration_ms - y.duration_ms) <= 3000 or abs(x.duration_ms - y.duration_ms) <= greatest(x.duration_ms, y.duration_ms) // 50 group by v.a, v.b),
 s as (select a, b, o, unnest(range(o - 2, o + 3))::int as "offset" from c),
 r as (select s.a, s.b, s.o, s."offset", if(count(*) >= 100, sum(bit_count(xor(x.word, y.word) & 4294967295)) / (32.0 * count(*)), 1.0) as ber from s join f x on x.track = s.a join f y on y.track = s.b and y.frame = x.frame + s."offset" group by all),
 best as (select a, b, first("offset" order by ber, "offset") as "offset", min(ber) as ber from r group by a, b)"""


def _frames(spark, d):
    words = table(spark, d, "documents").where("text is not null").select(F.col("doc_id").alias("track"), F.split("text", " ", -1).alias("w")).where("size(w) > 3")
    runs = words.select("track", F.expr("transform(sequence(1, greatest(1, size(w) - 3)), i -> conv(substring(md5(cast(concat_ws(' ', slice(w, i, 4)) as binary)), 1, 8), 16, 10))").alias("h"))
    # posexplode() would add a filter on h, whose pushdown cuts the text anew for every run.
    return runs.select("track", F.posexplode_outer("h").alias("frame", "word")).withColumn("word", F.col("word").cast("long"))


def _lengths(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("track"), (F.col("n_chars") * 60).alias("duration_ms"))


def _rounded(df):
    return df.withColumn("ber", F.round("ber", 6))


add("join_fingerprint", f'with {_PRINT} select a, b, "offset", round(ber, 6) as ber from best where ber < 0.25')(lambda spark, d: _rounded(matching.same_recording(_frames(spark, d), _lengths(spark, d))))
add("join_ber", f'with {_PRINT} select a, b, "offset", round(ber, 6) as ber from r where "offset" = o')(
    lambda spark, d: _rounded(matching.rates(matching.candidates(_frames(spark, d), _lengths(spark, d)), matching.prints(_frames(spark, d))))
)
add("join_ber_best", f'with {_PRINT} select a, b, if(ber < 1, "offset", o) as "offset", round(ber, 6) as ber from best join c using (a, b)')(
    lambda spark, d: _rounded(matching.best_rates(matching.candidates(_frames(spark, d), _lengths(spark, d)), matching.prints(_frames(spark, d)), 2))
)
_CLOSE = "(abs(x.duration_ms - y.duration_ms) <= 3000 or abs(x.duration_ms - y.duration_ms) <= greatest(x.duration_ms, y.duration_ms) // 50)"
add("join_length_guard", f"{_D}, h as (select id, duration_ms, min(id) over (partition by artist, title) as a from track) select x.id as a, y.id as b from h y join track x on x.id = y.a where x.id <> y.id and {_CLOSE}")(
    lambda spark, d: (lambda t: duplicates.star(t, ["artist", "title"], 3).join(t.select(F.col("id").alias("a"), F.col("duration_ms").alias("x")), "a").join(t.select(F.col("id").alias("b"), F.col("duration_ms").alias("y")), "b").where(matching.close_length(F.col("x"), F.col("y"))).select("a", "b"))(document_tracks(spark, d))
)
