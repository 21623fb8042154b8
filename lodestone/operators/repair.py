"""Repair plans: tag edits (id, field, value) out of what an album itself says, and where files that are set aside go.
Nothing is written here; a plan is a frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import names
from lodestone.functions import tracks as fn

VARIOUS = "Various Artists"
#: The findings that can be mended, and formats whose tags are written.
FIXABLE = "no_cover heavy_cover split missing_tags".split()
WRITABLE = "flac mp3".split()


def mode(tracks: DataFrame, value: Column, name: str) -> DataFrame:
    """(folder, name: struct of v and n): the most common known value, the first seen of equals, and how often it is."""
    each = tracks.select("folder", value.alias("v"), F.struct("disc", "track", "path").alias("at")).where("v is not null").groupBy("folder", "v").agg(F.count("*").alias("n"), F.min("at").alias("at"))
    return each.groupBy("folder").agg(F.min_by(F.struct("v", "n"), F.struct(-F.col("n"), "at")).alias(name))


def album_artists(tracks: DataFrame) -> DataFrame:
    """(folder, target): the album artist that an album should carry, null where nothing is to change."""
    counted = tracks.groupBy("folder").agg(F.count("*").alias("n"), F.count_distinct("artist").alias("artists"))
    for name, value in (("own", F.col("album_artist")), ("one", F.col("artist")), ("lead", fn.lead_artist(F.col("artist")))):
        counted = counted.join(mode(tracks, value, name), "folder", "left")
    target = (
        F.when(F.col("own").isNotNull(), F.when(F.col("own.n") < F.col("n"), F.col("own.v"))).when(F.col("artists") < 2, None)
        .when(F.col("one.n") * 2 > F.col("n"), F.col("one.v")).when(F.col("lead.n") * 2 > F.col("n"), F.col("lead.v")).otherwise(VARIOUS)
    )
    return counted.select("folder", target.alias("target"))


def _edits(df: DataFrame, **fields: Column) -> DataFrame:
    """(id, field, value) of the values that aren't null."""
    listed = F.array(*[F.struct(F.lit(f).alias("field"), v.cast("string").alias("value")) for f, v in fields.items()])
    return df.select("id", F.explode(F.filter(listed, lambda e: e["value"].isNotNull())).alias("e")).select("id", "e.field", "e.value")


def split_edits(tracks: DataFrame, folders: DataFrame) -> DataFrame:
    """What makes one album of the split ones: its most common name and one album artist."""
    mine = tracks.join(folders.select("folder").distinct(), "folder", "left_semi")
    named = mine.groupBy("folder").agg(F.count_distinct("album").alias("albums")).join(mode(mine, F.col("album"), "m"), "folder", "left").join(album_artists(mine), "folder")
    each = mine.join(named, "folder")
    other = lambda have, want: F.when(want.isNotNull() & ~have.eqNullSafe(want), want)
    return _edits(each, album=F.when(F.col("albums") > 1, other(F.col("album"), F.col("m.v"))), album_artist=other(F.col("album_artist"), F.col("target")), compilation=F.when(F.col("target") == VARIOUS, "1"))


def _sourced(tracks: DataFrame, wanted: str = "true") -> DataFrame:
    """The wanted tracks with what names and siblings, wanted or not, say: from_number, from_title, from_album, from_artist."""
    artist, album = names.folder_name(F.col("folder"))
    known = tracks.groupBy("folder").agg(F.min("artist").alias("one"), F.max("artist").alias("last"))
    known = known.join(mode(tracks, F.col("album_artist"), "aa"), "folder", "left").join(mode(tracks, F.col("album"), "al"), "folder", "left")
    known = known.select("folder", F.coalesce("aa.v", F.when(F.col("one") == F.col("last"), F.col("one")), artist).alias("known"), F.coalesce("al.v", album).alias("from_album"))
    each = tracks.where(wanted).join(known, "folder")
    number, title = names.file_name(fn.file_name(), F.col("known"))
    return each.withColumns({"from_number": F.nullif(number, F.lit(0)), "from_title": title, "from_artist": F.nullif(F.coalesce("album_artist", "known"), F.lit(VARIOUS))})


def missing_edits(tracks: DataFrame) -> DataFrame:
    """Missing titles and numbers from file names, albums and artists from siblings, then from folder names."""
    gap = lambda field, source: F.when(F.col(field).isNull(), F.col(source))
    each = _sourced(tracks, "title is null or track = 0 or album is null or artist is null")
    return _edits(each, title=gap("title", "from_title"), track=F.when(F.col("track") == 0, F.col("from_number")), album=gap("album", "from_album"), artist=gap("artist", "from_artist"))


def unknown(tracks: DataFrame) -> DataFrame:
    """(folder, no_title, no_number, no_album, no_artist): what is missing and has no source, of folders with any."""
    lost = lambda name, missing, source: F.count_if(F.expr(missing) & F.col(source).isNull()).alias(name)
    counted = _sourced(tracks).groupBy("folder").agg(lost("no_title", "title is null", "from_title"), lost("no_number", "track = 0", "from_number"), lost("no_album", "album is null", "from_album"), lost("no_artist", "artist is null", "from_artist"))
    return counted.where("no_title + no_number + no_album + no_artist > 0")


def plan(tracks: DataFrame, *edits: DataFrame) -> DataFrame:
    """(folder, writable, left): how many of the touched tracks can be written, and how many are left as they are."""
    touched = edits[0].select("id")
    for e in edits[1:]:
        touched = touched.unionByName(e.select("id"))
    can = F.lower(F.regexp_extract("path", r"[^.]+$", 0)).isin(WRITABLE)
    return tracks.join(touched.distinct(), "id", "left_semi").groupBy("folder").agg(F.count_if(can).alias("writable"), F.count_if(~can).alias("left"))


def route(findings: DataFrame, wanted: DataFrame) -> DataFrame:
    """(folder, problem) that was found, is asked for and can be mended."""
    return findings.where(F.col("problem").isin(FIXABLE)).select("folder", "problem").distinct().join(wanted, ["folder", "problem"], "left_semi")


def edit_comments(comments: Column, field: str, spellings: list[str], value: Column) -> Column:
    """An array of "key=value" with one field set: the first spelling (in upper case) is replaced, others go; a null value removes all."""
    # One pass over the comments, each looked at by itself. Own ones become a bare key, which is an own one wherever it stands;
    # another one at the end gives a new comment its place. Then the value goes before the first, and bare keys go.
    own = F.lit(spellings[0])
    marked = F.concat(F.transform(comments, lambda c: F.when(F.upper(F.substring_index(c, "=", 1)).isin(spellings), own).otherwise(c)), F.array(own))
    return F.array_remove(F.array_insert(marked, F.array_position(marked, own).cast("int"), F.coalesce(F.concat(F.lit(f"{field}="), value), own)), own)


def place(path: Column, volume: Column, batch: Column, hidden: str = ".aside") -> Column:
    """Where a path goes in its volume's hidden folder; null for a path that isn't on the volume."""
    rest = F.substring(path, F.length(volume) + 1, F.length(path))
    return F.when(F.startswith(path, F.concat(volume, F.lit("/"))), F.concat(volume, F.lit(f"/{hidden}/"), batch.cast("string"), rest))


def moves(copies: DataFrame, tracks: DataFrame) -> DataFrame:
    """(folder, path, whole) to set aside for copies (folder, id): the folder itself if the copy is several tracks and all
    that it holds, and no other folder of the library lies below it; else each file. Folders above are looked up by their
    names, folder by folder, so no pair of folders is compared."""
    held = tracks.groupBy("folder").agg(F.count("*").alias("held"))
    parts = F.split("folder", "/")
    above = held.select(F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("folder"))
    above = above.distinct().withColumn("nests", F.lit(True))
    counted = copies.groupBy("folder").agg(F.count("*").alias("n")).join(held, "folder").join(above, "folder", "left")
    whole = counted.select("folder", F.expr("n > 1 and n = held and nests is null").alias("whole"))
    folders = whole.where("whole").select("folder", F.col("folder").alias("path"), "whole")
    return folders.unionByName(copies.join(whole.where("not whole"), "folder").join(tracks.select("id", "path"), "id").select("folder", "path", "whole"))


def batches(log: DataFrame) -> DataFrame:
    """(batch, kind, labels, entries, size): the most common kind, the first seen of equals; the first two different labels
    by id and how many more there are. Labels are counted before any are listed."""
    kinds = log.groupBy("batch", "kind").agg(F.count("*").alias("n"), F.min("id").alias("at")).groupBy("batch").agg(F.min_by("kind", F.struct(-F.col("n"), "at")).alias("kind"))
    labels = log.groupBy("batch", "label").agg(F.min("id").alias("at"))
    first = labels.groupBy("batch").agg(F.min(F.struct("at", "label")).alias("a"), F.count("*").alias("different"))
    second = labels.join(first, "batch").where(F.col("at") > F.col("a.at")).groupBy("batch").agg(F.min(F.struct("at", "label")).alias("b"))
    named = first.join(second, "batch", "left").select("batch", F.concat_ws(", ", "a.label", "b.label", F.when(F.col("different") > 2, F.concat((F.col("different") - 2).cast("string"), F.lit(" more")))).alias("labels"))
    sums = log.groupBy("batch").agg(F.count("*").alias("entries"), F.sum("size").alias("size"))
    return sums.join(kinds, "batch").join(named, "batch").select("batch", "kind", "labels", "entries", "size")
