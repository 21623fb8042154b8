"""Which copy of a group is worth keeping. What a copy is worth is one struct; copies of a group are few, and are put in
order by insertion in an array, since the tolerance of the dynamic range makes the comparison non-transitive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.functions import tracks as fn
from lodestone.operators import duplicates

#: Readings of the dynamic range closer than this are one master; a smaller copy is told by its ratio from here.
DR_STEP, TOLD_RATIO = 2.0, 1.2


def merits(tracks: DataFrame, *copy: str) -> DataFrame:
    """The copy's columns and ``merit``: damaged, source, tracks, resolution, dr, tags, size, path, fake, name. A track that
    a copy holds twice (the same disc and number, or path where it has none) counts once, the first by name, id and size."""
    once = Window.partitionBy(*copy, F.when(F.col("track") > 0, F.concat_ws("/", F.col("disc").cast("string"), F.col("track").cast("string"))).otherwise(F.col("path"))).orderBy("disc", "track", F.lower(fn.file_name()), "id", "size")
    first = tracks.select("*", F.row_number().over(once).alias("_n")).where("_n = 1")
    tagged = "title is not null and artist is not null and album is not null and track > 0"
    worth = first.groupBy(*copy).agg(
        F.count_if(fn.has(fn.DAMAGED)).alias("damaged"), F.min(fn.source_class()).alias("source"), F.count("*").alias("tracks"), F.min(fn.resolution()).alias("resolution"), F.avg("dr").alias("dr"),
        (F.count_if(F.expr(tagged)) + F.count_if(F.expr("pictures > 0"))).alias("tags"), F.sum("size").alias("size"), F.max(fn.has(fn.UPSAMPLED | fn.PADDED)).alias("fake"),
    )
    name = copy[-1]
    return worth.select(*copy, F.struct("damaged", "source", "tracks", "resolution", "dr", "tags", "size", fn.path_score(name).alias("path"), "fake", F.col(name).alias("name")).alias("merit"))


def _dynamic(a: Column, b: Column) -> Column:
    return F.coalesce(F.abs(a["dr"] - b["dr"]) >= DR_STEP, F.lit(False))


def before(a: Column, b: Column) -> Column:
    """Whether copy a is the better one."""
    differ = lambda field: a[field] != b[field]
    return (
        F.when(differ("damaged"), a["damaged"] < b["damaged"]).when(differ("source"), a["source"] > b["source"]).when(differ("tracks"), a["tracks"] > b["tracks"])
        .when(differ("resolution"), a["resolution"] > b["resolution"]).when(_dynamic(a, b), a["dr"] > b["dr"]).when(differ("tags"), a["tags"] > b["tags"])
        .when(differ("size"), a["size"] < b["size"]).otherwise(a["path"] > b["path"])
    )


def ranked(worth: DataFrame, *group: str) -> DataFrame:
    """The group's columns and ``order``: an array of merits, the best first. Copies are inserted in the order of their names,
    each behind the last one that it isn't better than."""
    gathered = worth.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct(F.col("merit.name").alias("n"), "merit"))).alias("m"))
    one = worth.schema["merit"].dataType.simpleString()
    place = lambda out, m: F.coalesce(F.array_max(F.transform(out, lambda x, i: F.when(before(m, x), 0).otherwise(i + 1))), F.lit(0))

    def insert(out, m):
        at = place(out, m["merit"])
        return F.concat(F.slice(out, F.lit(1), at), F.array(m["merit"]), F.slice(out, at + 1, F.size(out) - at))

    return gathered.select(*group, F.aggregate("m", F.array().cast(f"array<{one}>"), insert).alias("order"))


def places(order: DataFrame, *group: str) -> DataFrame:
    return order.select(*group, F.posexplode("order").alias("place", "m")).select(*group, "place", F.col("m.name").alias("name"))


def user_pick(placed: DataFrame, picks: DataFrame, *group: str) -> DataFrame:
    """(group, place, name): a pick (group, name) that is in its group comes first, the others keep their order. Of several
    picks of a group the least name counts."""
    chosen = picks.groupBy(*group).agg(F.min("name").alias("_pick"))
    order = Window.partitionBy(*group).orderBy(F.coalesce(F.col("name") != F.col("_pick"), F.lit(True)), "place")
    return placed.join(chosen, list(group), "left").select(*group, (F.row_number().over(order) - 1).alias("place"), "name")


def reasons(order: DataFrame, *group: str) -> DataFrame:
    """(group, reason, ratio): the criterion that decided between the first two copies; the ratio of sizes where the other
    copy only pretends to hold more."""
    best, other = F.col("order")[0], F.col("order")[1]
    differ = lambda field: best[field] != other[field]
    ratio = other["size"] / best["size"]
    told = other["fake"] & (ratio >= TOLD_RATIO)
    reason = (
        F.when(differ("damaged"), "undamaged").when(differ("source"), F.when(other["source"] == 0, "lossless").otherwise("real_lossless")).when(differ("tracks"), "complete")
        .when(differ("resolution"), "resolution").when(_dynamic(best, other), "dynamic").when(differ("tags"), "tags").when(differ("size"), F.when(told, "same_smaller").otherwise("smaller")).otherwise("path")
    )
    return order.where("size(order) > 1").select(*group, reason.alias("reason"), F.round(F.when(reason == "same_smaller", ratio), 6).alias("ratio"))


def group_kinds(labels: DataFrame, kinds: DataFrame, default: int) -> DataFrame:
    """(root, kind): the weakest evidence of a group's members."""
    return labels.join(kinds, "id", "left").groupBy("root").agg(F.coalesce(F.max("kind"), F.lit(default)).alias("kind"))


def album_links(pairs: DataFrame, tracks: DataFrame) -> DataFrame:
    """(a, b) of folders that have two tracks and four fifths of the smaller one in common."""
    sizes = tracks.groupBy("folder").agg(F.count("*").alias("n"))
    one, two = sizes.select(F.col("folder").alias("f1"), F.col("n").alias("n1")), sizes.select(F.col("folder").alias("f2"), F.col("n").alias("n2"))
    return pairs.where("matched >= 2").join(one, "f1").join(two, "f2").where("5 * matched >= 4 * least(n1, n2)").select(F.col("f1").alias("a"), F.col("f2").alias("b"))


def across(tracks: DataFrame, labels: DataFrame, albums: DataFrame) -> DataFrame:
    """(root, units, other_release): groups that reach over several units, a unit being a group of album copies or else a
    folder. One track stands for each unit, the best; it is another release unless all of them name one album.

    albums: (folder, album_root)."""
    mine = labels.join(tracks, "id").join(albums, "folder", "left")
    mine = mine.withColumn("unit", F.coalesce(F.concat(F.lit("group:"), F.col("album_root")), F.col("folder")))
    best = ranked(merits(mine, "root", "unit", "path"), "root", "unit").select("root", "unit", F.col("order")[0]["name"].alias("path"))
    named = best.join(mine.select("root", "unit", "path", "album"), ["root", "unit", "path"]).withColumn("key", fn.norm_key(F.col("album")))
    counted = named.groupBy("root").agg(F.count("*").alias("units"), F.count("key").alias("known"), F.count_distinct("key").alias("keys")).where("units > 1")
    return counted.select("root", "units", F.expr("not (known = units and keys = 1)").alias("other_release"))


def ordered_groups(groups: DataFrame) -> DataFrame:
    """(root, other_release, reclaimable) with ``place``: other releases last, what gives back most first, then the root."""
    return groups.orderBy("other_release", F.desc("reclaimable"), "root")


def grouped_albums(tracks: DataFrame, labels: DataFrame) -> DataFrame:
    """(folder, album_root) of folders that are copies of each other."""
    links = album_links(duplicates.folder_pairs(tracks, labels), tracks)
    return duplicates.components(links).select(F.col("id").alias("folder"), F.col("root").alias("album_root"))
