"""Albums (tracks by folder), their aggregates, lint rules and views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.functions import tracks as fn
from lodestone.operators.duplicates import checkpointed


def mode_first(df: DataFrame, group: str, value: Column, name: str, order: tuple[str, ...] = ("disc", "track", "path")) -> DataFrame:
    """The commonest value of each group; of equally common ones the one that comes first. Nulls don't count. Counted
    before the shuffle, and the winner is an aggregate too, so a large group needs no window."""
    seen = df.select(group, value.alias("_v"), F.struct(*order).alias("_at")).where("_v is not null").groupBy(group, "_v").agg(F.count("*").alias("_n"), F.min("_at").alias("_at"))
    return seen.groupBy(group).agg(F.min(F.struct((-F.col("_n")).alias("n"), F.col("_at").alias("at"), F.col("_v").alias("v"))).alias("_b")).select(group, F.col("_b.v").alias(name))


def summary(tracks: DataFrame) -> DataFrame:
    return tracks.groupBy("folder").agg(
        F.count("*").alias("tracks"), F.sum("size").alias("size"), F.sum("duration_ms").alias("duration_ms"), F.bit_or("issues").alias("issues"),
        F.bool_and(F.col("deep_version") > 0).alias("analysed"), F.round(F.avg("dr"), 6).alias("dr"),
    )


def titles(tracks: DataFrame) -> DataFrame:
    named = mode_first(tracks, "folder", F.col("album"), "title")
    return tracks.select("folder").distinct().join(named, "folder", "left").select("folder", F.coalesce("title", fn.file_name("folder")).alias("title"))


def artists(tracks: DataFrame) -> DataFrame:
    named = mode_first(tracks, "folder", F.col("album_artist"), "own")
    each = tracks.groupBy("folder").agg(F.countDistinct("artist").alias("n"), F.min("artist").alias("one"))
    parent = F.substring_index(F.expr("substring(folder, 1, length(folder) - length(substring_index(folder, '/', -1)) - 1)"), "/", -1)
    return each.join(named, "folder", "left").select("folder", F.coalesce("own", F.when(F.col("n") > 1, "various").otherwise(F.col("one")), parent).alias("artist"))


def issue_counts(tracks: DataFrame) -> DataFrame:
    """(folder, issue, open): tracks of each album with an issue that is still open."""
    found = tracks.select("folder", F.explode(F.array(*[F.struct(F.lit(n).alias("issue"), fn.has(b, fn.open_mask()).alias("open")) for n, b in fn.ISSUES.items()])).alias("x"))
    return found.where("x.open").groupBy("folder", F.col("x.issue").alias("issue")).agg(F.count("*").alias("open"))


def no_cover(tracks: DataFrame, covers: DataFrame) -> DataFrame:
    return tracks.groupBy("folder").agg(F.max("pictures").alias("p"), F.count("*").alias("tracks")).where("p = 0").drop("p").join(covers.select("folder").distinct(), "folder", "left_anti")


def heavy_cover(tracks: DataFrame) -> DataFrame:
    heavy = tracks.where("picture_bytes > 1000000 or greatest(picture_w, picture_h) > 1600")
    first = F.min(F.struct((-F.col("picture_bytes")).alias("b"), "disc", "track", "path", "picture_w", "picture_h"))
    return heavy.groupBy("folder").agg(first.alias("f"), F.count("*").alias("tracks"), F.sum("picture_bytes").alias("total")).select("folder", (-F.col("f.b")).alias("biggest"), F.col("f.picture_w").alias("w"), F.col("f.picture_h").alias("h"), "tracks", "total")


def split(tracks: DataFrame) -> DataFrame:
    each = tracks.groupBy("folder").agg(F.count("*").alias("tracks"), F.countDistinct("album").alias("albums"), F.countDistinct("album_artist").alias("album_artists"), F.countDistinct("artist").alias("artists"), F.count_if(F.col("album_artist").isNull()).alias("missing"))
    return each.where("tracks >= 2 and albums <= 3 and (albums > 1 or album_artists > 1 or (artists > 1 and missing > 0 and albums = 1))")


def missing_tags(tracks: DataFrame) -> DataFrame:
    lack = {"title": "title is null", "artist": "artist is null", "album": "album is null", "number": "track = 0"}
    each = tracks.groupBy("folder").agg(F.count("*").alias("tracks"), *[F.count_if(F.expr(c)).alias(f"no_{n}") for n, c in lack.items()])
    return each.where("no_title + no_artist + no_album + no_number > 0")


def incomplete(tracks: DataFrame) -> DataFrame:
    """Numbers come down to distinct ones a disc before they are counted, so a large folder is no large group."""
    numbers = tracks.groupBy("folder", "disc", "track").agg(F.count("*").alias("n"), F.max("track_total").alias("t"), F.count_if(F.col("track") == 0).alias("z"))
    discs = numbers.groupBy("folder", "disc").agg(F.sum("n").alias("n"), F.sum("z").alias("z"), F.greatest(F.max("t"), F.max("track")).alias("want"), F.max("t").alias("t"), F.count_if(F.col("track") >= 1).alias("have"))
    counted = F.when((F.col("n") == 1) & (F.col("t") == 0), F.lit(0))
    sums = discs.groupBy("folder").agg(F.sum("z").alias("z"), F.sum(counted.otherwise(F.col("have"))).alias("have"), F.sum(counted.otherwise(F.col("want"))).alias("want"))
    return sums.where("z = 0 and want > 0 and have < want and want <= 99").select("folder", "have", "want")


def lint_all(tracks: DataFrame, covers: DataFrame) -> DataFrame:
    """(folder, problem), problems numbered in their fixed order: one aggregate by folder, disc and number, and one by
    folder of what came of it. Of the values that may be split only four of a folder are kept, as no rule asks for more."""
    distinct = lambda c: F.array_distinct(F.flatten(F.collect_list(c)))
    numbers = tracks.groupBy("folder", "disc", "track").agg(
        F.count("*").alias("n"), F.max("track_total").alias("t"), F.max("pictures").alias("p"), F.max(F.expr("picture_bytes > 1000000 or greatest(picture_w, picture_h) > 1600")).alias("heavy"),
        *[F.slice(F.collect_set(c), 1, 4).alias(c) for c in ("album", "album_artist", "artist")], F.count_if(F.col("album_artist").isNull()).alias("missing"),
        F.count_if(F.expr("title is null or artist is null or album is null or track = 0")).alias("lacking"),
    )
    discs = numbers.groupBy("folder", "disc").agg(
        F.sum("n").alias("n"), F.sum(F.expr("if(track = 0, n, 0)")).alias("z"), F.greatest(F.max("t"), F.max("track")).alias("want"), F.max("t").alias("t"), F.count_if(F.col("track") >= 1).alias("have"),
        F.max("p").alias("p"), F.max("heavy").alias("heavy"), *[F.slice(distinct(c), 1, 4).alias(c) for c in ("album", "album_artist", "artist")], F.sum("missing").alias("missing"), F.sum("lacking").alias("lacking"),
    )
    counted = F.when((F.col("n") == 1) & (F.col("t") == 0), F.lit(0))
    folders = discs.groupBy("folder").agg(
        F.sum("n").alias("n"), F.sum("z").alias("z"), F.sum(counted.otherwise(F.col("have"))).alias("have"), F.sum(counted.otherwise(F.col("want"))).alias("want"),
        F.max("p").alias("p"), F.max("heavy").alias("heavy"), *[F.size(distinct(c)).alias(c) for c in ("album", "album_artist", "artist")], F.sum("missing").alias("missing"), F.sum("lacking").alias("lacking"),
    )
    covered = covers.select("folder").distinct().withColumn("covered", F.lit(True))
    rules = {
        "no_cover": "p = 0 and covered is null", "heavy_cover": "heavy", "split": "n >= 2 and album <= 3 and (album > 1 or album_artist > 1 or (artist > 1 and missing > 0 and album = 1))",
        "missing_tags": "lacking > 0", "incomplete": "z = 0 and want > 0 and have < want and want <= 99",
    }
    found = F.array(*[F.when(F.expr(r), F.struct(F.lit(name).alias("problem"), F.lit(i).alias("place"))) for i, (name, r) in enumerate(rules.items())])
    return folders.join(covered, "folder", "left").select("folder", F.explode(F.array_compact(found)).alias("f")).select("folder", "f.problem", "f.place")


def ordered(tracks: DataFrame) -> DataFrame:
    """(folder, id, place): disc, number and file name give the place; albums are bounded by their folder."""
    order = Window.partitionBy("folder").orderBy("disc", "track", F.lower(fn.file_name()), "id")
    return tracks.select("folder", "id", F.row_number().over(order).alias("place"))


def badges(tracks: DataFrame, most: int = 3) -> DataFrame:
    """(folder, issue, count): the first three findings of an album that are open, "all" where every track has it."""
    order = F.create_map(*[x for i, name in enumerate(fn.ISSUES) for x in (F.lit(name), F.lit(i))])
    sizes = tracks.groupBy("folder").agg(F.count("*").alias("n"))
    found = issue_counts(tracks).join(sizes, "folder").withColumn("at", order[F.col("issue")])
    listed = found.groupBy("folder").agg(F.slice(F.array_sort(F.collect_list(F.struct("at", "issue", F.when(F.col("open") == F.col("n"), "all").otherwise(F.col("open").cast("string")).alias("count")))), 1, most).alias("b"))
    return listed.select("folder", F.explode("b").alias("b")).select("folder", "b.issue", "b.count")


def by_artist(listed: DataFrame) -> DataFrame:
    """(folder, place) by artist, title and folder, without case. Artists are dealt to ranges, and only the number of albums
    of each range goes through the driver; albums are placed within their artist."""
    rows = listed.select("folder", F.lower("artist").alias("a"), F.lower("title").alias("t"))
    ranged = checkpointed(rows.groupBy("a").agg(F.count("*").alias("n")).repartitionByRange(F.col("a").asc_nulls_first()).withColumn("p", F.spark_partition_id()))
    before, first = 0, [F.lit(-1), F.lit(0).cast("long")]
    for r in ranged.groupBy("p").agg(F.sum("n").alias("n")).orderBy("p").collect():
        first += [F.lit(r.p), F.lit(before).cast("long")]
        before += r.n
    order = Window.partitionBy("p").orderBy(F.col("a").asc_nulls_first())
    started = ranged.select("a", (F.create_map(*first)[F.col("p")] + F.sum("n").over(order) - F.col("n")).alias("start"))
    joined = rows.join(started.withColumnRenamed("a", "b"), F.col("a").eqNullSafe(F.col("b")))
    return joined.select("folder", (F.col("start") + F.row_number().over(Window.partitionBy("a").orderBy("t", "folder"))).alias("place"))


def siblings(listed: DataFrame) -> DataFrame:
    """(folder, sibling): folders beside an album that hold the same title, without case."""
    named = listed.where("title is not null").select("folder", F.regexp_replace("folder", "/[^/]*$", "").alias("parent"), F.lower("title").alias("t"))
    many = named.groupBy("parent", "t").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    kept = named.join(many, ["parent", "t"])
    return kept.alias("x").join(kept.alias("y"), F.expr("x.parent = y.parent and x.t = y.t and x.folder <> y.folder")).select(F.expr("x.folder").alias("folder"), F.expr("y.folder").alias("sibling"))


def issue_filter(tracks: DataFrame, chosen: int | None, mask: int) -> DataFrame:
    """(folder, flagged) of the albums shown for a chosen finding of the mask, with their flagged tracks; where no album has
    it any more, those of the whole mask."""
    opened = tracks.select("folder", fn.open_mask().bitwiseAND(F.lit(mask)).alias("o")).where("o <> 0")
    if chosen is not None and opened.where(fn.has(chosen, "o")).limit(1).count():
        opened = opened.where(fn.has(chosen, "o"))
    return opened.groupBy("folder").agg(F.count("*").alias("flagged"))


def copies(tracks: DataFrame) -> DataFrame:
    """(folder, copy): another folder with the same title and artist, without case: the least one, for that one the largest.
    Groups are joined with their ends, not with themselves."""
    named = tracks.groupBy("folder").agg(F.lower(F.max("album")).alias("t"), F.lower(F.max("album_artist")).alias("a")).where("t is not null and a is not null")
    ends = named.groupBy("t", "a").agg(F.min("folder").alias("one"), F.max("folder").alias("last")).where("one <> last")
    return named.join(ends, ["t", "a"]).select("folder", F.when(F.col("folder") == F.col("one"), F.col("last")).otherwise(F.col("one")).alias("copy"))
