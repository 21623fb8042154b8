"""Duplicates: tiers of evidence between tracks, connected groups, and what they could give back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import tracks as fn

IDENTICAL, SAME_AUDIO, SAME_RECORDING, SAME_TITLE = range(4)


def star(tracks: DataFrame, keys: list[str], kind: int) -> DataFrame:
    """Edges from the least id of each key to its other members. The least id is an aggregate with partial sums, and
    single members are left out before the join, so a key with very many members only splits a join partition."""
    known = tracks.where(" and ".join(f"{k} is not null" for k in keys)).select(*keys, "id")
    first = known.groupBy(*keys).agg(F.min("id").alias("a"), F.count("*").alias("n")).where("n > 1").drop("n")
    return known.join(first, keys).where("id <> a").select("a", F.col("id").alias("b"), F.lit(kind).alias("kind"))


def same_title(tracks: DataFrame, most: int = 12, tolerance_ms: int = 2000) -> DataFrame:
    """All pairs of 2 to ``most`` tracks of one title and artist, both known, whose lengths differ by the tolerance at most.
    Larger groups are no evidence, by definition; their size is counted before any pair is made. Where there is a column
    ``printed``, pairs of which both have a fingerprint are left to the fingerprints."""
    printed = F.col("printed") if "printed" in tracks.columns else F.lit(False)
    named = tracks.where("title is not null and artist is not null").select("id", "duration_ms", printed.alias("printed"), F.struct(fn.norm_key(F.col("artist")), fn.norm_key(F.col("title"))).alias("k"))
    sized = named.groupBy("k").agg(F.count("*").alias("n")).where(f"n between 2 and {most}").select("k")
    kept = named.join(sized, "k")
    pairs = kept.alias("x").join(kept.alias("y"), F.expr(f"x.k = y.k and x.id < y.id and abs(x.duration_ms - y.duration_ms) <= {tolerance_ms} and not (x.printed and y.printed)"))
    return pairs.select(F.expr("x.id").alias("a"), F.expr("y.id").alias("b"), F.lit(SAME_TITLE).alias("kind"))


def union_edges(*edges: DataFrame) -> DataFrame:
    """Strongest evidence for each unordered pair."""
    both = edges[0]
    for e in edges[1:]:
        both = both.unionByName(e)
    return both.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min("kind").alias("kind"))


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut, in files of the shared folder: that of spark.checkpoint.dir; a local session without one
    gets a folder of its warehouse."""
    spark = df.sparkSession
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir isn't set")
        context.setCheckpointDir(folder or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints")
    return df.checkpoint(eager=True)


def components(edges: DataFrame, most_rounds: int = 50) -> DataFrame:
    """(id, root): least id that each track is connected with. Large and small stars take turns; a round's edges are no more
    than those before, and are checkpointed. Raises if the rounds run out."""
    edges = checkpointed(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    for _ in range(most_rounds):
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("a").alias("id"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct())
        before = now
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        edges = checkpointed(small.where("a <> b").distinct())
    raise RuntimeError("groups did not settle")


def track_kinds(edges: DataFrame) -> DataFrame:
    ends = edges.select(F.explode(F.array("a", "b")).alias("id"), "kind")
    return ends.groupBy("id").agg(F.min("kind").alias("kind"))


def reclaimable(tracks: DataFrame, labels: DataFrame) -> DataFrame:
    """(root, copies, size, reclaimable): the least id of a group is kept, and the sizes of the others could go."""
    grouped = labels.join(tracks.select("id", "size"), "id").groupBy("root").agg(F.count("*").alias("copies"), F.sum("size").alias("size"), F.min_by("size", "id").alias("kept"))
    return grouped.select("root", "copies", "size", (F.col("size") - F.col("kept")).alias("reclaimable"))


def folder_pairs(tracks: DataFrame, labels: DataFrame) -> DataFrame:
    """(f1, f2, matched): tracks that two folders have in common, component by component. Counted by folder first, so a
    component with many members makes pairs of folders and not of tracks."""
    counts = labels.join(tracks.select("id", "folder"), "id").groupBy("root", "folder").agg(F.count("*").alias("n"))
    pairs = counts.alias("x").join(counts.alias("y"), F.expr("x.root = y.root and x.folder < y.folder"))
    return pairs.groupBy(F.expr("x.folder").alias("f1"), F.expr("y.folder").alias("f2")).agg(F.sum(F.expr("least(x.n, y.n)")).alias("matched"))
