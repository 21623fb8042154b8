"""Incremental diffs and copy-on-write changes of the track store, as frame to frame functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def changed(found: DataFrame, stamps: DataFrame) -> DataFrame:
    """Files that are new or whose size or time differ."""
    return found.join(stamps.select("path", "size", "modified"), ["path", "size", "modified"], "left_anti")


def gone(found: DataFrame, stamps: DataFrame, roots: list[str]) -> DataFrame:
    """Stamped files that are absent although their root was walked; unmounted roots keep theirs."""
    under = F.lit(False)
    for root in roots:
        under = under | F.col("path").startswith(root.rstrip("/") + "/")
    return stamps.where(under).join(found.select("path"), "path", "left_anti")


def hash_candidates(tracks: DataFrame) -> DataFrame:
    """Tracks without a hash that share their exact size with another one. Sizes are counted with partial sums first."""
    shared = tracks.groupBy("size").agg(F.count("*").alias("n")).where("n > 1").select("size")
    return tracks.where("hash is null").join(shared, "size", "left_semi")


def sample_hash(content: Column, piece: int = 65536) -> Column:
    """MD5 over the start, the middle and the end, each clamped to what there is."""
    size = F.length(content)
    at = lambda start: F.substring(content, F.greatest(start, F.lit(0)).cast("int") + 1, F.lit(piece))
    return F.md5(F.concat(at(F.lit(0)), at(F.floor(size / 2) - piece // 2), at(size - piece)))


def upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows replaced by path: a changed file loses its features, hash and accepted mask."""
    return old.join(new.select("path"), "path", "left_anti").unionByName(new, allowMissingColumns=True)


def accept(tracks: DataFrame, ids: DataFrame, mask: int, on: bool) -> DataFrame:
    bits = F.col("accepted").bitwiseOR(F.lit(mask)) if on else F.col("accepted").bitwiseAND(F.lit(~mask))
    marked = tracks.join(ids.select(F.col("id"), F.lit(True).alias("_hit")).distinct(), "id", "left")
    return marked.withColumn("accepted", F.when(F.col("_hit"), bits).otherwise(F.col("accepted"))).drop("_hit")


def delete_cascade(tracks: DataFrame, edges: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    left = edges.join(ids.select(F.col("id").alias("a")), "a", "left_anti").join(ids.select(F.col("id").alias("b")), "b", "left_anti")
    return tracks.join(ids, "id", "left_anti"), left.select("a", "b", "kind")


def relocate(tracks: DataFrame, old: str, new: str) -> DataFrame:
    """Paths at or under ``old`` move to ``new``; the prefix is exact, without wild cards."""
    under = (F.col("path") == old) | F.col("path").startswith(old + "/")
    moved = F.concat(F.lit(new), F.expr(f"substring(path, {len(old) + 1})"))
    return tracks.withColumn("quarantined", under).withColumn("path", F.when(under, moved).otherwise(F.col("path")))


def header_update(store: DataFrame, new: DataFrame, fields: list[str]) -> DataFrame:
    """Tag columns of the ids in ``new`` replaced, their hash unknown again; other columns stay."""
    came = new.select("id", F.lit(True).alias("_came"), *[F.col(f).alias(f"_{f}") for f in fields])
    joined = store.join(came, "id", "left")
    put = {f: F.when(F.col("_came"), F.col(f"_{f}")).otherwise(F.col(f)) for f in fields} | {"hash": F.when(F.col("_came").isNull(), F.col("hash"))}
    return joined.withColumns(put).select(*store.columns)


def deep_update(store: DataFrame, new: DataFrame, fields: list[str]) -> DataFrame:
    """Columns of the ids in ``new`` replaced, what isn't a finite number by null."""
    finite = lambda f: F.when(~F.col(f"_{f}").isin(float("nan"), float("inf"), float("-inf")), F.col(f"_{f}")) if dict(new.dtypes)[f] in ("double", "float") else F.col(f"_{f}")
    joined = store.join(new.select("id", F.lit(True).alias("_came"), *[F.col(f).alias(f"_{f}") for f in fields]), "id", "left")
    return joined.withColumns({f: F.when(F.col("_came"), finite(f)).otherwise(F.col(f)) for f in fields}).select(*store.columns)


def quarantine(tracks: DataFrame, batch, kind: int) -> DataFrame:
    """Log entries (id, batch, original, moved, size, kind) of tracks that are set aside."""
    return tracks.select("id", batch.alias("batch"), F.col("path").alias("original"), F.concat(F.lit("/.aside/"), batch.cast("string"), F.col("path")).alias("moved"), "size", F.lit(kind).alias("kind"))


def restore(store: DataFrame, log: DataFrame) -> DataFrame:
    """The store's paths with what the log moved back in its place; of several entries of a moved path the last one counts, by
    id where the log has one."""
    last = F.max_by("original", "id") if "id" in log.columns else F.max("original")
    back = log.groupBy(F.col("moved").alias("path")).agg(last.alias("original"))
    return store.join(back, "path", "left").withColumn("path", F.coalesce("original", "path")).select(*store.columns)


def emptied(store: DataFrame, log: DataFrame) -> DataFrame:
    """The store without rows at a moved path or below one. Each row's own folders are looked up, so no row meets every entry."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    gone = store.select("path", F.explode(above).alias("moved")).join(log.select("moved").distinct(), "moved", "left_semi").select("path").distinct()
    return store.join(gone, "path", "left_anti").select(*store.columns)


def migrate(store: DataFrame, defaults: dict) -> DataFrame:
    """Columns that the store lacks, with their defaults."""
    return store.withColumns({name: F.lit(value) for name, value in defaults.items() if name not in store.columns})


def replace_table(df: DataFrame, path: str) -> DataFrame:
    """The table at the path, replaced as a whole. ``df`` mustn't read that path."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)
