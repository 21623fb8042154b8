"""Benchmark decontamination by size-partitioned MinHash containment search, in DataFrame functions only.

Words are runs of ASCII letters and digits and of non-ASCII characters, lower-cased; a shingle is five of them in a row,
and a text of fewer words is one shingle. Items are parted by size into classes (1, 2-3, 4-7, ... shingles), and each
class is searched on its own, with a sketch table and two bounds of its own. The sketch of an item with q shingles is its
k least hashes (bottom-k MinHash), k = q - ceil(t q) + 1: whoever holds ceil(t q) of q shingles must hold one of any k of
them, so the search misses nothing at any length of document, where bands of a long document's own minima would miss short
items. The bounds of a class: a shingle of a document is looked up only if its hash isn't above the largest that the class
sketches (large items have small ones, so most shingles are left out), and only in a document that has the t-th part of
the class's least size. Candidates are verified by counting the exact shingles that they share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, free

SHINGLE, THRESHOLD = 5, 0.8
#: Rows up to which a counted table of hashes or keys is broadcast; beyond, it is shuffled.
BROADCAST_ROWS = 500_000
NOT_A_WORD = r"[^a-z0-9\x{80}-\x{10FFFF}]+"


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), NOT_A_WORD), "")


def _runs(of: Column, make, size: int) -> Column:
    """make() of each run of words; the array of no words has none."""
    last = F.greatest(F.size(of) - size + 1, F.lit(1))
    return F.when(F.size(of) > 0, F.transform(F.sequence(F.lit(1), last), lambda i: make(F.slice(of, i, size))))


def hashed(df: DataFrame, text: Column, size: int, *keep: str) -> DataFrame:
    """The kept columns and ``h``, the hashes of the runs of words, null without words. Words are hashed once and these
    hashes are combined; each step is a column of its own, else text would be cut anew for every run."""
    step = df.select(*keep, words(text).alias("_w")).select(*keep, F.transform("_w", lambda x: F.xxhash64(x)).alias("_w"))
    runs, last = F.col("_w"), F.size("_w")
    for k in range(1, size):
        runs = F.zip_with(F.slice(runs, 1, last - k), F.slice("_w", k + 1, last - k), lambda a, b: F.xxhash64(a, b))
    return step.select(*keep, F.when(last >= size, runs).when(last > 0, F.array(F.xxhash64("_w"))).alias("h"))


def small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def _least(size: Column, threshold: float) -> Column:
    """Of that many shingles the fewest that reach the threshold; a hair is taken off, so that 0.8 of 5 isn't over 4."""
    return F.ceil(size * F.lit(threshold) - F.lit(1e-9)).cast("int")


def sketches(items: DataFrame, key: str = "item_id", text: str = "text", threshold: float = THRESHOLD, size: int = SHINGLE) -> DataFrame:
    """(item, mark, class, hash): the sketched hashes of each item with words; ``mark`` is the hash of its text, since a
    key may be repeated, and ``class`` the logarithm of its number of shingles."""
    named = items.where(F.col(key).isNotNull()).select(F.col(key).alias("item"), F.xxhash64(text).alias("mark"), F.col(text).alias("t"))
    runs = hashed(named, F.col("t"), size, "item", "mark").select("item", "mark", F.array_sort(F.array_distinct("h")).alias("h")).where("size(h) > 0")
    kept = F.size("h") - _least(F.size("h"), threshold) + 1
    return runs.select("item", "mark", F.floor(F.log2(F.size("h").cast("double"))).cast("int").alias("class"), F.explode(F.slice("h", F.lit(1), kept)).alias("hash")).distinct()


def candidates(docs: DataFrame, sketch: DataFrame, threshold: float = THRESHOLD, size: int = SHINGLE) -> DataFrame:
    """(doc, of, item, mark) of each pair of a row (doc, of, t) and an item that share a sketched hash, class by class.
    There are as many classes as an item's number of shingles has bits, 31 at most."""
    bounds = sketch.groupBy("class").agg(F.max("hash").alias("top")).orderBy("class").collect()
    classes = F.array(*[F.struct(F.lit(r["class"]).alias("class"), F.lit(r.top).alias("top"), _least(F.lit(1 << r["class"]), threshold).alias("least")) for r in bounds])
    runs = hashed(docs, F.col("t"), size, "doc", "of")
    # explode() would add a filter on h, whose pushdown puts the cutting of the text back into the lambda.
    each = runs.select("doc", "of", F.size("h").alias("n"), F.explode_outer("h").alias("hash")).where(F.col("hash") <= F.lit(max((r.top for r in bounds), default=0)))
    if not bounds:
        return each.limit(0).select("doc", "of", F.lit(None).alias("item"), F.lit(None).cast("long").alias("mark"))
    looked = each.select("doc", "of", "hash", F.explode(F.filter(classes, lambda c: (F.col("hash") <= c["top"]) & (F.col("n") >= c["least"]))["class"]).alias("class"))
    return looked.join(small(sketch), ["class", "hash"]).select("doc", "of", "item", "mark").distinct()


def search(df: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", threshold: float = THRESHOLD, size: int = SHINGLE) -> DataFrame:
    """(key, item_key, n_shared, n_item, containment) of each document that holds the threshold or more of an item's
    distinct shingles, anywhere in its whole text.

    Null texts and texts without words hold nothing and are held by nothing; rows with a null key aren't searched; of a
    repeated key, or a repeated item key, the pair comes once, with its largest containment. Empty tables give an empty
    one. Other columns aren't carried."""
    sketch = checkpointed(sketches(items, item_key, item_text, threshold, size))
    docs = df.where(F.col(key).isNotNull()).select(F.col(key).alias("doc"), F.xxhash64(text).alias("of"), F.col(text).alias("t"))
    found = checkpointed(candidates(docs, sketch, threshold, size))
    joined = lambda run: F.array_join(run, " ")
    # The words are a column of their own: within the lambda, text would be cut anew for every run.
    cut = lambda frame, *keep: frame.select(*keep, words(F.col("t")).alias("w")).select(*keep, F.array_distinct(_runs(F.col("w"), joined, size)).alias("s"))
    wanted = items.where(F.col(item_key).isNotNull()).select(F.col(item_key).alias("item"), F.xxhash64(item_text).alias("mark"), F.col(item_text).alias("t"))
    wanted = wanted.dropDuplicates(["item", "mark"]).join(small(found.select("item", "mark").distinct()), ["item", "mark"], "left_semi")
    wanted = checkpointed(cut(wanted, "item", "mark").select("item", "mark", F.size("s").alias("n_item"), F.explode_outer("s").alias("shingle")).where("shingle is not null"))
    # Rows of one key and one text count once: shingles are distinct before they are counted.
    texts = docs.join(small(found.select("doc", "of").distinct()), ["doc", "of"], "left_semi")
    held = cut(texts, "doc", "of").select("doc", "of", F.explode_outer("s").alias("shingle"))
    shared = held.join(small(wanted), "shingle").join(small(found), ["doc", "of", "item", "mark"], "left_semi")
    counted = shared.groupBy("doc", "of", "item", "mark", "n_item").agg(F.count_distinct("shingle").alias("n_shared"))
    counted = counted.where(F.col("n_shared") >= F.col("n_item") * F.lit(threshold) - F.lit(1e-9))
    best = counted.groupBy("doc", "item").agg(F.max_by(F.struct("n_shared", F.col("n_item").cast("long").alias("n_item")), F.col("n_shared") / F.col("n_item")).alias("s"))
    return best.select(F.col("doc").alias(key), F.col("item").alias(item_key), "s.n_shared", "s.n_item", (F.col("s.n_shared") / F.col("s.n_item")).alias("containment"))


def clean(df: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", by_row: bool = False, **options) -> DataFrame:
    """The rows of ``df`` whose key has no text that holds an item, with all their columns; with ``by_row`` each row is
    judged by its own text, whatever others share its key. Cases as in search(), and rows with a null key stay."""
    if by_row:
        row = free(df, "_row")
        marked = df.withColumn(row, F.when(F.col(key).isNotNull(), F.struct(F.col(key).alias("key"), F.xxhash64(text).alias("mark"))))
        return clean(marked, items, row, text, **options).select(*[F.col(f"`{c}`") for c in df.columns])
    return df.join(search(df, items, key, text, **options).select(key).distinct(), key, "left_anti").select(*[F.col(f"`{c}`") for c in df.columns])
