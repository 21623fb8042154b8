"""Jaccard self-join on word n-grams: MinHash banding, verified on the full sets.

Words are runs of ASCII letters and digits and of non-ASCII characters, lower-cased. A document is the set of the hashes
of its runs of five words; one of fewer words is one such run. Documents with equal sets are one unit, of which one
document goes on. Units that share the hash of a band (a bucket) are candidates, verified on the full sets.

A pair may share many buckets. So of each part of units that buckets connect, the cheapest of three ways is taken: all
pairs of fitting sizes within the part; the pairs of each bucket, counted in the first band that they share; or, for a
large bucket, the pairs that share a second one too, counted in the first two bands that they share. True copies share
most buckets and go the first way; texts that only have some boilerplate in common share few and go the others, for a
part as a whole would be the square of what its buckets are. The number of bands is such that a pair at the threshold
shares two with the wanted recall. Either way a group is cut into blocks of BLOCK units. Per unit only its number of links
and one connection come out, so no step's rows grow with the square of a group.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, map_rows

SHINGLE, THRESHOLD = 5, 0.8
#: The chance that a pair at the threshold shares two bands, and the rows of a band; the bands follow.
RECALL, BAND_ROWS = 0.99999, 6
#: Units in a block of a large group. Rows up to which a table of ids is broadcast, and bytes of one of tasks.
BLOCK, BROADCAST_ROWS, BROADCAST_BYTES = 128, 500_000, 32 << 20
#: Distinct hashes of a block that are multiplied at once.
COLUMNS = 2048
#: Rows from which a key may be a hot one, and hot keys at most: those are joined by a broadcast.
HOT, HOT_KEYS = 1000, 10_000
#: Edges from which nodes with many different least neighbours are looked for.
LARGE = 1_000_000
#: Edges that a task of a round writes at least, where there are that many.
TASK_EDGES = 10_000
_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def bands_for(recall: float = RECALL, threshold: float = THRESHOLD, rows: int = BAND_ROWS) -> int:
    one, bands = threshold**rows, 2
    while (1 - one) ** bands + bands * one * (1 - one) ** (bands - 1) > 1 - recall:
        bands += 1
    return bands


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(1 << 14, 1 << (n - 1).bit_length())
        inverse = np.uint64(pow(int(_P), -1, 1 << 64))
        with np.errstate(over="ignore"):
            _POWERS[:] = [np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)]).cumprod(dtype=np.uint64) for b in (_P, inverse)]
    return _POWERS[0][:n], _POWERS[1][:n]


def shingles(text: str, size: int = SHINGLE) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the runs of ``size`` words of the whole text."""
    data = _LOWER[np.frombuffer(text.lower().encode(), np.uint8)]
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = _WORD[data]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64)
    powers, inverses = _powers(len(data) + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[:-1], out=sums[1:])
        words = mixed((sums[ends] - sums[starts]) * inverses[starts] + (ends - starts).astype(np.uint64))
        size = min(size, len(words))
        runs = np.full(len(words) - size + 1, size, np.uint64)
        for k in range(size):
            runs = runs * _P + words[k : k + len(runs)]
        return np.unique(mixed(runs))


class Banding:
    def __init__(self, bands: int, rows: int, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.bands, self.rows = bands, rows
        self.a = rng.integers(0, 1 << 31, bands * rows).astype(np.uint32) * np.uint32(2) + np.uint32(1)
        self.b = rng.integers(0, 1 << 32, bands * rows).astype(np.uint32)
        self.weights = rng.integers(0, 1 << 62, rows).astype(np.uint64) * np.uint64(2) + np.uint64(1)

    def signature(self, hashes: np.ndarray) -> np.ndarray:
        x = (hashes >> np.uint64(32)).astype(np.uint32)
        best = np.full(len(self.a), 0xFFFFFFFF, np.uint32)
        step = 1024
        for at in range(0, len(x), step):
            moved = x[at : at + step] * self.a[:, None]
            moved += self.b[:, None]
            np.minimum(best, moved.min(1), out=best)
        return best

    def hashes(self, hashes: np.ndarray) -> np.ndarray:
        """One 64-bit number a band, different for different bands."""
        rows = self.signature(hashes).reshape(self.bands, self.rows).astype(np.uint64)
        with np.errstate(over="ignore"):
            return mixed((rows * self.weights).sum(1, dtype=np.uint64) + np.arange(1, self.bands + 1, dtype=np.uint64) * _P)


def unit_of(hashes: np.ndarray) -> int:
    """A 64-bit number of the set."""
    with np.errstate(over="ignore"):
        whole = mixed(np.array([mixed(hashes ^ _P).sum(dtype=np.uint64) + np.uint64(len(hashes))]))
    return int(whole.view(np.int64)[0])


def looked_up(rows: DataFrame, table: DataFrame, keys: list[str], total: int) -> DataFrame:
    """``rows`` joined with the one row of ``table`` for their key, whose ``n`` is the number of rows with that key, of
    ``total`` or fewer. A key with more than total / HOT_KEYS rows is hot; there are at most HOT_KEYS of these, so they
    are broadcast, and no task gets all rows of a hot key."""
    bound = max(HOT, total // HOT_KEYS)
    hot = table.where(F.col("n") > bound)
    if total <= bound or not hot.limit(1).count():
        return rows.join(table, keys)
    cold = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(table.where(F.col("n") <= bound), keys)
    return rows.join(F.broadcast(hot), keys).unionByName(cold)


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) of every node of the (a, b) edges: root is the least node of its part. Alternates large and small
    stars; each round's edges are no more than those before, and are checkpointed. The center of a large star is a hot
    key. Raises if rounds run out."""
    edges = checkpointed(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    stats = lambda: edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    least = lambda of: of.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    before = stats()
    for _ in range(most_rounds if before[0] else 0):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = looked_up(both.where("b > a"), least(both), ["a"], 2 * before[0])
        large = near.select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
        # Few of the least nodes beside a node differ; to look for hot ones pays in large graphs only.
        near = looked_up(large, least(large), ["a"], before[0]) if before[0] > LARGE else large.join(least(large), "a")
        small = near.select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        # Edges get no more, so that few tasks do for few of them.
        edges = checkpointed(small.where("a != b").distinct().coalesce(1 + before[0] // TASK_EDGES))
        now = stats()
        if now == before:
            break
        before = now
    else:
        if before[0]:
            raise RuntimeError("connected parts did not settle")
    # Stars only: every node has its root, and roots are added.
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _first_shared(bands: np.ndarray, first: int, second: int) -> np.ndarray:
    """Which pairs share ``first`` and no band before it, and if there is a ``second``, that as the next one."""
    alike = np.equal.outer(bands[:, first], bands[:, first])
    for k in range(max(first, second)):
        if k != first:
            alike &= np.not_equal.outer(bands[:, k], bands[:, k])
    if second >= 0:
        alike &= np.equal.outer(bands[:, second], bands[:, second])
    np.fill_diagonal(alike, False)
    return alike


def _verified(rows: list[tuple], threshold: float):
    """(unit, linked documents, least linked unit) of the pairs within, or of those between the two sides; in a bucket
    only of the pairs that are counted there."""
    units, (first, second) = [r[0] for r in rows], rows[0][4:6]
    counted = _first_shared(np.stack([np.frombuffer(r[6], np.int64) for r in rows]), first, second) if first >= 0 else np.ones((1, 1), bool)
    if not counted.any():
        return []
    sides = np.array([r[1] for r in rows])
    copies = np.array([r[2] for r in rows], np.int64)
    sets = [np.frombuffer(r[3], np.uint64) for r in rows]
    sizes = np.array([len(s) for s in sets], np.int64)
    hashes = np.concatenate(sets)
    owners = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(hashes, kind="stable")
    hashes, owners = hashes[order], owners[order]
    start = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]])) if len(hashes) else np.zeros(0, int)
    count = np.diff(np.append(start, len(hashes)))
    ids = np.repeat(np.cumsum(count > 1) - 1, count)
    shared = np.repeat(count > 1, count)
    ids, owners = ids[shared], owners[shared]
    common = np.zeros((len(sets), len(sets)), np.float32)
    for first in range(0, int(ids[-1]) + 1 if len(ids) else 0, COLUMNS):
        a, b = np.searchsorted(ids, (first, first + COLUMNS))
        table = np.zeros((COLUMNS, len(sets)), np.float32)
        table[ids[a:b] - first, owners[a:b]] = 1
        common += table.T @ table
    union = sizes[:, None] + sizes[None, :] - common
    linked = (common >= threshold * union - 1e-6) & (union > 0) & counted
    np.fill_diagonal(linked, False)
    if sides.any():
        linked &= sides[:, None] != sides[None, :]
    root = np.arange(len(sets))
    while True:  # the least number of each part, by passing it along links
        lower = np.minimum(root, np.where(linked, root[None, :], len(sets)).min(1))
        lower = lower[lower]
        if (lower == root).all():
            break
        root = lower
    return [(units[i], int(copies[linked[i]].sum()), units[root[i]]) for i in np.flatnonzero(linked.any(1))]


def _verify(tasks: DataFrame, threshold: float) -> DataFrame:
    """Rows of (task, unit, side, copies, hashes, first, second, bands), grouped by task; a task has two blocks of units at most."""
    schema = "unit long, links long, root long"
    kinds = [pa.int64()] * 3

    def run(batches):
        held, at = [], None

        def flush():
            made = _verified(held, threshold) if len(held) > 1 else []
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*made), kinds)] if made else [pa.array([], k) for k in kinds], names=["unit", "links", "root"])

        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                for task, *row in zip(*(c.to_pylist() for c in batch.slice(lo, 64).columns)):
                    if task != at:
                        if held:
                            yield flush()
                        at = task
                    held.append(row)
        if held:
            yield flush()

    return tasks.repartition("task").sortWithinPartitions("task").mapInArrow(run, schema)


def join(df: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, size: int = SHINGLE, recall: float = RECALL, carry: bool = False) -> DataFrame:
    """(key, class_id, n_links, n_copies) of every row: n_links counts the other rows whose Jaccard similarity is the
    threshold or more, copies included; class_id is the least key of all that are connected by such links; n_copies
    counts the rows with the same set of n-grams, this one included.

    Texts without words (null, empty, punctuation) have the empty set and count as copies of each other. Repeated rows
    are copies. A row with a null key isn't compared: it comes out with a null class_id and no links. An empty table
    gives an empty one. Other columns aren't carried. The threshold must be over 0.5.

    With ``carry`` also ``_root``, ``_unit`` and ``_mark``: numbers of the row's class, of its set and of its text, null
    for a null key; a repeated key may be the class_id of several classes, which only ``_root`` tells apart."""
    bands = bands_for(recall, threshold)
    kind = df.select(key).schema[0].dataType.simpleString()

    def make():
        banding = Banding(bands, BAND_ROWS)

        def each(k, value, mark):
            hashes = shingles(value or "", size)
            yield k, mark, unit_of(hashes), len(hashes), banding.hashes(hashes).view(np.int64).tolist() if len(hashes) else []

        return each

    named = df.where(F.col(key).isNotNull()).select(F.col(key).alias("_key"), F.col(text).alias("_text"), F.xxhash64(text).alias("_mark"))
    rows = checkpointed(map_rows(named, ["_key", "_text", "_mark"], f"_key {kind}, _mark long, unit long, size int, bands array<long>", make))
    units = rows.groupBy("unit").agg(F.min(F.struct("_key", "_mark")).alias("f"), F.count("*").alias("copies"), F.first("size").alias("size"), F.first("bands").alias("bands"))
    units = checkpointed(units.select("unit", F.col("f._key").alias("first"), F.col("f._mark").alias("mark"), "copies", "size", "bands"))
    documents, total = rows.count(), units.count()
    banded = units.select("unit", F.posexplode("bands").alias("place", "band"))
    buckets = checkpointed(banded.groupBy("band").agg(F.min("unit").alias("least"), F.count("*").alias("n")).where("n > 1"))
    parts = checkpointed(components(looked_up(banded, buckets, ["band"], bands * total).select(F.col("unit").alias("a"), F.col("least").alias("b"))))
    verified = checkpointed(_verify(_shipped(named, _tasks(units, parts, buckets, bands, total, threshold), rows, size), threshold))
    linked = verified.groupBy("unit").agg(F.sum("links").alias("links"))
    joined = components(verified.select(F.col("unit").alias("a"), F.col("root").alias("b")))
    every = units.select("unit", "first", "copies").join(linked, "unit", "left").join(joined, F.col("unit") == F.col("node"), "left")
    every = checkpointed(every.select("unit", "first", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "unit").alias("root")))
    classes = checkpointed(every.groupBy("root").agg(F.min("first").alias("class_id"), F.count("*").alias("n")))
    answer = looked_up(every, classes, ["root"], total)
    answer = checkpointed(answer.select("unit", "root", "class_id", (F.col("links") + F.col("copies") - 1).alias("n_links"), F.col("copies").alias("n_copies"), F.col("copies").alias("n")))
    more = {"_root": "root", "_unit": "unit", "_mark": "_mark"} if carry else {}
    found = looked_up(rows.select("_key", "_mark", "unit"), answer, ["unit"], documents)
    found = found.select(F.col("_key").alias(key), "class_id", "n_links", "n_copies", *[F.col(c).alias(n) for n, c in more.items()])
    lost = df.where(F.col(key).isNull()).select(F.col(key), F.lit(None).cast(kind).alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(1).cast("long").alias("n_copies"), *[F.lit(None).cast("long").alias(n) for n in more])
    return found.unionByName(lost)


def _blocks(n: Column) -> Column:
    return F.ceil(n / BLOCK)


def _split(members: DataFrame, buckets: DataFrame, bands: int, total: int) -> DataFrame:
    """(unit, group, first, second, fit, n): the buckets of each unit, or where it takes less shipping, the pairs of a
    large bucket with a later one."""
    each = members.select("unit", "fit", F.posexplode("bands").alias("first", "group"))
    each = looked_up(each, buckets.select(F.col("band").alias("group"), "n"), ["group"], bands * total)
    # A unit has one row a band here.
    mine = checkpointed(each.groupBy("unit", "fit").agg(F.array_sort(F.collect_list(F.struct("first", "group", "n"))).alias("held")))
    later = lambda x: F.transform(F.filter("held", lambda y: y["first"] > x["first"]), lambda y: F.struct(x["group"].alias("bucket"), x["first"].alias("first"), x["n"].alias("all"), F.xxhash64(x["group"], y["group"]).alias("group"), y["first"].alias("second")))
    pairs = mine.select("unit", "fit", F.explode(F.flatten(F.transform(F.filter("held", lambda x: x["n"] > 2 * BLOCK), later))).alias("p")).select("unit", "fit", "p.*")
    sizes = checkpointed(pairs.groupBy("group", "bucket", "all").agg(F.count("*").alias("n")).where("n > 1"))
    cost = lambda n: n * _blocks(n)
    cut = checkpointed(sizes.groupBy("bucket", "all").agg(F.sum(cost(F.col("n"))).alias("parted")).where(F.col("parted") < cost(F.col("all"))).select("bucket"))
    # A bucket that no two of its units share a second one with isn't cut, but verified as it is.
    deep = looked_up(pairs, sizes.select("group", "n"), ["group"], bands * bands * total).join(small(cut, cut.count()), "bucket", "left_semi")
    flat = mine.select("unit", "fit", F.explode("held").alias("h")).select("unit", F.col("h.group").alias("group"), F.col("h.first").alias("first"), F.lit(-1).alias("second"), "fit", F.col("h.n").alias("n"))
    flat = flat.join(small(cut.withColumnRenamed("bucket", "group"), cut.count()), "group", "left_anti").select("unit", "group", "first", "second", "fit", "n")
    return flat.unionByName(deep.select("unit", "group", "first", "second", "fit", "n"))


def _tasks(units: DataFrame, parts: DataFrame, buckets: DataFrame, bands: int, total: int, threshold: float) -> DataFrame:
    """(unit, first, mark, copies, bands, tasks): of each unit that has candidates the tasks that it takes part in, as
    (task, side, first, second), the two being -1 where a part is a group as a whole. How often units are to be shipped
    decides between a part and its buckets."""
    fitted = F.floor(F.log(F.col("size").cast("double")) / F.lit(-math.log(threshold))).cast("int")
    cost = buckets.join(parts, F.col("least") == F.col("node")).groupBy("root").agg(F.sum(F.col("n") * _blocks(F.col("n"))).alias("apart"))
    sizes = parts.groupBy("root").agg(F.count("*").alias("n"))
    sizes = checkpointed(sizes.join(cost, "root").select("root", "n", ((F.col("n") <= 2 * BLOCK) | (F.col("n") * _blocks(F.col("n")) <= F.col("apart"))).alias("whole")))
    members = units.join(parts, F.col("unit") == F.col("node")).select("unit", F.col("first").alias("key"), "mark", "copies", "bands", fitted.alias("fit"), "root")
    members = checkpointed(looked_up(members, sizes, ["root"], total))
    groups = members.where("whole").select("unit", F.col("root").alias("group"), F.lit(-1).alias("first"), F.lit(-1).alias("second"), "fit", "n")
    if sizes.where("not whole").limit(1).count():
        groups = groups.unionByName(_split(members.where("not whole"), buckets, bands, total))
    few = groups.where(F.col("n") <= 2 * BLOCK).select("unit", F.array(F.struct(F.xxhash64("group", "first", "second").alias("task"), F.lit(0).alias("side"), "first", "second")).alias("tasks"))
    # In a larger group units are dealt to blocks by their class of sizes and a hash; classes further apart than one
    # can't reach the threshold, so a task is two blocks of the same or of neighbouring classes.
    many = groups.where(F.col("n") > 2 * BLOCK).drop("n")
    by_fit = checkpointed(many.groupBy("group", "fit").agg(F.count("*").alias("n")))
    near = by_fit.select("group", "fit", "n", _blocks(F.col("n")).cast("int").alias("blocks"))
    for step, name in ((-1, "below"), (1, "above")):
        near = near.join(by_fit.select("group", (F.col("fit") - step).alias("fit"), _blocks(F.col("n")).cast("int").alias(name)), ["group", "fit"], "left")
    placed = looked_up(many, checkpointed(near), ["group", "fit"], bands * bands * total).withColumn("block", F.pmod(F.xxhash64("unit"), F.col("blocks")).cast("int"))

    def listed(count, low_fit, low, high_fit, high, side):
        numbers = F.when(F.coalesce(count, F.lit(0)) > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
        named = lambda j: F.xxhash64("group", "first", "second", low_fit, low(j), high_fit, high(j))
        return F.transform(numbers, lambda j: F.struct(named(j).alias("task"), side(j).alias("side"), F.col("first").alias("first"), F.col("second").alias("second")))

    fit, block = F.col("fit"), F.col("block")
    same = listed(F.col("blocks"), fit, lambda j: F.least(j, block), fit, lambda j: F.greatest(j, block), lambda j: F.when(j == block, 0).when(j > block, 1).otherwise(2))
    above = listed(F.col("above"), fit, lambda j: block, fit + 1, lambda j: j, lambda j: F.lit(1))
    below = listed(F.col("below"), fit - 1, lambda j: j, fit, lambda j: block, lambda j: F.lit(2))
    tasks = few.unionByName(placed.select("unit", F.concat(same, above, below).alias("tasks"))).groupBy("unit").agg(F.flatten(F.collect_list("tasks")).alias("tasks"))
    return checkpointed(members.select("unit", F.col("key").alias("first"), "mark", "copies", F.when(~F.col("whole"), F.col("bands")).alias("bands")).join(tasks, "unit"))


def _shipped(named: DataFrame, placed: DataFrame, rows: DataFrame, size: int) -> DataFrame:
    """The rows to verify: each unit's set once for each of its tasks."""
    weight = placed.agg(F.sum(64 + 8 * F.coalesce(F.size("bands"), F.lit(0)) + 24 * F.size("tasks"))).first()[0] or 0
    texts = named.join(F.broadcast(placed) if weight <= BROADCAST_BYTES else placed, (F.col("_key") == F.col("first")) & (F.col("_mark") == F.col("mark")))
    if rows.groupBy("unit", "_key").count().where("count > 1").limit(1).count():
        texts = texts.dropDuplicates(["unit"])

    def make():
        def each(unit, copies, bands, tasks, value):
            data = shingles(value or "", size).tobytes()
            packed = np.array(bands or (), np.int64).tobytes()
            for t in tasks:
                yield t["task"], unit, t["side"], copies, data, t["first"], t["second"], packed

        return each

    return map_rows(texts, ["unit", "copies", "bands", "tasks", "_text"], "task long, unit long, side int, copies long, hashes binary, first int, second int, bands binary", make)


def small(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast where the counted rows are few enough, else left to a shuffle join."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df
