"""What the operators share: Arrow row mapping with bounded batches, and the folder that all executors share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows turned into Python objects at once, characters after which a slice is full, and bytes of output held back at most
#: (one row may be longer).
ROWS_AT_ONCE, LONG_AT_ONCE, BYTES_AT_ONCE = 256, 2 << 20, 8 << 20
#: Characters of a text that a classifier learns from at most; longer ones are scored, not learned from.
LEARNED = 1 << 16
#: What a session's Arrow batches are brought down to: rows, bytes. The defaults hold up to 64 MB several times over.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1_000, "spark.sql.execution.arrow.maxBytesPerBatch": 8 << 20}


def map_rows(df: DataFrame, columns: list[str], schema: str, make: Callable[[], Callable[..., Iterable[tuple]]]) -> DataFrame:
    """Rows of ``schema`` that ``make()`` yields for each row of ``columns``. ``make`` runs once a task, on the executor."""

    def one_by_one():
        each = make()
        return lambda rows: (made for row in rows for made in each(*row))

    return map_slices(df, columns, schema, one_by_one)


def map_slices(df: DataFrame, columns: list[str], schema: str, make: Callable[[], Callable[[list[tuple]], Iterable[tuple]]], rows_at_once: int = ROWS_AT_ONCE) -> DataFrame:
    """Rows of ``schema`` that ``make()`` yields for each small slice of rows of ``columns``: at most ``rows_at_once``, and no
    further row after LONG_AT_ONCE characters.

    ``make`` runs once a task, on the executor; it may give a second function, which yields what comes after the last
    slice. Memory depends on the longest row and not on the partition; for that the
    session's Arrow batches are brought down to BATCH, and stay so. Columns are selected by name and renamed, so others
    of the frame can't clash."""
    conf = df.sparkSession.conf
    for name, most in BATCH.items():
        now = conf.get(name).rstrip("bB")
        if not now.isdigit() or not 0 < int(now) <= most:
            conf.set(name, str(most))
    arrow = to_arrow_schema(T.StructType.fromDDL(schema))
    picked = df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)])

    def slices(batches):
        rows, size = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                for row in zip(*(c.to_pylist() for c in batch.slice(at, 64).columns)):
                    rows.append(row)
                    size += sum(len(x) for x in row if isinstance(x, (bytes, str, list)))
                    if len(rows) >= rows_at_once or size >= LONG_AT_ONCE:
                        yield rows
                        rows, size = [], 0
        if rows:
            yield rows

    def run(batches):
        each, last = made if isinstance(made := make(), tuple) else (made, lambda: ())
        held: list[list] = [[] for _ in arrow]
        size = 0

        def flush():
            nonlocal size
            out = pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(held, arrow)], schema=arrow)
            for v in held:
                v.clear()
            size = 0
            return out

        def every():
            for rows in slices(batches):
                yield from each(rows)
            yield from last()

        for row in every():
            for v, x in zip(held, row):
                v.append(x)
                if isinstance(x, (bytes, str, list)):
                    size += len(x)
            if size >= BYTES_AT_ONCE or len(held[0]) >= 4096:
                yield flush()
        if held[0]:
            yield flush()

    return picked.mapInArrow(run, schema)


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share: the one of ``spark.checkpoint.dir``.

    A local session where that is unset, as in tests, takes a folder of its warehouse; on a cluster it must be set."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        made = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not made.isDefined() and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir isn't set")
        root = made.get() if made.isDefined() else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut, in files that outlive executors."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_dir(df.sparkSession, "checkpoints"))
    return df.checkpoint(eager=True)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, learn: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text, label) of at most ``per_class`` rows of labels 0 and 1 each, in the order of a hash of their key, of
    those where ``learn`` holds; of a key's several texts the least one. Texts over LEARNED characters aren't learned
    from, so that what is brought to the driver is bounded in bytes too. The keys are at most twice ``per_class``, which
    bounds what is broadcast."""
    mine = labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1) & learn).select(key, label).distinct()
    first = [mine.where(F.col(label) == c).orderBy(F.xxhash64(key), key).limit(per_class) for c in (0, 1)]
    value = F.coalesce(text, F.lit(""))
    found = docs.select(key, value.alias("text")).where(F.length("text") <= LEARNED).join(F.broadcast(first[0].unionByName(first[1])), key)
    return found.groupBy(key, label).agg(F.min("text").alias("text")).select(key, "text", label)


def free(df: DataFrame, name: str) -> str:
    """``name``, or where the frame has such a column (case apart), one that it doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def one_in(key: str, parts: int, rest: int) -> Column:
    """Whether crc32 of the key as text leaves ``rest``; false for a null key."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % parts == rest, F.lit(False))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
