"""Queries on tracks of which some have an id beyond bigint, against the SQL with the same numbers as hugeint."""

import shutil
from decimal import Decimal

import duckdb
import pytest
from pyspark.sql import functions as F
from test_catalog import DIR, TABLES, rows

import __spark_entry__ as entry
from lodestone.plans.bind import album_tracks

#: A multiple of all moduli that queries take of ids, as far as fn_tag_normalise goes.
FAR = 63 * 142_858


@pytest.fixture(scope="module")
def far(spark, tmp_path_factory):
    """The smallest tables, orders from 20 on under keys so large that ids overflow."""
    folder = tmp_path_factory.mktemp("far")
    for t in TABLES:
        shutil.copy(f"{DIR}/{t}.parquet", folder)
    for t, key in (("orders", "o_orderkey"), ("lineitem", "l_orderkey")):
        frame = spark.read.parquet(f"{DIR}/{t}.parquet")
        (folder / f"{t}.parquet").unlink()
        frame.withColumn(key, F.expr(f"if({key} >= 20, {key} + {FAR}, {key})")).coalesce(1).write.parquet(str(folder / f"{t}.parquet"))
    return str(folder)


@pytest.mark.parametrize("name", sorted(n for n, sql in entry.oracle_sql().items() if "lineitem" in sql and n != "fn_tag_normalise"))
def test_wide_ids(spark, far, name):
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"create view {t} as select * {'replace (l_orderkey::hugeint as l_orderkey)' if t == 'lineitem' else ''} from '{far}/{t}.parquet{'/*.parquet' if t in ('orders', 'lineitem') else ''}'")
    want = db.execute(entry.oracle_sql()[name])
    names = [c[0] for c in want.description]
    got = entry.queries()[name](spark, far)
    plain = lambda r: tuple(int(x) if isinstance(x, Decimal) else x for x in r)
    a, b = rows(got.columns, [plain(r) for r in got.collect()]), rows(names, [plain(r) for r in want.fetchall()])
    assert a and a == b


def test_wide_tags(spark, far):
    """DuckDB takes no hugeint as a place in a list; the tags are those of the same line under its near key."""
    near = lambda path: path if (key := int(path.split("/")[2])) < FAR else path.replace(str(key), str(key - FAR), 1)
    got = [near(r.path) == r.path for r in entry.queries()["fn_tag_normalise"](spark, far).collect()]
    assert set(got) == {True, False}
    told = lambda d: sorted((tuple(near(x) if c == "path" else x for c, x in r.asDict().items()) for r in entry.queries()["fn_tag_normalise"](spark, d).collect()), key=repr)
    assert told(far) == told(DIR)


def test_ids_stay_bigint_where_they_fit(spark):
    assert dict(album_tracks(spark, DIR).dtypes)["id"] == "bigint"
