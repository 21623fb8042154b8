"""Edits of a file's comments, against the reference's rule written out."""

import time

from pyspark.sql import functions as F

from lodestone.operators import repair

SPELLINGS = ["ALBUMARTIST", "ALBUM ARTIST"]


def edited(comments, value):
    mine = [i for i, c in enumerate(comments) if c.split("=", 1)[0].upper() in SPELLINGS]
    entry = [] if value is None else [f"ALBUMARTIST={value}"]
    if not mine:
        return comments + entry
    return comments[: mine[0]] + entry + [c for i, c in enumerate(comments) if i > mine[0] and i not in mine]


def got(spark, rows):
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, c array<string>, v string")
    return [r.c for r in frame.select("id", repair.edit_comments(F.col("c"), "ALBUMARTIST", SPELLINGS, F.col("v")).alias("c")).orderBy("id").collect()]


def test_one_field_set(spark):
    lists = [
        [], ["albumartist=a"], ["TITLE=a", "Album Artist=b", "x=1", "ALBUMARTIST=c", "album artist"], ["ALBUMARTIST", "y"], ["albumartist", "x=ALBUMARTIST", "ALBUMARTIST=ALBUMARTIST"], ["x=1", "ALBUMARTIST", "x=1", "ALBUMARTIST"],
        ["ALBUMARTISTS=a", " ALBUMARTIST=b", "=ALBUMARTIST", "", "="], ["", "album artist=x=y", ""], ["ü=1", "a=1=2", "ALBUMARTIST=", "ü=1"],
    ]
    rows = [(c, v) for c in lists for v in (None, "", "n", "ALBUMARTIST", "ALBUMARTIST=q", "k=v", "ü\n")]
    assert got(spark, rows) == [edited(*r) for r in rows]


def test_many_comments_are_each_looked_at_once(spark):
    """The first spelling was found anew for each comment: a minute for this file."""
    comments = [f"k{i}=v" for i in range(15_000)] + ["album artist=a", "x=1", "albumartist=b"]
    got(spark, [(["x=1"], "n")])
    began = time.monotonic()
    assert got(spark, [(comments, "n")]) == [edited(comments, "n")]
    assert time.monotonic() - began < 10
