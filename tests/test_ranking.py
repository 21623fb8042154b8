"""Groups of three copies and more, which the SQL of the queries leaves out."""

import itertools

from pyspark.sql import functions as F

from lodestone.functions import names
from lodestone.operators import ranking

MERIT = "damaged long, source int, tracks long, resolution long, dr double, tags long, size long, path int, fake boolean, name string"


def better(a, b):
    for field, most in (("damaged", False), ("source", True), ("tracks", True), ("resolution", True)):
        if a[field] != b[field]:
            return (a[field] > b[field]) == most
    if a["dr"] is not None and b["dr"] is not None and abs(a["dr"] - b["dr"]) >= 2:
        return a["dr"] > b["dr"]
    if a["tags"] != b["tags"]:
        return a["tags"] > b["tags"]
    return a["size"] < b["size"] if a["size"] != b["size"] else a["path"] > b["path"]


def test_insertion_where_order_is_not_transitive(spark):
    rows = []
    for g, drs in enumerate(itertools.product([None, 8.0, 9.5, 11.0], repeat=4)):
        for i, dr in enumerate(drs):
            rows.append((g, dict(damaged=g % 2 * (i == 1), source=3, tracks=1, resolution=1, dr=dr, tags=(i * 7 + g) % 3, size=(i * 5 + g) % 4, path=-i, fake=False, name=f"n{i}")))
    made = spark.createDataFrame([(g, tuple(m.values())) for g, m in rows], f"grp int, merit struct<{MERIT.replace(' ', ':').replace(',:', ',')}>")
    got = {}
    for r in ranking.places(ranking.ranked(made, "grp"), "grp").orderBy("place").collect():
        got.setdefault(r.grp, []).append(r.name)
    for g in got:
        out = []
        for m in (m for h, m in rows if h == g):
            at = len(out)
            while at and better(m, out[at - 1]):
                at -= 1
            out.insert(at, m)
        assert got[g] == [m["name"] for m in out], g


def test_names_with_nothing_to_say(spark):
    rows = spark.createDataFrame([("", "", "a"), (None, None, None), ("(2019) [x]", "/", "07 .mp3"), ("x", "/music/A - B", "Ä - 5 - ö.flac")], "x string, folder string, name string")
    number, title = names.file_name(F.col("name"), F.lit("x"))
    artist, album = names.folder_name(F.col("folder"))
    got = [tuple(r) for r in rows.select(number, title, artist, album).collect()]
    assert got[0] == (0, "a", None, None) and got[1][1:] == (None, None, None) and got[3] == (5, "ö", "A", "B")
