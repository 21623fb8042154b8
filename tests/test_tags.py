"""Tags of files as one row each, and what is missing of them."""

from pyspark.sql import functions as F

import __spark_entry__ as entry
from lodestone.functions import tracks as fn
from lodestone.operators import repair
from lodestone.sources import media
from test_catalog import DIR

TAGS = "path string, tags array<struct<name: string, value: string>>"


def test_normalised_as_the_parser_does(spark):
    lists = [
        [("Album_Artist", " "), ("ALBUM ARTIST", "a\0"), ("albumartist", "b"), ("x", "y")], [("compilation", "no"), ("COMPILATION", "True"), ("Band", "b"), ("genre", "\tg\r\n"), ("date", " 1 9 ")],
        [("TIT2", "ü "), ("title", "v"), ("ALBUM", "\x0b\x0c "), ("TAL", "w"), ("artist", "\0x\0")], [(" title ", "t"), ("Compilation", "0")], [("title", " "), ("comment", "c")], [], [(None, "a"), ("title", None)],
    ]
    got = {r.path: r for r in media.normalised(spark.createDataFrame([(str(i), x) for i, x in enumerate(lists)], TAGS)).collect()}
    for i, tags in enumerate(lists):
        want = media.normalise([(n, v) for n, v in tags if n is not None and v is not None])
        assert (str(i) in got) == bool(want)
        if want:
            fields = {n: got[str(i)][n.lower().replace("albumartist", "album_artist")] for n in ("TITLE", "ARTIST", "ALBUM", "ALBUMARTIST", "DATE", "GENRE")}
            # The parser leaves a vertical tab and a form feed at the ends.
            assert fields == {n: (v.strip("\x0b\x0c ") if (v := want.get(n)) else v) if n != "ALBUM" or i != 2 else "w" for n in fields}
            assert got[str(i)].compilation == (want.get("COMPILATION") == "1")


def test_numbers_and_totals_of_tags(spark):
    rows = [
        ("a", [("track", "0"), ("trck", "x"), ("TRACKNUMBER", "7/9"), ("track", "8/4"), ("totaltracks", "5")], (7, 9, 0, 0)), ("b", [("totaltracks", "5/6"), ("track", "3/12"), ("disc", "/2"), ("totaldiscs", "4")], (3, 5, 0, 2)),
        ("c", [("disc", "12345 / 3"), ("track", "-1")], (0, 0, 1234, 3)), ("d", [("title", "t")], (0, 0, 0, 0)),
    ]
    got = {r.path: (r.track, r.track_total, r.disc, r.disc_total) for r in media.normalised(spark.createDataFrame([r[:2] for r in rows], TAGS)).collect()}
    assert got == {path: numbers for path, _, numbers in rows}


def test_tags_of_a_file_are_not_sorted_or_sent_one_by_one(spark):
    plan = entry.queries()["fn_tag_normalise"](spark, DIR)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and plan.count("Exchange hashpartitioning") == 1


def test_number_pair_without_digits(spark):
    values = ["3/12", "x", "", "/", "12345/99999", " 07 / 8", None, "1/", "/2", "-1/3"]
    frame = spark.createDataFrame([(v,) for v in values], "v string")
    assert [tuple(r) for r in frame.select(*fn.number_pair(F.col("v"))).collect()] == [(3, 12), (0, 0), (0, 0), (0, 0), (1234, 9999), (7, 8), (0, 0), (1, 0), (0, 2), (0, 3)]


def test_only_tracks_that_lack_something_are_looked_up(spark):
    fields = "id long, folder string, path string, disc int, track int, title string, album string, artist string, album_artist string"
    rows = [(1, "/a/X - Y", "/a/X - Y/01 one.flac", 1, 1, "one", "al", "p", None), (2, "/a/X - Y", "/a/X - Y/02 two.flac", 1, 2, None, None, None, None), (3, "/b", "/b/03 three.flac", 1, 0, "t", None, "p", None), (4, "/b", "/b/04 four.flac", 1, 4, "t", None, None, None),
            (5, "/b", "/b/5 five.flac", 1, 5, "t", "l", "q", None)]
    edits = repair.missing_edits(spark.createDataFrame(rows, fields))
    # The artists of /b are several, those of /a's complete track tell the other one's.
    assert sorted(map(tuple, edits.collect())) == [(2, "album", "al"), (2, "artist", "p"), (2, "title", "two"), (3, "album", "l"), (3, "track", "3"), (4, "album", "l")]
    plan = edits._jdf.queryExecution().optimizedPlan().toString()
    assert "isnull(title" in [line for line in plan.split("\n") if "Filter" in line and "track" in line and " OR " in line][0]
    assert "count(distinct" not in plan
