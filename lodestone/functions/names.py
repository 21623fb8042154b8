"""What the names of files and folders say about a track and its album."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# How rippers and shops name files and folders.
NUMBERED = r"^(?:(\d)[-.])?(\d{1,3})(?:\s*[-._)\]]\s*|\s+)(.+)$"
ARTIST_FIRST = r"^(.+?)\s+-\s+(\d{1,3})\s+-\s+(.+)$"
YEAR_FIRST = r"^[\[(]?(?:19|20)\d\d[\])]?\s*[-.]?\s+"
TRAILED = r"^(.+?)(?:\s*[\[({][^\])}]*[\])}]\s*)*$"
DISC = r"^(?i:cd|disc|disk|part)\s*\d+$"
NOT_ARTISTS = "music musik musique audio media download downloads flac mp3 albums 0 emulated storage sdcard".split()
VOLUME = r"^[0-9A-F]{4}-[0-9A-F]{4}$"


def _known(value: Column) -> Column:
    return F.nullif(F.trim(value), F.lit(""))


def file_name(name: Column, artist: Column) -> tuple[Column, Column]:
    """(number, title) of a file's name, 0 and null where it has none; the artist's name is taken off a numbered title."""
    bare = F.regexp_replace(name, r"\.[^.]*$", "")
    bare = F.trim(F.when(F.contains(bare, F.lit(" ")), bare).otherwise(F.translate(bare, "_", " ")))
    led, numbered = bare.rlike(ARTIST_FIRST), bare.rlike(NUMBERED)
    first, plain = F.regexp_extract(bare, ARTIST_FIRST, 2).try_cast("int"), F.regexp_extract(bare, NUMBERED, 2).try_cast("int")
    combined = (F.regexp_extract(bare, NUMBERED, 1) == "") & (plain > 100) & (plain % 100 > 0)
    number = F.when(led, first).when(numbered & combined, plain % 100).when(numbered, plain).otherwise(0)
    title, prefix = F.trim(F.regexp_extract(bare, NUMBERED, 3)), F.concat(F.lower(artist), F.lit(" - "))
    title = F.when(F.startswith(F.lower(title), prefix), F.substring(title, F.length(prefix) + 1, F.length(title))).otherwise(title)
    return number, _known(F.when(led, F.regexp_extract(bare, ARTIST_FIRST, 3)).when(numbered, title).otherwise(bare))


def _clean(name: Column) -> Column:
    """Without a year in front and brackets behind; brackets alone stay."""
    return F.trim(F.regexp_extract(F.trim(F.regexp_replace(F.trim(name), YEAR_FIRST, "")), TRAILED, 1))


def folder_name(folder: Column) -> tuple[Column, Column]:
    """(artist, album) of a folder's path; a disc's folder stands for the one above it."""
    parts = F.split(F.regexp_replace(folder, "/+$", ""), "/")
    up = F.when((F.size(parts) > 1) & F.trim(F.element_at(parts, -1)).rlike(DISC), 1).otherwise(0)
    at = lambda i: F.get(parts, F.size(parts) - 1 - up - i)
    name, parent = _clean(at(0)), F.trim(at(1))
    dashed = F.split(name, " - ")
    own = F.trim(dashed[0])
    album = _clean(F.regexp_replace(F.array_join(F.slice(dashed, 2, F.size(dashed)), " - "), YEAR_FIRST, ""))
    above = F.when((parent != "") & ~F.lower(parent).isin(NOT_ARTISTS) & ~parent.rlike(VOLUME), _clean(parent))
    split = F.size(dashed) > 1
    return F.when(split, _known(own)).otherwise(above), F.when(split, _known(album)).otherwise(_known(name))
