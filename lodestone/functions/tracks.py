"""Column functions on tracks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Finding bits.
DAMAGED, LOSSY_SOURCE, MAYBE_LOSSY, UPSAMPLED, PADDED, REENCODED = 1, 2, 4, 8, 16, 32
ISSUES = {"DAMAGED": DAMAGED, "LOSSY_SOURCE": LOSSY_SOURCE, "MAYBE_LOSSY": MAYBE_LOSSY, "UPSAMPLED": UPSAMPLED, "PADDED": PADDED, "REENCODED": REENCODED}
FAKES = LOSSY_SOURCE | MAYBE_LOSSY | UPSAMPLED | PADDED | REENCODED
# Audio file extensions.
EXTENSIONS = "flac mp3 wav aif aiff aifc dsf dff ape wv m4a mp4 aac alac ogg oga opus".split()
# Those whose headers are parsed here, so that a failure is damage.
OWN_PARSERS = "flac mp3 wav aif aiff aifc dsf dff ape wv".split()
# What marks a path as a stray copy, and what begins a guest's name.
CLUTTER = r"(?i)(\(\d+\)|\bcopy\b|копия|/download|/telegram|/tmp/|/temp/)"
GUEST = r"(?i)(\s+(feat\.?|ft\.?|featuring|with)\s+|\s*[(\[](feat\.?|ft\.?|featuring)\s).*$"


def has(bit: int, mask: Column | str = "issues") -> Column:
    return (F.col(mask) if isinstance(mask, str) else mask).bitwiseAND(F.lit(bit)) != 0


def open_mask() -> Column:
    return F.col("issues").bitwiseAND(F.bitwise_not("accepted"))


def file_name(path: str = "path") -> Column:
    return F.substring_index(path, "/", -1)


def norm_key(text: Column) -> Column:
    """Lower case, letters and decimal digits of the basic plane only."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\p{L}\p{Nd}]", ""), r"[\x{10000}-\x{10FFFF}]", "")


def khz(rate: Column) -> Column:
    return F.when(rate <= 0, "?").when(rate % 1000 == 0, (rate / 1000).cast("int").cast("string")).otherwise(F.format_string("%.1f", rate / 1000.0))


def quality() -> Column:
    rate, bits = F.col("sample_rate"), F.col("bits")
    dsd = F.concat(F.col("format"), F.lit(" DSD"), F.greatest(F.floor(rate / 44100), F.lit(1)).cast("string"))
    return (
        F.when(F.col("format").isin("DSF", "DFF"), dsd)
        .when(F.col("lossless") & (bits > 0), F.concat("format", F.lit(" "), bits.cast("string"), F.lit("/"), khz(rate)))
        .when(F.col("lossless"), F.concat("format", F.lit(" "), khz(rate)))
        .when(F.col("bitrate") > 0, F.concat("format", F.lit(" "), F.col("bitrate").cast("string")))
        .otherwise(F.col("format"))
    )


def size_label(size: Column) -> Column:
    return F.when(size >= 1_000_000_000, F.format_string("%.1f GB", size / 1e9)).when(size >= 1_000_000, F.format_string("%.1f MB", size / 1e6)).otherwise(F.concat(F.floor(size / 1000).cast("string"), F.lit(" KB")))


def plural(count: Column, word: str) -> Column:
    return F.concat(count.cast("string"), F.lit(f" {word}"), F.when(count == 1, "").otherwise("s"))


def duration_label(ms: Column) -> Column:
    s = F.floor(ms / 1000)
    return F.when(s >= 3600, F.format_string("%d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)).otherwise(F.format_string("%d:%02d", F.floor(s / 60), s % 60))


def kbps(size: Column, ms: Column) -> Column:
    return F.when(ms > 0, F.floor(size * 8 / ms)).otherwise(F.lit(0).cast("long"))


def like_bitrate(cutoff: Column) -> Column:
    """Bitrates in kbps that a cutoff is typical of, as a range where there is one."""
    ladder = F.when(cutoff <= 11_500, "up to 64")
    for bound, label in ((15_500, "96-112"), (17_200, "128"), (18_200, "160"), (19_200, "192")):
        ladder = ladder.when(cutoff <= bound, label)
    return ladder.otherwise("256-320")


def path_score(path: str = "path") -> Column:
    return F.regexp_count(F.col(path), F.lit(CLUTTER)) * -1000 - F.length(path)


def lead_artist(artist: Column) -> Column:
    lead = F.trim(F.regexp_replace(artist, GUEST, ""))
    return F.when(lead == "", artist).otherwise(lead)


def number_pair(value: Column) -> tuple[Column, Column]:
    """The number and the total of "3/12"; leading digits, at most four, else 0."""
    # The zero in front stands for no digits: a cast that fails is slow.
    number = lambda v: F.coalesce(F.concat(F.lit("0"), F.regexp_extract(F.trim(v), r"^(\d{1,4})", 1)).cast("int"), F.lit(0))
    return number(F.split_part(value, F.lit("/"), F.lit(1))), number(F.split_part(value, F.lit("/"), F.lit(2)))


def found_issues(damaged: Column) -> Column:
    """The mask that cutoff, ultrasonic drop, bits and rate give rise to."""
    cutoff, within = F.col("cutoff_hz"), lambda a, b: F.col("cutoff_hz").between(a, b)
    bit = lambda when, value: F.when(when, value).otherwise(0)
    lossless = F.col("lossless")
    upsampled = lossless & (F.col("sample_rate") >= 88_200) & (within(1, 24_500) | (F.col("ultrasonic_db") >= 40))
    padded = lossless & (F.col("bits") >= 24) & F.col("effective_bits").between(1, 16)
    return (
        bit(damaged, DAMAGED) + bit(lossless & within(1, 19_000), LOSSY_SOURCE) + bit(lossless & within(19_001, 20_600), MAYBE_LOSSY)
        + bit(upsampled, UPSAMPLED) + bit(padded, PADDED) + bit(~lossless & (F.col("bitrate") >= 256) & (cutoff >= 1) & (cutoff <= 17_000), REENCODED)
    )


def source_class() -> Column:
    return F.when(~F.col("lossless"), 0).when(has(LOSSY_SOURCE), 1).when(has(MAYBE_LOSSY), 2).otherwise(3)


def resolution() -> Column:
    rate = F.when(has(UPSAMPLED), F.least("sample_rate", F.lit(44100))).otherwise(F.col("sample_rate")).cast("long")
    bits = F.when(has(UPSAMPLED | PADDED), F.least("bits", F.lit(16))).otherwise(F.greatest("bits", F.lit(1)))
    return F.when(~F.col("lossless"), F.when(has(REENCODED), 128).otherwise(F.col("bitrate")).cast("long")).otherwise(rate * bits)


def shrink_target() -> tuple[Column, Column]:
    """(rate, bits) that an honest copy needs, nulls where nothing would change."""
    rate, bits = F.col("sample_rate"), F.col("bits")
    base = F.when(rate % 44100 == 0, 44100).when(rate % 48000 == 0, 48000).otherwise(rate)
    new_rate = F.when(has(UPSAMPLED) & (rate > base), base).otherwise(rate)
    new_bits = F.when(has(PADDED) & F.col("effective_bits").between(1, 16), 16).otherwise(bits)
    fit = (F.col("format") == "FLAC") & (F.col("deep_version") > 0) & ~has(DAMAGED) & F.col("channels").between(1, 8) & has(UPSAMPLED | PADDED) & ((new_rate != rate) | (new_bits != bits))
    return F.when(fit, new_rate), F.when(fit, new_bits)


def md5_match(told: Column, decoded: Column) -> Column:
    """-1 for an unknown signature, 1 for an equal one, else 0."""
    return F.when(told.isNull(), -1).when(told.eqNullSafe(decoded), 1).otherwise(0)


def route(format: Column) -> Column:
    """What decodes a format, null for nothing."""
    kinds = {"flac": ["FLAC"], "pcm": ["WAV", "AIFF"], "codec": "MP3 AAC ALAC OGG OPUS".split()}
    out = None
    for name, formats in kinds.items():
        out = F.when(format.isin(formats), name) if out is None else out.when(format.isin(formats), name)
    return out


def ago_label(ms: Column) -> Column:
    m = F.floor(ms / 60_000)
    said = lambda n, word: F.concat(F.floor(n).cast("string"), F.lit(f" {word}"))
    return F.when(m < 1, "just now").when(m < 60, said(m, "min")).when(m < 2880, said(m / 60, "h")).otherwise(said(m / 1440, "days"))


def eta(done: Column, left: Column, elapsed_ms: Column) -> Column:
    """Whole milliseconds that the bytes left will take, null in the first 20 seconds."""
    return F.when((elapsed_ms >= 20_000) & (done > 0), F.floor(left * elapsed_ms / F.nullif(done, F.lit(0))))


def extension(path: str = "path") -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1))


def damaged() -> Column:
    """Whether a listen shows damage: an error, bad frames, another signature, or fewer samples than promised."""
    truncated = (F.col("expected_samples") > 0) & (F.col("decoded_samples") < F.col("expected_samples"))
    return F.col("deep_error").isNotNull() | (F.col("frame_errors") > 0) | (F.col("md5_match") == 0) | truncated


def listened(not_decoded: str = "not decoded") -> dict[str, Column]:
    """What is kept of a listen: a format that nothing decodes gets no verdict; the signature of the samples is kept
    unless a FLAC file's own one matched."""
    skipped = F.col("deep_error").eqNullSafe(F.lit(not_decoded))
    kept = F.when((F.col("format") != "FLAC") | (F.col("md5_match") != 1), F.col("sample_md5"))
    return {"issues": F.when(skipped, 0).otherwise(found_issues(damaged())), "decoded_md5": kept}


def probed_damage(error: Column, path: str = "path") -> Column:
    """A header that isn't read is damage only where it would be parsed here."""
    return error.isNotNull() & extension(path).isin(OWN_PARSERS)


def explanation() -> Column:
    """Codes of what is known of a track, in their fixed order, joined by commas."""
    damage = F.when(F.col("deep_error").isNotNull(), "undecodable").when(F.col("truncated"), "truncated").when(F.col("frame_errors") > 0, "bad_frames").when(F.col("md5_match") == 0, "other_signature").otherwise("damaged")
    above = F.when(F.col("cutoff_hz").between(1, 24_500), "upsampled_cutoff").otherwise("upsampled_drop")
    parts = [F.when(has(DAMAGED), damage), F.when(has(LOSSY_SOURCE), "lossy_source"), F.when(has(MAYBE_LOSSY), "maybe_lossy"), F.when(has(UPSAMPLED), above), F.when(has(PADDED), "padded"), F.when(has(REENCODED), "reencoded")]
    found = F.nullif(F.concat_ws(",", *parts), F.lit(""))
    clean = F.when(F.col("lossless") & (F.col("md5_match") == 1), "clean_signed").when(F.col("lossless"), "clean_lossless").otherwise("clean")
    return F.when(F.col("probe_error").isNotNull(), "unreadable").when(F.col("deep_version") < 1, "waiting").when(F.col("deep_error") == "not decoded", "not_decoded").otherwise(F.coalesce(found, clean))
