"""Secret scans in DataFrame functions only: three fixed patterns, and character Markov models for what they miss.

Two first-order models over characters, one of random strings and one of ordinary identifiers, are counted from labelled
samples. A long token is a secret if the log-likelihood ratios of the character pairs of some part of it add up to more
than a bound, so a name or path before or after a secret in the same token doesn't hide it. The span is the whole token.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free

#: The base patterns, their kinds as listed, and the least length of what counts.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS, HEX = r"AKIA[A-Z0-9]{16,}", r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "markov")
ASSIGN_LEAST = 6
#: Tokens that the models judge, the characters they know, the most that one pair counts either way, and the summed ratio
#: of the best part above which a token is a secret (nats). The README has the recall and false alarms of this bound.
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"
MOST, BOUND = 2.0, 8.0
MARK, OTHER = "\x01", "\x02"
#: Code points of the blocks that a text is cut into to replace spans.
PLACE = 1024

#: Ordinary words that the default identifiers are made of.
WORDS = (
    "get set user name index count list item value key data file path table row column query result error message time date start end first last next "
    "load save read write open close create update delete find search filter sort group order total number string array object node tree graph edge "
    "page view model test config option default parse format convert check valid buffer stream client server request response session cache field "
    "type class method function return input output source target left right width height color image text line word document information "
    "the and that with from this have not are was for nation tion ing ment able ent ound ther ich sch ein und der die das que les des ent aire ción mente"
).split()


def samples(count: int = 3000, seed: int = 1) -> list[tuple[str, int]]:
    """Labelled samples by rule: 1 for random strings in usual alphabets, 0 for identifiers of ordinary words."""
    rng = random.Random(seed)
    alphabets = ("0123456789abcdef", "0123456789ABCDEF", LETTERS[:62], LETTERS[:62] + "+/", LETTERS[:62] + "-_", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    out = []
    for i in range(count):
        out.append(("".join(rng.choices(alphabets[i % len(alphabets)], k=rng.randint(20, 64))), 1))
        words = [w for w in rng.choices(WORDS, k=rng.randint(3, 7)) if w.isascii()] or ["name"]
        style = i % 6
        made = "_".join(words) if style == 0 else "-".join(words) if style == 1 else "/".join(words) if style == 2 else "".join(words) if style == 3 else "".join(w.title() for w in words) if style == 4 else words[0] + "".join(w.title() for w in words[1:])
        made = made.upper() if rng.random() < 0.1 else made
        out.append((made + (str(rng.randint(0, 2030)) if rng.random() < 0.15 else ""), 0))
    # Repeated signs and separators are ordinary.
    return out + [(c * 40, 0) for c in "-=_/+0"] * 5


def fit(labelled: list[tuple[str, int]]) -> list[int]:
    """Thousandths of the log-likelihood ratio of each pair of LETTERS, row by row, with add-one smoothing, MOST
    at most either way. Characters that aren't in LETTERS are skipped."""
    n = len(LETTERS)
    place = {c: i for i, c in enumerate(LETTERS)}
    pairs = [[1.0] * (n * n) for _ in range(2)]
    for text, label in labelled:
        at = [place[c] for c in text if c in place]
        for a, b in zip(at, at[1:]):
            pairs[label][a * n + b] += 1
    table = []
    for a in range(n):
        sums = [sum(p[a * n : a * n + n]) for p in pairs]
        ratios = [math.log(pairs[1][a * n + b] / sums[1]) - math.log(pairs[0][a * n + b] / sums[0]) for b in range(n)]
        table += [round(1000 * max(-MOST, min(MOST, r))) for r in ratios]
    return table


def ratio(table: list[int], token: str) -> float:
    """What score() computes, for one token."""
    n = len(LETTERS)
    at = [LETTERS.index(c) for c in token]
    run = best = 0
    for a, b in zip(at, at[1:]):
        run = max(0, run + table[a * n + b])
        best = max(best, run)
    return best / 1000


def score(table: list[int], token: Column) -> Column:
    """The largest sum of ratios over neighbouring pairs of the token. The table is a constant of fixed size, folded into
    the plan."""
    n = len(LETTERS)
    constant = F.split(F.lit(",".join(map(str, table))), ",").cast("array<int>")  # folded into a literal once
    letters, zero = F.lit(LETTERS), F.lit(0).cast("long")
    codes = F.transform(F.split(token, ""), lambda c: F.instr(letters, c) - 1)

    def step(s, c):
        run = F.greatest(zero, s["run"] + F.when(s["before"] < 0, F.lit(0)).otherwise(F.element_at(constant, s["before"] * n + c + 1)))
        return F.struct(c.alias("before"), run.alias("run"), F.greatest(s["best"], run).alias("best"))

    return F.aggregate(codes, F.struct(F.lit(-1).alias("before"), zero.alias("run"), zero.alias("best")), step, lambda s: s["best"]) / 1000.0


def running(values: Column, zero: Column, add) -> Column:
    """Of an array the results of ``add`` over its first elements, for the first one, the first two and so on. It is done
    in blocks of about the square root of the array's size, so that none of the arrays that grow in it gets long; ``add``
    must be associative. The array must be a column of its own: an expression would be made anew for each block."""
    size = F.size(values)
    step = F.greatest(F.lit(1), F.ceil(F.sqrt(size.cast("double"))).cast("int"))
    grow = lambda done, x: F.concat(done, F.array(x))
    none = F.array().cast("array<int>")
    blocks = F.transform(F.sequence(F.lit(0), F.floor((size - 1) / step).cast("int")), lambda i: F.slice(values, i * step + 1, step))
    inner = F.transform(blocks, lambda b: F.aggregate(b, none, lambda done, x: grow(done, add(F.coalesce(F.try_element_at(done, F.lit(-1)), zero), x))))
    before = F.aggregate(inner, F.array(zero), lambda done, b: grow(done, add(F.element_at(done, -1), F.element_at(b, -1))))
    return F.when(size > 0, F.flatten(F.zip_with(inner, F.slice(before, F.lit(1), F.size(inner)), lambda b, first: F.transform(b, lambda x: add(first, x))))).otherwise(none)


def _marked(text: Column, pattern: str) -> Column:
    """The text cut at the borders of the pattern's leftmost non-overlapping matches, which are every second part; null
    without matches. The text holds no marks."""
    return F.when(text.rlike(pattern), F.split(F.regexp_replace(text, F.lit(f"({pattern})"), F.lit(f"{MARK}$1{MARK}")), MARK, -1))


def _matches(parts: Column, ends: Column) -> Column:
    """(at, to, found) of the parts that are matches, by the running sums of the lengths of all parts."""
    empty = F.array().cast("array<struct<at:int,to:int,found:string>>")
    odd = F.when(F.size(parts) > 1, F.sequence(F.lit(2), F.size(parts) - 1, F.lit(2))).otherwise(F.array().cast("array<int>"))
    found = F.transform(odd, lambda i: F.struct(F.element_at(ends, i - 1).alias("at"), F.element_at(ends, i).alias("to"), F.element_at(parts, i).alias("found")))
    return F.when(parts.isNull(), empty).otherwise(found)


def _spans(found: Column, kind: int) -> Column:
    return F.transform(found, lambda m: F.struct(m["at"].alias("at"), F.lit(kind).alias("kind"), m["to"].alias("to")))


def _written(spans: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["at"].cast("string"), s["to"].cast("string"))), ",")


def scan(df: DataFrame, text: str = "text", table: list[int] | None = None, bound: float = BOUND, base: str = "_base", every: str = "_all") -> DataFrame:
    """All columns of ``df`` and ``base``, ``every``: arrays of (at, kind, to) by at, then kind as listed; code points, the
    end exclusive. ``every`` also has what the models add: tokens above the bound that overlap no base span. The frame
    mustn't have columns of these two names; what else it has is left alone.

    A null or empty text has empty arrays; repeated rows give repeated rows; no row is lost. A text of m matches takes
    about m to the power of 1.5 steps."""
    table = table or fit(samples())
    mine = {n: free(df, n) for n in ("_plain", "_parts", "_ends", "_found", "_token")}
    plain, parts, ends, found, token = (F.col(f"`{n}`") for n in mine.values())
    value = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    patterns = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "token": TOKEN}
    step = df.withColumn(mine["_plain"], F.when(F.instr(value, MARK) > 0, F.translate(value, MARK, OTHER)).otherwise(value))
    step = step.withColumn(mine["_parts"], F.struct(*[_marked(plain, p).alias(n) for n, p in patterns.items()])).drop(mine["_plain"])
    step = step.withColumn(mine["_ends"], F.struct(*[F.transform(parts[n], F.length).alias(n) for n in patterns]))
    step = step.withColumn(mine["_ends"], F.struct(*[F.when(parts[n].isNotNull(), running(ends[n], F.lit(0), lambda a, b: a + b)).alias(n) for n in patterns]))
    step = step.withColumn(mine["_found"], F.struct(*[_matches(parts[n], ends[n]).alias(n) for n in patterns])).drop(mine["_parts"], mine["_ends"])
    assigned = F.filter(found["assign"], lambda m: F.length(F.regexp_extract(m["found"], ASSIGN, 1)) >= ASSIGN_LEAST)
    step = step.withColumn(base, F.array_sort(F.concat(_spans(assigned, 0), _spans(found["access"], 1), _spans(found["hex"], 2))))
    step = step.withColumn(mine["_token"], F.filter(found["token"], lambda m: score(table, m["found"]) > bound)).drop(mine["_found"])
    # A token overlaps a base span if, of those that begin before its end, the furthest end lies behind its begin. Tokens
    # by their ends and base spans by their begins are put in order; at equal places tokens come first.
    event = lambda key, m, kind: F.struct(key.alias("key"), F.lit(kind).alias("kind"), m["at"].alias("at"), m["to"].alias("to"))
    step = step.withColumn(mine["_token"], F.when(F.size(token) > 0, F.array_sort(F.concat(F.transform(token, lambda m: event(m["to"], m, 0)), F.transform(base, lambda m: event(m["at"], m, 1))))))
    step = step.withColumn(mine["_ends"], F.transform(token, lambda e: F.when(e["kind"] == 1, e["to"]).otherwise(0)))
    step = step.withColumn(mine["_ends"], F.when(token.isNotNull(), running(ends, F.lit(0), F.greatest)))
    apart = F.filter(F.zip_with(token, ends, lambda e, most: F.struct(e["kind"].alias("kind"), e["at"].alias("at"), e["to"].alias("to"), most.alias("most"))), lambda e: (e["kind"] == 0) & (e["most"] <= e["at"]))
    added = F.coalesce(_spans(apart, len(KINDS) - 1), F.array().cast("array<struct<at:int,kind:int,to:int>>"))
    return step.withColumn(every, F.array_sort(F.concat(base, added))).drop(mine["_token"], mine["_ends"])


def report(df: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """(key, n_assign, n_access, n_hex, n_markov, base_sha256, spans) of every row, whose spans are joined as
    kind:start:end by commas. Cases as in scan(); a null key stays; other columns aren't carried."""
    found = scan(df.select(F.col(key).alias("_key"), F.col(text).alias("_text")), "_text", **options)
    of = lambda kind: F.size(F.filter("_all", lambda s: s["kind"] == kind)).cast("long")
    return found.select(F.col("_key").alias(key), of(0).alias("n_assign"), of(1).alias("n_access"), of(2).alias("n_hex"), of(3).alias("n_markov"), F.sha2(_written(F.col("_base")).cast("binary"), 256).alias("base_sha256"), _written(F.col("_all")).alias("spans"))


def redact(df: DataFrame, text: str = "text", instead: str = "[secret]", **options) -> DataFrame:
    """``df`` with every span of its text replaced; overlapping spans are replaced as one. All columns stay, whatever
    their names; texts without spans, null ones too, stay as they are."""
    base, every, ends, cuts = (free(df, n) for n in ("_base", "_all", "_to", "_cuts"))
    found = scan(df, text, base=base, every=every, **options)
    value, spans, most, pieces = F.col(f"`{text}`"), F.col(f"`{every}`"), F.col(f"`{ends}`"), F.col(f"`{cuts}`")
    found = found.withColumn(ends, F.when(F.size(spans) > 0, F.transform(spans, lambda s: s["to"])))
    found = found.withColumn(ends, F.when(most.isNotNull(), running(most, F.lit(0), F.greatest)))
    # A span that begins behind the ends of all before it begins a new cut, up to which the text since these ends stays.
    numbered = F.zip_with(spans, F.concat(F.array(F.lit(0)), most), lambda s, before: F.struct(before.alias("since"), s["at"].alias("at")))
    found = found.withColumn(ends, F.when(most.isNotNull(), F.struct(F.filter(numbered, lambda c: c["at"] >= c["since"]).alias("keeps"), F.element_at(most, -1).alias("last"))))
    # Blocks of the text, so that a place far in it is reached without counting from its begin.
    found = found.withColumn(cuts, F.when(most.isNotNull(), F.regexp_extract_all(value, F.lit(f"(?s).{{1,{PLACE}}}"), F.lit(0))))

    def piece(a, b):
        """Code points a to b of the text."""
        first, last = F.floor(a / PLACE).cast("int"), F.floor((b - 1) / PLACE).cast("int")
        part = lambda i: F.substring(F.element_at(pieces, i + 1), F.greatest(a - i * PLACE, F.lit(0)) + 1, F.least(b - i * PLACE, F.lit(PLACE)) - F.greatest(a - i * PLACE, F.lit(0)))
        return F.when(b > a, F.array_join(F.transform(F.sequence(first, last), part), "")).otherwise(F.lit(""))

    kept = F.transform(most["keeps"], lambda c: F.concat(piece(c["since"], c["at"]), F.lit(instead)))
    cut = F.concat(F.array_join(kept, ""), piece(most["last"], F.length(value)))
    # A filter that comes later stays above this column, as no filter passes one that counts rows; put into these expressions,
    # each of which uses the one before several times, a filter on the text would outgrow the driver's memory.
    clean = F.when(F.monotonically_increasing_id() >= 0, F.when(most.isNotNull(), cut).otherwise(value))
    return found.withColumn(text, clean).drop(base, every, ends, cuts)
