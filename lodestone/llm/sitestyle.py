"""Main text of web pages by a site style tree.

The pages of a host are merged into one tree of element paths (tag and class of every element from the root). Of each
path two distributions over its pages are counted: of the presentation (the sequence of child elements) and of the
content (runs of up to RUN words of the text directly below it). The entropy of a run over the pages that have the path
says how little it tells: a run on all pages has importance 0, one on a single page 1. The importance of a branch is
that of its presentation and of all runs in it, those of its descendants too. Branches whose importance is low beside
that of the host's bulk of text are removed, the highest first.

Where the tree can't tell (a host of few pages, a menu that differs from page to page), two rules break the tie: elements
whose tag, class or role names a menu, an advert and the like go; and where a page has text in an article or main element,
only such text stays. In an article the tree removes only what tells next to nothing (LOWEST in place of LOW), since
headings of articles recur.
"""

from __future__ import annotations

import html
import re
from collections.abc import Container

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, map_rows

#: The share that presentation has in the importance of a branch; the words of a run.
PRESENTATION, RUN = 0.1, 16
#: Importance, as a share of that of the host's bulk of text, below which a branch is low, and the same within an article;
#: the pages that a path must be on before it can be low; the share of a host's runs that a path must have to be bulk.
LOW, LOWEST, LEAST_PAGES, BULK = 0.9, 0.3, 3, 0.1
#: Levels of the tree: what lies deeper belongs to the element of the last level.
LEVELS = 48
#: Low paths (8 bytes each) up to which they are sent to every executor; beyond, they are joined to the pages.
BROADCAST_ROWS = 200_000

# Elements of the HTML standard by their role here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe object svg math select".split())
BLOCK = frozenset(
    "html body address article aside blockquote center details dialog dd dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr "
    "legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption".split()
)
CLOSES_P = BLOCK - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "legend", "html", "body"}
MAIN = frozenset(("article", "main"))
NOISE = frozenset("head nav header footer aside form menu dialog button input label fieldset search".split()) | RAW
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
NOISE_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notices?|newsletter|subscribe|signup|login|popup|modal|overlay|nav\w*|menus?|breadcrumbs?|"
    r"header|masthead|footer|copyright|side-?bar|aside|widgets?|related|recommend\w*|share|sharing|social|comments?|comment\w+|disqus|repl(?:y|ies)|toolbar|pagination|pager|skip\w*|hidden)(?:$|[\s_-])"
)
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BOUNDARY = {"ul", "ol", "dl", "table", "menu"}

_TAG = re.compile(r"""<(?:!--(?:.*?--!?>|.*)|[!?][^>]*>?|(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*)>?)""", re.S)
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")


class _Open:
    __slots__ = ("tag", "path", "level", "noise", "main", "low", "children")

    def __init__(self, tag, path, level, noise, main, low):
        self.tag, self.path, self.level, self.noise, self.main, self.low, self.children = tag, path, level, noise, main, low, []


_PATHS: dict[tuple[int, str], int] = {}


def _path(parent: int, label: str) -> int:
    found = _PATHS.get((parent, label))
    if found is None:
        if len(_PATHS) > 100_000:
            _PATHS.clear()
        found = _PATHS[parent, label] = xxhash.xxh64_intdigest(label, parent & 0xFFFFFFFFFFFFFFFF) - (1 << 63)
    return found


def host_of(url: str | None) -> str:
    found = re.match(r"\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return found[1].lower() if found else ""


def read(page: str, root: int = 0, low: Container[int] = (), lowest: Container[int] = ()):
    """(blocks, elements): blocks are (text, path, noise by name, inside an article or main element, in a low branch) in
    page order, elements (path, paths above it, labels of the children) as they close. Paths start at ``root``, a number
    of the host. Tags that never close end with their parents, a p at the next block; an end tag without its element is
    ignored; what is cut off at the end is read as far as it goes."""
    stack, blocks, elements, pieces = [_Open("", root, 0, False, False, False)], [], [], []
    small = None

    def flush():
        if pieces:
            text = " ".join(html.unescape("".join(pieces)).split())
            if text:
                top = stack[-1]
                for node in reversed(stack):
                    if node.tag in BLOCK or not node.tag:
                        top = node
                        break
                blocks.append((text, top.path, stack[-1].noise, stack[-1].main, stack[-1].low))
            pieces.clear()

    def close(depth):
        while len(stack) > depth:
            node = stack.pop()
            if node.level < LEVELS:
                elements.append((node.path, [n.path for n in stack[: LEVELS + 1]], node.children))

    at, end = 0, len(page)
    while at < end:
        start = page.find("<", at)
        if start < 0:
            pieces.append(page[at:])
            break
        if start > at:
            pieces.append(page[at:start])
        m = _TAG.match(page, start)
        if not m:
            pieces.append("<")
            at = start + 1
            continue
        at = m.end()
        tag = m[2]
        if not tag:
            continue
        tag = tag.lower()
        if m[1]:
            if tag in BLOCK:
                flush()
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    close(i)
                    break
            continue
        if tag == "br":
            pieces.append(" ")
            continue
        if tag in BLOCK:
            flush()
            if tag in CLOSES_P:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == "p":
                        close(i)
                        break
                    if stack[i].tag in BLOCK:
                        break
        if tag in SIBLINGS:
            flush()
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in SIBLINGS[tag]:
                    close(i)
                    break
                if stack[i].tag in BOUNDARY:
                    break
        if tag == "body":
            for i in range(1, len(stack)):
                if stack[i].tag == "head":
                    close(i)
                    break
        top = stack[-1]
        label, noise = tag, top.noise or tag in NOISE
        if m[3]:
            given = {a.lower(): b or c or d for a, b, c, d in _ATTRIBUTE.findall(m[3])}
            names = (given.get("class", "") + " " + given.get("id", "")).lower().strip()
            if names:
                label += "." + names
                noise = noise or bool(NOISE_NAMES.search(names)) and tag not in ("html", "body", "article", "main")
            noise = noise or given.get("role", "").lower() in NOISE_ROLES or given.get("aria-hidden") == "true" or "hidden" in m[3].replace(",", " ").replace("/", " ").split()
        top.children.append(label)
        if tag in VOID:
            continue
        if tag in RAW:
            small = small or page.lower()
            stop = small.find("</" + tag, at) if len(small) == end else _find(page, tag, at)
            if stop < 0:
                break
            close_at = page.find(">", stop)
            at = end if close_at < 0 else close_at + 1
            continue
        path, main = _path(top.path, label) if top.level < LEVELS else top.path, top.main or tag in MAIN
        stack.append(_Open(tag, path, top.level + 1, noise, main, top.low or path in (lowest if main else low)))
    flush()
    close(0)
    return blocks, elements


def _find(page: str, tag: str, at: int) -> int:
    """For pages whose lower-casing changes their length."""
    found = re.compile("</" + tag, re.I).search(page, at)
    return found.start() if found else -1


def root_of(url: str | None) -> int:
    return xxhash.xxh64_intdigest(host_of(url)) - (1 << 63)


def extract(page: str, root: int = 0, low: Container[int] = (), lowest: Container[int] = ()) -> str:
    """The blocks outside of low branches that aren't noise by name; of these, those in an article or main element where
    the page has one with text. An article that would go as a whole (a host of copies of one page) stays."""
    blocks = [b for b in read(page, root, low, lowest)[0] if not b[2]]
    own = [b for b in blocks if b[3]]
    return "\n".join(b[0] for b in [b for b in own if not b[4]] or own or [b for b in blocks if not b[4]])


def runs(text: str) -> list[str]:
    words = text.split(" ")
    return [" ".join(words[i : i + RUN]) for i in range(0, len(words), RUN)]


def style_tree(pages: DataFrame, url: str = "url", page: str = "html") -> DataFrame:
    """(root, path, above, pages, presentation, content, importance, best) of every element path of every host: content
    and importance of the branch below it, null where it has no text, and best, the importance of the path of the host that has the bulk of its
    text. Each page gives a row for each path and for each run of words; these are counted before they are shuffled, and
    only sums of counts and of count times logarithm are kept for each path, so that a host with very many pages needs no
    large group."""

    def make():
        def each(address, source):
            root, shown, said = root_of(address), {}, set()
            blocks, elements = read(source or "", root)
            for path, above, children in elements:
                shown.setdefault(path, (above, []))[1].append(",".join(c for c, b in zip(children, [None, *children]) if c != b))
            for text, path, *_ in blocks:
                said.update((path, run) for run in runs(text))
            for path, (above, kinds) in shown.items():
                yield path, above, 0, xxhash.xxh64_intdigest(";".join(dict.fromkeys(kinds))) - (1 << 63)
            for path, run in said:
                yield path, None, 1, xxhash.xxh64_intdigest(run) - (1 << 63)

        return each

    rows = map_rows(pages, [url, page], "path long, above array<long>, kind int, value long", make)
    counted = rows.groupBy("path", "above", "kind", "value").agg(F.count("*").cast("double").alias("c"))
    of = lambda kind, x: F.sum(F.when(F.col("kind") == kind, x))
    sums = counted.groupBy("path", "above").agg(of(0, F.col("c")).alias("pages"), of(0, F.col("c") * F.ln("c")).alias("shown"), of(1, F.lit(1.0)).alias("runs"), of(1, F.ln("c")).alias("said"))
    # Rows of runs don't carry what is above their path: a path has two rows by now.
    sums = checkpointed(sums.groupBy("path").agg(F.max("above").alias("above"), *[F.sum(c).alias(c) for c in ("pages", "shown", "runs", "said")]).where("above is not null"))
    m = F.col("pages")
    entropy = F.when((m > 1) & (F.col("runs") > 0), F.col("said") / F.ln(m)).otherwise(F.lit(0.0))
    known = sums.select("path", "above", F.coalesce(F.get("above", F.lit(0)), "path").alias("root"), m.cast("long").alias("pages"), F.coalesce("runs", F.lit(0.0)).alias("runs"), entropy.alias("entropy"),
        F.when(m > 1, 1 - F.col("shown") / m / F.ln(m)).otherwise(F.lit(1.0)).alias("presentation"))
    branch = known.select(F.explode(F.array_distinct(F.concat("above", F.array("path")))).alias("path"), "runs", "entropy")
    branch = branch.groupBy("path").agg(F.sum("runs").alias("all"), F.sum("entropy").alias("lost"))
    host = known.groupBy("root").agg(F.sum("runs").alias("total"))
    bulk = known.join(host, "root").where(F.col("runs") > 0).where(F.col("runs") >= BULK * F.col("total"))
    mixed = lambda content: PRESENTATION * F.col("presentation") + (1 - PRESENTATION) * content
    best = bulk.groupBy("root").agg(F.max(mixed(1 - F.col("entropy") / F.col("runs"))).alias("best"))
    whole = known.drop("runs", "entropy").join(branch, "path").join(best, "root", "left")
    content = F.when(F.col("all") > 0, 1 - F.col("lost") / F.col("all"))
    return whole.select("root", "path", "above", "pages", "presentation", content.alias("content"), mixed(content).alias("importance"), "best")


def low_paths(tree: DataFrame) -> DataFrame:
    """(path, lowest): the low branches of a style tree, and whether they are low enough to go from an article too. The
    page itself (the root, html and body) is never one."""
    share = F.col("importance") / F.col("best")
    return tree.where((F.col("pages") >= LEAST_PAGES) & (F.col("best") > 0) & (share < LOW) & (F.size("above") > 2)).select("path", (share < LOWEST).alias("lowest"))


def main_text(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html", tree: DataFrame | None = None) -> DataFrame:
    """(key, url, text, n_chars) of every page: blocks of the article in page order, joined by a line feed.

    A null or empty page has the empty text; a null url is of the host without a name; repeated rows give repeated rows
    and count as pages of their own; a null key stays; other columns aren't carried. ``tree`` may be the style tree of
    other pages, or an empty one. Low paths are few for each host and sent to all executors, up to BROADCAST_ROWS; beyond
    that each page is joined with those of its own paths that are low."""
    low = low_paths(style_tree(pages, url, page) if tree is None else tree)
    found = low.limit(BROADCAST_ROWS + 1).collect()
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}
    named = pages.select(F.col(key).alias("_key"), F.col(url).alias("_url"), F.col(page).alias("_page"))
    schema = f"`{key}` {kinds[key]}, `{url}` {kinds[url]}, text string, n_chars long"
    if len(found) <= BROADCAST_ROWS:
        packed = [np.array([r.path for r in found if not least or r.lowest], np.int64).tobytes() for least in (False, True)]
        sent = pages.sparkSession.sparkContext.broadcast(packed)

        def make():
            all_low, all_lowest = (frozenset(np.frombuffer(x, np.int64).tolist()) for x in sent.value)

            def each(k, address, source):
                text = extract(source or "", root_of(address), all_low, all_lowest)
                yield k, address, text, len(text)

            return each

        return map_rows(named, ["_key", "_url", "_page"], schema, make)

    def paths():
        def each(of, address, source):
            return ((of, path) for path in {path for path, _, _ in read(source or "", root_of(address))[1]})

        return each

    def apart():
        def each(k, address, source, own):
            text = extract(source or "", root_of(address), {r["path"] for r in own or ()}, {r["path"] for r in own or () if r["lowest"]})
            yield k, address, text, len(text)

        return each

    # Pages of equal address and source have equal paths, so they may share a list.
    named = named.withColumn("_of", F.struct(F.xxhash64("_url", "_page").alias("a"), F.xxhash64("_page", "_url", F.lit(1)).alias("b")))
    held = map_rows(named.dropDuplicates(["_of"]), ["_of", "_url", "_page"], "of struct<a:long,b:long>, path long", paths).join(low, "path")
    lists = checkpointed(held.groupBy("of").agg(F.collect_list(F.struct("path", "lowest")).alias("_low")))
    joined = named.join(lists, F.col("_of") == F.col("of"), "left")
    return map_rows(joined, ["_key", "_url", "_page", "_low"], schema, apart)
