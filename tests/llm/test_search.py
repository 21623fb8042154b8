"""op5, op7, op8, op9, op10 and the pipeline against brute force."""

import collections
import hashlib
import random
import re

import pytest

pytest.importorskip("lodestone.llm.queries")
from lodestone.llm import decontaminate, jaccard, queries, secrets, sharding, sitestyle  # noqa: E402

DIR = "/root/testdata/sf0.001"


def runs(text):
    w = re.findall("[a-z0-9\x80-\U0010ffff]+", (text or "").lower())
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


@pytest.mark.parametrize("n", [1, 2, 3, 17, 1001])
def test_permutation(n):
    to = [sharding.permute(i, n, 7) for i in range(n)]
    assert sorted(to) == list(range(n)) and [sharding.invert(p, n, 7) for p in to] == list(range(n))


def test_shards(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    odd = spark.createDataFrame([(None, None, 1), (3, "", 2), (3, "", 2), (3, "é", 4)], "doc_id long, text string, shard int")
    for df in (docs, odd, docs.limit(0)):
        got = sharding.shard(df, 16, seed=7).collect()
        n = len(got)
        assert n == df.count() and sorted(r.row for r in got) == list(range(n))
        assert all(sharding.permute(r.row, n, 7) == r.position == r.slot * 16 + r.shard for r in got)
    assert sorted(r["size"] for r in sharding.shard(odd, 16).collect()) == [1, 1, 1, 3]


def linked(rows):
    sets = [runs(t) for _, t in rows]
    root, degree = list(range(len(rows))), [0] * len(rows)
    for i, x in enumerate(sets):
        for j, y in enumerate(sets):
            if i != j and (x == y or len(x & y) >= 0.8 * len(x | y) - 1e-9):
                degree[i] += 1
                a, b = root[i], root[j]
                root = [b if r == a else r for r in root]
    least = collections.defaultdict(lambda: 1 << 60)
    for i, (k, _) in enumerate(rows):
        least[root[i]] = min(least[root[i]], k)
    return sorted((k, least[root[i]], degree[i]) for i, (k, _) in enumerate(rows))


def test_jaccard_large_groups_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 8)
    rng = random.Random(2)
    base, rows = [f"w{rng.randrange(9999)}" for _ in range(150)], []
    for i in range(90):
        w = base[:]
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(150)] = f"z{rng.randrange(9999)}"
        rows.append((i, " ".join(w + [f"e{j}" for j in range(rng.randint(0, 30) if i % 3 == 0 else 0)])))
    rows += [(200, ""), (201, None), (202, "!!!"), (203, "a b"), (204, "A  b"), (205, "x"), (205, "x"), (206, "q r s t u v")]
    df = spark.createDataFrame([(*r, 0) for r in rows] + [(None, "a b", 0)], "doc_id long, text string, class_id int")
    got = jaccard.join(df).collect()
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in got if r.doc_id is not None) == linked(rows)
    assert [(r.class_id, r.n_links) for r in got if r.doc_id is None] == [(None, 0)]
    assert jaccard.join(df.limit(0)).count() == 0


def test_shingles_are_those_of_the_words():
    texts = ["", "A b", "one two three four five six", "É x " * 9, "a-b_c.d e" * 50]
    for t in texts:
        assert len(jaccard.shingles(t)) == len(runs(t))


def test_decontaminate_cases(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda my"
    docs = [(1, "x " * 3000 + item.upper() + " y" * 3000), (2, item.rsplit(" ", 1)[0]), (3, " ".join(item.split()[:8])), (4, None), (5, ""), (None, item), (6, "short one"), (6, "Short, one!"), (7, item), (7, "none")]
    items = [(1, item), (2, "short one"), (3, ""), (4, None), (None, "x x x x x x"), (5, item)]
    d = spark.createDataFrame([(*r, 0) for r in docs], "doc_id long, text string, containment int")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r.doc_id, r.item_id) for r in decontaminate.search(d, b).collect())
    want = sorted({(k, i) for k, t in docs for i, u in items if k is not None and i is not None and runs(u) and len(runs(t) & runs(u)) >= 0.8 * len(runs(u)) - 1e-9})
    assert got == want and (1, 1) in got and (2, 5) in got and (3, 1) not in got
    assert decontaminate.search(d, b.limit(0)).count() == 0 and decontaminate.search(d.limit(0), b).count() == 0
    left = decontaminate.clean(d, b)
    assert left.columns == d.columns and sorted(r.doc_id or 0 for r in left.collect()) == [0, 3, 4, 5]


def test_site_style(spark):
    pages = [(i, "http://h/x", f"<body><div><p>same boiler</p></div><section><p>own  text {i}</p></section></body>") for i in range(9)]
    pages += [(20, None, None), (21, "//H:80/", "<nav>n</nav><article><p>A &amp; B&nbsp;c<br>d<div class='comments'>no</div><ul><li>1<li>2</ul></article><footer>f</footer>"), (None, "", "")]
    df = spark.createDataFrame([(*p, 0) for p in pages], "page_id long, url string, html string, text int")
    got = {r.page_id: (r.text, r.n_chars) for r in sitestyle.main_text(df).collect()}
    assert all(got[i] == (f"own text {i}", 10) for i in range(9))
    assert got[20] == ("", 0) and got[21][0] == "A & B c d\n1\n2" and got[None] == ("", 0)
    assert sitestyle.main_text(df.limit(0)).count() == 0
    for page, text in (("<p>a<p>b", "a\nb"), ("<div>x<!-- y", "x"), ("<script>if(a<b)</script>z", "z"), ("a < b", "a < b"), ("<p hidden>q</p>r", "r")):
        assert sitestyle.extract(page) == text


def test_the_tree_decides(spark, monkeypatch):
    words = lambda i, n: " ".join(f"w{i}x{j}" for j in range(n))
    menu = "".join(f"<span>Link {j}</span> " for j in range(12))
    page = lambda i: f"<body><div class=x>{menu}{i}</div><article><p>{words(i, 40)}</p><div class=y>Read on and share this page</div><p>{words(-i, 9)}</p></article></body>"
    plain = lambda i: f"<body><div class=x><p>{menu}{i}</p><p>All about us</p></div><section><p>{words(i, 40)}</p></section></body>"
    rows = [(i, "http://a/", page(i)) for i in range(8)] + [(20 + i, "http://b/", plain(i)) for i in range(8)]
    # Copies of one page, which the tree would take whole, and a host of two pages, of which it says nothing.
    rows += [(40 + i, "http://c/", page(77)) for i in range(5)] + [(60 + i, "http://d/", plain(i)) for i in range(2)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in sitestyle.main_text(df).collect()}
    assert all(got[i] == words(i, 40) + "\n" + words(-i, 9) for i in range(8))
    assert all(got[20 + i] == words(i, 40) for i in range(8))
    assert len({got[40 + i] for i in range(5)}) == 1 and words(77, 40) in got[40] and "Link 3" in got[60]
    without = {r.page_id: r.text for r in sitestyle.main_text(df, tree=sitestyle.style_tree(df).limit(0)).collect()}
    assert all(without[i] != got[i] for i in [*range(8), *range(20, 28)]) and without[60] == got[60]
    monkeypatch.setattr(sitestyle, "BROADCAST_ROWS", 1)
    joined = sitestyle.main_text(df.unionByName(df.where("page_id < 3")))
    assert sorted((r.page_id, r.text) for r in joined.collect()) == sorted([*got.items(), *((i, got[i]) for i in range(3))])


def test_the_tree_finds_low_branches_in_the_table(spark):
    tree = sitestyle.style_tree(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))
    assert sitestyle.low_paths(tree).count() > 0


def test_long_and_deep_pages(spark):
    deep = "<div>" * 3000 + "bottom" + "</div>" * 3000
    df = spark.createDataFrame([(1, "http://h/", deep), (2, "http://h/", "<p>" + "word " * 200_000)], "page_id long, url string, html string")
    got = {r.page_id: r for r in sitestyle.main_text(df).collect()}
    assert got[1].text == "bottom" and got[2].n_chars == 200_000 * 5 - 1


def test_site_style_query(spark):
    import html

    def plain(page):
        inner = re.search("<article>(.*)</article>", page, re.S)[1]
        parts = (" ".join(html.unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1)\b[^>]*>", inner))
        return "\n".join(p for p in parts if p)

    want = {r.page_id: plain(r.html) for r in spark.read.parquet(f"{DIR}/pages.parquet").collect()}
    assert {r.page_id: r.text for r in queries.op9_sitestyle(spark, DIR).collect()} == want


def brute_secrets(text, table=secrets.fit(secrets.samples())):
    text = text or ""
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    a = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 6]
    b = [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    c = [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    base = sorted(a + b + c)
    more = [(m.start(), 3, m.end()) for m in re.finditer(secrets.TOKEN, text) if secrets.ratio(table, m[0]) > secrets.BOUND and not any(x < m.end() and m.start() < y for x, _, y in base)]
    written = lambda spans: ",".join(f"{secrets.KINDS[k]}:{x}:{y}" for x, k, y in spans)
    return len(a), len(b), len(c), len(more), hashlib.sha256(written(base).encode()).hexdigest(), written(sorted(base + more))


def test_secrets(spark):
    rng = random.Random(1)
    bits = ["token", "SECRET", " ", "=", ":", '"', "AKIA", "ABCDEFGHIJ0123456789", "0123456789abcdef" * 2, "é", "😀", "\x01", "api_key", ".", "xyz123", "\n", "Zq9+/wK3pLm8RtY5vB2n"]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randint(0, 14)))) for i in range(600)] + [(None, None), (700, ""), (701, "token = " + "ab " * 3)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, spans int")
    got = {r.doc_id: tuple(r)[1:] for r in secrets.report(df).collect()}
    assert all(got[k] == brute_secrets(t) for k, t in rows) and any(v[3] for v in got.values())
    assert secrets.report(df.limit(0)).count() == 0
    clean = secrets.redact(df).collect()
    assert all(brute_secrets(r.text)[5] == "" or r.text != t for r, (_, t) in zip(clean, rows) if t)
    assert [r.text for r in clean if r.doc_id == 700] == [""]


def test_models_tell_random_strings_from_identifiers():
    table = secrets.fit(secrets.samples())
    fresh = [(secrets.ratio(table, t), y) for t, y in secrets.samples(400, seed=9)]
    assert sum(r > secrets.BOUND for r, y in fresh if not y) == 0
    assert sum(r > secrets.BOUND for r, y in fresh if y) > 0.8 * sum(y for _, y in fresh)


def test_pipeline(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    one = dict(corpus_pipeline.STAGES)
    kept = one["near_copies"](spark, docs, DIR)
    classes = linked([tuple(r) for r in docs.select("doc_id", "text").collect()])
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == sorted({c for _, c, _ in classes}) and kept.columns == docs.columns
    repeated = docs.where("doc_id < 3").unionByName(docs.where("doc_id < 3"))
    assert one["near_copies"](spark, repeated, DIR).count() <= 3
    left = {r.doc_id for r in one["benchmark"](spark, docs, DIR).collect()}
    assert {r.doc_id for r in decontaminate.search(docs, spark.read.parquet(f"{DIR}/benchmark.parquet")).collect()}.isdisjoint(left)
    clean = one["secrets"](spark, docs, DIR)
    assert clean.count() == docs.count() and clean.columns == docs.columns and clean.where("n_chars <> length(text)").count() == 0
    out = corpus_pipeline.run(spark, DIR)
    assert out.columns[:2] == ["doc_id", "n_tokens"] and 0 < out.count() <= docs.count()
