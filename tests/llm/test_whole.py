"""Cases in which an operator once did less than its whole job."""

import random

import pytest
from pyspark.sql import functions as F

pytest.importorskip("lodestone.llm.queries")
from lodestone.llm import secrets  # noqa: E402

ALPHABETS = ["0123456789abcdef", "0123456789ABCDEF", secrets.LETTERS[:62], secrets.LETTERS[:62] + "+/", secrets.LETTERS[:62] + "-_", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"]


def test_secrets_are_found_bare_and_beside_names(spark):
    rng, table = random.Random(5), secrets.fit(secrets.samples())
    for before, after in (("", ""), ("AWS_SECRET_ACCESS_KEY=", ""), ("config/server/session-data-value/", "/read_file_name")):
        for alphabet in ALPHABETS:
            for length, least in ((20, 0.9), (32, 0.98), (40, 0.98)):
                made = [before + "".join(rng.choices(alphabet, k=length)) + after for _ in range(100)]
                assert sum(secrets.ratio(table, t) > secrets.BOUND for t in made) >= least * 100
    names = ["AWS_SECRET_ACCESS_KEY=get_default_value", "config/server/session-data-value/list", "getDefaultOptionValueFromFile", "-" * 60, "=" * 30]
    assert all(secrets.ratio(table, t) < secrets.BOUND for t in names)
    key = "wJ4rXUtnF7MIaK2MDb9xRfiCYq8LkE3zHsP6vGdT"
    df = spark.createDataFrame([(1, f"export AWS_SECRET_ACCESS_KEY={key} # x"), (2, names[0])], "doc_id long, text string")
    assert [r.text for r in secrets.redact(df).orderBy("doc_id").collect()] == ["export [secret] # x", names[0]]


def test_near_copies_keep_different_texts_of_one_id(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    base = [f"w{i}" for i in range(60)]
    near = base[:-1] + ["other"]
    texts = [(1, " ".join(base)), (1, " ".join(f"v{i}" for i in range(40))), (2, " ".join(near)), (3, "one two three four five six"), (3, "one two three four five six"), (3, "q r s t u v w"), (4, "a b c d e f"), (None, "a b c d e f")]
    docs = spark.createDataFrame([(k, t, "x") for k, t in texts], "doc_id long, text string, source string")
    kept = corpus_pipeline.drop_near_copies(spark, docs, "")
    want = {texts[0], texts[1], texts[3], texts[5], texts[6], texts[7]}
    got = [(r.doc_id, r.text) for r in kept.collect()]
    assert kept.columns == docs.columns and len(got) == len(want) and set(got) == want
    both = spark.createDataFrame([(1, " ".join(base)), (1, " ".join(near))], "doc_id long, text string")
    assert corpus_pipeline.drop_near_copies(spark, both, "").count() == 1


def test_benchmark_stage_judges_rows_and_not_ids(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    item = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").first().text
    rows = [(7, item, 1), (7, "none", 2), (8, None, 3), (8, "see " + item, 4), (None, item, 5), (9, "fine", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n long")
    left = corpus_pipeline.drop_benchmark(spark, docs, "/root/testdata/sf0.001")
    assert left.columns == docs.columns and sorted(r.n for r in left.collect()) == [2, 3, 5, 6]


def test_jaccard_ships_in_proportion_where_only_boilerplate_is_shared(spark, monkeypatch):
    """Pairs of similarity 0.4 and no link at all: what is shipped to be verified mustn't grow with their square."""
    from lodestone.llm import jaccard

    monkeypatch.setattr(jaccard, "BLOCK", 16)
    shipped, verify, rng = [], jaccard._verify, random.Random(4)
    monkeypatch.setattr(jaccard, "_verify", lambda tasks, threshold: (shipped.append(tasks.count()), verify(tasks, threshold))[1])
    base = [f"w{rng.randrange(10**6)}" for _ in range(100)]
    for n in (250, 1000):
        rows = [(i, " ".join(base + [f"z{rng.randrange(10**9)}" for _ in range(68)])) for i in range(n)]
        got = jaccard.join(spark.createDataFrame(rows, "doc_id long, text string"))
        assert got.where("n_links > 0 or class_id <> doc_id").count() == 0
    assert shipped[1] < 8 * shipped[0] and shipped[1] < 4 * 1000


def test_jaccard_finds_links_in_buckets_too(spark, monkeypatch):
    """Near copies within a family that shares boilerplate, cut into pairs of buckets; repeated rows of one key."""
    from lodestone.llm import jaccard

    monkeypatch.setattr(jaccard, "BLOCK", 4)
    split, seen = jaccard._split, []
    monkeypatch.setattr(jaccard, "_split", lambda *a: seen.append(split(*a)) or seen[-1])
    rng = random.Random(6)
    base, rows = [f"w{rng.randrange(10**6)}" for _ in range(100)], []
    for i in range(150):
        own = base + [f"z{rng.randrange(10**9)}" for _ in range(60)]
        rows.append((3 * i, " ".join(own)))
        if i % 5 == 0:
            rows += [(3 * i + 1, " ".join(own[:-3] + ["q"]))] * (1 + (i % 2))
        if i % 10 == 0:
            rows.append((3 * i + 2, " ".join(["p", *own[:-1]])))
    from test_search import linked

    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in jaccard.join(df).collect()) == linked(rows)
    assert seen[0].where("second >= 0").count() > 0 and seen[0].where("second < 0").count() > 0


def test_each_size_class_is_searched_on_its_own(spark):
    from lodestone.llm import decontaminate

    rng = random.Random(8)
    made = {n: " ".join(f"w{rng.randrange(10**6)}" for _ in range(n)) for n in (5, 7, 12, 30, 90, 300)}
    items = spark.createDataFrame([(n, t) for n, t in made.items()], "item_id long, text string")
    docs = spark.createDataFrame([(n, f"before {t} after " + "z " * (4000 - n)) for n, t in made.items()] + [(1, made[300][:200])], "doc_id long, text string")
    got = decontaminate.search(docs, items)
    assert sorted((r.doc_id, r.item_id) for r in got.collect()) == [(n, n) for n in sorted(made)]
    sketch = decontaminate.sketches(items).cache()
    classes = {r.item: r["class"] for r in sketch.select("item", "class").distinct().collect()}
    assert len(set(classes.values())) == 6
    named = docs.selectExpr("doc_id as doc", "1L as of", "text as t")
    for n in made:  # without a class its item isn't found, and the others are
        left = decontaminate.candidates(named, sketch.where(f"class <> {classes[n]}")).collect()
        assert {r.item for r in left if r.doc == r.item} == set(made) - {n}
    # A short document is a candidate of no class that it is too small for, whatever hashes it shares.
    assert [r for r in decontaminate.candidates(named, sketch).collect() if r.doc == 1] == []


NAMES = "_row doc item hash _mark _key _text _base _all _hex _TOKEN _access _assign _score _predicted unit size bands n root class_id score ids frame"


def test_stages_with_clashing_names(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    names = NAMES.split()
    docs = spark.createDataFrame([(1, "fine words are here", *range(len(names)))], "doc_id long, text string, " + ", ".join(f"`{n}` int" for n in names))
    for name, stage in corpus_pipeline.STAGES[1:4]:
        left = stage(spark, docs, "/root/testdata/sf0.001")
        assert left.columns == docs.columns and left.collect() == docs.collect(), name
    real = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    kept = corpus_pipeline.keep_quality(spark, real, "/root/testdata/sf0.001")
    more = real.selectExpr("*", "1 as _score", "2 as _predicted", "3 as score")
    again = corpus_pipeline.keep_quality(spark, more, "/root/testdata/sf0.001")
    assert again.columns == more.columns and sorted(r.doc_id for r in again.collect()) == sorted(r.doc_id for r in kept.collect()) and {tuple(r)[-3:] for r in again.collect()} == {(1, 2, 3)}


def test_stages_on_empty_tables_nulls_and_repeats(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    where = "/root/testdata/sf0.001"
    real = spark.read.parquet(f"{where}/documents.parquet")
    odd = spark.createDataFrame([(None, None), (1, None), (1, None), (2, ""), (3, "long " * 100_000), (3, "other text of that id"), (3, "other text of that id")], "doc_id long, text string").selectExpr("doc_id", "text", "cast(null as string) lang", "cast(null as string) source", "cast(null as long) n_chars")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, real.limit(0), where).count() == 0, name
        out = stage(spark, odd, where)
        assert name == "bpe" or out.columns == odd.columns
        rows = out.collect()
        if name == "near_copies":  # texts without words are copies of each other; a null id stays
            assert sorted(((r.doc_id or 0), len(r.text or "")) for r in rows) == [(0, 0), (1, 0), (3, 21), (3, 500_000)]
        elif name != "quality":
            assert len(rows) == 7, name


def test_components_with_hubs(spark, monkeypatch):
    """Hubs that are hot keys, a long path, and large graphs' way of looking for hot keys in both steps."""
    from lodestone.llm import jaccard

    monkeypatch.setattr(jaccard, "HOT", 5)
    monkeypatch.setattr(jaccard, "TASK_EDGES", 50)
    rng = random.Random(14)
    edges = [(1000, i) for i in range(60)] + [(i, i + 1) for i in range(2000, 2060)] + [(rng.randrange(3000, 3080), rng.randrange(3000, 3080)) for _ in range(60)] + [(5, 2000), (7, 7)]
    root = {n: n for e in edges for n in e}
    for _ in range(200):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    alone = {a for a, b in edges if a == b} - {n for a, b in edges if a != b for n in (a, b)}
    want = sorted((n, r) for n, r in root.items() if n not in alone)
    for large in (10**9, 0):
        monkeypatch.setattr(jaccard, "LARGE", large)
        got = jaccard.components(spark.createDataFrame(edges, "a long, b long"))
        assert sorted((r.node, r.root) for r in got.collect()) == want
    assert jaccard.components(spark.createDataFrame([], "a long, b long")).count() == 0


def redacted(text, spans):
    out, at = [], 0
    for a, _, b in spans:
        if a >= at:
            out += [text[at:a], "[secret]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def test_secrets_of_texts_with_very_many_matches(spark):
    import time

    from test_search import brute_secrets

    bits = ["token=abc123 ", "é\n", "AKIA" + "Q7" * 10 + "/", "x=", "0f" * 13 + " ", "Zq9wK3pLm8RtY5vB2nXc7 ", "words in between 😀 "]
    rng = random.Random(3)
    texts = ["".join(rng.choice(bits) for _ in range(n)) for n in (3, 40, 700, 5000)] + ["", "plain", "x" * 30_000 + "token=abc123"]
    df = spark.createDataFrame([(i, t, 1, 2, 3, 4, 5, 6, 7) for i, t in enumerate(texts)], "doc_id long, text string, _base int, _all int, _hex int, _TOKEN int, _plain int, _found int, _cuts int")
    found = {r.doc_id: r for r in secrets.report(df).collect()}
    for i, t in enumerate(texts):
        want = brute_secrets(t)
        assert (found[i].n_assign, found[i].n_access, found[i].n_hex, found[i].n_markov, found[i].base_sha256, found[i].spans) == want
    clean = secrets.redact(df)
    assert clean.columns == df.columns
    for r in clean.collect():
        spans = [(int(a), k, int(b)) for k, a, b in (x.split(":") for x in found[r.doc_id].spans.split(",") if x)]
        assert r.text == redacted(texts[r.doc_id], spans) and tuple(r)[2:] == (1, 2, 3, 4, 5, 6, 7)
    took = []
    for n in (2_000, 100_000):
        many = spark.createDataFrame([(1, "token=abc123 Zq9wK3pLm8RtY5vB2nXc7 " * n)], "doc_id long, text string")
        began = time.time()
        assert secrets.report(many).first().n_assign == n
        assert secrets.redact(many).selectExpr("length(text) as n").first().n == 18 * n
        took.append(time.time() - began)
    assert took[1] < 50 * took[0], took


def test_recall_and_false_alarms_on_documents(spark):
    """Random tokens planted in documents are found, and next to nothing is in documents as they are."""
    rng = random.Random(12)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("text is not null").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    plain = sum(r.n_markov for r in secrets.report(docs.repartition(8)).collect())
    planted = []
    for k, t in rows[:400]:
        words = t.split(" ")
        words.insert(rng.randrange(len(words) + 1), "".join(rng.choices(ALPHABETS[k % len(ALPHABETS)], k=rng.randint(28, 44))))
        planted.append((k, " ".join(words)))
    found = secrets.report(spark.createDataFrame(planted, "doc_id long, text string").repartition(8)).collect()
    assert plain <= 0.002 * len(rows) and sum(r.n_markov + r.n_hex > 0 for r in found) >= 0.97 * len(planted)


def test_filters_on_redacted_texts(spark):
    """Such a filter once went into every expression that the text is made of, until the driver's memory was full."""
    rows = [(i, f"password = hunter{i}2 {'word ' * i}") for i in range(20)]
    clean = secrets.redact(spark.createDataFrame(rows, "doc_id long, text string")).withColumn("n", F.length("text"))
    assert clean.where("n <> length(text)").count() == 0
    assert clean.where("text like '%[secret]%' and doc_id < 5").count() == 5
    plan = clean.where("n <> length(text)")._jdf.queryExecution().optimizedPlan()
    assert len(plan.toString()) < 10_000_000


def test_words_of_many_texts_are_encoded_once():
    """The library is called for 600,000 different words the first time only, and then for first words alone."""
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from lodestone.llm import tokenfile

    with open(public_tokenizers.path("byte_bpe_50k.json"), "rb") as f:
        words = tokenfile.Words(f.read(), 2)
    texts = [" ".join(["first", *(f"w{i}" for i in range(at, at + 10_000))]) for at in range(0, 600_000, 10_000)]
    before = [words.encode(t) for t in texts]
    library, asked = words._ids, []
    words._ids = lambda text: asked.append(text) or library(text)
    assert [words.encode(t) for t in texts] == before and set(asked) == {"first"}


def test_words_of_known_parts_do_not_go_to_the_library():
    """40,000 different words of 400 parts: the library gets each part once, not each word."""
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from lodestone.llm import tokenfile

    with open(public_tokenizers.path("byte_bpe_50k.json"), "rb") as f:
        words = tokenfile.Words(f.read(), 2)
    texts = [" ".join(["first", *(f"stem{a:c}é,\n{b:c}nd" for b in range(0x100, 0x1C8))]) for a in range(0x100, 0x1C8)]
    library, asked = words._ids, []
    words._ids = lambda text: asked.append(text) or library(text)
    coded = [words.encode(t) for t in texts]
    assert sum(map(len, asked)) < sum(map(len, texts)) / 10
    assert coded[::20] == [library(t).tobytes() for t in texts[::20]]
