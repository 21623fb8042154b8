"""op2, op4: held-out accuracy, and the cases of the docstrings."""

import numpy as np
import pytest

pytest.importorskip("lodestone.llm.queries")
from lodestone.llm import quality, queries, toxicity  # noqa: E402

DIR = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name, label, least", [("op2_toxicity", "toxic", 0.9), ("op4_quality", "quality", 0.9)])
def test_held_out(spark, name, label, least):
    got = queries.QUERIES[name](spark, DIR)
    labels = spark.read.parquet(f"{DIR}/labels.parquet")
    rows = got.where("held_out").join(labels, "doc_id").select("score", "predicted", label).collect()
    assert got.count() == spark.read.parquet(f"{DIR}/documents.parquet").count()
    assert all(0 <= r.score <= 1 for r in rows)
    assert np.mean([r.predicted == r[label] for r in rows]) >= least


def odd(spark):
    return spark.createDataFrame([(1, None, "x"), (2, "", "x"), (2, "", "x"), (None, "a b", None), (5, "wort " * 40_000, "y")], "doc_id long, text string, score string")


def test_cases(spark):
    docs = odd(spark)
    labels = spark.createDataFrame([(1, 0, 1), (2, 1, 0), (None, 1, 1), (5, None, 1)], "doc_id long, quality int, toxic int")
    from pyspark.sql import functions as F

    for module in (toxicity, quality):
        got = module.classify(docs, module.train(docs, labels, F.lit(True))).collect()
        assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
        empty = module.train(docs.limit(0), labels.limit(0), F.lit(True))
        assert module.classify(docs.limit(0), empty).count() == 0
        assert len({r.score for r in module.classify(docs, empty).collect()}) == 1
    kept = quality.classify(docs, quality.fit([]), carry=True)
    assert kept.columns == ["doc_id", "text", "score", "_score", "_predicted"] and kept.count() == 5


def test_whole_text_is_scored():
    network = quality.fit([("good words here and there", 1), ("@@## $$%% !!", 0)] * 8)
    assert network.score("fine words " * 3000) != network.score("fine words " * 3000 + "@@## $$%% !! " * 50)
    rows = quality.chunks("x" * 1000)
    assert len(rows) == 4 and rows.shape[1] == quality.CHUNK


def test_blocks_do_not_change_features(monkeypatch):
    text = "Some words, é and others " * 300
    whole = toxicity.features(text)
    monkeypatch.setattr(toxicity, "BLOCK", 97)
    assert (toxicity.features(text) == whole).all()


def plain_toxicity(text):
    """The hashed n-grams of a text, one by one."""
    data, out = (" " + " ".join(text.lower().split()) + " ").encode(), set()
    for size in toxicity.SIZES:
        for i in range(len(data) - size + 1):
            h = 0
            for k in range(size):
                h = (h * 0x01000193 + (data[i + k] + 1) * ((k + 1) * 2 + 1)) % 2**32
            out.add(((h ^ h >> 15) * 2654435761 % 2**32) >> (32 - toxicity.BITS))
    return sorted(out)


def plain_network(network, text):
    """Each filter at each place of each chunk, one by one."""
    data, z = text.encode(), []
    for start in range(0, max(1, len(data) - (quality.CHUNK - quality.STEP)), quality.STEP):
        part = [*data[start : start + quality.CHUNK], *[256] * quality.CHUNK][: quality.CHUNK]
        z.append([max(0.0, max(sum(float(network.filters[k, part[i + k], f]) for k in range(quality.WIDTH)) for i in range(quality.CHUNK - quality.WIDTH + 1))) for f in range(quality.FILTERS)])
    z = np.array(z)
    margin = float(np.concatenate([z.mean(0), z.max(0)]) @ network.out + network.bias)
    return 1 / (1 + np.exp(-margin))


def test_scores_against_plain_loops(spark):
    rng = np.random.default_rng(3)
    texts = ["", "é", "ab", "some words and more", "x" * 256, "y" * 257, " ".join(f"w{i}" for i in range(300)), "Ünï " * 200]
    for t in texts[:6]:
        assert toxicity.features(t).tolist() == plain_toxicity(t)
    network = quality.Network(rng.normal(0, 1, (quality.WIDTH, 257, quality.FILTERS)), rng.normal(0, 0.2, 2 * quality.FILTERS), 0.1)
    df = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    for r in quality.classify(df, network).collect():
        assert abs(r.score - plain_network(network, texts[r.doc_id])) < 1e-4 and r.predicted == int(r.score >= 0.7)
    model = (rng.normal(0, 0.3, 1 << toxicity.BITS).astype(np.float32), -0.2)
    for r in toxicity.classify(df, model).collect():
        want = 1 / (1 + np.exp(-float(np.clip(model[0][plain_toxicity(texts[r.doc_id])].sum(dtype=np.float64) + model[1], -30, 30))))
        assert abs(r.score - want) < 1e-6 and r.predicted == int(r.score >= 0.5)


@pytest.mark.parametrize("name, label, rare", [("op2_toxicity", "toxic", 1), ("op4_quality", "quality", 0)])
def test_a_constant_would_fail(spark, name, label, rare):
    """Half of the mean of both classes' shares is what any constant gets; and labels that were held out rank by score."""
    labels = spark.read.parquet(f"{DIR}/labels.parquet")
    rows = queries.QUERIES[name](spark, DIR).where("held_out").join(labels, "doc_id").select("score", "predicted", label).collect()
    right = [np.mean([r.predicted == r[label] for r in rows if r[label] == y]) for y in (0, 1)]
    assert np.mean(right) >= 0.75 and right[rare] >= 0.5
    pairs = [(a.score > b.score) + 0.5 * (a.score == b.score) for a in rows if a[label] == 1 for b in rows if b[label] == 0]
    assert np.mean(pairs) >= 0.85


def test_the_sample_is_bounded(spark, monkeypatch):
    from pyspark.sql import functions as F

    from lodestone.llm import common

    monkeypatch.setattr(common, "LEARNED", 20)
    docs = spark.createDataFrame([(1, "b"), (1, "a"), (1, "a"), (2, "x" * 21), (3, "c")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 1), (3, 0)], "doc_id long, toxic int")
    got = common.labelled_sample(docs, labels, "toxic", 5, F.lit(True))
    assert sorted(tuple(r) for r in got.collect()) == [(1, "a", 1), (3, "c", 0)]


def test_very_long_text_is_scored(spark):
    df = spark.createDataFrame([(1, "wort und " * 150_000)], "doc_id long, text string")
    assert 0 <= quality.classify(df, quality.fit([])).first().score <= 1 and 0 <= toxicity.classify(df, toxicity.fit([])).first().score <= 1
