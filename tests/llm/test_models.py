"""Nearest neighbours against brute force; toxicity and quality on odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexspark.llm import ann, quality, toxicity

DOCS = "doc_id bigint, text string, score string, votes string"
ROWS = [(1, None, "x", None), (2, "", None, "y"), (3, "some words here", "x", "y"), (3, "some words here", "x", "y"), (None, "more words", None, None), (5, "word " * 30_000, "x", "y")]


def brute(data, q, k=5):
    cos = {i: float(v @ data[q] / np.sqrt((v @ v) * (data[q] @ data[q]))) for i, v in data.items() if i != q}
    return cos, sorted(cos, key=lambda i: (-cos[i], i))[:k]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_nearest_recall_and_scores(spark, sf):
    """The share of rows that is seen is well under all of them, and enough."""
    rows = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    data = {r.vec_id: np.array(r.embedding, float) for r in rows.collect()}
    found = {}
    for r in ann.nearest(rows, rows.where("vec_id % 50 = 0")).collect():
        found.setdefault(r.query_id, []).append(r)
    hits = wanted = 0
    for q in (i for i in data if i % 50 == 0):
        cos, best = brute(data, q)
        own = sorted(found[q], key=lambda r: r.rank)
        assert [r.rank for r in own] == [1, 2, 3, 4, 5]
        assert all(r.score == pytest.approx(cos[r.vec_id], abs=1e-9) for r in own)
        assert [(-r.score, r.vec_id) for r in own] == sorted((-r.score, r.vec_id) for r in own)
        hits, wanted = hits + len({r.vec_id for r in own} & set(best)), wanted + 5
    assert hits >= 0.9 * wanted


def test_nearest_prunes_clustered_vectors_and_splits(spark, monkeypatch):
    """Ten thousand vectors in clusters: a small share is calibrated, recall holds; blocks and groups of few rows change nothing."""
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((60, 16)) * 3
    x = centres[rng.integers(0, 60, 10_000)] + rng.standard_normal((10_000, 16))
    shares, plain = [], ann.Index.share
    monkeypatch.setattr(ann.Index, "share", lambda self, *a, **k: shares.append(plain(self, *a, **k)) or shares[-1])
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    asked = rows.where("vec_id % 100 = 0")
    got = {(r.query_id, r.vec_id) for r in ann.nearest(rows, asked).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit[::100] @ unit.T
    near[np.arange(100), np.arange(0, 10_000, 100)] = -2
    want = {(100 * i, int(j)) for i, row in enumerate(np.argsort(-near, axis=1)[:, :5]) for j in row}
    assert shares[0] < 0.1 and len(got & want) >= 0.9 * len(want)
    monkeypatch.setattr(ann, "BLOCK", 100)
    monkeypatch.setattr(ann, "GROUP", 30)
    assert {(r.query_id, r.vec_id) for r in ann.nearest(rows, asked).collect()} == got


def test_nearest_on_odd_rows(spark):
    bad = [None, [0.0, 0.0], [1.0, None], [1.0, float("nan")], [float("inf"), 1.0], [1.0], []]
    rows = [(100 + i, v) for i, v in enumerate(bad)] + [(None, [1.0, 0.0]), (0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [2.0, 0.0]), (1, [2.0, 0.0]), (2, [3.0, 0.0]), (3, [1.0, 1.0]), (3, [0.0, 1.0]), (4, [-1.0, 0.1])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumn("cell", F.lit(1)).withColumn("query", F.lit(1))
    got = [(r.rank, r.vec_id, round(r.score, 6)) for r in ann.nearest(df, df.where("vec_id % 50 = 0"), share=1.0).orderBy("rank").collect()]
    assert got == [(1, 1, 1.0), (2, 2, 1.0), (3, 3, round(0.5**0.5, 6)), (4, 4, round(-1 / 1.01**0.5, 6))]
    assert ann.nearest(df.where("false"), df).count() == 0 and ann.nearest(df, df.where("false")).count() == 0
    lone = spark.createDataFrame([(0, [1.0]), (1, [-2.0])], "vec_id bigint, embedding array<double>")
    assert [(r.query_id, r.vec_id, r.score) for r in ann.nearest(lone, lone.where("vec_id = 0")).collect()] == [(0, 1, -1.0)]


def test_toxicity_on_odd_rows(spark):
    docs = spark.createDataFrame(ROWS, DOCS)
    labels = spark.createDataFrame([(3, 0, 1), (5, 0, None), (1, None, 0), (2, 1, 0)], "doc_id bigint, quality int, toxic int")
    for known in (labels, labels.where("false")):
        out = toxicity.score(docs, toxicity.fit(docs, known)).collect()
        assert len(out) == len(ROWS) and all(0 <= r.score <= 1 for r in out)
        assert len({r.score for r in out if r.doc_id == 3}) == 1
    assert toxicity.score(docs.where("false"), toxicity.fit(docs.where("false"), labels)).count() == 0


def test_toxicity_learns_words():
    texts = [b"calm plain words about rivers", b"vile brutish insult about rivers"] * 60
    model = toxicity.train(texts, np.array([0, 1] * 60, np.float32))
    # a passage that fills a window decides, wherever it stands; one of a few words inside a clean window need not
    passage = b"vile brutish insult about rivers " * 18
    good, bad, deep = model.scores([b"calm words", b"brutish insult", b"calm plain words about rivers " * 200 + passage + b"calm plain words about rivers " * 200])
    assert good < toxicity.THRESHOLD <= min(bad, deep)


def test_quality_on_odd_rows(spark):
    docs = spark.createDataFrame(ROWS, DOCS)
    out = quality.quality(docs).collect()
    assert len(out) == len(ROWS) and all(0 <= r.score <= 1 and 0 <= r.posterior <= 1 for r in out)
    assert quality.quality(docs.where(F.lit(False))).count() == 0
