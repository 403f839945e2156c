"""The weak-label model against a version over single rows, kept rates on labels, odd rows."""

import numpy as np
from pyspark.sql import functions as F

from lexspark.llm import quality
from lexspark.llm.quality import BAD, GOOD, NONE

SF = "/root/testdata/sf0.1"


def test_em_equals_version_over_rows():
    rng = np.random.default_rng(1)
    truth = rng.random(4000) < 0.7
    right = np.array([0.95, 0.9, 0.8, 0.7])
    rows = np.where(rng.random((4000, 4)) < right, truth[:, None], ~truth[:, None]).astype(int)
    rows[rng.random(rows.shape) < 0.2] = NONE
    patterns, number, counts = np.unique(rows, axis=0, return_inverse=True, return_counts=True)
    post, tables = quality.em(patterns, counts.astype(float))
    own = np.where((rows == BAD).any(axis=1), 0.05, 0.95)
    for _ in range(60):
        prior = own.mean()
        log = np.tile(np.log([1 - prior, prior]), (len(rows), 1))
        for k in range(4):
            for c, w in enumerate((1 - own, own)):
                said = [w[rows[:, k] == v].sum() + 1 for v in (BAD, GOOD)]
                for v in (BAD, GOOD):
                    log[rows[:, k] == v, c] += np.log(said[v] / sum(said))
        own = 1 / (1 + np.exp(log[:, 0] - log[:, 1]))
    assert np.allclose(post[number.ravel()], own, atol=1e-6)
    assert ((own > 0.5) == truth).mean() > 0.9
    assert np.all(np.diff([tables[k, 1, GOOD] for k in range(4)]) < 0)  # the better labellers are found to be so


def test_kept_rates(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = quality.quality(docs).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id")
    rate = {r.quality: r.kept for r in got.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()}
    assert rate[1] > 0.97 and rate[0] < 0.25


def test_odd_rows(spark):
    long = "a word of a very long text. " * 40_000
    rows = [(1, None), (2, ""), (3, " \n\t"), (None, "x"), (4, "The same text. It is here twice."), (4, "The same text. It is here twice."), (5, long)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("votes", F.lit(1)).withColumn("score", F.lit(1)).withColumn("n", F.lit(1))
    got = quality.quality(docs).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and len(r.votes) == quality.LABELLERS for r in got)
    assert len({r for r in got if r.doc_id == 4}) == 1
    assert quality.quality(docs.limit(0)).collect() == []
