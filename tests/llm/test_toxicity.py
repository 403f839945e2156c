"""The network against plain versions, its long words, odd rows, and what the recurrence adds."""

import copy

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexspark.llm import toxicity
from lexspark.llm.toxicity import HIDDEN, Network, grams, prepared, read, sigmoid

SF = "/root/testdata/sf0.01"


def plain_logit(net: Network, words: list[bytes]) -> float:
    """One window, step by step."""
    p, states = net.p, []
    if not words:
        return float(p["c"][0])
    inputs = []
    for w in words:
        rows, _ = grams([w])
        inputs.append(p["table"][rows].sum(axis=0) / np.sqrt(len(rows)) @ p["U"] + p["b"])
    for d, w in enumerate((p["Wf"], p["Wb"])):
        h, own = np.zeros(HIDDEN), []
        for x in inputs if d == 0 else inputs[::-1]:
            a, r = x[d * 3 * HIDDEN : (d + 1) * 3 * HIDDEN], h @ w
            z, s = sigmoid(a[:HIDDEN] + r[:HIDDEN]), sigmoid(a[HIDDEN : 2 * HIDDEN] + r[HIDDEN : 2 * HIDDEN])
            h = (1 - z) * np.tanh(a[2 * HIDDEN :] + s * r[2 * HIDDEN :]) + z * h
            own.append(h)
        states.append(own if d == 0 else own[::-1])
    both = np.array([np.concatenate((a, b)) for a, b in zip(*states, strict=True)])
    e = np.exp(both @ p["v"])
    return float((e / e.sum()) @ both @ p["o"] + p["c"][0])


TEXTS = [b"", b"one", b"a b c d e f g", b" ".join(b"w%d" % (i % 7) for i in range(48))]


def test_forward_equals_plain_version():
    net = Network(np.random.default_rng(1))
    own, text, word, size = prepared(TEXTS)
    got = net.run(net.inputs(own), word, size)
    assert text.tolist() == [0, 1, 2, 3]
    assert np.allclose(got, [plain_logit(net, t.split()) for t in TEXTS], atol=1e-4)


@pytest.mark.parametrize("name", ["Wf", "Wb", "v", "o", "c", "dx"])
def test_gradients_equal_differences(name):
    net = Network(np.random.default_rng(2))
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    own, _, word, size = prepared(TEXTS[1:3])
    x = net.inputs(own).astype(np.float64)
    y = np.array([1.0, 0.0])
    loss = lambda: float(np.log1p(np.exp(-(2 * y - 1) * net.run(x, word, size))).sum())
    out, cache = net.run(x, word, size, keep=True)
    g = net.gradients(x, word, size, sigmoid(out) - y, cache)[name]
    at = x if name == "dx" else net.p[name]
    for i in list(np.ndindex(at.shape))[:: max(1, at.size // 20)]:
        if name == "dx" and i[0] == len(x) - 1:
            continue
        was, at[i] = at[i], at[i] + 1e-3
        up = loss()
        at[i] = was - 1e-3
        down = loss()
        at[i] = was
        assert abs((up - down) / 2e-3 - g[i]) < 2e-3


def test_long_runs_count_to_their_end():
    assert read(b"x" * 40) == [b"x" * 40]
    parts = read(bytes(range(97, 97 + 26)) * 8)
    assert len(parts) > 1 and all(len(p) <= toxicity.PART for p in parts) and parts[-1].endswith(b"xyz")
    bad, good = [b"scum", b"vermin", b"worthless"], [b"tree", b"river", b"window", b"apple"]
    rng = np.random.default_rng(3)
    text = lambda words, n: b"".join(words[k] for k in rng.integers(0, len(words), n))
    clean = [text(good, 30) for _ in range(150)]
    toxic = [text(good, 30) + text(bad, 4) for _ in range(150)]
    model = toxicity.train(clean + toxic, np.repeat([0.0, 1.0], 150).astype(np.float32))
    fresh = [text(good, 45), text(good, 45) + text(bad, 4)]  # some 200 characters without a space, toxic at the end
    a, b = model.scores(fresh)
    assert a < toxicity.THRESHOLD <= b


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "you are scum"), (3, "fine words"), (3, "fine words"), (4, "x" * 5000), (5, "you are scum " * 2000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("score", F.lit("old")).withColumn("toxic", F.lit("t")).withColumn("_id", F.lit(0))
    labels = spark.createDataFrame([(3, 0), (3, None), (5, 1), (None, 1), (6, 1)], "doc_id bigint, toxic int")
    model = toxicity.fit(docs, labels)
    got = toxicity.score(docs, model)
    assert got.columns == ["doc_id", "text", "toxic", "_id", "score"]
    assert got.count() == len(rows) and got.where("score between 0 and 1").count() == len(rows)
    for no in (toxicity.fit(docs.limit(0), labels), toxicity.fit(docs, labels.limit(0))):
        assert toxicity.score(docs.limit(0), no).count() == 0 and {r.score for r in toxicity.score(docs, no).collect()} == {0.0}


def test_the_recurrence_lowers_false_alarms(spark):
    """The network against the same one without its recurrent weights, on held-out rows."""
    docs = spark.read.parquet(f"{SF.replace('0.01', '0.1')}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF.replace('0.01', '0.1')}/labels.parquet")
    model = toxicity.fit(docs, labels)
    rows = docs.join(labels.where("toxic is not null"), "doc_id").where(toxicity.held_out("doc_id", 4, 2)).collect()
    y, texts = np.array([r.toxic for r in rows]), [(r.text or "").encode() for r in rows]
    score = model.scores(texts)
    still = copy.deepcopy(model)
    for k in ("Wf", "Wb"):
        still.network.p[k][:] = 0
    loss = lambda s: float(-np.mean(y * np.log(np.clip(s, 1e-6, 1)) + (1 - y) * np.log(np.clip(1 - s, 1e-6, 1))))
    assert ((score >= toxicity.THRESHOLD) == y).mean() > 0.95 and (score[y == 1] >= toxicity.THRESHOLD).mean() > 0.85
    assert loss(score) < loss(still.scores(texts))
