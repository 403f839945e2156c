"""Quality: a weak-label model over heuristic labellers, and a hashed linear scorer trained on its posteriors.

Each labeller votes good, bad or nothing on a whole text. Votes are counted by pattern over all documents (at most
3 ** LABELLERS rows reach the driver); expectation-maximisation on these counts estimates the labellers' accuracies and
the share of good texts, and gives each pattern its posterior. It starts from texts without a bad vote as the good ones.
A linear model on hashed byte n-gram frequencies learns the posteriors from a bounded sample (about SAMPLE rows, of any
length, by a hash of id and text; the workers hash their n-grams, so no text reaches the driver) and scores every whole
text.

Null and empty texts get the votes of a text without words. Repeated rows: same result, learnt once. Very long texts
are read whole. Ties: a score of THRESHOLD is kept. A sample of one kind only: every score is near that kind. Other
columns are not looked at. Empty table: no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspark.llm.common import as_bytes, blocks

SAMPLE, HASHED, LABELLERS = 3000, 1 << 16, 9
THRESHOLD = 0.5
GOOD, BAD, NONE = 1, 0, 2
_SYMBOLS = b"#$%&*+<=>@[]^_`{|}~\\"
_MARKS = frozenset(_SYMBOLS + b"!?~")
_DIGITS = b"0123456789"
_CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def votes(text: bytes) -> tuple[int, ...]:
    """Votes of the labellers: length, mean word, symbols, digits and capitals, repeated words, commonest word, repeated lines, sentence ends, words of or ending in several marks."""
    words = text.split()
    n, size = len(words), max(1, len(text))
    count = Counter(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    mean = sum(map(len, words)) / max(1, n)
    symbols = 1 - len(text.translate(None, _SYMBOLS)) / size
    digits = 1 - len(text.translate(None, _DIGITS)) / size
    capitals = 1 - len(text.translate(None, _CAPITALS)) / size
    ends = sum(w[-1:] in (b".", b"!", b"?") for w in words)
    marked = sum(w[-1] in _MARKS and (len(w) == 1 or w[-2] in _MARKS) for w in words)
    pick = lambda bad, good: BAD if bad else GOOD if good else NONE
    return (
        pick(n < 2, n >= 20),
        pick(mean < 2 or mean > 16, 3 <= mean <= 11),
        pick(symbols > 0.05, symbols < 0.02),
        pick(digits > 0.15 or capitals > 0.4, digits < 0.05 and capitals < 0.2),
        pick(n >= 20 and len(count) < 0.3 * n / (1 + n / 2000), n >= 20 and len(count) > 0.45 * n / (1 + n / 2000)),
        pick(n >= 10 and max(count.values()) > 0.2 * n, n >= 10 and max(count.values()) < 0.12 * n),
        pick(len(lines) > 3 and len(set(lines)) < 0.7 * len(lines), len(set(lines)) == len(lines) > 0),
        pick(n >= 20 and ends < n / 80, ends > n / 40),
        pick(n >= 5 and marked > 0.1 * n, marked < 0.02 * n),
    )


def em(patterns: np.ndarray, counts: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of good for each pattern, and the labellers' tables P(vote | class) [labeller, class, vote]."""
    post = np.where((patterns == BAD).any(axis=1), 0.05, 0.95)
    tables = np.zeros((patterns.shape[1], 2, 3))
    for _ in range(rounds):
        prior = np.clip((post * counts).sum() / counts.sum(), 0.01, 0.99)
        logs = np.log(np.array([1 - prior, prior]))[None, :].repeat(len(patterns), 0)
        for k in range(patterns.shape[1]):
            for c, w in enumerate((1 - post, post)):
                tables[k, c] = np.bincount(patterns[:, k], w * counts, 3) + 1
                tables[k, c] /= tables[k, c, [BAD, GOOD]].sum()
            # an abstention is no evidence
            logs += np.where(patterns[:, k, None] == NONE, 0, np.log(tables[k][:, patterns[:, k]]).T)
        logs -= logs.max(axis=1, keepdims=True)
        p = np.exp(logs)
        post = p[:, 1] / p.sum(axis=1)
    return post, tables


def hashed(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Rows and square-rooted frequencies of the text's byte 2- and 4-grams; classes of bytes, not words, are meant to count."""
    x = np.frombuffer(b" " + text.lower() + b" ", np.uint8).astype(np.uint32)
    with np.errstate(over="ignore"):
        two = (x[:-1] * np.uint32(257) + x[1:]) * np.uint32(0x9E3779B1) >> np.uint32(17)
        four = (((x[:-3] * np.uint32(257) + x[1:-2]) * np.uint32(263) + x[2:-1]) * np.uint32(269) + x[3:]) * np.uint32(0x85EBCA77) >> np.uint32(17) if len(x) > 3 else np.zeros(0, np.uint32)
    count = np.bincount(np.concatenate((two, four + np.uint32(HASHED // 2))), minlength=HASHED)
    rows = np.nonzero(count)[0]
    value = np.sqrt(count[rows])
    return rows, value / np.sqrt((value * value).sum())


def fit_linear(data: list[tuple[np.ndarray, np.ndarray]], post: np.ndarray, epochs: int = 12) -> tuple[np.ndarray, float]:
    """Weights and bias; data: rows and values of each text."""
    w, b, rng = np.zeros(HASHED), 0.0, np.random.default_rng(9)
    square = np.full(HASHED, 1e-4)
    for _ in range(epochs):
        for i in rng.permutation(len(data)).tolist():
            rows, value = data[i]
            g = 1 / (1 + np.exp(-np.clip(value @ w[rows] + b, -30, 30))) - post[i]
            step = g * value
            square[rows] += step * step
            w[rows] -= 0.3 * step / np.sqrt(square[rows])
            b -= 0.05 * g
    return w, b


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, votes (string), posterior (of the weak labels), score (of the linear model), kept."""
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType.simpleString()

    def patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: Counter = Counter()
        for batch in batches:
            count.update(votes(t) for t in as_bytes(batch.column(0)))
        yield pa.RecordBatch.from_arrays([pa.array(["".join(map(str, p)) for p in count], pa.string()), pa.array(list(count.values()), pa.int64())], ["votes", "n"])

    found = docs.select(text_col).mapInArrow(patterns, "votes string, n bigint").groupBy("votes").agg(F.sum("n").alias("n")).collect()
    if not found:
        return spark.createDataFrame([], f"`{id_col}` {kind}, votes string, posterior double, score double, kept boolean")
    found.sort()
    post, _ = em(np.array([list(map(int, r.votes)) for r in found]), np.array([r.n for r in found], float))
    posterior = {r.votes: float(p) for r, p in zip(found, post, strict=True)}
    n = sum(r.n for r in found)
    # rows of one id and text are learnt once; the id's hash alone decides who is near the sample
    key = F.xxhash64(F.col(id_col).cast("string"), F.col(text_col))
    near = F.pmod(key, F.lit(1 << 30)) < int((1 << 30) * min(1.0, SAMPLE / n))

    def learnt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
                rows, value = hashed(text)
                own = "".join(map(str, votes(text)))
                yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([own]), pa.array([rows.astype("<u4").tobytes()], pa.binary()), pa.array([value.astype("<f4").tobytes()], pa.binary())], ["key", "votes", "at", "value"])

    sample = docs.where(near).select(key.alias("key"), text_col).mapInArrow(learnt, "key bigint, votes string, at binary, value binary")
    # about SAMPLE rows of at most HASHED numbers each
    sample = sorted(sample.groupBy("key").agg(*[F.first(c).alias(c) for c in ("votes", "at", "value")]).collect())
    data = [(np.frombuffer(r.at, "<u4").astype(np.int64), np.frombuffer(r.value, "<f4").astype(np.float64)) for r in sample]
    known = spark.sparkContext.broadcast((posterior, *fit_linear(data, np.array([posterior[r.votes] for r in sample]))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        posterior, w, b = known.value
        for batch in batches:
            texts = as_bytes(batch.column(1))
            for x, y in blocks(texts):
                own = ["".join(map(str, votes(t))) for t in texts[x:y]]
                score = []
                for t in texts[x:y]:
                    rows, value = hashed(t)
                    score.append(1 / (1 + np.exp(-np.clip(value @ w[rows] + b, -30, 30))))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(x, y - x), pa.array(own), pa.array([posterior[v] for v in own]), pa.array(score, pa.float64()), pa.array([s >= THRESHOLD for s in score])], [id_col, "votes", "posterior", "score", "kept"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, votes string, posterior double, score double, kept boolean")
