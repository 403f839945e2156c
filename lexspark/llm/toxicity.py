"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained and run in numpy.

Inputs of a step are a word and its characters: the sum of a hashed word vector and of hashed character n-gram vectors
(prefixes, suffixes and inner grams, with marks at the ends). A run of over PART bytes without space (glued words, text in
scripts without spaces) is a step for each of its overlapping parts, so all of it counts. A text is read in overlapping windows of WINDOW words;
its score is that of its worst window, and every word is in some window. Training is on whole labelled texts by their
worst window, on a bounded, documented sample of labelled rows: the MAX_DOCS of each label with the smallest
hash of their id, of at most MAX_CHARS characters. Scoring takes every window of every text.

Null and empty texts have one empty window, which the network scores like any other. Texts without labels of one kind
give the share of toxic labels to every text (0.0 without labels). Repeated rows: same score. Rows of `labels` that are
null take no part, of those that contradict one another for an id the largest label counts; of an id with several texts
the least text is learnt. Very long texts: all their windows, in bounded portions. Ties of the worst window: same score.
A column of docs that has the name of the score's column is replaced; other columns stay. Empty tables: no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspark.llm.common import as_bytes, blocks, held_out, numbered, spread, starts

MAX_DOCS, MAX_CHARS = 1200, 12_000
WINDOW, STRIDE = 48, 36
DIM, HIDDEN = 12, 8
WORD_ROWS, GRAM_ROWS = 1 << 15, 1 << 15
#: Bytes of a run without space that is one step; longer ones are cut into parts that share OVERLAP bytes.
PART, OVERLAP = 40, 10
THRESHOLD = 0.3
#: A-Z to a-z; every other ASCII character that is no letter or digit to a space.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))
_MUL = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1], np.uint32)


def grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the n-grams (3 to 5 bytes, ends marked) of each word, and where each word's begin. The word itself is its first row."""
    own = [b"^" + w + b"$" for w in words]
    n = np.array([len(x) for x in own], np.int64)
    at = starts(n)
    flat = np.frombuffer(b"".join(own), np.uint8).astype(np.uint32) + np.uint32(1)
    word = np.fromiter((zlib.crc32(w) % WORD_ROWS for w in words), np.int64, len(words))
    rows, place = [word], [np.arange(len(words))]
    with np.errstate(over="ignore"):
        for size in (3, 4, 5):
            count = np.maximum(n - size + 1, 0)
            pos = spread(at[:-1], count)
            h = np.full(len(pos), size, np.uint32)
            for k in range(size):
                h = (h ^ flat[pos + k]) * _MUL[k]
                h ^= h >> np.uint32(15)
            rows.append((h % np.uint32(GRAM_ROWS)).astype(np.int64) + WORD_ROWS)
            place.append(np.repeat(np.arange(len(words)), count))
    rows, place = np.concatenate(rows), np.concatenate(place)
    order = np.argsort(place, kind="stable")
    return rows[order], starts(np.bincount(place, minlength=len(words)))


def read(text: bytes) -> list[bytes]:
    """A text's words, long ones in overlapping parts."""
    words = text.translate(_WORDS).split()
    if max(map(len, words), default=0) <= PART:
        return words
    return [x for w in words for x in ([w] if len(w) <= PART else [w[i : i + PART] for i in range(0, len(w) - OVERLAP, PART - OVERLAP)])]


def windows(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For texts of so many words: each window's text, first word (in its text) and number of words; a text has one at least."""
    count = np.maximum(1, -(-(lengths - (WINDOW - STRIDE)) // STRIDE))
    text = np.repeat(np.arange(len(lengths)), count)
    first = (np.arange(len(text)) - np.repeat(starts(count)[:-1], count)) * STRIDE
    return text, first, np.minimum(WINDOW, lengths[text] - first)


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    """table: input vectors; U: input weights of both directions; W: recurrent weights; v: attention; o, c: output."""

    def __init__(self, rng: np.random.Generator):
        g = lambda *s, scale=0.3: (rng.standard_normal(s) * scale).astype(np.float32)
        self.p = {"table": g(WORD_ROWS + GRAM_ROWS, DIM, scale=0.05), "U": g(DIM, 6 * HIDDEN), "b": np.zeros(6 * HIDDEN, np.float32), "Wf": g(HIDDEN, 3 * HIDDEN), "Wb": g(HIDDEN, 3 * HIDDEN), "v": g(2 * HIDDEN), "o": g(2 * HIDDEN), "c": np.array([-2.0], np.float32)}

    def inputs(self, words: list[bytes]) -> np.ndarray:
        """Projected inputs of distinct words and, last, of no word."""
        if not words:
            return np.zeros((1, 6 * HIDDEN), np.float32)
        rows, at = grams(words)
        x = np.add.reduceat(self.p["table"][rows], at[:-1]) / np.sqrt(np.diff(at)).astype(np.float32)[:, None]
        return np.concatenate((x @ self.p["U"] + self.p["b"], np.zeros((1, 6 * HIDDEN), np.float32)))

    def run(self, x: np.ndarray, word: np.ndarray, size: np.ndarray, keep: bool = False):
        """Logits of windows; word [windows, WINDOW] leads into x, size: words of each."""
        p, (n, t) = self.p, word.shape
        live = np.arange(t)[None, :] < size[:, None]
        states = np.zeros((2, t, n, HIDDEN), np.float32)
        kept = []
        for d, w in enumerate((p["Wf"], p["Wb"])):
            h = np.zeros((n, HIDDEN), np.float32)
            own = np.ascontiguousarray(x[:, d * 3 * HIDDEN : (d + 1) * 3 * HIDDEN])
            for i in range(t) if d == 0 else range(t - 1, -1, -1):
                a, r = own[word[:, i]], h @ w
                g = sigmoid(a[:, : 2 * HIDDEN] + r[:, : 2 * HIDDEN])
                z, s = g[:, :HIDDEN], g[:, HIDDEN:]
                m = np.tanh(a[:, 2 * HIDDEN :] + s * r[:, 2 * HIDDEN :])
                new = np.where(live[:, i, None], m + z * (h - m), h)
                if keep:
                    kept.append((d, i, h, g, m, r[:, 2 * HIDDEN :]))
                h = states[d, i] = new
        e = states[0] @ p["v"][:HIDDEN] + states[1] @ p["v"][HIDDEN:]
        e = np.where(live.T, e, np.float32(-30))
        e = np.exp(e - e.max(axis=0))
        e /= e.sum(axis=0)
        pooled = np.concatenate([(states[d] * e[:, :, None]).sum(axis=0) for d in (0, 1)], axis=1)
        pooled = np.where((size > 0)[:, None], pooled, 0)
        out = pooled @ p["o"] + p["c"]
        return (out, (live, states, kept, e, pooled)) if keep else out

    def gradients(self, x, word, size, dout, cache) -> dict[str, np.ndarray]:
        p, (live, states, kept, e, pooled) = self.p, cache
        out = {k: np.zeros_like(p[k]) for k in ("Wf", "Wb")} | {"o": pooled.T @ dout, "c": dout.sum(keepdims=True)}
        full = (size > 0)[:, None]
        dpool = dout[:, None] * p["o"] * full
        both = np.concatenate((states[0], states[1]), axis=2)
        de = (both * dpool[None]).sum(axis=2)
        ds = e * (de - (e * de).sum(axis=0))
        out["v"] = (both * ds[:, :, None]).sum(axis=(0, 1))
        dh = e[:, :, None] * dpool[None] + ds[:, :, None] * p["v"]
        dx = np.zeros_like(x)
        flow = [np.zeros((len(size), HIDDEN), np.float32) for _ in (0, 1)]
        for d, i, h, g, m, r in reversed(kept):
            w = p["Wf" if d == 0 else "Wb"]
            total = flow[d] + dh[i, :, d * HIDDEN : (d + 1) * HIDDEN]
            own = np.where(live[:, i, None], total, 0)
            z, s = g[:, :HIDDEN], g[:, HIDDEN:]
            dm = own * (1 - z) * (1 - m * m)
            dg = np.concatenate((own * (h - m), dm * r), axis=1) * g * (1 - g)
            dr = np.concatenate((dg, dm * s), axis=1)
            da = np.concatenate((dg, dm), axis=1)
            out["Wf" if d == 0 else "Wb"] += h.T @ dr
            flow[d] = np.where(live[:, i, None], own * z + dr @ w.T, total)
            at = slice(d * 3 * HIDDEN, (d + 1) * 3 * HIDDEN)
            order = np.argsort(word[:, i], kind="stable")
            who, begin = np.unique(word[order, i], return_index=True)
            dx[who, at] += np.add.reduceat(da[order], begin)
        dx[-1] = 0
        out["dx"] = dx
        return out


def prepared(texts: list[bytes]):
    """Distinct words, each window's text, words [windows, WINDOW] (the number of distinct words stands for none) and size."""
    words = [read(t) for t in texts]
    length = np.array([len(w) for w in words], np.int64)
    number, own = numbered([x for w in words for x in w])
    text, first, size = windows(length)
    at = starts(length)[:-1][text] + first
    place = at[:, None] + np.arange(WINDOW)
    live = np.arange(WINDOW)[None, :] < size[:, None]
    number = np.append(number, np.int32(len(own)))
    return own, text, np.where(live, number[np.minimum(place, len(number) - 1)], len(own)).astype(np.int32), size


def worst(scores: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    out = np.full(n, -np.inf, np.float32)
    np.maximum.at(out, text, scores)
    return out


class Model:
    def __init__(self, network: Network | None, prior: float):
        self.network, self.prior = network, prior

    def scores(self, texts: list[bytes], portion: int = 4096) -> np.ndarray:
        if self.network is None:
            return np.full(len(texts), self.prior)
        own, text, word, size = prepared(texts)
        x = self.network.inputs(own)
        logits = np.concatenate([self.network.run(x, word[a : a + portion], size[a : a + portion]) for a in range(0, len(size), portion)])
        return sigmoid(worst(logits, text, len(texts)).astype(np.float64))


def train(texts: list[bytes], labels: np.ndarray, epochs: int = 6, batch: int = 64, seed: int = 11, least_steps: int = 100) -> Model:
    prior = float(labels.mean()) if len(labels) else 0.0
    if prior in (0.0, 1.0):
        return Model(None, prior)
    epochs = max(epochs, -(-least_steps * batch // len(texts)))
    rng = np.random.default_rng(seed)
    net = Network(rng)
    # inputs start from how much oftener each row is in toxic texts
    seen = np.zeros((2, WORD_ROWS + GRAM_ROWS))
    for t, y in zip(texts, labels, strict=True):
        rows, _ = grams(list(set(read(t))))
        seen[int(y)][np.unique(rows)] += 1
    total = np.array([(labels == 0).sum(), (labels == 1).sum()])
    # and shrink where few texts speak for it: a row of one or two texts would only mark those texts
    odds = np.log((seen[1] + 0.5) / (total[1] + 1)) - np.log((seen[0] + 0.5) / (total[0] + 1))
    much = np.where(odds > 0, seen[1], seen[0])
    net.p["table"][:, 0] = np.clip(odds, -4, 4) * np.maximum(0, much - 2) / (much + 3)
    moment = {k: np.zeros_like(v) for k, v in net.p.items()}
    square = {k: np.zeros_like(v) for k, v in net.p.items()}
    steps = 0

    def update(name: str, g: np.ndarray, rate: float) -> None:
        moment[name] = 0.9 * moment[name] + 0.1 * g
        square[name] = 0.99 * square[name] + 0.01 * g * g
        net.p[name] -= (rate * (moment[name] / (1 - 0.9**steps)) / (np.sqrt(square[name] / (1 - 0.99**steps)) + 1e-6)).astype(np.float32)

    share = prior if prior > 0.05 else 0.05
    for epoch in range(epochs):
        order = rng.permutation(len(texts))
        rate = 0.02 * 0.5 ** (2.6 * epoch / epochs)
        for a in range(0, len(order), batch):
            pick = order[a : a + batch]
            own, text, word, size = prepared([texts[i] for i in pick])
            x = net.inputs(own)
            logits = net.run(x, word, size)
            best = np.zeros(len(pick), np.int64)
            by = np.argsort(logits, kind="stable")
            best[text[by]] = by  # the last assignment is the largest
            y = labels[pick]
            part_word, part_size = word[best], size[best]
            out, cache = net.run(x, part_word, part_size, keep=True)
            dout = ((sigmoid(out) - y) * np.where(y == 1, 0.5 / share, 0.5 / (1 - share)) / len(pick)).astype(np.float32)
            g = net.gradients(x, part_word, part_size, dout, cache)
            steps += 1
            dx = g.pop("dx")
            used = np.nonzero(np.abs(dx[:-1]).sum(axis=1))[0]
            for k, v in g.items():
                update(k, v, rate)
            if not len(used):
                continue
            rows, at = grams([own[i] for i in used])
            norm = np.sqrt(np.diff(at)).astype(np.float32)[:, None]
            vec = np.add.reduceat(net.p["table"][rows], at[:-1]) / norm
            update("U", vec.T @ dx[used], rate)
            update("b", dx[used].sum(axis=0), rate)
            back = np.repeat((dx[used] @ net.p["U"].T) / norm, np.diff(at), axis=0)
            order_rows = np.argsort(rows, kind="stable")
            who, begin = np.unique(rows[order_rows], return_index=True)
            step = np.add.reduceat(back[order_rows], begin)
            square["table"][who] += step * step
            net.p["table"][who] -= 0.02 * step / (np.sqrt(square["table"][who]) + 1e-6)
    return Model(net, prior)


def labelled(docs: DataFrame, labels: DataFrame, learn, id_col: str = "doc_id", text_col: str = "text", max_docs: int = MAX_DOCS, max_chars: int = MAX_CHARS) -> tuple[list[bytes], np.ndarray]:
    """The bounded sample: of each label, the rows with the smallest hash of the id."""
    known = labels.where(learn).where("toxic is not null").groupBy(F.col(id_col).alias("_id")).agg(F.max("toxic").alias("toxic"))
    # the ids of the sample come from the narrow tables; whole texts are read for those alone
    near = docs.where(F.length(text_col) <= max_chars).select(F.col(id_col).alias("_id")).distinct().join(known, "_id")
    texts, marks = [], []
    for y in (0, 1):
        ids = near.where(F.col("toxic") == y).orderBy(F.xxhash64("_id"), "_id").limit(max_docs)
        rows = docs.join(F.broadcast(ids), docs[id_col] == ids["_id"], "left_semi").where(F.length(text_col) <= max_chars).groupBy(id_col).agg(F.min(text_col)).collect()
        rows.sort(key=lambda r: (zlib.crc32(str(r[0]).encode()), r[0]))
        texts += [r[1].encode() for r in rows]
        marks += [y] * len(rows)
    return texts, np.array(marks, np.float32)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", mod: int = 4, rest: int = 2) -> Model:
    """Learns from labels whose crc32(id as text) mod `mod` is not `rest`."""
    return train(*labelled(docs, labels, ~held_out(id_col, mod, rest), id_col, text_col))


def score(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """docs with the score (0 to 1) of each whole text."""
    known = docs.sparkSession.sparkContext.broadcast(model)
    names = [c for c in docs.columns if c != score_col]
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_bytes(batch.column(at))
            for a, b in blocks(texts):
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, pa.array(known.value.scores(texts[a:b]), pa.float64())], [*names, score_col])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name != score_col), f"`{score_col}` double"])
    return docs.select(*[f"`{c}`" for c in names]).mapInArrow(run, schema)
