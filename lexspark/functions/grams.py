"""Trigrams of many texts at once, in arrays of code points."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

#: Bytes of text counted at once; a longer text is counted in parts of so many characters.
BLOCK = 1 << 20


@cache
def lower_table() -> np.ndarray:
    """The lower case of each code point as one code point, whatever stands beside it, as in the SQL."""
    table = np.arange(0x110000, dtype=np.uint32)
    for c in range(0x20000):  # no letter beyond has two cases
        table[c] = ord(chr(c).lower()[0])  # only U+0130 has two characters there; the first is its simple form
    return table


def counted(codes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Texts as code points one behind the other, and their sizes: grams (the code points of each in 63 bits), and for
    each text and gram in it the text's number, the gram's place in grams and the occurrences."""
    row = np.repeat(np.arange(len(sizes)), sizes)
    inside = np.flatnonzero(row[:-2] == row[2:])
    if not len(inside):
        none = np.zeros(0, np.int64)
        return none, none, none, none
    letters = np.flatnonzero(np.bincount(codes))
    n = len(letters)
    rank = np.zeros(letters[-1] + 1, np.int64)
    rank[letters] = np.arange(n)
    r = rank[codes]
    gram = ((r[:-2] * n + r[1:-1]) * n + r[2:])[inside]
    if n**3 <= 4 * BLOCK:
        grams = np.flatnonzero(np.bincount(gram))
        place = np.zeros(grams[-1] + 1, np.int64)
        place[grams] = np.arange(len(grams))
        gram = place[gram]
    else:
        grams, gram = np.unique(gram, return_inverse=True)
    key = row[inside] * len(grams) + gram
    key = key.astype(np.uint32) if len(sizes) * len(grams) < 1 << 32 else key
    key.sort()
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    own, gram = np.divmod(key[first].astype(np.int64), len(grams))
    whole = (letters[grams // (n * n)] << 42) | (letters[grams // n % n] << 21) | letters[grams % n]
    return whole, own, gram, np.diff(np.append(first, len(key)))


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """grams and occurrences of several parts as one."""
    grams, place = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
    return grams, np.bincount(place, np.concatenate([f for _, f in parts]), len(grams)).astype(np.int64)


def spelled(grams: np.ndarray) -> pa.Array:
    codes = np.stack([grams >> 42, (grams >> 21) & 0x1FFFFF, grams & 0x1FFFFF], axis=1).astype("<u4")
    text = codes.tobytes().decode("utf-32-le", "surrogatepass")
    return pa.array([text[i : i + 3] for i in range(0, len(text), 3)], pa.string())


def code_points(text: str, lower: bool) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return lower_table()[codes] if lower else codes


def long_text(text: str, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """grams and occurrences of one text, by parts that overlap by two characters: memory goes with its distinct grams."""
    out: list[tuple[np.ndarray, np.ndarray]] = []
    for i in range(0, len(text) - 2, BLOCK):
        codes = code_points(text[i : i + BLOCK + 2], lower)
        grams, _, _, freq = counted(codes, np.array([len(codes)]))
        out = [merged([*out, (grams, freq)])]
    return out[0] if out else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def blocks(texts: pa.Array, lower: bool) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For blocks of texts the number of the first text, and what counted() gives."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    begin = 0
    while begin < len(texts):
        done = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, done + BLOCK, "right")))
        raw = texts.slice(begin, end - begin).cast(pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary())
        own = [(x or b"").decode("utf-8", "replace") for x in raw.to_pylist()]
        if len(own) == 1 and len(own[0]) > BLOCK:
            grams, freq = long_text(own[0], lower)
            yield begin, grams, np.zeros(len(grams), np.int64), np.arange(len(grams)), freq
        else:
            yield begin, *counted(code_points("".join(own), lower), np.fromiter(map(len, own), np.int64, len(own)))
        begin = end


def postings(chunks: DataFrame, id_col: str, text_col: str, lower: bool = False) -> DataFrame:
    """gram, id, freq of every trigram of every row; nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, grams, own, gram, freq in blocks(batch.column(1), lower):
                columns = [spelled(grams).take(pa.array(gram)), batch.column(0).take(pa.array(own + begin)), pa.array(freq, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["gram", id_col, "freq"])

    rows = chunks.select(id_col, text_col)
    schema = StructType([StructField("gram", StringType()), StructField(id_col, rows.schema[0].dataType), StructField("freq", LongType())])
    return rows.mapInArrow(run, schema)


def totals(chunks: DataFrame, text_col: str, lower: bool = False) -> DataFrame:
    """gram, docs, freq: in how many rows each trigram stands, and how often; summed up inside blocks before a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, grams, _, gram, freq in blocks(batch.column(0), lower):
                docs, times = np.bincount(gram, minlength=len(grams)), np.bincount(gram, freq, len(grams)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([spelled(grams), pa.array(docs, pa.int64()), pa.array(times)], ["gram", "docs", "freq"])

    each = chunks.select(text_col).mapInArrow(run, "gram string, docs long, freq long")
    return each.groupBy("gram").agg(F.sum("docs").alias("docs"), F.sum("freq").alias("freq"))
