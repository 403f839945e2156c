"""Benchmark decontamination: prefix-filtered join of document words with item windows.

A window is `size` consecutive words of an item (an item of fewer words, but not none, is one window). A document is
hit where all of a window's words stand in order, so the overlap that is needed is the whole window and its necessary
prefix is one token: the rarest word, by the number of documents that hold it. Documents' places of such words join the
windows on the word; the place in the text and the window's length bound where it would begin and end; its words are
then compared one by one. Items and windows stay tables: neither passes the driver or is broadcast. A worker leaves out
words by a bit table of BITS positions, the same size whatever the benchmark; what it lets pass wrongly the join ends.

Texts are judged once for all their copies, by a digest. Three passes over the texts (counts, places, numbers of words);
what was found comes back by an equi join.

Null text or text without words: no words, no hit. Items without words, and items whose id is null, take no part;
rows of one item_id count as one item. Repeated rows are judged alike. Words of equal rarity: the one that comes first
in byte order. Very long texts are read whole, in a block of their own. Other columns stay; one that has the name of
found_col is replaced. Empty tables: no rows, or no hits.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from lexspark.llm.common import as_bytes, blocks, stored

WINDOW = 8
#: Positions of the table of bits of words; a power of 2.
BITS = 1 << 22
#: Words counted in a task before their counts leave it.
COUNTED = 200_000
#: Lower-cases A-Z and makes a space of every ASCII character that is not a letter or digit.
WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORDS).split()


def windows_of(words: list[bytes], size: int = WINDOW) -> set[tuple[bytes, ...]]:
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def _windows(items: DataFrame, size: int) -> DataFrame:
    """item, window (its words with a space between), each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [[b" ".join(w) for w in windows_of(words_of(t), size)] for t in as_bytes(batch.column(1))]
            at = pa.array(np.repeat(np.arange(len(own)), [len(x) for x in own]), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), pa.array([w.decode() for x in own for w in x], pa.string())], ["item", "window"])

    return items.mapInArrow(run, "item string, window string").distinct()


def _bits(words: DataFrame):
    """The table of bits of a column of words, broadcast: BITS / 8 bytes; at most BITS numbers reach the driver."""

    size = BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(size, bool)
        for batch in batches:
            seen[[zlib.crc32(w.encode()) & (size - 1) for w in batch.column(0).to_pylist()]] = True
        yield pa.RecordBatch.from_arrays([pa.array(np.nonzero(seen)[0], pa.int32())], ["at"])

    found = words.mapInArrow(run, "at int").distinct().toArrow().column("at").to_numpy()
    bits = np.zeros(size, bool)
    bits[found] = True
    return words.sparkSession.sparkContext.broadcast(np.packbits(bits))


class Filter:
    """Of a block of texts, the words whose bit is set."""

    def __init__(self, packed: np.ndarray):
        self.bits = np.unpackbits(packed).astype(bool).tobytes()

    def of(self, lists: list[list[bytes]]) -> frozenset[bytes]:
        bits, crc, last = self.bits, zlib.crc32, len(self.bits) - 1
        return frozenset(w for w in set().union(*lists) if bits[crc(w) & last])


def _counts(docs: DataFrame, text_col: str, bits) -> DataFrame:
    """word, n: in how many documents it stands, of words whose bit is set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep, count = Filter(bits.value), Counter()
        out = lambda: pa.RecordBatch.from_arrays([pa.array([w.decode() for w in count], pa.string()), pa.array(list(count.values()), pa.int64())], ["word", "n"])
        for batch in batches:
            texts = as_bytes(batch.column(0))
            for a, b in blocks(texts):
                lists = [words_of(t) for t in texts[a:b]]
                wanted = keep.of(lists)
                for words in lists:
                    count.update(wanted.intersection(words))
                if len(count) > COUNTED:
                    yield out()
                    count.clear()
        yield out()

    return docs.select(F.col(text_col).cast("string")).mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def _places(docs: DataFrame, text_col: str, bits, known, size: int, least: int) -> DataFrame:
    """key (of a text), word, pos, near, off, each once: places of words of `bits` inside a run of words of `known`.

    A window holds words of items alone, so only a run of them, `least` words long at least, can hold one; near is the
    run, size - 1 words to either side at most, and off the word's place in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep, every = Filter(bits.value), Filter(known.value)
        for batch in batches:
            texts = as_bytes(batch.column(1))
            for a, b in blocks(texts):
                lists = [words_of(t) for t in texts[a:b]]
                wanted, items = keep.of(lists), every.of(lists)
                row, word, pos, near, off = [], [], [], [], []
                for k, words in enumerate(lists, a):
                    if wanted.isdisjoint(words):
                        continue
                    for i in [i for i, w in enumerate(words) if w in wanted]:
                        first, end = i, i + 1
                        while first > max(0, i - size + 1) and words[first - 1] in items:
                            first -= 1
                        while end < min(len(words), i + size) and words[end] in items:
                            end += 1
                        if end - first < least:
                            continue
                        row.append(k)
                        word.append(words[i].decode())
                        pos.append(i)
                        near.append(b" ".join(words[first:end]).decode())
                        off.append(i - first)
                if row:
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), pa.array(word), pa.array(pos, pa.int64()), pa.array(near), pa.array(off, pa.int32())], ["key", "word", "pos", "near", "off"])

    return docs.select(_key(text_col).alias("key"), F.col(text_col).cast("string")).mapInArrow(run, "key string, word string, pos bigint, near string, off int").distinct()


@F.pandas_udf(LongType())
def _n_words(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: len(words_of(t.encode())) if t else 0)


def _key(text_col: str):
    return F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit("")))


def decontaminate(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = WINDOW, found_col: str = "found") -> DataFrame:
    """docs with found_col: n_words, the covered spans of words (starts, ends) and the ids of items that occur, as strings."""
    items = items.select(F.col(item_id).cast("string").alias("item"), F.coalesce(F.col(item_text).cast("string"), F.lit("")).alias("text")).where("item is not null")
    owned = stored(_windows(items, size))
    each = owned.select("window").distinct().select("window", F.posexplode(F.split("window", " ")).alias("at", "word"))
    known = _bits(each.select("word"))
    counts = _counts(docs, text_col, known)
    rarest = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word", "at")).alias("r")
    windows = stored(each.join(counts, "word", "left").groupBy("window").agg(rarest, F.count("*").cast("int").alias("size")).select("window", F.col("r.word").alias("word"), F.col("r.at").alias("at"), "size"))

    least = windows.agg(F.coalesce(F.min("size"), F.lit(size))).first()[0]
    places = _places(docs, text_col, _bits(windows.select("word")), known, size, least)
    joined = places.join(windows, "word").where("off >= at and pos - off >= 0")
    same = F.array_join(F.slice(F.split("near", " "), F.col("off") - F.col("at") + 1, F.col("size")), " ") == F.col("window")
    hits = stored(joined.where(same).select("key", (F.col("pos") - F.col("at")).alias("start"), (F.col("pos") - F.col("at") + F.col("size")).alias("end"), "window"))

    # spans that touch or overlap are one
    before = Window.partitionBy("key").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    up_to = Window.partitionBy("key").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0)
    spans = hits.select("key", "start", "end").distinct().withColumn("new", F.coalesce((F.col("start") > F.max("end").over(before)).cast("int"), F.lit(1)))
    spans = spans.withColumn("span", F.sum("new").over(up_to)).groupBy("key", "span").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    spans = spans.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("spans"))
    own = hits.select("key", "window").distinct().join(owned, "window").select("key", "item").distinct().groupBy("key").agg(F.array_sort(F.collect_list("item")).alias("items"))
    found = stored(spans.join(own, "key").select(F.col("key").alias("_decon_key"), "spans", "items"))

    kept = [f"`{c}`" for c in docs.columns if c != found_col]
    # where nobody asks for the number of words, it is not worked out
    keyed = docs.select(*kept, _n_words(F.col(text_col).cast("string")).alias("_decon_n"), _key(text_col).alias("_decon_own"))
    out = keyed.join(found, keyed["_decon_own"] == found["_decon_key"], "left")
    places_of = lambda name: F.coalesce(F.transform("spans", lambda s: s[name]), F.array().cast("array<bigint>"))
    shown = F.struct(keyed["_decon_n"].alias("n_words"), places_of("start").alias("starts"), places_of("end").alias("ends"), F.coalesce(found["items"], F.array().cast("array<string>")).alias("items"))
    return out.select(*[keyed[c] for c in docs.columns if c != found_col], shown.alias(found_col))


def report(found: DataFrame, id_col: str = "doc_id", found_col: str = "found", least_items: int = 2) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of each document."""
    x = F.col(found_col)
    return found.select(
        id_col,
        x["n_words"].alias("n_words"),
        F.aggregate(F.zip_with(x["starts"], x["ends"], lambda a, b: b - a), F.lit(0).cast("bigint"), lambda s, n: s + n).alias("n_hit"),
        F.size(x["items"]).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(x["items"], ","), 256).alias("items_sha256"),
        (F.size(x["items"]) >= least_items).alias("contaminated"),
    )
