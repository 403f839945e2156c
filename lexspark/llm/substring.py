"""Substring de-duplication by content-defined chunking with a gear rolling hash.

A text's bytes are cut after every byte at which the gear hash of the last 32 bytes has its top bits zero (at least
`least` bytes after the last cut). Cuts follow the content, so an insertion moves only the chunks that it touches.
Chunks are made once and written; they are de-duplicated by a 128-bit digest: the first occurrence, by document id and
place, stays; every other is a duplicate. Digests are counted with partial sums before the shuffle; only digests seen
more than once, a table of their own, are joined with the chunks, an equi join that adaptive execution splits where one
digest is hot. Duplicates that touch are one run; a run counts from SHORTEST bytes on, or where it is the whole text:
single chunks of some 50 bytes repeat by chance of wording, a passage of 50 words does not.

Null and empty texts: no chunks. Rows of one id and text are repeats of one document and get the same result; rows of
one id with other texts are documents of their own, ordered by place alone where they hold the same chunk at the same
byte. A null id is an id and comes first. Chunks of under `least` bytes (short texts, ends) are chunks too. Very long
texts are chunked whole; a text's runs are joined in order by a window over its duplicates. Other columns stay in
cleaned(), and are not looked at elsewhere. Empty table: no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexspark.llm.common import as_bytes, blocks, stored

#: Mean distance of cuts is 2 ** BITS + LEAST bytes: a passage of 50 words holds several whole chunks.
BITS, LEAST = 5, 16
#: Bytes of a run of duplicates that counts.
SHORTEST = 96
_GEAR = np.frombuffer(b"".join(hashlib.blake2b(bytes([b]), digest_size=4).digest() for b in range(256)), "<u4").copy()


def cuts(text: bytes, bits: int = BITS, least: int = LEAST) -> list[int]:
    """Ends of the chunks of a text; the last is its length."""
    n = len(text)
    if not n:
        return []
    h = _GEAR[np.frombuffer(text, np.uint8)]
    for k in (1, 2, 4, 8, 16):  # after k: the gear hash of the last 2 k bytes
        if n > k:
            shifted = h[:-k] << np.uint32(k)
            h = h.copy()
            h[k:] += shifted
    out, last = [], 0
    for p in (np.nonzero(h < np.uint32(1 << (32 - bits)))[0] + 1).tolist():
        if p - last >= least and p < n:
            out.append(p)
            last = p
    return [*out, n]


def _key(text_col: str):
    return F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))


def chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = BITS, least: int = LEAST) -> DataFrame:
    """A row for each chunk: id, key (a hash of the text), begin, size (bytes), digest."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_bytes(batch.column(2))
            for a, b in blocks(texts, 4 << 20):
                row, begin, size, digest = [], [], [], []
                for i, text in enumerate(texts[a:b], a):
                    ends = cuts(text, bits, least)
                    last = 0
                    for e in ends:
                        digest.append(hashlib.blake2b(text[last:e], digest_size=16).digest())
                        begin.append(last)
                        size.append(e - last)
                        last = e
                    row += [i] * len(ends)
                at = pa.array(row, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(begin, pa.int64()), pa.array(size, pa.int32()), pa.array(digest, pa.binary())], ["id", "key", "begin", "size", "digest"])

    return docs.select(F.col(id_col).alias("id"), _key(text_col).alias("key"), F.col(text_col).cast("string")).mapInArrow(run, f"id {kind}, key bigint, begin bigint, size int, digest binary")


def duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each place of a document that holds a duplicate chunk: id, key, begin, size, first_id, copies."""
    own = stored(chunks(docs, id_col, text_col))
    seen = stored(own.groupBy("digest").agg(F.count("*").alias("copies"), F.min(F.struct("id", "begin")).alias("first")).where("copies > 1"))
    found = own.join(seen, "digest").where(~(F.col("id").eqNullSafe(F.col("first.id")) & (F.col("begin") == F.col("first.begin"))))
    return found.select("id", "key", "begin", "size", F.col("first.id").alias("first_id"), "copies").distinct()


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = SHORTEST) -> DataFrame:
    """A row for each row of docs: id, n_bytes, dup_chunks, dup_bytes, longest_dup (bytes of the longest run of duplicates) and spans (begin, end of each run)."""
    return _with_runs(docs.select(F.col(id_col).alias("_id"), _key(text_col).alias("_key"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("bigint").alias("n_bytes")), duplicates(docs, id_col, text_col), shortest).select(
        F.col("_id").alias(id_col),
        "n_bytes",
        _total("chunks").alias("dup_chunks"),
        _total("bytes").alias("dup_bytes"),
        _spans().alias("spans"),
        F.coalesce(F.array_max(F.transform("_runs", lambda r: r["end"] - r["begin"])), F.lit(0)).cast("bigint").alias("longest_dup"),
    )


def cleaned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = SHORTEST) -> DataFrame:
    """docs without the runs of duplicates; first occurrences stay. Cuts never split a character."""
    own = docs.select("*", F.col(id_col).alias("_id"), _key(text_col).alias("_key"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("bigint").alias("n_bytes_"))
    found = _with_runs(own.withColumnRenamed("n_bytes_", "_n_bytes"), duplicates(docs, id_col, text_col), shortest, "_n_bytes")
    shown = list(docs.columns)
    at = shown.index(text_col)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, spans = batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()
            out = [remove(t.encode(), [(x["begin"], x["end"]) for x in s]).decode() if s else t for t, s in zip(texts, spans, strict=True)]
            columns = batch.columns[:-1]
            columns[at] = pa.array(out, batch.column(at).type)
            yield pa.RecordBatch.from_arrays(columns, shown)

    return found.select(*[f"`{c}`" for c in shown], _spans().alias("_spans")).mapInArrow(run, schema)


def _spans():
    return F.transform("_runs", lambda r: F.struct(r["begin"].alias("begin"), r["end"].alias("end")))


def _total(name: str):
    return F.aggregate("_runs", F.lit(0).cast("bigint"), lambda n, r: n + r[name])


def _with_runs(own: DataFrame, found: DataFrame, shortest: int, size_col: str = "n_bytes") -> DataFrame:
    """own (with _id, _key and the size in bytes) and _runs: of neighbouring duplicates, in order, with the number and the bytes of their chunks."""
    by = ["id", "key"]
    found = found.withColumn("end", F.col("begin") + F.col("size"))
    before = Window.partitionBy(*by).orderBy("begin", "end").rowsBetween(Window.unboundedPreceding, -1)
    up_to = Window.partitionBy(*by).orderBy("begin", "end").rowsBetween(Window.unboundedPreceding, 0)
    found = found.withColumn("new", F.coalesce((F.col("begin") > F.max("end").over(before)).cast("int"), F.lit(1))).withColumn("run", F.sum("new").over(up_to))
    runs = found.groupBy(*by, "run").agg(F.min("begin").alias("begin"), F.max("end").alias("end"), F.count("*").alias("chunks"), F.sum("size").cast("bigint").alias("bytes"))
    # a run that is the whole text is told by its document's size
    runs = runs.where((F.col("end") - F.col("begin") >= shortest) | (F.col("begin") == 0))
    runs = runs.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("begin", "end", "chunks", "bytes"))).alias("_found"))
    out = own.join(runs, own["_id"].eqNullSafe(runs["id"]) & (own["_key"] == runs["key"]), "left")
    whole = F.filter(F.coalesce("_found", F.array().cast(f"array<{_RUN}>")), lambda r: (r["end"] - r["begin"] >= shortest) | (r["end"] == F.col(size_col)))
    return out.select(*[own[c] for c in own.columns], whole.alias("_runs"))


_RUN = "struct<begin:bigint,end:bigint,chunks:bigint,bytes:bigint>"


def remove(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """A UTF-8 text without the given spans; a character that a span holds in part stays."""
    inside = lambda i: i < len(text) and text[i] & 0xC0 == 0x80
    out, last = [], 0
    for a, b in spans:
        while inside(a):
            a += 1
        while inside(b):
            b -= 1
        if a < b:
            out.append(text[last:a])
            last = b
    return b"".join([*out, text[last:]])
