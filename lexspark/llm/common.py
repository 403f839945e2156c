"""Shared helpers of the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text handled at once inside a Python worker; longer single texts stand alone.
BLOCK_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a temporary one on a local
    session, and an error on a cluster, whose executors could not see it."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at is None:
        at = sc.getCheckpointDir()
        if at is None:
            if not (sc.master or "").startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            sc.setCheckpointDir(tempfile.mkdtemp(prefix="lexspark-"))
            at = sc.getCheckpointDir()
    elif sc.getCheckpointDir() is None:
        sc.setCheckpointDir(at)
    return at


def stored(df: DataFrame) -> DataFrame:
    """Write df as a table in the shared folder and read it again: cuts lineage, survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/lexspark-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """checkpoint() in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def held_out(doc_id: str, mod: int, rest: int):
    """crc32 of the id's text, modulo mod, equals rest; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % mod == rest


def as_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 of each text; null is empty."""
    return [x or b"" for x in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()]


def blocks(texts: list[bytes], size: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about so many bytes each."""
    start = total = 0
    for i, x in enumerate(texts):
        total += len(x)
        if total >= size or i - start >= 20_000:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def numbered(words: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
    """The words' numbers and the distinct words in order of first occurrence."""
    own = dict.fromkeys(words)
    own = dict(zip(own, range(len(own)), strict=True))
    return np.fromiter(map(own.__getitem__, words), np.int32, len(words)), list(own)


def starts(lengths) -> np.ndarray:
    out = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=out[1:])
    return out


def spread(starts_of: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenated ranges start, start + 1, ... of the given lengths."""
    n = int(lengths.sum())
    if not n:
        return np.zeros(0, np.int64)
    at = starts(lengths)[:-1]
    return np.arange(n, dtype=np.int64) + np.repeat(starts_of - at, lengths)
