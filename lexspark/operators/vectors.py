"""Vector search, rank fusion and the upkeep of an embedding cache."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexspark.functions.columns import inner_product

RRF_K, COVERAGE, SHRINK = 60, 0.98, 0.9


def top_k(vectors: DataFrame, query: list[float], k: int, id_col: str, vec_col: str) -> DataFrame:
    """The k rows with the largest inner product; ties to the smaller id."""
    q = F.array(*[F.lit(float(x)) for x in query])
    return vectors.where(F.col(vec_col).isNotNull()).select(id_col, inner_product(F.col(vec_col), q).alias("similarity")).orderBy(F.desc("similarity"), id_col).limit(k)


def fuse(lists: list[DataFrame], id_col: str, k: int = 8) -> DataFrame:
    """Reciprocal-rank fusion of ranked lists (id, rank from 1); ties as the lists are given, then by rank."""
    own = [x.select(id_col, (1 / (RRF_K + F.col("rank"))).alias("part"), (F.lit(i * 1_000_000) + F.col("rank")).alias("seen")) for i, x in enumerate(lists)]
    every = own[0]
    for x in own[1:]:
        every = every.unionByName(x)
    return every.groupBy(id_col).agg(F.sum("part").alias("score"), F.min("seen").alias("first_seen")).orderBy(F.desc("score"), "first_seen", id_col).limit(k)


def ranks(top: DataFrame, order: list) -> DataFrame:
    """Ranks of a list that a limit has bounded."""
    return top.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(*order)))


def pending(chunks: DataFrame, cache: DataFrame, model: str, dim: int) -> DataFrame:
    """A text for each hash that the cache lacks."""
    own = chunks.groupBy("text_hash").agg(F.min("text").alias("text"))
    return own.join(cache.where((F.col("model") == model) & (F.col("dim") == dim)).select("text_hash"), "text_hash", "left_anti")


def attach(chunks: DataFrame, cache: DataFrame, model: str, dim: int) -> DataFrame:
    known = cache.where((F.col("model") == model) & (F.col("dim") == dim)).select("text_hash", "vec")
    return chunks.drop("vec").join(known, "text_hash", "left")


def check_coverage(chunks: DataFrame, least: float = COVERAGE) -> float:
    have, n = chunks.agg(F.count("vec"), F.count("*")).first()
    if n and have / n < least:
        raise ValueError(f"vectors for {have} of {n} chunks")
    return have / n if n else 1.0


def check_shrink(before: int, now: int, least: float = SHRINK) -> None:
    if before and now < least * before:
        raise ValueError(f"{now} rows after {before}")


def census(cache: DataFrame) -> DataFrame:
    return cache.groupBy("model", "dim").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "model", "dim")
