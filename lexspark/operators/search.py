"""Full-text search: trigram substring semantics, BM25, facets, fallback, postings."""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexspark.functions import grams
from lexspark.functions.columns import occurrences
from lexspark.functions.text import nfkc_column

K1, B, SHORTEST, LEAST_IDF = 1.2, 0.75, 3, 1e-6


def terms_of(query: str, least: int = SHORTEST) -> list[str]:
    """Words of a query long enough to be searched, in lower case; shorter ones are dropped beside them."""
    words = unicodedata.normalize("NFKC", query.replace('"', " ")).lower().split()
    return [w for w in dict.fromkeys(words) if len(w) >= least]


def matching(text: Column, terms: list[str], conjunction: str = "AND") -> Column:
    own = [F.contains(F.lower(text), F.lit(t)) for t in terms]
    return reduce((lambda a, b: a & b) if conjunction == "AND" else (lambda a, b: a | b), own) if own else F.lit(False)


def statistics(chunks: DataFrame, terms: list[str], text_col: str = "text") -> DataFrame:
    """One row for the whole corpus, whatever the filter: n, avgdl and the rows n0, n1, ... that hold each term."""
    low = F.lower(text_col)
    size = F.greatest(F.lit(0), F.length(text_col) - 2)
    return chunks.agg(F.count("*").alias("n"), F.avg(F.coalesce(size, F.lit(0))).alias("avgdl"), *[F.sum(F.coalesce(F.contains(low, F.lit(t)).cast("int"), F.lit(0))).alias(f"n{k}") for k, t in enumerate(terms)])


def ranked(chunks: DataFrame, terms: list[str], conjunction: str = "AND", text_col: str = "text", where: Column | None = None) -> DataFrame:
    """Matching rows with `score`, smallest best. Occurrences are counted in matching rows only."""
    stats = statistics(chunks, terms, text_col)
    found = chunks.where(matching(F.col(text_col), terms, conjunction))
    found = found.where(where) if where is not None else found
    size = F.greatest(F.lit(0), F.length(text_col) - 2)
    score = F.lit(0.0)
    for k, t in enumerate(terms):
        idf = F.ln((F.col("n") - F.col(f"n{k}") + 0.5) / (F.col(f"n{k}") + 0.5))
        f = occurrences(F.lower(text_col), t).cast("double")
        score = score - F.when(idf > 0, idf).otherwise(LEAST_IDF) * f * (K1 + 1) / (f + K1 * (1 - B + B * size / F.col("avgdl")))
    own = ["n", "avgdl", *[f"n{k}" for k in range(len(terms))]]
    return found.crossJoin(F.broadcast(stats)).withColumn("score", score).drop(*own)  # stats is one row


def page(found: DataFrame, order: list, limit: int = 20, offset: int = 0) -> DataFrame:
    return found.orderBy(*order).offset(offset).limit(limit) if offset else found.orderBy(*order).limit(limit)


def facets(found: DataFrame, keys: list[str]) -> DataFrame:
    """Hits by key over all matching rows."""
    return found.groupBy(*keys).agg(F.count("*").alias("n"))


def index_text(chunks: DataFrame, text_col: str = "text") -> DataFrame:
    """chunks with text_norm, the compatibility form that every search looks at; worked out once, when the table is written."""
    return chunks.withColumn("text_norm", nfkc_column(F.col(text_col)))


def short_lists(chunks: DataFrame, words: list[str], id_col: str, text_col: str = "text", n: int = 30, most: int = 2) -> DataFrame:
    """id, rank of the fallback of a question: the first words, n rows each in order of ids, each list ranked by itself."""
    lists = [substring_search(chunks, [w], text_col).select(F.lit(k).alias("list"), F.col(id_col).alias("id")).orderBy("id").limit(n) for k, w in enumerate(words[:most])]
    every = reduce(DataFrame.unionByName, lists)
    return every.withColumn("rank", F.row_number().over(Window.partitionBy("list").orderBy("id")))  # two lists of n rows at most


def substring_search(chunks: DataFrame, words: list[str], text_col: str = "text", where: Column | None = None) -> DataFrame:
    """The fallback for words too short for the index: literal, in any case, all of them."""
    found = chunks.where(matching(F.col(text_col), [w.lower() for w in words]))
    return found.where(where) if where is not None else found


def postings(chunks: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """gram, id, freq of every trigram."""
    return grams.postings(chunks, id_col, text_col, lower=True)


def gram_totals(chunks: DataFrame, text_col: str = "text") -> DataFrame:
    """gram, docs, freq of every trigram, each row being a document: the postings summed up by gram."""
    return grams.totals(chunks, text_col, lower=True)
