"""Documents to token digests: toxicity, near-duplicates, contamination, secrets, tokens.

Every stage takes documents with any further columns, whatever their names, and but for the last returns COLUMNS. Rows
with null in any column, empty and very long texts, ties and repeated rows go through every stage as its docstring says;
an empty table of documents gives no rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspark.llm import bpe, decontam, minhash, secrets, toxicity
from lexspark.llm.common import stored, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below the threshold; the network learns from all labelled documents but the held-out ones.

    Null and empty texts get the score of an empty window; repeated rows one score; without labels of both kinds all stay."""
    docs = docs.select(COLUMNS)
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model, score_col="_toxic").where(F.col("_toxic") < toxicity.THRESHOLD).select(COLUMNS)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: that with the smallest id. Documents without words or id are kept, and all rows of an
    id of which one row is the kept one of its group (repeated rows stay repeated)."""
    docs = docs.select(COLUMNS)
    rows = minhash.near_duplicates(docs).where("doc_id is not null").groupBy("doc_id").agg(F.bool_or("kept").alias("kept"))
    gone = rows.where(~F.col("kept")).select(F.col("doc_id").alias("_gone"))
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which windows of fewer than two benchmark items occur; texts without words have none and stay."""
    found = decontam.decontaminate(docs.select(COLUMNS), table(spark, sf_dir, "benchmark"), found_col="_found")
    return found.where(F.size("_found.items") < 2).select(COLUMNS)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each secret replaced; n_chars follows the text, and is null where the text is."""
    out = secrets.redact(docs.select(COLUMNS), secrets.grow(secrets.labelled_findings(spark)))
    return out.withColumn("n_chars", F.length("text").cast("bigint")).select(COLUMNS)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded bytes; a null text has no tokens."""
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, ids=False)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", keep_one_of_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("bpe", tokenise),
]
#: A trained network and a merge replay are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
