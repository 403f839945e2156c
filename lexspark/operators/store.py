"""Lookups and pages over the stored tables: documents, chunks, hits, headings, answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexspark.functions import columns as C
from lexspark.functions import text as T
from lexspark.operators.chunking import page_at

OTHER = "その他"
EXCERPT, HEADINGS, SHOWN, HEADING, DESCRIPTION = 200, 200, 12, 30, 150


def meta_value(meta: DataFrame, key: str) -> DataFrame:
    return meta.where(F.col("key") == key).select("value")


def by_id(docs: DataFrame, doc_id, columns: list[str] | None = None) -> DataFrame:
    """A document's row, or some of its columns; the filter reaches the scan."""
    found = docs.where(F.col("doc_id") == doc_id)
    return found.select(*columns) if columns else found


def hydrated(ids: DataFrame, chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """Ranked chunk ids (chunk_id, rank) with their chunks and documents; `place` keeps counting over ids that are not found."""
    found = ids.join(chunks, "chunk_id").join(docs, "doc_id")
    return found.withColumn("place", F.col("rank")).orderBy("rank")


def with_related(docs: DataFrame, history: DataFrame, diffs: DataFrame, notices: DataFrame) -> DataFrame:
    """docs with events, comparisons and the notices of their series; empty arrays where there are none."""
    out = docs.join(history.select("doc_id", "events"), "doc_id", "left").join(diffs.select(F.col("target_id").alias("doc_id"), "diffs"), "doc_id", "left").join(notices.select("series", "notices"), "series", "left")
    empty = lambda c: F.coalesce(c, F.array().cast(out.schema[c].dataType)).alias(c)
    return out.select(*docs.columns, empty("events"), empty("diffs"), empty("notices"))


def editions_of(docs: DataFrame, doc_id) -> DataFrame:
    """All editions of a document's series with `current`, in order; no rows where it is the only one."""
    series = docs.where(F.col("doc_id") == doc_id).select("series").limit(1)
    own = docs.join(F.broadcast(series), "series", "left_semi").withColumn("n", F.count("*").over(Window.partitionBy("series")))  # one series
    return own.where("n > 1").select("series", "doc_id", "edition", (F.col("doc_id") == doc_id).alias("current")).orderBy("edition", "doc_id")


def newest_first(events: Column) -> Column:
    return F.reverse(F.array_sort(events))


def hits(found: DataFrame, terms: list[str]) -> DataFrame:
    """Search hits (chunks with their documents' columns) as shown: the page of the match, whether the heading is to be
    trusted for it, the clause there if not, the excerpt, the address of the page."""
    own = found.withColumn("offset", F.coalesce(T.first_match_column("text", terms), F.lit(0)))
    start = F.coalesce("page_start", F.lit(0))
    own = own.withColumn("page", F.coalesce(page_at(F.col("pages"), F.col("offset")), start)).withColumn("heading_reliable", F.abs(F.col("page") - start) <= 1)
    clause = F.when(~F.col("heading_reliable"), T.clause_at_column("text", "offset", "heading"))
    return own.withColumn("clause_at_match", clause).withColumn("snippet", T.excerpt_column("text", terms)).withColumn("pdf_page_url", C.page_url(F.col("pdf_url"), F.col("page")))


def by_document(page: DataFrame, place: str, doc: str, row: list[str]) -> DataFrame:
    """Hits of a page under their documents, in the order of first appearance."""
    own = page.groupBy(doc).agg(F.min(place).alias("first"), F.array_sort(F.collect_list(F.struct(place, *row))).alias("hits"))
    return own.orderBy("first")


def by_section(facets: DataFrame, section: str, n: str = "n") -> DataFrame:
    """Counts by section; those without one are together."""
    label = F.coalesce(F.nullif(F.btrim(F.col(section)), F.lit("")), F.lit(OTHER))
    return facets.groupBy(label.alias("section")).agg(F.sum(n).alias("n")).orderBy(F.desc("n"), "section")


def control_breaks(rows: DataFrame, keys: list[str], order: list[str], within: str) -> DataFrame:
    """rows with `opens`: the first of a run of equal keys in a sorted report (a report of each `within`)."""
    w = Window.partitionBy(within).orderBy(*order)
    now = F.struct(*[F.coalesce(F.nullif(F.col(k).cast("string"), F.lit("")), F.lit(OTHER)).alias(k) for k in keys])
    return rows.withColumn("_now", now).withColumn("opens", ~F.col("_now").eqNullSafe(F.lag("_now").over(w))).drop("_now")


def description(chunks: DataFrame) -> DataFrame:
    """doc_id, description: the first SHOWN different clause-like headings of a document's first HEADINGS chunks."""
    w = Window.partitionBy("doc_id").orderBy("chunk_id")
    own = chunks.select("doc_id", "chunk_id", T.normalised(F.col("heading")).alias("heading")).withColumn("k", F.row_number().over(w)).where(F.col("k") <= HEADINGS)
    own = own.where((F.col("heading") != "") & (F.length("heading") <= HEADING) & ~F.col("heading").rlike("[。、]") & F.col("heading").rlike(T.CLAUSE_LINE.pattern))
    once = own.groupBy("doc_id", "heading").agg(F.min("k").alias("k"))
    listed = once.groupBy("doc_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("k", "heading"))), 1, SHOWN).alias("h"))
    return listed.select("doc_id", C.clip(F.array_join(F.transform("h", lambda x: x["heading"]), "／"), DESCRIPTION).alias("description"))


def source_fields(rows: DataFrame) -> DataFrame:
    """Answer sources with url (deep link), page_url and excerpt (EXCERPT characters)."""
    url = F.concat(F.lit("/doc/"), C.url_quoted(F.col("doc_id")), F.when(F.coalesce(F.col("anchor"), F.lit("")) != "", F.concat(F.lit("#"), C.url_quoted(F.col("anchor")))).otherwise(""))
    return rows.withColumn("url", url).withColumn("page_url", C.page_url(F.col("pdf_url"), F.col("page"))).withColumn("excerpt", F.substring("text", 1, EXCERPT))


def cited(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """Citation marks of answers (id, text) with their sources (id, place, ...); `dangling` where there is none."""
    marks = answers.select("id", F.posexplode(C.citations(F.col("text"))).alias("k", "place"))
    return marks.join(sources.withColumn("_there", F.lit(True)), ["id", "place"], "left").withColumn("dangling", F.col("_there").isNull()).drop("_there", "k")


def context(sources: DataFrame, turns: DataFrame, last: int = 6) -> DataFrame:
    """id, context (numbered sources, in order) and turns (the last ones, oldest first) of questions."""
    shown = F.concat(F.lit("["), F.col("place").cast("string"), F.lit("] "), F.col("title"), F.lit("\n"), F.col("text"))
    own = sources.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", shown.alias("x")))), lambda r: r["x"]), "\n\n").alias("context"))
    w = Window.partitionBy("id").orderBy(F.desc("turn"))
    kept = turns.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= last).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    return own.join(kept, "id", "left")


def embedding_batches(pending: DataFrame, size: int = 32, chars: int = 1600) -> DataFrame:
    """Texts to embed, cut to length and dealt into batches: bucket and batch in it, so no task numbers them all."""
    own = pending.select("text_hash", F.substring("text", 1, chars).alias("text")).withColumn("bucket", F.pmod(F.xxhash64("text_hash"), F.lit(1024)).cast("int"))
    at = F.row_number().over(Window.partitionBy("bucket").orderBy("text_hash"))
    return own.withColumn("batch", F.floor((at - 1) / size).cast("int"))


def quality_gate(docs: DataFrame, chunks: DataFrame, optional: list[str]) -> DataFrame:
    """One row: documents, chunks, vectors, how many rows fill each optional column, and ok."""
    filled = docs.agg(F.count("*").alias("docs"), *[F.count(F.when(F.size(c) > 0, 1)).alias(c) for c in optional])
    own = filled.crossJoin(F.broadcast(chunks.agg(F.count("*").alias("chunks"), F.count("vec").alias("vectors"))))  # one row each
    ok = F.col("vectors") > 0
    for c in optional:
        ok = ok & (F.col(c) > 0)
    return own.withColumn("ok", ok & (F.col("docs") > 0))


def manifest_faults(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """name and fault of files (name, sha256, rows) that are missing or differ from their manifest."""
    m = manifest.select("name", F.col("sha256").alias("_sha"), F.col("rows").alias("_rows"))
    own = m.join(files, "name", "left")
    fault = F.when(F.col("sha256").isNull(), "missing").when(F.col("sha256") != F.col("_sha"), "digest").when(~F.col("rows").eqNullSafe(F.col("_rows")), "rows")
    return own.select("name", fault.alias("fault")).where("fault is not null")
