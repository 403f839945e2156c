"""Queries that call the operators themselves on the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexspark.functions import columns as C
from lexspark.functions import text as T
from lexspark.operators import chunking, history, layout, linking, search, store, vectors
from lexspark.plans.tables import AND_TERMS, QUERY_VECTOR, _Q, bm25_sql, docs, query, table


@query("SELECT doc_id, text, lang, source, n_chars FROM documents WHERE doc_id = 42")
def document_by_id(spark, sf_dir):
    return store.by_id(docs(spark, sf_dir), 42)


@query(f"SELECT vec_id AS chunk_id, rank, label AS doc_id, n_name AS title FROM (SELECT vec_id, label, row_number() OVER (ORDER BY list_inner_product(embedding::DOUBLE[], {_Q}) DESC, vec_id) AS rank FROM embeddings) JOIN nation ON label = n_nationkey WHERE rank <= 20")
def hydrate_ranked(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    top = vectors.ranks(vectors.top_k(rows, QUERY_VECTOR, 20, "vec_id", "embedding"), [F.desc("similarity"), "vec_id"]).select(F.col("vec_id").alias("chunk_id"), "rank")
    names = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("doc_id"), F.col("n_name").alias("title"))
    return store.hydrated(top, rows.select(F.col("vec_id").alias("chunk_id"), F.col("label").alias("doc_id")), names).select("chunk_id", "rank", "doc_id", "title")


@query("SELECT doc_id, CAST(strpos(lower(text), 'erth') - 1 AS INT) AS at FROM documents WHERE contains(lower(text), 'erth')")
def first_match_offset(spark, sf_dir):
    own = docs(spark, sf_dir).where(F.contains(F.lower("text"), F.lit("erth")))
    return own.select("doc_id", T.first_match_column("text", ["erth"]).alias("at"))


@query("SELECT doc_id, CASE WHEN p > 121 THEN '… ' ELSE '' END || substr(text, greatest(p - 120, 1), p + 219 - greatest(p - 121, 0)) || CASE WHEN p + 219 < length(text) THEN ' …' ELSE '' END AS excerpt FROM (SELECT *, strpos(lower(text), 'erth') AS p FROM documents) WHERE p > 0")
def excerpt_window(spark, sf_dir):
    own = docs(spark, sf_dir).where(F.contains(F.lower("text"), F.lit("erth")))
    return own.select("doc_id", F.translate(T.excerpt_column("text", ["erth"]), T.OPEN + T.CLOSE, "").alias("excerpt"))


@query("SELECT lang, source, doc_id, (coalesce(nullif(source, ''), 'その他') IS DISTINCT FROM lag(coalesce(nullif(source, ''), 'その他')) OVER (PARTITION BY lang ORDER BY source, doc_id)) AS opens FROM documents")
def control_breaks(spark, sf_dir):
    return store.control_breaks(docs(spark, sf_dir).select("lang", "source", "doc_id"), ["source"], ["source", "doc_id"], "lang")


@query("SELECT p_brand AS doc_id, arg_max(p_size, (n, -p_size)) AS body_size FROM (SELECT p_brand, p_size::DOUBLE AS p_size, sum(length(p_name)) AS n FROM part GROUP BY p_brand, p_size) GROUP BY p_brand")
def body_size(spark, sf_dir):
    return layout.body_size(table(spark, sf_dir, "part").select(F.col("p_brand").alias("doc_id"), F.col("p_size").cast("double").alias("size"), F.col("p_name").alias("text")))


_KEY = "substr(regexp_replace(regexp_replace(line, '[\\s\\p{Z}]+', '', 'g'), '[0-9０-９]+', '#', 'g'), 1, 60)"


@query(f"WITH l AS (SELECT source, doc_id, {_KEY} AS key FROM (SELECT source, doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)), p AS (SELECT source, count(DISTINCT doc_id) AS pages FROM l GROUP BY source) SELECT source AS doc_id, key, count(DISTINCT l.doc_id) AS n FROM l JOIN p USING (source) WHERE key <> '' AND pages >= 2 GROUP BY source, key, pages HAVING count(DISTINCT l.doc_id) >= greatest(2, least(4, pages * 0.5))")
def running_lines(spark, sf_dir):
    lines = docs(spark, sf_dir).select(F.col("source").alias("doc_id"), F.col("doc_id").alias("page"), F.explode(F.split("text", "\n")).alias("text"))
    lines = lines.select("*", F.lit(0.0).alias("y0"), F.lit(10.0).alias("y1"), F.lit(800.0).alias("height"), F.lit(8.0).alias("size"))
    return layout.running_lines(lines, docs(spark, sf_dir).select(F.col("source").alias("doc_id"), F.lit(10.0).alias("body_size")).distinct())


@query("SELECT doc_id, part, CAST(row_number() OVER (ORDER BY doc_id, part) AS BIGINT) AS chunk_id FROM (SELECT doc_id, CAST(unnest(range(0, (length(text) - 1) // 1500 + 1)) AS INT) AS part FROM documents WHERE length(text) > 0)")
def chunk_ordinals(spark, sf_dir):
    parts = chunking.fixed_parts(docs(spark, sf_dir), "doc_id", "text").select("doc_id", F.lit(0).alias("section"), "part")
    return chunking.numbered(parts).select("doc_id", "part", "chunk_id")


@query("WITH c AS (SELECT o_custkey AS doc_id, CASE o_orderstatus WHEN 'O' THEN 'added' WHEN 'F' THEN 'updated' ELSE 'removed' END AS kind, strftime(o_orderdate, '%Y-%m-%d') AS up, strftime(o_orderdate - to_days(CAST(o_orderkey % 3 * 30 AS INT)), '%Y-%m-%d') AS prev FROM orders), e AS (SELECT doc_id, up AS date, CASE WHEN kind = 'updated' AND up <> prev THEN 'updated' ELSE 'listed' END AS type FROM c WHERE kind <> 'removed' UNION ALL SELECT doc_id, prev, 'listed' FROM c WHERE kind = 'updated' AND up <> prev) SELECT doc_id, date, max(type) AS type FROM e GROUP BY doc_id, date")
def events_observed(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    kind = F.when(F.col("o_orderstatus") == "O", "added").when(F.col("o_orderstatus") == "F", "updated").otherwise("removed")
    back = F.date_sub(F.col("o_orderdate").cast("date"), (F.col("o_orderkey") % 3 * 30).cast("int"))
    return history.observed(o.select(F.col("o_custkey").alias("doc_id"), kind.alias("kind"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("upload_date"), F.date_format(back, "yyyy-MM-dd").alias("previous_date")))


@query("WITH s AS (SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 3 = 0 THEN 'old' ELSE o_orderpriority END AS old_date, CASE WHEN o_orderkey % 4 = 0 THEN 'x' ELSE o_orderstatus END AS old_sha, CASE WHEN o_orderkey % 5 = 0 THEN 'v1' ELSE 'v2' END AS version, o_orderkey % 7 <> 0 AS here FROM orders WHERE o_orderkey % 9 <> 0), j AS (SELECT c.o_orderkey AS doc_id, o_orderpriority AS date, CASE WHEN c.o_orderkey % 11 <> 0 THEN o_orderstatus END AS sha, c.o_orderkey % 13 <> 0 AS converted, s.doc_id IS NOT NULL AS known, old_date, coalesce(version = 'v2' AND here, false) AS current, old_sha FROM orders c LEFT JOIN s ON c.o_orderkey = s.doc_id), a AS (SELECT *, current AND coalesce(date = old_date, false) AS same_date, current AND coalesce(sha = old_sha, false) AS same_sha FROM j), b AS (SELECT *, CASE WHEN same_date THEN 'unchanged' WHEN sha IS NULL THEN 'failed' WHEN same_sha THEN 'unchanged' WHEN NOT converted THEN 'failed' WHEN known THEN 'updated' ELSE 'added' END AS action FROM a) SELECT doc_id, action, action IN ('updated', 'failed') AND sha IS NOT NULL AND coalesce(old_date <> date, false) AS snapshot, CASE WHEN action = 'failed' THEN CASE WHEN sha IS NULL THEN 'fetch' ELSE 'convert' END END AS stage, NOT same_date AND same_sha AS refresh FROM b")
def sync_plan(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    state = o.where("o_orderkey % 9 <> 0").select(key.alias("doc_id"), F.when(key % 3 == 0, "old").otherwise(F.col("o_orderpriority")).alias("upload_date"), F.when(key % 4 == 0, "x").otherwise(F.col("o_orderstatus")).alias("sha256"), F.when(key % 5 == 0, "v1").otherwise("v2").alias("pipeline_version"), (key % 7 != 0).alias("has_document"))
    fetched = o.select(key.alias("doc_id"), F.when(key % 11 != 0, F.col("o_orderstatus")).alias("sha256"), (key % 13 != 0).alias("converted"))
    return history.sync_plan(o.select(key.alias("doc_id"), F.col("o_orderpriority").alias("upload_date")), state, fetched, "v2")


@query("SELECT doc_id, series, effective_date, previous_id, members FROM (SELECT p_partkey AS doc_id, p_brand || (p_partkey % 50)::VARCHAR AS series, CASE WHEN p_size > 10 THEN '2025-' || lpad(p_size::VARCHAR, 2, '0') END AS effective_date, lag(p_partkey) OVER (PARTITION BY p_brand || (p_partkey % 50)::VARCHAR ORDER BY coalesce(CASE WHEN p_size > 10 THEN '2025-' || lpad(p_size::VARCHAR, 2, '0') END, '0000-00-00'), p_partkey) AS previous_id, count(*) OVER (PARTITION BY p_brand || (p_partkey % 50)::VARCHAR) AS members FROM part WHERE p_partkey % 6 <> 0) WHERE members > 1")
def series_editions(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    state = p.select(F.col("p_partkey").alias("doc_id"), F.concat("p_brand", (F.col("p_partkey") % 50).cast("string")).alias("series"), F.when(F.col("p_size") > 10, F.concat(F.lit("2025-"), F.lpad(F.col("p_size").cast("string"), 2, "0"))).alias("effective_date"), F.when(F.col("p_partkey") % 6 == 0, "gone").alias("removed_at"))
    return history.editions(state).drop("removed_at")


_NOISE = C.TITLE_NOISE.removeprefix("(?U)")


@query(f"SELECT name, arg_min(p_brand, p_partkey) AS owner, min(p_partkey) AS ord FROM (SELECT *, regexp_replace(p_name || '_20250' || (p_partkey % 9 + 1) || '01', '{_NOISE}', '', 'g') AS name FROM part WHERE p_partkey % 6 <> 0) WHERE length(name) >= 6 GROUP BY name")
def title_dictionary(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    title = F.concat("p_name", F.lit("_20250"), (F.col("p_partkey") % 9 + 1).cast("string"), F.lit("01"))
    return linking.series_titles(p.select(F.col("p_partkey").alias("doc_id"), F.col("p_brand").alias("series"), title.alias("title"), F.when(F.col("p_partkey") % 6 == 0, "gone").alias("removed_at")))


@query("SELECT o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%d') AS date FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderkey % 4 <> 0 AND strftime(o_orderdate, '%Y-%m-%d') >= '1996-01-01'")
def fetch_plan(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    notices = o.select(F.col("o_orderkey").alias("id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"), (F.col("o_orderpriority") == "1-URGENT").alias("rule_change"))
    return history.to_fetch(notices, o.where("o_orderkey % 4 = 0").select(F.col("o_orderkey").alias("id")), "1996-01-01").select("id", "date")


@query("SELECT c_custkey, arg_min(name, src) AS name FROM (SELECT c_custkey, c_name AS name, 0 AS src FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, upper(c_name), 1 FROM customer WHERE c_custkey % 3 = 0) GROUP BY c_custkey")
def merged_catalogs(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return history.merged([c.where("c_custkey % 2 = 0").select("c_custkey", F.col("c_name").alias("name")), c.where("c_custkey % 3 = 0").select("c_custkey", F.upper("c_name").alias("name"))], "c_custkey")


@query(bm25_sql(AND_TERMS, "AND", ", t AS (SELECT *, row_number() OVER (ORDER BY score, doc_id) AS place FROM s ORDER BY score, doc_id LIMIT 20) SELECT source, min(place) AS first, count(*) AS n, string_agg(doc_id::VARCHAR, ',' ORDER BY place) AS ids FROM t GROUP BY source"))
def hits_by_document(spark, sf_dir):
    page = vectors.ranks(search.page(search.ranked(docs(spark, sf_dir), AND_TERMS), ["score", "doc_id"]).select("doc_id", "source", "score"), ["score", "doc_id"])
    own = store.by_document(page, "rank", "source", ["doc_id"])
    return own.select("source", F.col("first").cast("bigint").alias("first"), F.size("hits").cast("bigint").alias("n"), F.array_join(F.transform("hits", lambda h: h["doc_id"].cast("string")), ",").alias("ids"))


@query("SELECT coalesce(nullif(trim(CASE WHEN source = 'src3' THEN ' ' ELSE source END, ' '), ''), 'その他') AS section, count(*) AS n FROM documents WHERE contains(lower(text), 'erth') GROUP BY 1")
def facet_sections(spark, sf_dir):
    found = docs(spark, sf_dir).where(search.matching(F.col("text"), ["erth"])).withColumn("section", F.when(F.col("source") == "src3", " ").otherwise(F.col("source")))
    return store.by_section(search.facets(found, ["section"]), "section")


@query("SELECT id, row_number() OVER (PARTITION BY list ORDER BY id) AS rank FROM ((SELECT 0 AS list, doc_id AS id FROM documents WHERE contains(lower(text), 'ü') ORDER BY doc_id LIMIT 30) UNION ALL (SELECT 1, doc_id FROM documents WHERE contains(lower(text), '%%') ORDER BY doc_id LIMIT 30))")
def short_term_lists(spark, sf_dir):
    return search.short_lists(docs(spark, sf_dir), ["ü", "%%", "x"], "doc_id").select("id", "rank")


@query("SELECT doc_id::VARCHAR AS doc_id, CAST(coalesce(length(text), 0) + coalesce(length(lang), 0) + coalesce(length(source), 0) AS INT) AS chars, 1 AS figures, 1 AS tables, 0 AS headings FROM documents")
def document_statistics(spark, sf_dir):
    none = F.lit(None).cast("array<array<string>>").alias("rows")
    block = lambda kind, text, rows: F.struct(F.lit(kind).alias("type"), text.alias("text"), rows)
    empty = F.lit(None).cast("string")
    blocks = F.array(block("paragraph", F.col("text"), none), block("table", empty, F.array(F.array("lang", "source")).alias("rows")), block("figure", empty, none))
    return layout.statistics(docs(spark, sf_dir).select(F.col("doc_id").cast("string").alias("doc_id"), blocks.alias("blocks")))


@query("SELECT conv_id, turn, sha256(lower(trim(regexp_replace(text, '[\\s\\p{Z}]+', ' ', 'g'), ' ')) || chr(0) || 'm' || chr(0) || '64' || chr(0) || 'v1') AS key FROM conversations WHERE role = 'user'")
def answer_keys(spark, sf_dir):
    own = table(spark, sf_dir, "conversations").where("role = 'user'")
    return own.select("conv_id", "turn", C.answer_key(F.col("text"), F.lit("m"), F.lit(64), F.lit("v1")).alias("key"))


@query("SELECT event_type AS type, day AS date, count(DISTINCT user_id) AS n FROM (SELECT *, strftime(ts, '%Y-%m-%d') AS day FROM events) WHERE day >= strftime(DATE '2024-01-20' - to_days(14), '%Y-%m-%d') GROUP BY 1, 2")
def recent_events(spark, sf_dir):
    own = table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), F.date_format("ts", "yyyy-MM-dd").alias("date"), F.col("event_type").alias("type"))
    return history.recent(own, "2024-01-20").select("type", "date", F.size("doc_ids").cast("bigint").alias("n"))


@query("SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 1 WHEN p_size % 4 = 1 THEN 2 WHEN p_size % 4 = 2 AND length(p_name) <= 40 THEN 3 END AS level FROM part")
def heading_levels(spark, sf_dir):
    size = F.when(F.col("p_size") % 4 == 0, 14.5).when(F.col("p_size") % 4 == 1, 12.2).otherwise(10.5)
    return table(spark, sf_dir, "part").select("p_partkey", layout.heading_level(F.col("p_name"), size, F.lit(10.0), F.col("p_size") % 4 == 2).alias("level"))
