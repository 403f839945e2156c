"""Linking of notices to document series, and references between rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexspark.functions import text as T
from lexspark.functions.columns import title_norm, trigrams

SHORTEST_TITLE, SHORTEST_KEY, NEAR, PER_REFERENCE, IN_ALL, HEADING = 6, 8, 60, 3, 5, 40


def series_titles(state: DataFrame) -> DataFrame:
    """name, owner, ord: the normalised titles (the id where there is none) of documents that are not removed, of
    SHORTEST_TITLE characters at least; the first in the order of ids names the series."""
    own = state.where("removed_at is null").select("doc_id", "series", title_norm(F.coalesce(F.nullif("title", F.lit("")), F.col("doc_id").cast("string"))).alias("name"))
    return own.where(F.length("name") >= SHORTEST_TITLE).groupBy("name").agg(F.min_by("series", "doc_id").alias("owner"), F.min("doc_id").alias("ord"))


def display_order(links: DataFrame, n: int = 3) -> DataFrame:
    """Of each series the first n notices, those with a comparison first, then the newest; `comparison` is the first file of that kind."""
    w = Window.partitionBy("owner").orderBy(F.desc("has_comparison"), F.desc("date"), F.desc("id"))
    file = F.try_element_at(F.filter("attachments", lambda a: a["comparison"]), F.lit(1))
    return links.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n).withColumn("comparison", file)


def longest_contained(texts: DataFrame, names: DataFrame, id_col: str, text_col: str, least: int = SHORTEST_TITLE) -> DataFrame:
    """For each text the longest name (name, owner, ord) in it; ties to the smaller ord. Names meet texts on their
    trigram that fewest names share, an equi join of ids and trigrams; only then texts and names are compared whole."""
    known = names.where(F.length("name") >= least).select("name", "owner", "ord")
    grams = known.select("name", F.explode(F.array_distinct(trigrams(F.col("name")))).alias("gram")).distinct()
    rare = grams.join(grams.groupBy("gram").agg(F.count("*").alias("n")), "gram").groupBy("name").agg(F.min(F.struct("n", "gram")).alias("r")).select("name", F.col("r.gram").alias("gram"))
    own = texts.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    near = own.select("_id", F.explode(F.array_distinct(trigrams(F.col("_text")))).alias("gram")).join(rare, "gram").select("_id", "name").distinct()
    found = near.join(own, "_id").where(F.contains("_text", "name")).select("_id", "name").join(known, "name")
    best = found.groupBy("_id").agg(F.min(F.struct((-F.length("name")).alias("n"), "ord", "name", "owner")).alias("best"))
    return best.select(F.col("_id").alias(id_col), F.col("best.name").alias("name"), F.col("best.owner").alias("owner"))


def link_notices(notices: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(links, unmatched) of notices (id, title_norm, date, attachments array<struct<text_norm, url, comparison>>): by
    attachment; where none matches, by title with all attachments."""
    each = notices.select("id", F.posexplode("attachments").alias("no", "a")).select("id", "no", "a", F.concat_ws("/", "id", "no").alias("aid"), F.col("a.text_norm").alias("text"))
    by_file = each.join(longest_contained(each, names, "aid", "text"), "aid").groupBy("id", "owner").agg(F.array_sort(F.collect_list(F.struct("no", "a"))).alias("own"))
    by_file = by_file.select("id", "owner", F.transform("own", lambda x: x["a"]).alias("attachments"))
    rest = notices.join(by_file.select("id").distinct(), "id", "left_anti")
    by_title = rest.join(longest_contained(rest, names, "id", "title_norm"), "id").select("id", "owner", "attachments")
    links = by_file.unionByName(by_title).withColumn("has_comparison", F.exists("attachments", lambda a: a["comparison"]))
    return links, notices.join(links.select("id").distinct(), "id", "left_anti")


# Article numbers and dotted numbers that name a place in a rule, in a text without white space.
ARTICLE, DOTTED = r"第([0-9]+)条(?:第?([0-9]+)項)?", r"(?<![0-9.])([0-9]+(?:\.[0-9]+){1,4})\)?"
# What a title ends in besides its name.
TITLE_TAIL = r"(?:_日本語版|_仏語英語版|_英語)?(?:[_\-][0-9]{8})?(?:-[0-9a-f]{6})?$"


def title_keys(docs: DataFrame, least: int = SHORTEST_KEY) -> DataFrame:
    """key, doc_ids: titles without tail and white space, in compatibility form, and the documents that bear them."""
    key = T.squashed(F.regexp_replace(F.coalesce("title", F.lit("")), TITLE_TAIL, ""))
    return docs.select(key.alias("key"), "doc_id").where(F.length("key") >= least).groupBy("key").agg(F.array_sort(F.collect_set("doc_id")).alias("doc_ids"))


def _places(text: Column, pattern: str) -> Column:
    """at, whole and number of every match: what stands between the matches gives their places."""
    whole, number, gaps = (F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.split(text, pattern, -1))
    return F.transform(F.arrays_zip(whole.alias("whole"), number.alias("number"), F.slice(gaps, 1, F.size(whole)).alias("gap")), lambda x: x)


def _marks(texts: DataFrame, pattern: str, order: int, label) -> DataFrame:
    own = texts.select("id", F.posexplode(_places(F.col("text"), pattern)).alias("k", "m"))
    w = Window.partitionBy("id").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    at = F.sum(F.length("m.gap") + F.length("m.whole")).over(w) - F.length("m.whole")
    return own.select("id", F.lit(order).alias("kind"), at.alias("at"), F.col("m.number").alias("prefix"), label(F.col("m.number")).alias("shown"))


def name_places(texts: DataFrame, keys: DataFrame) -> DataFrame:
    """id, begin, end, key of the rule names in texts (id, text without white space): names meet texts on their first
    SHORTEST_KEY characters, an equi join, and are then compared whole. Of names that begin inside a longer one found
    there the longer one stays."""
    wanted = keys.where(F.length("key") >= SHORTEST_KEY).select("key", F.substring("key", 1, SHORTEST_KEY).alias("gram"))
    grams = F.regexp_extract_all("text", F.lit(f"(?s)(?=(.{{{SHORTEST_KEY}}}))."), F.lit(1))
    own = texts.select("id", F.posexplode(grams).alias("begin", "gram")).join(wanted, "gram").join(texts, "id")
    own = own.where(F.substr("text", F.col("begin") + 1, F.length("key")) == F.col("key"))
    found = own.groupBy("id").agg(F.array_sort(F.collect_set(F.struct((-F.length("key")).alias("short"), "key", "begin", (F.col("begin") + F.length("key")).alias("end")))).alias("f"))
    none = F.array().cast("array<struct<short:int,key:string,begin:int,end:int>>")
    kept = F.aggregate("f", none, lambda done, x: F.when(F.exists(done, lambda y: (y["begin"] <= x["begin"]) & (x["begin"] < y["end"])), done).otherwise(F.concat(done, F.array(x))))
    return found.select("id", F.explode(kept).alias("x")).select("id", "x.begin", "x.end", "x.key")


def references(texts: DataFrame, keys: DataFrame) -> DataFrame:
    """id, ref, key, prefix, label, doc_ids: references in texts (id, text) to rules (keys: key, doc_ids), in order (ref from 1):
    for each article number, then each dotted number, the last rule name that begins before it and ends NEAR characters
    before it at most. The paragraph of an article is not looked at. The same reference counts once for a text."""
    flat = texts.select("id", T.squashed(F.col("text")).alias("text")).where("text <> ''")
    marks = _marks(flat, ARTICLE, 0, lambda n: F.concat(F.lit("第"), n, F.lit("条"))).unionByName(_marks(flat, DOTTED, 1, lambda n: n))
    names = name_places(flat, keys)
    # as-of backward by place: one shuffle by text
    near = marks.join(names, "id").where((F.col("begin") < F.col("at")) & (F.col("at") - F.col("end") <= NEAR))
    best = near.groupBy("id", "kind", "at", "prefix", "shown").agg(F.max_by("key", "begin").alias("key"))
    once = best.groupBy("id", "key", "prefix", F.concat_ws(" ", "key", "shown").alias("label")).agg(F.min(F.struct("kind", "at")).alias("first"))
    ranked = once.withColumn("ref", F.row_number().over(Window.partitionBy("id").orderBy("first", "key", "label")))
    return ranked.join(keys.select("key", "doc_ids"), "key").select("id", "ref", "key", "prefix", "label", "doc_ids")


def heading_under(heading: Column, prefix: Column, first: bool = False) -> Column:
    """A heading below a number (its first article only, if asked for), or the article itself."""
    flat = T.squashed(heading)
    return F.startswith(flat, F.concat(prefix, F.lit(".1" if first else "."))) | F.startswith(flat, F.concat(F.lit("第"), prefix, F.lit("条")))


def sane(heading: Column) -> Column:
    flat = T.squashed(heading)
    return (F.length(flat) <= HEADING) & ~flat.rlike("[。、]")


def follow(chunks: DataFrame, scored: DataFrame, refs: DataFrame, seen: DataFrame) -> DataFrame:
    """chunk_id, via, place: chunks that the references of a question lead to, IN_ALL at most.

    refs: place (of the reference), prefix, label, doc_ids; scored: chunk_id, doc_id, heading, score of the question's
    matches; seen: chunk_id. Of each reference the head, the nearest chunk at or before its first match that opens the
    article, then its PER_REFERENCE best matches; a chunk counts once, for the first that leads to it. One join for the
    matches and one for the heads, whatever the number of references."""
    fresh = lambda df: df.where(sane(F.col("heading"))).join(seen, "chunk_id", "left_anti")
    wanted = refs.select("place", "prefix", "label", F.explode("doc_ids").alias("doc_id"))
    best = Window.partitionBy("place").orderBy("score", "chunk_id")
    found = fresh(scored).join(wanted, "doc_id").where(heading_under(F.col("heading"), F.col("prefix"))).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= PER_REFERENCE)
    least = found.groupBy("place").agg(F.min("chunk_id").alias("least"))
    heads = fresh(chunks.select("chunk_id", "doc_id", "heading")).join(wanted.join(least, "place"), "doc_id").where((F.col("chunk_id") <= F.col("least")) & heading_under(F.col("heading"), F.col("prefix"), first=True))
    heads = heads.groupBy("place", "label").agg(F.max("chunk_id").alias("chunk_id")).select("place", F.lit(0).alias("rank"), "chunk_id", "label")
    every = heads.unionByName(found.select("place", "rank", "chunk_id", "label"))
    once = every.groupBy("chunk_id").agg(F.min(F.struct("place", "rank", "label")).alias("x"))
    return once.orderBy("x.place", "x.rank", "chunk_id").limit(IN_ALL).select("chunk_id", F.col("x.label").alias("via"), F.col("x.place").alias("place"))


def preceding(events: DataFrame, marks: DataFrame, key: str, at: str) -> DataFrame:
    """As-of join backward: each event with the last mark of its key at or before it; one shuffle by key."""
    both = events.select(key, at, F.struct(*[c for c in events.columns]).alias("event"), F.lit(None).cast(marks.schema[at].dataType).alias("mark_at")).unionByName(marks.select(key, at, F.lit(None).cast(events.select(F.struct(*events.columns).alias("e")).schema["e"].dataType).alias("event"), F.col(at).alias("mark_at")))
    order = Window.partitionBy(key).orderBy(at, F.col("event").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("mark_at", F.last("mark_at", ignorenulls=True).over(order)).where("event is not null").select("event.*", "mark_at")
