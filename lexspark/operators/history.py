"""Change detection, event history, series, merges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def classify(now: DataFrame, before: DataFrame, id_col: str, version: str, whole: bool = True) -> DataFrame:
    """id and status: added, updated, unchanged, or (on whole runs) removed."""
    a, b = now.select(id_col, F.struct(version).alias("v"), F.lit(True).alias("here")), before.select(id_col, F.struct(version).alias("w"), F.lit(True).alias("was"))
    out = a.join(b, id_col, "full_outer")
    status = F.when(F.col("was").isNull(), "added").when(F.col("here").isNull(), "removed").when(F.col("v").eqNullSafe(F.col("w")), "unchanged").otherwise("updated")
    out = out.select(id_col, status.alias("status"))
    return out if whole else out.where("status <> 'removed'")


def check_shrink(before: int, now: int, least: float = 0.7) -> None:
    if before and now < least * before:
        raise ValueError(f"{now} entries after {before}")


def observed(changes: DataFrame) -> DataFrame:
    """doc_id, date, type of a change feed (doc_id, kind, upload_date, previous_date, detected): updates with both dates give two
    events, re-conversions none; an update beats a listing of the same document and date."""
    real = (F.col("kind") == "updated") & F.col("previous_date").isNotNull() & F.col("upload_date").isNotNull() & (F.col("previous_date") != F.col("upload_date"))
    event = lambda date, kind: F.struct(F.col(date).alias("date"), F.lit(kind).alias("type"))
    rows = changes.where("kind in ('added', 'updated')").select("doc_id", F.explode(F.when(real, F.array(event("previous_date", "listed"), event("upload_date", "updated"))).otherwise(F.array(event("upload_date", "listed")))).alias("e"))
    rows = rows.select("doc_id", "e.date", "e.type").where("date is not null")
    return rows.groupBy("doc_id", "date").agg(F.max_by("type", F.when(F.col("type") == "updated", 1).otherwise(0)).alias("type"))


def reconverted(changes: DataFrame) -> DataFrame:
    """doc_id and the days on which the same version was converted again."""
    same = changes.where("kind = 'updated'").where(~F.coalesce(F.col("previous_date") != F.col("upload_date"), F.lit(False)))
    return same.groupBy("doc_id").agg(F.array_sort(F.collect_set("detected")).alias("reconverted_at"))


def histories(state: DataFrame, changes: DataFrame) -> DataFrame:
    """doc_id, series, events of each document (state: doc_id, series, upload_date, removed_at)."""
    own = observed(changes).unionByName(state.where("upload_date is not null").select("doc_id", F.col("upload_date").alias("date"), F.lit("listed").alias("type")))
    own = own.groupBy("doc_id", "date").agg(F.max_by("type", F.when(F.col("type") == "updated", 1).otherwise(0)).alias("type"))
    a, b = state.select("doc_id", "series"), state.where("removed_at is null and upload_date is not null").select(F.col("doc_id").alias("other"), "series", F.col("upload_date").alias("date"))
    # the events of a series are its members' by definition: each with each of the others
    edition = a.join(b, "series").where("doc_id <> other").select("doc_id", "date", F.lit("edition").alias("type"))
    detected = changes.where("kind = 'removed'").groupBy("doc_id").agg(F.max("detected").alias("detected"))
    removed = state.join(detected, "doc_id", "left").select("doc_id", F.coalesce("detected", F.substring("removed_at", 1, 10)).alias("date"), F.lit("removed").alias("type")).where("date is not null")
    every = own.unionByName(edition).unionByName(removed)
    events = every.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("date", "type"))).alias("events"))
    return a.join(events, "doc_id", "left").join(reconverted(changes), "doc_id", "left")


def editions(state: DataFrame) -> DataFrame:
    """Series of several members, in order of effective date and id, each with the one before."""
    order = Window.partitionBy("series").orderBy(F.coalesce("effective_date", F.lit("0000-00-00")), "doc_id")
    out = state.where("removed_at is null").withColumn("previous_id", F.lag("doc_id").over(order)).withColumn("members", F.count("*").over(Window.partitionBy("series")))
    return out.where("members > 1")


def upsert(previous: DataFrame, fresh: DataFrame, key: str, kept: list[str]) -> DataFrame:
    """Fresh rows win; the columns `kept` stay where the fresh row has none."""
    p, f = previous.alias("p"), fresh.alias("f")
    new = F.col(f"f.{key}").isNotNull()
    columns = [F.coalesce(f"f.{key}", f"p.{key}").alias(key)]
    for c in previous.columns:
        if c != key:
            columns.append((F.coalesce(f"f.{c}", f"p.{c}") if c in kept else F.when(new, F.col(f"f.{c}")).otherwise(F.col(f"p.{c}"))).alias(c))
    return p.join(f, F.col(f"p.{key}") == F.col(f"f.{key}"), "full_outer").select(columns)


def sync_plan(catalog: DataFrame, state: DataFrame, fetched: DataFrame, version: str) -> DataFrame:
    """doc_id, action, snapshot, stage of a run. catalog: doc_id, upload_date; state: doc_id, upload_date, sha256,
    pipeline_version, has_document; fetched: doc_id, sha256 (null: failed), converted (false: failed).

    unchanged: same date, version and artefact, or same bytes, version and artefact (`refresh`: its date is stored anew);
    failed, with the stage; added without a record, else updated. A snapshot is taken of what is replaced with another date."""
    s = state.select("doc_id", F.col("upload_date").alias("old_date"), F.col("sha256").alias("old_sha"), "pipeline_version", "has_document", F.lit(True).alias("known"))
    f = fetched.select("doc_id", "sha256", "converted")
    current = F.coalesce((F.col("pipeline_version") == version) & F.col("has_document"), F.lit(False))
    same_date = current & F.coalesce(F.col("upload_date") == F.col("old_date"), F.lit(False))
    same_bytes = current & F.coalesce(F.col("sha256") == F.col("old_sha"), F.lit(False))
    action = F.when(same_date, "unchanged").when(F.col("sha256").isNull(), "failed").when(same_bytes, "unchanged").when(~F.coalesce("converted", F.lit(True)), "failed").when(F.col("known"), "updated").otherwise("added")
    own = catalog.select("doc_id", "upload_date").join(s, "doc_id", "left").join(f, "doc_id", "left").withColumn("action", action)
    replaced = F.col("action").isin("updated", "failed") & F.col("sha256").isNotNull() & F.coalesce(F.col("old_date") != F.col("upload_date"), F.lit(False))
    stage = F.when(F.col("action") == "failed", F.when(F.col("sha256").isNull(), "fetch").otherwise("convert"))
    return own.select("doc_id", "action", replaced.alias("snapshot"), stage.alias("stage"), (~same_date & same_bytes).alias("refresh"))


def to_reconvert(state: DataFrame, version: str) -> DataFrame:
    """doc_id of kept documents whose artefact is of another version; run again, it goes on where it stopped."""
    return state.where("removed_at is null and has_document").where(~F.col("pipeline_version").eqNullSafe(F.lit(version))).select("doc_id")


def to_fetch(notices: DataFrame, known: DataFrame, since: str | None = None, forced: bool = False) -> DataFrame:
    """Rule changes that are not known yet (all, if forced), from a date on; no date counts as late."""
    own = notices.where("rule_change")
    own = own if since is None else own.where(F.coalesce("date", F.lit("9999")) >= since)
    return own if forced else own.join(known.select("id"), "id", "left_anti")


def newest(notices: DataFrame) -> DataFrame:
    return notices.orderBy(F.desc("date"), F.desc("id"))


def recent(events: DataFrame, today: str, days: int = 14) -> DataFrame:
    """type, date and documents of events (doc_id, date, type) of the last days."""
    own = events.where(F.col("date") >= F.date_format(F.date_sub(F.lit(today).cast("date"), days), "yyyy-MM-dd")).select("doc_id", "date", "type").distinct()
    return own.groupBy("type", "date").agg(F.array_sort(F.collect_set("doc_id")).alias("doc_ids")).orderBy("type", F.desc("date"))


def merged(catalogs: list[DataFrame], key: str) -> DataFrame:
    """Rows of several catalogues, each key once, from the first that has it."""
    every = None
    for k, c in enumerate(catalogs):
        own = c.withColumn("_from", F.lit(k))
        every = own if every is None else every.unionByName(own)
    names = [c for c in every.columns if c not in ("_from", key)]
    return every.groupBy(key).agg(F.min_by(F.struct(*names), "_from").alias("x")).select(key, "x.*")
