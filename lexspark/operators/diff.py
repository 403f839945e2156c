"""Clause-level differences between two versions of a document."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexspark.functions.text import line_diff, nfkc, similarity
from lexspark.operators.headings import level_of, under_headings

PREAMBLE, SAME_HEADING = "(前文)", 0.72
CHANGES = "target_id string, base_id string, ord int, status string, key string, heading string, similarity double, lines array<struct<op:string,text:string>>"


def clauses(blocks: list[dict]) -> dict[str, tuple[str, str]]:
    """key -> (heading, body), in order. The title (level 1) is in no key; repeated keys are numbered from 2."""
    found: list[tuple[str, str, list[str]]] = []
    for head, above, own in under_headings(blocks, lambda h: nfkc(h.get("clause") or h.get("text"))):
        inner = head is not None and level_of(head) >= 2
        key = " > ".join(v for k, v in sorted(above.items()) if k >= 2) if inner else ""
        body: list[str] = []
        for b in own:
            if b["type"] == "table":
                body += [" | ".join(nfkc(c) for c in row) for row in (b.get("rows") if b.get("rows") is not None else [])]
            elif b["type"] != "figure" and b.get("text"):
                body.append(nfkc(b["text"]))
        found.append((key or PREAMBLE, nfkc(head.get("text")) if inner else "", body))
    out: dict[str, tuple[str, str]] = {}
    seen: dict[str, int] = {}
    for key, heading, body in found:
        if key == PREAMBLE and not heading and not body:
            continue
        seen[key] = seen.get(key, 0) + 1
        out[key if seen[key] == 1 else f"{key}#{seen[key]}"] = heading, "\n".join(body).strip()
    return out


def pair_up(old: dict, new: dict) -> dict[str, str]:
    """new key -> old key: equal keys, then the most similar heading among what is left, each old clause once."""
    out = {k: k for k in new if k in old}
    left = [k for k in old if k not in out]
    for k in (k for k in new if k not in out):
        scores = [similarity(old[o][0], new[k][0]) for o in left]
        if scores and max(scores) >= SAME_HEADING:
            out[k] = left.pop(scores.index(max(scores)))
    return out


def masked(text: str) -> str:
    return re.sub(r"(?:19|20)\d{2}", "YYYY", text)


def compare(old_blocks: list[dict], new_blocks: list[dict]) -> list[dict]:
    """A row for each clause, unchanged ones too, in the new order, removed ones last."""
    old, new = clauses(old_blocks), clauses(new_blocks)
    pairs = pair_up(old, new)
    rows = []
    for i, (key, (heading, body)) in enumerate(new.items()):
        row = {"ord": i, "key": key, "heading": heading, "similarity": None, "lines": []}
        if key not in pairs:
            rows.append(row | {"status": "added", "lines": [("add", x) for x in body.splitlines() if x.strip()]})
            continue
        before = old[pairs[key]][1]
        if before == body:
            rows.append(row | {"status": "unchanged"})
        else:
            status = "year_only" if masked(before) == masked(body) else "changed"
            rows.append(row | {"status": status, "similarity": round(similarity(before, body), 3), "lines": line_diff(before, body)})
    used = set(pairs.values())
    for key, (heading, body) in old.items():
        if key not in used:
            rows.append({"ord": 1_000_000, "key": key, "heading": heading, "similarity": None, "status": "removed", "lines": [("del", x) for x in body.splitlines() if x.strip()]})
    return rows


def diff_pairs(pairs: DataFrame) -> DataFrame:
    """Clause rows of pairs (target_id, base_id, old_blocks, new_blocks); a row holds its two documents."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in CHANGES.split(", ")[:7]] + ["lines"]
        for batch in batches:
            rows = [{"target_id": t, "base_id": b} | r | {"lines": [{"op": o, "text": x} for o, x in r["lines"]]} for t, b, x, y in zip(batch["target_id"], batch["base_id"], batch["old_blocks"], batch["new_blocks"], strict=True) for r in compare([dict(z) for z in x], [dict(z) for z in y])]
            yield pd.DataFrame(rows, columns=names)

    return pairs.select("target_id", "base_id", "old_blocks", "new_blocks").mapInPandas(run, CHANGES)


def summary(changes: DataFrame) -> DataFrame:
    count = lambda s: F.count(F.when(F.col("status") == s, 1)).alias(s)
    return changes.groupBy("target_id", "base_id").agg(F.count("*").alias("clauses"), *[count(s) for s in ("unchanged", "changed", "year_only", "added", "removed")])


def adjacent(members: DataFrame, series: str, order: list, id_col: str) -> DataFrame:
    """Neighbouring members of each series: base_id, target_id."""
    w = Window.partitionBy(series).orderBy(*order)
    return members.select(series, F.col(id_col).alias("base_id"), F.lead(id_col).over(w).alias("target_id")).where("target_id is not null")


def pairs_of(members: DataFrame, previous: DataFrame) -> DataFrame:
    """kind, base_id, target_id: a document and its earlier version (`previous`: doc_id), and neighbouring editions of a series."""
    old = previous.select(F.lit("revision").alias("kind"), F.concat("doc_id", F.lit("@previous")).alias("base_id"), F.col("doc_id").alias("target_id"))
    order = [F.coalesce("effective_date", F.lit("0000-00-00")), "doc_id"]
    return old.unionByName(adjacent(members, "series", order, "doc_id").select(F.lit("edition").alias("kind"), "base_id", "target_id"))


def index(summaries: DataFrame) -> DataFrame:
    """target_id and its comparisons (kind, base_date, base_id, counts): revisions first, then by the base's date; `substantive` counts what is more than a year."""
    own = summaries.withColumn("substantive", F.col("changed") + F.col("added") + F.col("removed"))
    row = F.struct((F.col("kind") != "revision").alias("later"), "base_date", "base_id", "kind", "clauses", "unchanged", "changed", "year_only", "added", "removed", "substantive")
    sorted_ = F.array_sort(F.collect_list(row))
    return own.groupBy("target_id").agg(sorted_.alias("d")).select("target_id", F.transform("d", lambda x: x.dropFields("later")).alias("diffs"))


def addresses(docs: DataFrame, indexed: DataFrame, root: str) -> DataFrame:
    """url, last_date: the root, each document and each of its comparisons (docs: doc_id, upload_date)."""
    quoted = lambda x: F.replace(F.url_encode(x), F.lit("+"), F.lit("%20"))
    pages = docs.select(F.concat(F.lit(root + "/doc/"), quoted(F.col("doc_id"))).alias("url"), F.col("upload_date").alias("last_date"))
    newest = docs.agg(F.lit(root + "/").alias("url"), F.max("upload_date").alias("last_date"))
    each = indexed.select("target_id", F.explode("diffs").alias("d")).join(docs, F.col("target_id") == F.col("doc_id"))
    diffs = each.select(F.concat(F.lit(root + "/doc/"), quoted(F.col("doc_id")), F.lit("/diff/"), quoted(F.col("d.base_id"))).alias("url"), F.col("upload_date").alias("last_date"))
    return newest.unionByName(pages).unionByName(diffs)
