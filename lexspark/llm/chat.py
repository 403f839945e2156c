"""Preference formatting with DataFrame functions only.

A pair names a chosen and a rejected conversation. Turns are aligned by their numbers; the prefix is all turns before
the first number at which the two differ (in role or text, or because one has no such turn). The prefix is rendered
once as the prompt; what follows is rendered as the two completions, each with the spans of characters that carry loss:
the texts, with their end marks, of assistant turns. In rendered roles and texts a backslash is doubled and the marks
are broken by one ("<|" as "<\\|", "|>" as "|\\>"), so that no text can pass for a turn.

A shuffle by conversation finds the pairs' turns, one by pair and turn compares the two sides, and one by pair gathers
a conversation's own turns, which its row holds anyway; sums of lengths run over sorted turns, so the time is in
proportion to a conversation's length. Rows with null conv_id or turn take no part. A null role or text counts as empty.
Several rows of one turn are one turn, in order of role and text, repeated rows included. A pair with a side that has no
turns is left out; completions may be empty (equal conversations, or one the beginning of the other). Very long texts
are rendered whole. Other columns of the turns, whatever their names, are not looked at. Empty tables: no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BEGIN, MIDDLE, END = "<|", "|>\n", "<|end|>\n"
LOSS_ROLE = "assistant"


def broken_off(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, pairs): each conversation with an assistant turn, and as its rejected side the same one ending in the first
    half of the text of its last assistant turn (of an odd number of characters the shorter half; turns after it are
    dropped, and so is that half where it is empty). pair_id and chosen_id are the conv_id, rejected_id is -1 - conv_id."""
    own = turns.select("conv_id", "turn", "role", "text").where("conv_id is not null and turn is not null")
    last = own.where(F.col("role") == LOSS_ROLE).groupBy("conv_id").agg(F.max("turn").alias("_last"))
    both = own.join(last, "conv_id")
    answer = (F.col("turn") == F.col("_last")) & F.coalesce(F.col("role") == LOSS_ROLE, F.lit(False))
    half = F.substring(F.col("text"), F.lit(1), F.floor(F.length("text") / 2).cast("int"))
    cut = both.where("turn <= _last").select((-1 - F.col("conv_id")).alias("conv_id"), "turn", "role", F.when(answer, half).otherwise(F.col("text")).alias("text"), answer.alias("_answer"))
    cut = cut.where(~F.col("_answer") | (F.length("text") > 0)).drop("_answer")
    pairs = last.select(F.col("conv_id").alias("pair_id"), F.col("conv_id").alias("chosen_id"), (-1 - F.col("conv_id")).alias("rejected_id"))
    return own.unionByName(cut), pairs


def escaped(x: Column) -> Column:
    for plain, safe in (("\\", "\\\\"), ("<|", "<\\|"), ("|>", "|\\>")):
        x = F.replace(x, F.lit(plain), F.lit(safe))
    return x


def preference_pairs(turns: DataFrame, pairs: DataFrame) -> DataFrame:
    """pair_id, chosen_id, rejected_id, n_prefix, prompt, chosen, rejected, chosen_mask, rejected_mask.

    A mask holds spans begin-end, comma-joined, of the loss-bearing characters of its completion."""
    rows = turns.where("conv_id is not null and turn is not null").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("raw"))
    shown = F.concat(F.lit(BEGIN), escaped(F.col("role")), F.lit(MIDDLE), escaped(F.col("raw")), F.lit(END))
    loss = F.when(F.col("role") == LOSS_ROLE, F.length(escaped(F.col("raw"))) + len(END)).otherwise(0)
    rows = rows.select("conv_id", "turn", F.struct("role", "raw", shown.alias("shown"), loss.cast("bigint").alias("loss")).alias("row"))
    known = pairs.select("pair_id", "chosen_id", "rejected_id")
    sides = known.select("pair_id", "chosen_id", "rejected_id", F.posexplode(F.array("chosen_id", "rejected_id")).alias("side", "conv_id"))
    keys = ["pair_id", "chosen_id", "rejected_id"]
    gathered = lambda side: F.array_sort(F.collect_list(F.when(F.col("side") == side, F.col("row"))))
    both = rows.join(sides, "conv_id").groupBy(*keys, "turn").agg(gathered(0).alias("a"), gathered(1).alias("b"))
    same = F.transform("a", lambda x: x["shown"]) == F.transform("b", lambda x: x["shown"])
    pair = Window.partitionBy(*keys)
    over = both.select(*keys, "turn", "a", "b", F.min(F.when(~same, F.col("turn"))).over(pair).alias("first"), F.sum(F.size("a")).over(pair).alias("n_a"), F.sum(F.size("b")).over(pair).alias("n_b")).where("n_a > 0 and n_b > 0")
    common = F.col("first").isNull() | (F.col("turn") < F.col("first"))
    # a row for each turn and side; of the prefix the chosen side alone
    parts = F.filter(F.array(F.struct(F.lit(0).alias("side"), F.col("a").alias("rows")), F.struct(F.lit(1).alias("side"), F.col("b").alias("rows"))), lambda x: (F.size(x["rows"]) > 0) & (~common | (x["side"] == 0)))
    each = over.select(*keys, "turn", common.alias("common"), F.explode(parts).alias("part"))
    text = F.array_join(F.transform("part.rows", lambda x: x["shown"]), "")
    each = each.select(*keys, "turn", "common", F.col("part.side").alias("side"), F.col("part.rows").alias("rows"), text.alias("text"))
    so_far = Window.partitionBy(*keys, "common", "side").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    each = each.withColumn("at", F.sum(F.length("text").cast("bigint")).over(so_far) - F.length("text"))
    each = each.withColumn("spans", _spans(F.col("rows"), F.col("at")))
    own = lambda side, c: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("common") & (F.col("side") == side), F.struct("turn", F.col(c).alias("x"))))), lambda r: r["x"]), "")
    mask = lambda side: F.array_join(F.flatten(F.transform(F.array_sort(F.collect_list(F.when(~F.col("common") & (F.col("side") == side), F.struct("turn", "spans")))), lambda r: r["spans"])), ",")
    prompt = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("common"), F.struct("turn", F.col("text").alias("x"))))), lambda r: r["x"]), "")
    out = each.groupBy(*keys).agg(
        F.count(F.when(F.col("common"), 1)).alias("n_prefix"),
        prompt.alias("prompt"),
        own(0, "text").alias("chosen"),
        own(1, "text").alias("rejected"),
        mask(0).alias("chosen_mask"),
        mask(1).alias("rejected_mask"),
    )
    return out.select(*keys, "n_prefix", "prompt", "chosen", "rejected", "chosen_mask", "rejected_mask")


def _spans(rows: Column, at: Column) -> Column:
    """Spans of the loss-bearing characters of one turn's rows (most turns have one row)."""
    one = lambda begin, r: F.when(r["loss"] > 0, F.concat((begin + F.length(r["shown"]) - r["loss"]).cast("string"), F.lit("-"), (begin + F.length(r["shown"])).cast("string")))
    single = F.array_compact(F.array(one(at, rows[0])))
    start = F.struct(at.alias("at"), F.array().cast("array<string>").alias("spans"))
    several = F.aggregate(rows, start, lambda s, r: F.struct((s["at"] + F.length(r["shown"])).alias("at"), F.concat(s["spans"], F.array_compact(F.array(one(s["at"], r)))).alias("spans")), lambda s: s["spans"])
    return F.when(F.size(rows) == 1, single).otherwise(several)


#: The query's rows in SQL.
ORACLE = r"""
WITH o AS (SELECT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
l AS (SELECT conv_id, max(turn) AS last FROM o WHERE role = 'assistant' GROUP BY conv_id),
u AS (SELECT o.conv_id AS pair_id, 0 AS side, turn, role, text FROM o JOIN l USING (conv_id)
      UNION ALL
      SELECT o.conv_id, 1, turn, role, CASE WHEN turn = last AND role = 'assistant' THEN substr(text, 1, length(text) // 2) ELSE text END
      FROM o JOIN l USING (conv_id)
      WHERE turn <= last AND NOT (turn = last AND coalesce(role, '') = 'assistant' AND coalesce(length(text), 0) < 2)),
e AS (SELECT pair_id, side, turn, coalesce(role, '') AS role, coalesce(text, '') AS raw,
             replace(replace(replace(coalesce(role, ''), '\', '\\'), '<|', '<\|'), '|>', '|\>') AS shown_role,
             replace(replace(replace(coalesce(text, ''), '\', '\\'), '<|', '<\|'), '|>', '|\>') AS shown FROM u),
s AS (SELECT pair_id, side, turn, role, raw, '<|' || shown_role || '|>' || chr(10) || shown || '<|end|>' || chr(10) AS text,
             CASE WHEN role = 'assistant' THEN length(shown) + 8 ELSE 0 END AS loss FROM e),
c AS (SELECT pair_id FROM s GROUP BY pair_id HAVING count(DISTINCT side) = 2),
m AS (SELECT pair_id, turn, string_agg(text, '' ORDER BY role, raw) FILTER (side = 0) AS a, string_agg(text, '' ORDER BY role, raw) FILTER (side = 1) AS b,
             count(*) FILTER (side = 0) AS na, count(*) FILTER (side = 1) AS nb
      FROM s GROUP BY pair_id, turn),
f AS (SELECT pair_id, coalesce(min(turn) FILTER (a IS DISTINCT FROM b OR na <> nb), 9223372036854775807) AS first FROM m GROUP BY pair_id),
r AS (SELECT s.*, s.turn < f.first AS common,
             sum(length(text)) OVER (PARTITION BY pair_id, side, s.turn < f.first ORDER BY turn, role, raw ROWS UNBOUNDED PRECEDING) AS after
      FROM s JOIN f USING (pair_id) JOIN c USING (pair_id))
SELECT pair_id, pair_id AS chosen_id, -1 - pair_id AS rejected_id,
       CAST(count(DISTINCT turn) FILTER (common) AS BIGINT) AS n_prefix,
       coalesce(string_agg(text, '' ORDER BY turn, role, raw) FILTER (common AND side = 0), '') AS prompt,
       coalesce(string_agg(text, '' ORDER BY turn, role, raw) FILTER (NOT common AND side = 0), '') AS chosen,
       coalesce(string_agg(text, '' ORDER BY turn, role, raw) FILTER (NOT common AND side = 1), '') AS rejected,
       coalesce(string_agg((after - loss)::BIGINT || '-' || after::BIGINT, ',' ORDER BY turn, role, raw) FILTER (NOT common AND side = 0 AND loss > 0), '') AS chosen_mask,
       coalesce(string_agg((after - loss)::BIGINT || '-' || after::BIGINT, ',' ORDER BY turn, role, raw) FILTER (NOT common AND side = 1 AND loss > 0), '') AS rejected_mask
FROM r GROUP BY pair_id
"""
