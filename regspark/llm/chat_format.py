"""Preference formatting: one shared prompt, two masked completions; DataFrame functions only.

A chosen and a rejected conversation are compared turn by turn (role and text); the turns
before the first difference are rendered once as the prompt, the rest of either side as its
completion.  A mask lists the character spans [start, end, start, end, ...] of a completion
that the loss covers: the texts of assistant turns with their end marks.

Defined cases: turns are ordered by (turn, role, text), nulls first; a null text is empty, a
null role is ``unknown``; a side without turns is empty, so the other side is one completion;
equal sides have the whole conversation as prompt and empty completions; repeated turn rows
are turns of their own; an empty table gives an empty result.  A pair with a null id is a
pair like any other.  Markers written inside a text are broken up (``<|`` becomes ``< |``), so they
cannot pass for turn borders.  Columns other than id, turn, role and text are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

END = "<|end|>\n"
#: a window of the search for the next id sees 2 to this power ids at most
NODE_BITS = 13


def turn_text(turn: Column) -> Column:
    return F.concat(F.replace(F.coalesce(turn["text"], F.lit("")), F.lit("<|"), F.lit("< |")), F.lit(END))


def turn_head(turn: Column) -> Column:
    return F.concat(F.lit("<|"), F.coalesce(turn["role"], F.lit("unknown")), F.lit("|>\n"))


def rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(turn_head(t), turn_text(t))), "")


def loss_spans(turns: Column) -> Column:
    """Start and end of every assistant text in ``rendered(turns)``."""
    none = F.array().cast("array<bigint>")
    zero = F.struct(F.lit(0).cast("long").alias("at"), none.alias("spans"))

    def step(acc, t):
        start = acc["at"] + F.length(turn_head(t))
        end = start + F.length(turn_text(t))
        own = F.when(t["role"] == "assistant", F.array(start.cast("long"), end.cast("long"))).otherwise(none)
        return F.struct(end.cast("long").alias("at"), F.concat(acc["spans"], own).alias("spans"))
    return F.aggregate(turns, zero, step, lambda acc: acc["spans"])


def conversations_of(turns: DataFrame, side: str) -> DataFrame:
    """One row per ``pair_id`` with its ordered turns."""
    row = F.struct(F.col("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    return turns.groupBy("pair_id").agg(F.array_sort(F.collect_list(row)).alias(side))


def preference_format(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """Both sides: (pair_id, turn, role, text).  One row per pair: ``n_prompt_turns``, ``prompt``,
    ``chosen``, ``rejected`` and their masks."""
    a, b = conversations_of(chosen, "a"), conversations_of(rejected, "b")
    both = a.join(b.withColumnRenamed("pair_id", "other_id"), F.col("pair_id").eqNullSafe(F.col("other_id")), "full_outer")
    none = F.array().cast(a.schema["a"].dataType)
    both = both.select(F.coalesce("pair_id", "other_id").alias("pair_id"), F.coalesce("a", none).alias("a"),
                       F.coalesce("b", none).alias("b"))
    same = F.zip_with("a", "b", lambda x, y: x["role"].eqNullSafe(y["role"]) & x["text"].eqNullSafe(y["text"]))
    first = F.array_position(same, False)
    shorter = F.least(F.size("a"), F.size("b"))
    common = F.when(first == 0, shorter).otherwise(F.least(first.cast("int") - 1, shorter))
    cut = both.withColumn("n", common)
    rest = lambda side: F.slice(side, F.col("n") + 1, F.size(side))
    cut = cut.select("pair_id", "n", F.slice("a", F.lit(1), F.col("n")).alias("shared"),
                     rest("a").alias("a"), rest("b").alias("b"))
    return cut.select("pair_id", F.col("n").cast("long").alias("n_prompt_turns"), rendered(F.col("shared")).alias("prompt"),
                      rendered(F.col("a")).alias("chosen"), rendered(F.col("b")).alias("rejected"),
                      loss_spans(F.col("a")).alias("chosen_mask"), loss_spans(F.col("b")).alias("rejected_mask"))


def next_ids(ids: DataFrame) -> DataFrame:
    """(id, next) of distinct non-null longs ``id``: the next greater one, null for the greatest.

    Ids are dealt to nodes of ``2 ** NODE_BITS`` consecutive ones, nodes to nodes of nodes, and so
    on: a window sees the children of one node only.  The last child's next id is the first
    one of the next node."""
    steps = -(-64 // NODE_BITS)

    def level(nodes: DataFrame, step: int) -> DataFrame:
        # nodes: (node, first); -> (node, next)
        up = nodes.withColumn("up", F.shiftright("node", NODE_BITS) if step < steps else F.lit(0).cast("long"))
        inside = up.withColumn("own", F.lead("first").over(Window.partitionBy("up").orderBy("node")))
        if step == steps:
            return inside.select("node", F.col("own").alias("next"))
        above = level(up.groupBy(F.col("up").alias("node")).agg(F.min("first").alias("first")), step + 1)
        return (inside.join(above.withColumnRenamed("node", "up"), "up")
                .select("node", F.coalesce("own", "next").alias("next")))
    return level(ids.select(F.col("id").alias("node"), F.col("id").alias("first")), 0).withColumnRenamed("node", "id")


def preference_sides(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chosen: every conversation.  Rejected: the same, but its last assistant turn is that of the
    next conversation by id that has one (no reply if there is none).  Turns after the last
    assistant turn are in both; no mask covers them."""
    base = turns.select("conv_id", "turn", F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    last = base.where("role = 'assistant'").groupBy("conv_id").agg(F.max("turn").alias("last"))
    reply = (base.join(last, "conv_id").where("turn = last and role = 'assistant'")
             .groupBy("conv_id").agg(F.first("last").alias("last"), F.min("text").alias("text")))
    follow = next_ids(reply.select(F.col("conv_id").cast("long").alias("id")))
    other = (reply.select("conv_id", "last").join(follow, F.col("conv_id") == F.col("id"))
             .join(reply.select(F.col("conv_id").alias("next"), "text"), "next")
             .select("conv_id", F.col("last").alias("turn"), F.lit("assistant").alias("role"), "text"))
    chosen = base.withColumnRenamed("conv_id", "pair_id")
    replaced = F.coalesce((F.col("turn") == F.col("last")) & (F.col("role") == "assistant"), F.lit(False))
    before = base.join(last, "conv_id", "left").where(~replaced).select("conv_id", "turn", "role", "text")
    return chosen, before.unionByName(other).withColumnRenamed("conv_id", "pair_id")


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One preference pair for every conversation."""
    turns = spark.read.parquet(f"{sf_dir.rstrip('/')}/conversations.parquet")
    return preference_format(*preference_sides(turns)).withColumnRenamed("pair_id", "conv_id")


OP10_SQL = r"""
WITH last AS (SELECT conv_id, max(turn) AS last FROM conversations WHERE role = 'assistant' GROUP BY conv_id),
kept AS (SELECT c.*, l.last FROM conversations c LEFT JOIN last l ON c.conv_id = l.conv_id),
reply AS (SELECT c.conv_id, any_value(l.last) AS last, min(c.text) AS text
          FROM conversations c JOIN last l ON c.conv_id = l.conv_id AND c.turn = l.last
          WHERE c.role = 'assistant' GROUP BY c.conv_id),
follow AS (SELECT conv_id, last, lead(conv_id) OVER (ORDER BY conv_id) AS next FROM reply),
r AS (
  SELECT conv_id, turn, role, text FROM kept WHERE NOT coalesce(turn = last AND role = 'assistant', false)
  UNION ALL SELECT f.conv_id, f.last, 'assistant', y.text FROM follow f JOIN reply y ON y.conv_id = f.next),
a AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS p FROM kept),
b AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS p FROM r),
diff AS (
  SELECT coalesce(a.conv_id, b.conv_id) AS conv_id,
         min(CASE WHEN a.p IS NULL OR b.p IS NULL OR a.role IS DISTINCT FROM b.role OR a.text IS DISTINCT FROM b.text
             THEN coalesce(a.p, b.p) END) AS first, max(coalesce(a.p, b.p)) AS most
  FROM a FULL JOIN b ON a.conv_id = b.conv_id AND a.p = b.p GROUP BY 1),
n AS (SELECT conv_id, coalesce(first - 1, most) AS n FROM diff),
parts AS (
  SELECT 'a' AS side, a.conv_id, p, p <= n.n AS shared, role, '<|' || role || '|>' || chr(10) AS head,
         replace(coalesce(text, ''), '<|', '< |') || '<|end|>' || chr(10) AS body FROM a JOIN n ON a.conv_id = n.conv_id
  UNION ALL
  SELECT 'b', b.conv_id, p, p <= n.n, role, '<|' || role || '|>' || chr(10),
         replace(coalesce(text, ''), '<|', '< |') || '<|end|>' || chr(10) FROM b JOIN n ON b.conv_id = n.conv_id),
spans AS (
  SELECT *, sum(length(head) + length(body)) OVER (PARTITION BY side, conv_id, shared ORDER BY p) AS e FROM parts),
texts AS (
  SELECT conv_id, coalesce(string_agg(head || body, '' ORDER BY p) FILTER (side = 'a' AND shared), '') AS prompt,
         coalesce(string_agg(head || body, '' ORDER BY p) FILTER (side = 'a' AND NOT shared), '') AS chosen,
         coalesce(string_agg(head || body, '' ORDER BY p) FILTER (side = 'b' AND NOT shared), '') AS rejected,
         coalesce(flatten(list([(e - length(body))::BIGINT, e::BIGINT] ORDER BY p) FILTER (side = 'a' AND NOT shared AND role = 'assistant')), []::BIGINT[]) AS chosen_mask,
         coalesce(flatten(list([(e - length(body))::BIGINT, e::BIGINT] ORDER BY p) FILTER (side = 'b' AND NOT shared AND role = 'assistant')), []::BIGINT[]) AS rejected_mask
  FROM spans GROUP BY conv_id)
SELECT n.conv_id, n.n AS n_prompt_turns, t.prompt, t.chosen, t.rejected, t.chosen_mask, t.rejected_mask
FROM n JOIN texts t ON n.conv_id = t.conv_id
"""
