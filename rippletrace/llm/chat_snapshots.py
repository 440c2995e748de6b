"""Cumulative-snapshot collapse of logged conversations (DataFrame operations only).

A chat service often logs the whole conversation after each turn, so most logs are prefixes of longer ones. Each turn
gets the rolling hash of all turns up to it: the running exclusive-or of two position-salted 64-bit hashes (128 bits).
A conversation whose full hash is the prefix hash of a longer one goes (anti-join); equal ones leave the smallest id.
What stays is rendered with role markers.

Defined results: turns without a conv_id belong to no conversation and are left out. Turns are ordered by turn (nulls
first), role and text; null roles and texts are empty; a turn row that is repeated whole counts once. Marker strings
inside a text get a space after ``<``, so that a text can't forge a turn. A table without rows gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import durable


def _turns(conversations: DataFrame) -> DataFrame:
    df = conversations.where("conv_id is not null").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = W.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    row = F.struct("turn", "role", "text")
    df = df.withColumn("again", F.coalesce(row == F.lag(row).over(order), F.lit(False)) & (F.row_number().over(order) > 1)).where("not again").drop("again")
    return df.withColumn("pos", F.row_number().over(order))


def prefix_hashes(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), p1 and p2 (hash of the turns up to pos), last (no turn follows)."""
    df = _turns(conversations)
    order = W.partitionBy("conv_id").orderBy("pos")
    upto = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    df = df.select("conv_id", "pos", F.xxhash64("pos", "role", "text").alias("a"), F.xxhash64(F.lit("second"), "text", "pos", "role").alias("b"))
    return df.select(
        "conv_id", "pos",
        F.bit_xor("a").over(upto).alias("p1"), F.bit_xor("b").over(upto).alias("p2"),
        F.lead("pos").over(order).isNull().alias("last"),
    )


def maximal_conversations(conversations: DataFrame) -> DataFrame:
    """conv_id of each conversation that stays, n_turns and n_copies (equal conversations, itself included)."""
    h = durable(prefix_hashes(conversations))
    key = ["pos", "p1", "p2"]
    full = h.where("last").groupBy(*key).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    begun = h.where("not last").select(*key).distinct()  # partial aggregation first: a hot first turn is one row a task
    return full.join(begun, key, "left_anti").select("conv_id", F.col("pos").cast("long").alias("n_turns"), "n_copies")


def rendered(turn: Column) -> Column:
    plain = F.regexp_replace(F.concat(turn["role"], F.lit("\n"), turn["text"]), r"<\|", "< |")
    return F.concat(F.lit("<|im_start|>"), plain, F.lit("<|im_end|>"))


def collapse_and_render(conversations: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_copies, chat (the rendered text) of the maximal conversations."""
    kept = maximal_conversations(conversations)
    turns = conversations.where("conv_id is not null").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = F.array_distinct(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))))
    chat = F.array_join(F.transform("turns", rendered), "\n")
    whole = turns.join(kept.select("conv_id"), "conv_id", "left_semi").groupBy("conv_id").agg(ordered.alias("turns"))
    return whole.join(kept, "conv_id").select("conv_id", "n_turns", "n_copies", chat.alias("chat"))


def op7_chat_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collapse_and_render(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


OP7_SQL = r"""
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos, count(*) OVER (PARTITION BY conv_id) AS n FROM t),
p AS (SELECT conv_id, pos, n, string_agg(length(role) || ':' || role || length(text) || ':' || text, '') OVER (PARTITION BY conv_id ORDER BY pos) AS pre FROM r),
f AS (SELECT pos, pre, min(conv_id) AS conv_id, count(*) AS n_copies FROM p WHERE pos = n GROUP BY pos, pre),
k AS (SELECT * FROM f WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.pos < p.n AND p.pos = f.pos AND p.pre = f.pre))
SELECT k.conv_id, k.pos::BIGINT AS n_turns, k.n_copies,
       string_agg('<|im_start|>' || replace(r.role || chr(10) || r.text, '<|', '< |') || '<|im_end|>', chr(10) ORDER BY r.pos) AS chat
FROM k JOIN r USING (conv_id) GROUP BY k.conv_id, k.pos, k.n_copies
"""
