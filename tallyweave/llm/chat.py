"""Chat formatting: snapshots of conversations that longer ones continue are dropped, the rest is rendered."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _ordered(turns: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), role and text of every different turn, and two hashes of the conversation up to it.

    The hashes roll: each turn, hashed with its position, is added to what stands before it.
    """
    rows = turns.where(F.col("conv_id").isNotNull()).select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    turn = ["turn", "role", "text"]
    repeated = reduce(and_, [F.col(c).eqNullSafe(F.col(f"before.{c}")) for c in turn])
    # column by column: the lag of a struct would have every text shuffled twice
    rows = rows.withColumn("before", F.struct(*[F.lag(c).over(order).alias(c) for c in turn])).where(~repeated).drop("before")
    return rows.withColumn("pos", F.row_number().over(order)).select(
        "conv_id",
        "pos",
        "role",
        "text",
        F.bit_xor(F.xxhash64("pos", "role", "text")).over(so_far).alias("x"),
        F.bit_xor(F.xxhash64("text", "role", "pos")).over(so_far).alias("y"),
        F.lead("pos").over(order).isNull().alias("last"),
    )


def maximal_conversations(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns and rendered text of every conversation that no longer one begins with.

    A rolling hash over (position, role, text) stands for every turn prefix; conversations whose whole hash
    is a proper prefix of another are removed by an anti-join, and of equal conversations the
    smallest conv_id stays. Prefix hashes are made distinct before they meet, so a first turn
    that very many conversations share is one row. Turns are ordered by turn (null first), then role and text;
    repeated rows count once; a null role or text is empty; rows without a conv_id are left out; columns
    of other names play no part. No rows give no rows. Turns stay rows, sorted by conversation and hashed
    as they stream past, in work linear in their number; only those of a conversation that is kept meet
    in one row, its rendering.
    """
    ordered = _ordered(turns)
    prefix = ["pos", "x", "y"]
    begun = ordered.where(~F.col("last")).select(prefix).distinct()
    whole = ordered.where("last").groupBy(prefix).agg(F.min("conv_id").alias("conv_id"))
    kept = ordered.join(whole.join(begun, prefix, "left_anti").select("conv_id"), "conv_id", "left_semi")
    said = F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n"), F.col("text"), F.lit("\n"))
    gathered = F.array_sort(F.collect_list(F.struct("pos", said.alias("said"))))
    return kept.groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.concat_ws("", gathered["said"]).alias("rendered"))


ORACLE_SQL = """
WITH said AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL
), rolled AS (
  SELECT conv_id,
    string_agg(length(role) || ':' || role || length(text) || ':' || text, '')
      OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS prefix,
    string_agg('<|' || role || '|>' || chr(10) || text || chr(10), '')
      OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS rendered,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS n,
    count(*) OVER (PARTITION BY conv_id) AS total
  FROM said
)
SELECT min(conv_id) AS conv_id, any_value(total) AS n_turns, any_value(rendered) AS rendered
FROM rolled WHERE n = total AND prefix NOT IN (SELECT prefix FROM rolled WHERE n < total)
GROUP BY prefix
"""
