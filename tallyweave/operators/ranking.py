"""Global rank, row number and ntile without sending all rows to one task."""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.functions.columns import quoted
from tallyweave.operators.placement import range_placed
from tallyweave.sources.workspace import stored

_LOCAL_POSITION = (1 << 33) - 1


def dense_rank_of_sizes(sizes: DataFrame, size: str, name: str) -> DataFrame:
    """Dense rank of groups by descending size.

    Only the distinct sizes are ranked in one task. Distinct sizes of groups over N rows
    number at most sqrt(2 N), whatever the number of groups.
    """
    distinct = sizes.select(F.col(quoted(size)).alias("__size")).distinct()
    ranks = distinct.withColumn(name, F.dense_rank().over(Window.orderBy(F.desc("__size"))))
    return sizes.join(ranks, sizes[quoted(size)] == ranks["__size"]).drop("__size")


def with_global_index(
    df: DataFrame, keys: list[str], index: str, total: str, descending: Collection[str] = ()
) -> DataFrame:
    """Number the rows 1..n in the order of the keys and add n.

    Rows are range-partitioned and sorted by the whole order, then written once, so the
    partition a row belongs to is fixed. One offset per partition is added on reading.
    """
    placed = range_placed(df, keys, descending).withColumns(
        {
            "__part": F.spark_partition_id(),
            "__pos": F.monotonically_increasing_id().bitwiseAND(F.lit(_LOCAL_POSITION)),
        }
    )
    fixed = stored(placed)
    # one row per partition
    counts = fixed.groupBy("__part").agg(F.count("*").alias("__rows"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        F.col("__part").alias("__p"),
        F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__before"),
        F.sum("__rows").over(Window.partitionBy()).alias(total),
    )
    # no more rows than shuffle partitions, so always small enough to broadcast
    return fixed.join(F.broadcast(offsets), fixed["__part"] == offsets["__p"]).select(
        *[quoted(c) for c in df.columns],
        (F.col("__before") + F.col("__pos") + F.lit(1)).alias(index),
        total,
    )


def ntile_of(index: Column, total: Column, tiles: int) -> Column:
    """Tile of a 1-based row index: the first ``total % tiles`` tiles have one row more."""
    small = F.floor(total / F.lit(tiles))
    longer = total % F.lit(tiles)
    edge = longer * (small + 1)
    in_longer = F.ceil(index / (small + 1))
    in_shorter = longer + F.ceil((index - edge) / F.greatest(small, F.lit(1)))
    return F.when(index <= edge, in_longer).otherwise(in_shorter).cast("int")
