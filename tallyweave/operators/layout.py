"""Partition counts and file layout of written tables."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.functions.columns import quoted
from tallyweave.functions.expressions import as_double
from tallyweave.operators.bounded import BYTES_PER_CELL, MB
from tallyweave.operators.placement import range_placed

CLUSTER_BITS = 10


def ingest_partitions(rows: int) -> int:
    """4 up to a million rows, then one per 50,000 rows between 4 and 200."""
    return max(4, min(200, rows // 50_000)) if rows > 1_000_000 else 4


def persist_partitions(rows: int) -> int:
    if rows > 5_000_000:
        return 32
    return 16 if rows > 1_000_000 else 8


def size_partitions(rows: int, columns: int, target_mb: int = 128) -> int:
    return max(1, int(rows * columns * BYTES_PER_CELL / MB / target_mb))


def repacked_for_ingest(df: DataFrame, rows: int) -> DataFrame:
    """Only lowers the number of partitions, as ``coalesce`` does.

    Above the clamp the input's own partitions are kept: folding a large table into 200
    tasks would take the parallelism away.
    """
    return df.coalesce(ingest_partitions(rows)) if rows <= 200 * 50_000 else df


def repacked_for_persist(df: DataFrame, rows: int) -> DataFrame:
    """Few files for a small table; a table past the last step keeps its partitions."""
    return df.coalesce(persist_partitions(rows)) if rows <= 10_000_000 else df


def repacked_to_size(df: DataFrame, rows: int, partitions: int, target_mb: int = 128) -> DataFrame:
    """Partitions of about ``target_mb`` by the 50-bytes-a-cell estimate."""
    wanted = size_partitions(rows, len(df.columns), target_mb)
    if wanted < partitions:
        return df.coalesce(wanted)
    return df.repartition(wanted) if wanted > partitions else df


def clustering_key(df: DataFrame, columns: list[str], bits: int = CLUSTER_BITS) -> Column:
    """Key that interleaves the bits of the columns scaled to ``2^bits`` steps.

    Numbers scale between their extremes; other columns by the bucket of their hash.
    """
    ends = df.agg(
        *[F.min(as_double(c)).alias(f"lo{i}") for i, c in enumerate(columns)],
        *[F.max(as_double(c)).alias(f"hi{i}") for i, c in enumerate(columns)],
    ).first()
    top = (1 << bits) - 1

    def step(i: int, c: str) -> Column:
        lo, hi = ends[f"lo{i}"], ends[f"hi{i}"]
        if lo is None:
            return F.pmod(F.xxhash64(quoted(c)), F.lit(top + 1))
        scaled = F.floor((as_double(c) - F.lit(lo)) / F.lit((hi - lo) or 1.0) * F.lit(top))
        return F.coalesce(scaled, F.lit(0)).cast("long")

    n = len(columns)
    parts = [
        F.shiftleft(F.shiftright(step(i, c), b).bitwiseAND(F.lit(1)), b * n + i)
        for i, c in enumerate(columns)
        for b in range(bits)
    ]
    return reduce(add, parts)


def clustered(df: DataFrame, columns: list[str], files: int | None = None, first: list[str] = ()) -> DataFrame:
    """Rows near in all columns end near each other: range partitions of the interleaved key.

    ``first`` names columns that come before it, such as the one the table is partitioned by. The
    columns themselves and a random number of each row end the order, so that rows with one
    key still spread over partitions. Wide rows of few values a column travel as short ones.
    """
    keyed = df.withColumn("__key", clustering_key(df, columns))
    return range_placed(keyed, list(dict.fromkeys([*first, "__key", *columns])), partitions=files, fold=True).drop("__key")
