"""Small sides of a join, with their size checked before anything is broadcast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from tallyweave.functions.expressions import cell_bytes

MAX_ROWS = 50_000
MAX_BYTES = 64 * 1024 * 1024
BYTES_PER_CELL = 50
MB = 1024 * 1024


def proven_small(df: DataFrame, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> bool:
    """Whether a distributed aggregate finds at most ``max_rows`` rows of ``max_bytes`` together."""
    size = df.agg(F.count("*").alias("n"), _bytes(df).alias("b")).first()
    return size.n <= max_rows and (size.b or 0) <= max_bytes


def small_rows(df: DataFrame, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> list[Row] | None:
    """The rows if they are proven few, else None; no more than the bound ever reaches the driver."""
    return df.collect() if proven_small(df, max_rows, max_bytes) else None


def small_copy(df: DataFrame, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> DataFrame | None:
    """The table held as literal rows if it is proven small, else None."""
    rows = small_rows(df, max_rows, max_bytes)
    return None if rows is None else df.sparkSession.createDataFrame(rows, df.schema)


def broadcast_checked(df: DataFrame, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Broadcast the table if it is proven small; otherwise leave the join to a shuffle."""
    small = small_copy(df, max_rows, max_bytes)
    return df if small is None else F.broadcast(small)


def _bytes(df: DataFrame) -> Column:
    total = F.lit(0)
    for name, dtype in df.dtypes:
        total = total + cell_bytes(name, dtype)
    return F.sum(total.cast("long"))


def size_estimate(df: DataFrame) -> DataFrame:
    """One row: rows, columns, estimated MB (50 bytes a cell) and measured MB of the cells."""
    width = len(df.columns)
    rows = F.count("*")
    return df.agg(
        rows.alias("rows"),
        F.lit(width).alias("columns"),
        (rows * F.lit(width * BYTES_PER_CELL) / F.lit(MB)).alias("estimated_mb"),
        (F.coalesce(_bytes(df), F.lit(0)) / F.lit(MB)).alias("measured_mb"),
    )


def broadcast_small(df: DataFrame, threshold_mb: float = 200.0) -> DataFrame:
    """Broadcast hint if both the estimated and the measured size stay within the threshold."""
    size = size_estimate(df).first()
    if 0 < size.estimated_mb <= threshold_mb and size.measured_mb <= threshold_mb:
        return F.broadcast(df)
    return df
