"""Writing tables, verifying what was written, compacting and clustering it."""

from __future__ import annotations

import importlib.util
import time
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave import presets
from tallyweave.functions.columns import first_present, quoted
from tallyweave.operators.layout import clustered
from tallyweave.operators.placement import SALT
from tallyweave.operators.reports import as_json
from tallyweave.sources.tables import file_sizes, scan_as
from tallyweave.sources.workspace import new_path

TARGET_FILE_MB = 128
# ends of the names of a table that is being written, and of one that is being replaced
FRESH, OLD = ".new-", ".old-"
WRITE_SCHEMA = (
    "table_name string, path string, success boolean, record_count long, column_count int, "
    "partition_column string, integrity_check boolean, layout_applied boolean, processing_time_seconds double"
)


def write_table(df: DataFrame, path: str, partition: str | None = None, fmt: str = "parquet") -> None:
    """Overwrite the table, partitioned by a column if the table has it.

    Rows are first brought together by the partition value and spread within it, so a
    value makes few files even if it holds a large share of the rows. The table that was there
    stays until the new one is whole, and may be read to make it.
    """
    partitioned = partition in df.columns
    _write(df.hint("rebalance", partition) if partitioned else df, path, partition, fmt)


def _write(placed: DataFrame, path: str, partition: str | None = None, fmt: str = "parquet") -> None:
    spark = placed.sparkSession
    if fmt == "delta":
        w = placed.write.mode("overwrite").option("overwriteSchema", True)
        (w.partitionBy(partition) if partition in placed.columns else w).format(fmt).save(path)
        return
    recovered(spark, path)
    fresh = f"{path}{FRESH}{uuid.uuid4().hex}"
    w = placed.write.option("compression", "snappy")
    try:
        (w.partitionBy(partition) if partition in placed.columns else w).format(fmt).save(fresh)
    except Exception:
        _delete(spark, fresh)
        raise
    published(spark, fresh, path)


def _hadoop(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def _delete(spark: SparkSession, path: str) -> None:
    place, files = _hadoop(spark, path)
    files.delete(place, True)


def published(spark: SparkSession, fresh: str, path: str) -> None:
    """Put a written table in the place of another by renames; the other goes last.

    A crash between the two renames leaves both tables whole under names of their own;
    ``recovered`` then puts the old one back.
    """
    new, files = _hadoop(spark, fresh)
    place, _ = _hadoop(spark, path)
    old, _ = _hadoop(spark, f"{path}{OLD}{uuid.uuid4().hex}")
    had = files.exists(place)
    if had and not files.rename(place, old):
        raise OSError(f"cannot move the table at {path}")
    if not files.rename(new, place):
        if had:
            files.rename(old, place)
        raise OSError(f"cannot move the new table to {path}")
    if had:
        files.delete(old, True)


def recovered(spark: SparkSession, path: str) -> bool:
    """Put back the table that a crashed overwrite had moved aside, if there is none at the path."""
    place, files = _hadoop(spark, path)
    if files.exists(place):
        return False
    aside = files.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{path}{OLD}*")) or []
    return bool(aside) and files.rename(aside[0].getPath(), place)


def footer_rows(spark: SparkSession, path: str) -> int:
    """Rows of a Parquet table as the footers of its files state them; a file without a footer fails.

    Tasks read footers alone: Spark pushes the count into its Parquet scan in a session of its own,
    which leaves the caller's settings as they are. A table without files has no rows.
    """
    session = spark.newSession()
    session.conf.set("spark.sql.sources.useV1SourceList", "")
    session.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    written, files = _hadoop(spark, path)
    if not files.exists(written):
        raise FileNotFoundError(path)
    # the columns do not matter for a count
    return session.read.schema("x int").parquet(path).agg(F.count("*").alias("n")).first().n


def file_ranges(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per file of a scanned table: its rows and the least and greatest value of each column."""
    ends = [f(quoted(c)).alias(f"{name}_{c}") for c in columns for name, f in (("min", F.min), ("max", F.max))]
    return df.groupBy(F.col("_metadata.file_path").alias("file_path")).agg(F.count("*").alias("rows"), *ends)


def files_touched(df: DataFrame, column: str, low, high) -> DataFrame:
    """One row: files of the table, and those that may hold a value of the column from ``low`` to ``high``."""
    least, most = F.col(quoted(f"min_{column}")), F.col(quoted(f"max_{column}"))
    touched = (least <= F.lit(high)) & (most >= F.lit(low))
    return file_ranges(df, [column]).agg(
        F.count("*").alias("files"), F.coalesce(F.sum(touched.cast("long")), F.lit(0)).alias("touched")
    )


def verification(spark: SparkSession, path: str, columns: int, expected: int) -> DataFrame:
    """One row: rows by the footers of the written files, columns, and whether the rows agree."""
    found = footer_rows(spark, path)
    return spark.createDataFrame([(found, columns, found == expected)], "record_count long, column_count int, integrity_check boolean")


def table_format() -> str:
    return "delta" if importlib.util.find_spec("delta") else "parquet"


def partition_column(df: DataFrame, table: str) -> str | None:
    return first_present(df, presets.PARTITION_CANDIDATES.get(table, []))


def cluster_columns(df: DataFrame, table: str) -> list[str]:
    """Clustering columns the table has, without its partition column."""
    return [
        c
        for c in presets.CLUSTER_COLUMNS.get(table, [])
        if c in df.columns and c != partition_column(df, table)
    ]


def persist_table(df: DataFrame, table: str, path: str, files: int | None = None) -> tuple:
    """Write one wide table, verify it, and report truthfully what layout was applied.

    The plan behind the table runs once. A table with clustering columns is written to the shared
    folder first; its layout is made from that copy, by ranges of the partition column and of the
    interleaved clustering columns, and the rows of both are compared by their footers. Any other
    table is written at once. ``layout_applied`` is true if the files are clustered.
    """
    start = time.monotonic()
    spark, fmt = df.sparkSession, table_format()
    partition, layout = partition_column(df, table), cluster_columns(df, table)
    if layout:
        copy = new_path(spark, "staged")
        # four bytes of it are enough to spread rows
        df.withColumn(SALT, F.rand(17).cast("float")).write.option("compression", "zstd").parquet(copy)
        staged = spark.read.parquet(copy)
        rows = footer_rows(spark, copy)
        _write(clustered(staged, layout, files, first=[partition] if partition else []), path, partition, fmt)
        _delete(spark, copy)
    else:
        write_table(df, path, partition, fmt)
        rows = None
    found = footer_rows(spark, path) if fmt == "parquet" else spark.read.format(fmt).load(path).count()
    return (
        table,
        path,
        True,
        found,
        len(df.columns),
        partition,
        rows is None or rows == found,
        bool(layout),
        time.monotonic() - start,
    )


def persist_tables(tables: Mapping[str, DataFrame], folder: str) -> list[tuple]:
    return [persist_table(df, name, f"{folder}/{name}.parquet") for name, df in tables.items()]


def compacted(spark: SparkSession, source: str, path: str, target_mb: int = TARGET_FILE_MB) -> DataFrame:
    """Rewrite a table of many small files as files of about ``target_mb``.

    The scan packs small files into tasks, so no shuffle is needed.
    """
    df = spark.read.parquet(source)
    size = file_sizes(df).agg(F.coalesce(F.sum("file_size"), F.lit(0)).alias("b")).first().b
    files = max(1, -(-size // (target_mb * 1024 * 1024)))
    _write(df.coalesce(files), path)
    return scan_as(spark, path, df.schema)


def write_clustered(df: DataFrame, columns: list[str], path: str, files: int | None = None) -> DataFrame:
    """Write the table clustered on several columns and read it back."""
    _write(clustered(df, columns, files), path)
    return scan_as(df.sparkSession, path, df.schema)


def write_json_report(metrics: DataFrame, path: str) -> None:
    as_json(metrics).write.mode("overwrite").text(path)


def write_text_report(lines: DataFrame, path: str) -> None:
    lines.write.mode("overwrite").text(path)
