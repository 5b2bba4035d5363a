"""Reading table files: single tables, named sets, folders of tables."""

from __future__ import annotations

import logging
import time
from collections.abc import Iterable, Mapping

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallyweave import presets
from tallyweave.functions.columns import quoted
from tallyweave.operators.quality import structure_check

log = logging.getLogger(__name__)

LOAD_SCHEMA = (
    "table_name string, success boolean, rows long, columns int, size_mb double, load_seconds double, "
    "compliance_score double, missing_columns string, error_message string"
)


def scan(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.format(fmt).load(path)


def scan_as(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Read a written table with its schema: partition columns keep zeros on the left and their place."""
    return spark.read.schema(schema).parquet(path).select(*[quoted(c) for c in schema.names])


def file_sizes(df: DataFrame) -> DataFrame:
    """One row per input file with its bytes. Only file metadata columns are read."""
    return df.select("_metadata.file_path", "_metadata.file_size").distinct()


def input_size(df: DataFrame) -> DataFrame:
    """One row: files and MB of the files a scan reads."""
    return file_sizes(df).agg(
        F.count("*").alias("files"), (F.coalesce(F.sum("file_size"), F.lit(0)) / F.lit(1024 * 1024)).alias("size_mb")
    )


def path_size_mb(spark: SparkSession, path: str) -> float:
    """MB of a file or folder as the file system sums them, without reading any; 0.0 if it is missing or empty."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    return files.getContentSummary(place).getLength() / (1024 * 1024) if files.exists(place) else 0.0


def load_table(
    spark: SparkSession, path: str, name: str, fmt: str = "parquet"
) -> tuple[DataFrame | None, tuple]:
    """A table and its load record. A missing or unreadable file is a failed record."""
    start = time.monotonic()
    try:
        df = scan(spark, path, fmt)
        schema = presets.SCHEMAS.get(name)
        if schema:
            check = structure_check(df, schema).first()
            rows, score = check.rows, check.compliance_score
            missing = ",".join(x for x in (check.missing_keys, check.missing_required) if x)
        else:
            rows, score, missing = df.count(), 100.0, ""
        size = path_size_mb(spark, path)
    except (PySparkException, Py4JJavaError) as e:
        seconds = time.monotonic() - start
        return None, (name, False, 0, 0, 0.0, seconds, 0.0, "", str(e).split("\n")[0])
    seconds = time.monotonic() - start
    return df, (name, True, rows, len(df.columns), size, seconds, score, missing, None)


def dictionary_key(file_name: str) -> str:
    """Table key of a dictionary file; unknown files become ``dict_`` and the lower-case name."""
    stem = file_name.removesuffix(".parquet")
    return presets.DICTIONARY_FILES.get(stem, f"{presets.DICTIONARY_PREFIX}{stem.lower()}")


def table_key(file_name: str, data_tables: Iterable[str] = presets.DATA_TABLES) -> str:
    stem = file_name.removesuffix(".parquet")
    return stem if stem in data_tables else dictionary_key(stem)


def folder_exists(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def load_tables(
    spark: SparkSession,
    folder: str,
    data_tables: Iterable[str] = presets.DATA_TABLES,
    dictionaries: Iterable[str] = tuple(presets.DICTIONARY_FILES),
    required: Iterable[str] = presets.REQUIRED_TABLES,
) -> tuple[dict[str, DataFrame], list[tuple]]:
    """The named tables of a folder and their load records.

    A table that fails is logged and left out; a missing required table is an error.
    """
    if not folder_exists(spark, folder):
        raise FileNotFoundError(folder)
    tables, records = {}, []
    for file_name in [*data_tables, *dictionaries]:
        key = file_name if file_name in data_tables else dictionary_key(file_name)
        df, record = load_table(spark, f"{folder}/{file_name}.parquet", key)
        records.append(record)
        if df is None:
            log.warning("table %s not loaded: %s", key, record[-1])
        else:
            tables[key] = df
    missing = [t for t in required if t not in tables]
    if missing:
        raise ValueError(f"required tables not loaded: {', '.join(missing)}")
    return tables, records


def separated(tables: Mapping[str, DataFrame]) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """Data tables and dictionaries, told apart by the key prefix."""
    is_dict = {k: k.startswith(presets.DICTIONARY_PREFIX) for k in tables}
    return (
        {k: v for k, v in tables.items() if not is_dict[k]},
        {k: v for k, v in tables.items() if is_dict[k]},
    )


def discovered(spark: SparkSession, folder: str, suffix: str = ".parquet") -> dict[str, str]:
    """Table name -> path of every table folder or file with the suffix in a layer folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/*{suffix}")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []
    paths = sorted(str(s.getPath().toString()) for s in found)
    return {p.rsplit("/", 1)[-1].removesuffix(suffix): p for p in paths}
