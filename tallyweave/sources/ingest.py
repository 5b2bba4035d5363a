"""Control-table-driven ingestion of delimited files."""

from __future__ import annotations

import time

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Row, SparkSession

from tallyweave.operators.reports import INGESTION_LOG_SCHEMA
from tallyweave.sources.sinks import verification, write_table
from tallyweave.sources.tables import folder_exists, path_size_mb
from tallyweave.sources.text import active_control_rows, breaks_lines_in_quotes, scan_delimited


def ingest_file(spark: SparkSession, entry: Row) -> tuple:
    """Read one delimited file, write it as a table, verify it; the result is a log row."""
    start = time.monotonic()
    source = f"{entry.path_origen}/{entry.nombre_archivo}"
    destination = f"{entry.path_destino}/{entry.nombre_tabla}.parquet"

    def failed(message: str) -> tuple:
        return (entry.id_ingesta, entry.nombre_tabla, False, 0, 0, 0.0, time.monotonic() - start, 0.0, False, False, message)

    try:
        if not folder_exists(spark, source):
            return failed(f"Archivo no encontrado: {source}")
        # only a file with line breaks in quotes has to be read in one task
        df = scan_delimited(spark, source, entry.delimitador, multiline=breaks_lines_in_quotes(spark, source))
        partitioned = entry.columna_particion in df.columns
        rows = df.count()
        write_table(df, destination, entry.columna_particion)
        check = verification(spark, destination, len(df.columns), rows).first()
        size = path_size_mb(spark, source)
    except (PySparkException, Py4JJavaError) as e:
        return failed(str(e).split("\n")[0])
    seconds = time.monotonic() - start
    return (
        entry.id_ingesta,
        entry.nombre_tabla,
        check.integrity_check,
        rows,
        len(df.columns),
        size,
        seconds,
        rows / seconds if seconds else 0.0,
        partitioned,
        check.integrity_check,
        None if check.integrity_check else "row count differs after writing",
    )


def ingest_all(spark: SparkSession, control: DataFrame) -> DataFrame:
    """Run the active entries of a control table in order; one failure stops nothing.

    Control rows are streamed to the driver, each starting one distributed job. No active
    row gives an empty log.
    """
    log = [ingest_file(spark, entry) for entry in active_control_rows(control).toLocalIterator()]
    return spark.createDataFrame(log, INGESTION_LOG_SCHEMA)
