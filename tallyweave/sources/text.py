"""Delimited text and the ingestion control table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave import presets
from tallyweave.functions.expressions import as_int


def scan_delimited(spark: SparkSession, path: str, delimiter: str = ",", multiline: bool = False) -> DataFrame:
    """Header, UTF-8, double quotes, every column text.

    ``multiline`` reads a file in one task, so it is only for files with line breaks in
    quoted values.
    """
    return (
        spark.read.option("header", True)
        .option("sep", delimiter)
        .option("encoding", "UTF-8")
        .option("quote", '"')
        .option("escape", '"')
        .option("multiLine", multiline)
        .option("inferSchema", False)
        .csv(path)
    )


def breaks_lines_in_quotes(spark: SparkSession, path: str) -> bool:
    """Whether some line of the files holds an odd number of quotes, so that a quoted value goes on in the next."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return not spark.read.text(path).where(quotes % 2 == 1).isEmpty()


def active_control_rows(control: DataFrame) -> DataFrame:
    """Active rows of a control table, blanks filled, in order of group and position."""
    missing = [c for c in presets.CONTROL_REQUIRED if c not in control.columns]
    if missing:
        raise ValueError(f"control table lacks columns: {', '.join(missing)}")

    def text(name: str):
        return F.nullif(F.trim(F.col(name)), F.lit("")) if name in control.columns else F.lit(None).cast("string")

    defaults = presets.CONTROL_DEFAULTS
    return (
        control.filter(as_int("estado") == 1)
        .select(
            *[F.col(c).cast("string").alias(c) for c in presets.CONTROL_REQUIRED if c != "estado"],
            F.coalesce(
                F.nullif(F.col("delimitador"), F.lit("")) if "delimitador" in control.columns else F.lit(None),
                F.lit(defaults["delimitador"]),
            ).alias("delimitador"),
            text("columna_particion").alias("columna_particion"),
            F.coalesce(text("grupo_ingesta"), F.lit(defaults["grupo_ingesta"])).alias("grupo_ingesta"),
            F.coalesce(as_int(text("orden_grupo")), F.lit(defaults["orden_grupo"])).alias("orden_grupo"),
        )
        .orderBy("grupo_ingesta", "orden_grupo")
    )


def load_control(spark: SparkSession, path: str) -> DataFrame:
    return active_control_rows(scan_delimited(spark, path))


def control_summary(control: DataFrame) -> DataFrame:
    """Per group: entries and the first and last entry in order.

    The entries themselves are the rows of the control table, already in order.
    """
    place = F.struct("orden_grupo", "nombre_archivo", "nombre_tabla")

    def entry(c):
        return F.concat_ws(
            " ", F.concat(c["orden_grupo"].cast("string"), F.lit(".")), c["nombre_archivo"], F.lit("->"), c["nombre_tabla"]
        )

    return (
        control.groupBy("grupo_ingesta")
        .agg(F.count("*").alias("entries"), F.min(place).alias("__a"), F.max(place).alias("__z"))
        .select("grupo_ingesta", "entries", entry(F.col("__a")).alias("first_entry"), entry(F.col("__z")).alias("last_entry"))
    )
