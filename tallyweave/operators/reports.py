"""Statistics over run logs. Logs are ordinary tables, one row per operation."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.functions.expressions import first_case, percent

INGESTION_LOG_SCHEMA = (
    "id_ingesta string, table_name string, success boolean, records_processed long, columns_count int, "
    "file_size_mb double, processing_time_seconds double, throughput_records_per_second double, "
    "partition_applied boolean, integrity_check boolean, error_message string"
)


def ingestion_statistics(log: DataFrame) -> DataFrame:
    """One row over all ingestions; the means and totals are over the successful ones."""
    ok = F.col("success")

    def good(c: str):
        return F.when(ok, F.col(c))

    return log.agg(
        F.count("*").alias("ingestions"),
        F.coalesce(percent(F.count_if(ok), F.count("*")), F.lit(0.0)).alias("success_rate"),
        F.coalesce(F.sum(good("records_processed")), F.lit(0)).alias("total_records_processed"),
        F.sum(good("processing_time_seconds")).alias("total_processing_time"),
        F.avg(good("throughput_records_per_second")).alias("average_throughput"),
        F.max(good("throughput_records_per_second")).alias("maximum_throughput"),
        F.min(good("throughput_records_per_second")).alias("minimum_throughput"),
        F.avg(good("file_size_mb")).alias("average_file_size_mb"),
        F.count_if(ok & F.col("partition_applied")).alias("files_with_partitioning"),
        F.avg(good("columns_count")).alias("average_columns_per_table"),
    )


def error_category(message: str = "error_message"):
    """Category of an error text; the first that applies."""
    text = F.lower(F.coalesce(F.col(message), F.lit("Error desconocido")))
    return first_case(
        [
            (text.contains("no encontrado"), "archivo_no_encontrado"),
            (text.contains("permission"), "permisos_archivo"),
            (text.contains("format") | text.contains("delimiter"), "formato_datos"),
        ],
        "error_general",
    )


def failures(log: DataFrame) -> DataFrame:
    """The failed ingestions with their error category, one row each."""
    return log.filter(~F.col("success")).withColumn("category", error_category())


def failure_categories(log: DataFrame) -> DataFrame:
    """Failures per category with the first and last id; ``failures`` lists them all."""
    return (
        failures(log)
        .groupBy("category")
        .agg(
            F.count("*").alias("failed"),
            F.min("id_ingesta").alias("first_id"),
            F.max("id_ingesta").alias("last_id"),
        )
    )


def operation_statistics(log: DataFrame) -> DataFrame:
    """Total, successes and success rate: overall, per table and per operation type."""
    table, operation = F.col("table_name"), F.col("operation_type")
    level = F.when(F.grouping("table_name") == 0, "table").when(F.grouping("operation_type") == 0, "operation")
    return log.groupingSets([[], [table], [operation]], table, operation).agg(
        level.alias("level_or_null"),
        F.count("*").alias("total_operations"),
        F.count_if("success").alias("successful_operations"),
        F.count_if(~F.col("success")).alias("failed_operations"),
        percent(F.count_if("success"), F.count("*")).alias("success_rate"),
    ).select(
        F.coalesce("level_or_null", F.lit("overall")).alias("level"),
        F.coalesce("table_name", "operation_type").alias("name"),
        "total_operations",
        "successful_operations",
        "failed_operations",
        "success_rate",
    )


def failed_operations(log: DataFrame) -> DataFrame:
    return log.filter(~F.col("success")).select("table_name", "operation_type", "source_column", "error_message")


def experiment_summary(log: DataFrame) -> DataFrame:
    """Per research question: experiments, successes and means over the successes."""

    def good(c: str):
        return F.when(F.col("success"), F.col(c))

    return (
        log.groupBy("research_question")
        .agg(
            F.count("*").alias("total_experiments"),
            F.count_if("success").alias("successful_experiments"),
            F.avg(good("auc_score")).alias("average_auc_score"),
            F.avg(good("training_time_seconds")).alias("average_training_time_seconds"),
            F.avg(good("feature_count")).alias("average_feature_count"),
        )
        .filter(F.col("successful_experiments") > 0)
    )


def run_summary(metrics: DataFrame) -> DataFrame:
    """One row over the table metrics of a run: means, totals, throughput and flags."""
    seconds = F.sum("processing_time_seconds")
    return metrics.agg(
        F.count("*").alias("tables"),
        F.sum("record_count").alias("total_records"),
        F.avg("data_quality_score").alias("average_quality_score"),
        F.avg("null_percentage").alias("average_null_percentage"),
        F.avg("duplicate_percentage").alias("average_duplicate_percentage"),
        seconds.alias("total_processing_time_seconds"),
        F.coalesce(F.try_divide(F.sum("record_count"), seconds), F.lit(0.0)).alias(
            "average_throughput_records_per_second"
        ),
        F.bool_and("success").alias("all_tables_persisted_successfully"),
        F.bool_and(F.col("data_quality_score") >= 70).alias("quality_threshold_met"),
    )


def text_summary(summary: DataFrame, labels: Mapping[str, str]) -> DataFrame:
    """The row of a summary as text lines ``label: value``."""
    lines = [F.concat(F.lit(f"{label}: "), F.col(c).cast("string")) for c, label in labels.items()]
    return summary.select(F.explode(F.array(*lines)).alias("value"))


def as_json(metrics: DataFrame) -> DataFrame:
    """Each row of a metrics table as one JSON text."""
    return metrics.select(F.to_json(F.struct("*")).alias("value"))
