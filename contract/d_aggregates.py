"""Counts, distinct values and statistics over run logs.

Log tables are one row per order or line, so the statistics work over the whole tables.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from contract.census import sub, view
from contract.registry import query, table
from tallyweave.functions.expressions import as_double
from tallyweave.operators import models, reports
from tallyweave.operators.catalog import feature_usage, features_by_type, question_coverage
from tallyweave.operators.features import table_features


@query("d01_row_count", "SELECT count(*) AS rows FROM lineitem")
def d01(spark, sf):
    return table(spark, sf, "lineitem").agg(F.count("*").alias("rows"))


@query("d02_class_sizes", "SELECT o_orderstatus AS label, count(*) AS rows FROM orders GROUP BY 1")
def d02(spark, sf):
    return models.class_sizes(table(spark, sf, "orders"), "o_orderstatus")


@query(
    "d03_smallest_class",
    "SELECT count(*) AS classes, min(rows) AS smallest_class FROM "
    "(SELECT o_orderstatus, count(*) AS rows FROM orders GROUP BY 1)",
)
def d03(spark, sf):
    return models.class_summary(table(spark, sf, "orders"), "o_orderstatus")


@query(
    "d04_min_max",
    f"SELECT min(TRY_CAST(P03 AS DOUBLE)) AS least, max(TRY_CAST(P03 AS DOUBLE)) AS greatest FROM {sub('poblacion')}",
)
def d04(spark, sf):
    age = as_double("P03")
    return view(spark, sf, "poblacion").agg(F.min(age).alias("least"), F.max(age).alias("greatest"))


@query(
    "d05_distinct_counts",
    f"SELECT count(DISTINCT (l_orderkey, l_linenumber)) AS keys, count(*) AS rows FROM lineitem",
)
def d05(spark, sf):
    return table(spark, sf, "lineitem").agg(
        F.count_distinct(F.struct("l_orderkey", "l_linenumber")).alias("keys"), F.count("*").alias("rows")
    )


@query("d06_distinct_rows", f"SELECT DISTINCT P02, P03, AUR FROM {sub('poblacion')}")
def d06(spark, sf):
    return view(spark, sf, "poblacion").select("P02", "P03", "AUR").distinct()


@query(
    "d07_distinct_values",
    "SELECT DISTINCT c_nationkey AS valor, lpad(c_nationkey::VARCHAR, 2, '0') AS codigo FROM customer",
)
def d07(spark, sf):
    value = F.col("c_nationkey").alias("valor")
    return table(spark, sf, "customer").select(value).distinct().withColumn("codigo", F.lpad(F.col("valor").cast("string"), 2, "0"))


INGESTION_LOG = [
    "CAST(o_orderkey AS STRING) AS id_ingesta",
    "o_orderstatus <> 'F' AS success",
    "o_custkey AS records_processed",
    "CAST(o_orderkey % 40 AS INT) AS columns_count",
    "CAST(o_custkey % 64 AS DOUBLE) AS file_size_mb",
    "CAST(o_orderkey % 16 + 1 AS DOUBLE) AS processing_time_seconds",
    "CAST(o_custkey % 1024 AS DOUBLE) AS throughput_records_per_second",
    "o_orderpriority = '1-URGENT' AS partition_applied",
    "CASE o_orderpriority WHEN '1-URGENT' THEN 'Archivo NO encontrado' WHEN '2-HIGH' THEN 'Permission denied' "
    "WHEN '3-MEDIUM' THEN 'bad Delimiter' WHEN '5-LOW' THEN 'unknown FORMAT' END AS error_message",
]
LOG_SQL = f"(SELECT {', '.join(INGESTION_LOG)} FROM orders)"


def _log(spark, sf):
    return table(spark, sf, "orders").selectExpr(*INGESTION_LOG)


@query(
    "d08_ingestion_statistics",
    f"""SELECT count(*) AS ingestions, count(*) FILTER (success) * 100.0::DOUBLE / count(*) AS success_rate,
    (sum(records_processed) FILTER (success))::BIGINT AS total_records_processed,
    sum(processing_time_seconds) FILTER (success) AS total_processing_time,
    avg(throughput_records_per_second) FILTER (success) AS average_throughput,
    max(throughput_records_per_second) FILTER (success) AS maximum_throughput,
    min(throughput_records_per_second) FILTER (success) AS minimum_throughput,
    avg(file_size_mb) FILTER (success) AS average_file_size_mb,
    count(*) FILTER (success AND partition_applied) AS files_with_partitioning,
    avg(columns_count) FILTER (success) AS average_columns_per_table FROM {LOG_SQL}""",
)
def d08(spark, sf):
    return reports.ingestion_statistics(_log(spark, sf))


CATEGORY = """CASE WHEN lower(coalesce(error_message, 'Error desconocido')) LIKE '%no encontrado%' THEN 'archivo_no_encontrado'
    WHEN lower(error_message) LIKE '%permission%' THEN 'permisos_archivo'
    WHEN lower(error_message) LIKE '%format%' OR lower(error_message) LIKE '%delimiter%' THEN 'formato_datos'
    ELSE 'error_general' END AS category"""


@query("d09_failures", f"SELECT id_ingesta, {CATEGORY} FROM {LOG_SQL} WHERE NOT success")
def d09(spark, sf):
    return reports.failures(_log(spark, sf)).select("id_ingesta", "category")


@query(
    "d09_failure_categories",
    f"SELECT category, count(*) AS failed, min(id_ingesta) AS first_id, max(id_ingesta) AS last_id FROM "
    f"(SELECT *, {CATEGORY} FROM {LOG_SQL} WHERE NOT success) GROUP BY 1",
)
def d09b(spark, sf):
    return reports.failure_categories(_log(spark, sf))


OPERATION_LOG = [
    "concat('tabla_', l_returnflag) AS table_name",
    "CASE WHEN l_linestatus = 'F' THEN 'variable_recoding' ELSE 'geographic_recoding' END AS operation_type",
    "concat('col_', CAST(l_linenumber AS STRING)) AS source_column",
    "l_quantity < 45 AS success",
    "CASE WHEN l_quantity >= 45 THEN concat('codigo ', CAST(l_partkey AS STRING)) END AS error_message",
]
OPERATION_SQL = f"(SELECT {', '.join(OPERATION_LOG)} FROM lineitem)"


def _operations(spark, sf):
    return table(spark, sf, "lineitem").selectExpr(*OPERATION_LOG)


@query(
    "d10_operation_statistics",
    f"""SELECT CASE WHEN grouping(table_name) = 0 THEN 'table' WHEN grouping(operation_type) = 0 THEN 'operation'
    ELSE 'overall' END AS level, coalesce(table_name, operation_type) AS name, count(*) AS total_operations,
    count(*) FILTER (success) AS successful_operations, count(*) FILTER (NOT success) AS failed_operations,
    count(*) FILTER (success) * 100.0::DOUBLE / count(*) AS success_rate
    FROM {OPERATION_SQL} GROUP BY GROUPING SETS ((), (table_name), (operation_type))""",
)
def d10(spark, sf):
    return reports.operation_statistics(_operations(spark, sf))


@query(
    "d10_failed_operations",
    f"SELECT table_name, operation_type, source_column, error_message FROM {OPERATION_SQL} WHERE NOT success",
)
def d10b(spark, sf):
    return reports.failed_operations(_operations(spark, sf))


def _usage(spark, sf):
    persons = table_features(view(spark, sf, "poblacion"), "poblacion", ["ID_HOG", "ID_PER", "registro_a", "registro_b"])
    return feature_usage(persons, "poblacion")


# features of persons that have a known source each, by their type; a feature counts if all its sources have a value
SUPPORT_SQL = f"""(SELECT age * 4 + sex * 3 + education * 3 AS demographic,
    province * 4 + household + household * age * 5 AS distributed_aggregate,
    age * education * job * 2 + age * education * area * 2 AS composite_index,
    age * education * job + education + kinship AS target_variable
    FROM (SELECT (count(P03) > 0)::BIGINT AS age, (count(P02) > 0)::BIGINT AS sex, (count(nivel_instruccion) > 0)::BIGINT AS education,
      (count(I01) > 0)::BIGINT AS province, (count(ID_VIV) > 0 AND count(ID_HOG) > 0)::BIGINT AS household,
      (count(ocupacion) > 0)::BIGINT AS job, (count(AUR) > 0)::BIGINT AS area, (count(parentesco) > 0)::BIGINT AS kinship
      FROM {sub('poblacion')}))"""


@query(
    "d11_features_by_type",
    f"""SELECT 'demographic' AS feature_type, 10 AS features, demographic AS supported_features FROM {SUPPORT_SQL}
    UNION ALL SELECT 'distributed_aggregate', 10, distributed_aggregate FROM {SUPPORT_SQL}
    UNION ALL SELECT 'composite_index', 4, composite_index FROM {SUPPORT_SQL}
    UNION ALL SELECT 'target_variable', 3, target_variable FROM {SUPPORT_SQL}""",
)
def d11(spark, sf):
    return features_by_type(_usage(spark, sf))


@query(
    "d12_question_coverage",
    f"""SELECT 'question_1_distributed_processing' AS question, 10 AS features_count, distributed_aggregate AS supported_count,
    'densidad_relativa_provincia_censo,dependientes_hogar,edad_maxima_hogar,edad_minima_hogar,edad_promedio_hogar,'
    || 'percentil_poblacional_censo,poblacion_total_provincia_censo,ranking_provincial_censo,ratio_dependencia_hogar,'
    || 'tamaño_hogar_calculado' AS features, distributed_aggregate >= 4 AS coverage_adequate FROM {SUPPORT_SQL}
    UNION ALL SELECT 'question_2_automated_features', 14, demographic + composite_index,
    'categoria_desarrollo,categoria_vulnerabilidad,completo_educacion_basica,es_dependiente_demografico,es_hombre,es_mujer,'
    || 'es_poblacion_activa,grupo_edad_detallado,grupo_edad_economico,indice_desarrollo_compuesto,'
    || 'indice_vulnerabilidad_compuesto,nivel_educativo_numerico,sexo_descripcion,tiene_educacion_superior',
    demographic + composite_index >= 10 FROM {SUPPORT_SQL}
    UNION ALL SELECT 'question_3_ensemble_targets', 3, target_variable,
    'target_educacion_superior,target_jefe_hogar,target_vulnerabilidad_alta', target_variable >= 3 FROM {SUPPORT_SQL}""",
)
def d12(spark, sf):
    return question_coverage(_usage(spark, sf))


EXPERIMENT_LOG = [
    "concat('Q', CAST(l_linenumber AS STRING)) AS research_question",
    "l_returnflag <> 'R' AND l_linenumber < 7 AS success",
    "CAST(l_quantity AS DOUBLE) AS auc_score",
    "CAST(l_suppkey AS DOUBLE) AS training_time_seconds",
    "CAST(l_partkey % 30 AS INT) AS feature_count",
]


@query(
    "d13_experiment_summary",
    f"""SELECT research_question, count(*) AS total_experiments, count(*) FILTER (success) AS successful_experiments,
    avg(auc_score) FILTER (success) AS average_auc_score,
    avg(training_time_seconds) FILTER (success) AS average_training_time_seconds,
    avg(feature_count) FILTER (success) AS average_feature_count
    FROM (SELECT {', '.join(EXPERIMENT_LOG)} FROM lineitem) GROUP BY 1 HAVING count(*) FILTER (success) > 0""",
)
def d13(spark, sf):
    return reports.experiment_summary(table(spark, sf, "lineitem").selectExpr(*EXPERIMENT_LOG))


RUN_METRICS = [
    "o_custkey AS record_count",
    "CAST(60 + o_custkey % 40 AS DOUBLE) AS data_quality_score",
    "CAST(o_orderkey % 8 AS DOUBLE) AS null_percentage",
    "CAST(o_orderkey % 4 AS DOUBLE) AS duplicate_percentage",
    "CAST(o_orderkey % 16 + 1 AS DOUBLE) AS processing_time_seconds",
    "o_orderstatus <> 'F' AS success",
]


@query(
    "d14_run_summary",
    f"""SELECT count(*) AS tables, sum(record_count)::BIGINT AS total_records,
    avg(data_quality_score) AS average_quality_score, avg(null_percentage) AS average_null_percentage,
    avg(duplicate_percentage) AS average_duplicate_percentage,
    sum(processing_time_seconds) AS total_processing_time_seconds,
    sum(record_count)::DOUBLE / sum(processing_time_seconds) AS average_throughput_records_per_second,
    bool_and(success) AS all_tables_persisted_successfully, bool_and(data_quality_score >= 70) AS quality_threshold_met
    FROM (SELECT {', '.join(RUN_METRICS)} FROM orders)""",
)
def d14(spark, sf):
    return reports.run_summary(table(spark, sf, "orders").selectExpr(*RUN_METRICS))
