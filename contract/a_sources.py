"""Scans, sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from contract.census import view, views
from contract.registry import query, table
from tallyweave.operators.quality import null_share
from tallyweave.operators.reports import as_json, text_summary
from tallyweave.sources import ingest, sinks, tables, text
from tallyweave.sources.workspace import new_path

ALL_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()
COLUMN_COUNTS = {
    "region": 2, "nation": 3, "customer": 5, "supplier": 4, "part": 6, "orders": 6, "lineitem": 11, "events": 6,
    "documents": 5, "embeddings": 3, "pages": 3, "benchmark": 2, "labels": 3, "conversations": 4,
}


def _counts_sql(names, extra=""):
    return " UNION ALL ".join(
        f"SELECT '{n}' AS table_name, count(*) AS rows, {COLUMN_COUNTS[n]} AS columns{extra} FROM {n}" for n in names
    )


@query("a01_parquet_scan", _counts_sql(["lineitem", "orders", "customer", "nation"], ", true AS success"))
def a01(spark, sf):
    records = [tables.load_table(spark, f"{sf}/{n}.parquet", n)[1] for n in ("lineitem", "orders", "customer", "nation")]
    return spark.createDataFrame(records, tables.LOAD_SCHEMA).select("table_name", "success", "rows", "columns")


@query(
    "a02_load_named_set",
    "SELECT 'lineitem' AS table_name, true AS success, count(*) AS rows, 11 AS columns FROM lineitem "
    "UNION ALL SELECT 'orders', true, count(*), 6 FROM orders "
    "UNION ALL SELECT 'customer', true, count(*), 5 FROM customer "
    "UNION ALL SELECT 'padron', false, 0, 0 "
    "UNION ALL SELECT 'dict_nation', true, count(*), 3 FROM nation "
    "UNION ALL SELECT 'dict_region', true, count(*), 2 FROM region",
)
def a02(spark, sf):
    _, records = tables.load_tables(
        spark,
        sf,
        data_tables=["lineitem", "orders", "customer", "padron"],
        dictionaries=["nation", "region"],
        required=["lineitem", "orders", "customer"],
    )
    return spark.createDataFrame(records, tables.LOAD_SCHEMA).select("table_name", "success", "rows", "columns")


ORDER_TEXT = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]


def _orders_as_text(spark, sf, delimiter):
    path = new_path(spark, "text")
    orders = table(spark, sf, "orders").select(*ORDER_TEXT)
    orders.write.option("header", True).option("sep", delimiter).csv(path)
    return path


@query(
    "a04_delimited_scan",
    "SELECT " + ", ".join(f"{c}::VARCHAR AS {c}" for c in ORDER_TEXT) + " FROM orders",
)
def a04(spark, sf):
    return text.scan_delimited(spark, _orders_as_text(spark, sf, ";"), ";")


# one control row per order: inactive ones, blank delimiters, groups and positions
CONTROL = [
    "CAST(o_orderkey AS STRING) AS id_ingesta",
    "CASE WHEN o_orderstatus = 'F' THEN '0' ELSE '1' END AS estado",
    "concat('archivo_', CAST(o_orderkey AS STRING), '.csv') AS nombre_archivo",
    "concat('tabla_', CAST(o_custkey AS STRING)) AS nombre_tabla",
    "'/entrada' AS path_origen",
    "'/salida' AS path_destino",
    "CASE WHEN o_orderkey % 3 = 0 THEN ';' END AS delimitador",
    "CASE WHEN o_orderkey % 4 = 0 THEN 'I01' END AS columna_particion",
    "CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderpriority END AS grupo_ingesta",
    "CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_custkey AS STRING) END AS orden_grupo",
]
ACTIVE_SQL = f"""
SELECT id_ingesta, nombre_archivo, nombre_tabla, path_origen, path_destino,
       coalesce(delimitador, ',') AS delimitador, columna_particion,
       coalesce(grupo_ingesta, 'default') AS grupo_ingesta, coalesce(TRY_CAST(orden_grupo AS INT), 1) AS orden_grupo
FROM (SELECT {', '.join(CONTROL)} FROM orders) WHERE estado = '1'"""


def _control(spark, sf):
    path = new_path(spark, "control")
    table(spark, sf, "orders").selectExpr(*CONTROL).write.option("header", True).csv(path)
    return text.load_control(spark, path)


@query("a05_control_scan", ACTIVE_SQL)
def a05(spark, sf):
    return _control(spark, sf)


@query(
    "a06_control_summary",
    f"""WITH c AS ({ACTIVE_SQL}),
    p AS (SELECT *, concat(orden_grupo::VARCHAR, '. ', nombre_archivo, ' -> ', nombre_tabla) AS entry,
          row_number() OVER (PARTITION BY grupo_ingesta ORDER BY orden_grupo, nombre_archivo, nombre_tabla) AS a,
          row_number() OVER (PARTITION BY grupo_ingesta ORDER BY orden_grupo DESC, nombre_archivo DESC, nombre_tabla DESC) AS z
          FROM c)
    SELECT grupo_ingesta, count(*) AS entries, max(CASE WHEN a = 1 THEN entry END) AS first_entry,
           max(CASE WHEN z = 1 THEN entry END) AS last_entry FROM p GROUP BY 1""",
)
def a06(spark, sf):
    return text.control_summary(_control(spark, sf))


LOG_COLUMNS = ["id_ingesta", "table_name", "success", "records_processed", "columns_count", "partition_applied", "integrity_check"]


@query(
    "a07_ingest_file",
    "SELECT '1' AS id_ingesta, 'ordenes' AS table_name, true AS success, count(*) AS records_processed, "
    "5 AS columns_count, true AS partition_applied, true AS integrity_check FROM orders",
)
def a07(spark, sf):
    source = _orders_as_text(spark, sf, "|")
    folder, name = source.rsplit("/", 1)
    entry = spark.createDataFrame(
        [("1", "1", name, "ordenes", folder, new_path(spark, "bronze"), "|", "o_orderstatus", "g", 1)],
        "id_ingesta string, estado string, nombre_archivo string, nombre_tabla string, path_origen string, "
        "path_destino string, delimitador string, columna_particion string, grupo_ingesta string, orden_grupo int",
    ).first()
    return spark.createDataFrame([ingest.ingest_file(spark, entry)], ingest.INGESTION_LOG_SCHEMA).select(*LOG_COLUMNS)


@query(
    "a08_ingest_all",
    "SELECT 'p' || o_orderpriority[1] AS id_ingesta, 't' || o_orderpriority[1] AS table_name, true AS success, "
    "count(*) AS records_processed, 4 AS columns_count, false AS partition_applied, true AS integrity_check "
    "FROM orders WHERE o_orderpriority <> '5-LOW' GROUP BY ALL "
    "UNION ALL SELECT 'px', 'tx', false, 0, 0, false, false",
)
def a08(spark, sf):
    """One source file per priority, one of them inactive, and one control row without a file."""
    folder = new_path(spark, "text")
    out = new_path(spark, "bronze")
    orders = table(spark, sf, "orders").select(*ORDER_TEXT).withColumn("g", F.substring("o_orderpriority", 1, 1))
    orders.drop("o_orderpriority").write.option("header", True).partitionBy("g").csv(folder)
    found = (
        table(spark, sf, "orders")
        .select(F.substring("o_orderpriority", 1, 1).alias("g"))
        .distinct()
        .unionByName(spark.createDataFrame([("x",)], "g string"))
    )
    control = found.select(
        F.concat(F.lit("p"), "g").alias("id_ingesta"),
        F.when(F.col("g") == "5", "0").otherwise("1").alias("estado"),
        F.concat(F.lit("g="), "g").alias("nombre_archivo"),
        F.concat(F.lit("t"), "g").alias("nombre_tabla"),
        F.lit(folder).alias("path_origen"),
        F.lit(out).alias("path_destino"),
        F.lit("falta").alias("columna_particion"),
    )
    return ingest.ingest_all(spark, control).select(*LOG_COLUMNS)


ORDER_CODES = ["o_orderkey", "o_totalprice", "lpad(CAST(o_custkey % 25 AS STRING), 2, '0') AS codigo"]
CONTENT_SQL = (
    "SELECT lpad((o_custkey % 25)::VARCHAR, 2, '0') AS codigo, count(*) AS rows, sum(o_orderkey)::BIGINT AS keys, "
    "sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS price FROM orders GROUP BY 1"
)


def _coded_orders(spark, sf):
    return table(spark, sf, "orders").selectExpr(*ORDER_CODES)


def _content(df):
    return df.groupBy("codigo").agg(
        F.count("*").alias("rows"),
        F.sum("o_orderkey").alias("keys"),
        F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("price"),
    )


@query("a09_partitioned_sink", CONTENT_SQL)
def a09(spark, sf):
    path, df = new_path(spark, "sink"), _coded_orders(spark, sf)
    sinks.write_table(df, path, "codigo")
    return _content(tables.scan_as(spark, path, df.schema))


def _wide_orders(spark, sf):
    age = F.expr("CAST(o_orderkey % 91 AS STRING)").alias("edad")
    return _coded_orders(spark, sf).withColumnRenamed("codigo", "codigo_provincia_2d").select("*", age)


@query(
    "a10_persist_wide_tables",
    "SELECT 'censo_master' AS table_name, count(*) AS record_count, 4 AS column_count, "
    "'codigo_provincia_2d' AS partition_column, true AS integrity_check, true AS layout_applied FROM orders "
    "UNION ALL SELECT 'otra', count(*), 5, NULL, true, false FROM customer",
)
def a10(spark, sf):
    named = {
        "censo_master": _wide_orders(spark, sf),
        "otra": table(spark, sf, "customer"),
    }
    written = sinks.persist_tables(named, new_path(spark, "silver"))
    return spark.createDataFrame(written, sinks.WRITE_SCHEMA).select(
        "table_name", "record_count", "column_count", "partition_column", "integrity_check", "layout_applied"
    )


@query(
    "a12_readback_verification",
    "SELECT count(*) AS record_count, 11 AS column_count, true AS integrity_check FROM lineitem",
)
def a12(spark, sf):
    path, df = new_path(spark, "sink"), table(spark, sf, "lineitem")
    sinks.write_table(df, path)
    return sinks.verification(spark, path, len(df.columns), df.count())


@query("a13_compaction", CONTENT_SQL)
def a13(spark, sf):
    path = new_path(spark, "small")
    _coded_orders(spark, sf).repartition(24).write.parquet(path)
    return _content(sinks.compacted(spark, path, new_path(spark, "compact")))


@query("a14_clustering", CONTENT_SQL)
def a14(spark, sf):
    return _content(
        sinks.write_clustered(_coded_orders(spark, sf), ["codigo", "o_totalprice"], new_path(spark, "clustered"))
    )


@query(
    "a14_files_skipped",
    "SELECT 'o_totalprice' AS \"column\", 8 AS files_before, 8 AS touched_before, true AS fewer_touched, "
    "count(*) FILTER (o_totalprice BETWEEN 100000 AND 110000) AS rows FROM orders "
    "UNION ALL SELECT 'edad', 8, 8, true, count(*) FILTER (o_orderkey % 91 BETWEEN 30 AND 34) FROM orders",
)
def a14_skipped(spark, sf):
    """Files that a filter has to read before and after clustering, by the least and greatest value of each file."""
    plain, laid = new_path(spark, "plain"), new_path(spark, "clustered")
    orders = table(spark, sf, "orders").selectExpr("o_orderkey", "o_totalprice", "CAST(o_orderkey % 91 AS INT) AS edad")
    orders.repartition(8, "o_orderkey").write.parquet(plain)
    before = spark.read.parquet(plain)
    after = sinks.write_clustered(before, ["o_totalprice", "edad"], laid, files=8)
    found = None
    for column, low, high in (("o_totalprice", 100000.0, 110000.0), ("edad", 30, 34)):
        rows = after.agg(F.count(F.when(F.col(column).between(low, high), 1)).alias("rows"))
        one = sinks.files_touched(before, column, low, high).select(
            F.col("files").cast("int").alias("files_before"), F.col("touched").cast("int").alias("touched_before")
        ).crossJoin(sinks.files_touched(after, column, low, high).select("touched")).crossJoin(rows)
        one = one.select(
            F.lit(column).alias("column"), "files_before", "touched_before", (F.col("touched") < F.col("touched_before")).alias("fewer_touched"), "rows"
        )
        found = one if found is None else found.unionByName(one)
    return found


@query("a15_discovery", _counts_sql(ALL_TABLES))
def a15(spark, sf):
    found = tables.discovered(spark, sf)
    from tallyweave.operators.quality import load_report

    return load_report({n: tables.scan(spark, p) for n, p in found.items()}).drop("kind")


@query("a16_input_size")
def a16(spark, sf):
    """MB of a table by the file system, beside the files that its scan reads."""
    size = F.lit(tables.path_size_mb(spark, f"{sf}/lineitem.parquet"))
    return tables.input_size(table(spark, sf, "lineitem")).withColumn("folder_mb", size)


@query(
    "a17_report_sink",
    "SELECT 'json' AS report, count(*) AS rows, 11 AS columns, 0.0::DOUBLE AS null_percent FROM lineitem "
    "UNION ALL SELECT 'text', count(*), 11, 0.0 FROM lineitem",
)
def a17(spark, sf):
    """Metrics written as JSON and as text lines, read back."""
    metrics = null_share(table(spark, sf, "lineitem"))
    json_path, text_path = new_path(spark, "report"), new_path(spark, "report")
    sinks.write_json_report(metrics, json_path)
    labels = {"rows": "Registros", "columns": "Columnas", "null_percent": "Nulos"}
    sinks.write_text_report(text_summary(metrics, labels), text_path)
    as_rows = spark.read.schema(metrics.schema).json(json_path)
    line = F.split("value", ": ")
    picked = [F.max(F.when(line[0] == v, line[1])).alias(k) for k, v in labels.items()]
    as_lines = spark.read.text(text_path).agg(*picked)
    return as_rows.select(F.lit("json").alias("report"), "rows", "columns", "null_percent").unionByName(
        as_lines.select(
            F.lit("text").alias("report"),
            F.col("rows").cast("long"),
            F.col("columns").cast("int"),
            F.col("null_percent").cast("double"),
        )
    )


@query(
    "a18_separate_dictionaries",
    "SELECT 'poblacion' AS table_name, 'data' AS kind, count(*) AS rows FROM lineitem UNION ALL "
    "SELECT 'dict_provincia', 'dictionary', count(*) FROM nation",
)
def a18(spark, sf):
    from tallyweave.operators.quality import load_report

    data, dicts = tables.separated(views(spark, sf, ["poblacion", "dict_provincia"]))
    return load_report(data).unionByName(load_report(dicts)).drop("columns")
