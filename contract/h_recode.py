"""Recoding by dictionary and three-level geography."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contract.census import GEO_LOOKUP, PROVINCE_LOOKUP, dictionaries, region_rules, sub, view, views
from contract.registry import query, table
from tallyweave.operators import geo, recode


@query("h01_geographic_lookup", f"SELECT * FROM {GEO_LOOKUP}")
def h01(spark, sf):
    return geo.geographic_lookup(dictionaries(spark, sf))


@query(
    "h02_homologated_codes",
    f"SELECT id_persona, ciudad, lpad(ciudad, 6, '0') AS codigo_parroquia_6d_homo FROM {sub('enemdu_personas')}",
)
def h02(spark, sf):
    df = view(spark, sf, "enemdu_personas").select("id_persona", "ciudad")
    return geo.homologated_table(df, "enemdu_personas")


@query(
    "h03_names_by_parish",
    f"""SELECT p.id_persona, lpad(p.ciudad, 6, '0') AS codigo_parroquia_6d_homo, k.parroquiaNombre, k.cantonNombre, k.provinciaNombre
    FROM {sub('enemdu_personas')} p LEFT JOIN {GEO_LOOKUP} k ON lpad(p.ciudad, 6, '0') = k.codigo_parroquia_6d""",
)
def h03(spark, sf):
    df = geo.homologated_table(view(spark, sf, "enemdu_personas"), "enemdu_personas")
    return geo.enriched(df, geo.lookup_levels(geo.geographic_lookup(dictionaries(spark, sf)))).select(
        "id_persona", "codigo_parroquia_6d_homo", "parroquiaNombre", "cantonNombre", "provinciaNombre"
    )


@query(
    "h03_names_by_province",
    f"""SELECT h.ID_HOG, lpad(h.I01, 2, '0') AS codigo_provincia_2d_homo, k.* FROM {sub('hogar')} h
    LEFT JOIN {PROVINCE_LOOKUP} k ON lpad(h.I01, 2, '0') = k.codigo_provincia_2d""",
)
def h03b(spark, sf):
    df = geo.homologated(view(spark, sf, "hogar").select("ID_HOG", "I01"), ["I01"])
    return geo.enriched(df, geo.lookup_levels(geo.geographic_lookup(dictionaries(spark, sf)))).drop("I01")


@query(
    "h04_urban_flag",
    "SELECT area, CASE WHEN area = '1' THEN 1 ELSE 0 END AS es_urbano, count(*) AS rows FROM "
    f"{sub('enemdu_personas')} GROUP BY 1, 2 UNION ALL "
    f"SELECT AUR, CASE WHEN AUR = '1' THEN 1 ELSE 0 END, count(*) FROM {sub('poblacion')} GROUP BY 1, 2",
)
def h04(spark, sf):
    survey = geo.with_urban_flag(view(spark, sf, "enemdu_personas").select("area"))
    census = geo.with_urban_flag(view(spark, sf, "poblacion").select("AUR")).withColumnRenamed("AUR", "area")
    return (
        survey.groupBy("area", "es_urbano")
        .agg(F.count("*").alias("rows"))
        .unionByName(census.groupBy("area", "es_urbano").agg(F.count("*").alias("rows")))
    )


REGION_SQL = f"""SELECT c_custkey, codigo_provincia_2d, provinciaNombre, {region_rules('codigo_provincia_2d', 'provinciaNombre')}
    FROM (SELECT c_custkey, lpad(c_nationkey::VARCHAR, 2, '0') AS codigo_provincia_2d, NOMBRE AS provinciaNombre
          FROM customer LEFT JOIN {sub('dict_provincia')} d ON d.CODIGO = c_nationkey)"""


def _regions(spark, sf):
    names = geo.province_names(view(spark, sf, "dict_provincia"))
    customers = table(spark, sf, "customer").select(
        "c_custkey", F.lpad(F.col("c_nationkey").cast("string"), 2, "0").alias("codigo_provincia_2d")
    )
    return geo.with_regions(customers.join(names, ["codigo_provincia_2d"], "left"))


@query("h05_natural_region", f"SELECT c_custkey, codigo_provincia_2d, region_geografica FROM ({REGION_SQL})")
def h05(spark, sf):
    return _regions(spark, sf).select("c_custkey", "codigo_provincia_2d", "region_geografica")


@query("h06_named_region", f"SELECT c_custkey, provinciaNombre, region_especifica FROM ({REGION_SQL})")
def h06(spark, sf):
    return _regions(spark, sf).select("c_custkey", "provinciaNombre", "region_especifica")


# a dictionary row per line of the supplied table: several labels per code, blanks, a switched-off variable
DICTIONARY = [
    "concat('V', CAST(l_linenumber AS STRING)) AS variable_codigo",
    "CASE WHEN l_quantity < 48 THEN CAST(l_suppkey AS STRING) END AS codigo",
    "CASE WHEN l_returnflag <> 'R' THEN concat('E', CAST(l_partkey AS STRING)) END AS etiqueta",
    "CASE WHEN l_linenumber < 4 THEN concat('campo_', CAST(l_linenumber AS STRING)) END AS campo",
    "CASE WHEN l_linenumber = 6 THEN 'NO' WHEN l_linestatus = 'F' THEN 'SI' ELSE 'si' END AS requiere_recodificacion",
]
MAPPINGS_SQL = f"""SELECT variable_codigo, codigo, max(etiqueta) AS etiqueta, max(campo) AS campo, count(*) AS filas
    FROM (SELECT {', '.join(DICTIONARY)} FROM lineitem) WHERE upper(requiere_recodificacion) = 'SI'
    AND codigo IS NOT NULL AND etiqueta IS NOT NULL AND variable_codigo IN ('V1','V2','V5','V6') GROUP BY 1, 2"""


@query("h07_variables_to_recode", MAPPINGS_SQL)
def h07(spark, sf):
    return recode.mappings_for(table(spark, sf, "lineitem").selectExpr(*DICTIONARY), ["V1", "V2", "V5", "V6"])


@query(
    "h08_recode_literal_map",
    "SELECT o_orderkey, o_orderstatus, CASE o_orderstatus WHEN 'F' THEN 'Finalizada' WHEN 'O' THEN 'Orden abierta' "
    "ELSE o_orderstatus END AS estado FROM orders",
)
def h08(spark, sf):
    """P has no label and stays; O has two labels and the greater one wins."""
    rows = [
        ("o_orderstatus", "F", "Finalizada", "estado", "SI"),
        ("o_orderstatus", "O", "Abierta", "estado", "SI"),
        ("o_orderstatus", "O", "Orden abierta", "estado", "si"),
        ("o_orderstatus", "P", None, "estado", "SI"),
        ("o_orderpriority", "1-URGENT", "Urgente", "prioridad", "NO"),
    ]
    from contract.census import DICTIONARY_SCHEMA

    df = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return recode.recode_table(df, spark.createDataFrame(rows, DICTIONARY_SCHEMA))[0]


@query(
    "h08_recode_by_join",
    f"""SELECT l_orderkey, l_linenumber, l_suppkey, coalesce(m.etiqueta, l_suppkey::VARCHAR) AS proveedor
    FROM lineitem LEFT JOIN ({MAPPINGS_SQL}) m ON m.variable_codigo = 'V1' AND m.codigo = l_suppkey::VARCHAR""",
)
def h08b(spark, sf):
    """A dictionary made from the whole table, joined because it may be of any size."""
    dictionary = table(spark, sf, "lineitem").selectExpr(*DICTIONARY)
    mappings = recode.mappings_for(dictionary, ["V1"])
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("V1"))
    out = recode.recode_by_join(df, mappings.select("codigo", "etiqueta"), "V1", "proveedor")
    return out.withColumnRenamed("V1", "l_suppkey")


RECODED_PERSON_SQL = f"""SELECT p.*, CASE P02 WHEN '1' THEN 'Hombre' WHEN '2' THEN 'Mujer' ELSE P02 END AS sexo_texto,
    CASE AUR WHEN '1' THEN 'Urbano' ELSE AUR END AS "AUR_recoded",
    lpad(I01, 2, '0') AS codigo_provincia_2d_homo, lpad(CANTON, 4, '0') AS codigo_canton_4d_homo FROM {sub('poblacion')} p"""

from contract.census import CANTON_LOOKUP  # noqa: E402

GEO_PERSON_SQL = f"""SELECT *, {region_rules('codigo_provincia_2d', 'provinciaNombre')}, CASE WHEN AUR = '1' THEN 1 ELSE 0 END AS es_urbano
    FROM ({RECODED_PERSON_SQL}) r LEFT JOIN {CANTON_LOOKUP} k ON r.codigo_canton_4d_homo = k.codigo_canton_4d"""


@query(
    "h09_geographic_recode",
    f"""SELECT ID_HOG, ID_PER, codigo_canton_4d_homo, cantonNombre, provinciaNombre, es_urbano, region_geografica, region_especifica
    FROM ({GEO_PERSON_SQL})""",
)
def h09(spark, sf):
    levels = geo.lookup_levels(geo.geographic_lookup(dictionaries(spark, sf)))
    return geo.geographic_recode(view(spark, sf, "poblacion"), "poblacion", levels).select(
        "ID_HOG", "ID_PER", "codigo_canton_4d_homo", "cantonNombre", "provinciaNombre", "es_urbano",
        "region_geografica", "region_especifica",
    )


def _recoded(spark, sf):
    names = ["poblacion", "hogar", "vivienda", "enemdu_personas", "enemdu_vivienda"]
    return recode.recode_all(views(spark, sf, names), dictionaries(spark, sf))


@query("h10_recoded_persons", GEO_PERSON_SQL)
def h10(spark, sf):
    return _recoded(spark, sf)[0]["poblacion"]


@query(
    "h10_recoded_tables",
    f"""SELECT 'poblacion' AS table_name, (SELECT count(*) FROM lineitem) AS rows, 25 AS columns
    UNION ALL SELECT 'hogar', count(*), 11 FROM orders UNION ALL SELECT 'vivienda', count(*), 15 FROM customer
    UNION ALL SELECT 'enemdu_personas', count(*), 23 FROM orders UNION ALL SELECT 'enemdu_vivienda', count(*), 16 FROM customer""",
)
def h10b(spark, sf):
    from tallyweave.operators.quality import load_report

    return load_report(_recoded(spark, sf)[0]).drop("kind")


LABELS_SQL = f"""SELECT 'poblacion' AS table_name, 'sexo_texto' AS target, CASE P02 WHEN '1' THEN 'Hombre' WHEN '2' THEN 'Mujer' ELSE P02 END AS label
    FROM {sub('poblacion')} UNION ALL SELECT 'poblacion', 'AUR_recoded', CASE AUR WHEN '1' THEN 'Urbano' ELSE AUR END FROM {sub('poblacion')}
    UNION ALL SELECT 'hogar', 'dormitorios_texto', CASE H01 WHEN '1' THEN 'Uno' ELSE H01 END FROM {sub('hogar')}
    UNION ALL SELECT 'vivienda', 'tipo_vivienda', CASE V01 WHEN '1' THEN 'Casa' WHEN '2' THEN 'Departamento' ELSE V01 END FROM {sub('vivienda')}
    UNION ALL SELECT 'enemdu_personas', 'sexo_texto', CASE p02 WHEN '1' THEN 'Hombre' ELSE p02 END FROM {sub('enemdu_personas')}
    UNION ALL SELECT 'enemdu_vivienda', 'tipo_vivienda', CASE vi01 WHEN '0' THEN 'Casa' ELSE vi01 END FROM {sub('enemdu_vivienda')}"""


@query("h10_recoded_labels", f"SELECT table_name, target, label, count(*) AS rows FROM ({LABELS_SQL}) GROUP BY 1, 2, 3")
def h10d(spark, sf):
    """Rows of every label of every recoded column of all tables."""
    tables, log = _recoded(spark, sf)
    labels = [
        tables[name].groupBy(F.lit(name).alias("table_name"), F.lit(target).alias("target"), F.col(target).alias("label")).count()
        for name, operation, _, target, *_ in log
        if operation == "variable_recoding"
    ]
    return reduce(DataFrame.unionByName, labels).withColumnRenamed("count", "rows")


LOG_SQL = """SELECT column0 AS table_name, column1 AS operation_type, column2 AS source_column, column3 AS target_column,
    column4::BIGINT AS mappings_applied, true AS success, NULL::VARCHAR AS error_message FROM (VALUES
    ('poblacion', 'variable_recoding', 'AUR', 'AUR_recoded', 1), ('poblacion', 'variable_recoding', 'P02', 'sexo_texto', 3),
    ('poblacion', 'geographic_recoding', 'I01,CANTON', 'geography', 9),
    ('hogar', 'variable_recoding', 'H01', 'dormitorios_texto', 1), ('hogar', 'geographic_recoding', 'I01', 'geography', 5),
    ('vivienda', 'variable_recoding', 'V01', 'tipo_vivienda', 2), ('vivienda', 'geographic_recoding', 'I01,CANTON', 'geography', 8),
    ('enemdu_personas', 'variable_recoding', 'p02', 'sexo_texto', 1),
    ('enemdu_personas', 'geographic_recoding', 'ciudad', 'geography', 10),
    ('enemdu_vivienda', 'variable_recoding', 'vi01', 'tipo_vivienda', 1),
    ('enemdu_vivienda', 'geographic_recoding', 'ciudad', 'geography', 9)) v(column0, column1, column2, column3, column4)"""
ROWS_SQL = """SELECT 'poblacion' AS table_name, count(*) AS rows FROM lineitem UNION ALL SELECT 'hogar', count(*) FROM orders
    UNION ALL SELECT 'vivienda', count(*) FROM customer UNION ALL SELECT 'enemdu_personas', count(*) FROM orders
    UNION ALL SELECT 'enemdu_vivienda', count(*) FROM customer"""


@query("h10_operation_log", f"SELECT * FROM ({LOG_SQL}) JOIN ({ROWS_SQL}) USING (table_name)")
def h10c(spark, sf):
    tables, log = _recoded(spark, sf)
    from tallyweave.operators.quality import load_report

    rows = load_report(tables).select("table_name", "rows")
    return spark.createDataFrame(log, recode.LOG_SCHEMA).join(rows, "table_name")
