"""Census and survey tables as projections of the supplied tables.

Each select list is written once in SQL that Spark and DuckDB read alike; the Spark side
uses it with ``selectExpr``, the oracle side as a subquery.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from contract.registry import table

DWELLING_OF_ORDER = "CAST(floor({c} / 10) AS BIGINT)"

PERSON = [
    DWELLING_OF_ORDER.format(c="l_orderkey") + " AS ID_VIV",
    "l_orderkey AS ID_HOG",
    "l_linenumber AS ID_PER",
    "CAST(l_suppkey % 25 AS STRING) AS I01",
    "CAST(l_partkey % 3 AS STRING) AS I02",
    "CAST((l_suppkey % 25) * 100 + l_partkey % 7 AS STRING) AS CANTON",
    "CASE WHEN l_returnflag = 'A' THEN '1' WHEN l_returnflag = 'R' THEN '2' "
    "WHEN l_linestatus = 'F' THEN '9' END AS P02",
    "CASE WHEN l_quantity = 50 THEN 'x' WHEN l_quantity = 49 THEN NULL "
    "ELSE CAST(CAST(l_quantity * 2 AS INT) AS STRING) END AS P03",
    "CASE WHEN l_linestatus = 'F' THEN '1' ELSE '2' END AS AUR",
    "CASE CAST(round(l_discount * 100) AS INT) WHEN 0 THEN 'Analfabeto' WHEN 1 THEN 'Ninguno' "
    "WHEN 2 THEN 'Primaria' WHEN 3 THEN 'SECUNDARIA' WHEN 4 THEN 'Bachillerato' WHEN 5 THEN 'Superior' "
    "WHEN 6 THEN 'Universitario' WHEN 7 THEN 'Post-grado' WHEN 8 THEN 'Maestria' WHEN 9 THEN 'Otro' "
    "END AS nivel_instruccion",
    "CASE CAST(round(l_tax * 100) AS INT) WHEN 0 THEN 'Empleado publico' WHEN 1 THEN 'Asalariado' "
    "WHEN 2 THEN 'Desempleo abierto' WHEN 3 THEN 'Inactivo' WHEN 4 THEN 'No ocupado' "
    "WHEN 5 THEN 'Cuenta propia' WHEN 6 THEN 'Patrono' WHEN 7 THEN 'Jornalero' END AS ocupacion",
    "CASE l_linenumber WHEN 1 THEN 'Jefe de hogar' WHEN 2 THEN 'Conyuge' WHEN 3 THEN 'Hijo' "
    "WHEN 7 THEN 'Representante' ELSE 'Otro pariente' END AS parentesco",
    "l_partkey AS registro_a",
    "l_suppkey AS registro_b",
]
HOUSEHOLD = [
    DWELLING_OF_ORDER.format(c="o_orderkey") + " AS ID_VIV",
    "o_orderkey AS ID_HOG",
    "CAST(o_custkey % 25 AS STRING) AS I01",
    "CAST(o_custkey % 6 AS STRING) AS H01",
    "CAST(o_orderkey % 9 + 1 AS STRING) AS H1303",
]
DWELLING = [
    "c_custkey AS ID_VIV",
    "CAST(c_nationkey AS STRING) AS I01",
    "CAST(c_nationkey * 100 + c_custkey % 7 AS STRING) AS CANTON",
    "CASE c_mktsegment WHEN 'AUTOMOBILE' THEN '1' WHEN 'BUILDING' THEN '2' WHEN 'FURNITURE' THEN '3' "
    "WHEN 'HOUSEHOLD' THEN '4' ELSE '5' END AS V01",
    "CAST(c_custkey % 4 AS STRING) AS V0201R",
    "nullif(c_mktsegment, 'MACHINERY') AS tipo_techo",
]
SURVEY_PERSON = [
    "nullif(o_custkey, 7) AS id_vivienda",
    "o_custkey % 2 + CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END AS id_hogar",
    "o_orderkey AS id_persona",
    "CAST(((o_custkey % 25) * 100 + o_custkey % 7) * 100 + o_custkey % 11 AS STRING) AS ciudad",
    "CAST(o_orderkey % 61 AS STRING) AS p24",
    "CAST(o_orderkey % 4 AS STRING) AS p40",
    "CAST(o_orderkey % 5 AS STRING) AS p41",
    "CASE WHEN o_orderpriority = '5-LOW' THEN NULL "
    "ELSE CAST(CAST(floor(o_totalprice / 500) AS BIGINT) AS STRING) END AS ingrl",
    "CAST(o_orderkey % 97 AS STRING) AS p03",
    "CASE WHEN o_orderkey % 2 = 0 THEN '1' ELSE '2' END AS p02",
    "CASE WHEN o_orderstatus = 'F' THEN '1' ELSE '2' END AS area",
    "CASE o_orderpriority WHEN '1-URGENT' THEN 'Empleado publico' WHEN '2-HIGH' THEN 'Asalariado privado' "
    "WHEN '3-MEDIUM' THEN 'Desempleo' WHEN '5-LOW' THEN 'Inactivo' ELSE 'Cuenta propia' END AS ocupacion",
]
SURVEY_DWELLING = [
    "nullif(c_custkey, 11) AS id_vivienda",
    "c_custkey % 2 AS id_hogar",
    "CAST(((c_custkey % 25) * 100 + c_custkey % 7) * 100 + c_custkey % 11 AS STRING) AS ciudad",
    "CAST(c_custkey % 5 AS STRING) AS vi01",
    "CAST(c_custkey % 4 AS STRING) AS vi02",
    "c_mktsegment AS servicio_higienico",
]
PROVINCE = [
    "n_nationkey AS CODIGO",
    "CASE n_nationkey WHEN 1 THEN 'Azuay' WHEN 9 THEN 'GUAYAS' WHEN 17 THEN 'Pichincha' ELSE n_name END AS NOMBRE",
]
CANTON = [
    "s_nationkey * 100 + s_suppkey % 7 AS CODIGO",
    "concat('CANTON ', CAST(s_nationkey * 100 + s_suppkey % 7 AS STRING)) AS NOMBRE",
]
PARISH = [
    "(c_nationkey * 100 + c_custkey % 7) * 100 + c_custkey % 11 AS CODIGO",
    "concat('PARROQUIA ', CAST((c_nationkey * 100 + c_custkey % 7) * 100 + c_custkey % 11 AS STRING)) AS NOMBRE",
]

SOURCES = {
    "poblacion": ("lineitem", PERSON),
    "hogar": ("orders", HOUSEHOLD),
    "vivienda": ("customer", DWELLING),
    "enemdu_personas": ("orders", SURVEY_PERSON),
    "enemdu_vivienda": ("customer", SURVEY_DWELLING),
    "dict_provincia": ("nation", PROVINCE),
    "dict_canton": ("supplier", CANTON),
    "dict_parroquia": ("customer", PARISH),
}

DICTIONARY_SCHEMA = (
    "variable_codigo string, codigo string, etiqueta string, campo string, requiere_recodificacion string"
)
# a lower-case flag, a second label for a code, a null label, a switched-off variable, an absent variable
DICTIONARY_ROWS = [
    ("P02", "1", "Hombre", "sexo_texto", "SI"),
    ("P02", "2", "Mujer", "sexo_texto", "si"),
    ("P02", "2", "Dama", "sexo_texto", "SI"),
    ("AUR", "1", "Urbano", None, "SI"),
    ("AUR", "2", None, None, "SI"),
    ("I02", "0", "Zona 0", "zona", "NO"),
    ("H01", "1", "Uno", "dormitorios_texto", "SI"),
    ("V01", "1", "Casa", "tipo_vivienda", "SI"),
    ("V01", "2", "Departamento", "tipo_vivienda", "SI"),
    ("p02", "1", "Hombre", "sexo_texto", "SI"),
    ("vi01", "0", "Casa", "tipo_vivienda", "SI"),
    ("Z99", "1", "Nada", "nada", "SI"),
]


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A census table from the supplied tables."""
    if name in ("dict_censo", "dict_enemdu"):
        return spark.createDataFrame(DICTIONARY_ROWS, DICTIONARY_SCHEMA)
    source, items = SOURCES[name]
    df = table(spark, sf_dir, source).selectExpr(*items)
    return df.distinct() if name.startswith("dict_") else df


def views(spark: SparkSession, sf_dir: str, names: list[str] | None = None) -> dict[str, DataFrame]:
    return {n: view(spark, sf_dir, n) for n in names or [*SOURCES, "dict_censo", "dict_enemdu"]}


def dictionaries(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    names = ["dict_provincia", "dict_canton", "dict_parroquia", "dict_censo", "dict_enemdu"]
    return views(spark, sf_dir, names)


def sub(name: str) -> str:
    """The same table as a DuckDB subquery."""
    source, items = SOURCES[name]
    distinct = "DISTINCT " if name.startswith("dict_") else ""
    return f"(SELECT {distinct}{', '.join(items)} FROM {source})"


# --- oracle fragments -------------------------------------------------------------------

AGE = "TRY_CAST(P03 AS INT)"


def age_rules(age: str = AGE) -> str:
    return f"""
    CASE WHEN {age} < 5 THEN 'PRIMERA_INFANCIA' WHEN {age} < 12 THEN 'INFANCIA' WHEN {age} < 18 THEN 'ADOLESCENCIA'
         WHEN {age} < 27 THEN 'JUVENTUD' WHEN {age} < 60 THEN 'ADULTEZ' ELSE 'ADULTO_MAYOR' END AS grupo_edad_detallado,
    CASE WHEN {age} < 15 THEN 'DEPENDIENTE_MENOR' WHEN {age} < 65 THEN 'POBLACION_ACTIVA'
         ELSE 'DEPENDIENTE_MAYOR' END AS grupo_edad_economico,
    CASE WHEN {age} < 15 OR {age} >= 65 THEN 1 ELSE 0 END AS es_dependiente_demografico,
    CASE WHEN {age} >= 15 AND {age} < 65 THEN 1 ELSE 0 END AS es_poblacion_activa"""


def sex_rules(sex: str = "P02") -> str:
    return f"""
    CASE {sex} WHEN '1' THEN 'HOMBRE' WHEN '2' THEN 'MUJER' ELSE 'NO_ESPECIFICADO' END AS sexo_descripcion,
    CASE WHEN {sex} = '2' THEN 1 ELSE 0 END AS es_mujer,
    CASE WHEN {sex} = '1' THEN 1 ELSE 0 END AS es_hombre"""


def rx(c: str, terms: str) -> str:
    return f"regexp_matches({c}, '({terms})', 'i')"


EDUCATION_RULES = f"""
    CASE WHEN {rx('nivel_instruccion', 'superior|universitario|post-grado')} THEN 1 ELSE 0 END AS tiene_educacion_superior,
    CASE WHEN {rx('nivel_instruccion', 'secundaria|bachillerato')} THEN 1 ELSE 0 END AS completo_educacion_basica,
    CASE WHEN {rx('nivel_instruccion', 'analfabet|ninguno')} THEN 0
         WHEN {rx('nivel_instruccion', 'primaria')} THEN 1
         WHEN {rx('nivel_instruccion', 'secundaria|bachillerato')} THEN 2
         WHEN {rx('nivel_instruccion', 'superior|universitario')} THEN 3
         WHEN {rx('nivel_instruccion', 'post-grado|maestr|doctor')} THEN 4
         ELSE 1 END AS nivel_educativo_numerico"""

# persons with every row-level rule
PERSON_RULES = f"""
(SELECT *, CASE WHEN indice_vulnerabilidad_compuesto >= 0.7 THEN 'ALTA'
               WHEN indice_vulnerabilidad_compuesto >= 0.4 THEN 'MEDIA' ELSE 'BAJA' END AS categoria_vulnerabilidad,
          CASE WHEN indice_desarrollo_compuesto >= 0.7 THEN 'ALTO'
               WHEN indice_desarrollo_compuesto >= 0.4 THEN 'MEDIO' ELSE 'BAJO' END AS categoria_desarrollo
 FROM (SELECT *, (es_dependiente_demografico + (1 - tiene_educacion_superior)
               + CASE WHEN {rx('ocupacion', 'desempleo|inactiv|no ocupa')} THEN 1 ELSE 0 END)
               / 3.0::DOUBLE AS indice_vulnerabilidad_compuesto,
          (nivel_educativo_numerico / 4.0::DOUBLE + es_poblacion_activa + es_urbano)
               / 3.0::DOUBLE AS indice_desarrollo_compuesto
       FROM (SELECT *, {age_rules()}, {sex_rules()}, {EDUCATION_RULES},
                    CASE WHEN AUR = '1' THEN 1 ELSE 0 END AS es_urbano
             FROM {sub('poblacion')})))"""

GEO_LOOKUP = f"""
(SELECT DISTINCT p.codigo_parroquia_6d, p.parroquiaNombre, p.codigo_canton_4d, c.cantonNombre,
        p.codigo_provincia_2d, v.provinciaNombre
 FROM (SELECT DISTINCT lpad(CODIGO::VARCHAR, 6, '0') AS codigo_parroquia_6d, NOMBRE AS parroquiaNombre,
              substr(lpad(CODIGO::VARCHAR, 6, '0'), 1, 4) AS codigo_canton_4d,
              substr(lpad(CODIGO::VARCHAR, 6, '0'), 1, 2) AS codigo_provincia_2d FROM {sub('dict_parroquia')}) p
 LEFT JOIN (SELECT DISTINCT lpad(CODIGO::VARCHAR, 4, '0') AS codigo_canton_4d, NOMBRE AS cantonNombre,
              substr(lpad(CODIGO::VARCHAR, 4, '0'), 1, 2) AS codigo_provincia_2d FROM {sub('dict_canton')}) c
   ON p.codigo_canton_4d = c.codigo_canton_4d AND p.codigo_provincia_2d = c.codigo_provincia_2d
 LEFT JOIN (SELECT DISTINCT lpad(CODIGO::VARCHAR, 2, '0') AS codigo_provincia_2d, NOMBRE AS provinciaNombre
            FROM {sub('dict_provincia')}) v ON p.codigo_provincia_2d = v.codigo_provincia_2d)"""

CANTON_LOOKUP = (
    f"(SELECT DISTINCT codigo_canton_4d, cantonNombre, codigo_provincia_2d, provinciaNombre FROM {GEO_LOOKUP})"
)
PROVINCE_LOOKUP = f"(SELECT DISTINCT codigo_provincia_2d, provinciaNombre FROM {GEO_LOOKUP})"


def region_rules(code: str, name: str) -> str:
    return f"""
    CASE WHEN {code} IN ('01','02','03','04','05','06','18') THEN 'SIERRA'
         WHEN {code} IN ('07','08','09','12','13','21','23','24') THEN 'COSTA'
         WHEN {code} IN ('14','15','16','19','22') THEN 'AMAZONIA'
         WHEN {code} = '20' THEN 'GALAPAGOS' ELSE 'OTRAS' END AS region_geografica,
    CASE WHEN {rx(name, 'quito|pichincha')} THEN 'CAPITAL' WHEN {rx(name, 'guayas|guayaquil')} THEN 'COMERCIAL'
         WHEN {rx(name, 'azuay|cuenca')} THEN 'PATRIMONIAL' ELSE 'OTRAS_PROVINCIAS' END AS region_especifica"""
