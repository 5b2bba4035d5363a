"""Wide tables and whole runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from contract.census import CANTON_LOOKUP, age_rules, dictionaries, region_rules, sex_rules, sub, view, views
from contract.i_features import CENSUS_TARGETS, SURVEY_TARGETS
from contract.registry import query
from tallyweave.operators import features, geo, quality
from tallyweave.operators.groups import household_aggregates, province_sizes
from tallyweave.operators.joins import join_keeping
from tallyweave.plans.master import census_master, master_tables, survey_master
from tallyweave.plans.medallion import run_silver
from tallyweave.sources.workspace import new_path

TIES = ["ID_HOG", "ID_PER", "registro_a", "registro_b"]


@query(
    "j00_flagship",
    f"""SELECT provinciaNombre, region_geografica, grupo_edad_detallado, count(*) AS personas,
    sum(es_dependiente_demografico)::BIGINT AS dependientes, avg(edad) AS edad_media,
    max(tamano) AS hogar_mayor, max(n) AS poblacion_provincia
    FROM (SELECT *, {region_rules('codigo_provincia_2d', 'provinciaNombre')}, {age_rules()}, TRY_CAST(P03 AS DOUBLE) AS edad,
            count(*) OVER (PARTITION BY ID_VIV, ID_HOG) AS tamano, count(*) OVER (PARTITION BY codigo_provincia_2d) AS n
          FROM (SELECT p.*, k.* FROM {sub('poblacion')} p JOIN {sub('hogar')} h ON p.ID_VIV = h.ID_VIV AND p.ID_HOG = h.ID_HOG
                JOIN {sub('vivienda')} v ON p.ID_VIV = v.ID_VIV
                LEFT JOIN {CANTON_LOOKUP} k ON lpad(p.CANTON, 4, '0') = k.codigo_canton_4d))
    GROUP BY 1, 2, 3""",
)
def j00(spark, sf):
    """Persons with geography, age rules and household size, joined wide, by province and age group."""
    levels = geo.lookup_levels(geo.geographic_lookup(dictionaries(spark, sf)))
    persons = geo.with_regions(geo.enriched(geo.homologated(view(spark, sf, "poblacion"), ["CANTON"]), levels))
    persons = province_sizes(features.age_features(persons), "codigo_provincia_2d", "poblacion_total_provincia")
    households = household_aggregates(view(spark, sf, "poblacion"), onto=view(spark, sf, "hogar"))
    home = join_keeping(
        households,
        view(spark, sf, "vivienda"),
        {"ID_VIV": "ID_VIV"},
        ["ID_VIV AS viv", "ID_HOG AS hog", "`tamaño_hogar_calculado`"],
        ["V01"],
    )
    wide = join_keeping(
        persons, home, {"ID_VIV": "viv", "ID_HOG": "hog"}, [f"`{c}`" for c in persons.columns], ["`tamaño_hogar_calculado`"]
    )
    return wide.groupBy("provinciaNombre", "region_geografica", "grupo_edad_detallado").agg(
        F.count("*").alias("personas"),
        F.sum("es_dependiente_demografico").alias("dependientes"),
        F.avg(F.col("P03").try_cast("double")).alias("edad_media"),
        F.max("tamaño_hogar_calculado").alias("hogar_mayor"),
        F.max("poblacion_total_provincia").alias("poblacion_provincia"),
    )


CENSUS_BASE_SQL = f"""SELECT p.ID_VIV AS idVivienda, p.ID_HOG AS idHogar, p.ID_PER AS idPersona, p.P03 AS edad, p.P02 AS sexoCodigo,
    p.I01 AS provinciaCodigo, p.I02 AS ubicacionCodigo, p.CANTON AS cantonCodigo, p.grupo_edad_detallado, p.grupo_edad_economico,
    p.es_dependiente_demografico, p.es_poblacion_activa, p.nivel_instruccion, h.H01 AS numeroDormitorios, h.H1303 AS totalPersonasHogar,
    v.V01 AS tipoViviendaCodigo, v.V0201R AS materialParedesCodigo, v.tipo_techo
    FROM (SELECT *, {age_rules()} FROM {sub('poblacion')}) p
    JOIN {sub('hogar')} h ON p.ID_VIV = h.ID_VIV AND p.ID_HOG = h.ID_HOG
    JOIN {sub('vivienda')} v ON p.ID_VIV = v.ID_VIV"""


def _census_inputs(spark, sf):
    return views(spark, sf, ["poblacion", "hogar", "vivienda"])


@query("j01_census_master", CENSUS_BASE_SQL)
def j01(spark, sf):
    tables = _census_inputs(spark, sf)
    tables["poblacion"] = features.age_features(tables["poblacion"])
    return census_master(tables)


SURVEY_BASE_SQL = f"""SELECT p.id_vivienda AS idVivienda, p.id_hogar AS idHogar, p.id_persona AS idPersona,
    p.p24 AS horasTrabajadasSemana, p.ingrl AS ingresoLaboral, p.p03 AS edad,
    p.target_empleo_formal, p.target_ingresos_suficientes, v.vi01 AS tipoViviendaEnemdu, v.vi02 AS materialParedesEnemdu,
    v.servicio_higienico
    FROM {SURVEY_TARGETS} p JOIN {sub('enemdu_vivienda')} v ON p.id_vivienda = v.id_vivienda AND p.id_hogar = v.id_hogar"""


def _survey_inputs(spark, sf):
    tables = views(spark, sf, ["enemdu_personas", "enemdu_vivienda"])
    persons = tables["enemdu_personas"]
    tables["enemdu_personas"] = features.survey_targets(persons, persons.columns)
    return tables


@query("j02_survey_master", SURVEY_BASE_SQL)
def j02(spark, sf):
    return survey_master(_survey_inputs(spark, sf))


def _metrics_sql(name: str, base: str, columns: int, nullable: list[str], provinces: str, flags: int, targets: str) -> str:
    nulls = " + ".join(f"count(*) FILTER ({c} IS NULL)" for c in nullable)
    return f"""SELECT '{name}' AS table_name, count(*) AS record_count, {columns} AS column_count,
    ({nulls}) * 100.0::DOUBLE / (count(*) * {columns}) AS null_percentage,
    (count(*) - count(DISTINCT concat_ws('|', idVivienda, idHogar, idPersona))) * 100.0::DOUBLE / count(*) AS duplicate_percentage,
    {provinces}::BIGINT AS geographic_coverage,
    {flags} AS feature_count, '{targets}' AS target_variables FROM ({base})"""


def _scored_sql(metrics: str) -> str:
    return f"""SELECT *, round(greatest(0, 100 - null_percentage * 2) * 0.3::DOUBLE
    + greatest(0, 100 - duplicate_percentage * 5) * 0.4::DOUBLE + least(100, geographic_coverage * 4) * 0.2::DOUBLE
    + least(100, feature_count * 2) * 0.1::DOUBLE, 1) AS data_quality_score FROM ({metrics})"""


@query(
    "j03_master_tables",
    _scored_sql(
        _metrics_sql(
            "censo_master",
            CENSUS_BASE_SQL,
            18,
            ["edad", "sexoCodigo", "nivel_instruccion", "tipo_techo"],
            "count(DISTINCT provinciaCodigo)",
            4,
            "",
        )
        + " UNION ALL "
        + _metrics_sql(
            "enemdu_master", SURVEY_BASE_SQL, 11, ["ingresoLaboral"], "0", 0, "target_empleo_formal,target_ingresos_suficientes"
        )
    ),
)
def j03(spark, sf):
    tables = _census_inputs(spark, sf) | _survey_inputs(spark, sf)
    tables["poblacion"] = features.age_features(tables["poblacion"])
    return quality.all_wide_table_metrics(master_tables(tables))


def silver_run(spark, sf):
    return run_silver(spark, views(spark, sf), new_path(spark, "silver"))


J04_SQL = f"""WITH p AS (SELECT t.*, g.provinciaNombre, count(*) OVER (PARTITION BY t.ID_VIV, t.ID_HOG) AS tamano
    FROM {CENSUS_TARGETS} t LEFT JOIN {CANTON_LOOKUP} g ON lpad(t.CANTON, 4, '0') = g.codigo_canton_4d)
    SELECT p.provinciaNombre, grupo_edad_detallado, categoria_vulnerabilidad, count(*) AS personas,
    sum(target_vulnerabilidad_alta) AS vulnerables, sum(target_jefe_hogar) AS jefes, sum(tamano)::BIGINT AS tamanos,
    count(v.tipo_techo) AS techos
    FROM p JOIN {sub('hogar')} h ON p.ID_VIV = h.ID_VIV AND p.ID_HOG = h.ID_HOG JOIN {sub('vivienda')} v ON p.ID_VIV = v.ID_VIV
    GROUP BY 1, 2, 3"""


@query("j04_silver_census", J04_SQL)
def j04(spark, sf):
    wide = silver_run(spark, sf).tables["censo_master"]
    return wide.groupBy("provinciaNombre", "grupo_edad_detallado", "categoria_vulnerabilidad").agg(
        F.count("*").alias("personas"),
        F.sum("target_vulnerabilidad_alta").alias("vulnerables"),
        F.sum("target_jefe_hogar").alias("jefes"),
        F.sum("tamaño_hogar_calculado").alias("tamanos"),
        F.count("tipo_techo").alias("techos"),
    )


@query(
    "j04_silver_survey",
    f"""SELECT k.parroquiaNombre IS NOT NULL AS localizado, sexo_texto, sexo_descripcion, grupo_edad_detallado, count(*) AS personas,
    sum(es_poblacion_activa)::BIGINT AS activos, sum(target_empleo_formal) AS formales, sum(target_ingresos_suficientes) AS suficientes
    FROM (SELECT *, {age_rules('TRY_CAST(p03 AS INT)')}, {sex_rules('p02')}, CASE p02 WHEN '1' THEN 'Hombre' ELSE p02 END AS sexo_texto FROM {SURVEY_TARGETS}) p
    JOIN {sub('enemdu_vivienda')} v ON p.id_vivienda = v.id_vivienda AND p.id_hogar = v.id_hogar
    LEFT JOIN (SELECT DISTINCT lpad(CODIGO::VARCHAR, 6, '0') AS c, NOMBRE AS parroquiaNombre FROM {sub('dict_parroquia')}) k
    ON lpad(p.ciudad, 6, '0') = k.c GROUP BY 1, 2, 3, 4""",
)
def j04b(spark, sf):
    wide = silver_run(spark, sf).tables["enemdu_master"]
    located = F.col("provinciaNombre").isNotNull().alias("localizado")
    return wide.groupBy(located, "sexo_texto", "sexo_descripcion", "grupo_edad_detallado").agg(
        F.count("*").alias("personas"),
        F.sum("es_poblacion_activa").alias("activos"),
        F.sum("target_empleo_formal").alias("formales"),
        F.sum("target_ingresos_suficientes").alias("suficientes"),
    )


@query("j04_silver_metrics")
def j04c(spark, sf):
    return silver_run(spark, sf).metrics
