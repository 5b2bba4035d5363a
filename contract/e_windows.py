"""Values of a province or household on each of its rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from contract.census import sub, view
from contract.registry import query, table
from tallyweave.operators import groups, ranking

TIES = ["ID_HOG", "ID_PER", "registro_a", "registro_b"]


@query(
    "e01_province_total",
    "SELECT c_custkey, c_nationkey, count(*) OVER (PARTITION BY c_nationkey) AS poblacion_total_provincia FROM customer",
)
def e01(spark, sf):
    df = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    return groups.province_sizes(df, "c_nationkey", "poblacion_total_provincia")


@query(
    "e02_relative_density",
    "SELECT l_suppkey, count(*) OVER (PARTITION BY l_suppkey) / 100000.0::DOUBLE AS densidad_relativa_provincia FROM lineitem",
)
def e02(spark, sf):
    df = groups.province_sizes(table(spark, sf, "lineitem").select("l_suppkey"), "l_suppkey", "n")
    return df.select("l_suppkey", (F.col("n") / F.lit(100000)).alias("densidad_relativa_provincia"))


@query(
    "e03_province_rank",
    "SELECT c_nationkey, rows, dense_rank() OVER (ORDER BY rows DESC)::INT AS ranking_provincial FROM "
    "(SELECT c_nationkey, count(*) AS rows FROM customer GROUP BY 1)",
)
def e03(spark, sf):
    sizes = table(spark, sf, "customer").groupBy("c_nationkey").agg(F.count("*").alias("rows"))
    return ranking.dense_rank_of_sizes(sizes, "rows", "ranking_provincial")


@query(
    "e04_population_percentile",
    "SELECT c_custkey, c_nationkey, ntile(100) OVER (ORDER BY n DESC, c_nationkey, c_custkey)::INT AS percentil "
    "FROM (SELECT *, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer)",
)
def e04(spark, sf):
    df = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    sized = groups.province_sizes(df, "c_nationkey", "n")
    indexed = ranking.with_global_index(sized, ["n", "c_nationkey", "c_custkey"], "i", "rows", descending=["n"])
    return indexed.select(
        "c_custkey", "c_nationkey", ranking.ntile_of(F.col("i"), F.col("rows"), 100).alias("percentil")
    )


PROVINCE_SQL = f"""SELECT ID_HOG, ID_PER, I01, registro_a, registro_b, n AS poblacion_total_provincia_censo,
    n / 100000.0::DOUBLE AS densidad_relativa_provincia_censo,
    dense_rank() OVER (ORDER BY n DESC)::INT AS ranking_provincial_censo,
    ntile(100) OVER (ORDER BY n DESC, I01, {', '.join(TIES)})::INT AS percentil_poblacional_censo
    FROM (SELECT *, count(*) OVER (PARTITION BY I01) AS n FROM {sub('poblacion')})"""


@query("e01_e04_geographic_aggregates", PROVINCE_SQL)
def e_geo(spark, sf):
    df = view(spark, sf, "poblacion").select("ID_HOG", "ID_PER", "I01", "registro_a", "registro_b")
    return groups.geographic_aggregates(df, "censo", TIES)


AGE = "TRY_CAST(P03 AS INT)"
HOUSEHOLD_SQL = f"""SELECT ID_VIV, ID_HOG, ID_PER, P03, count(*) OVER w AS "tamaño_hogar_calculado",
    avg(TRY_CAST(P03 AS DOUBLE)) OVER w AS edad_promedio_hogar, max(TRY_CAST(P03 AS DOUBLE)) OVER w AS edad_maxima_hogar,
    min(TRY_CAST(P03 AS DOUBLE)) OVER w AS edad_minima_hogar,
    (sum(CASE WHEN {AGE} < 15 OR {AGE} >= 65 THEN 1 ELSE 0 END) OVER w)::BIGINT AS dependientes_hogar,
    (sum(CASE WHEN {AGE} < 15 OR {AGE} >= 65 THEN 1 ELSE 0 END) OVER w)::DOUBLE / count(*) OVER w AS ratio_dependencia_hogar
    FROM {sub('poblacion')} WINDOW w AS (PARTITION BY ID_VIV, ID_HOG)"""


@query("e05_e10_household_aggregates", HOUSEHOLD_SQL)
def e_household(spark, sf):
    return groups.household_aggregates(view(spark, sf, "poblacion").select("ID_VIV", "ID_HOG", "ID_PER", "P03"))


def _household_value(name: str):
    def run(spark, sf):
        df = view(spark, sf, "poblacion").select("ID_VIV", "ID_HOG", "P03")
        return groups.household_aggregates(df).select("ID_HOG", name)

    return run


for key, column in {
    "e05_household_size": "tamaño_hogar_calculado",
    "e06_household_mean_age": "edad_promedio_hogar",
    "e07_household_max_age": "edad_maxima_hogar",
    "e08_household_min_age": "edad_minima_hogar",
    "e09_household_dependants": "dependientes_hogar",
    "e10_household_dependency": "ratio_dependencia_hogar",
}.items():
    query(key, f'SELECT ID_HOG, "{column}" FROM ({HOUSEHOLD_SQL})')(_household_value(column))
