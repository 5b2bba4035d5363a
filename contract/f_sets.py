"""Order and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from contract.a_sources import ACTIVE_SQL, _control
from contract.census import sub, view
from contract.registry import query, table
from tallyweave.operators import quality


@query(
    "f01_two_key_sort",
    f"SELECT grupo_ingesta, orden_grupo, count(*) AS rows FROM ({ACTIVE_SQL}) GROUP BY 1, 2 ORDER BY 1, 2",
)
def f01(spark, sf):
    """Control rows by group and position: entries at each place, in order."""
    places = _control(spark, sf).groupBy("grupo_ingesta", "orden_grupo").agg(F.count("*").alias("rows"))
    return places.orderBy("grupo_ingesta", "orden_grupo")


@query("f04_distinct_rows", "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem")
def f04(spark, sf):
    return table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber").distinct()


@query(
    "f05_value_set_difference",
    f"""SELECT coalesce(o.codigo, d.codigo) AS codigo, CASE WHEN o.codigo IS NULL THEN 'domain_only'
    WHEN d.codigo IS NULL THEN 'observed_only' ELSE 'both' END AS status
    FROM (SELECT DISTINCT lpad(CANTON, 4, '0') AS codigo FROM {sub('poblacion')}) o
    FULL JOIN (SELECT DISTINCT lpad(CODIGO::VARCHAR, 4, '0') AS codigo FROM {sub('dict_canton')}) d ON o.codigo = d.codigo""",
)
def f05(spark, sf):
    code = lambda c: F.lpad(F.col(c).cast("string"), 4, "0").alias("codigo")
    observed = view(spark, sf, "poblacion").select(code("CANTON"))
    domain = view(spark, sf, "dict_canton").select(code("CODIGO"))
    return quality.domain_difference(observed, domain, "codigo")


@query(
    "f06_column_set_difference",
    f"""SELECT count(*) AS rows, count(*) FILTER (P02 IS NOT NULL AND P03 IS NOT NULL AND I01 IS NOT NULL) AS complete_rows,
    'ESCOLA' AS missing_columns, 3 AS matching_columns FROM {sub('poblacion')}""",
)
def f06(spark, sf):
    report = quality.schema_compliance(view(spark, sf, "poblacion"), ["P02", "P03", "I01", "ESCOLA"])
    return report.select("rows", "complete_rows", "missing_columns", "matching_columns")
