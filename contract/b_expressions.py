"""Projections, filters and scalar expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from contract.census import rx, sub, view
from contract.registry import query, table
from tallyweave.functions import columns as C
from tallyweave.functions import expressions as X


@query("b01_select_present", "SELECT o_orderkey, o_orderstatus FROM orders")
def b01(spark, sf):
    return C.select_present(table(spark, sf, "orders"), ["o_orderkey", "no_existe", "o_orderstatus"])


@query("b02_rename", "SELECT o_orderkey AS idHogar, o_custkey AS idVivienda, o_orderstatus AS estado FROM orders")
def b02(spark, sf):
    df = table(spark, sf, "orders")
    names = {"o_orderkey": "idHogar", "o_custkey": "idVivienda", "ausente": "x", "o_orderstatus": "estado"}
    return df.selectExpr(*C.renamed(names, df.columns))


@query("b03_select_by_name", "SELECT l_orderkey, l_partkey, l_linenumber, l_linestatus FROM lineitem")
def b03(spark, sf):
    df = table(spark, sf, "lineitem")
    keys = C.containing(df.columns, ["key"], exclude=["supp"], limit=15)
    return df.select(*keys, *C.starting(df.columns, ["l_line"]))


@query("b04_first_present", "SELECT I01 AS provincia, count(*) AS rows FROM " + sub("poblacion") + " GROUP BY 1")
def b04(spark, sf):
    df = view(spark, sf, "poblacion")
    c = C.first_present(df, ["codigo_provincia_2d", "codigo_provincia_2d_homo", "I01", "provincia_codigo"])
    return df.groupBy(F.col(c).alias("provincia")).agg(F.count("*").alias("rows"))


@query(
    "b05_computed_columns",
    "SELECT l_orderkey, l_linenumber, l_quantity * 2 AS doble, l_quantity + 1 AS sig FROM lineitem",
)
def b05(spark, sf):
    df = table(spark, sf, "lineitem").withColumns({"doble": F.col("l_quantity") * 2, "sig": F.col("l_quantity") + 1})
    return df.select("l_orderkey", "l_linenumber", "doble", "sig")


@query("b06_label", "SELECT doc_id, quality AS label FROM labels")
def b06(spark, sf):
    return C.with_label(table(spark, sf, "labels"), "quality").select("doc_id", "label")


@query(
    "b07_null_filters",
    f"SELECT P02 IS NULL AS sin_sexo, count(*) AS rows FROM {sub('poblacion')} WHERE P03 IS NOT NULL GROUP BY 1",
)
def b07(spark, sf):
    df = view(spark, sf, "poblacion").filter(F.col("P03").isNotNull())
    return df.groupBy(F.col("P02").isNull().alias("sin_sexo")).agg(F.count("*").alias("rows"))


@query(
    "b08_and_or",
    "SELECT o_orderstatus, count(*) AS rows FROM orders WHERE (o_totalprice >= 100000 AND o_orderstatus <> 'P') "
    "OR o_custkey < 100 GROUP BY 1",
)
def b08(spark, sf):
    rule = ((F.col("o_totalprice") >= 100000) & (F.col("o_orderstatus") != "P")) | (F.col("o_custkey") < 100)
    return table(spark, sf, "orders").filter(rule).groupBy("o_orderstatus").agg(F.count("*").alias("rows"))


@query(
    "b09_code_equality",
    "SELECT l_linenumber, count(*) AS rows, sum(CASE WHEN l_linenumber = 1 THEN 1 ELSE 0 END)::BIGINT AS unos "
    "FROM lineitem GROUP BY 1",
)
def b09(spark, sf):
    return (
        table(spark, sf, "lineitem")
        .groupBy("l_linenumber")
        .agg(F.count("*").alias("rows"), F.sum(X.flag(X.code_is("l_linenumber", "1"))).alias("unos"))
    )


@query(
    "b10_flag_any_case",
    "SELECT o_orderpriority, sum(CASE WHEN upper(CASE WHEN o_orderkey % 2 = 0 THEN 'si' ELSE 'No' END) = 'SI' "
    "THEN 1 ELSE 0 END)::BIGINT AS marcados FROM orders GROUP BY 1",
)
def b10(spark, sf):
    mark = F.when(F.col("o_orderkey") % 2 == 0, "si").otherwise("No")
    return (
        table(spark, sf, "orders")
        .groupBy("o_orderpriority")
        .agg(F.sum(X.flag(F.upper(mark) == "SI")).alias("marcados"))
    )


@query(
    "b11_in_list",
    "SELECT p_brand, count(*) AS rows FROM part WHERE p_type IN ('ECONOMY', 'PROMO') GROUP BY 1",
)
def b11(spark, sf):
    df = table(spark, sf, "part").filter(F.col("p_type").isin("ECONOMY", "PROMO"))
    return df.groupBy("p_brand").agg(F.count("*").alias("rows"))


@query(
    "b12_regex_search",
    f"SELECT {rx('p_name', 'RING|widget')} AS hit, count(*) AS rows FROM part GROUP BY 1",
)
def b12(spark, sf):
    hit = X.matches_any("p_name", ["RING", "widget"])
    return table(spark, sf, "part").groupBy(hit.alias("hit")).agg(F.count("*").alias("rows"))


@query(
    "b13_first_case",
    "SELECT o_orderkey, CASE WHEN o_totalprice < 50000 THEN 'BAJO' WHEN o_totalprice < 200000 THEN 'MEDIO' "
    "ELSE 'ALTO' END AS nivel FROM orders",
)
def b13(spark, sf):
    level = X.below_cuts(F.col("o_totalprice"), [("BAJO", 50000), ("MEDIO", 200000)], "ALTO")
    return table(spark, sf, "orders").select("o_orderkey", level.alias("nivel"))


@query(
    "b14_casts",
    f"SELECT ID_HOG, ID_PER, ID_PER::VARCHAR AS texto, TRY_CAST(P03 AS INT) AS entero, "
    f"TRY_CAST(P03 AS DOUBLE) AS doble FROM {sub('poblacion')}",
)
def b14(spark, sf):
    return view(spark, sf, "poblacion").select(
        "ID_HOG",
        "ID_PER",
        X.as_code("ID_PER").alias("texto"),
        X.as_int("P03").alias("entero"),
        X.as_double("P03").alias("doble"),
    )


@query(
    "b15_padded_codes",
    "SELECT c_custkey, lpad(c_nationkey::VARCHAR, 2, '0') AS c2, lpad(c_custkey::VARCHAR, 4, '0') AS c4, "
    "lpad((c_custkey * 1000)::VARCHAR, 6, '0') AS c6 FROM customer",
)
def b15(spark, sf):
    return table(spark, sf, "customer").select(
        "c_custkey",
        X.padded_code("c_nationkey", 2).alias("c2"),
        X.padded_code("c_custkey", 4).alias("c4"),
        X.padded_code(F.col("c_custkey") * 1000, 6).alias("c6"),
    )


@query(
    "b16_parent_code",
    "SELECT substr(lpad(c_custkey::VARCHAR, 6, '0'), 1, 2) AS c2, substr(lpad(c_custkey::VARCHAR, 6, '0'), 1, 4) AS c4, "
    "count(*) AS rows FROM customer GROUP BY 1, 2",
)
def b16(spark, sf):
    code = X.padded_code("c_custkey", 6)
    return (
        table(spark, sf, "customer")
        .groupBy(X.parent_code(code, 2).alias("c2"), X.parent_code(code, 4).alias("c4"))
        .agg(F.count("*").alias("rows"))
    )


@query(
    "b17_arithmetic",
    "SELECT l_orderkey, l_linenumber, 1 - l_discount AS neto, l_quantity / 100000.0::DOUBLE AS densidad, "
    "(l_quantity + l_tax + l_discount) / 3.0::DOUBLE AS media, "
    "CASE WHEN l_discount <> 0 THEN l_quantity / l_discount END AS razon FROM lineitem",
)
def b17(spark, sf):
    q, d, t = F.col("l_quantity"), F.col("l_discount"), F.col("l_tax")
    return table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        (F.lit(1) - d).alias("neto"),
        (q / F.lit(100000)).alias("densidad"),
        X.mean_of([q, t, d]).alias("media"),
        F.try_divide(q, d).alias("razon"),
    )


@query(
    "b18_aliases",
    "SELECT o.o_orderkey AS orden, c.c_name AS cliente FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey",
)
def b18(spark, sf):
    o, c = table(spark, sf, "orders").alias("o"), table(spark, sf, "customer").alias("c")
    joined = o.join(c, F.col("o.o_custkey") == F.col("c.c_custkey"))
    return joined.select(F.col("o.o_orderkey").alias("orden"), F.col("c.c_name").alias("cliente"))
